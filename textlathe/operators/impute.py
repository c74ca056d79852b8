"""Filling missing fields by message passing over a Chow-Liu tree.

Numeric fields are cut into quantile bins, categorical ones keep their most frequent
levels; rarer ones share a state, within which they are as likely as they are frequent.
Pair counts over all rows
give mutual informations, whose maximum spanning tree is the model. For a record with
missing fields, its observed fields and what records of the same group say about a
missing field enter as evidence; one sweep up and one down the tree give every missing
field's posterior, decoded to the mode or to a bin's median.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlathe.runtime import cut_lineage

OTHER = "\x00other"


@dataclass
class TreeModel:
    """Nodes, tree and probabilities; a few kilobytes, whatever the table's size."""

    numeric: list[str]
    categorical: list[str]
    edges: dict[str, list[float]] = field(default_factory=dict)
    medians: dict[str, list[float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    #: For each categorical field its most frequent rarer level, and that one's share of them.
    rarer: dict[str, tuple[str, float]] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    root: np.ndarray | None = None
    tables: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def nodes(self) -> list[str]:
        return self.numeric + self.categorical

    def states(self, name: str) -> int:
        return len(self.medians[name]) if name in self.medians else len(self.levels[name]) + 1


def bin_of(value: Column, edges: list[float]) -> Column:
    """The bin's number: how many edges lie below or at the value; null for a null."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int") if edges else F.lit(0)


def coded(df: DataFrame, model: TreeModel) -> DataFrame:
    """Adds a state column `s0`, `s1`, ... for each node, null where it is missing."""
    cols = {}
    for k, name in enumerate(model.nodes):
        c = F.col(name)
        if name in model.numeric:
            state = bin_of(c, model.edges[name])
        else:
            levels = model.levels[name]
            known = F.element_at(F.create_map(*[F.lit(x) for n, v in enumerate(levels) for x in (v, n)]), c) if levels else F.lit(None)
            state = F.coalesce(known, F.lit(len(levels))).cast("int")
        cols[f"s{k}"] = F.when(c.isNotNull(), state)
    return df.withColumns(cols)


def fit_tree(df: DataFrame, numeric: list[str], categorical: list[str], bins: int = 12, levels: int = 32, smoothing: float = 0.5) -> TreeModel:
    """Fit the tree on every row of `df`; three small aggregates reach the driver.

    `numeric` columns hold doubles, null where missing; `categorical` ones strings.
    """
    model = TreeModel(list(numeric), list(categorical))
    if numeric:
        cuts = [n / bins for n in range(1, bins)]
        got = df.agg(*[F.percentile_approx(F.col(c), cuts, 10_000).alias(c) for c in numeric]).first()
        model.edges = {c: sorted(set(got[c] or [])) for c in numeric}
    model.levels = {c: [] for c in categorical}
    if categorical:
        ranked = (
            df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in categorical])).alias("x"))
            .where("x.v is not null").groupBy("x.c", "x.v").count()
        )
        # counted values only are ordered; at most `levels` + 1 rows of each column reach the driver
        place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("count"), "v"))
        totals = {r.c: r.n for r in ranked.groupBy("c").agg(F.sum("count").alias("n")).collect()}
        for r in ranked.withColumn("n", place).where(F.col("n") <= levels + 1).orderBy("c", "n").collect():
            if r.n <= levels:
                model.levels[r.c].append(r.v)
                totals[r.c] -= r["count"]
            else:
                model.rarer[r.c] = (r.v, r["count"] / totals[r.c])
    if numeric:
        mid = [
            F.percentile_approx(F.when(bin_of(F.col(c), model.edges[c]) == b, F.col(c)), 0.5, 10_000).alias(f"{c}|{b}")
            for c in numeric for b in range(len(model.edges[c]) + 1)
        ]
        row = df.agg(*mid).first()
        for c in numeric:
            n, e = len(model.edges[c]) + 1, model.edges[c]
            model.medians[c] = [row[f"{c}|{b}"] if row[f"{c}|{b}"] is not None else (e[min(b, len(e) - 1)] if e else 0.0) for b in range(n)]
    n = len(model.nodes)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}").alias("a"), F.col(f"s{j}").alias("b")) for i in range(n) for j in range(i, n)]
    counted = (
        coded(df, model).select(F.explode(F.array(*pairs)).alias("x"))
        .where("x.a is not null and x.b is not null").groupBy("x.i", "x.j", "x.a", "x.b").count().collect()
    )
    size = [model.states(c) for c in model.nodes]
    joint = {(i, j): np.full((size[i], size[j]), smoothing / size[j]) for i in range(n) for j in range(n) if i != j}
    single = [np.full(s, smoothing) for s in size]
    for r in counted:
        if r.i == r.j:
            single[r.i][r.a] += r["count"]
        else:
            joint[r.i, r.j][r.a, r.b] += r["count"]
            joint[r.j, r.i][r.b, r.a] += r["count"]
    weight = np.full((n, n), -1.0)
    for (i, j), t in joint.items():
        p = t / t.sum()
        weight[i, j] = float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
    model.order, model.parent = [0], [-1] * n
    while len(model.order) < n:
        i, j = max(((i, j) for i in model.order for j in range(n) if j not in model.order), key=lambda e: (weight[e], -e[1]))
        model.order.append(j)
        model.parent[j] = i
    model.root = single[0] / single[0].sum()
    for j in model.order[1:]:
        t = joint[model.parent[j], j]
        model.tables[j] = t / t.sum(1, keepdims=True)
    return model


def posteriors(model: TreeModel, evidence: list[np.ndarray]) -> list[np.ndarray]:
    """Each node's posterior for a batch: `evidence[k]` has a row of likelihoods a record."""
    up, to_parent = [e.copy() for e in evidence], {}
    for j in reversed(model.order[1:]):
        m = up[j] @ model.tables[j].T
        to_parent[j] = m / m.max(1, keepdims=True)
        up[model.parent[j]] = up[model.parent[j]] * to_parent[j]
    down = {model.order[0]: np.broadcast_to(model.root, up[model.order[0]].shape)}
    for j in model.order[1:]:
        i = model.parent[j]
        rest = down[i] * up[i] / np.maximum(to_parent[j], 1e-300)
        m = rest @ model.tables[j]
        down[j] = m / m.sum(1, keepdims=True)
    out = []
    for k in range(len(model.nodes)):
        p = down[k] * up[k]
        out.append(p / np.maximum(p.sum(1, keepdims=True), 1e-300))
    return out


def group_evidence(df: DataFrame, model: TreeModel, group: str) -> DataFrame:
    """For each group, as parallel arrays, the states of its fields (`pos`, numbered
    through all fields), their counts, and each one's median or most frequent value.

    `df` has the state columns of `coded`. Rows are aggregated by (group, field, state,
    value) first, with partial sums before the shuffle, so a group that holds a third of
    all rows still gives no more rows than its fields have states.
    """
    numbers, texts, at = [], [], 0
    for k, c in enumerate(model.nodes):
        pos = (F.lit(at) + F.col(f"s{k}")).alias("pos")
        if c in model.numeric:
            numbers.append(F.struct(pos, F.col(c).alias("m")))
        else:
            texts.append(F.struct(pos, F.col(c).alias("t")))
        at += model.states(c)
    parts = []
    for entries in (numbers, texts):
        if entries:
            rows = df.where(F.col(group).isNotNull()).select(group, F.explode(F.array(*entries)).alias("x")).select(group, "x.*").where("pos is not null")
            if entries is numbers:
                parts.append(rows.groupBy(group, "pos").agg(F.count("*").alias("n"), F.percentile_approx("m", 0.5, 1000).alias("m"), F.lit(None).cast("string").alias("t")))
            else:
                told = rows.groupBy(group, "pos", "t").agg(F.count("*").alias("n")).groupBy(group, "pos")
                parts.append(told.agg(F.sum("n").alias("n"), F.lit(None).cast("double").alias("m"), F.max_by("t", F.struct("n", "t")).alias("t")))
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    mates = F.collect_list(F.struct("pos", "n", "m", "t"))
    return counted.groupBy(group).agg(mates.alias("mates")).select(group, *[F.col(f"mates.{c}").alias(f"mates_{c}") for c in ("pos", "n", "m", "t")])


def fill_missing(df: DataFrame, row_id: str, group: str, numeric: list[str], categorical: list[str], model: TreeModel | None = None) -> DataFrame:
    """One row for each row of `df`: its id, its group, and for each field the value,
    `<field>_fill` and `<field>_confidence`.

    `<field>_fill` is null for a given value, `group` for one filled with evidence from
    records of the same group, `tree` for one inferred from the record's own fields.
    Fields are missing where null (NaN counts as null if the caller makes it so).
    Rows without a group are filled by the tree alone; repeated rows are filled each;
    other columns are ignored; an empty table gives an empty result.
    """
    picked = df.select(row_id, group, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    # the narrow rows are read for every statistic of the tree: worked out and written once
    picked = cut_lineage(picked.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numeric}))
    model = model or fit_tree(picked, numeric, categorical)
    stated = coded(picked, model)
    states = stated.join(group_evidence(stated, model, group), group, "left")
    names = model.nodes
    schema = T.StructType([T.StructField(row_id, picked.schema[row_id].dataType), T.StructField(group, picked.schema[group].dataType)])
    for c in names:
        schema.add(c, T.DoubleType() if c in numeric else T.StringType()).add(f"{c}_fill", T.StringType()).add(f"{c}_confidence", T.DoubleType())

    def run(frames):
        for frame in frames:
            yield filled_batch(frame, model, row_id, group)[schema.names]

    gaps = F.lit(False)
    for c in names:
        gaps = gaps | F.col(c).isNull()
    whole = states.where(~gaps).select(
        row_id, group, *[x for c in names for x in (F.col(c), F.lit(None).cast("string").alias(f"{c}_fill"), F.lit(None).cast("double").alias(f"{c}_confidence"))]
    )
    return states.where(gaps).mapInPandas(run, schema).unionByName(whole)


def filled_batch(frame: pd.DataFrame, model: TreeModel, row_id: str, group: str) -> pd.DataFrame:
    n, names = len(frame), model.nodes
    sizes = [model.states(c) for c in names]
    ends = np.cumsum([0, *sizes])
    votes, mids, texts = np.zeros((n, ends[-1])), np.full((n, ends[-1]), np.nan), np.full((n, ends[-1]), None, object)
    has = np.array([p is not None for p in frame["mates_pos"]], bool)
    if has.any():
        flat = lambda c: np.concatenate([np.asarray(x, object if c == "t" else float) for x in frame[f"mates_{c}"][has]])
        rows = np.repeat(np.flatnonzero(has), [len(p) for p in frame["mates_pos"][has]])
        pos = flat("pos").astype(int)
        votes[rows, pos], mids[rows, pos], texts[rows, pos] = flat("n"), flat("m"), flat("t")
    evidence, missing = [], []
    for k, c in enumerate(names):
        state = frame[f"s{k}"].to_numpy(dtype=float, na_value=np.nan)
        gone = np.isnan(state)
        e = np.ones((n, sizes[k]))
        e[~gone] = 1e-9
        e[np.flatnonzero(~gone), state[~gone].astype(int)] = 1.0
        v = votes[:, ends[k] : ends[k + 1]]
        told = gone & (v.sum(1) > 0)
        # a group member's state is right but for an error spread over the other states
        e[told] = np.exp((v - v.max(1, keepdims=True)) * np.log(20.0))[told]
        evidence.append(e)
        missing.append(gone)
    post = posteriors(model, evidence)
    out = {row_id: frame[row_id], group: frame[group]}
    every = np.arange(n)
    for k, c in enumerate(names):
        p, gone, part = post[k], missing[k], slice(ends[k], ends[k + 1])
        v = votes[:, part]
        told = gone & (v.sum(1) > 0)
        alone = gone & ~told
        fill, sure = np.full(n, None, object), np.full(n, np.nan)
        among = np.where(v > 0, p, -1.0).argmax(1)
        if c in model.numeric:
            value = frame[c].to_numpy(dtype=float, na_value=np.nan).copy()
            value[told] = mids[:, part][every, among][told]
            value[alone] = np.array(model.medians[c])[p.argmax(1)][alone]
            sure[alone] = p.max(1)[alone]
        else:
            value = frame[c].to_numpy(dtype=object).copy()
            value[told] = texts[:, part][every, among][told]
            rare, share = model.rarer.get(c, (None, 0.0))
            q = np.concatenate([p[:, :-1], p[:, -1:] * share], axis=1)  # of the rarer levels only the most frequent can be the mode
            value[alone] = np.array([*model.levels[c], rare], object)[q.argmax(1)][alone]
            sure[alone] = q.max(1)[alone]
            alone = alone & np.array([x is not None for x in value], bool)
            sure[gone & ~told & ~alone] = np.nan
        sure[told] = p[every, among][told]
        fill[told], fill[alone] = "group", "tree"
        out[c] = value
        out[f"{c}_fill"], out[f"{c}_confidence"] = fill, np.where(np.isnan(sure), None, sure)
    return pd.DataFrame(out)
