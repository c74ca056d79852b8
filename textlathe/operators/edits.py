"""Text errors: edit scripts as rows, error tables, generated errors, overlap measures."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlathe.functions.udfs import edit_script_udf

GENERAL = "<gen>"


def edit_rows(pairs: DataFrame, wrong: str, right: str) -> DataFrame:
    """One row for each edit from a wrong to a right word: op, error, fix, place.

    A transposition gives a row for each of its two letters, a deletion fixes to
    `<del>`, an insertion errs by `<ins>`; places are shares of the wrong word's length.
    """
    e = pairs.withColumn("_e", edit_script_udf(F.col(wrong), F.col(right))).select(wrong, right, F.explode("_e.edits").alias("e"))
    at = lambda c, i: F.substring(F.col(c), i + 1, F.lit(1))
    i, j = F.col("e.s1_idx"), F.col("e.s2_idx")
    row = lambda op, err, fix, pos: F.struct(F.lit(op).alias("op"), err.alias("error"), fix.alias("fix"), pos.cast("int").alias("abs_pos"))
    rows = (
        F.when(F.col("e.op") == "transpose", F.array(row("transpose", at(wrong, i), at(wrong, i + 1), i), row("transpose", at(wrong, i + 1), at(wrong, i), i + 1)))
        .when(F.col("e.op") == "delete", F.array(row("delete", at(wrong, i), F.lit("<del>"), i)))
        .when(F.col("e.op") == "insert", F.array(row("insert", F.lit("<ins>"), at(right, j), i)))
        .otherwise(F.array(row("substitute", at(wrong, i), at(right, j), i)))
    )
    out = e.select(wrong, right, F.explode(rows).alias("r")).select(wrong, right, "r.*")
    return out.withColumn("pct_pos", F.try_divide("abs_pos", F.length(wrong)))


def printable(df: DataFrame) -> DataFrame:
    """Rows whose error and fix are printable ASCII or a mark."""
    ok = lambda c: F.col(c).rlike(r"^[\x20-\x7e\t\n\r\x0b\x0c]*$") | F.col(c).isin("<ins>", "<del>")
    return df.where(ok("error") & ok("fix"))


class ErrorModel:
    """Where errors fall, of what kind there, and what stands for what; small tables.

    Kinds are known for each place, and signs for each sign that they stand for or stand
    after; what was never seen there is drawn from the general table.
    """

    def __init__(self, places: dict[float, float], kinds: dict, swaps: dict[str, dict[str, float]], extra: dict[str, dict[str, float]]):
        self.places, self.kinds, self.swaps, self.extra = places, kinds, swaps, extra

    @classmethod
    def fit(cls, edits: DataFrame, places: int = 10) -> ErrorModel:
        """From edit rows; the tables are bounded by kinds, places and printable signs."""
        e = printable(edits)
        bin_ = F.least(F.lit(places - 1), F.floor(F.col("pct_pos") * places))
        where: dict[float, float] = {}
        kinds: dict = {GENERAL: {}}
        for r in e.groupBy(bin_.alias("b"), "op").agg(F.count("*").alias("n")).collect():
            kinds[GENERAL][r.op] = kinds[GENERAL].get(r.op, 0) + r.n
            if r.b is not None:
                where[r.b / places] = where.get(r.b / places, 0) + r.n
                kinds.setdefault(r.b / places, {})[r.op] = r.n
        swaps: dict[str, dict[str, float]] = {GENERAL: {}}
        extra: dict[str, dict[str, float]] = {GENERAL: {}}
        wrong = e.columns[0]
        before = F.substring(F.col(wrong), F.col("abs_pos"), F.lit(1))  # the sign that an extra one stands after
        for table, op, given, drawn in ((swaps, "substitute", F.col("fix"), "error"), (extra, "delete", before, "error")):
            for r in e.where(F.col("op") == op).groupBy(given.alias("g"), F.col(drawn).alias("d")).agg(F.count("*").alias("n")).collect():
                table.setdefault(r.g, {})[r.d] = r.n
                table[GENERAL][r.d] = table[GENERAL].get(r.d, 0) + r.n
        return cls(where or {0.0: 1}, kinds if kinds[GENERAL] else {GENERAL: {"delete": 1}}, swaps, extra)

    def draw(self, table: dict, rng: random.Random):
        keys = sorted(table, key=str)
        return rng.choices(keys, [table[k] for k in keys])[0]

    def spoil(self, word: str, rng: random.Random) -> str:
        """One error of a kind drawn for a drawn place: the reverse of the fix it needs."""
        place = self.draw(self.places, rng)
        at = min(len(word) - 1, int(place * len(word)))
        kind = self.draw(self.kinds.get(place) or self.kinds[GENERAL], rng)
        if kind == "insert":
            return word[:at] + word[at + 1 :]
        if kind == "delete":
            table = self.extra.get(word[at]) or self.extra[GENERAL]
            return word[: at + 1] + (self.draw(table, rng) if table else word[at]) + word[at + 1 :]
        if kind == "substitute":
            table = self.swaps.get(word[at]) or self.swaps[GENERAL]
            return word[:at] + (self.draw(table, rng) if table else word[at]) + word[at + 1 :]
        return word[:at] + word[at : at + 2][::-1] + word[at + 2 :]


def typo_variants(df: DataFrame, key: str, text: str, model: ErrorModel, rates: list[float], versions: int, seed: int = 3) -> DataFrame:
    """Each text at each rate and version, spoilt; rate 0 once as the baseline.

    Places are drawn with replacement over words and gaps alike; draws depend on key,
    rate, version and seed alone, not on partitions.
    """
    grid = [(0.0, 0)] + [(r, v) for r in rates for v in range(versions)]
    picked = df.select(key, text)
    kind = T.StructType([T.StructField(key, picked.schema[0].dataType), T.StructField("rate", T.DoubleType()), T.StructField("ver", T.IntegerType()), T.StructField("variant", T.StringType())])

    def run(frames):
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text]):
                if not isinstance(t, str):
                    continue
                parts = re.findall(r"\S+|\s+", t)
                for rate, ver in grid:
                    rng = random.Random(f"{seed}|{k}|{rate}|{ver}")
                    now = list(parts)
                    for at in rng.choices(range(len(parts)), k=int(len(parts) * rate)) if parts else []:
                        if not parts[at].isspace():
                            now[at] = model.spoil(parts[at], rng)
                    rows.append((k, rate, ver, "".join(now)))
            yield pd.DataFrame(rows, columns=[key, "rate", "ver", "variant"]).astype({"ver": np.int32})

    return picked.mapInPandas(run, kind)


def word_overlap(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Multiset Jaccard of the words of two columns; null where both have none."""

    def counts(c: str, n: str) -> DataFrame:
        return df.select(key, F.explode(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda x: x != "")).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))

    both = counts(a, "x").join(counts(b, "y"), [key, "w"], "full_outer").na.fill(0, ["x", "y"])
    return both.groupBy(key).agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("jaccard"))
