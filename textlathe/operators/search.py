"""Hybrid search over sections: lexical rank, vector rank, rollup, fusion and recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlathe.functions import numbers as N
from textlathe.functions import text as X


def lexical_view(records: DataFrame) -> DataFrame:
    """Sections as texts to be ranked: title, heading or title, body."""
    return records.select(
        "seq",
        X.canonical_route("route").alias("page_id"),
        F.concat_ws("\n", "title", X.heading_of("heading_key", "title"), F.coalesce("fragment_text", F.lit(""))).alias("text"),
    )


def term_counts(df: DataFrame, key: list[str], text: str, name: str) -> DataFrame:
    return df.select(*key, F.explode(X.tokens(text)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias(name))


#: Rows of query terms that may be broadcast.
MAX_TERMS = 500_000


def lexical_scores(view: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, page_id, score, first_seq): the best section's score and the first
    section with any.

    Sections and queries meet on terms. The queries' terms, if a count finds them few,
    are broadcast: words of no query never enter a shuffle, and frequent words don't
    gather in one task.
    """
    q = term_counts(queries, ["query_id"], "query", "qtf")
    wanted = q.select("term").distinct()
    if q.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        q, wanted = F.broadcast(q), F.broadcast(wanted)
    d = view.select("seq", "page_id", F.explode(X.tokens("text")).alias("term")).join(wanted, "term", "left_semi").groupBy("seq", "page_id", "term").agg(F.count("*").alias("dtf"))
    section = d.join(q, "term").groupBy("query_id", "page_id", "seq").agg(F.sum(F.col("qtf") * F.col("dtf")).alias("score"))
    return section.groupBy("query_id", "page_id").agg(F.max("score").alias("score"), F.min("seq").alias("first_seq"))


def ranked(scores: DataFrame, by: list, part: str = "query_id", top: int | None = None, name: str = "rank") -> DataFrame:
    out = scores.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*by)))
    return out.where(F.col(name) <= top) if top else out


def lexical_rank(view: DataFrame, queries: DataFrame, top: int | None = 10) -> DataFrame:
    return ranked(lexical_scores(view, queries), [F.desc("score"), F.asc("first_seq")], top=top)


#: Query vectors of one block (the only ones that are broadcast, after a count), and
#: scores that a task holds at once: a block's rows follow from its queries.
MAX_QUERIES, MAX_SCORES = 20_000, 4_000_000


def picked(ids, matrix, seq, page, rows, keep, itself: bool) -> pd.DataFrame:
    """The pairs that `keep` takes of a block of queries and a block of rows."""
    out = []
    step = max(1, MAX_SCORES // max(1, len(ids)))
    for at in range(0, len(seq) if len(ids) else 0, step):
        part = slice(at, at + step)
        # rounded, as a product's last digits depend on a row's place: equal vectors score alike
        scores = np.round(matrix @ rows[part].T, 12)
        if itself:
            scores[ids[:, None] == seq[None, part]] = -np.inf
        q, r = keep(scores, seq[part], page[part])
        good = np.isfinite(scores[q, r])
        q, r = q[good], r[good]
        out.append(pd.DataFrame({"query_id": ids[q], "seq": seq[part][r], "page_id": page[part][r], "score": scores[q, r]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "seq", "page_id", "score"]).astype({"query_id": "int64", "seq": "int64", "score": "float64"})


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


PAIRS = "query_id bigint, seq bigint, page_id string, score double"


def scored_blocks(vectors: DataFrame, queries: DataFrame, keep, itself: bool = True) -> DataFrame:
    """Rows (query_id, seq, page_id, score) of a stated set of queries against all rows,
    as far as `keep` picks them from a block's scores.

    Both sides meet in blocks by a matrix product; only picked pairs become rows. Up to
    `MAX_QUERIES` queries are one block that every task has; more of them are packed into
    such blocks, and so are the rows, and each pair of blocks is a row of the product.
    `keep` gets scores (queries x rows), row ids and pages, and returns query and row
    places. With `itself`, where queries are rows of the same table, no row meets itself.
    """
    asked, rows = queries.select("query_id", "query_vector"), vectors.select("seq", "page_id", "vector")
    if asked.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES:
        got = asked.collect()
        given = vectors.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in got], np.int64), np.array([r.query_vector for r in got], np.float64)))

        def run(frames):
            ids, matrix = given.value
            for f in frames:
                if len(f):
                    yield picked(ids, matrix, f["seq"].to_numpy(), f["page_id"].to_numpy(), stacked(f["vector"]), keep, itself)

        return rows.mapInPandas(run, PAIRS)
    most = max(1, MAX_QUERIES)

    def packed(id_name: str, vector_name: str):
        def run(frames):
            for f in frames:
                for at in range(0, len(f), most):
                    p = f.iloc[at : at + most]
                    page = p["page_id"].tolist() if "page_id" in p else []
                    yield pd.DataFrame({"ids": [p[id_name].to_numpy()], "page": [page], "flat": [stacked(p[vector_name]).ravel()]})

        return run

    shape = "{0}ids array<bigint>, {0}page array<string>, {0}flat array<double>"
    a = asked.mapInPandas(packed("query_id", "query_vector"), shape.format("")).toDF("q_ids", "q_page", "q_flat").drop("q_page")
    b = rows.mapInPandas(packed("seq", "vector"), shape.format(""))

    def meet(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                ids, seq = np.asarray(r.q_ids), np.asarray(r.ids)
                yield picked(ids, np.asarray(r.q_flat).reshape(len(ids), -1), seq, np.asarray(r.page, object), np.asarray(r.flat).reshape(len(seq), -1), keep, itself)

    return b.crossJoin(a).mapInPandas(meet, PAIRS)


def vector_topk(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, seq, page_id, score, rank): each query's best rows over all rows.

    Each block gives its own best `top` rows of each query, and what equals the last of
    them, before anything is shuffled.
    """

    def best(scores, seq, page):
        return np.nonzero(scores >= least_of(scores, top))

    return ranked(scored_blocks(vectors, queries, best), [F.desc("score"), F.asc("seq")], top=top)


def least_of(scores: np.ndarray, top: int) -> np.ndarray:
    """Each row's score at place `top`, as a column; the least if there are fewer."""
    if scores.shape[1] <= top:
        return scores.min(1, keepdims=True)
    return np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top, None]


def vector_pages(vectors: DataFrame, queries: DataFrame, itself: bool = True, top: int | None = None) -> DataFrame:
    """(query_id, page_id, score, seq): the best row of each page for each query; with
    `top`, at least of every page that can be among a query's first `top` pages.

    Each block gives one row a query and page, no more than `top` pages of it and what
    equals the last of them. `itself` as for `scored_blocks`.
    """

    def best(scores, seq, page):
        order = np.lexsort((seq, page.astype(str)))  # a page's rows side by side, the earliest first
        names = page[order].astype(str)
        begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        s = scores[:, order]
        most = np.maximum.reduceat(s, begin, axis=1)
        wanted = most >= least_of(most, top) if top else np.ones(most.shape, bool)
        q, p = np.nonzero(wanted)
        place = np.searchsorted(begin, np.arange(len(order)), side="right") - 1
        at = np.where(s == most[:, place], np.arange(len(order)), len(order))
        first = np.minimum.reduceat(at, begin, axis=1)
        return q, order[first[q, p]]

    return rollup(scored_blocks(vectors, queries, best, itself))


def vector_pairs(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, seq, score) of cosine similarities from `least` on; only such pairs
    become rows. Zero vectors are like nothing."""
    unit = lambda df, c: df.withColumn("_n", N.norm(c)).where("_n > 0").withColumn(c, F.transform(c, lambda x: x.cast("double") / F.col("_n"))).drop("_n")
    pairs = scored_blocks(unit(vectors, "vector"), unit(queries, "query_vector"), lambda scores, seq, page: np.nonzero(scores >= least))
    return pairs.select("query_id", "seq", "score")


def rollup(scores: DataFrame) -> DataFrame:
    """The best section of each page, the earliest among equals; aggregated before any sort."""
    best = F.max(F.struct("score", (-F.col("seq")).alias("late")))
    return scores.groupBy("query_id", "page_id").agg(best.alias("b")).select("query_id", "page_id", F.col("b.score").alias("score"), (-F.col("b.late")).alias("seq"))


def fuse(keyword: DataFrame, semantic: DataFrame, top: int = 10) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings (query_id, page_id, rank).

    Each side gives its first `top` pages; equal scores keep keyword order first, then
    the order in which semantic pages were first seen.
    """
    k = keyword.where(F.col("rank") <= top).select("query_id", "page_id", F.col("rank").alias("keyword_rank"))
    s = semantic.where(F.col("rank") <= top).select("query_id", "page_id", F.col("rank").alias("semantic_rank"))
    both = k.join(s, ["query_id", "page_id"], "full_outer").withColumn("score", N.reciprocal_rank("keyword_rank", "semantic_rank"))
    seen = F.coalesce("keyword_rank", F.lit(1000) + F.col("semantic_rank"))
    return ranked(both, [F.desc("score"), seen])


def recall(ranks: DataFrame, labels: DataFrame, cutoffs=(1, 3)) -> DataFrame:
    """Share of each subset's queries whose expected page is within each cutoff; a
    subset without any hit still has its row."""
    hit = labels.join(ranks.select("query_id", F.col("page_id").alias("expected_page_id"), "rank"), ["query_id", "expected_page_id"], "left")
    return hit.groupBy("subset").agg(F.count("*").alias("queries"), *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cutoffs])


def breadcrumbs(titles: DataFrame) -> DataFrame:
    """(route, crumb): titles of every prefix of a route that has one, from the root on.

    A part that isn't the last adds " > " even if later parts have no title; a title
    `_index` shows the part with blanks for hyphens; parts that begin with a number sign
    don't count. Routes come without slashes at their end.
    """
    used = F.filter(F.split("route", "/"), lambda x: (x != "") & ~x.startswith("#"))
    parts = titles.select("route").distinct().select("route", used.alias("all")).select("route", "all", F.posexplode("all").alias("pos", "part"))
    prefix = parts.select("route", "pos", "part", F.size("all").alias("n"), F.concat(F.lit("/"), F.array_join(F.slice("all", F.lit(1), F.col("pos") + 1), "/")).alias("prefix"))
    named = prefix.join(titles.select(F.col("route").alias("prefix"), "title"), "prefix").where("title is not null")
    shown = F.when(F.col("title") == "_index", F.replace("part", F.lit("-"), F.lit(" "))).otherwise(F.col("title"))
    step = F.struct("pos", F.when(F.col("pos") < F.col("n") - 1, F.concat(shown, F.lit(" > "))).otherwise(shown).alias("t"))
    return named.groupBy("route").agg(F.array_sort(F.collect_list(step)).alias("s")).select("route", F.array_join(F.transform("s", lambda x: x["t"]), "").alias("crumb"))


def hybrid(keyword: DataFrame, semantic: DataFrame | None, top: int = 10) -> DataFrame:
    """(query_id, page_id, rank): fused rankings where there is a semantic one.

    Without a semantic side at all (`None`: vectors not published, not readable), or for
    queries that it lacks (no known word), the keyword ranking stands, untruncated.
    """
    plain = keyword.select("query_id", "page_id", "rank")
    if semantic is None:
        return plain
    known = semantic.select("query_id").distinct()
    return fuse(keyword.join(known, "query_id", "left_semi"), semantic, top).select("query_id", "page_id", "rank").unionByName(plain.join(known, "query_id", "left_anti"))


def pooled_vectors(tokens: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, vector): mean of the token vectors of (key, token_id) rows, scaled to length
    one; keys without a known token or of zero length give no row."""
    e = tokens.join(table, "token_id").select(key, F.posexplode("vector").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    v = e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))
    return v.withColumn("n", N.norm("v")).where("n > 0").select(key, F.transform("v", lambda x: x / F.col("n")).alias("vector"))
