"""Building a published search index from sections, and searching it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlathe.functions import numbers as N
from textlathe.functions import text as X
from textlathe.functions import udfs as U
from textlathe.operators import search as S
from textlathe.runtime import cut_lineage, spread
from textlathe.sources import sinks as K

#: Places from one section to the next; a section has fewer pieces.
SECTION = 1 << 31

#: Megabytes of token vectors that may be sent to every task.
MOST_TABLE_MB = 512


class Rejected(ValueError):
    """The corpus or its vectors didn't pass; nothing was published."""


def gate(records: DataFrame, suspicious_limit: float = 0.01, legitimate_limit: float = 0.10) -> bool:
    """Whether a corpus has sections, and few enough empty ones of either kind."""
    kinds = {r.kind: r["count"] for r in records.select(X.emptiness("heading_key", "fragment_text").alias("kind")).groupBy("kind").count().collect()}
    n = sum(kinds.values())
    return n > 0 and kinds.get("suspicious", 0) / n <= suspicious_limit and kinds.get("legitimate", 0) / n <= legitimate_limit


def chunks(records: DataFrame, titles: DataFrame, vocab: dict[str, int], target: int = 256) -> DataFrame:
    """Sections as chunks within `target` tokens of the vocabulary, with their place:
    (seq, piece_no, chunk_id, page_id, url, title, heading, crumb, text)."""

    known: dict[str, int] = {}  # sizes of words met before, in each worker

    def count(text: str) -> int:
        total = 0
        for w in U.words_and_signs(text):
            if w not in known:
                known[w] = len(U.wordpieces(U.plain_word(w), vocab))
            total += known[w]
        return total

    heading = X.heading_of("heading_key", "title")
    context = F.when(heading == F.col("title"), F.col("title")).otherwise(F.concat_ws("\n", "title", heading))
    placed = spread(records).select("seq", "route", "heading_key", "title", heading.alias("heading"), X.canonical_route("route").alias("page_id"), X.section_url("route", "heading_key").alias("url"), context.alias("context"), F.posexplode(U.pack_udf(target, count)("fragment_text", context)).alias("piece_no", "body"))
    crumbs = S.breadcrumbs(titles.select(X.canonical_route("route").alias("route"), "title"))
    named = placed.join(crumbs.withColumnRenamed("route", "page_id"), "page_id", "left")
    return named.select("seq", "piece_no", F.concat_ws("|", "route", "heading_key", F.col("piece_no").cast("string")).alias("chunk_id"), "page_id", "url", "title", "heading", F.coalesce("crumb", F.lit("")).alias("crumb"), F.concat_ws("\n\n", "context", "body").alias("text"))


def embedded(df: DataFrame, ids: str, vectors: np.ndarray, name: str = "vector") -> DataFrame:
    """Adds the mean of the tokens' vectors, scaled to length one; null without a token."""
    if vectors.nbytes > MOST_TABLE_MB << 20:
        raise Rejected("the token table is over its bound")
    given = df.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            m = given.value[r].mean(0) if r is not None and len(r) else None
            size = 0.0 if m is None else float(np.linalg.norm(m))
            out.append((m / size).tolist() if size > 0 else None)
        return pd.Series(out, dtype=object)

    return df.withColumn(name, run(ids))


def build_index(spark: SparkSession, records: DataFrame, titles: DataFrame, vocab: dict[str, int], vectors: np.ndarray, path: str, target: int = 256, built_at: str = "", **limits: float) -> dict:
    """Gate, chunk, tokenize, embed, quantize and publish; returns the set's metadata.

    A rejected corpus stops before anything else is done, unusable vectors before
    anything is published, and a failure on the way leaves the published set as it was.
    Chunks without a known token are left out and counted.
    """
    if not gate(records, **limits):
        raise Rejected("the corpus didn't pass the gate")
    if vectors.ndim != 2 or not np.isfinite(vectors).all():
        raise Rejected("token vectors must be finite rows")
    tokens = chunks(records, titles, vocab, target).withColumn("ids", U.wordpiece_udf(vocab)(X.basic_units("text")))
    docs = cut_lineage(embedded(tokens, "ids", vectors))
    counts = docs.agg(F.count("*").alias("n"), F.count_if(F.size("ids") == 0).alias("unknown"), F.count_if((F.size("ids") > 0) & ~F.coalesce(N.valid_vector("vector"), F.lit(False))).alias("bad"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("top")).first()
    if counts.n == counts.unknown:
        raise Rejected("no chunk has a known token")
    if counts.bad:
        raise Rejected("document vectors must be finite and not zero")
    scale = counts.top / 127.0 if counts.top else 1.0
    kept = docs.where(F.size("ids") > 0)
    rows = spark.createDataFrame(list(enumerate(vectors.astype(float).tolist())), "token_id int, vector array<double>")
    rows = rows.withColumn("scale", N.row_scale("vector"))
    tables = {
        "chunks": kept.select("seq", "piece_no", "chunk_id", "page_id", "url", "title", "heading", "crumb"),
        "documents": kept.select("chunk_id", (F.col("seq") * SECTION + F.col("piece_no")).alias("place"), "page_id", N.quantized("vector", F.lit(scale)).cast("array<tinyint>").alias("q")),
        "tokens": rows.select("token_id", N.quantized("vector", "scale").cast("array<tinyint>").alias("q"), "scale"),
        "vocabulary": spark.createDataFrame(sorted(vocab.items()), "piece string, token_id int"),
    }
    meta = {"dims": int(vectors.shape[1]), "scale": scale, "chunks": counts.n - counts.unknown, "left_out": counts.unknown, "built_at": built_at}
    return meta | {"version": K.publish(spark, path, tables, meta)}


def semantic_rank(spark: SparkSession, path: str, queries: DataFrame, top: int | None = None) -> DataFrame | None:
    """(query_id, page_id, score, rank) of a published index, the first `top` pages of each
    query where it is given; None where there is no index, or one that can't be read.

    Queries without a known token have no rows. Token vectors are taken back from their
    row scales, scores from the documents' one scale; only scores above zero are ranked.
    """
    state, meta, tables = K.loaded(spark, path, ("documents", "tokens", "vocabulary"))
    if state != "ready":
        return None
    vocab = {r.piece: r.token_id for r in tables["vocabulary"].collect()}
    rows = tables["tokens"].orderBy("token_id").collect()  # no more than `MOST_TABLE_MB`, as the set was built within it
    table = np.array([r.q for r in rows], float) * np.array([r.scale for r in rows])[:, None]
    asked = embedded(queries.select("query_id", U.wordpiece_udf(vocab)(X.basic_units("query")).alias("ids")), "ids", table, "query_vector")
    docs = tables["documents"].select(F.col("place").alias("seq"), "page_id", F.transform("q", lambda x: x.cast("double")).alias("vector"))
    best = S.vector_pages(docs, asked.where("query_vector is not null").select("query_id", "query_vector"), itself=False, top=top)  # places and query ids have nothing in common
    scored = best.withColumn("score", F.col("score") * meta["scale"]).where("score > 0")
    return S.ranked(scored, [F.desc("score"), F.asc("seq")], top=top).select("query_id", "page_id", "score", "rank")
