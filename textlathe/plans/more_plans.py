"""Order, batches, splits, tags, pooling, nested means, cubes and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlathe.functions import numbers as N
from textlathe.functions import text as X
from textlathe.operators import plugins as P
from textlathe.operators import search as S
from textlathe.plans import search_plans as Q
from textlathe.plans.base import Plans
from textlathe.runtime import scratch, table

plans = Plans()
query = plans.query
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@query(f"""WITH {Q.LEXICAL}, titled AS (SELECT DISTINCT {Q.ROUTE} AS page_id, unnest({Q.TOKENS.format("title")}) AS term FROM search_record), said AS (SELECT DISTINCT item_id AS query_id, unnest({Q.TOKENS.format("query")}) AS term FROM eval_item),
  m AS (SELECT query_id, page_id, count(*) AS matches FROM said JOIN titled USING (term) GROUP BY ALL)
SELECT query_id, page_id, coalesce(matches, 0) AS matches, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(matches, 0) DESC, score DESC, first_seq) AS place FROM lex LEFT JOIN m USING (query_id, page_id)""")
def keyword_row_order(spark, sf):
    """Pages whose title has more of the query's own words come first, then by rank."""
    r, asked = table(spark, sf, "search_record"), Q.queries_of(spark, sf)
    titles = r.select(X.canonical_route("route").alias("page_id"), F.explode(X.tokens("title")).alias("term")).distinct()
    said = asked.select("query_id", F.explode(X.tokens("query")).alias("term")).distinct()
    m = said.join(titles, "term").groupBy("query_id", "page_id").agg(F.count("*").alias("matches"))
    k = S.lexical_scores(Q.sections(spark, sf), asked).join(m, ["query_id", "page_id"], "left").na.fill(0, ["matches"])
    return S.ranked(k, [F.desc("matches"), F.desc("score"), F.asc("first_seq")], name="place").select("query_id", "page_id", "matches", F.col("place").cast("bigint").alias("place"))


@query(f"SELECT seq, {Q.ROUTE} AS page, CASE WHEN row_number() OVER (PARTITION BY {Q.ROUTE} ORDER BY seq) = 1 THEN title END AS crumb FROM search_record")
def first_flag(spark, sf):
    """Only a page's first row carries its title."""
    r = table(spark, sf, "search_record").select("seq", X.canonical_route("route").alias("page"), "title")
    return r.select("seq", "page", F.when(F.row_number().over(Window.partitionBy("page").orderBy("seq")) == 1, F.col("title")).alias("crumb"))


@query(f"""WITH {Q.HYBRID.split("WITH ", 1)[1]}, {Q.FUSED}
SELECT query_id, page_id, rank FROM hyb WHERE query_id IN (SELECT query_id FROM sem) UNION ALL SELECT query_id, page_id, rank FROM lex WHERE query_id NOT IN (SELECT query_id FROM sem)""")
def hybrid_fallback(spark, sf):
    keyword = S.lexical_rank(Q.sections(spark, sf), Q.queries_of(spark, sf), None)
    return S.hybrid(keyword, Q.semantic_pages(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT k.key AS lang, count(d.doc_id) AS docs FROM (SELECT unnest(['sv', 'xx', 'de', 'tr']) AS key) k LEFT JOIN documents d ON d.lang = k.key GROUP BY 1")
def reindex_keys(spark, sf):
    """Counts for an ordered list of keys, those without a row too."""
    keys = spark.createDataFrame([(k,) for k in ("sv", "xx", "de", "tr")], "lang string")
    return keys.join(table(spark, sf, "documents"), "lang", "left").groupBy("lang").agg(F.count("doc_id").alias("docs"))


@query("SELECT item_id, CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 16) AS BIGINT) AS batch FROM eval_item")
def batches(spark, sf):
    """Fixed-size batches of a small ordered set."""
    return table(spark, sf, "eval_item").select("item_id", F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id")) - 1) / 16).cast("bigint").alias("batch"))


@query("SELECT split, item_id FROM (SELECT unnest(generate_series(0, 4)) AS split), eval_item QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5(split || '-' || item_id), item_id) <= 24")
def shuffle_split(spark, sf):
    """Five test sets drawn by hash order."""
    s = table(spark, sf, "eval_item").select("item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("split"))
    w = Window.partitionBy("split").orderBy(F.md5(F.concat_ws("-", "split", "item_id")), "item_id")
    return s.withColumn("n", F.row_number().over(w)).where("n <= 24").select("split", "item_id")


@query("SELECT label, lower(regexp_extract(label, '^([A-Za-z]+)', 1)) AS base, max(l.lang) AS lang, count(*) AS n FROM benchmark_df b LEFT JOIN lang_code l ON lower(split_part(replace(b.label, '_', '-'), '-', 1)) = l.code WHERE label IS NOT NULL GROUP BY ALL")
def language_tags(spark, sf):
    """Tags without region and case, by the table of codes."""
    b = table(spark, sf, "benchmark_df").where("label is not null")
    code = F.lower(F.split_part(F.replace("label", F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))
    return b.groupBy("label").agg(F.count("*").alias("n")).withColumn("code", code).join(table(spark, sf, "lang_code"), "code", "left").select("label", F.lower(F.regexp_extract("label", "^([A-Za-z]+)", 1)).alias("base"), "lang", "n")


@query(r"SELECT record_id, coalesce(regexp_matches(trim(" + '"totalParams"' + r"), '^[0-9.,-]+$'), false) AS numeric FROM param_estimation")
def numeric_cells(spark, sf):
    return table(spark, sf, "param_estimation").select("record_id", F.coalesce(F.trim("totalParams").rlike("^[0-9.,-]+$"), F.lit(False)).alias("numeric"))


@query("SELECT record_id, nullif(tau2, 0) AS tau2, CASE creator WHEN 'Oum Data' THEN 'Oum' ELSE creator END AS creator FROM param_estimation WHERE NOT isnan(coalesce(tau2, 0)) AND notes IS NOT NULL")
def replace_values(spark, sf):
    """Zeros as nulls, a mapped name, rows without notes dropped."""
    d = table(spark, sf, "param_estimation").where("not isnan(coalesce(tau2, 0D))").na.drop(subset=["notes"])
    return d.replace("Oum Data", "Oum", "creator").select("record_id", F.nullif("tau2", F.lit(0.0)).alias("tau2"), "creator")


@query("WITH e AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings) SELECT label, i, round(max(CAST(x AS DOUBLE)), 6) AS top, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(sum(CAST(x AS DOUBLE) * w) / sum(w), 6) AS weighted FROM e GROUP BY label, i".replace("unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings", "w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings)"))
def pooling(spark, sf):
    """Greatest, mean and place-weighted mean of each group's vectors."""
    v = table(spark, sf, "embeddings").select("label", "embedding", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("w"))
    e = v.select("label", "w", F.posexplode("embedding").alias("i", "f")).withColumn("x", F.col("f").cast("double"))
    return e.groupBy("label", (F.col("i") + 1).cast("bigint").alias("i")).agg(F.round(F.max("x"), 6).alias("top"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 6).alias("weighted"))


@query("SELECT response_id, round(list_avg(list_transform(reference_contexts, lambda x: length(x))), 6) AS mean_length, list_max(list_transform(reference_contexts, lambda x: length(x))) AS longest FROM rag_response_df WHERE len(reference_contexts) > 0")
def nested_mean(spark, sf):
    """Means over a nested array without taking it apart."""
    r = table(spark, sf, "rag_response_df").where(F.size("reference_contexts") > 0)
    total = F.aggregate("reference_contexts", F.lit(0.0), lambda s, x: s + F.length(x))
    return r.select("response_id", F.round(total / F.size("reference_contexts"), 6).alias("mean_length"), F.array_max(F.transform("reference_contexts", lambda x: F.length(x))).cast("bigint").alias("longest"))


REASON = "CASE WHEN response IS NULL THEN 'content_filter' WHEN regexp_matches(response, '[.!?]$') THEN 'stop' WHEN regexp_matches(response, '[[:alnum:]]$') THEN 'length' ELSE 'eos' END"


@query(f"SELECT query_id, count(*) AS n, bool_and({REASON} IN ('stop', 'eos', 'end_turn')) AS finished FROM rag_response_df GROUP BY query_id")
def response_finish(spark, sf):
    """Whether all of a question's responses ended of themselves, by their reasons to end."""
    r = F.col("response")
    reason = F.when(r.isNull(), "content_filter").when(r.rlike("[.!?]$"), "stop").when(r.rlike("[a-zA-Z0-9]$"), "length").otherwise("eos")
    told = table(spark, sf, "rag_response_df").groupBy("query_id").agg(F.count("*").alias("n"), F.collect_set(reason).alias("reasons"))
    return told.select("query_id", "n", P.finished("reasons").alias("finished"))


@query("""WITH m AS (SELECT l_returnflag, covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2, covar_pop(l_quantity, l_discount) AS c12, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2,
    avg(l_quantity) AS m1, avg(l_extendedprice) AS my, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, k, round(lo + (hi - lo) * k / 10.0, 6) AS x, round(my + (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) * (lo + (hi - lo) * k / 10.0 - m1), 4) AS y FROM m, (SELECT unnest(generate_series(0, 10)) AS k)""")
def regression_line(spark, sf):
    """The line of one feature of a fit on two, the other one held at its mean."""
    x, z, y = "l_quantity", "l_discount", "l_extendedprice"
    f = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.covar_pop(x, y).alias("c1"), F.covar_pop(z, y).alias("c2"), F.covar_pop(x, z).alias("c12"), F.var_pop(x).alias("v1"), F.var_pop(z).alias("v2"),
        F.avg(x).alias("m1"), F.avg(y).alias("my"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    slope = (F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12")) / (F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / 10.0
    return f.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).select("l_returnflag", F.col("k").cast("bigint").alias("k"), F.round(at, 6).alias("x"), F.round(F.col("my") + slope * (at - F.col("m1")), 4).alias("y"))


@query("SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY CUBE (l_linestatus, l_returnflag)")
def cube_counts(spark, sf):
    return table(spark, sf, "lineitem").cube("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


@query("SELECT date_trunc('hour', ts) - to_hours(k) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def sliding_windows(spark, sf):
    from textlathe.streaming.events import sliding

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sliding(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_tumbling(spark, sf):
    """The stream drained in append mode: all windows that the watermark has closed."""
    import uuid

    from textlathe.streaming.events import EVENTS, drain, tumbling

    raw = spark.readStream.schema(EVENTS).parquet(f"{sf}/events.parque[t]")  # a pattern, as the table may be one file
    e = raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    out = drain(tumbling(e), "hours", f"{scratch(spark)}/stream-{uuid.uuid4().hex}")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


class Lengths:
    """A stand-in classifier: short or long texts."""

    def predict_batch(self, texts: list[str]) -> list[str]:
        return ["short" if len(t) < 100 else "long" for t in texts]


@query("SELECT row_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) < 100 THEN 'short' ELSE 'long' END AS predicted FROM benchmark_df")
def classifier_plugin(spark, sf):
    return P.classified(table(spark, sf, "benchmark_df").select("row_id", "text"), "text", Lengths).select("row_id", "predicted")


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, CAST(NULL AS DOUBLE) AS none FROM events")
def metric_specs(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", *P.metric_columns("v", P.metric_specs(["k=k", "none=a.b.c"])))


@query(f"""WITH v AS (SELECT vec_id AS token_id, embedding FROM embeddings), t AS (SELECT item_id, unnest([item_id, item_id * 7 % 500, item_id * 13 % 500]) AS token_id FROM eval_item),
  m AS (SELECT item_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM t JOIN v USING (token_id)), p AS (SELECT item_id, i, avg(CAST(x AS DOUBLE)) AS v FROM m GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM p GROUP BY 1)
SELECT item_id, round(sum(v / norm * i), 6) AS moment FROM p JOIN n USING (item_id) WHERE norm > 0 GROUP BY item_id""")
def query_vectors(spark, sf):
    """Mean-pooled, normalised query vectors; one figure of each, its first moment."""
    item = F.col("item_id")
    t = table(spark, sf, "eval_item").select("item_id", F.explode(F.array(item, item * 7 % 500, item * 13 % 500)).alias("token_id"))
    v = S.pooled_vectors(t, table(spark, sf, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector")), "item_id")
    weights = F.transform(F.sequence(F.lit(1), F.size("vector")), lambda k: k.cast("double"))
    return v.select("item_id", F.round(N.dot("vector", weights), 6).alias("moment"))


@query()
def index_search(spark, sf):
    """The whole way: gate, chunk, tokenize, embed, quantize, publish, read back, rank.

    The vocabulary is the corpus's frequent words, its vectors are drawn by a seed.
    """
    import uuid

    import numpy as np

    from textlathe.operators import index as I

    records = table(spark, sf, "search_record").withColumn("fragment_text", F.coalesce("fragment_text", F.lit("")))
    titles = records.groupBy("route").agg(F.min("title").alias("title"))
    words = records.select(F.explode(X.basic_units("fragment_text")).alias("w")).where("length(w) > 1").groupBy("w").count().orderBy(F.desc("count"), "w").limit(4000)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    vocab = {w: n for n, w in enumerate([*letters, *[f"##{c}" for c in letters], *[r.w for r in words.collect()]])}
    vectors = np.random.default_rng(7).standard_normal((len(vocab), 64))
    path = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    I.build_index(spark, records, titles, vocab, vectors, path, suspicious_limit=1.0, legitimate_limit=1.0)
    ranks = I.semantic_rank(spark, path, Q.queries_of(spark, sf), top=10)
    return ranks.select("query_id", "page_id", F.round("score", 6).alias("score"), "rank")
