"""Vectors, nested values, graphs, regressions and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlathe.functions import numbers as N
from textlathe.functions import text as X
from textlathe.operators import graphs as G
from textlathe.operators import nested as J
from textlathe.operators import regression as R
from textlathe.operators import search as S
from textlathe.plans.base import Plans
from textlathe.runtime import table

plans = Plans()
query = plans.query
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES

BIG = "CAST({} AS DOUBLE)"
SCALE = "CASE WHEN list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) > 0 THEN list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127.0 ELSE 1.0 END"


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query(f"WITH s AS (SELECT vec_id, embedding, {SCALE} AS scale FROM embeddings) SELECT vec_id, round(scale, 10) AS scale, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) / scale, 0))) AS INT)), ',') AS q FROM s")
def quantize_row(spark, sf):
    s = vectors(spark, sf).withColumn("scale", N.row_scale("embedding"))
    return s.select("vec_id", F.round("scale", 10).alias("scale"), F.array_join(F.transform(N.quantized("embedding", "scale"), lambda x: x.cast("string")), ",").alias("q"))


GLOBAL = "g AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) / 127.0 AS scale FROM embeddings)"


@query(f"WITH {GLOBAL} SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) / scale, 0))) AS INT)), ',') AS q FROM embeddings, g")
def quantize_global(spark, sf):
    """One scale from the largest magnitude of all vectors: one row, joined back."""
    top = vectors(spark, sf).agg((F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))) / 127.0).alias("scale"))
    s = vectors(spark, sf).crossJoin(F.broadcast(top))
    return s.select("vec_id", F.array_join(F.transform(N.quantized("embedding", "scale"), lambda x: x.cast("string")), ",").alias("q"))


@query(f"WITH s AS (SELECT vec_id, embedding, {SCALE} AS scale FROM embeddings), q AS (SELECT vec_id, list_transform(list_zip(embedding, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(CAST(x AS DOUBLE) / scale, 0))) * scale)), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2])) AS d FROM s) SELECT vec_id, round(list_max(d), 8) AS worst FROM q")
def dequantize_error(spark, sf):
    s = vectors(spark, sf).withColumn("scale", N.row_scale("embedding"))
    back = s.withColumn("b", N.dequantized(N.quantized("embedding", "scale"), "scale"))
    return back.select("vec_id", F.round(F.array_max(F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") - y))), 8).alias("worst"))


@query("WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS v FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY label) SELECT label, i, round(v / (norm + 1e-32), 6) AS v FROM m JOIN n USING (label)")
def mean_pool(spark, sf):
    """Mean of each group's vectors, scaled to length one."""
    e = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    n = e.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return e.join(n, "label").select("label", (F.col("i") + 1).cast("bigint").alias("i"), F.round(F.col("v") / (F.col("norm") + 1e-32), 6).alias("v"))


@query("SELECT vec_id, len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS valid FROM embeddings")
def vector_valid(spark, sf):
    return vectors(spark, sf).select("vec_id", N.valid_vector("embedding").alias("valid"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND {COS} >= 0.35")
def cosine_pairs(spark, sf):
    """Every row whose id is divisible by 20 against all rows, by a similarity threshold."""
    return similar_rows(spark, sf).select(F.col("query_id").alias("a"), F.col("seq").alias("b"), F.round("score", 6).alias("similarity"))


def similar_rows(spark, sf):
    v = vectors(spark, sf)
    rows = v.select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("page_id"), F.col("embedding").alias("vector"))
    return S.vector_pairs(rows, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 0.35)


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS DOUBLE) AS k, TRY_CAST(json_extract(props, '$.a.b') AS DOUBLE) AS deep FROM events")
def json_path(spark, sf):
    """Dotted paths; null where a step isn't an object."""
    v = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "double").alias("k"), F.try_variant_get("v", "$.a.b", "double").alias("deep"))


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS k_mean FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') GROUP BY event_type")
def json_metrics(spark, sf):
    """Only values that are numbers in the JSON count; strings and booleans don't."""
    e = table(spark, sf, "events").withColumn("v", F.variant_get(F.try_parse_json("props"), "$.k", "variant"))
    return e.where(F.schema_of_variant("v").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.try_variant_get("v", "$", "double")), 6).alias("k_mean"))


@query("SELECT path, 'int' AS kind, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS path FROM events) GROUP BY path")
def json_key_types(spark, sf):
    """Every path of the records with its kind and how often it occurs."""
    return J.key_tree(table(spark, sf, "events"), "props")


@query("SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' ELSE '{}' END AS kept FROM events")
def map_subset(spark, sf):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select("event_id", F.to_json(F.map_filter(m, lambda k, v: k.isin("k", "label"))).alias("kept"))


@query("SELECT response_id, len(list_filter(reference_contexts, lambda x: length(x) >= 16)) = len(reference_contexts) AS complete, array_to_string(reference_contexts, chr(10) || '---' || chr(10)) AS context FROM rag_response_df WHERE reference_contexts IS NOT NULL")
def context_string(spark, sf):
    r = table(spark, sf, "rag_response_df").where("reference_contexts is not null")
    return r.select("response_id", F.forall("reference_contexts", lambda x: F.length(x) >= 16).alias("complete"), F.array_join("reference_contexts", "\n---\n").alias("context"))


@query("SELECT generated_by, response_by, count(*) AS n, round(avg(len(reference_contexts)), 6) AS contexts, count(*) FILTER (reference IS NULL OR length(reference) < 16) AS short FROM rag_response_df GROUP BY ALL")
def evaluation_summary(spark, sf):
    r = table(spark, sf, "rag_response_df")
    return r.groupBy("generated_by", "response_by").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("reference_contexts").isNotNull(), F.size("reference_contexts"))), 6).alias("contexts"), F.count_if(F.col("reference").isNull() | (F.length("reference") < 16)).alias("short"))


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND {COS} >= 0.35),
  two AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT two.dst, r FROM reach JOIN two ON two.src = reach.id)
SELECT id, min(r) AS component FROM reach GROUP BY id""")
def graph_components(spark, sf):
    """Clusters of vectors: connected components over the similarity edges."""
    edges = similar_rows(spark, sf).select(F.col("query_id").alias("src"), F.col("seq").alias("dst"))
    return G.components(vectors(spark, sf).select(F.col("vec_id").alias("id")), edges)


@query("WITH RECURSIVE t AS (SELECT 0 AS node, 0 AS level UNION SELECT b.k, t.level + 1 FROM t JOIN (SELECT n_nationkey AS k, n_nationkey // 2 AS parent FROM nation WHERE n_nationkey > 0) b ON b.parent = t.node AND t.node <> b.k) SELECT node, level FROM t")
def recursive_tree(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey > 0").select(F.floor(F.col("n_nationkey") / 2).cast("int").alias("src"), F.col("n_nationkey").alias("dst"))
    return G.levels(n, spark.createDataFrame([(0,)], "node int"))


@query("SELECT o_orderpriority AS caller, o_orderstatus AS callee, count(*) AS calls FROM orders GROUP BY ALL")
def tally_edges(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("caller"), F.col("o_orderstatus").alias("callee")).agg(F.count("*").alias("calls"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, unnest([(n_nationkey * 3 + 1) % 25, (n_nationkey + 7) % 25]) AS dst FROM nation),
  w AS (SELECT 0 AS node, 0 AS level UNION SELECT e.dst, level + 1 FROM w JOIN e ON e.src = w.node WHERE level < 25) SELECT node, min(level) AS level FROM w GROUP BY node""")
def call_graph(spark, sf):
    """Breadth-first levels in a graph with cycles."""
    k = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"))
    edges = k.select("src", F.explode(F.array((F.col("src") * 3 + 1) % 25, (F.col("src") + 7) % 25)).alias("dst"))
    return G.levels(edges, spark.createDataFrame([(0,)], "node int"))


@query()
def tree_paths(spark, sf):
    """A seeded tree's paths, which of them lead to the deepest first path, and visible ones."""
    t = G.tree(spark)
    goal = t.select("path").orderBy(F.desc(F.size("path")), "path").limit(1).select(F.col("path").alias("goal"))
    return t.crossJoin(F.broadcast(goal)).select(F.concat_ws(".", F.transform("path", lambda x: x.cast("string"))).alias("path"), F.size("path").alias("depth"), G.prefix_of("path", "goal").alias("marked"), F.forall("path", lambda x: x < 2).alias("visible"))


@query("""WITH p AS (SELECT CASE WHEN regexp_matches(route, '^/+$') THEN '/' ELSE regexp_replace(route, '/+$', '') END AS page, split_part(heading_key, '#', 1) AS anchor FROM search_record), l AS (SELECT chunk_id, split_part(url, '#', 1) AS page, split_part(url, '#', 2) AS anchor FROM chunk)
SELECT chunk_id, bool_or(p.page IS NOT NULL) AS page_found, l.anchor = '' OR bool_or(p.anchor IS NOT NULL AND p.anchor = l.anchor) AS anchor_found FROM l LEFT JOIN p USING (page) GROUP BY chunk_id, l.anchor""")
def link_check(spark, sf):
    """Links met with pages, and with their anchors; a page's anchors are never gathered."""
    sections = table(spark, sf, "search_record").select(X.canonical_route("route").alias("page"), X.anchor_of("heading_key").alias("anchor")).distinct()
    pages = sections.select("page").distinct()
    links = table(spark, sf, "chunk").select("chunk_id", F.split_part("url", F.lit("#"), F.lit(1)).alias("page"), F.split_part("url", F.lit("#"), F.lit(2)).alias("anchor"))
    found = links.join(pages.withColumn("has_page", F.lit(True)), "page", "left").join(sections.withColumn("has_anchor", F.lit(True)), ["page", "anchor"], "left")
    return found.select("chunk_id", F.col("has_page").isNotNull().alias("page_found"), ((F.col("anchor") == "") | F.col("has_anchor").isNotNull()).alias("anchor_found"))


@query("""WITH m AS (SELECT l_returnflag AS g, count(*) AS n, covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_tax, l_extendedprice) AS c2, covar_pop(l_quantity, l_tax) AS c12, var_pop(l_quantity) AS v1, var_pop(l_tax) AS v2, var_pop(l_extendedprice) AS vy,
    avg(l_quantity) AS m1, avg(l_tax) AS m2, avg(l_extendedprice) AS my, min(l_quantity) AS lo1, max(l_quantity) AS hi1, min(l_tax) AS lo2, max(l_tax) AS hi2 FROM lineitem GROUP BY 1),
  u AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS u1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS u2, CASE WHEN c1 > 0 THEN c1 * c1 / v1 ELSE 0 END AS e1, CASE WHEN c2 > 0 THEN c2 * c2 / v2 ELSE 0 END AS e2 FROM m),
  b AS (SELECT *, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN e1 >= e2 AND c1 > 0 THEN c1 / v1 ELSE 0 END AS b1, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN e2 > e1 THEN c2 / v2 ELSE 0 END AS b2 FROM u)
SELECT g, n, round(my - b1 * (m1 - lo1) - b2 * (m2 - lo2), 3) AS intercept, round(b1 * (hi1 - lo1), 3) AS quantity, round(b2 * (hi2 - lo2), 3) AS tax, round((b1 * c1 + b2 * c2) / vy, 6) AS r2 FROM b""")
def nonnegative_two(spark, sf):
    """Two features with slopes of at least zero on scaled values, for each group."""
    cols = [F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", "l_extendedprice")]
    m = R.fit(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), *cols), ["l_quantity", "l_tax"], "l_extendedprice", "g")
    b = lambda k: F.round(F.col("coefficients")[k], 3)
    return m.select("g", "n", F.round("intercept", 3).alias("intercept"), b(0).alias("quantity"), b(1).alias("tax"), F.round("r2", 6).alias("r2"))


@query()
def nonnegative_glm(spark, sf):
    """log10 of size by three scores with slopes of at least zero, for each variant word."""
    from textlathe.operators.records import with_releases

    w = with_releases(table(spark, sf, "param_estimation")).join(table(spark, sf, "param_estimation").select("record_id", N.not_nan("tau2").alias("tau2")), "record_id")
    rows = w.select("variant", F.log10("totalParams").alias("size"), "mmlu_pro", "intelligenceIndex", F.when(F.col("tau2") > 0, F.col("tau2")).alias("tau2"))
    m = R.fit(rows, ["mmlu_pro", "intelligenceIndex", "tau2"], "size", "variant")
    return m.select("variant", "n", F.round("intercept", 6).alias("intercept"), F.transform("coefficients", lambda x: F.round(x, 6)).alias("coefficients"), F.round("r2", 6).alias("r2"))


HOURS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(HOURS)
def tumbling_windows(spark, sf):
    """The same windowed aggregate as the stream's, over the folder at rest."""
    from textlathe.streaming.events import tumbling

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, sf):
    from textlathe.streaming.events import sessions

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT e.event_id, max(o.ts) AS before FROM events e LEFT JOIN events o ON o.user_id = e.user_id AND o.event_type = 'signup' AND o.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def as_of_join(spark, sf):
    """The last sign-up at or before each purchase, by one window over the union of both."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").where("event_type in ('purchase', 'signup')").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_type") == "signup", F.col("ts")).alias("mark"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return e.withColumn("before", F.max("mark").over(w)).where("event_type = 'purchase'").select("event_id", "before")
