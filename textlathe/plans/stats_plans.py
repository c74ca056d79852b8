"""Statistics, windows, reshaping, sets and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlathe.functions import numbers as N
from textlathe.functions import text as X
from textlathe.operators import stats as A
from textlathe.plans.base import Plans
from textlathe.runtime import table

plans = Plans()
query = plans.query
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


def t(spark, sf, name):
    return table(spark, sf, name)


@query("""WITH long AS (SELECT l_returnflag, 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT l_returnflag, metric, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS low, round(quantile_cont(v, 0.25), 4) AS q25,
  round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS high FROM long GROUP BY ALL""")
def describe_stats(spark, sf):
    return A.describe(t(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_extendedprice"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 8) AS sem FROM events GROUP BY event_type")
def sem_by_group(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(A.standard_error("value"), 8).alias("sem"))


@query("""SELECT coalesce(lower(trim(source)), '?') AS origin, round(avg(CAST("totalParams" IS NULL AS INT)), 6) AS "totalParams_missing", round(avg(CAST(mmlu_pro IS NULL OR isnan(mmlu_pro) AS INT)), 6) AS mmlu_pro_missing,
  round(avg(CAST("intelligenceIndex" IS NULL OR isnan("intelligenceIndex") AS INT)), 6) AS "intelligenceIndex_missing", round(avg(CAST(captured_at IS NULL AS INT)), 6) AS captured_at_missing FROM param_estimation GROUP BY 1""")
def missingness(spark, sf):
    df = t(spark, sf, "param_estimation").withColumn("origin", F.coalesce(F.lower(F.trim("source")), F.lit("?")))
    return A.missingness(df, "origin", ["totalParams", "mmlu_pro", "intelligenceIndex", "captured_at"])


_CLEAN = ", ".join(f'CASE WHEN "{c}" > 0 AND NOT isnan("{c}") THEN "{c}" END AS "{c}"' for c in ("gdpval", "intelligenceIndex", "mmlu_pro", "omniscience_accuracy", "tau2"))
_COLS = ["gdpval", "intelligenceIndex", "mmlu_pro", "omniscience_accuracy", "tau2"]


@query(f"WITH c AS (SELECT {_CLEAN} FROM param_estimation) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) AS r FROM c" for n, a in enumerate(_COLS) for b in _COLS[n + 1 :]))
def corr_matrix(spark, sf):
    df = t(spark, sf, "param_estimation").select(*[F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c)).alias(c) for c in _COLS])
    return A.correlations(df, _COLS).withColumn("r", F.round("r", 6))


@query("SELECT lang, n, round(n / sum(n) OVER (), 8) AS p FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def value_counts(spark, sf):
    return A.shares(t(spark, sf, "documents").where("lang is not null"), [], "lang").withColumn("p", F.round("p", 8))


@query("SELECT l_linestatus, l_returnflag, n, round(n / sum(n) OVER (PARTITION BY l_linestatus), 8) AS p FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)")
def cond_prob(spark, sf):
    return A.shares(t(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag").withColumn("p", F.round("p", 8))


@query("""WITH g AS (SELECT l_returnflag AS op, CASE WHEN grouping(l_linestatus) = 1 THEN '<gen>' ELSE l_linestatus END AS error, l_linenumber AS fix, count(*) AS n, grouping(l_linestatus) AS g
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linenumber)))
SELECT op, error, fix, n, round(n / sum(n) OVER (PARTITION BY g, op, error), 8) AS p FROM g""")
def backoff_prob(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("op"), F.col("l_linestatus").alias("error"), F.col("l_linenumber").alias("fix"))
    return A.backoff(df, "error", ["op", "fix"]).withColumn("p", F.round("p", 8))


@query("SELECT pos, round(sum(p) OVER (ORDER BY pos), 8) AS cdf FROM (SELECT l_linenumber AS pos, count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1)")
def cdf_position(spark, sf):
    p = A.shares(t(spark, sf, "lineitem"), [], "l_linenumber")
    return p.select(F.col("l_linenumber").alias("pos"), F.round(F.sum("p").over(Window.partitionBy(F.lit(1)).orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)), 8).alias("cdf"))


@query("SELECT least(10, CAST(floor(l_quantity / 5.0) AS BIGINT) + 1) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    return t(spark, sf, "lineitem").select(F.least(F.lit(10), F.width_bucket("l_quantity", F.lit(0.0), F.lit(50.0), F.lit(10))).cast("bigint").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, round(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 4) AS spread FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def group_range(spark, sf):
    w = Window.partitionBy("o_custkey")
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.round(F.max("o_totalprice").over(w) - F.min("o_totalprice").over(w), 4).alias("spread"))


@query("""SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS size_rank,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS price_rank FROM part""")
def avg_rank(spark, sf):
    return t(spark, sf, "part").select("p_partkey", "p_brand", A.average_rank("p_size", "p_brand").alias("size_rank"), A.average_rank("p_retailprice", "p_brand", True).alias("price_rank"))


@query(r"""SELECT slug, record_id, model FROM (SELECT record_id, model, regexp_replace(regexp_replace(regexp_replace(lower(trim(model)), '[_\s]+', '-', 'g'), '[^a-z0-9.\-]', '', 'g'), '-+', '-', 'g') AS slug FROM param_estimation)
QUALIFY row_number() OVER (PARTITION BY slug ORDER BY record_id) = 1""")
def first_wins_dedupe(spark, sf):
    return A.first_wins(t(spark, sf, "param_estimation").select(X.model_slug("model").alias("slug"), "record_id", "model"), "slug", ["record_id"])


@query("SELECT l_returnflag, round(sum(p), 6) AS total, abs(sum(p) - 1) < 1e-9 AS ok FROM (SELECT l_returnflag, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM lineitem GROUP BY l_returnflag, l_linenumber) GROUP BY 1")
def row_stochastic(spark, sf):
    return A.shares(t(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber").groupBy("l_returnflag").agg(F.round(F.sum("p"), 6).alias("total"), (F.abs(F.sum("p") - 1) < 1e-9).alias("ok"))


_T = "[" + ",".join(map(str, A.T95)) + "]"


@query(f"""WITH b AS (SELECT c_nationkey, count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) / sqrt(count(c_acctbal)) AS sem FROM customer GROUP BY 1)
SELECT c_nationkey, n, round(mean, 4) AS mean, round(CASE WHEN n < 2 THEN NULL WHEN n < 30 THEN {_T}[n - 1] ELSE {A.Z95} END * sem, 4) AS half_width FROM b""")
def confidence_interval(spark, sf):
    return A.interval(t(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")


@query("""WITH l AS (SELECT code, min(lang) AS lang FROM lang_code GROUP BY code), r AS (SELECT corpus, doc_key, l.lang AS truth FROM benchmark_df b JOIN l ON b.label = l.code),
  d AS (SELECT corpus, doc_key, truth, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT corpus, truth, count(*) AS n FROM r GROUP BY ALL),
  p AS (SELECT corpus, doc_key, arg_min(truth, (-n, truth)) AS by_document FROM d GROUP BY ALL), q AS (SELECT corpus, arg_min(truth, (-n, truth)) AS by_corpus FROM c GROUP BY ALL)
SELECT corpus, model, sum(n) AS n, round(sum(n * CAST(predicted = truth AS INT)) * 1.0 / sum(n), 6) AS micro_f1
FROM (SELECT d.corpus, truth, n, unnest(['document', 'corpus']) AS model, unnest([by_document, by_corpus]) AS predicted FROM d JOIN p ON d.corpus IS NOT DISTINCT FROM p.corpus AND d.doc_key IS NOT DISTINCT FROM p.doc_key JOIN q ON d.corpus IS NOT DISTINCT FROM q.corpus) GROUP BY ALL""")
def micro_f1(spark, sf):
    """Micro-F1 of two predictors by corpus: a line's language is its document's most
    frequent one, or its corpus's. With one label a row it is the share of right ones."""
    codes = t(spark, sf, "lang_code").groupBy(F.col("code").alias("label")).agg(F.min("lang").alias("truth"))
    d = t(spark, sf, "benchmark_df").join(F.broadcast(codes), "label").groupBy("corpus", "doc_key", "truth").agg(F.count("*").alias("n"))
    often = lambda n: F.struct(n.alias("n"), F.transform(F.split("truth", ""), lambda x: -F.ascii(x)).alias("o"))
    p = d.groupBy("corpus", "doc_key").agg(F.max_by("truth", often(F.col("n"))).alias("document"))
    q = d.groupBy("corpus", "truth").agg(F.sum("n").alias("n")).groupBy("corpus").agg(F.max_by("truth", often(F.col("n"))).alias("corpus_wide")).withColumnRenamed("corpus", "c")
    both = d.join(p.toDF("pc", "pd", "document"), d["corpus"].eqNullSafe(F.col("pc")) & d["doc_key"].eqNullSafe(F.col("pd"))).join(q, F.col("corpus").eqNullSafe(F.col("c")))
    told = both.select("corpus", "truth", "n", F.explode(F.create_map(F.lit("document"), "document", F.lit("corpus"), "corpus_wide")).alias("model", "predicted"))
    return told.groupBy("corpus", "model").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("predicted") == F.col("truth"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("micro_f1"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS balance FROM customer),
  c AS (SELECT s_suppkey AS k, s_acctbal AS supplies FROM supplier) SELECT k, orders, round(spent, 2) AS spent, balance, supplies FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def outer_features(spark, sf):
    a = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    b = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    c = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("supplies"))
    return a.join(b, "k", "full_outer").join(c, "k", "full_outer")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT n.* FROM nation n JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') ON c_nationkey = n_nationkey")
def left_join_index(spark, sf):
    far = t(spark, sf, "nation").join(t(spark, sf, "region").where("r_name != 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, sf, "customer").join(far, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM lang_code)")
def semi_join(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "lang_code"), "lang", "left_semi").select("doc_id", "lang")


@query("SELECT DISTINCT expected_page_id FROM eval_item WHERE expected_page_id NOT IN (SELECT regexp_replace(route, '/+$', '') FROM search_record WHERE route IS NOT NULL)")
def anti_join(spark, sf):
    """Labelled pages that the corpus lacks."""
    pages = t(spark, sf, "search_record").select(X.canonical_route("route").alias("expected_page_id"))
    return t(spark, sf, "eval_item").select("expected_page_id").distinct().join(pages, "expected_page_id", "left_anti")


@query("SELECT p_partkey, round(CASE WHEN f.v IS NOT NULL AND f.v <> 0 THEN f.v ELSE p_retailprice END, 4) AS price FROM part LEFT JOIN (SELECT l_partkey AS k, max(l_discount) * 100 AS v FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) f ON p_partkey = f.k")
def price_override(spark, sf):
    fill = t(spark, sf, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_discount") * 100).alias("v"))
    j = t(spark, sf, "part").join(fill, "p_partkey", "left")
    return j.select("p_partkey", F.round(F.when(F.col("v").isNotNull() & (F.col("v") != 0), F.col("v")).otherwise(F.col("p_retailprice")), 4).alias("price"))


@query(r"""WITH c AS (SELECT regexp_replace(model, '\s*\([^)]*\)\s*$', '') AS base, CASE WHEN tau2 > 0 AND NOT isnan(tau2) THEN tau2 END AS tau2, CASE WHEN gdpval > 0 AND NOT isnan(gdpval) THEN gdpval END AS gdpval FROM param_estimation)
SELECT base, max(tau2) AS tau2_best, round(avg(gdpval), 6) AS gdpval_mean FROM c GROUP BY base""")
def name_unify(spark, sf):
    good = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c))
    return t(spark, sf, "param_estimation").groupBy(X.without_remark("model").alias("base")).agg(F.max(good("tau2")).alias("tau2_best"), F.round(F.avg(good("gdpval")), 6).alias("gdpval_mean"))


@query("""SELECT record_id, round(CASE WHEN "totalExperts" > 0 THEN "activeExperts" / "totalExperts" END, 8) AS active_ratio, round(1 - CASE WHEN "totalExperts" > 0 THEN "activeExperts" / "totalExperts" END, 8) AS sparsity,
  round((3 * price_1m_input_tokens + price_1m_output_tokens) / 4, 6) AS blended FROM param_estimation WHERE NOT isnan(coalesce(price_1m_input_tokens, 0)) AND NOT isnan(coalesce(price_1m_output_tokens, 0))""")
def derived_ratios(spark, sf):
    ratio = F.try_divide(F.col("activeExperts"), F.nullif(F.when(F.col("totalExperts") > 0, F.col("totalExperts")), F.lit(0)))
    df = t(spark, sf, "param_estimation").where("not isnan(coalesce(price_1m_input_tokens, 0D)) and not isnan(coalesce(price_1m_output_tokens, 0D))")
    return df.select("record_id", F.round(ratio, 8).alias("active_ratio"), F.round(1 - ratio, 8).alias("sparsity"), F.round(N.blended_price("price_1m_input_tokens", "price_1m_output_tokens"), 6).alias("blended"))


@query("SELECT record_id, metric, value FROM (SELECT record_id, gdpval, tau2, omniscience_accuracy FROM param_estimation) UNPIVOT (value FOR metric IN (gdpval, tau2, omniscience_accuracy)) WHERE NOT isnan(value)")
def unpivot_metrics(spark, sf):
    return t(spark, sf, "param_estimation").unpivot("record_id", ["gdpval", "tau2", "omniscience_accuracy"], "metric", "value").where("value is not null and not isnan(value)")


@query("SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') * 1.0 / count(*) AS a, count(*) FILTER (l_returnflag = 'N') * 1.0 / count(*) AS n, count(*) FILTER (l_returnflag = 'R') * 1.0 / count(*) AS r FROM lineitem GROUP BY 1")
def pivot_probs(spark, sf):
    p = A.shares(t(spark, sf, "lineitem"), ["l_linenumber"], "l_returnflag")
    w = p.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.first("p"))
    return w.select("l_linenumber", *[F.coalesce(x, F.lit(0.0)).alias(x.lower()) for x in ("A", "N", "R")])


@query("SELECT 'chunk' AS corpus, title, text FROM chunk UNION ALL SELECT 'search_record', title, fragment_text FROM search_record UNION ALL SELECT 'documents', title, text FROM documents")
def union_tagged(spark, sf):
    tagged = lambda name, c: t(spark, sf, name).select(F.lit(name).alias("corpus"), "title", F.col(c).alias("text"))
    return tagged("chunk", "text").unionByName(tagged("search_record", "fragment_text")).unionByName(tagged("documents", "text"))


@query("""SELECT 'lost' AS side, title, count(*) AS n FROM (SELECT title FROM documents WHERE source = 'blog' EXCEPT ALL SELECT title FROM documents WHERE source = 'forum') GROUP BY title
UNION ALL SELECT 'gained', title, count(*) FROM (SELECT title FROM documents WHERE source = 'forum' EXCEPT ALL SELECT title FROM documents WHERE source = 'blog') GROUP BY title""")
def except_multiset(spark, sf):
    """What each side has more of, and how often: both counts come from one aggregate."""
    d = t(spark, sf, "documents").where("source in ('blog', 'forum')").groupBy("title").agg((F.count_if(F.col("source") == "blog") - F.count_if(F.col("source") == "forum")).alias("d"))
    return d.where("d != 0").select(F.when(F.col("d") > 0, "lost").otherwise("gained").alias("side"), "title", F.abs("d").alias("n"))


@query("SELECT title FROM documents WHERE source = 'blog' INTERSECT ALL SELECT title FROM documents WHERE source = 'mirror'")
def intersect_multiset(spark, sf):
    d = t(spark, sf, "documents")
    return d.where("source = 'blog'").select("title").intersectAll(d.where("source = 'mirror'").select("title"))


@query("SELECT lang FROM documents WHERE lang IS NOT NULL INTERSECT SELECT lang FROM lang_code")
def set_intersection(spark, sf):
    return t(spark, sf, "documents").where("lang is not null").select("lang").intersect(t(spark, sf, "lang_code").select("lang"))


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 20")
def stratified_sample(spark, sf):
    """Exactly 20 rows of each label, by hash order: a sampling operator."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return t(spark, sf, "documents").where("lang is not null").withColumn("n", F.row_number().over(w)).where("n <= 20").select("doc_id", "lang")


@query("SELECT DISTINCT subset, rate, ver FROM eval_item, (SELECT unnest(generate_series(1, 20)) * 5 AS rate), (SELECT unnest(generate_series(1, 5)) AS ver)")
def experiment_grid(spark, sf):
    subsets = t(spark, sf, "eval_item").select("subset").distinct()
    return subsets.select("subset", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k")).select("subset", (F.col("k") * 5).cast("bigint").alias("rate"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ver")).withColumn("ver", F.col("ver").cast("bigint"))


@query("WITH r AS (SELECT r_regionkey AS k FROM region) SELECT a.k AS a, b.k AS b FROM r a JOIN r b ON a.k <= b.k")
def pairs_with_self(spark, sf):
    """Unordered pairs of a fixed list of five."""
    r = t(spark, sf, "region").select("r_regionkey")
    return r.select(F.col("r_regionkey").alias("a")).join(r.select(F.col("r_regionkey").alias("b")), F.col("a") <= F.col("b"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def latest_page(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest"))


@query("SELECT v.response_id, length(v.response) AS n, length(b.reference) AS base, round((length(v.response) - length(b.reference)) * 1.0 / nullif(length(v.response), 0), 6) AS delta_share FROM rag_response_df v JOIN (SELECT query_id, min(reference) AS reference FROM rag_response_df GROUP BY 1) b USING (query_id) WHERE v.response IS NOT NULL AND b.reference IS NOT NULL")
def baseline_alignment(spark, sf):
    """Variants against their question's baseline by key; the share is of the variant's own size."""
    v = t(spark, sf, "rag_response_df")
    base = v.groupBy("query_id").agg(F.min("reference").alias("reference"))
    n, b = F.length("response"), F.length("reference")
    j = v.select("response_id", "query_id", "response").join(base, "query_id").where("response is not null and reference is not null")
    return j.select("response_id", n.cast("bigint").alias("n"), b.cast("bigint").alias("base"), F.round((n - b) / F.nullif(n, F.lit(0)), 6).alias("delta_share"))


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS fitted FROM lineitem GROUP BY ALL""")
def cell_means(spark, sf):
    """Fitted values of the saturated two-way model are its cells' means."""
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("fitted"))


@query("SELECT l_returnflag, round(greatest(regr_slope(l_extendedprice, l_quantity), 0), 6) AS slope, round(CASE WHEN regr_slope(l_extendedprice, l_quantity) > 0 THEN regr_intercept(l_extendedprice, l_quantity) ELSE avg(l_extendedprice) END, 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linear_fit(spark, sf):
    """One feature with a slope of at least zero, in closed form."""
    slope = F.regr_slope("l_extendedprice", "l_quantity")
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.greatest(slope, F.lit(0.0)), 6).alias("slope"),
        F.round(F.when(slope > 0, F.regr_intercept("l_extendedprice", "l_quantity")).otherwise(F.avg("l_extendedprice")), 4).alias("intercept"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"),
    )


FOLDS = """r AS (SELECT l_linenumber AS split, l_quantity AS x, log10(l_extendedprice) AS y, l_extendedprice AS raw FROM lineitem WHERE l_extendedprice > 0),
  f AS (SELECT s.split, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT split FROM r) s JOIN r ON r.split <> s.split GROUP BY 1),
  m AS (SELECT r.split, count(*) AS n, 1 - sum(pow(y - a - b * x, 2)) / nullif(sum(pow(y, 2)) - pow(sum(y), 2) / count(*), 0) AS r2, avg(abs(raw - pow(10, a + b * x))) AS mae, sqrt(avg(pow(raw - pow(10, a + b * x), 2))) AS rmse FROM r JOIN f USING (split) GROUP BY 1)"""


def folds(spark, sf):
    """Each fold's figures by a line that is fitted on all other folds: their sums are the
    total less the fold's own, so rows are read for the sums and once for the errors."""
    r = t(spark, sf, "lineitem").where("l_extendedprice > 0").select(F.col("l_linenumber").alias("split"), F.col("l_quantity").cast("double").alias("x"), F.log10(F.col("l_extendedprice").cast("double")).alias("y"), F.col("l_extendedprice").cast("double").alias("raw"))
    parts = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}
    own = r.groupBy("split").agg(*[F.sum(c).alias(k) for k, c in parts.items()])
    total = own.agg(*[F.sum(k).alias(f"t_{k}") for k in parts])
    n, sx, sy, sxx, sxy = (F.col(f"t_{k}") - F.col(k) for k in parts)
    slope = (sxy - sx * sy / n) / (sxx - sx * sx / n)
    lines = own.crossJoin(F.broadcast(total)).select("split", slope.alias("b"), ((sy - slope * sx) / n).alias("a"))
    off, raw = F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.col("raw") - F.pow(F.lit(10.0), F.col("a") + F.col("b") * F.col("x"))
    rows = r.join(lines, "split")
    return rows.groupBy("split").agg(F.count("*").alias("n"), (1 - F.sum(off * off) / F.nullif(F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count("*"), F.lit(0.0))).alias("r2"), F.avg(F.abs(raw)).alias("mae"), F.sqrt(F.avg(raw * raw)).alias("rmse"))


@query(f"WITH {FOLDS} SELECT split, n, round(r2, 6) AS r2, round(mae, 4) AS mae, round(rmse, 4) AS rmse FROM m")
def cv_metrics(spark, sf):
    """Cross-validation by folds: R2 of logarithms, errors of the raw values."""
    return folds(spark, sf).select("split", "n", F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query(f"WITH {FOLDS} SELECT count(*) AS folds, round(avg(r2), 6) AS r2, round(stddev_samp(r2), 6) AS r2_std, CASE WHEN min(n) > 5 THEN round(avg(mae), 4) END AS mae, CASE WHEN min(n) > 5 THEN round(stddev_samp(mae), 4) END AS mae_std FROM m")
def cv_summary(spark, sf):
    """Means and sample deviations over the folds, none where a fold has five rows or fewer."""
    enough = F.min("n") > 5
    return folds(spark, sf).agg(F.count("*").alias("folds"), F.round(F.avg("r2"), 6).alias("r2"), F.round(F.stddev_samp("r2"), 6).alias("r2_std"), F.when(enough, F.round(F.avg("mae"), 4)).alias("mae"), F.when(enough, F.round(F.stddev_samp("mae"), 4)).alias("mae_std"))


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, avg(o_totalprice) AS m FROM orders GROUP BY ALL), z AS (SELECT min(a) AS a0, min(b) AS b0 FROM c)
SELECT c.a, c.b, round(c.m - CASE WHEN c.a = a0 AND c.b = b0 THEN 0 WHEN c.a = a0 OR c.b = b0 THEN o.m ELSE x.m + y.m - o.m END, 4) AS coefficient
FROM c, z JOIN c o ON o.a = a0 AND o.b = b0 JOIN c x ON x.a = c.a AND x.b = b0 JOIN c y ON y.a = a0 AND y.b = c.b""")
def two_way_model(spark, sf):
    """Coefficients of the two-way model with interaction, the first levels as the base:
    the row of both bases is the intercept, a base and another level a main effect, two
    others their interaction. They follow from the means of the few cells."""
    c = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.avg("o_totalprice").alias("m"))
    all_cells = Window.partitionBy(F.lit(1))
    based = c.withColumns({"a0": F.col("a") == F.min("a").over(all_cells), "b0": F.col("b") == F.min("b").over(all_cells)})
    at = lambda cond, over: F.max(F.when(cond, F.col("m"))).over(over)
    m = based.withColumns({"o": at(F.col("a0") & F.col("b0"), all_cells), "x": at(F.col("b0"), Window.partitionBy("a")), "y": at(F.col("a0"), Window.partitionBy("b"))})
    less = F.when(F.col("a0") & F.col("b0"), F.lit(0.0)).when(F.col("a0") | F.col("b0"), F.col("o")).otherwise(F.col("x") + F.col("y") - F.col("o"))
    return m.where("o is not null and x is not null and y is not null").select("a", "b", F.round(F.col("m") - less, 4).alias("coefficient"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS spent, round(sum(value * value) / nullif(sum(value), 0), 6) AS weighted FROM events GROUP BY user_id")
def weighted_average(spark, sf):
    """Sums of weights times scores over sums of weights, with conditional sums beside."""
    e = t(spark, sf, "events")
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 4).alias("spent"),
        F.round(F.try_divide(F.sum(F.col("value") * F.col("value")), F.nullif(F.sum("value"), F.lit(0.0))), 6).alias("weighted"),
    )


@query("SELECT user_id, count(*) FILTER (event_type <> 'view') AS kept, round(exp(sum(value / 100 * CAST(event_type <> 'view' AS INT)) / nullif(sum(CAST(event_type <> 'view' AS INT)), 0)), 6) AS perplexity FROM events GROUP BY user_id")
def perplexity(spark, sf):
    """exp of summed losses over kept places: the sums of loss times mask and of the mask.
    Each user's events are a sequence, hundredths of their values its losses."""
    mask = F.when(F.col("event_type") != "view", 1).otherwise(0)
    e = t(spark, sf, "events").groupBy("user_id")
    return e.agg(F.sum(mask).alias("kept"), F.round(F.exp(F.try_divide(F.sum(F.col("value") / 100 * mask), F.nullif(F.sum(mask), F.lit(0)))), 6).alias("perplexity"))


@query("SELECT chunks, questions, chunks * 120 + questions * 450 AS prompt_tokens, (chunks * 120 + questions * 450) // 1000 AS thousands, round((chunks * 120 + questions * 450) * 3.0 / 1e6, 6) AS usd FROM (SELECT unnest(generate_series(1, 10)) * 100 AS chunks), (SELECT unnest(generate_series(1, 5)) * 50 AS questions)")
def cost_grid(spark, sf):
    """Token and price arithmetic over a grid of parameters."""
    g = spark.range(1, 11).select((F.col("id") * 100).alias("chunks"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select("chunks", (F.col("k") * 50).cast("bigint").alias("questions"))
    tokens = F.col("chunks") * 120 + F.col("questions") * 450
    return g.select("chunks", "questions", tokens.alias("prompt_tokens"), F.floor(tokens / 1000).cast("bigint").alias("thousands"), F.round(tokens * 3.0 / 1e6, 6).alias("usd"))


@query("SELECT x, y, round(exp(-(x * x + y * y) / 2.0), 8) AS density, round(exp(-(x * x + y * y) / 2.0) / max(exp(-(x * x + y * y) / 2.0)) OVER (), 8) AS opacity FROM (SELECT (unnest(generate_series(0, 20)) - 10) / 5.0 AS x), (SELECT (unnest(generate_series(0, 20)) - 10) / 5.0 AS y)")
def gaussian_grid(spark, sf):
    axis = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: (k - 10) / 5.0)
    g = spark.range(1).select(F.explode(axis).alias("x")).select("x", F.explode(axis).alias("y"))
    d = F.exp(-(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2.0)
    return g.select("x", "y", F.round(d, 8).alias("density"), F.round(d / F.max(d).over(Window.partitionBy(F.lit(1))), 8).alias("opacity"))


@query("SELECT decade, CAST(pow(10, decade) AS DOUBLE) AS tick, round(log10(3 * pow(10, decade)), 8) AS third FROM (SELECT unnest(generate_series(0, 12)) AS decade)")
def log_ticks(spark, sf):
    return spark.range(13).select(F.col("id").alias("decade"), F.pow(F.lit(10.0), F.col("id")).alias("tick"), F.round(F.log10(3 * F.pow(F.lit(10.0), F.col("id"))), 8).alias("third"))


@query("SELECT c_custkey, ceil(c_acctbal * 100 / 7) / 100 AS up FROM customer")
def ceil_places(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", (F.ceil(F.col("c_acctbal") * 100 / 7) / 100).alias("up"))


_HEX = "printf('#%02x%02x%02x', {0} * 37 % 256, {0} * 91 % 256, {0} * 53 % 256)"


@query("WITH c AS (SELECT n_nationkey AS k, ['#1a2b3c','#ffffff','#000000','#c0ffee','#7f7f7f'][n_nationkey % 5 + 1] AS hex FROM nation), ch AS (SELECT k, hex, list_transform([2, 4, 6], lambda i: CAST(('0x' || substr(hex, i, 2)) AS INT) / 255.0) AS v FROM c), "
       "l AS (SELECT k, hex, list_transform(v, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS w FROM ch), y AS (SELECT k, hex, 0.2126 * w[1] + 0.7152 * w[2] + 0.0722 * w[3] AS lum FROM l) "
       "SELECT a.k AS a, b.k AS b, round((greatest(a.lum, b.lum) + 0.05) / (least(a.lum, b.lum) + 0.05), 6) AS ratio, CASE WHEN (greatest(a.lum, b.lum) + 0.05) / (least(a.lum, b.lum) + 0.05) >= 7 THEN 'AAA' WHEN (greatest(a.lum, b.lum) + 0.05) / (least(a.lum, b.lum) + 0.05) >= 4.5 THEN 'AA' ELSE 'fail' END AS grade FROM y a, y b WHERE a.k <> b.k")
def contrast_ratio(spark, sf):
    """A fixed palette's colours against each other."""
    hexes = F.array(*[F.lit(x) for x in ("#1a2b3c", "#ffffff", "#000000", "#c0ffee", "#7f7f7f")])
    c = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.element_at(hexes, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("hex"))
    a, b = c.select(F.col("k").alias("a"), F.col("hex").alias("ha")), c.select(F.col("k").alias("b"), F.col("hex").alias("hb"))
    r = N.contrast("ha", "hb")
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", F.round(r, 6).alias("ratio"), F.when(r >= 7, "AAA").when(r >= 4.5, "AA").otherwise("fail").alias("grade"))
