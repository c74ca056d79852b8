"""Search queries: gate, sections, lexical and vector rankings, fusion, recall."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlathe.functions import numbers as N
from textlathe.functions import text as X
from textlathe.operators import search as S
from textlathe.plans.base import Plans
from textlathe.runtime import cut_lineage, spread, table

plans = Plans()
query = plans.query
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES

ROUTE = "CASE WHEN regexp_matches(route, '^/+$') THEN '/' ELSE regexp_replace(route, '/+$', '') END"
HEADING = r"CASE WHEN regexp_extract(heading_key, '(?s)^[^#]*#(.*)$', 1) = '' THEN title ELSE regexp_extract(heading_key, '(?s)^[^#]*#(.*)$', 1) END"
STRIP = r"regexp_replace(coalesce(fragment_text, ''), '^[\s\x{b}\p{Z}\x{85}]+|[\s\x{b}\p{Z}\x{85}]+$', '', 'g')"
KIND = rf"""CASE WHEN {STRIP} <> '' THEN 'non-empty'
  WHEN heading_key = '' OR starts_with(heading_key, '#') OR regexp_matches(split_part(heading_key, '#', 1), '^heading-[0-9]+$') THEN 'legitimate' ELSE 'suspicious' END"""
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
VIEW = f"SELECT seq, {ROUTE} AS page_id, title || chr(10) || {HEADING} || chr(10) || coalesce(fragment_text, '') AS text FROM search_record"
LEXICAL = f"""view AS ({VIEW}),
  d AS (SELECT seq, page_id, term, count(*) AS dtf FROM (SELECT seq, page_id, unnest({TOKENS.format("text")}) AS term FROM view) GROUP BY ALL),
  q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format("query")}) AS term FROM eval_item) GROUP BY ALL),
  sec AS (SELECT query_id, page_id, seq, sum(qtf * dtf) AS score FROM d JOIN q USING (term) GROUP BY ALL),
  page AS (SELECT query_id, page_id, max(score) AS score, min(seq) AS first_seq FROM sec GROUP BY ALL),
  lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seq) AS rank FROM page)"""
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
VECTORS = f"""sims AS (SELECT q.vec_id AS query_id, d.vec_id AS seq, CAST(d.label AS VARCHAR) AS page_id, {DOT.format("q.embedding", "d.embedding")} AS score
    FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)"""


def queries_of(spark, sf):
    return table(spark, sf, "eval_item").select(F.col("item_id").alias("query_id"), "query")


def vectors_of(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("page_id"), F.col("embedding").alias("vector"))


def vector_queries(spark, sf):
    """Every row whose id is divisible by 20 asks."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"SELECT seq, {KIND} AS kind, CASE WHEN starts_with(route, '/treadmill/') THEN 'treadmill' ELSE 'blog' END AS source FROM search_record")
def gate_classify(spark, sf):
    return table(spark, sf, "search_record").select("seq", X.emptiness("heading_key", "fragment_text").alias("kind"), X.source_of("route").alias("source"))


@query(f"""WITH k AS (SELECT {KIND} AS kind, CASE WHEN starts_with(route, '/treadmill/') THEN 'treadmill' ELSE 'blog' END AS source FROM search_record)
SELECT coalesce(source, 'total') AS source, count(*) AS n, count(*) FILTER (kind = 'legitimate') AS legitimate, count(*) FILTER (kind = 'suspicious') AS suspicious,
  round(count(*) FILTER (kind = 'suspicious') / count(*), 6) AS suspicious_rate,
  count(*) FILTER (kind = 'suspicious') / count(*) <= 0.01 AND count(*) FILTER (kind = 'legitimate') / count(*) <= 0.10 AS passed
FROM k GROUP BY ROLLUP (source)""")
def gate_report(spark, sf):
    k = table(spark, sf, "search_record").select(X.emptiness("heading_key", "fragment_text").alias("kind"), X.source_of("route").alias("source"))
    rate = lambda x: F.coalesce(F.try_divide(F.count_if(F.col("kind") == x), F.count("*")), F.lit(0.0))
    return k.rollup("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "legitimate").alias("legitimate"), F.count_if(F.col("kind") == "suspicious").alias("suspicious"),
        F.round(rate("suspicious"), 6).alias("suspicious_rate"), ((F.count("*") > 0) & (rate("suspicious") <= 0.01) & (rate("legitimate") <= 0.10)).alias("passed"),
    ).withColumn("source", F.coalesce("source", F.lit("total")))


@query(f"""SELECT seq, {ROUTE} AS page_id, split_part(heading_key, '#', 1) AS anchor, {HEADING} AS heading,
  CASE WHEN split_part(heading_key, '#', 1) = '' THEN {ROUTE} ELSE {ROUTE} || '#' || split_part(heading_key, '#', 1) END AS url,
  CASE WHEN {HEADING} = title THEN title ELSE title || chr(10) || {HEADING} END AS context FROM search_record""")
def section_location(spark, sf):
    r = table(spark, sf, "search_record")
    heading = X.heading_of("heading_key", "title")
    return r.select(
        "seq", X.canonical_route("route").alias("page_id"), X.anchor_of("heading_key").alias("anchor"), heading.alias("heading"), X.section_url("route", "heading_key").alias("url"),
        F.when(heading == F.col("title"), F.col("title")).otherwise(F.concat_ws("\n", "title", heading)).alias("context"),
    )


@query(f"SELECT DISTINCT {ROUTE} AS page_id FROM (SELECT route FROM search_record UNION ALL SELECT route FROM documents)")
def canonical_routes(spark, sf):
    routes = table(spark, sf, "search_record").select("route").unionByName(table(spark, sf, "documents").select("route"))
    return routes.select(X.canonical_route("route").alias("page_id")).distinct()


@query(f"""WITH t AS (SELECT {ROUTE} AS route, min(title) AS title FROM search_record GROUP BY 1
    UNION ALL SELECT '/blog', 'Blog' UNION ALL SELECT '/treadmill', 'Treadmill'),
  p AS (SELECT route, list_filter(string_split(route, '/'), lambda x: x <> '') AS parts FROM t),
  x AS (SELECT route, unnest(generate_series(1, len(parts))) AS pos, parts FROM p),
  y AS (SELECT x.route, pos, len(parts) AS n, '/' || array_to_string(parts[1:pos], '/') AS prefix FROM x)
SELECT y.route, string_agg(CASE WHEN pos < n THEN t.title || ' > ' ELSE t.title END, '' ORDER BY pos) AS crumb FROM y JOIN t ON t.route = y.prefix WHERE t.title IS NOT NULL GROUP BY y.route""")
def breadcrumb(spark, sf):
    pages = table(spark, sf, "search_record").groupBy(X.canonical_route("route").alias("route")).agg(F.min("title").alias("title"))
    roots = spark.createDataFrame([("/blog", "Blog"), ("/treadmill", "Treadmill")], "route string, title string")
    return S.breadcrumbs(pages.unionByName(roots))


def sections(spark, sf):
    """The sections as texts; a table of fewer files than cores is spread over them, as
    cutting texts into words is the costly part."""
    return S.lexical_view(spread(table(spark, sf, "search_record").select("seq", "route", "heading_key", "title", "fragment_text")))


@query(VIEW)
def lexical_view(spark, sf):
    return sections(spark, sf)


@query(f"WITH {LEXICAL} SELECT query_id, page_id, CAST(score AS BIGINT) AS score, first_seq, rank FROM lex")
def lexical_rank(spark, sf):
    return S.lexical_rank(sections(spark, sf), queries_of(spark, sf), None).select("query_id", "page_id", F.col("score").cast("bigint").alias("score"), "first_seq", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {LEXICAL} SELECT query_id, page_id, rank FROM lex WHERE rank <= 10")
def lexical_topk_per_query(spark, sf):
    return S.lexical_rank(sections(spark, sf), queries_of(spark, sf)).select("query_id", "page_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term""")
def term_freq(spark, sf):
    per_doc = S.term_counts(spread(table(spark, sf, "documents").select("doc_id", "text").where("text is not null")), ["doc_id"], "text", "n")
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"WITH {VECTORS} SELECT query_id, seq, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM sims QUALIFY rank <= 5")
def vector_topk_many(spark, sf):
    top = S.vector_topk(vectors_of(spark, sf), vector_queries(spark, sf), 5)
    return top.select("query_id", "seq", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {VECTORS} SELECT seq, round(score, 6) AS score FROM sims WHERE query_id = 0 ORDER BY score DESC, seq LIMIT 10")
def vector_topk(spark, sf):
    one = vector_queries(spark, sf).where("query_id = 0")
    return S.vector_topk(vectors_of(spark, sf), one, 10).select("seq", F.round("score", 6).alias("score"))


@query(f"""WITH {VECTORS} SELECT query_id, page_id, round(max(score), 6) AS score, arg_min(seq, (-score, seq)) AS seq FROM sims GROUP BY query_id, page_id""")
def vector_rollup(spark, sf):
    r = S.vector_pages(vectors_of(spark, sf), vector_queries(spark, sf))
    return r.select("query_id", "page_id", F.round("score", 6).alias("score"), "seq")


HYBRID = f"""WITH {LEXICAL},
  s AS (SELECT q.item_id AS query_id, d.doc_id AS page_id, max({DOT.format("e.embedding", "v.embedding")}) AS score
    FROM eval_item q JOIN embeddings e ON e.vec_id = q.item_id JOIN embeddings v ON v.vec_id <> e.vec_id JOIN pages d ON d.n = v.vec_id GROUP BY ALL),
  sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM s WHERE score > 0)"""
PAGES = f"pages AS (SELECT page_id AS doc_id, CAST('0x' || substr(md5(page_id), 1, 7) AS BIGINT) % (SELECT count(*) FROM embeddings) AS n FROM (SELECT DISTINCT {ROUTE} AS page_id FROM search_record))"
HYBRID = HYBRID.replace("WITH ", f"WITH {PAGES}, ", 1)
FUSED = """k AS (SELECT query_id, page_id, rank AS kr FROM lex WHERE rank <= 10), m AS (SELECT query_id, page_id, rank AS sr FROM sem WHERE rank <= 10),
  f AS (SELECT coalesce(k.query_id, m.query_id) AS query_id, coalesce(k.page_id, m.page_id) AS page_id, kr, sr,
    coalesce(1.0::DOUBLE / (60 + kr), 0) + coalesce(2.0::DOUBLE / (60 + sr), 0) AS score FROM k FULL JOIN m ON k.query_id = m.query_id AND k.page_id = m.page_id),
  hyb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(kr, 1000 + sr)) AS rank FROM f)"""


def semantic_pages(spark, sf, top=10):
    """Each page borrows the vector at its hash's place, each item the vector of its id;
    the first `top` pages of each item."""
    vectors = table(spark, sf, "embeddings")
    size = vectors.agg(F.count("*").alias("size"))
    place = F.conv(F.substring(F.md5("page_id"), 1, 7), 16, 10).cast("bigint") % F.col("size")
    pages = table(spark, sf, "search_record").select(X.canonical_route("route").alias("page_id")).distinct().crossJoin(F.broadcast(size)).select("page_id", place.alias("seq"))
    rows = pages.join(vectors.select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector")), "seq")
    asked = table(spark, sf, "eval_item").select(F.col("item_id").alias("query_id")).join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    return S.ranked(S.vector_pages(rows, asked, top=top).where("score > 0"), [F.desc("score"), F.asc("page_id")], top=top)


@query(f"{HYBRID}, {FUSED} SELECT query_id, page_id, kr AS keyword_rank, sr AS semantic_rank, round(score, 8) AS score, rank FROM hyb")
def hybrid_rrf(spark, sf):
    keyword = S.lexical_rank(sections(spark, sf), queries_of(spark, sf))
    fused = S.fuse(keyword, semantic_pages(spark, sf))
    return fused.select("query_id", "page_id", F.col("keyword_rank").cast("bigint").alias("keyword_rank"), F.col("semantic_rank").cast("bigint").alias("semantic_rank"), F.round("score", 8).alias("score"), F.col("rank").cast("bigint").alias("rank"))


RECALL = "SELECT '{0}' AS condition, subset, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3 FROM eval_item e LEFT JOIN {1} r ON r.query_id = e.item_id AND r.page_id = e.expected_page_id GROUP BY subset"


@query(f"{HYBRID}, {FUSED} " + " UNION ALL ".join(RECALL.format(c, t) for c, t in (("keyword-only", "lex"), ("semantic-only", "sem"), ("hybrid", "hyb"))))
def recall_at_k(spark, sf):
    labels = table(spark, sf, "eval_item").select(F.col("item_id").alias("query_id"), "subset", "expected_page_id")
    # ten pages a query, each read for its own figures and for the fusion
    keyword = cut_lineage(S.lexical_rank(sections(spark, sf), queries_of(spark, sf)))
    semantic = cut_lineage(semantic_pages(spark, sf))
    out = None
    for name, ranks in (("keyword-only", keyword), ("semantic-only", semantic), ("hybrid", S.fuse(keyword, semantic))):
        r = S.recall(ranks, labels).select(F.lit(name).alias("condition"), "subset", "queries", F.round("recall_1", 6).alias("recall_1"), F.round("recall_3", 6).alias("recall_3"))
        out = r if out is None else out.unionByName(r)
    return out


@query(f"WITH {LEXICAL} SELECT query_id, page_id, rank, CAST(floor((rank - 1) / 20) AS BIGINT) AS page FROM lex")
def pagination(spark, sf):
    r = S.lexical_rank(sections(spark, sf), queries_of(spark, sf), None)
    return r.select("query_id", "page_id", F.col("rank").cast("bigint").alias("rank"), F.floor((F.col("rank") - 1) / 20).cast("bigint").alias("page"))


@query(f"""SELECT route, title, count(*) AS sections, count(*) FILTER (first) AS shown FROM (
  SELECT {ROUTE} AS route, title, row_number() OVER (PARTITION BY {ROUTE}, heading_key, coalesce(fragment_text, '') ORDER BY seq) = 1 AS first FROM search_record) GROUP BY route, title""")
def dedupe_sections(spark, sf):
    """Sections repeated under a page are shown once."""
    r = table(spark, sf, "search_record").select("seq", X.canonical_route("route").alias("route"), "title", "heading_key", F.coalesce("fragment_text", F.lit("")).alias("t"))
    first = F.row_number().over(Window.partitionBy("route", "heading_key", "t").orderBy("seq")) == 1
    return r.withColumn("first", first).groupBy("route", "title").agg(F.count("*").alias("sections"), F.count_if("first").alias("shown"))
