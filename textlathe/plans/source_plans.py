"""Readers and sinks over whole tables: a table is written in a file format into the shared
folder and read back by the reader of that format; the SQL reads the table itself."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlathe.functions import text as X
from textlathe.plans.base import Plans
from textlathe.plans.search_plans import ROUTE
from textlathe.runtime import scratch, table
from textlathe.sources import readers as S
from textlathe.sources import sinks as K

plans = Plans()
query = plans.query
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


def folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/files-{uuid.uuid4().hex}"


def named_file(spark: SparkSession, lines: DataFrame, path: str, name: str, kind: str = "text", **options: str) -> None:
    """One file of a given name, of a small table."""
    lines.coalesce(1).write.options(**options).format(kind).save(f"{path}-parts/{name}")
    fs, root, Path = K._fs(spark, path)
    fs.mkdirs(root)
    for f in fs.listStatus(Path(f"{path}-parts/{name}")):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), Path(f"{path}/{name}"))


CELLS = "SELECT doc_id, route, source, n_chars, published_at FROM documents"


@query(f"SELECT 'comma' AS kind, * FROM ({CELLS}) UNION ALL SELECT 'tab', * FROM ({CELLS})")
def read_delimited(spark, sf):
    """Comma and tab files through a given schema."""
    path, cells = folder(spark), table(spark, sf, "documents").select("doc_id", "route", "source", "n_chars", "published_at")
    schema = "doc_id bigint, route string, source string, n_chars bigint, published_at timestamp_ntz"
    out = None
    for kind, sep in (("comma", ","), ("tab", "\t")):
        cells.write.option("sep", sep).option("header", True).csv(f"{path}/{kind}")
        got = S.delimited(spark, f"{path}/{kind}", schema, sep).select(F.lit(kind).alias("kind"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT response_id, query_id, user_input, len(reference_contexts) AS contexts FROM rag_response_df")
def read_json_lines(spark, sf):
    """JSON lines with nested records, read through a schema of a few of their fields."""
    path, r = folder(spark), table(spark, sf, "rag_response_df")
    r.select("response_id", F.struct("query_id", "user_input", "reference", "response").alias("turn"), "reference_contexts").write.json(path)
    got = S.json_lines(spark, path, "response_id bigint, turn struct<query_id:bigint,user_input:string>, reference_contexts array<string>")
    return got.select("response_id", "turn.query_id", "turn.user_input", F.when(F.col("reference_contexts").isNotNull(), F.size("reference_contexts").cast("bigint")).alias("contexts"))


@query("SELECT 'nations_' || n_regionkey AS corpus, CAST(n_regionkey AS VARCHAR) AS suffix, n_nationkey, n_name FROM nation")
def read_tagged_files(spark, sf):
    """Files whose names say what is in them."""
    path, n = folder(spark), table(spark, sf, "nation")
    for r in n.select("n_regionkey").distinct().collect():
        named_file(spark, n.where(F.col("n_regionkey") == r.n_regionkey), path, f"nations_{r.n_regionkey}.parquet", "parquet")
    return S.file_suffix(S.tagged_parquet(spark, path), "suffix").select("corpus", "suffix", "n_nationkey", "n_name")


@query("SELECT lang AS label, row_number() OVER (PARTITION BY lang ORDER BY code) - 1 AS line_no, code AS text FROM lang_code")
def read_labelled_lines(spark, sf):
    """A text file a language, every second one gzipped."""
    path, c = folder(spark), table(spark, sf, "lang_code")
    for n, r in enumerate(c.select("lang").distinct().orderBy("lang").collect()):
        packed = n % 2 == 1
        own = c.where(F.col("lang") == r.lang).orderBy("code").select("code")
        named_file(spark, own, path, f"{r.lang}.txt{'.gz' if packed else ''}", compression="gzip" if packed else "none")
    return S.labelled_lines(spark, path).select("label", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query("SELECT code AS typo, max(lang) AS correction FROM lang_code GROUP BY code UNION ALL SELECT 'every', max(lang) FROM lang_code")
def read_misspellings(spark, sf):
    """A dictionary of headers and wrong words; one listed under each keeps the last header."""
    path, c = folder(spark), table(spark, sf, "lang_code")
    words = c.groupBy("lang").agg(F.array_sort(F.collect_set("code")).alias("codes")).orderBy("lang")
    lines = words.select(F.explode(F.concat(F.array(F.concat(F.lit("$"), "lang")), F.array(F.lit("every 2")), "codes")).alias("value"))
    named_file(spark, lines, path, "words.txt")
    return S.misspellings(spark, path)


@query("SELECT word AS typo, kind AS correction FROM name_list")
def read_word_pairs(spark, sf):
    path = folder(spark)
    table(spark, sf, "name_list").select(F.concat(F.lit(" "), "word", F.lit("\t "), "kind").alias("value")).write.text(path)
    return S.word_pairs(spark, path)


@query("SELECT code AS key, lang AS value FROM lang_code")
def read_flat_map(spark, sf):
    """Flat key and value lines, some quoted, between comments and blank lines."""
    path, c = folder(spark), table(spark, sf, "lang_code")
    plain = F.concat("code", F.lit(": "), "lang")
    line = F.when(F.length("code") == 2, F.concat(F.lit("'"), "code", F.lit("': \""), "lang", F.lit('"'))).otherwise(plain)
    c.select(F.explode(F.array(F.lit("# codes"), line, F.lit(" "))).alias("value")).write.text(path)
    return S.flat_map(spark, path)


@query("SELECT user_input AS typo, reference AS correction FROM rag_response_df WHERE created_at IS NOT NULL AND length(reference) > 60 AND user_input IS NOT NULL")
def read_commit_edits(spark, sf):
    """Edits of which only English ones that are marked as typos count."""
    path, r = folder(spark), table(spark, sf, "rag_response_df").where("user_input is not null and reference is not null")
    lang = F.when(F.length("reference") > 60, "eng").otherwise("deu")
    one = F.struct(F.struct(F.col("user_input").alias("text"), F.lit("eng").alias("lang")).alias("src"), F.struct(F.col("reference").alias("text"), lang.alias("lang")).alias("tgt"), F.col("created_at").isNotNull().alias("is_typo"))
    r.select("response_id", F.array(one).alias("edits")).write.json(path)
    return S.commit_edits(spark, path)


@query("""SELECT c.record_id, n.record_no, '{"id": ' || (c.record_id + n.record_no) || ', "pushed": ' || CASE WHEN length(c.model) > 14 THEN 'true' ELSE 'false' END || '}' AS record
FROM param_estimation c, (VALUES (0), (1)) n(record_no)""")
def read_payloads(spark, sf):
    """Records in pages' scripts: plain, or escaped in a pushed string."""
    pushes = F.coalesce(F.length("model") > 14, F.lit(False))
    one = lambda n: F.concat(F.lit('{"id":'), (F.col("record_id") + n).cast("string"), F.lit(',"pushed":'), F.when(pushes, "true").otherwise("false"), F.lit("}"))
    plain = F.concat(F.lit('<script>var x = {"models": ['), one(0), F.lit(", "), one(1), F.lit("], \"other\": [1]}</script>"))
    pushed = F.concat(F.lit('<script>self.__next_f.push([1,"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    pages = table(spark, sf, "param_estimation").select("record_id", F.when(pushes, pushed).otherwise(plain).alias("page"))
    return S.payload_records(pages, "page", ["record_id"])


@query("""SELECT doc_id, CASE WHEN lang IS NOT NULL THEN title END AS meta_title, md5(CASE WHEN lang IS NOT NULL THEN '# ' || title || chr(10) || chr(10) ELSE '' END || text) AS body
FROM documents WHERE title IS NOT NULL AND text IS NOT NULL AND NOT regexp_matches(title, '^\\s|\\s$|[\\r\\n''"]') AND title <> ''""")
def read_front_matter(spark, sf):
    """Front matter with a title before each text that has a language, without one before the others."""
    d = table(spark, sf, "documents").where("title is not null and text is not null and title != ''").where(~F.col("title").rlike(r"^\s|\s$|[\r\n'\"]"))
    front = F.when(F.col("lang").isNotNull(), F.concat(F.lit("---\ntitle: '"), "title", F.lit("'\ntags: [a]\n---\n"))).otherwise("---\ntags: [a]\n---\n")
    return S.with_front_matter(d.select("doc_id", F.concat(front, "text").alias("t")), "t").select("doc_id", "meta_title", F.md5("body").alias("body"))


@query("""SELECT o_orderkey, x.pos, x.heading_key, x.content FROM orders, LATERAL (VALUES (0, '', o_orderpriority), (1, 'a' || o_orderkey || '#' || o_orderstatus, 'total ' || o_orderstatus), (2, 'end#The end', '')) x(pos, heading_key, content)""")
def read_page_sections(spark, sf):
    """HTML pages cut at anchored headings."""
    page = F.concat(
        F.lit("<p>"), "o_orderpriority", F.lit('</p>\n<h2 class="x"> '), "o_orderstatus", F.lit('<span id="a'), F.col("o_orderkey").cast("string"),
        F.lit('"></span></h2><p>total\n <b>'), "o_orderstatus", F.lit('</b></p><h3>The <i>end</i><span id="end"></span></h3>'),
    )
    return S.page_sections(table(spark, sf, "orders").select("o_orderkey", page.alias("page")), "page", ["o_orderkey"])


@query("SELECT doc_id FROM documents WHERE lang IS NULL AND title IS NOT NULL AND text IS NOT NULL")
def read_changed_files(spark, sf):
    """Texts of two snapshots that differ; added and deleted ones don't count."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "title")
    after = d.where("title is not null").withColumn("text", F.when(F.col("lang").isNull(), F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")))
    return S.changed_files(d, after, "doc_id", "text").select("doc_id")


SECTION_TEXTS = f"""SELECT {ROUTE} AS route, heading_key, max(coalesce(fragment_text, '')) AS t FROM search_record WHERE starts_with(route, '/') AND heading_key IS NOT NULL GROUP BY ALL"""


@query(f"SELECT route, heading_key, 'Page ' || route AS title, md5(t) AS digest FROM ({SECTION_TEXTS})")
def read_corpus(spark, sf):
    """Corpus files of pages and their sections, several of them, through the strict reader."""
    path = folder(spark)
    s = table(spark, sf, "search_record").where("startswith(route, '/') and heading_key is not null").groupBy(X.canonical_route("route").alias("route"), "heading_key").agg(F.max(F.coalesce("fragment_text", F.lit(""))).alias("t"))
    pages = s.groupBy("route").agg(F.map_from_entries(F.collect_list(F.struct("heading_key", "t"))).alias("data"))
    value = F.concat(F.lit("{"), F.to_json(F.map_from_arrays(F.array("route"), F.array(F.struct(F.concat(F.lit("Page "), "route").alias("title"), "data")))).substr(F.lit(2), F.lit(1 << 30)))
    pages.select(value.alias("value")).mapInPandas(one_object, "value string").write.option("lineSep", "\n").text(path)
    records, _ = S.corpus(spark, path)
    return records.select("route", "heading_key", "title", F.md5("fragment_text").alias("digest"))


def one_object(frames):
    """All of a partition's objects as one."""
    both: dict = {}
    for frame in frames:
        for v in frame["value"]:
            both |= json.loads(v)
    yield pd.DataFrame({"value": [json.dumps(both, ensure_ascii=False)]})


@query("SELECT query, subset, expected_page_id, expected_section_url, rationale, source_text FROM eval_item")
def read_labels(spark, sf):
    """Evaluation labels as one array of objects: a small fixed table."""
    path, e = folder(spark), table(spark, sf, "eval_item").select(*S.LABEL_KEYS)
    rows = e.agg(F.to_json(F.collect_list(F.struct(*S.LABEL_KEYS)), {"ignoreNullFields": "false"}).alias("value"))
    named_file(spark, rows, path, "labels.json")
    return S.labels(spark, path)


@query("""SELECT '{"code":"' || code || '","lang":"' || lang || '"}' || chr(10) AS line FROM lang_code""")
def canonical_lines(spark, sf):
    """Objects as JSON in one form, whatever the order of their keys: a small fixed table."""
    rows = table(spark, sf, "lang_code").collect()
    return spark.createDataFrame([(S.canonical_json({"lang": r.lang, "code": r.code}),) for r in rows], "line string")


@query("SELECT 'documents' AS name, doc_id AS id, n_chars AS n, true AS whole FROM documents UNION ALL SELECT 'embeddings', vec_id, len(embedding), true FROM embeddings")
def publish_and_read(spark, sf):
    """Two tables published as one set, published again, and read through the pointer."""
    path = folder(spark)
    tables = {"documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n")), "embeddings": table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").cast("bigint").alias("n"))}
    K.publish(spark, path, {"documents": tables["documents"].limit(0)}, {"round": 1})
    version = K.publish(spark, path, tables, {"round": 2})
    meta, found = K.published(spark, path)
    told = json.dumps(meta, sort_keys=True, separators=(",", ":")) + "\n"
    whole = meta["version"] == version and meta["round"] == 2 and meta["bytes"] == len(told.encode())
    both = [found[name].select(F.lit(name).alias("name"), "id", "n", F.lit(whole).alias("whole")) for name in sorted(found)]
    return both[0].unionByName(both[1])


@query("SELECT c_mktsegment AS name, printf('%.4f', sqrt(avg(c_acctbal * c_acctbal))) AS value FROM customer GROUP BY 1")
def metric_lines(spark, sf):
    """A metric file written and read back as text."""
    path = folder(spark)
    K.metric_file(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.sqrt(F.avg(F.col("c_acctbal").cast("double") * F.col("c_acctbal").cast("double"))).alias("value")), path, "name", "value")
    return S.delimited(spark, path, "name string, value string")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def stage_once(spark, sf):
    """A stage's table made once: the second call reads what the first one wrote."""
    path, o = folder(spark), table(spark, sf, "orders")
    K.once(spark, path, lambda: o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")))
    return K.once(spark, path, lambda: o.limit(0))


@query("SELECT 'lineitem' AS name, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem")
def saved_parameters(spark, sf):
    """Figures saved as a model's parameters and loaded again."""
    path = folder(spark)
    r = table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("total")).first()
    K.save_parameters(spark, path, "lineitem", {"n": r.n, "total": r.total})
    p = K.load_parameters(spark, path, "lineitem")
    return spark.createDataFrame([("lineitem", p["n"], p["total"])], "name string, n bigint, total double")


@query("""SELECT 'events' AS name, count(*) AS n FROM events""")
def counted_rows(spark, sf):
    """A plain columnar sink and source."""
    path = folder(spark)
    table(spark, sf, "events").write.parquet(path)
    return spark.read.parquet(path).agg(F.lit("events").alias("name"), F.count("*").alias("n")).select("name", "n")
