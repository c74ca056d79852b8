"""Readers: strict corpora, labels, delimited and line files, dictionaries, payloads, pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlathe.functions import text as X
from textlathe.functions.udfs import embedded_records, payload_text

SUBSETS = ("exact-term", "paraphrase", "navigational")
LABEL_KEYS = ("query", "subset", "expected_page_id", "expected_section_url", "rationale", "source_text")


class CorpusError(ValueError):
    """A corpus or label file that breaks its contract."""


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, titles) of `{route: {title, data: {heading key: text}}}` files, strictly.

    Records are (seq, route, heading_key, title, fragment_text) in file order, `seq` unique
    over all files and pages whatever their size; titles
    hold pages without sections too. Bad JSON, routes without a leading slash, other
    keys than title and data, and values that aren't strings raise `CorpusError`.
    """
    files = spark.read.text(path, wholetext=True)
    parsed = files.select(F.try_parse_json("value").alias("v"), "value")
    if not parsed.where("v is null").isEmpty():
        raise CorpusError("not JSON")
    pages = files.select(F.from_json("value", "map<string,string>").alias("m")).select(F.posexplode("m").alias("page_no", "route", "page"))
    if not parsed.where(~F.schema_of_variant("v").startswith("OBJECT")).isEmpty():
        raise CorpusError("not an object of pages")
    body = pages.select("page_no", "route", F.try_parse_json("page").alias("p"), F.from_json("page", "map<string,string>").alias("m"))
    shape = F.schema_of_variant("p")
    keys = F.array_sort(F.map_keys("m"))
    # every value of `data` must be a string, so its inferred schema knows no other type
    wrong = (
        ~F.col("route").startswith("/") | F.col("p").isNull() | ~shape.startswith("OBJECT") | (keys != F.array(F.lit("data"), F.lit("title")))
        | (F.schema_of_variant(F.variant_get("p", "$.title", "variant")) != "STRING")
        | ~F.schema_of_variant(F.variant_get("p", "$.data", "variant")).rlike(r"^OBJECT<(?:(?:`[^`]*`|[^:,`]*): STRING(?:, )?)*>$")
    )
    if not body.where(F.coalesce(wrong, F.lit(True))).isEmpty():
        raise CorpusError("a page breaks the contract")
    titled = body.select("page_no", "route", F.try_variant_get("p", "$.title", "string").alias("title"), F.from_json(F.col("m")["data"], "map<string,string>").alias("data"))
    flat = titled.select("page_no", "route", "title", F.posexplode("data").alias("pos", "heading_key", "fragment_text"))
    records = flat.select(F.monotonically_increasing_id().alias("seq"), "route", "heading_key", "title", "fragment_text")
    return records, titled.select("route", "title")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation labels: an array of objects with exactly the six keys, subsets of the
    three kinds, no query twice; anything else raises `CorpusError`."""
    files = spark.read.text(path, wholetext=True)
    items = files.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    n = items.count()
    good = items.where(F.array_sort(F.map_keys("m")) == F.array(*[F.lit(k) for k in sorted(LABEL_KEYS)])).where(F.col("m")["subset"].isin(*SUBSETS))
    out = good.select(*[F.col("m")[k].alias(k) for k in LABEL_KEYS])
    if not n or out.count() != n or out.select("query").distinct().count() != n or not out.where("query is null or expected_page_id is null").isEmpty():
        raise CorpusError("labels break the contract")
    return out


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV file with a given schema; the byte order mark is dropped by the reader."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines through a narrow schema, so other fields aren't even built."""
    return spark.read.schema(schema).json(path)


def tagged_parquet(spark: SparkSession, path: str, tag: str = "corpus") -> DataFrame:
    """Parquet files with their file's stem as a column."""
    return spark.read.parquet(path).withColumn(tag, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def file_suffix(df: DataFrame, name: str) -> DataFrame:
    """What follows the last low line of the file's stem, as a column."""
    return df.withColumn(name, F.element_at(F.split(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1), "_"), -1))


def labelled_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(label, line_no, text) of one text file a language, plain or gzipped; `most` keeps
    the first lines of each file, a sampling option."""
    raw = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("label"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    # lines are rows from the start: a file's blocks follow each other, and a block's lines have growing places
    number = F.row_number().over(Window.partitionBy("label").orderBy("block", "place")) - 1
    rows = raw.select("label", number.alias("line_no"), "text").where("text != ''")
    return rows.where(F.col("line_no") < most) if most else rows


def misspellings(spark: SparkSession, path: str) -> DataFrame:
    """(typo, correction) of `$word` dictionaries: a header line with the right word, then
    wrong ones, perhaps with a count. A wrong word listed twice keeps its last header."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\$")).alias("pos", "part"))
    lines = files.select("file", "pos", F.split(X.stripped("part"), r"\s*\n\s*").alias("l")).where(F.col("l")[0] != "")
    rows = lines.select("file", "pos", F.col("l")[0].alias("correction"), F.posexplode(F.slice("l", F.lit(2), F.greatest(F.lit(0), F.size("l") - 1))).alias("n", "line"))
    words = rows.select("file", "correction", F.split("line", r"\s+")[0].alias("typo"), F.struct("pos", "n").alias("place"))
    return words.groupBy("file", "typo").agg(F.max_by("correction", "place").alias("correction")).select("typo", "correction")


def word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(typo, correction) of lines with two words."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("typo"), parts[1].alias("correction"))


def flat_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of flat `key: value` files; comments, quotes and blank lines aside."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#") & line.contains(":"))
    clean = lambda c: F.regexp_replace(F.trim(c), r"^(['\"])(.*)\1$", "$2")
    return rows.select(clean(F.regexp_extract(line, r"^([^:]*):", 1)).alias("key"), clean(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))


def commit_edits(spark: SparkSession, path: str) -> DataFrame:
    """(typo, correction) of edit records: English on both sides and marked as typos."""
    side = "struct<text:string,lang:string>"
    rows = spark.read.schema(f"edits array<struct<src:{side},tgt:{side},is_typo:boolean>>").json(path)
    e = rows.select(F.explode("edits").alias("e")).where("e.is_typo and e.src.lang = 'eng' and e.tgt.lang = 'eng'")
    return e.select(F.col("e.src.text").alias("typo"), F.col("e.tgt.text").alias("correction"))


def payload_records(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(…keep, record_no, record) of the JSON records that stand in pages' payloads.

    Pushed payload strings are decoded first; arrays that don't parse are skipped.
    """
    picked = pages.select(*keep, text)
    kind = T.StructType([*[picked.schema[k] for k in keep], T.StructField("record_no", T.IntegerType()), T.StructField("record", T.StringType())])

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                found = embedded_records(payload_text(r[text])) if isinstance(r[text], str) else []
                rows += [[*[r[k] for k in keep], n, x] for n, x in enumerate(found)]
            out = pd.DataFrame(rows, columns=kind.names)
            out["record_no"] = out["record_no"].astype("int32")
            yield out

    return picked.mapInPandas(run, kind)


def with_front_matter(docs: DataFrame, text: str) -> DataFrame:
    """Adds `front`, `meta_title` and `body`: front matter between rules is taken off, its
    title leads the body as a first-level heading; without a title the body stands alone."""
    front = F.regexp_extract(text, r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    rest = F.regexp_replace(F.col(text), r"(?s)^---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", "")
    title = F.nullif(F.regexp_replace(F.regexp_extract(front, r"(?m)^title:[ \t]*(.*)$", 1), r"^(['\"])(.*)\1$", "$2"), F.lit(""))
    return docs.withColumns({"front": F.nullif(front, F.lit("")), "meta_title": title}).withColumn("body", F.when(F.col("meta_title").isNull(), rest).otherwise(F.concat(F.lit("# "), "meta_title", F.lit("\n\n"), rest)))


def page_sections(pages: DataFrame, page: str, keep: list[str]) -> DataFrame:
    """(…keep, pos, heading_key, content) of HTML pages cut at anchored headings.

    The key is `anchor#heading`; what stands before the first heading, or a page without
    any, has the empty key.
    """
    mark = r"(?s)<h[1-6][^>]*>(.*?)<span[^>]*\bid=\"([^\"]*)\"[^>]*></span>(.*?)</h[1-6]>"
    plain = lambda c: F.trim(X.collapsed(F.regexp_replace(c, r"<[^>]+>", " ")))
    parts = F.split(F.regexp_replace(F.col(page), mark, "\x01$2#$1$3\x02"), "\x01")
    rows = pages.select(*keep, F.posexplode(parts).alias("pos", "part"))
    key = F.when(F.col("pos") == 0, "").otherwise(F.concat(F.split_part("part", F.lit("#"), F.lit(1)), F.lit("#"), plain(F.regexp_extract("part", r"(?s)^[^#]*#(.*?)\x02", 1))))
    content = F.when(F.col("pos") == 0, F.col("part")).otherwise(F.regexp_extract("part", r"(?s)\x02(.*)$", 1))
    return rows.select(*keep, "pos", key.alias("heading_key"), plain(content).alias("content")).where("pos > 0 or content != ''")


def changed_files(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """Keys that both snapshots have with different contents; added and deleted ones aside."""
    digest = lambda df, name: df.select(key, F.sha2(content, 256).alias(name))
    return digest(before, "old").join(digest(after, "new"), key).where("old != new")


def canonical_json(value) -> str:
    """Sorted keys, no spare blanks, one line."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
