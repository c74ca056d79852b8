"""Sinks: published table sets, skipped stages, reports and metric files."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlathe.functions import text as X


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict) -> str:
    """Write a set of tables so that readers see all of it or the set before.

    Each set goes to a new version folder; the one-line pointer file that readers follow
    is put in place last, by a rename. A failed write leaves pointer and old set alone.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    fs, root, Path = _fs(spark, path)
    note = sized({**meta, "version": version, "tables": sorted(tables)})
    new, now = Path(f"{path}/current.{version}"), Path(f"{path}/current")
    out = fs.create(new, True)
    out.write(bytearray(note.encode()))
    out.close()
    if not fs.rename(new, now):
        fs.delete(now, False)
        if not fs.rename(new, now):
            raise OSError("the pointer couldn't be put in place")
    return version


def sized(meta: dict) -> str:
    """Metadata that states its own length: repeated until the length stands."""
    size = 0
    while True:
        text = json.dumps({**meta, "bytes": size}, sort_keys=True, separators=(",", ":")) + "\n"
        if len(text.encode()) == size:
            return text
        size = len(text.encode())


def published(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]] | None:
    """The current set's metadata and tables; None where none is published."""
    fs, _, Path = _fs(spark, path)
    if not fs.exists(Path(f"{path}/current")):
        return None
    meta = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/current").collect()))
    return meta, {t: spark.read.parquet(f"{path}/{meta['version']}/{t}") for t in meta["tables"]}


def loaded(spark: SparkSession, path: str, needs: tuple[str, ...] = ()) -> tuple[str, dict, dict[str, DataFrame]]:
    """(state, metadata, tables) of a published set: `ready`, `missing` where there is
    none, or `broken` where its pointer, a table or one of `needs` can't be read."""
    try:
        found = published(spark, path)
        if found is None:
            return "missing", {}, {}
        meta, tables = found
        if set(needs) - set(tables) or any(not df.columns for df in tables.values()):
            return "broken", meta, {}
        return "ready", meta, tables
    except (AnalysisException, Py4JJavaError, ValueError, KeyError, TypeError):
        return "broken", {}, {}


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """A stage's table: read if it was completed before, else made and written."""
    fs, _, Path = _fs(spark, path)
    if not fs.exists(Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def metric_file(df: DataFrame, path: str, name: str, value: str) -> None:
    """A CSV of (name, value) in order of the lower-case name, values with four places."""
    df.orderBy(F.lower(name), name).select(name, F.format_string("%.4f", F.col(value).cast("double")).alias(value)).write.mode("overwrite").option("header", True).csv(path)


#: The order of conditions and subsets in reports, and the lines' formats.
CONDITIONS, SUBSETS = ("keyword-only", "semantic-only", "hybrid"), ("exact-term", "paraphrase", "navigational")
RECALL_HEAD = "condition     subset       queries  recall@1  recall@3"
RECALL_LINE = "%-13s %-13s %7d %9s %9s"
COUNTS_LINE = "%s: total=%d legitimate_empty=%d suspicious_empty=%d"
RATES = " suspicious_rate=%.3f%% limit=%.3f%% legitimate_rate=%.3f%% legit_limit=%.3f%%"


def place(column: str, order: tuple[str, ...]) -> Column:
    """Where a value stands in a fixed order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)), F.lit(99))


def recall_report(recall: DataFrame) -> str:
    """A recall table (condition, subset, queries, recall_1, recall_3) as aligned lines."""
    share = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    line = F.format_string(RECALL_LINE, "condition", "subset", F.col("queries").cast("bigint"), share("recall_1"), share("recall_3"))
    rows = recall.orderBy(place("condition", CONDITIONS), "condition", place("subset", SUBSETS), "subset").select(line.alias("line")).limit(1000)
    return "\n".join([RECALL_HEAD, *(r.line for r in rows.collect())])


def gate_lines(records: DataFrame, suspicious_limit: float = 0.01, legitimate_limit: float = 0.10) -> DataFrame:
    """(part, seq, line) of a gate report, to be read in the order of part and seq: counts
    of each source, totals with rates and limits, suspicious sections, the verdict.

    The lines stay a table, as a bad corpus may have any number of suspicious sections.
    """
    told = records.select("seq", "route", "heading_key", X.emptiness("heading_key", "fragment_text").alias("kind"), X.source_of("route").alias("source"))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    n, legitimate, suspicious = F.count("*"), count("legitimate"), count("suspicious")
    share = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
    by = told.groupBy("source").agg(n.alias("n"), legitimate.alias("l"), suspicious.alias("s"))
    names = records.sparkSession.createDataFrame([("blog",), ("treadmill",)], "source string").join(by, "source", "left").na.fill(0)
    first = names.select(F.lit(0).alias("part"), place("source", ("blog", "treadmill")).cast("bigint").alias("seq"), F.format_string(COUNTS_LINE, "source", "n", "l", "s").alias("line"))
    rates = F.format_string(COUNTS_LINE + RATES, F.lit("total"), n, legitimate, suspicious, share(suspicious) * 100, F.lit(suspicious_limit * 100), share(legitimate) * 100, F.lit(legitimate_limit * 100))
    passed = (n > 0) & (share(suspicious) <= suspicious_limit) & (share(legitimate) <= legitimate_limit)
    total = told.agg(rates.alias("t"), F.when(passed, "gate: PASS").otherwise("gate: FAIL").alias("v"))
    ends = total.select(F.explode(F.array(F.struct(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.col("t").alias("line")), F.struct(F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.col("v").alias("line")))).alias("x")).select("x.*")
    bad = told.where("kind = 'suspicious'").select(F.lit(2).alias("part"), "seq", F.concat(F.lit("suspicious: "), "route", F.lit(" '"), "heading_key", F.lit("'")).alias("line"))
    return first.unionByName(ends).unionByName(bad)


def save_parameters(spark: SparkSession, path: str, name: str, parameters: dict) -> None:
    """A fitted model as one row of JSON: its name, inputs, coefficients and metrics."""
    text = json.dumps(parameters, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    spark.createDataFrame([(name, text)], "name string, parameters string").write.mode("overwrite").parquet(f"{path}/{name}")


def load_parameters(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/{name}").first().parameters)
