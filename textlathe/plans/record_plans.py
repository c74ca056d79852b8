"""Queries over harvested model records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlathe.functions.release_sql import CLAIMS
from textlathe.operators import records
from textlathe.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return records.group_fills(records.fill_releases(table(spark, sf, "param_estimation")))


def p2_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its three fields filled and each filled value marked."""
    filled = records.fill_releases(table(spark, sf, "param_estimation"))
    return filled.select("record_id", *[x for c in records.FIELDS for x in (F.col(c), F.col(f"{c}_fill"), F.round(f"{c}_confidence", 4).alias(f"{c}_confidence"))])


QUERIES = {"p2_found": p2_found, "p2_filled": p2_filled}
ORACLES = {
    "p2_found": f"""WITH {CLAIMS},
  usable AS (SELECT release, field, count(value) AS n FROM claims WHERE release IS NOT NULL GROUP BY release, field)
SELECT record_id, field FROM claims JOIN usable USING (release, field) WHERE value IS NULL AND n > 0""",
}
