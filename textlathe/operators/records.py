"""Harvested model records: release keys, usable values and filled fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlathe.functions.releases import clean_name, positive, release_key, share, stated_count
from textlathe.operators.impute import fill_missing

#: The fields whose values are stated, with how a usable value is read.
FIELDS = {"totalParams": stated_count, "mmlu_pro": share, "intelligenceIndex": positive}


def with_releases(records: DataFrame) -> DataFrame:
    """record_id, release, usable values of `FIELDS` (null where there is none), creator,
    source, size, variant and the quarter of capture as categories."""
    key = release_key(F.col("model"), F.col("creator"))
    part = F.split(key, r"\|")
    return records.select(
        "record_id",
        key.alias("release"),
        *[read(F.col(c)).alias(c) for c, read in FIELDS.items()],
        F.nullif(clean_name(F.col("creator")), F.lit("")).alias("maker"),
        F.nullif(F.lower(F.trim("source")), F.lit("")).alias("origin"),
        F.try_element_at(part, F.lit(3)).alias("size"),
        F.try_element_at(part, F.lit(4)).alias("variant"),
        F.date_format(F.date_trunc("quarter", "captured_at"), "yyyy-MM").alias("quarter"),
    )


def fill_releases(records: DataFrame) -> DataFrame:
    """`param_estimation` with every gap of `FIELDS` filled and marked; see `fill_missing`.

    The tree joins the three fields, maker, size, variant and quarter of capture, so that
    a release without a value of its own takes one from similar records of a close time.
    """
    return fill_missing(with_releases(records), "record_id", "release", list(FIELDS), ["maker", "size", "variant", "quarter"])


def group_fills(filled: DataFrame) -> DataFrame:
    """(record_id, field) of each field filled with evidence from its own release."""
    marks = [F.struct(F.lit(c).alias("field"), F.col(f"{c}_fill").alias("fill")) for c in FIELDS]
    return filled.select("record_id", F.explode(F.array(*marks)).alias("x")).where("x.fill = 'group'").select("record_id", "x.field")
