"""The queries of this subpackage: name -> function of (spark, data folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlathe.llm import bpe, fuse, langid, leaks, pairs, pii, split
from textlathe.llm.sql import ORACLES
from textlathe.runtime import table


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every line with its language and confidence."""
    lines = table(spark, sf, "benchmark_df")
    out = langid.segment_lines(lines, langid.fit_lines(lines, table(spark, sf, "lang_code")))
    return out.select("row_id", "seg_no", "n_segments", "lang", F.round("confidence", 4).alias("confidence"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    lines, codes = table(spark, sf, "benchmark_df"), table(spark, sf, "lang_code")
    return langid.label_cases(lines, codes, langid.fit_lines(lines, codes))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every oversized field."""
    return split.split_oversized(split.oversized_fields(table(spark, sf, "chunk"), table(spark, sf, "search_record")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).where("piece_no = 1").select("item_table", "item_key", "field", "unbroken")


def p4_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Surviving records with their values and what the discounted votes favour."""
    return fuse.fuse_releases(table(spark, sf, "param_estimation"), table(spark, sf, "metric_source"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return fuse.survivors(table(spark, sf, "param_estimation"), table(spark, sf, "metric_source")).select("group_id", "field", "record_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.flag_pairs(table(spark, sf, "rag_response_df"), table(spark, sf, "benchmark_df"), table(spark, sf, "lang_code"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents"))


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts encoded and decoded again; equal to the texts, null ones empty."""
    return bpe.decode_corpus(p6_ids(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"), paraphrases=False).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the kind of leak, paraphrases among them."""
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_pii(table(spark, sf, "documents"), pii.fit_models(table(spark, sf, "name_list")))


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders in the place of personal information."""
    return pii.find_pii(table(spark, sf, "documents"), pii.fit_models(table(spark, sf, "name_list")), redact=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p3_found, p3_pieces, p4_found, p4_fused, p5_found, p6_ids, p6_decoded, p7_found, p7_leaks, p8_found, p8_redacted)}
__all__ = ["ORACLES", "QUERIES"]
