"""Schemas of JSON records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlathe.functions.udfs import key_kinds

PLACES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())]))


def key_tree(records: DataFrame, text: str) -> DataFrame:
    """(path, kind, n) of all places in JSON records.

    A place that is nested anywhere is nested, one that is always of the same kind has
    that kind, any other is `mixed`; so a null beside a number is mixed too. Texts that
    aren't JSON and nulls add nothing. Places are counted before the shuffle.
    """

    @F.pandas_udf(PLACES)
    def places(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                found = key_kinds(json.loads(t)) if t is not None else []
            except ValueError:
                found = []
            out.append([{"path": p, "kind": k} for p, k in found])
        return pd.Series(out, dtype=object)

    counted = records.select(F.explode(places(text)).alias("x")).groupBy("x.path", "x.kind").agg(F.count("*").alias("n"))
    told = counted.groupBy("path").agg(F.collect_set("kind").alias("kinds"), F.sum("n").alias("n"))
    kind = F.when(F.array_contains("kinds", "nested"), "nested").when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed")
    return told.select("path", kind.alias("kind"), "n")
