import pytest
from pyspark.sql import functions as F

from textlathe.operators import plugins as P
from textlathe.operators import search as S


def test_specs_and_paths(spark):
    specs = P.metric_specs(["a=x.y", "b = z"])
    df = spark.createDataFrame([('{"x": {"y": 1.5}, "z": true}',), ('{"x": 3, "z": "4"}',), ("oops",), (None,)], "j string").select(F.try_parse_json("j").alias("v"))
    assert [tuple(r) for r in df.select(*P.metric_columns("v", specs)).collect()] == [(1.5, None), (None, None), (None, None), (None, None)]
    for bad in (["a"], ["=x"], ["a=x", "a=y"]):
        with pytest.raises(ValueError):
            P.metric_specs(bad)


def test_plugins(spark):
    df = spark.createDataFrame([("one two",), (None,), ("",)], "t string")
    out = P.extracted(df, "t", {"words": str.split}).collect()
    assert [r.words for r in out] == [["one", "two"], None, []]
    assert P.columns_like(df.withColumn("tx", F.lit(1)), "x").columns == ["tx"]
    with pytest.raises(ValueError, match="missing columns: a, b"):
        P.required(df, ["t", "b", "a"])
    assert P.broken_label("aa.bb.cc", 6) == ["aa.bb.", "cc"]
    assert P.timed(len)("abc") == 3


def test_tokenizer_settings():
    base = {"normalizer": {"type": "BertNormalizer", "lowercase": True, "strip_accents": None}, "pre_tokenizer": {"type": "BertPreTokenizer"}, "model": {"vocab": {"a": 0}}}
    assert P.tokenizer_settings(base)["strip_accents"] is True
    with pytest.raises(ValueError):
        P.tokenizer_settings({**base, "normalizer": None})


def test_fallback(spark):
    k = spark.createDataFrame([(1, f"p{n}", n) for n in range(1, 13)] + [(2, "a", 1)], "query_id bigint, page_id string, rank int")
    assert S.hybrid(k, None).count() == 13
    s = spark.createDataFrame([(2, "b", 1)], "query_id bigint, page_id string, rank int")
    got = S.hybrid(k, s)
    assert got.where("query_id = 1").count() == 12
    assert [r.page_id for r in got.where("query_id = 2").orderBy("rank").collect()] == ["b", "a"]


def test_pooled_vectors(spark):
    tokens = spark.createDataFrame([("q", 0), ("q", 1), ("r", 9), ("z", 2)], "k string, token_id int")
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "token_id int, vector array<double>")
    got = {r.k: r.vector for r in S.pooled_vectors(tokens, table, "k").collect()}
    assert list(got) == ["q"] and got["q"] == pytest.approx([0.5**0.5, 0.5**0.5])
