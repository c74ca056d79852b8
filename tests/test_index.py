import numpy as np
import pytest

from textlathe.operators import index as I
from textlathe.operators import search as S
from textlathe.sources import sinks as K

VOCAB = {"alpha": 0, "beta": 1, "page": 2, "blog": 3, "known": 4}
VECTORS = np.array([[1.0, 0.0], [0.0, 1.0], [0.2, 0.2], [0.1, 0.1], [0.5, -0.5]])


def corpus(spark, rows):
    records = spark.createDataFrame(rows, "seq bigint, route string, heading_key string, title string, fragment_text string")
    titles = spark.createDataFrame([("/blog/", "_index"), ("/blog/some-page/", "Page"), ("/x", "X")], "route string, title string")
    return records, titles


def test_index_from_gate_to_ranks(spark, tmp_path):
    path = str(tmp_path / "index")
    records, titles = corpus(spark, [(0, "/blog/some-page/", "", "Page", "alpha alpha"), (1, "/blog/some-page/", "a#Heading", "Page", "beta"), (2, "/x", "", "X", "\u2603\u2603"), (3, "/y/", "", "Y", "beta beta known")])
    queries = spark.createDataFrame([(1, "Beta"), (2, "unheard"), (3, "alpha")], "query_id bigint, query string")
    assert I.semantic_rank(spark, path, queries) is None
    meta = I.build_index(spark, records, titles, VOCAB, VECTORS, path)
    assert (meta["chunks"], meta["left_out"], meta["dims"]) == (3, 1, 2)
    chunks = {r.chunk_id: r for r in K.published(spark, path)[1]["chunks"].collect()}
    assert set(chunks) == {"/blog/some-page/||0", "/blog/some-page/|a#Heading|0", "/y/||0"}
    assert chunks["/blog/some-page/|a#Heading|0"].crumb == "blog > Page" and chunks["/blog/some-page/|a#Heading|0"].url == "/blog/some-page#a"
    ranks = I.semantic_rank(spark, path, queries)
    got = {(r.query_id, r["rank"]): r.page_id for r in ranks.collect()}
    assert got[1, 1] == "/blog/some-page" and got[3, 1] == "/blog/some-page" and not any(q == 2 for q, _ in got)
    keyword = spark.createDataFrame([(2, "/z", 1), (1, "/y", 1)], "query_id bigint, page_id string, rank int")
    assert S.hybrid(keyword, ranks).where("query_id = 2").first().page_id == "/z"


@pytest.mark.parametrize("most", [0, 1000])
def test_query_ids_hide_no_chunk(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(S, "MAX_QUERIES", most)
    path = str(tmp_path / "index")
    I.build_index(spark, *corpus(spark, [(1, "/x", "", "X", "alpha")]), VOCAB, VECTORS, path)
    ids = [1, 4096, I.SECTION]
    ranks = I.semantic_rank(spark, path, spark.createDataFrame([(n, "alpha") for n in ids], "query_id bigint, query string"))
    assert sorted((r.query_id, r.page_id) for r in ranks.collect()) == [(n, "/x") for n in ids]


def test_index_without_arrow(spark, tmp_path):
    path = str(tmp_path / "index")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        I.build_index(spark, *corpus(spark, [(1, "/x", "", "X", "alpha"), (2, "/y", "", "Y", "beta")]), VOCAB, VECTORS, path)
        ranks = I.semantic_rank(spark, path, spark.createDataFrame([(1, "alpha")], "query_id bigint, query string"), top=1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert [(r.query_id, r.page_id, r["rank"]) for r in ranks] == [(1, "/x", 1)]


def test_rejected_corpus_keeps_the_published_set(spark, tmp_path):
    path = str(tmp_path / "index")
    good = corpus(spark, [(0, "/x", "", "X", "alpha")])
    first = I.build_index(spark, *good, VOCAB, VECTORS, path)
    for rows, vectors in (([(0, "/x", "bad", "X", "")], VECTORS), ([], VECTORS), ([(0, "/x", "", "X", "alpha")], VECTORS * np.nan), ([(0, "/x", "", "X", "alpha")], VECTORS * 0), ([(0, "/x", "", "X", "nothing")], VECTORS)):
        with pytest.raises(I.Rejected):
            I.build_index(spark, *corpus(spark, rows), VOCAB, vectors, path)
    assert K.published(spark, path)[0]["version"] == first["version"]
