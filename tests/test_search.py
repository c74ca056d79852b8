import pytest
from pyspark.sql import functions as F

from textlathe.functions import text as X
from textlathe.operators import search as S


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, page_id string, rank int")


def order(df):
    return [r.page_id for r in df.orderBy("rank").collect()]


def test_page_in_both_lists_comes_first(spark):
    out = S.fuse(ranks(spark, [(1, "a", 1), (1, "b", 2)]), ranks(spark, [(1, "b", 1)]))
    assert order(out)[0] == "b"


def test_semantic_weighs_twice_on_a_tie(spark):
    out = S.fuse(ranks(spark, [(1, "k", 1)]), ranks(spark, [(1, "s", 1)])).orderBy("rank").collect()
    assert [r.page_id for r in out] == ["s", "k"]
    assert out[0].score == pytest.approx(2 / 61) and out[1].score == pytest.approx(1 / 61)


def test_tails_beyond_ten_are_dropped(spark):
    k = [(1, f"k{n}", n) for n in range(1, 12)]
    s = [(1, f"s{n}", n) for n in range(1, 12)]
    out = order(S.fuse(ranks(spark, k), ranks(spark, s)))
    assert len(out) == 20 and "k11" not in out and "s11" not in out


def test_empty_semantic_side_keeps_keyword_order(spark):
    assert order(S.fuse(ranks(spark, [(1, "a", 1), (1, "b", 2)]), ranks(spark, []))) == ["a", "b"]


def test_rollup_keeps_earliest_of_equals(spark):
    s = spark.createDataFrame([(1, 5, "p", 0.5), (1, 3, "p", 0.5), (1, 9, "q", 0.7)], "query_id bigint, seq bigint, page_id string, score double")
    got = {(r.page_id, r.seq, r.score) for r in S.rollup(s).collect()}
    assert got == {("p", 3, 0.5), ("q", 9, 0.7)}


def test_lexical_rank_and_absent_terms(spark):
    view = spark.createDataFrame([(0, "/first", "shared shared"), (1, "/second", "shared")], "seq bigint, page_id string, text string")
    q = spark.createDataFrame([(1, "shared"), (2, "absent")], "query_id bigint, query string")
    got = S.lexical_rank(view, q).collect()
    assert [r.page_id for r in sorted(got, key=lambda r: r["rank"])] == ["/first", "/second"]
    assert {r.query_id for r in got} == {1}


def test_recall_has_subsets_without_hits(spark):
    labels = spark.createDataFrame([(1, "exact", "/a"), (2, "none", "/b")], "query_id bigint, subset string, expected_page_id string")
    got = {r.subset: (r.recall_1, r.recall_3) for r in S.recall(ranks(spark, [(1, "/a", 2)]), labels).collect()}
    assert got == {"exact": (0.0, 1.0), "none": (0.0, 0.0)}


@pytest.mark.parametrize("route, want", [("/", "/"), ("///", "/"), ("/blog/post//", "/blog/post"), ("/blog", "/blog")])
def test_canonical_route(spark, route, want):
    df = spark.createDataFrame([(route,)], "r string")
    assert df.select(X.canonical_route("r")).first()[0] == want


def test_sections_and_gate(spark):
    rows = [("", "T", "x"), ("plain", "T", ""), ("heading-3#Title only", "T", ""), ("named#a#b", "T", "\t\xa0\n"), ("#h", "T", None)]
    df = spark.createDataFrame(rows, "k string, t string, x string")
    got = df.select(X.anchor_of("k").alias("a"), X.heading_of("k", "t").alias("h"), X.emptiness("k", "x").alias("e")).collect()
    assert [tuple(r) for r in got] == [("", "T", "non-empty"), ("plain", "T", "suspicious"), ("heading-3", "Title only", "legitimate"), ("named", "a#b", "suspicious"), ("", "h", "legitimate")]


def test_breadcrumb(spark):
    titles = spark.createDataFrame([("/blog", "Blog"), ("/blog/example", "Example"), ("/x/y", "Y")], "route string, title string")
    got = {r.route: r.crumb for r in S.breadcrumbs(titles).collect()}
    assert got == {"/blog": "Blog", "/blog/example": "Blog > Example", "/x/y": "Y"}


def test_vector_blocks_equal_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(n, f"p{n % 7}", rng.standard_normal(8).tolist()) for n in range(60)] + [(60, "p0", [0.0] * 8), (61, "p1", [1.0] * 8), (62, "p1", [1.0] * 8), (63, "p2", [1.0] * 8)]
    v = spark.createDataFrame(rows, "seq bigint, page_id string, vector array<double>").repartition(3)
    asked = [(n, rows[n][2]) for n in (0, 20, 40, 61)]
    q = spark.createDataFrame(asked, "query_id bigint, query_vector array<double>").repartition(2)
    scores = {i: sorted(((-round(float(np.dot(x, w)), 9), n, p) for n, p, w in rows if n != i)) for i, x in asked}
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    pages = {i: {} for i in scores}
    for i, found in scores.items():
        for s, n, p in found:
            pages[i].setdefault(p, (n, s))
    want = {
        "top": sorted((i, n, k) for i, found in scores.items() for k, (_, n, _) in enumerate(found[:5], 1)),
        "pages": sorted((i, p, n) for i, ps in pages.items() for p, (n, _) in ps.items()),
        "pairs": sorted((i, n) for i, x in asked for n, _, w in rows if n != i and np.any(w) and np.dot(unit(x), unit(w)) >= 0.2),
        "best pages": sorted((i, p) for i, ps in pages.items() for p, _ in sorted(ps.items(), key=lambda x: (x[1][1], x[1][0]))[:3]),
        "none": [],
    }
    plain = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    for queries, most in ((1000, 4_000_000), (1000, 12), (1, 40), (0, 1)):  # one block, small ones, and products of blocks
        monkeypatch.setattr(S, "MAX_QUERIES", queries)
        monkeypatch.setattr(S, "MAX_SCORES", most)
        best = S.ranked(S.vector_pages(v, q, top=3), [F.desc("score"), F.asc("seq")], top=3)
        assert want == {
            "top": plain(S.vector_topk(v, q, 5), "query_id", "seq", "rank"),
            "pages": plain(S.vector_pages(v, q), "query_id", "page_id", "seq"),
            "pairs": plain(S.vector_pairs(v, q, 0.2), "query_id", "seq"),
            "best pages": plain(best, "query_id", "page_id"),
            "none": plain(S.vector_topk(v.limit(0), q, 5), "query_id") + plain(S.vector_topk(v, q.limit(0), 5), "query_id"),
        }
