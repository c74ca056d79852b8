import json

import pytest

from textlathe.sources import readers as S
from textlathe.sources import sinks as K
from textlathe.streaming import events as V

GOOD = {"/river/otter/": {"title": "Otters", "data": {"": "They swim.", "food#What they eat": "Fish", "dens#Dens": ""}}, "/bare": {"title": "Bare", "data": {}}}
BAD = [
    "{not json", "[]", json.dumps({"blog": {"title": "a", "data": {}}}), json.dumps({"/a": 5}), json.dumps({"/a": {"title": "a", "data": {}, "more": 1}}),
    json.dumps({"/a": {"title": "a"}}), json.dumps({"/a": {"title": 5, "data": {}}}), json.dumps({"/a": {"title": "a", "data": {"x": 5}}}), json.dumps({"/a": {"title": "a", "data": []}}),
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_corpus(spark, tmp_path):
    records, titles = S.corpus(spark, write(tmp_path / "c.json", json.dumps(GOOD)))
    got = [tuple(r)[1:] for r in records.orderBy("seq").collect()]
    assert got == [("/river/otter/", "", "Otters", "They swim."), ("/river/otter/", "food#What they eat", "Otters", "Fish"), ("/river/otter/", "dens#Dens", "Otters", "")]
    assert titles.count() == 2


@pytest.mark.parametrize("text", BAD)
def test_malformed_corpus(spark, tmp_path, text):
    with pytest.raises(S.CorpusError):
        S.corpus(spark, write(tmp_path / "c.json", text))


def test_places_of_several_files(spark, tmp_path):
    for n in range(3):
        write(tmp_path / f"c{n}.json", json.dumps({f"/p{n}/{k}": {"title": "T", "data": {f"h{x}#H": "t" for x in range(4)}} for k in range(3)}))
    records, _ = S.corpus(spark, str(tmp_path))
    rows = records.collect()
    assert len({r.seq for r in rows}) == len(rows) == 36
    for n in range(3):
        own = [(r.route, r.heading_key) for r in sorted(rows, key=lambda r: r.seq) if r.route.startswith(f"/p{n}/")]
        assert own == [(f"/p{n}/{k}", f"h{x}#H") for k in range(3) for x in range(4)]


def test_labels(spark, tmp_path):
    row = {"query": "q", "subset": "paraphrase", "expected_page_id": "/a", "expected_section_url": None, "rationale": "r", "source_text": "s"}
    assert S.labels(spark, write(tmp_path / "l.json", json.dumps([row]))).first().expected_section_url is None
    for bad in ([row, row], [{**row, "subset": "other"}], [{k: v for k, v in row.items() if k != "query"}], []):
        with pytest.raises(S.CorpusError):
            S.labels(spark, write(tmp_path / "b.json", json.dumps(bad)))


def test_small_files(spark, tmp_path):
    words = S.misspellings(spark, write(tmp_path / "d.txt", "$otter\noter\nottre 2\n$other\noter\n"))
    assert {tuple(r) for r in words.collect()} == {("ottre", "otter"), ("oter", "other")}
    assert [tuple(r) for r in S.word_pairs(spark, write(tmp_path / "p.txt", "teh the\n\nodd\n")).collect()] == [("teh", "the")]
    assert {tuple(r) for r in S.flat_map(spark, write(tmp_path / "y.yaml", "# c\nteh: 'the'\nadn: and\n")).collect()} == {("teh", "the"), ("adn", "and")}
    edit = {"edits": [{"src": {"text": "teh", "lang": "eng"}, "tgt": {"text": "the", "lang": "eng"}, "is_typo": True}, {"src": {"text": "x", "lang": "fra"}, "tgt": {"text": "y", "lang": "eng"}, "is_typo": True}]}
    assert [tuple(r) for r in S.commit_edits(spark, write(tmp_path / "e.jsonl", json.dumps(edit))).collect()] == [("teh", "the")]
    assert S.delimited(spark, write(tmp_path / "t.csv", "﻿a;b\n1;x\n"), "a int, b string", ";").first().b == "x"
    lines = S.labelled_lines(spark, write(tmp_path / "de.txt", "eins\nzwei\n"), 1)
    assert [tuple(r) for r in lines.collect()] == [("de", 0, "eins")]


def test_pages_and_front_matter(spark):
    page = '<p>Intro</p><h2>First<span id="one"></span></h2><p>Body <b>x</b></p><h2>Second<span id="two"></span></h2>'
    df = spark.createDataFrame([(1, page), (2, "<p>only</p>")], "id int, html string")
    got = [tuple(r) for r in S.page_sections(df, "html", ["id"]).orderBy("id", "pos").collect()]
    assert got == [(1, 0, "", "Intro"), (1, 1, "one#First", "Body x"), (1, 2, "two#Second", ""), (2, 0, "", "only")]
    md = spark.createDataFrame([("---\ntitle: 'T'\n---\nbody",), ("---\nx: 1\n---\nbody",), ("none",)], "t string")
    assert [r.body for r in S.with_front_matter(md, "t").collect()] == ["# T\n\nbody", "body", "none"]


def test_payload_reader(spark):
    df = spark.createDataFrame([(1, '"models": [{"a": 1}]'), (2, None), (3, "")], "id int, t string")
    assert [tuple(r) for r in S.payload_records(df, "t", ["id"]).collect()] == [(1, 0, '{"a": 1}')]


def test_publish_keeps_old_set_on_failure(spark, tmp_path):
    path = str(tmp_path / "set")
    assert K.published(spark, path) is None
    first = K.publish(spark, path, {"t": spark.range(3)}, {"dims": 2})
    broken = spark.range(3).selectExpr("raise_error('no') as x")
    with pytest.raises(Exception):
        K.publish(spark, path, {"t": broken}, {})
    meta, tables = K.published(spark, path)
    assert meta["version"] == first and tables["t"].count() == 3
    second = K.publish(spark, path, {"t": spark.range(5)}, {"dims": 2})
    meta, tables = K.published(spark, path)
    assert meta["version"] == second and tables["t"].count() == 5
    assert len(K.sized({"a": 1}).encode()) == json.loads(K.sized({"a": 1}))["bytes"]


def test_states_of_a_set(spark, tmp_path):
    path = str(tmp_path / "set")
    assert K.loaded(spark, path)[0] == "missing"
    version = K.publish(spark, path, {"t": spark.range(3)}, {"dims": 2})
    assert K.loaded(spark, path, ("t",))[0] == "ready" and K.loaded(spark, path, ("t", "u"))[0] == "broken"
    for f in (tmp_path / "set" / version / "t").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    assert K.loaded(spark, path)[0] == "broken"
    (tmp_path / "set" / "current").write_text("{cut")
    for f in (tmp_path / "set").glob(".*.crc"):
        f.unlink()
    assert K.loaded(spark, path)[0] == "broken"


def test_once_and_report(spark, tmp_path):
    made = []
    for _ in range(2):
        K.once(spark, str(tmp_path / "stage"), lambda: made.append(1) or spark.range(2))
    assert len(made) == 1
    rows = [(c, s, 1, a, b) for c, *v in (("hybrid", (1.0, 1.0), (0.0, 1.0), (0.0, 1.0)), ("keyword-only", (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))) for s, (a, b) in zip(("exact-term", "paraphrase", "navigational"), v)]
    r = spark.createDataFrame(rows, "condition string, subset string, queries int, recall_1 double, recall_3 double")
    assert K.recall_report(r) == (
        "condition     subset       queries  recall@1  recall@3\n"
        "keyword-only  exact-term          1    100.0%    100.0%\n"
        "keyword-only  paraphrase          1      0.0%    100.0%\n"
        "keyword-only  navigational        1      0.0%      0.0%\n"
        "hybrid        exact-term          1    100.0%    100.0%\n"
        "hybrid        paraphrase          1      0.0%    100.0%\n"
        "hybrid        navigational        1      0.0%    100.0%"
    )


def test_gate_report(spark):
    rows = [(0, "/blog/otter/", "", "Otters swim."), (1, "/blog/otter/", "food#What they eat", "Fish."), (2, "/blog/otter/", "heading-2#Dens", "Holes."), (3, "/blog/otter/", "heading-3#Young", ""), (4, "/treadmill/mole/", "", ""), (5, "/treadmill/mole/", "tunnels#Their tunnels", "")]
    df = spark.createDataFrame(rows, "seq bigint, route string, heading_key string, fragment_text string")
    lines = lambda *limits: [r.line for r in K.gate_lines(df, *limits).orderBy("part", "seq").collect()]
    assert lines() == [
        "blog: total=4 legitimate_empty=1 suspicious_empty=0",
        "treadmill: total=2 legitimate_empty=1 suspicious_empty=1",
        "total: total=6 legitimate_empty=2 suspicious_empty=1 suspicious_rate=16.667% limit=1.000% legitimate_rate=33.333% legit_limit=10.000%",
        "suspicious: /treadmill/mole/ 'tunnels#Their tunnels'",
        "gate: FAIL",
    ]
    assert lines(0.5, 0.5)[-1] == "gate: PASS" and lines(0.1, 0.5)[-1] == "gate: FAIL"
    assert [r.line for r in K.gate_lines(df.limit(0)).where("part = 3").collect()] == ["gate: FAIL"]


def test_parameters_and_metric_file(spark, tmp_path):
    K.save_parameters(spark, str(tmp_path), "glm", {"intercept": 1.5, "slopes": [0, 2]})
    assert K.load_parameters(spark, str(tmp_path), "glm") == {"intercept": 1.5, "slopes": [0, 2]}
    K.metric_file(spark.createDataFrame([("b", 2.0), ("A", 1.23456)], "model string, tau double").coalesce(1), str(tmp_path / "m"), "model", "tau")
    lines = [x for f in (tmp_path / "m").glob("part-*") for x in f.read_text().split()]
    assert lines == ["model,tau", "A,1.2346", "b,2.0000"]


def test_streams_equal_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    folder = tmp_path / "in"
    spark.read.parquet(src).orderBy("ts").repartition(3).write.parquet(str(folder))
    stream = V.event_stream(spark, str(folder))
    got = V.drain(V.tumbling(stream), "hours", str(tmp_path), "complete")
    want = V.tumbling(spark.read.parquet(src).withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp")))
    assert got.agg({"n": "sum"}).first()[0] == 1000 and got.count() == want.count()
    assert V.drain(V.deduplicated(V.event_stream(spark, str(folder), "100 days")), "once", str(tmp_path)).count() == 1000
