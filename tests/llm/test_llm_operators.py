import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlathe.llm import bpe, fuse, langid, leaks, pairs, pii, pii_lines, queries, refusals, split
from textlathe.llm.batches import parts
from textlathe.llm.boosting import BoostedTrees
from textlathe.llm.pii_lines import write_lines
from textlathe.runtime import table

SF = "/root/testdata/sf0.001"


def test_parts_cover_all():
    texts = ["a" * 5, None, "b" * 50, "", "c" * 5, "d" * 5]
    assert [texts[p] for p in parts(texts, 2, 10)] == [["a" * 5, None], ["b" * 50], ["", "c" * 5], ["d" * 5]]
    assert list(parts([], 2)) == []


# ---- splitting


def pieces_ok(text, limit, overlap):
    parts = split.cut(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b, _), nxt in zip(parts, [*parts[1:], None]):
        assert 0 < b - a <= limit
        if nxt:
            assert nxt[0] == b - overlap and nxt[1] > b
    return parts


@pytest.mark.parametrize("seed", range(30))
def test_cut_invariants(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "Sentence. ", "\n\n", "x" * r.randint(1, 90), "标题。", "a, ", "\r\n"]) for _ in range(r.randint(5, 200)))
    if len(text) > 120:
        pieces_ok(text, 120, 10)


def test_cut_prefers_natural_boundaries():
    text = ("One sentence of some words. " * 4 + "\n\n") * 3
    assert {k for *_, k in pieces_ok(text, 150, 10)} <= {"paragraph", "sentence", "end"}
    assert {k for *_, k in pieces_ok("x" * 500, 120, 10)} == {"inside", "end"}


def cost_of(ends, text, limit, overlap, pos, pen):
    share = (len(text) - overlap) / -(-(len(text) - overlap) // (limit - overlap))
    price = dict(zip(pos.tolist(), pen.tolist())) | {len(text): 0.0}
    return sum(price[e] for e in ends) + sum(4 * (((e - overlap) if k == 0 else e - ends[k - 1]) / share - 1) ** 2 for k, e in enumerate(ends))


def test_cut_cost_is_least():
    """The programme's path against all paths over all natural boundaries."""
    r = random.Random(1)
    parts = ["word ", "Sentence here. ", "\n\n", "标题。", "a, ", "\r\n", "some longer stretch of words, "]
    for k in range(60):
        limit, overlap = ((300, 30), (120, 10), (40, 4))[k % 3]
        text = "".join(r.choice([*parts, "x" * r.randint(1, 90)]) for _ in range(r.randint(30, 200)))
        pos, pen, _ = split.boundaries(text, limit - overlap - split.HARD_STEP)
        n, room = len(text), limit - overlap
        share = (n - overlap) / -(-(n - overlap) // room)
        nodes, price = [0, *pos.tolist(), n], [0.0, *pen.tolist(), 0.0]
        best = [0.0] + [np.inf] * (len(nodes) - 1)
        for i in range(1, len(nodes)):
            for j in range(i):
                gain = nodes[i] - (nodes[j] if j else overlap)
                if gain <= room and (j or gain > 0):
                    best[i] = min(best[i], best[j] + price[i] + 4 * ((gain - share) / share) ** 2)
        ends = [b for _, b, _ in split.cut(text, limit, overlap)]
        assert cost_of(ends, text, limit, overlap, pos, pen) == pytest.approx(best[-1])


def items(spark, rows):
    return spark.createDataFrame(rows, "item_table string, item_key string, field string, text string, size_limit int, overlap int, piece string")


def test_split_cases(spark):
    long = "word " * 60
    rows = [("t", "1", "f", None, 100, 10, "x"), ("t", "2", "f", "", 100, 10, "x"), ("t", "3", "f", "x" * 100, 100, 10, "x"), ("t", "4", "f", long, 100, 10, "x"), ("t", "4", "f", long, 100, 10, "x"), ("t", "5", "f", "x" * 101, 100, 10, "x"), ("t", "6", "f", "y" * 60 + " " + "y" * 60, 100, 10, "x")]
    got = split.split_oversized(items(spark, rows)).where("piece_no = 1").collect()
    assert sorted((r.item_key, r.unbroken) for r in got) == [("4", 0), ("4", 0), ("5", 1), ("6", 0)]
    assert split.split_oversized(items(spark, [])).count() == 0


# ---- fusion


def harvest(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, model string, creator string, totalParams string, mmlu_pro double, intelligenceIndex double, source string, captured_at timestamp_ntz, rank string")


def test_fuse_rule_and_edges(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2025, 1, n)
    sources = spark.createDataFrame([("card", 1), ("site", 2), ("paper", 1)], "source string, trust_rank int")
    rows = [
        (1, "A 1 7B", None, "7B", 0.5, None, "SITE ", day(3), "z"), (2, "a-1-7b", None, "8B", None, None, " card", None, "z"), (3, "A 1 7B (high)", None, "9B", 0.6, None, "paper", day(1), "z"),
        (4, "A 1 7B", None, "9B", 0.6, None, "paper", day(1), "z"), (5, "A 1 7B", None, None, -1.0, float("nan"), None, day(9), "z"), (6, "B 1 7B", None, "7B", None, None, "card", day(1), "z"), (7, None, None, "7B", 0.1, None, "card", None, "z"),
        (8, "C 1 7B", None, "?", None, 12.0, None, None, "z"), (9, "C 1 7B", None, None, None, 13.0, "unknown", None, "z"),
    ]
    got = {(r.group_id, r.field): r.record_id for r in fuse.fuse_releases(harvest(spark, rows), sources).collect()}
    assert got == {(1, "totalParams"): 4, (1, "mmlu_pro"): 4, (8, "intelligenceIndex"): 9}
    assert fuse.fuse_releases(harvest(spark, []), sources).count() == 0


def test_fuse_hot_release(spark):
    sources = spark.createDataFrame([("card", 1), ("site", 2)], "source string, trust_rank int")
    rows = [(n, "Hot 1 7B", None, f"{7 + n % 3}B", 0.5, None, "site" if n else "card", None, "z") for n in range(600)] + [(1000 + n, f"Cc {n // 2} 3B", None, "3B", None, None, "site", None, "z") for n in range(100)]
    got = fuse.fuse_releases(harvest(spark, rows), sources)
    assert got.count() == 52 and got.where("group_id = 0 and field = 'totalParams'").first().record_id == 0


def test_copied_votes_are_discounted():
    accuracy = np.full(4, 0.8)
    free, copied = np.ones((4, 4)), np.ones((4, 4))
    copied[:3, :3] = 0.05
    np.fill_diagonal(copied, 1)
    voters = [[0, 1, 2], [3]]
    assert fuse.posterior(fuse.votes(voters, accuracy, free))[0] > 0.99
    assert fuse.posterior(fuse.votes(voters, accuracy, copied))[0] < 0.65
    assert fuse.parsed("0,2#1|3#0|#2") == ([[0, 2], [3], []], [1, 0, 2])


def test_planted_copiers_lose(spark):
    """Two sources copy a third one's errors. Where five honest ones contradict them it is
    seen; then they no longer outvote two honest ones, which plain votes would let them."""
    r = random.Random(12)
    rows, truth = [], {}
    for k in range(360):
        true, wrong = 10 + k % 40, k % 2 == 0 or k >= 300
        honest = 5 if k < 300 else 2
        told = {f"honest {x}": true if r.random() < 0.95 else r.randint(100, 200) for x in range(honest)}
        told |= dict.fromkeys(("copied", "copier a", "copier b"), r.randint(60, 90) if wrong else true)
        truth[len(rows) + 1] = (k, true)
        rows += [(len(rows) + 1 + x, f"M {k} 1B", None, None, None, float(v), s, None, "z") for x, (s, v) in enumerate(told.items())]
    sources = spark.createDataFrame([("copied", 1)], "source string, trust_rank int")
    by_id, late = {r[0]: r[5] for r in rows}, {}
    for prior in ("votes", "trust"):
        got = fuse.fuse_releases(harvest(spark, rows), sources, prior).collect()
        assert len(got) == 360 and all(by_id[g.record_id] == g.value for g in got)  # the record survives that has the value
        late[prior] = sum(g.value == truth[g.group_id][1] for g in got if truth[g.group_id][0] >= 300)
    assert late["votes"] >= 50 and late["trust"] == 0


def test_further_sources_vote_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(fuse, "MAX_SOURCES", 1)
    rows = [(n, "A 1 7B", None, None, None, 5.0 if n < 3 else 9.0, s, None, "z") for n, s in enumerate(["common", "x", "y", "u", "v", "w", "t"])]
    rows += [(100 + n, f"B {n} 7B", None, None, None, 5.0, "common", None, "z") for n in range(5)]
    got = fuse.fuse_releases(harvest(spark, rows), spark.createDataFrame([], "source string, trust_rank int"), "votes").collect()
    assert [g.value for g in got] == [9.0]


def test_survivors_need_no_votes(spark, monkeypatch):
    """What no vote can change runs no vote; where votes are told, the learnt sources count."""
    tables = [table(spark, SF, t) for t in ("param_estimation", "metric_source")]
    rows = {(r.group_id, r.field): (r.record_id, r.value, r.posterior) for r in fuse.fuse_releases(*tables).collect()}
    told = lambda n: (np.full(n, 0.5), np.ones((n, n)))
    monkeypatch.setattr(fuse, "learn_sources", lambda fields, n: told(n))
    other = {(r.group_id, r.field): (r.record_id, r.value, r.posterior) for r in fuse.fuse_releases(*tables).collect()}
    assert any(rows[k][2] != other[k][2] for k in rows) and {k: v[:2] for k, v in rows.items()} == {k: v[:2] for k, v in other.items()}

    def fail(*_):
        raise AssertionError("a fit whose result no row shows")

    monkeypatch.setattr(fuse, "learn_sources", fail)
    assert {(r.group_id, r.field): (r.record_id, r.value) for r in fuse.survivors(*tables).collect()} == {k: v[:2] for k, v in rows.items()}
    assert {(r.group_id, r.field): r.record_id for r in queries.p4_found(spark, SF).collect()} == {k: v[0] for k, v in rows.items()}


# ---- pairs


@pytest.fixture(scope="module")
def pair_parts(spark):
    lines, codes, rows = (table(spark, SF, n) for n in ("benchmark_df", "lang_code", "rag_response_df"))
    big = table(spark, "/root/testdata/sf0.01", "rag_response_df")
    return pairs.fit_languages(table(spark, "/root/testdata/sf0.01", "benchmark_df"), codes, big), pairs.end_table(big)


Q = "What does the typo healer do when the tokenizer changes?"
CASES = [
    (Q, None, "empty"), (Q, " \n​", "empty"), (Q, "N/A", "empty"), (Q, "**Answer:**", "empty"), (Q, "<p></p>", "empty"), (Q, "[no answer]", "empty"), (Q, "```\n```", "empty"),
    (Q, Q, "copied_question"), (Q, f"> {Q.lower()}", "copied_question"), (Q, f"{Q}\n{Q}", "copied_question"), (Q, f"Question: {Q}", "copied_question"), (Q, "What does the healer do when the tokenizer changes?", "copied_question"),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "Das kann ich leider nicht beantworten.", "refusal"), (Q, "Hmm. I must pass on this one. Let me know if you need something else.", "refusal"), (Q, "El contexto no permite dar una respuesta.", "refusal"),
    (Q, "Die Reihenfolge ändert sich dabei nicht. Es bleiben die besten 153 Abschnitte erhalten.", "other_language"),
    (Q, "In the test with 51 pages the order did not change. The default threshold of 40 is appl", "truncated"), (Q, "- Most of the time is spent in the second pass\n- ", "truncated"), (Q, "It keeps 5.\n\n```python\nfor i in range(81):", "truncated"), (Q, "It keeps the top 83 passages and drops the rest.\n\n| k | ms |\n|---|---|\n| 1 |", "truncated"),
    (Q, "Yes.", None), (Q, "98", None), (Q, "Never", None), (Q, "In the test with 51 pages the order did not change", None), (Q, f"{Q} In the test with 51 pages the order did not change.", None),
    (Q, "I can't give an exact figure, but the notes are clear on the rest. It keeps the top 83 passages and drops the rest.", None), (Q, 'The log shows the line "I cannot help with that" once. Most of the time is spent in the second pass.', None),
    (Q + " Reply in German.", "Die Reihenfolge ändert sich dabei nicht.", None), (None, "In the test with 51 pages the order did not change.", None),
]


@pytest.mark.parametrize("q, r, want", CASES)
def test_defects(pair_parts, q, r, want):
    assert pairs.defect_of(q, r, *pair_parts) == want


@pytest.mark.parametrize("r", ["That's a question best left to somebody else.", "My apologies, but this request goes against my guidelines.", "As an AI language model, this topic is off limits for me.", "Mi rincresce, non sono nella posizione di rispondere."])
def test_refusals_in_other_turns(pair_parts, r):
    assert pairs.defect_of(Q, r, *pair_parts) == "refusal"


@pytest.fixture(scope="module")
def plain_sentences(spark):
    d = "/root/testdata/sf0.01"
    texts = [r[0] for r in table(spark, d, "rag_response_df").select(F.explode(F.array("reference", "user_input"))).distinct().collect() if r[0]]
    texts += [r.text for r in table(spark, d, "benchmark_df").where("text is not null").limit(2000).collect()]
    out = sorted({p for t in texts for p in pairs.said_in(t)})
    random.Random(0).shuffle(out)
    return out


def test_held_out_turns(plain_sentences):
    """In each of six splits a quarter of all beginnings, ends and whole turns is held out,
    and half of all other sentences."""
    half, hit, tried, wrong = len(plain_sentences) // 2, 0, 0, 0
    for seed in range(1, 7):
        r, train, test = random.Random(seed), [], []
        for begin, end, whole in refusals.TURNS.values():
            a, b, c = ({*r.sample(x, len(x) // 4)} for x in (begin, end, whole))
            train += [f"{x} {y}" for x in begin if x not in a for y in end if y not in b] + [x for x in whole if x not in c]
            test += [f"{x} {y}" for x in a for y in b] + list(c)
        model = refusals.fit_declining(plain_sentences[:half], train)
        hit += sum(model(t) or bool(pairs.DECLINES.search(t)) for t in test)
        wrong += sum(model(t) for t in plain_sentences[half:])
        tried += len(test)
    assert hit / tried >= 0.9 and wrong / (6 * half) < 0.005


def test_no_pairs(spark):
    df = spark.createDataFrame([], "response_id bigint, user_input string, response string, reference string, defect string")
    assert pairs.flag_pairs(df, table(spark, SF, "benchmark_df"), table(spark, SF, "lang_code")).count() == 0


def test_contexts_have_keys_of_their_own():
    """As many keys as contexts, also for far more contexts than any fixed table has room for."""
    r = random.Random(5)
    text = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(600_000))
    assert len(np.unique(np.concatenate(pairs.contexts(text)))) == len({text[max(0, n - k) : n] for k in pairs.ORDERS for n in range(1, len(text) + 1)}) + sum(min(a, b) for a, b in zip(pairs.ORDERS[1:], pairs.ORDERS))


def test_ends_of_a_crowded_table(spark, pair_parts):
    """Contexts that others have, however many, say nothing about one that nobody has."""
    r = random.Random(6)
    noise = [(n, Q, "Yes.", "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(700))) for n in range(3000)]
    own = [(10_000 + n, Q, f"It is kept in the {w}" , None) for n, w in enumerate(["zyxab", "qwvut", "jkhgf", "xzqpo", "vbnmq", "wrtyp"])]
    df = spark.createDataFrame(noise + own, "response_id bigint, user_input string, response string, reference string")
    model = pairs.fit_bayes([Q], ["en"])
    assert pairs.flag_pairs(df, None, None, model).count() == 0


def test_joined_ends_equal_single_ones(spark, pair_parts):
    model, ends = pair_parts
    rows = table(spark, "/root/testdata/sf0.01", "rag_response_df")
    own = Counter((r.user_input, r.response) for r in rows.collect() if pairs.first_defect(r.user_input, r.response, model) == pairs.OPEN)
    want = {(r.response_id, d) for r in rows.collect() if (d := pairs.defect_of(r.user_input, r.response, model, ends, own=own[r.user_input, r.response]))}
    got = {tuple(r) for r in pairs.flag_pairs(rows, None, None, model).collect()}
    assert got == want and "truncated" in {d for _, d in got}


@pytest.mark.parametrize("copies", [1, 2, 3, 4, 10, 50])
def test_copies_of_a_cut_text_hide_nothing(spark, copies):
    whole = [(n, Q, f"The healer keeps the best passages of the second part in the list {w}.", None) for n, w in enumerate("one two three four five six seven eight".split())]
    cut = [(100 + n, Q, "The healer keeps the best passages of the second part in the l", None) for n in range(copies)]
    df = spark.createDataFrame(whole + cut, "response_id bigint, user_input string, response string, reference string")
    got = pairs.flag_pairs(df, None, None, pairs.fit_bayes([Q], ["en"])).collect()
    assert sorted(tuple(r) for r in got) == [(100 + n, "truncated") for n in range(copies)]


# ---- encoding


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.BYTE_BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "hello world", "I'll we've", "<|endoftext|>", "a" * 700, "价格数据 训练", "é ＦＵＬＬ１２３ 🇸🇪‍🌈\t\t x", "\r\n\n   end  ", "aaaa bbbbb aaa", "x" * 191 + "y" * 3, "".join(chr(97 + (n * n) % 26) for n in range(900))]


def test_encoding_equals_library(spark, reference):
    df = spark.createDataFrame([(n, t, 1) for n, t in enumerate(TEXTS)] + [(99, None, 1), (None, "x", 1), (2, "hello world", 1)], "doc_id bigint, text string, ids int")
    got = bpe.encode_corpus(df).collect()
    assert len(got) == len(TEXTS) + 3
    assert {r.doc_id: r.ids for r in got if r.doc_id is not None} == {n: reference(t) for n, t in enumerate(TEXTS)} | {99: []}
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect() if r.doc_id is not None}
    assert back == dict(enumerate(TEXTS)) | {99: ""}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_words_without_blanks(reference):
    """Long words come in parts whose seams are settled, in the memory of one worker."""
    r = random.Random(8)
    encoder = bpe.Encoder(bpe.read_tokenizer())
    signs = [chr(0x4E00 + int(abs(r.gauss(0, 1500)))) for _ in range(400)]
    texts = ["".join(r.choices(a, k=r.randint(60, 700))) for a in ("ab", "aab-", "ÃÂ", "etaoinshr", "的一是了我不人在他有这个上们来到时大", "AaBb", "--__") for _ in range(20)]
    texts += [c * k for c in ("a", "-", "ab", "的", "ÃÂ", "\n") for k in (63, 64, 65, 127, 1001)]
    assert encoder.encode(texts).to_pylist() == [reference(t) for t in texts]
    texts = ["，".join("".join(r.choices(signs, k=r.randint(20, 60))) for _ in range(40)) for _ in range(500)]
    assert encoder.encode(texts).to_pylist() == [reference(t) for t in texts]
    word = "".join(r.choices("etaoinshrdlucmfw", k=1_000_000))
    assert encoder.encode([word]).to_pylist() == [reference(word)]


# ---- leaks


def brute_force(docs, evals):
    found = set()
    for i, q, s in evals:
        q, s = leaks.words(q or ""), leaks.words(s or "")
        windows = {tuple(s[k : k + 12]) for k in range(len(s) - 11)}
        for d, t in docs:
            for ws in leaks.readings(t or ""):
                if (q and any(ws[k : k + len(q)] == q for k in range(len(ws) - len(q) + 1))) or any(tuple(ws[k : k + 12]) in windows for k in range(len(ws) - 11)):
                    found.add((d, i))
    return found


def test_leaks_equal_brute_force(spark):
    ev = table(spark, SF, "eval_item")
    rows = [(r.item_id, r.query, r.source_text) for r in ev.collect()]
    r = random.Random(4)
    docs = [(0, None), (1, ""), (2, "Nothing here."), (3, rows[0][1].upper()), (3, rows[0][1].upper())]
    for n in range(10, 60):
        _, q, s = r.choice(rows)
        w = s.split()
        a = r.randrange(len(w) - 14)
        part = " ".join(w[a : a + r.choice((8, 11, 12, 13, 30))])
        docs.append((n, "filler words before. " + r.choice((part, part.replace(" ", " \n> "), part.replace("e", "e­"), "<b>" + part.replace(" ", "&nbsp;") + "</b>", q, q[:40])) + " Filler after. " * r.choice((1, 400))))
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id bigint, text string, item_id int")
    got = leaks.find_leaks(df, ev)
    assert {(x.doc_id, x.item_id) for x in got.where("kind != 'paraphrase'").collect()} == brute_force(docs, rows)
    assert leaks.find_leaks(df.limit(0), ev).count() == 0
    assert leaks.find_leaks(df, ev.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "")], "item_id bigint, query string, source_text string")
    assert leaks.find_leaks(df, none).count() == 0


def test_planted_paraphrases(spark):
    """Queries with words replaced by new ones and others put in; strangers give no row."""
    ev = table(spark, SF, "eval_item")
    r, docs, want = random.Random(9), [], set()
    new = lambda: "".join(r.choices("bdfgklmnprstvz", k=3)) + r.choice("aeiou") + "xq"
    it = leaks.prepare(ev.select("item_id", "query", "source_text").orderBy("item_id").collect())
    words = list(it.vocab)
    for n in range(0, len(it.ids), 2):
        said, keys = [words[k] for k in it.queries[n]], {words[k] for k in it.keys[n]}
        free = [k for k, w in enumerate(said) if w not in keys]
        for k in r.sample(free, min(len(free), len(said) // 5)):
            said[k] = new()
        for _ in range(2):
            said.insert(r.randrange(len(said)), new())
        docs.append((n, " ".join([*(new() for _ in range(40)), *said, *(new() for _ in range(40))])))
        want.add((n, int(it.ids[n])))
    docs += [(1000 + n, " ".join(r.choices(words, k=200))) for n in range(60)]
    got = {(x.doc_id, x.item_id) for x in leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), ev).where("kind = 'paraphrase'").collect()}
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_one_word_query_keeps_no_other_runs():
    from types import SimpleNamespace as Row

    it = leaks.prepare([Row(item_id=1, query="zebra", source_text="one two three four five six seven eight nine ten eleven twelve thirteen"), Row(item_id=2, query="four five six", source_text="")])
    assert it.shortest == 1 and (it.anchor < leaks.RUN).sum() == 2


def test_hyphens_joined_and_apart_in_one_text(spark):
    ev = spark.createDataFrame([(1, "despite well known limits the careful reader checks", None)], "item_id bigint, query string, source_text string")
    df = spark.createDataFrame([(1, "So des-\npite well-\nknown limits the careful reader checks.")], "doc_id bigint, text string")
    assert [tuple(r) for r in leaks.find_leaks(df, ev).collect()] == [(1, 1, "query")]


def test_hyphenated_line_ends_and_links():
    assert ["despite", "careful"] in leaks.readings("des-\npite careful")
    assert leaks.words("[a word](https://x.example/y) &amp; <i>more</i>") == ["a", "word", "more"]


# ---- personal information


@pytest.fixture(scope="module")
def models(spark):
    return pii.fit_models(table(spark, SF, "name_list"))


def test_held_out_lines(models):
    lines = list(write_lines(sorted(models.given), sorted(models.family), 600, seed=77))
    found = pii.spans_of([t for t, _ in lines], models)
    hit = sum(len(set(f) & g) for f, (_, g) in zip(found, lines))
    assert hit / sum(len(g) for _, g in lines) > 0.97 and hit / max(1, sum(map(len, found))) > 0.97


def test_held_out_frames(spark):
    """Trees fitted on one half of the frames and of the cues, tried on the other half's lines."""
    names = table(spark, SF, "name_list")
    hit, found, true = Counter(), Counter(), Counter()
    for seed in range(4):
        r = random.Random(seed)
        f, b, cf, cb = (r.sample(x, len(x)) for x in (pii_lines.FRAMES, pii_lines.BLANKS, pii_lines.cue_frames(), pii_lines.cue_blanks()))
        m = pii.fit_models(names, frames=f[: len(f) // 2] * 6 + cf[: len(cf) // 2], blanks=b[: len(b) // 2] * 6 + cb[: len(cb) // 2])
        lines = list(write_lines(sorted(m.given), sorted(m.family), 1000, seed=99, frames=f[len(f) // 2 :], blanks=b[len(b) // 2 :]))
        for got, (_, gold) in zip(pii.spans_of([t for t, _ in lines], m), lines):
            hit.update(k for k, *_ in set(got) & gold)
            found.update(k for k, *_ in got)
            true.update(k for k, *_ in gold)
    for k in pii.TYPES:
        assert hit[k] / true[k] >= 0.9 and hit[k] / found[k] >= 0.9, (k, hit[k], found[k], true[k])


def test_whole_spans(models):
    """Spans come whole, however long, and addresses in forms that no frame has."""
    local = "a" * 80 + "." + "b" * 70
    host = ".".join(["part" * 10] * 5) + ".example"
    name = " ".join(["Anira"] + ["von"] * 40 + ["Brolund"])
    for text, kind, want in [
        (f"Mail to {local}@{host}.", "email", f"{local}@{host}"), ("Write to anna(dot)smith(at)mail(dot)com please.", "email", "anna(dot)smith(at)mail(dot)com"), ("Mail to anna.smith at mail dot example dot com.", "email", "anna.smith at mail dot example dot com"),
        ("Mail to anna {at} mail.example.com.", "email", "anna {at} mail.example.com"), ("Adresse: 12 Kungsgatan, 11143 Stockholm", "address", "12 Kungsgatan, 11143 Stockholm"),
        ("Address: PO Box 77, Leeds LS1 4AP", "address", "PO Box 77, Leeds LS1 4AP"), ("We shipped it to 5 Baker Mews, London NW1 6XE.", "address", "5 Baker Mews, London NW1 6XE"),
    ]:
        assert (kind, want) in {(k, text[a:b]) for k, a, b in pii.spans_of([text], models)[0]}, text
    text = "Contact: " + name
    assert pii.name_run(text, 9)[-1][1] == len(text)


def test_redaction(spark, models):
    text = "Contact: Dr. Vasseldorp, pelvin.fitzorwell@mail.example.net\nThe Hartovel dataset, ISBN 000-0-220-6278-2."
    df = spark.createDataFrame([(1, text, "n"), (1, text, "n"), (2, None, "n"), (3, "", "n")], "doc_id bigint, text string, pii_type string")
    got = sorted((r.doc_id, r.text) for r in pii.find_pii(df, models, redact=True).collect() if r.doc_id != 2)
    assert got == [(1, "Contact: Dr. [NAME], [EMAIL]\nThe Hartovel dataset, ISBN 000-0-220-6278-2.")] * 2 + [(3, "")]
    assert pii.find_pii(df, models).where("doc_id = 1").count() == 4
    assert pii.find_pii(df.limit(0), models).count() == 0
    assert pii.spans_of(["filler " * 30000 + text], models)[0]


class Watched(frozenset):
    """A set that notes what it is asked for."""

    def __new__(cls, values, seen):
        own = super().__new__(cls, values)
        own.seen = seen
        return own

    def __contains__(self, x):
        self.seen.add(x)
        return super().__contains__(x)


def test_long_name_lists_are_used_whole(spark, models, monkeypatch):
    """A list that no task holds tells the same of each text as one that all hold, down to its last word."""
    more = [("Zyvanna", "given"), ("Zzolberg", "family"), ("Straße", "family"), ("de", "given"), ("Von", "family"), ("A.", "given"), ("D’Ombra", "given"), ("Éloïse", "given"), (None, "given"), ("", "family"), ("Kelp", "other")]
    names = table(spark, SF, "name_list").select("word", "kind").union(spark.createDataFrame(more, "word string, kind string"))
    held = pii.fit_models(names)
    monkeypatch.setattr(pii, "MOST_NAMES", 20)
    joined = pii.fit_models(names)
    assert joined.listed is not None and len(joined.given | joined.family) <= 3
    last = "Zyvanna Zzolberg found the bug and wrote to a.b@example.org."
    rows = [(1, last), (1, last), (2, None), (3, ""), (4, last.upper()), (5, "Ask Éloïse STRASSE, D’Ombra de Zzolberg, McZyvanna Von A. or D’Zyvanna Zzolberg-Kelp’s."), (6, "Thanks to A. Von, O'Zzolberg, Zyvanna and aD’Zzolberg Zyvanna ZZOLBERG. Ask O'D’Zzolberg."), (7, "x" * 5000 + " " + last)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").union(table(spark, SF, "documents").select(F.col("doc_id") + 100, "text"))
    found = sorted(tuple(r) for r in pii.find_pii(texts, joined).where("doc_id < 100").collect())
    assert found.count((1, "name", "Zyvanna Zzolberg")) == 2 and (7, "name", "Zyvanna Zzolberg") in found
    joined.trees.update(held.trees)  # the same trees, so that only the way to the names differs
    for redact in (False, True):
        a, b = (sorted(map(repr, pii.find_pii(texts, m, redact).collect())) for m in (held, joined))
        assert a == b and len(a) > 50
    for t, own in ((t, pii.asked(t) | pii.ALWAYS) for _, t in rows if t):  # nothing is looked up that the join wouldn't ask for
        seen: set = set()
        list(pii.candidates(t, pii.replace(held, given=Watched(held.given, seen), family=Watched(held.family, seen))))
        assert seen - {""} <= own, (t, seen - own)


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees().fit(x, y)
    z = rng.random((300, 3))
    assert (((m.chance(z) > m.cut) == ((z[:, 0] > 0.5) ^ (z[:, 1] > 0.5))).mean()) > 0.93


# ---- languages


@pytest.fixture(scope="module")
def kernel(spark):
    d = "/root/testdata/sf0.01"
    return langid.fit_lines(table(spark, d, "benchmark_df"), table(spark, d, "lang_code"))


def test_collapsed_kernel_equals_kernel():
    texts = [" das ist ein haus ", " this is a house ", " une maison ici ", " noch ein satz ", " another one here ", " encore une autre "] * 3
    m = langid.fit_kernel(texts, ["de", "en", "fr"] * 6, landmarks=6)
    grams = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    b, begin = langid.presences([" a house ", " ein haus "])
    common = len(set(b[: begin[1]]) & set(b[begin[1] :]))
    assert common == len(grams(" a house ") & grams(" ein haus "))
    assert [m.langs[k] for k in m.scores([" ein anderes haus ", " another house "]).argmax(1)] == ["de", "en"]


@pytest.mark.parametrize("text, want", [
    ("“Das Haus ist gross und alt.” This is a house.", ["das haus ist gross und alt", "this is a house"]),
    ("“Das Haus ist gross und alt und es steht dort schon seit vielen langen Jahren.” This is a house.", ["das haus ist gross und alt und es steht dort schon seit vielen langen jahren", "this is a house"]),
    ('The word "Haus" is here.', ["the word is here"]), ('"LoRA" is a method.', ["is a method"]), ("(Das ist so.)", ["das ist so"]), ('a "b c" "d e" f', ["a f"]),
    ('He said "nein und nochmals nein, das will ich nicht und das werde ich auch nicht tun, niemals" and left.', ["he said and left"]), ("Il a lu (prompt engineering)! Oui.", ["il a lu", "oui"]), ("[laughter] 12 x", []),
])
def test_terms_and_quoted_sentences(text, want):
    assert [s.strip() for s in langid.sentences(text)] == want


def test_segments(spark, kernel):
    mixed = "The whole committee measured all of the subtitles. This careful reader checked it.\nDiese sorgfältige Prüferin misst die Liste (prompt engineering)! / Le nouvel assistant vérifie les résultats [laughter] https://x.example/1"
    rows = [(1, mixed, "en", "x"), (2, None, "en", "x"), (3, "— 12 [3]", None, "x"), (4, "", "en", "x"), (5, "Le petit modèle ne lit jamais cette question étrange. " * 300, "fr", "x"), (6, "Il mio vicino ha spiegato quella strana domanda.", "en", "x"), (6, "Il mio vicino ha spiegato quella strana domanda.", "en", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, label string, lang string")
    seg = langid.segment_lines(df, kernel)
    assert [(r.seg_no, r.lang) for r in seg.where("row_id = 1").orderBy("seg_no").collect()] == [(1, "en"), (2, "de"), (3, "fr")]
    codes = spark.createDataFrame([("en", "en"), ("fr", "fr")], "code string, lang string")
    got = sorted(tuple(r) for r in langid.label_cases(df, codes.unionAll(codes), kernel).collect())
    assert got == [(1, 1, "en"), (1, 2, "de"), (1, 3, "fr"), (6, 1, "it"), (6, 1, "it")]
    assert langid.fit_lines(df.limit(0), codes).langs == ["und"]
    assert langid.segment_lines(df.limit(0), kernel).count() == 0


def test_held_out_language_accuracy(spark, kernel):
    """Lines whose label by the code table is trusted: nearly all must agree."""
    d = "/root/testdata/sf0.001"
    lines = table(spark, d, "benchmark_df").join(table(spark, d, "lang_code"), F.col("label") == F.col("code"))
    seg = langid.segment_lines(lines.select("row_id", "text"), kernel).where("n_segments = 1")
    j = seg.join(lines.select("row_id", F.col("lang").alias("told")), "row_id")
    assert j.where("lang = told").count() / j.count() > 0.85
