import functools
import itertools
import random

import pytest

from textlathe.functions import udfs as U

WORDS = lambda text: len(text.split())


def least_edits(a: str, b: str) -> int:
    """Distance by all choices at each pair of places; neighbours may change places once."""

    @functools.cache
    def of(i: int, j: int) -> int:
        if i == 0 or j == 0:
            return i + j
        ways = [of(i - 1, j) + 1, of(i, j - 1) + 1, of(i - 1, j - 1) + (a[i - 1] != b[j - 1])]
        if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
            ways.append(of(i - 2, j - 2) + 1)
        return min(ways)

    return of(len(a), len(b))


def test_edit_scripts_are_short_and_lead_to_the_other_word():
    r = random.Random(21)
    short = ["".join(x) for n in range(4) for x in itertools.product("kl", repeat=n)]
    long = ["".join(r.choices("oprsu", k=r.randint(0, 9))) for _ in range(60)]
    for a, b in [*itertools.product(short, short), *zip(long, reversed(long)), ("otter", "toter"), ("", "mole"), ("mole", "")]:
        n, edits = U.edit_script(a, b)
        assert n == len(edits) == least_edits(a, b), (a, b)
        assert U.rebuilt(a, b, edits) == b, (a, b, edits)


def test_edit_kinds():
    assert U.edit_script("weihgt", "weight")[1] == [("transpose", 3, -1)]
    assert U.edit_script("rivver", "river")[1] in ([("delete", 2, -1)], [("delete", 3, -1)])
    assert [op for op, *_ in U.edit_script("lak", "lake")[1]] == ["insert"]
    assert U.edit_script("pond", "pone")[1] == [("substitute", 3, 3)]


LINES = ["The otter swims.\n", "It dives; it rests. Then it eats a fish!\n", "\n", "  \n", "No stop here\n", "Is that all? Yes. Or no"]


def lines_packed(body: str, context: str, target: int) -> list[str] | None:
    """Lines with the blank ones after them, taken together as long as they fit; None if a
    line alone is over the target."""
    units: list[str] = []
    for line in body.splitlines(True):
        if units and (not line.strip() or not units[-1].strip()):
            units[-1] += line
        else:
            units.append(line)
    if any(WORDS(f"{context} {u}") > target for u in units):
        return None
    out: list[str] = []
    for u in units:
        if out and WORDS(f"{context} {out[-1]}{u}") <= target:
            out[-1] += u
        else:
            out.append(u)
    return out


@pytest.mark.parametrize("target", [3, 4, 5, 7, 9, 12, 30])
def test_packed_pieces(target):
    """Nothing is lost and no piece is over the target unless it is one sentence; where
    lines needn't be cut, pieces are the greedy ones."""
    for lines in itertools.permutations(LINES, 4):
        body, context = "".join(lines), "River notes"
        got = U.pack(body, context, WORDS, target)
        assert "".join(got) == body
        for piece in got:
            over = WORDS(f"{context} {piece}") > target
            assert not over or len([x for x in piece.replace("!", ".").replace("?", ".").split(". ") if x.strip()]) == 1
        want = lines_packed(body, context, target)
        assert want is None or got == want


def test_packing_nothing():
    assert U.pack("", "River", WORDS, 8) == U.pack(" \n\t\n", "River", WORDS, 8) == []


def test_wordpieces():
    vocab = {"river": 1, "bank": 2, "##bank": 3, "##s": 4, "riv": 5, "ol": 6, "##e": 7}
    run = lambda ws: [i for w in ws for i in U.wordpieces(U.plain_word(w), vocab)]
    assert run(["river", "bank"]) == [1, 2]
    assert run(["riverbanks", "olé"]) == [1, 3, 4, 6, 7]
    assert run(["riverq", "bank"]) == [2]  # a word with a part that no piece covers gives none
    assert U.wordpieces("s" * 101, {"s": 1, "##s": 2}) == []


def test_rouge_and_diff():
    assert U.rouge_l("the cat sat", "the cat ran") == pytest.approx(2 / 3)
    assert U.rouge_l("", "x") == 0.0
    assert U.line_diff("a\nb\nc", "a\nx\nc") == [("replace", "b", "x")]


def test_payload_records():
    page = 'x self.__next_f.push([1,"{\\"models\\": [{\\"n\\": \\"a]\\"}, {\\"n\\": 2}]"]) y'
    assert U.embedded_records(U.payload_text(page)) == ['{"n": "a]"}', '{"n": 2}']
    assert U.payload_text("plain") == "plain"
    assert U.embedded_records('"data": [oops]') == []


def test_html_lines():
    assert U.html_lines("<h1>A <b>b</b></h1><p>one\n two</p><pre>x\n  y</pre>") == ["A b", "one two", "x\n  y"]


def test_key_tree(spark):
    from textlathe.operators.nested import key_tree

    rows = ['{"a": 1, "b": {"c": "x"}, "l": [{"m": 1.5}, {"m": null}], "e": [], "p": [1, "2"], "t": true}', '{"a": null, "b": 3, "t": false}', "oops", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = {r.path: r.kind for r in key_tree(df, "j").collect()}
    assert got == {"a": "mixed", "b": "nested", "b.c": "str", "l": "nested", "l[]": "nested", "l[].m": "mixed", "e": "nested", "e[]": "empty", "p": "nested", "p[]": "primitive", "t": "bool"}
