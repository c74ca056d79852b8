"""Arrow functions for what built-in expressions cannot say."""

from __future__ import annotations

import difflib
import html.parser
import itertools
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = T.ArrayType(T.StringType())
EDIT = T.StructType([T.StructField("op", T.StringType()), T.StructField("s1_idx", T.IntegerType()), T.StructField("s2_idx", T.IntegerType())])
EDITS = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("edits", T.ArrayType(EDIT))])
CHANGE = T.StructType([T.StructField(k, T.StringType()) for k in ("kind", "old", "new")])


def edit_script(a, b) -> tuple[int, list[tuple[str, int, int]]]:
    """Restricted distance with adjacent transpositions, and the edits that turn a into b.

    Among equal costs the first of transpose, delete, insert, substitute or match that
    is shortest wins; deletions and insertions count only where the signs differ.
    """
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int32)
    how = np.zeros((n + 1, m + 1), np.int8)  # 1 transpose, 2 delete, 3 insert, 4 substitute, 5 match
    cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
    how[1:, 0], how[0, 1:] = 2, 3
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            best, step = None, 0
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and not same:
                best, step = cost[i - 2, j - 2] + 1, 1
            if not same and (best is None or cost[i - 1, j] + 1 < best):
                best, step = cost[i - 1, j] + 1, 2
            if not same and (best is None or cost[i, j - 1] + 1 < best):
                best, step = cost[i, j - 1] + 1, 3
            if best is None or cost[i - 1, j - 1] + (not same) < best:
                best, step = cost[i - 1, j - 1] + (not same), 5 if same else 4
            cost[i, j], how[i, j] = best, step
    edits, i, j = [], n, m
    while i or j:
        step = how[i, j]
        if step == 1:
            edits.append(("transpose", i - 2, -1))
            i, j = i - 2, j - 2
        elif step == 2:
            edits.append(("delete", i - 1, -1))
            i -= 1
        elif step == 3:
            edits.append(("insert", i, j - 1))
            j -= 1
        else:
            if step == 4:
                edits.append(("substitute", i - 1, j - 1))
            i, j = i - 1, j - 1
    return int(cost[n, m]), edits[::-1]


@F.pandas_udf(EDITS)
def edit_script_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [edit_script(x, y) if x is not None and y is not None else (None, None) for x, y in zip(a, b)]
    return pd.DataFrame({"distance": pd.array([r[0] for r in rows], "Int32"), "edits": [None if r[1] is None else [{"op": o, "s1_idx": p, "s2_idx": q} for o, p, q in r[1]] for r in rows]})


def rebuilt(a: str, b: str, edits: list) -> str:
    """The text that the edits make of a; b only gives the signs that they name."""
    out, at = [], 0
    for op, i, j in edits:
        out.append(a[at:i])
        out.append({"transpose": a[i : i + 2][::-1], "delete": "", "insert": b[j] if j >= 0 else "", "substitute": b[j] if j >= 0 else ""}[op])
        at = i + {"transpose": 2, "delete": 1, "insert": 0, "substitute": 1}[op]
    return "".join([*out, a[at:]])


@F.pandas_udf(T.StringType())
def rebuilt_udf(a: pd.Series, b: pd.Series, edits: pd.Series) -> pd.Series:
    steps = lambda e: [(x["op"], x["s1_idx"], x["s2_idx"]) if isinstance(x, dict) else tuple(x) for x in e]
    return pd.Series([rebuilt(x, y, steps(e)) if e is not None else None for x, y, e in zip(a, b, edits)], dtype=object)


def lcs_length(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = diagonal + 1 if x == y else max(row[j], row[j - 1])
            diagonal = keep
    return row[-1]


def rouge_l(a: str, b: str) -> float:
    """F-measure of the longest common subsequence of lower-case words."""
    x, y = re.findall(r"[a-z0-9]+", a.lower()), re.findall(r"[a-z0-9]+", b.lower())
    if not x or not y:
        return 0.0
    n = lcs_length(x, y)
    return 2 * n / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def rouge_l_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def pack(body: str, context: str, count, target: int) -> list[str]:
    """Lossless pieces of a body within a token target, the context counted in.

    A unit is a line with the blank lines after it (those before the first belong to
    it), or a sentence of such a unit that is itself over the target. Units join the
    piece before them while it fits; sentences only join those of their own line, and
    one over the target stays whole. White space alone gives no piece.
    """
    fits = lambda text: count(f"{context}\n\n{text}") <= target
    lines = body.splitlines(keepends=True)
    number = list(itertools.accumulate(bool(x.strip()) for x in lines))
    if not number or not number[-1]:
        return []
    units: list[tuple[int, str]] = []  # (0 or the number of the line it may not leave, text)
    for n, group in itertools.groupby(zip(number, lines), key=lambda x: max(1, x[0])):
        line = "".join(x for _, x in group)
        parts = [line] if fits(line) else re.findall(r".+?(?:[.!?](?:\s+|$)|$)", line, re.S)
        units += [(0, line)] if fits(line) else [(n, p) for p in (parts if "".join(parts) == line else [line])]
    out: list[tuple[int, str]] = []
    for home, text in units:
        if out and out[-1][0] == home and fits(out[-1][1] + text):
            out[-1] = (home, out[-1][1] + text)
        else:
            out.append((home, text))
    return [text for _, text in out]


def pack_udf(target: int = 256, count=None):
    """The packer as a column function of (body, context); `count` counts tokens of a text."""
    count = count or (lambda text: len(text.split()))

    @F.pandas_udf(WORDS)
    def run(body: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([pack(b, c or "", count, target) if b is not None else None for b, c in zip(body, context)])

    return run


def wordpieces(word: str, vocab: dict[str, int], longest: int = 100) -> list[int]:
    """Greedy longest pieces; none at all for a word with an unknown piece or over the limit."""
    if len(word) > longest:
        return []
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                out.append(vocab[piece])
                at = end
                break
        else:
            return []
    return out


def words_and_signs(text: str) -> list[str]:
    """Lower-case runs without blanks and punctuation, and each punctuation sign."""
    return re.findall(r"[^\W_]+|[^\w\s]|_", text.lower())


def plain_word(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def wordpiece_udf(vocab: dict[str, int]):
    """Token ids of basic units; the vocabulary is a parameter of bounded size."""

    @F.pandas_udf("array<int>")
    def run(units: pd.Series) -> pd.Series:
        return pd.Series([[i for u in row for i in wordpieces(plain_word(u), vocab)] if row is not None else None for row in units])

    return run


def line_diff(a: str, b: str) -> list[tuple[str, str, str]]:
    """Changed stretches between two texts' lines: (kind, old, new)."""
    x, y = a.splitlines(), b.splitlines()
    return [(op, "\n".join(x[i:j]), "\n".join(y[k:m])) for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op != "equal"]


@F.pandas_udf(T.ArrayType(CHANGE))
def line_diff_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "old": o, "new": n} for k, o, n in line_diff(x, y)] if x is not None and y is not None else None for x, y in zip(a, b)])


def changed_words(a: str, b: str) -> list[tuple[str, str]]:
    """Changed stretches widened to the words that enclose them."""
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        wide = lambda t, p, q: t[len(re.split(r"\s", t[:p])[-1]) * -1 + p : q + len(re.split(r"\s", t[q:])[0])]
        out.append((wide(a, i, j), wide(b, k, m)))
    return out


#: What kinds of places in a JSON value are called.
KINDS = {type(None): "null", bool: "bool", int: "int", float: "float", str: "str"}


def key_kinds(value, path: str = "") -> list[tuple[str, str]]:
    """(path, kind) of every place of a parsed JSON value; objects and lists of objects
    are `nested` themselves, other lists `primitive`, lists without a member `empty`."""
    if isinstance(value, dict):
        inside = [x for k, v in value.items() for x in key_kinds(v, f"{path}.{k}" if path else k)]
        return [(path, "nested"), *inside] if path else inside
    if not isinstance(value, list):
        return [(path, KINDS[type(value)])]
    if not value or not all(isinstance(v, dict) for v in value):
        return [(path, "nested"), (f"{path}[]", "primitive" if value else "empty")]
    return [(path, "nested"), *(x for v in value for x in key_kinds(v, f"{path}[]"))]


def embedded_records(text: str, keys: tuple[str, ...] = ("models", "data", "defaultData")) -> list[str]:
    """JSON records of the arrays that stand under the given keys in any text; arrays that
    don't parse are skipped."""
    read, out, at = json.JSONDecoder().raw_decode, [], 0
    mark = re.compile(r'"(?:%s)":\s*(?=\[)' % "|".join(map(re.escape, keys)))
    while m := mark.search(text, at):
        try:
            found, at = read(text, m.end())
        except ValueError:
            found, at = [], m.end()
        out += [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in found if isinstance(x, dict)]
    return out


def payload_text(text: str) -> str:
    """Escaped strings of pushed payload calls joined; other texts unchanged."""
    parts = re.findall(r"self\.__next_f\.push\(\[\d+,(\"(?:[^\"\\]|\\.)*\")\]\)", text)
    return "".join(json.loads(p) for p in parts) if parts else text


class Blocks(html.parser.HTMLParser):
    """Block elements of a page as lines; preformatted text stays as it is."""

    BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "blockquote", "pre", "tr"}

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[str] = []
        self.now: list[str] = []
        self.kept = 0

    def close_line(self) -> None:
        text = "".join(self.now)
        text = text if self.kept else re.sub(r"\s+", " ", text).strip()
        if text:
            self.lines.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK or tag == "br":
            self.close_line()
        self.kept += tag == "pre"

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.close_line()
        self.kept -= tag == "pre" and self.kept > 0

    def handle_data(self, data):
        self.now.append(data)


def html_lines(page: str) -> list[str]:
    p = Blocks()
    p.feed(page)
    p.close()
    p.close_line()
    return p.lines


@F.pandas_udf(WORDS)
def html_lines_udf(page: pd.Series) -> pd.Series:
    return pd.Series([html_lines(x) if x is not None else None for x in page])
