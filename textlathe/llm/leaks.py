"""Evaluation items leaking into documents, by latent semantic retrieval.

1. One pass over all documents counts the evaluation words' document frequencies and
   keeps the passages that can hold an item at all: runs of evaluation words that are as
   long as an item's window and, below `RUN` words, have the anchor word of such a window.
   All other text is let go without loss. For paraphrases, stretches around a query's key
   words are kept too, whatever words stand between.
2. The TF-IDF matrix of all passage windows gets a randomised singular value
   decomposition: each partition adds up its share of A'A times a random block, the
   driver orthonormalises a block of (words x rank). Rows stay lists of word numbers.
3. Item windows and passage windows meet in the latent space, in blocks. A pair is a
   candidate if its latent product plus the product of the two residual norms reaches
   the item window's own norm: a passage that holds the window always does. A paraphrase
   is one from a latent cosine of `COSINE` on.
4. Longest common runs of words decide. Of the paraphrases, a long common subsequence
   with the query and the query's key words are asked.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlathe.runtime import cut_lineage, spread

#: Words in a row of an item's source that make a leak; passage windows and their step.
RUN, WIDTH, STRIDE = 12, 24, 12
RANK, POWER, SEED = 64, 1, 17
#: Items handled at once (their windows are sent to every task), rows of a product block.
ITEM_BLOCK, ROW_BLOCK = 20_000, 2048
#: Paraphrases: words of the query in order, least latent cosine, share of key words, least query.
PARAPHRASE_SHARE, COSINE, KEY_SHARE, LEAST_QUERY = 0.7, 0.4, 0.3, 4
#: Tasks of the decomposition, each of which sends a block of sums.
SKETCH_TASKS = 200

INVISIBLE = re.compile("[­͏؜​-‏‪-‮⁠-⁤⁪-⁯﻿︀-️]")
BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
ESCAPE = re.compile(r"\\(?:[nrtbf\"/\\])")
HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t>|*#]*(?=[^\W\d_])")
PARTED = re.compile(r"([^\W\d_]+)[-‐‑][ \t]*\r?\n[ \t>|*#]*([^\W\d_]+)")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Text without markup, escapes and invisible characters, in one case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", BLOCK_TAG.sub(" ", text))
    if "](" in text:
        text = LINK.sub("] ", text)
    if "\\" in text:
        text = ESCAPE.sub(" ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return text.casefold()


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))


def readings(text: str, known=None) -> list[list[str]]:
    """The words of a text; if words are parted at line ends, with all of them apart, with
    all joined, and with each as `known` has it: joined if it holds the joined word."""
    t = plain(text)
    if "-" in t or "‐" in t or "‑" in t:
        joined = HYPHEN.sub("", t)
        if joined != t:
            out = [WORD.findall(t), WORD.findall(joined)]
            if known is not None and len(HYPHEN.findall(t)) > 1:
                out.append(WORD.findall(PARTED.sub(lambda m: m[1] + ("" if m[1] + m[2] in known else " ") + m[2], t)))
            return out
    return [WORD.findall(t)]


@dataclass
class Items:
    """Evaluation items as word numbers, with every window that a leak must hold."""

    ids: np.ndarray
    queries: list[np.ndarray]
    sources: list[np.ndarray]
    vocab: dict[str, int]
    windows: np.ndarray
    owner: np.ndarray
    shortest: int
    #: For each word, the shortest window below `RUN` words that it is the anchor of.
    anchor: np.ndarray
    #: Key words of each query (none for a short one), and the queries of each key word.
    keys: list[np.ndarray]
    asked_by: dict[int, list[int]]


def prepare(rows: list) -> Items:
    vocab: dict[str, int] = {}
    number = lambda text: np.array([vocab.setdefault(w, len(vocab)) for w in words(text or "")], np.int32)
    queries, sources = [number(r.query) for r in rows], [number(r.source_text) for r in rows]
    spread_of = np.zeros(len(vocab), np.int64)  # in how many items a word occurs
    for q, s in zip(queries, sources):
        spread_of[np.unique(np.concatenate([q, s]))] += 1
    size = np.array([len(w) for w in vocab], np.int64)
    windows, owner, shortest = [], [], RUN
    anchor, keys, asked_by = np.full(len(vocab), RUN, np.int64), [], {}
    for n, (q, s) in enumerate(zip(queries, sources)):
        cuts = [q[:RUN]] if len(q) else []
        cuts += [s[k : k + RUN] for k in range(len(s) - RUN + 1)]
        for w in cuts:
            shortest = min(shortest, len(w))
            windows.append(np.pad(w, (0, RUN - len(w)), constant_values=-1))
            owner.append(n)
        rare = q[np.lexsort((q, -size[q], spread_of[q]))]
        if 0 < len(q) < RUN:
            anchor[rare[0]] = min(anchor[rare[0]], len(q))
        keys.append(np.array(list(dict.fromkeys(rare.tolist()))[: max(1, round(KEY_SHARE * len(q)))] if len(q) >= LEAST_QUERY else [], np.int64))
        for w in keys[-1].tolist():
            asked_by.setdefault(w, []).append(n)
    return Items(np.array([r.item_id for r in rows]), queries, sources, vocab, np.array(windows, np.int32).reshape(-1, RUN), np.array(owner, np.int32), shortest, anchor, keys, asked_by)


def runs_of(numbers: np.ndarray, least: int) -> list[np.ndarray]:
    """Maximal runs without -1 of at least `least` words."""
    known = np.concatenate([[False], numbers >= 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    return [numbers[a:b] for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def stretches(numbers: np.ndarray, it: Items, is_key: np.ndarray) -> list[np.ndarray]:
    """Stretches with all key words of a query near each other; overlapping ones are one.
    Words of no item stand in them as the number after the last one."""
    at = np.flatnonzero((numbers >= 0) & is_key[numbers])
    if not len(at):
        return []
    has, cuts = set(numbers[at].tolist()), []
    for n in {q for w in has for q in it.asked_by[w]}:
        keys = it.keys[n].tolist()
        if not has.issuperset(keys):
            continue
        reach = 2 * len(it.queries[n])
        places = [at[numbers[at] == w] for w in keys]
        for p in places[0].tolist():
            if all((np.abs(x - p) <= reach).any() for x in places[1:]):
                cuts.append((max(0, p - reach), min(len(numbers), p + reach + 1)))
    out: list[list[int]] = []
    for a, b in sorted(cuts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [np.where(numbers[a:b] < 0, len(it.vocab), numbers[a:b]).astype(np.int32) for a, b in out]


def passages(documents: DataFrame, items, paraphrases: bool = True) -> DataFrame:
    """(doc_id, loose, run): runs of evaluation words of every document and, loose, the
    stretches around queries' key words; rows with a null doc_id and a negative first
    number hold a partition's counts: texts, then a word's texts."""

    def run(frames):
        it: Items = items.value
        get, seen, n = it.vocab.get, np.zeros(len(it.vocab) + 1, np.int64), 0
        is_key = np.zeros(len(it.vocab) + 1, bool)
        is_key[list(it.asked_by)] = True
        for frame in frames:
            ids, loose, found = [], [], []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                n += 1
                for ws in readings(text, it.vocab):
                    numbers = np.array([get(w, -1) for w in ws], np.int32)
                    kept = [r for r in runs_of(numbers, it.shortest) if len(r) >= RUN or it.anchor[r].min() <= len(r)]
                    open_ = stretches(numbers, it, is_key) if paraphrases else []
                    ids += [doc] * (len(kept) + len(open_))
                    loose += [False] * len(kept) + [True] * len(open_)
                    found += kept + open_
                seen[np.unique(numbers)] += 1  # -1 counts in the last place
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "loose": pd.array(loose, "boolean"), "run": pd.Series(found, dtype=object)})
        counts = np.concatenate([[-1, n], seen[:-1]]).astype(np.int32)
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "loose": pd.array([False], "boolean"), "run": [counts]})

    given = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null and text != ''")
    return spread(given).mapInPandas(run, "doc_id bigint, loose boolean, run array<int>")


def weights_of(counted: DataFrame, size: int) -> np.ndarray:
    """Inverse document frequencies; one row a partition is added up before the driver."""
    rows = counted.where("doc_id is null").select(F.posexplode("run").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect()
    total = np.zeros(size + 2)
    for r in rows:
        total[r.i] = r.c
    return np.log((total[1] + 1) / (total[2:] + 1)) + 1


def windows_of(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the runs, padded with -1, and the run each comes from."""
    out, owner = [], []
    for n, r in enumerate(runs):
        last = max(0, len(r) - WIDTH)
        for at in [*range(0, last, STRIDE), last]:
            w = r[at : at + WIDTH]
            out.append(np.pad(w, (0, WIDTH - len(w)), constant_values=-1))
            owner.append(n)
    return np.array(out, np.int32).reshape(-1, WIDTH), np.array(owner, np.int64)


def word_rows(weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    """What each word adds to a window's product with the block; a row of zeros for -1 and
    for words of no item."""
    return np.concatenate([weights[:, None] * block, np.zeros((1, block.shape[1]))]).astype(np.float32)


def latent(windows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products of the windows' TF-IDF rows with a block, summed from the words' rows."""
    return rows[windows].sum(1)


def squares(windows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Squared norms of the windows' TF-IDF rows."""
    w = np.append(weights, 0.0)[windows]
    return ((windows[:, :, None] == windows[:, None, :]) * (w * w)[:, :, None]).sum((1, 2))


def sketch(found: DataFrame, weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A'A times a block, A being the TF-IDF rows of all windows of all passages."""
    rows = word_rows(weights, block)

    def run(frames):
        out = np.zeros(block.shape)
        for frame in frames:
            w, _ = windows_of([np.asarray(r, np.int32) for r in frame["run"]])
            for at in range(0, len(w), ROW_BLOCK):
                part = w[at : at + ROW_BLOCK]
                y, flat = latent(part, rows), part.ravel()
                order = np.argsort(flat, kind="stable")
                order = order[(flat[order] >= 0) & (flat[order] < len(weights))]
                if len(order):
                    words = flat[order]
                    begin = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
                    out[words[begin]] += weights[words[begin], None] * np.add.reduceat(y[order // part.shape[1]], begin)
        yield pd.DataFrame({"x": [out.ravel()]})

    # few tasks, as each sends a whole block: passages are a small part of the corpus
    summed = found.coalesce(SKETCH_TASKS).mapInPandas(run, "x array<double>").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(block.size)
    out[summed["i"].to_numpy(np.int64)] = summed["v"].to_numpy(float)
    return out.reshape(block.shape)


def latent_space(found: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (words x rank) by a randomised decomposition."""
    rank = min(rank, len(weights))
    block = np.random.default_rng(SEED).standard_normal((len(weights), rank)).astype(np.float32)
    for _ in range(1 + POWER):
        block, _ = np.linalg.qr(sketch(found, weights, block))
        block = block.astype(np.float32)
    return block


def longest_run(a: list, b: list) -> int:
    """Length of the longest run of words that both have."""
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = prev[j - 1] + 1
                best = max(best, row[j])
        prev = row
    return best


def subsequence(a: list, b: list) -> int:
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(row[j], prev[j + 1]))
        prev = row
    return prev[-1]


def holds(run: bytes, part: np.ndarray) -> bool:
    """Whether the part's words stand in a row in the run (both as 4-byte numbers)."""
    needle, at = part.tobytes(), run.find(part.tobytes())
    while at >= 0 and at % 4:
        at = run.find(needle, at + 1)
    return at >= 0


def verdict(run: np.ndarray, it: Items, n: int, loose: bool) -> str | None:
    q, s = it.queries[n], it.sources[n]
    if loose:
        near = subsequence(q.tolist(), run.tolist()) >= PARAPHRASE_SHARE * len(q) and np.isin(it.keys[n], run).all()
        return "paraphrase" if near else None
    raw = run.tobytes()
    if len(q) and holds(raw, q):
        return "query"
    if any(holds(raw, s[k : k + RUN]) for k in range(len(s) - RUN + 1)):
        return "source"
    return None


def search(found: DataFrame, items, weights: np.ndarray, space: np.ndarray) -> DataFrame:
    """(doc_id, item_id, kind) of the pairs that the check after the candidate search keeps."""

    def run(frames):
        it: Items = items.value
        rows = word_rows(weights, space)
        ql = np.concatenate([latent(it.windows[b : b + ROW_BLOCK], rows) for b in range(0, len(it.windows), ROW_BLOCK)])
        own = np.concatenate([squares(it.windows[b : b + ROW_BLOCK], weights) for b in range(0, len(it.windows), ROW_BLOCK)]).astype(np.float32)
        qr = np.sqrt(np.maximum(own - (ql * ql).sum(1), 0))
        asked = np.flatnonzero([len(k) > 0 for k in it.keys])
        whole = np.stack([rows[it.queries[n]].sum(0) for n in asked]) if len(asked) else np.zeros((0, rows.shape[1]), np.float32)
        whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
        for frame in frames:
            runs, loose = [np.asarray(r, np.int32) for r in frame["run"]], frame["loose"].to_numpy(bool)
            pairs: set[tuple[int, int]] = set()
            w, owner = windows_of(runs)
            for at in range(0, len(w), ROW_BLOCK):
                part, of = w[at : at + ROW_BLOCK], owner[at : at + ROW_BLOCK]
                pl = latent(part, rows)
                pr = np.sqrt(np.maximum(squares(part, weights) - (pl * pl).sum(1), 0)).astype(np.float32)
                tight = np.flatnonzero(~loose[of])
                for b in range(0, len(ql) if len(tight) else 0, 4 * ROW_BLOCK):
                    some = slice(b, b + 4 * ROW_BLOCK)
                    bound = pl[tight] @ ql[some].T + np.outer(pr[tight], qr[some])
                    hit_p, hit_q = np.nonzero(bound >= own[some] * (1 - 1e-4) - 1e-3)
                    pairs.update(zip(of[tight[hit_p]].tolist(), it.owner[b + hit_q].tolist()))
                free = np.flatnonzero(loose[of])
                if len(free) and len(asked):
                    cosine = pl[free] @ whole.T / np.maximum(np.linalg.norm(pl[free], axis=1, keepdims=True), 1e-12)
                    hit_p, hit_q = np.nonzero(cosine >= COSINE)
                    pairs.update(zip(of[free[hit_p]].tolist(), asked[hit_q].tolist()))
            ids = frame["doc_id"].tolist()
            out = [(ids[r], int(it.ids[n]), kind) for r, n in sorted(pairs) if (kind := verdict(runs[r], it, n, bool(loose[r])))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind"]).astype({"doc_id": "int64", "item_id": "int64"})

    return found.mapInPandas(run, "doc_id bigint, item_id bigint, kind string")


def find_leaks(documents: DataFrame, eval_items: DataFrame, rank: int = RANK, paraphrases: bool = True) -> DataFrame:
    """(doc_id, item_id, kind) for each document and evaluation item that leaked into it.

    `kind` is `query` (all words of the query in a row), `source` (`RUN` or more words of
    the source in a row) or, if `paraphrases` are asked for, `paraphrase` (a query of
    `LEAST_QUERY` words or more, most of its words in order among others). Null, empty and wordless texts and items give
    no row; repeated documents are reported each; items are taken in blocks, so their
    number isn't bound by memory; other columns are ignored; empty tables give an empty
    result. Texts are read whole, whatever their length.
    """
    spark = documents.sparkSession
    rows = eval_items.select("item_id", "query", "source_text").where("item_id is not null").orderBy("item_id")
    parts = []
    block: list = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == ITEM_BLOCK:
            parts.append(block)
            block = []
    if block or not parts:
        parts.append(block)
    out = None
    for part in parts:
        it = prepare(part)
        items = spark.sparkContext.broadcast(it)
        if not len(it.windows):
            got = documents.select(F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("item_id"), F.lit("").alias("kind")).limit(0)
        else:
            counted = cut_lineage(passages(documents, items, paraphrases))
            weights = weights_of(counted, len(it.vocab))
            found = counted.where("doc_id is not null")
            got = search(found, items, weights, latent_space(found, weights, rank))
        out = got if out is None else out.unionAll(got)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct((F.col("kind") == "paraphrase").alias("late"), "kind"))["kind"].alias("kind"))
