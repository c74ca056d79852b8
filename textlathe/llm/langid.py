"""Languages of lines and of their segments, by string kernels.

Two texts are as alike as the share of character n-grams (one to four letters, words
bounded by blanks) that both have: the blended-spectrum presence kernel. Nystroem
landmarks and kernel ridge regression give a score for each language against the rest.
As the kernel is a product of n-gram presences, landmarks times coefficients collapse
into one matrix, and a batch of sentences is scored by one product with it. A line's
sentences are joined to segments by the best path under a price for each change.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlathe.llm.batches import parts
from textlathe.runtime import spread

#: Labelled lines the classifier may be fitted on, landmarks, n-gram buckets, ridge.
SAMPLE, LANDMARKS, BUCKETS, RIDGE, SEED = 9_000, 600, 1 << 16, 1e-3, 5
#: Length of lines that may be in the sample.
FIT_CHARS = 4_000
#: A sentence counts as often as it occurs in the sample, up to this; labels less likely than this are wrong.
MOST_WEIGHT, LEAST_LIKELY = 25, 0.05
LONGEST_GRAM = 4
SWITCH_PRICE = 1.0
CHUNK = 4000

NOISE = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|https?://\S+|www\.\S+|\S+@\S+|[@#]\w+|`[^`]*`|&\w+;")
#: Quoted or bracketed stretches of one line; a term if it stands inside a sentence.
QUOTED = re.compile(r"[\"“„«][^\"“”„«»\n]*[\"”»]|\([^()\n]*\)")
SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)|[\r\n\v\f\x85\u2028\u2029]|\s[/|–—-]+\s")
INNER_END = re.compile(r"[.!?…]\s+\S")
SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\s*[\r\n\v\f\x85\u2028\u2029]+\s*|\s+[/|–—-]+\s+|(?<=[.!?…])\s*[/|–—]\s*")
LETTERS = re.compile(r"[^\W\d_]+")


def without_terms(text: str) -> str:
    """The text without quoted and bracketed terms inside its sentences.

    A stretch is inside a sentence if words of the same sentence stand before it, or, if
    it doesn't end like a sentence itself, after it. One that holds the end of a sentence
    and more behind it is no term, nor is one that is all that its sentence has.
    """
    if not QUOTED.search(text):
        return text
    ends = [m.end() for m in SENTENCE_END.finditer(text)] + [len(text)]
    out, at, led = [], 0, -1
    for m in QUOTED.finditer(text):
        a, b = m.span()
        if INNER_END.search(text, a + 1, b - 1):
            continue
        k = bisect.bisect_right(ends, a)
        begin, end = ends[k - 1] if k else 0, ends[min(bisect.bisect_left(ends, b), len(ends) - 1)]
        if LETTERS.search(text, max(begin, at), a):
            led = begin
        closed = text[b - 2] in ".!?…"
        if led == begin or (not closed and LETTERS.search(QUOTED.sub(" ", text[b:end]))):
            out.append(text[at:a])
            at = b
    return " ".join([*out, text[at:]])


def sentences(text: str) -> list[str]:
    """Whole sentences and fragments that have words, as runs of letters and blanks.

    Markup, links, handles, notes in square brackets, quoted or bracketed terms inside a
    sentence and numbers are no words; a single letter alone is none either.
    """
    out = []
    for part in SPLIT.split(without_terms(NOISE.sub(" ", text))):
        found = LETTERS.findall(part.lower()) if part else []
        if found and sum(map(len, found)) > 1:
            out.append(" " + " ".join(found) + " ")
    return out


def presences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of all texts one after the other, and where each begins."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        keys.append((owner[: len(codes) - n + 1] * BUCKETS + (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)[inside])
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    key.sort()  # a sort and a comparison are several times as fast as a set of integers
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    begin = np.searchsorted(key, np.arange(len(texts)) * BUCKETS)
    return key % BUCKETS, begin


@dataclass
class KernelModel:
    langs: list[str]
    matrix: np.ndarray
    heat: float = 0.05

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores (texts x languages); every text has a blank at least."""
        buckets, begin = presences(texts)
        total = np.add.reduceat(self.matrix[buckets], begin, axis=0)
        size = np.diff(np.append(begin, len(buckets)))
        return total / np.sqrt(size)[:, None]

    def logs(self, texts: list[str]) -> np.ndarray:
        """Logarithms of the confidence in each language."""
        z = self.scores(texts) / self.heat
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def rows_times(buckets: np.ndarray, begin: np.ndarray, block: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Normalised presence rows times a dense block; `row_of` gives a bucket's row in it,
    the last one for buckets without. Only rows that the batch has enter the product."""
    size = np.diff(np.append(begin, len(buckets)))
    owner, place = np.repeat(np.arange(len(begin)), size), row_of[buckets]
    has = place < len(block) - 1
    owner, place = owner[has], place[has]
    used, column = np.unique(place, return_inverse=True)
    rows = np.zeros((len(begin), len(used)), np.float32)
    rows[owner, column] = (1 / np.sqrt(size)).astype(np.float32)[owner]
    return rows @ block[used]


def fit_kernel(texts: list[str], labels: list[str], weights: np.ndarray | None = None, landmarks: int = LANDMARKS) -> KernelModel:
    """Nystroem features on stratified landmarks, one-versus-rest ridge, heat by held-out rows."""
    weights = np.ones(len(texts)) if weights is None else weights
    langs = sorted(set(labels))
    y = np.array([langs.index(c) for c in labels])
    rng = np.random.default_rng(SEED)
    share = max(1, landmarks // max(1, len(langs)))
    picked = []
    for k in range(len(langs)):  # half the landmarks of a language are its most frequent texts, half are drawn
        own = rng.permutation(np.flatnonzero(y == k))
        often = own[np.argsort(-weights[own], kind="stable")][: share // 2]
        picked += [*often, *own[~np.isin(own, often)][: share - len(often)]]
    # rows only for buckets that a landmark has, and one of zeros for all others
    buckets, begin = presences([texts[i] for i in picked])
    owner = np.repeat(np.arange(len(picked)), np.diff(np.append(begin, len(buckets))))
    used, place = np.unique(buckets, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(picked)), np.float32)
    dense[place, owner] = 1 / np.sqrt(np.bincount(owner))[owner]
    row_of = np.full(BUCKETS, len(used))
    row_of[used] = np.arange(len(used))
    kernel = dense.T @ dense
    value, vector = np.linalg.eigh(kernel.astype(np.float64))
    good = value > 1e-6 * value.max()
    root = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)
    features = np.concatenate([rows_times(*presences(texts[at : at + 200]), dense, row_of) @ root for at in range(0, len(texts), 200)])
    held = np.arange(len(texts)) % 5 == 0
    target = np.eye(len(langs))[y]

    def solve(rows: np.ndarray) -> np.ndarray:
        z, w = features[rows], weights[rows][:, None].astype(np.float32)
        return np.linalg.solve((z.T @ (w * z)).astype(np.float64) + RIDGE * max(1.0, w.sum()) / 100 * np.eye(z.shape[1]), z.T @ (w * target[rows]))

    heat = 0.1
    if held.sum() > 50:
        s = features[held] @ solve(~held)
        best = None
        for t in (0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2):
            z = s / t - (s / t).max(1, keepdims=True)
            loss = -(z[np.arange(len(z)), y[held]] - np.log(np.exp(z).sum(1))).mean()
            if best is None or loss < best:
                best, heat = loss, t
    matrix = np.zeros((BUCKETS, len(langs)), np.float32)
    matrix[used] = dense[:-1] @ (root @ solve(np.ones(len(texts), bool))).astype(np.float32)
    return KernelModel(langs, matrix, heat)


def one_language(codes: DataFrame) -> DataFrame:
    """(code, lang), one row a code: a small fixed table."""
    return codes.where("code is not null and lang is not null").groupBy("code").agg(F.min("lang").alias("lang"))


def fit_lines(lines: DataFrame, codes: DataFrame, sample: int = SAMPLE) -> KernelModel:
    """Fit on at most `sample` labelled lines, taken in order of a hash of their text.

    Only lines of up to `FIT_CHARS` characters are taken, so the sample is bounded in
    bytes too. A label stands for a language by its exact spelling in `codes`. Wrong
    labels and lines in several languages are outvoted: a sentence takes its most
    frequent label, and a first fit sorts out labels that it finds unlikely before the
    second.
    """
    labelled = lines.select(F.col("label").alias("code"), "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(one_language(codes)), "code")
    rows = labelled.orderBy(F.xxhash64("text"), "lang").limit(sample).collect()
    votes: dict[str, Counter] = {}
    for r in rows:
        for t in sentences(r.text):
            votes.setdefault(t, Counter())[r.lang] += 1
    texts = sorted(votes)
    if not texts:
        return KernelModel(["und"], np.zeros((BUCKETS, 1), np.float32))
    labels = [min(votes[t], key=lambda c: (-votes[t][c], c)) for t in texts]
    weights = np.array([min(MOST_WEIGHT, votes[t][c]) for t, c in zip(texts, labels)], float)
    first = fit_kernel(texts, labels, weights)
    place = np.array([first.langs.index(c) for c in labels])
    logs = np.concatenate([first.logs(texts[p]) for p in parts(texts, CHUNK)])
    keep = np.flatnonzero((logs[np.arange(len(texts)), place] > np.log(LEAST_LIKELY)) | (weights >= 5))
    return fit_kernel([texts[i] for i in keep], [labels[i] for i in keep], weights[keep]) if len(keep) else first


def best_path(logs: np.ndarray, price: float = SWITCH_PRICE) -> np.ndarray:
    """States of least cost where each change of language costs `price`."""
    n, k = logs.shape
    back = np.zeros((n, k), np.int64)
    score = logs[0].copy()
    for i in range(1, n):
        top = int(score.argmax())
        moved = score[top] - price > score
        back[i] = np.where(moved, top, np.arange(k))
        score = np.where(moved, score[top] - price, score) + logs[i]
    path = np.zeros(n, np.int64)
    path[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segment_lines(lines: DataFrame, model: KernelModel, id_col: str = "row_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(id, seg_no, n_segments, lang, confidence) for each segment of each text,
    with the string column `keep` carried along if it is named.

    Segments are the longest runs of sentences in one language, numbered from 1; the
    confidence is the mean of its sentences'. Nulls, empty texts and texts without words
    give no row; long texts are read whole; repeated rows are segmented each; other
    columns are ignored; an empty table gives an empty result.
    """
    given = lines.sparkSession.sparkContext.broadcast(model)
    kept = F.col(keep).cast("string") if keep else F.lit(None).cast("string")
    picked = lines.select(F.col(id_col).cast("bigint").alias(id_col), kept.alias("k"), F.col(text_col).alias("t")).where("t is not null")

    def run(frames):
        model: KernelModel = given.value
        for frame in frames:
            for rows in parts(frame["t"].tolist(), CHUNK):
                ids = list(zip(frame[id_col].iloc[rows].tolist(), frame["k"].iloc[rows].tolist()))
                cut = [sentences(t) for t in frame["t"].iloc[rows]]
                distinct = {s: n for n, s in enumerate(dict.fromkeys(s for p in cut for s in p))}
                texts = list(distinct)
                logs = np.concatenate([model.logs(texts[p]) for p in parts(texts, CHUNK)]) if texts else np.zeros((0, 1))
                top, most = logs.argmax(1).tolist(), np.exp(logs.max(1)).tolist() if texts else []
                out = []
                for (row, k), p in zip(ids, cut):
                    if not p:
                        continue
                    at = [distinct[s] for s in p]
                    first = top[at[0]]
                    if all(top[n] == first for n in at):  # the likeliest of each sentence, and no change to pay for
                        out.append((row, 1, 1, model.langs[first], sum(most[n] for n in at) / len(at), k))
                        continue
                    own = logs[at]
                    path = best_path(own)
                    sure = np.exp(own[np.arange(len(p)), path])
                    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(p)]
                    for no, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
                        out.append((row, no, len(cuts) - 1, model.langs[path[a]], float(sure[a:b].mean()), k))
                yield pd.DataFrame(out, columns=[id_col, "seg_no", "n_segments", "lang", "confidence", "k"])

    done = spread(picked).mapInPandas(run, f"{id_col} bigint, seg_no int, n_segments int, lang string, confidence double, k string")
    return done.withColumnRenamed("k", keep) if keep else done.drop("k")


def label_cases(lines: DataFrame, codes: DataFrame, model: KernelModel) -> DataFrame:
    """Segments of the lines whose label doesn't stand for their one language, and of all
    lines in several languages: (row_id, seg_no, lang). Null and unlisted labels stand
    for none; the label travels with its line, so repeated rows come out each."""
    told = F.broadcast(one_language(codes).select(F.col("code").alias("label"), F.col("lang").alias("told")))
    found = segment_lines(lines, model, keep="label").join(told, "label", "left")
    return found.where("n_segments > 1 or told is null or told != lang").select("row_id", "seg_no", "lang")
