"""Naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

GRAM_BUCKETS = 1 << 15
LETTERS = re.compile(r"[^\W\d_]+")


def gram_ids(text: str) -> np.ndarray:
    """Buckets of all character n-grams of one to four letters, words bounded by blanks."""
    codes = np.frombuffer((" " + " ".join(LETTERS.findall(text.lower())) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        out.append(((h ^ (h >> np.uint64(29))) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class NaiveBayes:
    langs: list[str]
    logs: np.ndarray
    declining: object = None

    def scores(self, text: str) -> np.ndarray:
        return self.logs[gram_ids(text)].sum(0)

    def best(self, text: str) -> str:
        return self.langs[int(self.scores(text).argmax())]


def fit_bayes(texts: list[str], labels: list[str]) -> NaiveBayes:
    langs = sorted(set(labels)) or ["en"]
    place = {c: k for k, c in enumerate(langs)}
    counts = np.full((GRAM_BUCKETS, len(langs)), 0.05)
    for t, c in zip(texts, labels):
        np.add.at(counts[:, place[c]], gram_ids(t), 1.0)
    return NaiveBayes(langs, np.log(counts / counts.sum(0)).astype(np.float32))
