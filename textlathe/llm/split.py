"""Cutting oversized texts into overlapping pieces at natural boundaries.

For each oversized text a dynamic programme runs over its boundary positions: a path of
cuts costs the penalty of each boundary (least at a blank line, most inside a word) and
the squared shortfall of each piece against an even share; no piece is over the limit
and neighbours share exactly the given overlap. Only oversized texts leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlathe.runtime import spread

#: The code points with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

W = f"[{WHITE}]"
#: A boundary lies at the end of each match; the first kind that matches there counts.
BOUNDARIES = [
    ("paragraph", 0.0, re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")),
    ("line", 0.25, re.compile("\r\n|[\r\n\x0b\x0c\x85  ]")),
    ("sentence", 0.5, re.compile(rf"[.!?…]+[\"'”’)\]]*{W}+|[。！？]+[」』”]*")),
    ("clause", 1.0, re.compile(rf"[,;:]{W}+|[、，；：]")),
    ("space", 2.0, re.compile(rf"{W}+")),
]
HARD, HARD_STEP = 12.0, 16
#: Zero-width joiner and the emoji variation selector: nothing is parted before or after them.
JOINING = "\u200d\ufe0f"
KINDS = [k for k, _, _ in BOUNDARIES] + ["inside", "end"]
WHITE_RUN = re.compile(f"{W}+")


#: Ends that are worked out together; see `cheapest`.
BLOCK = 16


def boundaries(text: str, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions to cut at, their penalties and kinds.

    Every end of a paragraph, line, sentence, clause or white space is one. In stretches
    longer than `room` without any, every `HARD_STEP`-th position is, unless it would
    part a letter from its combining mark.
    """
    n = len(text)
    kind = np.full(n + 1, -1, np.int8)
    for k in reversed(range(len(BOUNDARIES))):  # the first kind that matches counts
        kind[[m.end() for m in BOUNDARIES[k][2].finditer(text)]] = k
    kind[0] = kind[n] = -1
    at = np.concatenate([[0], np.flatnonzero(kind >= 0), [n]])
    for g in np.flatnonzero(np.diff(at) > room):
        for p in range(int(at[g]) + HARD_STEP, int(at[g + 1]), HARD_STEP):
            while p > at[g] + 1 and (unicodedata.combining(text[p]) or text[p] in JOINING or text[p - 1] == JOINING[0]):
                p -= 1
            if kind[p] < 0:
                kind[p] = len(BOUNDARIES)
    pos = np.flatnonzero(kind >= 0)
    penalty = np.array([*[x for _, x, _ in BOUNDARIES], HARD])
    return pos, penalty[kind[pos]], kind[pos].astype(np.int64)


def cheapest(pos: np.ndarray, penalty: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Places in `pos` (from 0 to the text's length) of the ends of the cheapest pieces.

    Ends are worked out in blocks: what leads to a block's ends from before the block is
    one matrix of costs; only what leads from within the block is taken one by one.
    Among equal costs the earliest predecessor counts.
    """
    n, room = int(pos[-1]), limit - overlap
    share = (n - overlap) / -(-(n - overlap) // room)
    m = len(pos)
    # the first piece has the whole limit: as if it began `overlap` late
    x = pos.astype(float)
    x[0] = overlap
    lows = np.searchsorted(pos, pos - room)
    lows[pos <= limit] = 0
    cost, back = np.full(m, np.inf), np.zeros(m, np.int64)
    cost[0] = 0.0
    scale, aim = 4.0 / share**2, x + share
    places, xs, pen, low_of = np.arange(m), x.tolist(), penalty.tolist(), lows.tolist()
    for a in range(1, m, BLOCK):
        b = min(a + BLOCK, m)
        low, edge = low_of[a], min(low_of[b - 1], a)
        step = x[a:b, None] - aim[low:a]
        step *= step
        step *= scale
        step += cost[low:a]
        if low == 0:  # ends within the overlap are no piece; other pieces than the first have less room
            gain = x[a:b, None] - x[:a]
            step[(gain <= 0) | (gain > room)] = np.inf
        if edge > low:
            step[:, : edge - low][places[low:edge] < lows[a:b, None]] = np.inf
        top = step.argmin(1)
        least, prev = step[places[: b - a], top].tolist(), (top + low).tolist()
        done: list[float] = []
        for i in range(a, b):
            best, want = least[i - a], xs[i] - share
            for j in range(max(a, low_of[i]), i):
                g = want - xs[j]
                c = done[j - a] + scale * g * g
                if c < best:
                    best, prev[i - a] = c, j
            done.append(best + pen[i])
        cost[a:b], back[a:b] = done, prev
    path, i = [], m - 1
    while i > 0:
        path.append(i)
        i = int(back[i])
    return path[::-1]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of each piece of an oversized text."""
    pos, penalty, kind = boundaries(text, max(1, limit - overlap - HARD_STEP))
    pos = np.concatenate([[0], pos, [len(text)]])
    penalty, kind = np.concatenate([[0.0], penalty, [0.0]]), np.concatenate([[6], kind, [6]])
    out, start = [], 0
    for i in cheapest(pos, penalty, limit, overlap):
        out.append((start, int(pos[i]), KINDS[kind[i]]))
        start = max(0, int(pos[i]) - overlap)
    return out


SCHEMA = T.StructType([
    T.StructField("item_table", T.StringType()),
    T.StructField("item_key", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("piece_no", T.IntegerType()),
    T.StructField("n_pieces", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("cut", T.StringType()),
    T.StructField("piece", T.StringType()),
    T.StructField("unbroken", T.IntegerType()),
])


def split_oversized(items: DataFrame) -> DataFrame:
    """Pieces of every item over its limit.

    `items` has item_table, item_key, field, text, size_limit and overlap. A row comes out for each
    piece, numbered from 1, with its place in the text; texts within the limit, nulls
    and empty texts give none, repeated rows are cut each, other columns are ignored.
    `unbroken` is 1 if the text has a stretch without white space over the limit.
    """
    over = items.select("item_table", "item_key", "field", "text", "size_limit", "overlap").where(F.length("text") > F.col("size_limit"))

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                runs = max(map(len, WHITE_RUN.split(r.text)))
                parts = cut(r.text, r.size_limit, r.overlap)
                for no, (a, b, kind) in enumerate(parts, 1):
                    rows.append((r.item_table, r.item_key, r.field, no, len(parts), a, b, kind, r.text[a:b], int(runs > r.size_limit)))
            yield pd.DataFrame(rows, columns=SCHEMA.names)

    return spread(over).mapInPandas(run, SCHEMA)


def oversized_fields(chunk: DataFrame, search_record: DataFrame, text_limit: int = 1200, text_overlap: int = 100, heading_limit: int = 120, heading_overlap: int = 10) -> DataFrame:
    """The three length-bound fields as items for `split_oversized`."""

    def field(df: DataFrame, name: str, key: str, col: str, limit: int, overlap: int) -> DataFrame:
        return df.select(
            F.lit(name).alias("item_table"),
            F.col(key).cast("string").alias("item_key"),
            F.lit(col).alias("field"),
            F.col(col).alias("text"),
            F.lit(limit).alias("size_limit"),
            F.lit(overlap).alias("overlap"),
        )

    return (
        field(chunk, "chunk", "chunk_id", "text", text_limit, text_overlap)
        .unionAll(field(chunk, "chunk", "chunk_id", "heading", heading_limit, heading_overlap))
        .unionAll(field(search_record, "search_record", "seq", "fragment_text", text_limit, text_overlap))
    )
