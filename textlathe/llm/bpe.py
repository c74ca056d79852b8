"""Byte-level BPE encoding of a corpus by recursive DuckDB queries, one database a worker.

Words are cut by the tokenizer's published pattern. Each worker keeps the words that it
has met; new ones of a chunk become token-position rows, a recursive query joins every
neighbouring pair with the merge table, contracts each word's leftmost pair of least
rank and ends when no word has a pair left.

The query keeps all its steps, so its rows grow with the square of a word's length.
Words are therefore encoded in parts of `PART` bytes, batches are bounded by the rows
that they can give, and parts are joined in pairs: tokens at a seam are encoded anew by
the same query, further to the left where needed, until each two neighbours are what
their joined bytes encode to, which only a word's true encoding fulfils.

Nulls and empty texts give an empty list; texts and words of any length are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textlathe.llm.batches import parts

#: The public tokenizers' folder and the file used unless another is given.
TOKENIZER_DIR = os.environ.get("TEXTLATHE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZER_DIR}/byte_bpe_50k.json"

#: Fixed value: the published word pattern of this family of byte-level tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes encoded at once, and rows that all steps of a query may give together.
PART, STATE_ROWS = 64, 2_000_000
#: Words a worker remembers before it starts afresh, and documents of one chunk.
REMEMBERED, CHUNK = 400_000, 500

STEP = """
    SELECT w, pos, CASE WHEN pos = hit THEN merged ELSE tok END AS tok, step + 1 AS step
    FROM (
        SELECT w, pos, tok, step, merged, before,
               min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY w) AS hit
        FROM (
            SELECT p.w, p.pos, p.tok, p.step, p.before, m.rank, m.merged,
                   min(m.rank) OVER (PARTITION BY p.w) AS best
            FROM (
                SELECT w, pos, tok, step,
                       lead(tok) OVER (PARTITION BY w ORDER BY pos) AS follower,
                       lag(pos) OVER (PARTITION BY w ORDER BY pos) AS before
                FROM {source}
            ) p LEFT JOIN merges m ON p.tok = m.l AND p.follower = m.r
        )
        WHERE best IS NOT NULL
    )
    WHERE before IS NULL OR before <> hit
"""

RECURSIVE = f"""
    WITH RECURSIVE state AS (
        SELECT w, pos, tok, 0 AS step FROM start
        UNION ALL
        ({STEP.format(source="state")})
    ), last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
    SELECT w, list(tok ORDER BY pos) AS toks
    FROM state JOIN last USING (w, step) GROUP BY w
"""

@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(moved)}


def read_tokenizer(path: str = BYTE_BPE) -> dict:
    """Merge table and vocabulary of a byte-level BPE file as plain arrays."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    letters = byte_letters()
    back = {c: b for b, c in letters.items()}
    return {
        "l": np.array([vocab[a] for a, _ in pairs], np.int32),
        "r": np.array([vocab[b] for _, b in pairs], np.int32),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int32),
        "bytes": np.array([vocab[letters[b]] for b in range(256)], np.int32),
        "pieces": {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)},
    }


class Encoder:
    """Encodes words by recursive queries and remembers them; one to a worker."""

    def __init__(self, tok: dict):
        import duckdb
        import regex

        self.find = regex.compile(WORD_PATTERN).findall
        self.byte_ids, self.pieces = tok["bytes"], tok["pieces"]
        self.known: dict[str, bytes] = {}
        self.tokens: dict[bytes, tuple[int, ...]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = pa.table({"l": tok["l"], "r": tok["r"], "merged": tok["merged"], "rank": np.arange(len(tok["l"]), dtype=np.int32)})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, raw: list[bytes]) -> None:
        """Encode byte strings that aren't remembered, by whole sets."""
        fresh = sorted({b for b in raw if b not in self.tokens}, key=len)
        at = 0
        while at < len(fresh):
            end, rows = at, 0
            while end < len(fresh) and (end == at or rows + len(fresh[end]) * (len(fresh[end]) + 1) // 2 <= STATE_ROWS):
                rows += len(fresh[end]) * (len(fresh[end]) + 1) // 2
                end += 1
            part = fresh[at:end]
            sizes = np.array([len(b) for b in part])
            start = pa.table({
                "w": np.repeat(np.arange(len(part), dtype=np.int32), sizes),
                "pos": (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
                "tok": self.byte_ids[np.frombuffer(b"".join(part), np.uint8)],
            })
            self.db.register("start", start)
            got = self.db.sql(RECURSIVE).to_arrow_table()
            self.db.unregister("start")
            lists = got["toks"].combine_chunks()
            ends, ids = lists.offsets.to_pylist(), lists.values.to_pylist()
            for n, w in enumerate(got["w"].to_pylist()):
                self.tokens[part[w]] = tuple(ids[ends[n] : ends[n + 1]])
            at = end

    def join(self, left: list[int], right: list[int]):
        """A coroutine that joins the tokens of two neighbouring parts: asks for the
        encodings of byte strings and returns the tokens of both together."""
        at = 0
        while at < len(right):
            last, nxt = left[-1], right[at]
            if (yield self.pieces[last] + self.pieces[nxt]) == (last, nxt):
                break
            k = 1
            while True:
                made = yield b"".join(self.pieces[t] for t in left[-k:]) + self.pieces[nxt]
                if k >= len(left):
                    left = list(made)
                    break
                before = left[-k - 1]
                if (yield self.pieces[before] + self.pieces[made[0]]) == (before, made[0]):
                    left[-k:] = made
                    break
                k = min(2 * k, len(left))
            at += 1
        return left + right[at:]

    def settle(self, joins: list) -> list[list[int]]:
        """Run coroutines side by side: what all of them ask for is encoded in one set."""
        done: list = [None] * len(joins)
        asked = {n: next(j) for n, j in enumerate(joins)}
        while asked:
            self.contract(list(asked.values()))
            for n in list(asked):
                try:
                    while asked[n] in self.tokens:
                        asked[n] = joins[n].send(self.tokens[asked[n]])
                except StopIteration as end:
                    done[n] = end.value
                    del asked[n]
        return done

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't remembered."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        cut = [[b[at : at + PART] for at in range(0, len(b), PART)] for b in raw]
        self.contract([p for parts_ in cut for p in parts_])
        open_ = {}
        for w, parts_ in zip(words, cut):
            if len(parts_) == 1:
                self.known[w] = np.array(self.tokens[parts_[0]], "<i4").tobytes()
            else:
                open_[w] = [list(self.tokens[p]) for p in parts_]
        while open_:
            pairs = [(w, k) for w, segs in open_.items() for k in range(0, len(segs) - 1, 2)]
            done = iter(self.settle([self.join(open_[w][k], open_[w][k + 1]) for w, k in pairs]))
            for w, segs in list(open_.items()):
                open_[w] = [next(done) for _ in range(len(segs) // 2)] + (segs[-1:] if len(segs) % 2 else [])
                if len(open_[w]) == 1:
                    self.known[w] = np.array(open_.pop(w)[0], "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [self.find(t) if t else [] for t in texts]
        fresh = set().union(*cut) - self.known.keys()
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh = set().union(*cut)
            self.learn(sorted(fresh))
            self.tokens.clear()
        known = self.known.__getitem__
        rows = [b"".join(map(known, words)) for words in cut]
        ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        ids = np.frombuffer(b"".join(rows), "<i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))


@functools.cache
def _encoder(path_key: str) -> list:
    return []


def _worker_encoder(key: str, tok: dict) -> Encoder:
    kept = _encoder(key)
    if not kept:
        kept.append(Encoder(tok))
    return kept[0]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids) for each row of `df`, in its partitions, without a shuffle.

    Null and empty texts have an empty list, null ids stay null, repeated rows are
    encoded each, strings that spell a special token are ordinary text, and columns
    other than the two named play no part. An empty table gives an empty result.
    """
    tok = df.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        encoder = _worker_encoder(path, tok.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for rows in parts(texts, CHUNK):
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([ids, encoder.encode(texts[rows])], names=[id_col, "ids"])

    given = df.select(id_col, df[text_col].cast("string").alias("text"))
    kind = T.StructType([T.StructField(id_col, given.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return given.mapInArrow(run, kind)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(id, text) from token ids: an ordered DuckDB aggregation joins the pieces' bytes.

    Bytes that form no character become U+FFFD, unknown ids vanish, null lists give null.
    """
    pieces = read_tokenizer(path)["pieces"]
    given = df.sparkSession.sparkContext.broadcast((list(pieces), [b.hex() for b in pieces.values()]))

    def run(batches):
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        ids, hexes = given.value
        db.register("vocab_in", pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(hexes)}))
        db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                db.register("rows_in", pa.table({"n": np.arange(part.num_rows), "ids": part.column(1)}))
                got = dict(db.execute("""
                    SELECT n, string_agg(piece, '' ORDER BY pos) FROM (
                        SELECT n, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM rows_in
                    ) JOIN vocab USING (id) GROUP BY n
                """).fetchall())
                nulls = part.column(1).is_null().to_pylist()
                texts = [None if nulls[n] else bytes.fromhex(got.get(n) or "").decode("utf-8", "replace") for n in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    picked = df.select(id_col, ids_col)
    return picked.mapInArrow(run, T.StructType([T.StructField(id_col, picked.schema[0].dataType), T.StructField("text", T.StringType())]))
