"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Text splits by the tokenizer's pattern. Pieces that the vocabulary doesn't hold whole become token-position rows; a
recursive query joins neighbours with the merge table and contracts each piece's leftmost pair of lowest rank until no
piece has a pair left. Pieces repeat, so each batch sends only pieces that it hasn't seen. Decoding joins token-position
rows with the vocabulary and aggregates their bytes in order. Neither step shuffles: every row is encoded where it lies.

The recursive query is keyed by position: it holds each token's latest state and works on the rows of the last round, so
memory is linear in the bytes of a batch, however long a piece. A piece of n bytes takes at most n rounds over its live tokens.

Defined results: a null text is empty and has no ids; bytes that aren't UTF-8 survive the round trip; ids that are null
or outside the vocabulary raise an error; an empty table gives an empty result; other columns pass through unchanged,
and columns that have the name of an added one are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import without

#: Bytes of text that are split and looked up at a time, bytes of pieces that one query takes, and pieces that a task remembers.
CHUNK, BATCH, REMEMBERED = 2 << 20, 1 << 18, 600_000

#: start holds (piece, pos, id); positions run on from piece to piece, so one order serves all. A token that its left neighbour took in has id -1.
ENCODE = """
WITH RECURSIVE step(pos, piece, id, round) USING KEY (pos) AS (
  SELECT pos, piece, id, 0 FROM start
  UNION
  (WITH pair AS (
     SELECT piece, pos, id, round, CASE WHEN lead(piece) OVER w = piece THEN lead(id) OVER w END AS next_id, CASE WHEN lag(piece) OVER w = piece THEN lag(pos) OVER w END AS prev_pos
     FROM step WHERE id >= 0 WINDOW w AS (ORDER BY pos)),
   ranked AS (SELECT piece, pos, id, round, prev_pos, (merged::BIGINT << 32) | pos AS key FROM pair LEFT JOIN merges ON id = a AND next_id = b),
   lowest AS (SELECT piece, min(key) AS best FROM ranked WHERE key IS NOT NULL GROUP BY piece)
   SELECT pos, r.piece, CASE WHEN pos = (best & 4294967295) THEN (best >> 32)::INT WHEN prev_pos = (best & 4294967295) THEN -1 ELSE id END, round + 1
   FROM ranked r JOIN lowest l ON r.piece = l.piece))
SELECT piece, id FROM step WHERE id >= 0 ORDER BY pos
"""
DECODE = """
SELECT row, string_agg(vocabulary.chars, '' ORDER BY pos) AS chars, count(*) AS n
FROM tokens JOIN vocabulary USING (id) GROUP BY row
"""


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    """The vocabulary: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip())]


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens that together are a token: ids a and b of both and merged of the whole."""
    rows = array("i")
    for t, r in ranks.items():
        for i in range(1, len(t)):
            if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                rows.extend((a, b, r))
    cols = np.frombuffer(rows, dtype=np.int32).reshape(-1, 3)
    return pa.table({name: np.ascontiguousarray(cols[:, k]) for k, name in enumerate(("a", "b", "merged"))})


class Encoder:
    """One task's DuckDB connection with the merge table, and the pieces that it has encoded."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import duckdb
        import regex

        self.ranks = dict(ranks)
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.seen: dict[str, bytes] = {}  # ids as int32
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("merge_rows", merge_table(self.ranks))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.con.unregister("merge_rows")

    def learn(self, pieces: Iterable[str]) -> None:
        work: list[tuple[str, bytes]] = []
        for p in pieces:
            raw = p.encode("utf-8", "surrogateescape")
            if (whole := self.ranks.get(raw)) is not None:
                self.seen[p] = array("i", (whole,)).tobytes()
            else:
                work.append((p, raw))
        upto = np.cumsum([len(raw) for _, raw in work])
        at = 0
        while at < len(work):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH, side="right")))
            part, at = work[at:to], to
            sizes = np.array([len(raw) for _, raw in part])
            ids = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in part), dtype=np.uint8)]
            start = pa.table({"piece": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids})
            self.con.register("start", start)
            got = self.con.sql(ENCODE).to_arrow_table()
            packed = got["id"].to_numpy().astype(np.int32).tobytes()
            bounds = (4 * np.searchsorted(got["piece"].to_numpy(), np.arange(len(part) + 1))).tolist()
            for i, (p, _) in enumerate(part):
                self.seen[p] = packed[bounds[i] : bounds[i + 1]]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        pieces = [self.split(t.decode("utf-8", "surrogateescape")) for t in texts]
        here = set(chain.from_iterable(pieces))
        if len(self.seen) > REMEMBERED:  # the frequent ones stay
            self.seen = {p: self.seen[p] for p in here if p in self.seen}
        self.learn(here.difference(self.seen))
        look = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(look, own)), dtype=np.int32) for own in pieces]


class Decoder:
    """The vocabulary as a DuckDB table, bytes as characters of the same number."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB"})
        self.con.register("words", pa.table({"id": pa.array([r for _, r in ranks], pa.int32()), "chars": [t.decode("latin-1") for t, _ in ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.con.unregister("words")

    def decode(self, col: pa.Array) -> list[bytes | None]:
        """The bytes of each list of ids."""
        every: list[bytes | None] = []
        for at, size in spans(col):
            ids = col.slice(at, size)
            flat, counts = ids.flatten(), [len(v) if v.is_valid else 0 for v in ids]
            tokens = {"row": np.repeat(np.arange(size, dtype=np.int32), counts), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}
            self.con.register("tokens", pa.table(tokens))
            got = self.con.sql(DECODE).to_arrow_table()
            if sum(got["n"].to_pylist()) != len(flat):
                raise ValueError("token ids outside the vocabulary")
            out = [b"" if valid else None for valid in ids.is_valid().to_pylist()]
            for row, chars in zip(got["row"].to_pylist(), got["chars"].to_pylist(), strict=True):
                out[row] = chars.encode("latin-1")
            every += out
        return every


#: The coders of a Python worker last from task to task: what they have learnt is a cache, never a result.
CODERS: dict[object, tuple[Encoder, Decoder]] = {}


def coders(key: object, ranks: list[tuple[bytes, int]], pattern: str) -> tuple[Encoder, Decoder]:
    if key not in CODERS:
        CODERS.clear()
        CODERS[key] = Encoder(ranks, pattern), Decoder(ranks)
    return CODERS[key]


def chunks(col: pa.Array) -> Iterator[list[bytes]]:
    """The values, null as empty, in lists of about CHUNK bytes."""
    held, size = [], 0
    for v in col:
        raw = v.as_py() or b""
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    yield held


def spans(ids: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices with about `most` ids."""
    sizes = np.array([len(v) if v.is_valid else 0 for v in ids], dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield int(at[0]), len(at)


def encode(df: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, lasting: bool = True) -> DataFrame:
    """df with ids array<int>; with decoded_col also what the ids decode to, in the same pass.

    lasting: coders stay in their Python worker for its next task; without, each task returns their memory at its end.
    The vocabulary, of a fixed size, goes to the executors as a broadcast variable.
    """
    spread = df.sparkSession.sparkContext.broadcast(ranks)
    key = (hashlib.sha256(repr(ranks).encode()).hexdigest(), pattern)
    rows = without(df, [ids_col, "_raw", *([decoded_col] if decoded_col else [])]).withColumn("_raw", F.col(text_col).cast("binary"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder, decoder = coders(key, spread.value, pattern)
            done, raw, rest = 0, b.column("_raw"), b.drop_columns(["_raw"])
            for part in chunks(raw):
                ids = encoder.encode(part)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
                out = rest.slice(done, len(part)).append_column(ids_col, col)
                yield out.append_column(decoded_col, pa.array(decoder.decode(col), pa.binary())) if decoded_col else out
                done += len(part)
        if not lasting:
            CODERS.clear()
            pa.default_memory_pool().release_unused()

    fields = [f for f in rows.schema.fields if f.name != "_raw"] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(go, T.StructType(fields + ([T.StructField(decoded_col, T.BinaryType())] if decoded_col else [])))


def decode(df: DataFrame, ranks: list[tuple[bytes, int]], *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with decoded binary, from array<int>: null ids decode to null, no ids to no bytes."""
    spread = df.sparkSession.sparkContext.broadcast(ranks)
    rows = without(df, [bytes_col])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(spread.value)
        for b in batches:
            yield b.append_column(bytes_col, pa.array(decoder.decode(b.column(ids_col)), pa.binary()))

    return rows.mapInArrow(go, T.StructType([*rows.schema.fields, T.StructField(bytes_col, T.BinaryType())]))
