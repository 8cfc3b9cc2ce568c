"""Periodic runs of words in texts, by the runs theorem.

A run is a maximal stretch of words that repeats with a smallest period. Each run that holds its period twice has a root
that is the longest Lyndon word at its start, in the order of words or in the reverse order; a position's longest Lyndon
word ends before the next suffix that is smaller in that order. So: suffix ranks by prefix doubling, next smaller and next
greater ranks, then each root is extended both ways by common extensions, which are range minima of the LCP array (of the
texts, and of the texts reversed) in a sparse table. Many short texts are worked on together, text by text in order.

A text's words, ranks and tables lie in its task: about 200 bytes a word of the longest text.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; equal
texts give equal values; rows that repeat an id are each judged; an empty table gives an empty result; input columns that
have the name of an added column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import without

ADDED = ["runs", "collapsed"]
#: Words that are worked on together, if no text has more.
CHUNK = 1 << 17
#: Places that are tried one by one before the table of minima is asked.
NEAR = 16


class Suffixes:
    """Ranks of the suffixes of all texts: text by text, then by words, the shorter first. rank is the inverse suffix array.

    levels[k] numbers the stretches of 2**k words: two suffixes of one text agree in so many words where the numbers do.
    """

    def __init__(self, ids: np.ndarray, text: np.ndarray, end: np.ndarray):
        n = len(ids)
        self.end, self.text = end, text
        key = text * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key)
        rank, alone = self.grouped(order, key[order], np.zeros(n, dtype=np.int64), np.arange(n))
        self.levels, width = [rank], 1
        live = np.flatnonzero(~alone)
        while len(live):
            there = live + width
            inside = there < end[live]
            second = np.where(inside, rank[np.where(inside, there, 0)] + 1, 0)
            key = rank[live].astype(np.int64) * (n + 1) + second
            order = np.argsort(key)
            live = live[order]
            own = rank[live].astype(np.int64)
            rank = rank.copy()
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            within = np.arange(len(live)) - np.repeat(first, np.diff(np.concatenate([first, [len(live)]])))
            moved, alone = self.grouped(np.arange(len(live)), key[order], own, within)
            rank[live] = moved
            self.levels.append(rank)
            live = np.sort(live[~alone])
            width *= 2
        self.rank = rank

    @staticmethod
    def grouped(order: np.ndarray, key: np.ndarray, base: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank: base + place of the first of its equal keys, whether it has no equal), for the keys in sorted order."""
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        first = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        rank, alone = np.empty(len(key), dtype=np.int32), np.empty(len(key), dtype=bool)
        rank[order] = np.repeat((base + place)[first], sizes)
        alone[order] = np.repeat(sizes == 1, sizes)
        return rank, alone

    def lcp(self) -> np.ndarray:
        """How many words each suffix shares with the one before it in order; 0 at a text's first."""
        n = len(self.rank)
        suffix = np.empty(n, dtype=np.int64)
        suffix[self.rank] = np.arange(n)
        out = np.zeros(n, dtype=np.int32)
        at = 1 + np.flatnonzero(self.levels[0][suffix[1:]] == self.levels[0][suffix[:-1]])
        for k in range(len(self.levels)):
            a, b = suffix[at], suffix[at - 1]
            more = self.levels[k + 1][a] == self.levels[k + 1][b] if k + 1 < len(self.levels) else np.zeros(len(at), dtype=bool)
            done, a, b = at[~more], a[~more] + (1 << k), b[~more] + (1 << k)
            out[done] = 1 << k
            for j in range(k - 1, -1, -1):
                inside = (a < self.end[suffix[done]]) & (b < self.end[suffix[done]])
                a_in, b_in = np.where(inside, a, 0), np.where(inside, b, 0)
                step = (inside & (self.levels[j][a_in] == self.levels[j][b_in])).astype(np.int64) << j
                out[done] += step.astype(np.int32)
                a, b = a + step, b + step
            at = at[more]
        return out


def minima(v: np.ndarray) -> list[np.ndarray]:
    """The sparse table of range minima: level k holds the least of each 2**k neighbours."""
    table, width = [v], 1
    while 2 * width <= len(v):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


class Extensions:
    """Common extensions of two places of one text, as range minima of the LCP array."""

    def __init__(self, suffixes: Suffixes):
        self.rank, self.table = suffixes.rank, minima(suffixes.lcp())

    def words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b share; a is never b."""
        x, y = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.table[k][low[i]], self.table[k][high[i] - (1 << k) + 1])
        return out


def next_smaller(v: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place the first later one of its text with a smaller value, or the text's end."""
    out = np.arange(1, len(v) + 1)
    live = np.arange(len(v))
    for _ in range(NEAR):
        inside = out[live] < end[live]
        live = live[inside]
        live = live[v[out[live]] > v[live]]
        out[live] += 1
    if len(live):
        at, own, stop = out[live], v[live], end[live]
        for k, table in reversed(list(enumerate(minima(v)))):
            fits = at + (1 << k) <= stop
            at[fits & (table[np.where(fits, at, 0)] > own)] += 1 << k
        out[live] = at
    return out


def runs_of(ids: np.ndarray, first: np.ndarray, exponent: int = 2, least: int = 2) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text t, ids[first[t]:first[t + 1]], by start and period.

    A run counts if it has at least exponent (2 or more) times its period and least words. The leftmost root of such
    a run starts within its first period, so the words after that root repeat for exponent - 2 periods and one word more.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    if not len(ids):
        return out
    suffixes = Suffixes(ids, text, end)
    places = np.arange(len(ids))
    roots = []
    for v in (suffixes.rank, -suffixes.rank):
        period = next_smaller(v, end) - places
        at = places[places + period < end]
        at = at[ids[at] == ids[at + period[at]]]
        roots.append(np.stack([at, period[at]]))
    at, period = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not len(at):
        return out
    # the rest looks at the texts that have a root whose next word repeats
    chosen, t = np.unique(text[at], return_inverse=True)
    took = np.concatenate([np.arange(first[c], first[c + 1]) for c in chosen])
    shift = np.cumsum(np.diff(first)[chosen]) - np.diff(first)[chosen]  # where each chosen text begins now
    at = at - first[chosen][t] + shift[t]
    ids, own = ids[took], np.repeat(np.arange(len(chosen)), np.diff(first)[chosen])
    begin, end = shift[own], (shift + np.diff(first)[chosen])[own]
    n = len(ids)
    ahead = Extensions(Suffixes(ids, own, end)).words(at, at + period)
    keep = ahead >= (exponent - 2) * period + 1
    at, period, ahead = at[keep], period[keep], ahead[keep]
    if not len(at):
        return out
    back = np.zeros(len(at), dtype=np.int64)
    inner = np.flatnonzero(at > begin[at])
    if len(inner):
        turned = Suffixes(ids[::-1], (len(chosen) - 1 - own)[::-1], (n - begin)[::-1])
        back[inner] = Extensions(turned).words(n - at[inner], n - at[inner] - period[inner])
    start, length = at - back, back + period + ahead
    good = length >= np.maximum(least, exponent * period)
    found = np.unique(np.stack([start[good], period[good], length[good]]), axis=1)
    for s, p, m in found.T.tolist():
        out[chosen[own[s]]].append((s - int(begin[s]), m, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, less those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for s, m, p in runs:
        marks[s + p] += 1
        marks[s + m] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0))


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers: equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for words in texts for w in words], dtype=np.int64)


def word_parts(col: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each text) in lists of about CHUNK words, null as empty. bytes.split parts words at ASCII white space alone."""
    at, held, size = 0, [], 0
    for v in col:
        held.append((v.as_py() or b"").split())
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = at + len(held), [], 0
    yield at, held


def find_runs(docs: DataFrame, *, text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """docs less its text, with runs array<struct<start, length, period>> (by start and period, in words from 0) and collapsed, the text less what runs repeat."""
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    rows = without(docs, [*ADDED, "_raw"]).withColumn("_raw", F.col(text_col).cast("binary")).drop(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = b.drop_columns(["_raw"])
            for at, texts in word_parts(b.column("_raw")):
                found = runs_of(numbered(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]), exponent, least)
                less = pa.array([collapsed(t, r) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
                runs = pa.array([[{"start": s, "length": m, "period": p} for s, m, p in r] for r in found], kind)
                yield pa.RecordBatch.from_arrays([*rest.slice(at, len(texts)).columns, runs, less], names=[*rest.schema.names, *ADDED])

    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    kept = rows.drop("_raw")
    return rows.mapInArrow(go, T.StructType([*kept.schema.fields, T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]))


def longest(runs: Column) -> Column:
    """The run of greatest length, of equals the first by start and period; null without runs."""
    keyed = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    top = F.array_max(keyed)
    return F.when(top.isNotNull(), F.struct((-top["start"]).alias("start"), top["length"].alias("length"), (-top["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """A line 'start,length,period' for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def looped(text: Column, seed: Column, word: str = r"[^\x20\x09-\x0D]+") -> Column:
    """A text whose words from some place on repeat a stretch of it, both drawn from a non-negative seed; for tests of runs on real texts. A text without words stays."""
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    n = F.size(words)
    a = (seed % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + seed % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)
