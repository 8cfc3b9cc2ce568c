"""Benchmark decontamination: windows of benchmark words are found in documents, by hash and then by their bytes.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A benchmark item gives each of
its windows of `size` consecutive words; an item of fewer words is one window. The windows go out as broadcast hash sets
of bounded size: one as a rule, more than one pass over the documents where they don't fit. A document's windows are
looked up by the polynomial hash of their normalised bytes, and each match is compared byte by byte.

Defined results: a null or empty text has no words and no hit; a null or wordless item has no window; the windows of an
item whose id is null hit words but are in no list; rows that repeat an item count once, rows that repeat a document
are each scanned; an empty table on either side gives no hits; input columns that have the name of an added column are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stowage.llm.common import cut, without
from stowage.llm.hashing import Prefix, joined

SIZE = 10
ADDED = ["n_words", "n_hit", "items", "spans"]
#: Bytes of text that are worked on at a time, and words whose windows are hashed at a time.
CHUNK, BLOCK = 4 << 20, 1 << 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
SPACE = 0x20


class Words:
    """The words of some texts: text t has words first[t] to first[t + 1], word i lies at starts[i]:ends[i] of the joined texts and at begin[i]:stop[i] of norm.

    norm holds the words alone, lower-cased, with one space after each, so that any window is one span of it.
    """

    def __init__(self, texts: list[bytes]):
        data, self.at = joined([t + b" " for t in texts])
        data = LOWER[data]
        inside = IN_WORD[data]
        before = np.concatenate([[False], inside[:-1]])
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
        keep = inside
        keep[self.ends] = True
        self.norm = data[keep]
        sizes = self.ends - self.starts + 1
        self.begin = np.cumsum(sizes) - sizes
        self.stop = self.begin + sizes - 1
        self.norm[self.stop] = SPACE
        self.first = np.searchsorted(self.starts, self.at)

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of first words, hashes of windows) of the windows of `size` words that lie in one text, a block at a time."""
        last = np.repeat(self.first[1:], np.diff(self.first)) - size
        for a in range(0, len(self.starts), BLOCK):
            at = a + np.flatnonzero(np.arange(a, min(a + BLOCK, len(self.starts))) <= last[a : a + BLOCK])
            if len(at):
                low, high = self.begin[at[0]], self.stop[at[-1] + size - 1]
                yield at, Prefix(self.norm[low:high]).hash(self.begin[at] - low, self.stop[at + size - 1] - low)


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether spans of a and b of these (positive) sizes hold equal bytes; about `most` bytes are compared at a time."""
    out, upto = np.zeros(len(sizes), dtype=bool), np.cumsum(sizes)
    group = (upto - sizes) // most
    for g in np.unique(group):
        i = np.flatnonzero(group == g)
        begins = np.cumsum(sizes[i]) - sizes[i]
        within = np.arange(sizes[i].sum()) - np.repeat(begins, sizes[i])
        out[i] = np.logical_and.reduceat(a[np.repeat(a_at[i], sizes[i]) + within] == b[np.repeat(b_at[i], sizes[i]) + within], begins)
    return out


class WindowSet:
    """A hash set of windows of one number of words, with the items of each."""

    def __init__(self, windows: list[bytes], items: list[list]):
        self.data, at = joined(windows)
        keys = Prefix(self.data).hash(at[:-1], at[1:])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.sizes = keys[order], at[:-1][order], np.diff(at)[order]
        self.items = [items[i] for i in order]
        self.bits = 64 - max(10, min(26, int(len(windows)).bit_length() + 6))
        self.seen = np.zeros(1 << (64 - self.bits), dtype=bool)
        self.seen[self.keys >> np.uint64(self.bits)] = True

    def find(self, words: Words, at: np.ndarray, hashes: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, entries) of the windows that are in the set, verified; windows of one hash are tried one after another."""
        may = np.flatnonzero(self.seen[hashes >> np.uint64(self.bits)])
        at, hashes = at[may], hashes[may]
        entry, end = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, side="right")
        while (live := np.flatnonzero(entry < end)).size:
            at, entry, end = at[live], entry[live], end[live]
            sizes = words.stop[at + size - 1] - words.begin[at]
            alike = np.flatnonzero(sizes == self.sizes[entry])
            good = alike[same_spans(words.norm, words.begin[at[alike]], self.data, self.at[entry[alike]], sizes[alike])]
            yield at[good], entry[good]
            entry = entry + 1


def benchmark_windows(bench: DataFrame, size: int = SIZE, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words int, win binary, item): the windows of each item, each once."""
    item = bench.schema[item_col].dataType
    rows = bench.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("raw")).filter("raw IS NOT NULL")
    schema = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("win", T.BinaryType()), T.StructField("item", item)])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in enumerate(b.column("raw")):
                w = Words([raw.as_py()])
                n, norm = min(size, len(w.starts)), w.norm.tobytes()
                for i in range(0, len(w.starts) - n + 1 if n else 0, BLOCK):
                    wins = [norm[w.begin[j] : w.stop[j + n - 1]] for j in range(i, min(i + BLOCK, len(w.starts) - n + 1))]
                    item = b.column("item").take(pa.array([k] * len(wins)))
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(wins), pa.int32()), pa.array(wins, pa.binary()), item], names=["words", "win", "item"])

    return rows.mapInArrow(go, schema).distinct()


def window_sets(windows: DataFrame, most_windows: int, most_bytes: int) -> Iterator[dict[int, WindowSet]]:
    """The sets of all windows by number of words, in blocks of about most_windows and most_bytes, one after another."""
    rows = cut(windows)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("win")), F.lit(0))).first()
    blocks = max(1, -(-n // most_windows), -(-total // most_bytes))
    for k in range(blocks):
        found: dict[int, dict[bytes, list]] = {}
        block = rows.filter(F.pmod(F.xxhash64("win", "item"), F.lit(blocks)) == k)
        for r in block.toArrow().to_pylist():
            own = found.setdefault(r["words"], {}).setdefault(r["win"], [])
            if r["item"] is not None:
                own.append(r["item"])
        yield {size: WindowSet(list(wins), list(wins.values())) for size, wins in found.items()}


def scan_texts(texts: list[bytes], sets: dict[int, WindowSet], before: list[tuple[list, set]] | None = None) -> tuple[np.ndarray, list[tuple[list, set]], list[list[tuple[int, int]]]]:
    """(numbers of words, runs of hit words and items of each text, byte spans of the runs). before: runs and items that other sets have found."""
    words, n = Words(texts), len(texts)
    marks = np.zeros(len(words.starts) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in range(n)]
    for t, (own, known) in enumerate(before or []):
        items[t] |= known
        for a, b in own:
            marks[words.first[t] + a] += 1
            marks[words.first[t] + b] -= 1
    for size, known in sets.items():
        for at, hashes in words.windows(size):
            for good, entry in known.find(words, at, hashes, size):
                np.add.at(marks, good, 1)
                np.subtract.at(marks, good + size, 1)
                text = np.searchsorted(words.first, good, side="right") - 1
                for pair in np.unique(text * len(known.keys) + entry):
                    items[pair // len(known.keys)].update(known.items[pair % len(known.keys)])
    hit = np.cumsum(marks[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    # a window ends with its text, but runs of two texts can touch
    inner = words.first[1:-1]
    inner = inner[(inner > 0) & (inner < len(hit))]
    inner = np.unique(inner[hit[inner] & hit[inner - 1]])
    begins, stops = np.sort(np.concatenate([edge[::2], inner])), np.sort(np.concatenate([edge[1::2], inner]))
    runs: list[list] = [[] for _ in range(n)]
    spans: list[list] = [[] for _ in range(n)]
    for t, a, b in zip(np.searchsorted(words.first, begins, side="right") - 1, begins, stops, strict=True):
        runs[t].append((int(a - words.first[t]), int(b - words.first[t])))
        spans[t].append((int(words.starts[a] - words.at[t]), int(words.ends[b - 1] - words.at[t])))
    return np.diff(words.first), list(zip(runs, items, strict=True)), spans


def less(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def parts_of(col: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, values) in lists of about CHUNK bytes, null as empty."""
    at, held, size = 0, [], 0
    for v in col:
        held.append(v.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = at + len(held), [], 0
    yield at, held


def scan(
    docs: DataFrame,
    bench: DataFrame,
    *,
    size: int = SIZE,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    text: str | None = None,
    most_windows: int = 1 << 20,
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """docs less its text, with n_words, n_hit (words in a window of the benchmark), items (sorted as strings) and spans (bytes begin to stop of the maximal runs of hit words).

    text="whole" leaves the text as it is, "clean" leaves what lies outside of the spans. Documents pass once for each
    block of at most about most_windows windows and most_bytes bytes of them.
    """
    item = bench.schema[item_col].dataType
    kept = without(docs, [*ADDED, "_raw", "_runs", text_col])
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType())]))
    added = [T.StructField("_raw", T.BinaryType()), T.StructField("_runs", span), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item)), T.StructField("spans", span)]
    schema = T.StructType([*kept.schema.fields, *added])
    item_kind, pair = to_arrow_type(item), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
    pairs = lambda rows: pa.array([[{"begin": a, "stop": b} for a, b in r] for r in rows], pair)
    context = docs.sparkSession.sparkContext

    def one_pass(rows: DataFrame, sets: dict[int, WindowSet], first: bool, last: bool) -> DataFrame:
        spread = context.broadcast(sets)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rest = b.select([c for c in b.schema.names if c not in {f.name for f in added}])
                for at, texts in parts_of(b.column("_raw")):
                    own = b.slice(at, len(texts))
                    before = None if first else [([(x["begin"], x["stop"]) for x in runs], set(items)) for runs, items in zip(own.column("_runs").to_pylist(), own.column("items").to_pylist(), strict=True)]
                    n_words, found, spans = scan_texts(texts, spread.value, before)
                    raw = own.column("_raw")
                    if last and text is None:
                        raw = pa.nulls(len(texts), pa.binary())
                    elif last and text == "clean":
                        raw = pa.array([v if not s else less(v, s) for v, s in zip(raw.to_pylist(), spans, strict=True)], pa.binary())
                    n_hit = [sum(b - a for a, b in runs) for runs, _ in found]
                    items = pa.array([sorted(i, key=str) for _, i in found], pa.list_(item_kind))
                    columns = [raw, pairs([] if last else runs for runs, _ in found), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), items, pairs(spans)]
                    yield pa.RecordBatch.from_arrays([*rest.slice(at, len(texts)).columns, *columns], names=[*rest.schema.names, *(f.name for f in added)])

        return rows.mapInArrow(go, schema)

    rows = without(docs, [*ADDED, "_raw", "_runs"]).withColumn("_raw", F.col(text_col).cast("binary")).drop(text_col)
    ahead = None
    for sets in window_sets(benchmark_windows(bench, size, item_col=item_col, text_col=item_text_col), most_windows, most_bytes):
        if ahead is not None:
            rows = cut(one_pass(rows, ahead, "_runs" not in rows.columns, False))
        ahead = sets
    rows = one_pass(rows, ahead, "_runs" not in rows.columns, True)
    out = rows.drop("_raw", "_runs")
    return out if text is None else rows.withColumn(text_col, F.col("_raw").cast("string")).select(*kept.columns, text_col, *ADDED)


def remove_spans(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """docs with every run of hit words cut out of its text, between the first word's start and the last word's end."""
    return scan(docs, bench, text="clean", **options).drop(*ADDED).select(*[c for c in docs.columns if c.lower() not in ADDED])


def remove_documents(docs: DataFrame, bench: DataFrame, *, least: int = 1, **options) -> DataFrame:
    """docs without those that have `least` hit words or more."""
    return scan(docs, bench, text="whole", **options).filter(F.col("n_hit") < least).drop(*ADDED).select(*[c for c in docs.columns if c.lower() not in ADDED])
