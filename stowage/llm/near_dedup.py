"""MinHash near-dedup with odd sketches: every document gets the smallest id that a chain of similar texts reaches.

A document's set are its distinct five-word shingles, as 64-bit hashes. Documents with equal sets are one class, and only
classes go on. ROWS MinHash samples of a set for each band give its band keys, and the first SAMPLES folded into a bitmap
by parity its odd sketch: the XOR of two sketches has so many bits as the samples differ, which tells high similarities precisely. Classes
that share a band key are candidates; those whose sizes or sketches can't reach the threshold go; the rest is confirmed
on the full sets of the whole texts.

A bucket is never expanded into all its pairs. Its lowest class is compared with the others (a star). Once links
have made components, only members outside of the bucket's largest component are compared with members of other
components: whatever pair is left out is connected already. So no connection is lost, and a group of n near copies costs
about n comparisons.

There are so many bands that a pair at the threshold shares no key with a probability of at most MISSED: 25 at 0.85, 37 at
0.8, (1 - 0.8**ROWS)**37 = 4e-7. Its sketch (SLACK standard deviations) drops it with less than 3e-7.

Defined results: without words or text, a document has the empty set and is linked with nothing; with fewer than five
words, the whole sequence is its one shingle; rows with a null id are kept and in no component (null); rows that repeat
an id are judged by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut
from stowage.llm.components import connected_components, extended
from stowage.llm.hashing import WORD_GAP, Prefix, joined, mix, powers, runs

SHINGLE, BANDS, ROWS = 5, 25, 5
SAMPLES = BANDS * ROWS
#: The most that a pair at the threshold may have as its probability to share no band key.
MISSED = 5e-7
#: Bits of the sketch that every set has, and samples and bits of the finer one for sets in unresolved buckets.
SKETCH_BITS, FINE_SAMPLES, FINE_BITS = 256, 2048, 4096
SLACK = 5
CHUNK = 1 << 20
STEP = powers(np.uint64(0xA24BAED4963EE407), SHINGLE)
_DRAW = np.random.default_rng(7)
MULTIPLIERS = _DRAW.integers(1, 2**63, FINE_SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _DRAW.integers(0, 2**63, FINE_SAMPLES, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, bounds = joined([t.lower() for t in texts])  # bytes.lower() changes A to Z only
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * len(texts)
    start, end = runs(~WORD_GAP[data], bounds)
    words = mix(Prefix(data).hash(start, end))
    first = np.searchsorted(start, bounds)
    n = len(words)
    every = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        every += words[j : n - SHINGLE + 1 + j] * STEP[j]
    every = mix(every)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= SHINGLE:
            out.append(np.unique(every[s : e - SHINGLE + 1]))
        elif e > s:
            short = (words[s:e] * STEP[: e - s]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.array([e - s], np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        else:
            out.append(none)
    return out


def minhashes(sets: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """(sets, samples); every set has an element."""
    x = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), samples), np.uint64)
    for i in range(samples):
        out[:, i] = np.minimum.reduceat(x * MULTIPLIERS[i] + OFFSETS[i], begins)
    return out


def bands_for(percent: int) -> int:
    """The bands that a threshold needs."""
    agree = (percent / 100) ** ROWS
    return 1 if agree >= 1 else int(np.ceil(np.log(MISSED) / np.log1p(-agree)))


def band_keys(samples: np.ndarray) -> np.ndarray:
    bands = samples.shape[1] // ROWS
    key = np.zeros((len(samples), bands), np.uint64)
    for r in range(ROWS):
        key = mix(key + samples[:, r::ROWS][:, :bands] * np.uint64(2 * r + 3))
    return mix(key + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(sets, bits / 64) words: sample i of value v flips bit h(i, v)."""
    n, k = samples.shape
    bit = (mix(samples + np.arange(k, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.int64) % bits
    flips = np.bincount((bit + bits * np.arange(n)[:, None]).ravel(), minlength=n * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, bits), axis=1).view(np.uint64)


def most_different_bits(percent: int, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """The most bits that two sketches of a pair at the threshold may differ by, with SLACK standard deviations to spare.

    Of all samples, Binomial(1 - J) differ; each flips two bits, and 2m flips leave bits / 2 * (1 - exp(-4m / bits)) set.
    Both draws spread: the samples by their binomial, the bits by their occupancy.
    """
    apart = 1 - percent / 100
    m, load = samples * apart, 2 * samples * apart / bits
    odd = (1 - np.exp(-2 * load)) / 2
    by_samples = 2 * np.exp(-2 * load) * np.sqrt(samples * apart * (1 - apart))
    by_bits = bits * (odd * (1 - odd) - load * np.exp(-4 * load))
    return int(np.ceil(bits / 2 * (1 - np.exp(-4 * m / bits)) + SLACK * np.sqrt(by_samples**2 + by_bits)))


FINE = [f"f{i}" for i in range(FINE_BITS // 64)]
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
SIGNATURE = "doc_id long, n_shingles long, cls long, " + ", ".join(f"{s} long" for s in SKETCH) + ", bands array<long>"


def in_chunks(raw: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for v in raw:
        held.append(v.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    yield held


def class_of(s: np.ndarray) -> np.uint64:
    """One hash for a set: of the sum and the xor of its mixed elements, and its size."""
    m = mix(s)
    both = np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(m)])
    return mix(both[:1] + both[1:] * np.uint64(3) + np.array([len(s)], np.uint64))[0]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands_each: int = BANDS) -> DataFrame:
    """One row a document: set size, class, sketch and band keys (none for the empty set)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in in_chunks(b.column("raw")):
                if not texts:
                    continue
                sets = shingle_sets(texts)
                full = [i for i, s in enumerate(sets) if len(s)]
                sketch = np.zeros((len(texts), len(SKETCH)), np.uint64)
                cls = np.zeros(len(texts), np.uint64)
                count = np.zeros(len(texts), np.int64)
                keys = np.zeros((0, bands_each), np.uint64)
                if full:
                    samples = minhashes([sets[i] for i in full], max(SAMPLES, bands_each * ROWS))
                    sketch[full], keys = odd_sketches(samples[:, :SAMPLES]), band_keys(samples[:, : bands_each * ROWS])
                    cls[full] = [class_of(sets[i]) for i in full]
                    count[full] = bands_each
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                cols = [b.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls.view(np.int64)), *(pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(len(SKETCH))), bands]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "cls", *SKETCH, "bands"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(go, SIGNATURE)


def differing_bits(left: str, right: str, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}")))
    return total


def may_link(left: str, right: str, words: list[str], percent: int, most: int) -> Column:
    """Neither the sizes nor the sketches rule the pair out."""
    n, m = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (differing_bits(left, right, words) <= most)


def fine_sketches(texts: DataFrame) -> DataFrame:
    """(cls, n_shingles, f0...) of the finer sketch, from (cls, raw)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in in_chunks(b.column("raw")):
                if part:
                    sets = shingle_sets(part)
                    words = odd_sketches(minhashes(sets, FINE_SAMPLES), FINE_BITS)
                    cols = [b.column("cls").slice(at, len(part)), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(len(FINE)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["cls", "n_shingles", *FINE])
                    at += len(part)

    return texts.mapInArrow(go, "cls long, n_shingles long, " + ", ".join(f"{w} long" for w in FINE))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold. Texts meet pair by pair; no group is gathered."""
    a, b = texts.toDF("u", "u_raw"), texts.toDF("v", "v_raw")
    rows = pairs.select("u", "v").join(b, "v").join(a, "u")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            keep = []
            for i, (u, u_raw, v_raw) in enumerate(zip(batch.column("u").to_pylist(), batch.column("u_raw"), batch.column("v_raw"), strict=True)):
                if u != last:
                    last, one = u, shingle_sets([u_raw.as_py()])[0]
                other = shingle_sets([v_raw.as_py()])[0]
                at = np.searchsorted(one, other)
                shared = int((one[np.minimum(at, len(one) - 1)] == other).sum())
                if 100 * shared >= percent * (len(one) + len(other) - shared):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(go, "u long, v long")


def link_classes(classes: DataFrame, texts_of, percent: int) -> DataFrame:
    """(cls, root) for classes that are linked with another; classes: cls, doc_id, n_shingles, sketch, bands.

    texts_of gives (cls, raw) for a table of (cls, doc_id).
    """
    member = F.struct("n_shingles", *SKETCH).alias("m")
    in_bands = classes.select("cls", "doc_id", F.explode("bands").alias("key"))
    # the lowest document is one pivot for most buckets of a group, so that few different pairs are compared
    crowded = in_bands.groupBy("key").agg(F.min(F.struct("doc_id", "cls"))["cls"].alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = cut(in_bands.join(crowded, "key").select("key", "cls", "pivot"))
    texts = cut(texts_of(classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "doc_id")))
    sketches = classes.select("cls", member)
    stars = buckets.filter("cls <> pivot").select(F.least("pivot", "cls").alias("u"), F.greatest("pivot", "cls").alias("v")).distinct()
    stars = stars.join(sketches.toDF("v", "right"), "v").join(sketches.toDF("u", "left"), "u")
    stars = cut(stars.filter(may_link("left", "right", SKETCH, percent, most_different_bits(percent))).select("u", "v"))
    links = cut(confirmed(stars, texts, percent))
    roots = connected_components(links)

    owned = buckets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    parts = cut(owned.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")))
    largest = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("total"))
    # a bucket of two, or one whose star was the only pair, has been compared whole
    open_buckets = largest.filter("parts > 1 AND total > 2").select("key", F.col("top.root").alias("main"))
    rows = cut(owned.join(open_buckets, "key"))
    fine = cut(fine_sketches(texts.join(rows.select("cls").distinct(), "cls", "left_semi"))).select("cls", F.struct("n_shingles", *FINE).alias("m"))
    rows = rows.join(fine, "cls")
    left = rows.filter("root <> main").select("key", F.col("cls").alias("u"), F.col("root").alias("u_root"), F.col("m").alias("left"))
    right = rows.select(F.col("key").alias("r_key"), F.col("cls").alias("v"), F.col("root").alias("v_root"), "main", F.col("m").alias("right"))
    # of two members that are both outside of the largest component, one order is enough
    once = (F.col("v_root") == F.col("main")) | (F.col("u") < F.col("v"))
    near = may_link("left", "right", FINE, percent, most_different_bits(percent, FINE_SAMPLES, FINE_BITS))
    rest = left.join(right, (F.col("key") == F.col("r_key")) & (F.col("u_root") != F.col("v_root")) & once & near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return extended(roots, confirmed(rest.join(stars, ["u", "v"], "left_anti"), texts, percent))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    rows = cut(signatures(docs, id_col, text_col, bands_for(percent)))
    known = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    one = F.min(F.struct("doc_id", "n_shingles", *SKETCH, "bands")).alias("one")  # equal sets have equal sketches
    classes = cut(known.groupBy("cls").agg(one).select("cls", "one.*"))

    def texts_of(chosen: DataFrame) -> DataFrame:
        raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).join(chosen, "doc_id").select("cls", "raw")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """An id may repeat with other texts: those aren't of the class."""
            for b in batches:
                at = 0
                for part in in_chunks(b.column("raw")):
                    if part:
                        sets = shingle_sets(part)
                        want = b.column("cls").slice(at, len(part)).to_numpy().view(np.uint64)
                        keep = [at + i for i, x in enumerate(sets) if len(x) and class_of(x) == want[i]]
                        yield b.take(pa.array(keep, pa.int64()))
                        at += len(part)

        return raw.mapInArrow(own, "cls long, raw binary").dropDuplicates(["cls"])

    roots = link_classes(classes, texts_of, percent)
    named = classes.select("cls", "doc_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    of_class = named.select("cls", "root").join(smallest, "root").select("cls", "component")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
