"""Suffix-array dedup: removes every byte that a string of SPAN bytes covers which also starts earlier.

Sorting all suffixes of a corpus would move every byte many times, so suffixes are sorted only where they can matter. Each
window of SPAN bytes has an anchor, its GRAM bytes of lowest hash (of equals the rightmost); equal windows have equal anchors
at equal offsets. Windows next to each other mostly share an anchor, so a document of n bytes has about n / 32 anchors, each with its
run of windows and the hash of all the bytes they span.

1. Where the documents lie: anchors, by prefix hashes. Of equal ones with equal spans only the first of a batch goes on.
2. By anchor hash: of equal spans all but the first are repeats as a whole. The first ones go on if their anchor has several
   spans: there, only some windows are equal. Where a batch has more than CROWD spans of an anchor, one of them goes to the
   anchor's bucket and tells so, the others to those of their spans' hashes.
3. Back at the documents, by id: the bytes of those spans. An anchor of more than HOT spans or of a crowd is no group of its
   own: each of its windows goes on alone under its own hash, the first of equal ones in a batch.
4. By anchor hash: suffix sort of their windows. A mergesort compares suffixes by the longest common extension, a binary
   search over lengths whose steps compare prefix hashes. Neighbours that agree on SPAN bytes are verified byte by byte; a
   collision sends their run to a plain sort. All but the first of equal windows are repeats.
5. By id: the repeats of a document are joined into spans and cut out.

Defined results: a null text is empty; matches never cross documents; a null id's row keeps all and serves no other;
rows that repeat an id are told apart by no order, so none of them counts as earlier than another for equal starts, and each
loses what starts earlier in its own text, in another row's or in another document; an empty table gives an empty result; columns with an added name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import cut, without
from stowage.llm.hashing import Prefix, joined, mix

SPAN, GRAM = 100, 32
REACH = SPAN - GRAM + 1
PLACE_BITS = 24
#: Bytes that are hashed at a time; longer texts are hashed in pieces that share SPAN - 1 bytes.
CHUNK = 1 << 18
#: Bytes whose anchors are compared before they are sent.
SENT = 6 << 20
BUCKET_BYTES = 6 << 20
#: Spans of one anchor in a batch, and in all, from which its windows are dealt on their own.
CROWD, HOT = 32, 1 << 12
#: own is a hash of the whole text, which tells the texts of one id apart.
ANCHOR = np.dtype([("gram", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("own", "<u4"), ("lo", "<i4"), ("offset", "u1"), ("count", "u1"), ("hot", "u1")])
NEED = np.dtype([("gram", "<u8"), ("own", "<u4"), ("lo", "<i4"), ("offset", "u1"), ("count", "u1"), ("hot", "u1")])
CONTEXT = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("own", "<u4"), ("lo", "<i4"), ("offset", "u1"), ("count", "u1")])
MARK = np.dtype([("own", "<u4"), ("lo", "<i4"), ("count", "<i4")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(texts: list[bytes], docs: np.ndarray, bases: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The anchors of the texts, which are pieces of docs that start at bases, in whole texts of hash own."""
    data, bounds = joined(texts)
    if len(data) < SPAN:
        return np.zeros(0, ANCHOR)
    prefix = Prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(prefix.raw(at, at + GRAM))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((grams & ~low) | (low - at.astype(np.uint64)), REACH)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + SPAN <= bounds[owner + 1])
    if not len(start):
        return np.zeros(0, ANCHOR)
    owner = owner[start]
    place = (low - (least[start] & low)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    lo, hi, place, owner = start[first], start[last], place[first], owner[first]
    out = np.zeros(len(lo), ANCHOR)
    out["gram"] = grams[place]
    out["span"] = mix(prefix.hash(lo, hi + SPAN) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["doc"], out["own"], out["lo"] = docs[owner], own[owner], lo - bounds[owner] + bases[owner]
    out["offset"], out["count"] = place - lo, hi - lo + 1
    return out


def text_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def pieces(raw: pa.Array, ids: np.ndarray) -> Iterator[np.ndarray]:
    """The anchors of each CHUNK of the texts."""
    texts, docs, bases, owns, size = [], [], [], [], 0
    for i, v in zip(ids.tolist(), raw, strict=True):
        text = v.as_py() or b""
        own = text_hash(text)
        for base in range(0, max(1, len(text) - SPAN + 1), CHUNK):
            texts.append(text[base : base + CHUNK + SPAN - 1])
            docs.append(i)
            bases.append(base)
            owns.append(own)
            size += len(texts[-1])
            if size >= CHUNK:
                yield anchors(texts, np.array(docs), np.array(bases), np.array(owns))
                texts, docs, bases, owns, size = [], [], [], [], 0
    if texts:
        yield anchors(texts, np.array(docs), np.array(bases), np.array(owns))


def later(doc: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which rows lie after the first of their group, where groups lie together in the order of (doc, start). Equal places aren't after each other."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return (doc != doc[head]) | (start != start[head])


def ordered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a by gram, span, doc, start and text, each once (a hot one of equals); where a gram begins; where a span does; what lies after its span's first."""
    a = a[np.lexsort((a["hot"] == 0, a["own"], a["lo"], a["doc"], a["span"], a["gram"]))]
    new = np.ones(len(a), bool)
    new[1:] = False
    for f in ("gram", "span", "doc", "lo", "own"):
        new[1:] |= a[f][1:] != a[f][:-1]
    a = a[new]
    gram = np.ones(len(a), bool)
    gram[1:] = a["gram"][1:] != a["gram"][:-1]
    span = gram.copy()
    span[1:] |= a["span"][1:] != a["span"][:-1]
    return a, gram, span, later(a["doc"], a["lo"], span)


def by_doc(doc: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """items packed for each doc."""
    order = np.argsort(doc, kind="stable")
    doc, items = doc[order], items[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return doc[first], [x.tobytes() for x in np.split(items, first[1:])] if len(first) else []


def marks_of(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), MARK)
    out["own"], out["lo"], out["count"] = a["own"], a["lo"], a["count"]
    return out


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which windows at a and b agree, byte by byte."""
    wide, some = np.arange(SPAN), 1 << 13
    return np.concatenate([np.zeros(0, bool), *((data[a[i : i + some, None] + wide] == data[b[i : i + some, None] + wide]).all(1) for i in range(0, len(a), some))])


def dealt(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets with rows, and each one's rows. Anchors are the lowest of their neighbours' hashes, so hashes are mixed anew."""
    key = ((mix(gram) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.split(order, edge[1:]) if len(edge) else []


def extension(prefix: Prefix, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the next SPAN bytes at a and b agree: binary search over lengths, by prefix hashes."""
    least, most = np.zeros(len(a), np.int64), np.full(len(a), SPAN, np.int64)
    for _ in range(SPAN.bit_length()):
        mid = (least + most + 1) >> 1
        same = prefix.raw(a, a + mid) == prefix.raw(b, b + mid)
        least, most = np.where(same, mid, least), np.where(same, most, mid - 1)
    return least


def precedes(data: np.ndarray, prefix: Prefix, place: np.ndarray, turn: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether window a comes before window b: by bytes, of equal windows by turn."""
    pa_, pb = place[a], place[b]
    same = extension(prefix, pa_, pb)
    inside = np.minimum(same, SPAN - 1)
    return np.where(same >= SPAN, turn[a] < turn[b], data[pa_ + inside] < data[pb + inside])


def suffix_order(data: np.ndarray, prefix: Prefix, place: np.ndarray, turn: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Sorts the windows at place inside each run (runs lie together) by a bottom-up mergesort over all runs at once.

    In a merge, each window finds its rank in the other half by binary search; only runs longer than a half take part.
    """
    order = np.arange(len(place))
    begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(run)))
    width = 1
    while (sizes > width).any():
        begins, sizes = begins[sizes > width], sizes[sizes > width]
        at = np.repeat(begins, sizes)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = np.repeat(sizes, sizes)
        block = inner // (2 * width) * (2 * width)
        right = inner - block >= width
        other = at + block + np.where(right, 0, width)
        others = np.where(right, width, np.clip(size - block - width, 0, width))
        me = order[at + inner]
        least, most = np.zeros(len(me), np.int64), others.copy()
        while (open_ := np.flatnonzero(least < most)).size:
            mid = (least[open_] + most[open_]) >> 1
            before = precedes(data, prefix, place, turn, order[other[open_] + mid], me[open_])
            least[open_[before]] = mid[before] + 1
            most[open_[~before]] = mid[~before]
        own = inner - block - np.where(right, width, 0)
        order[at + block + own + least] = me
        width *= 2
    return order


def repeated_windows(data: np.ndarray, place: np.ndarray, doc: np.ndarray, start: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which of the windows at place also start earlier in their run; each run lies together."""
    turn = np.empty(len(run), np.int64)
    turn[np.lexsort((start, doc))] = np.arange(len(run))
    prefix = Prefix(data)
    order = suffix_order(data, prefix, place, turn, run)
    a, b = order[:-1], order[1:]
    same = (run[a] == run[b]) & (prefix.raw(place[a], place[a] + SPAN) == prefix.raw(place[b], place[b] + SPAN))
    hit = np.flatnonzero(same)
    for r in np.unique(run[a[hit[~equal_bytes(data, place[a[hit]], place[b[hit]])]]]):
        own = np.flatnonzero(run == r)
        text = {i: data[place[i] : place[i] + SPAN].tobytes() for i in own.tolist()}
        order[own] = sorted(own.tolist(), key=lambda i: (text[i], turn[i]))
        same[own[:-1]] = [text[i] == text[j] for i, j in zip(order[own[:-1]].tolist(), order[own[1:]].tolist(), strict=True)]
    if not len(order):
        return order
    return order[later(doc[order], start[order], np.r_[True, ~same])]


FOUND = "doc_id long, marks binary, needs binary"


def found(docs: np.ndarray, marks: np.ndarray, need_docs: np.ndarray, needs: np.ndarray) -> pa.Table:
    d, m = by_doc(docs, marks)
    e, n = by_doc(need_docs, needs)
    return pa.table({"doc_id": pa.array(np.concatenate([d, e]), pa.int64()), "marks": pa.array(m + [None] * len(e), pa.binary()), "needs": pa.array([None] * len(d) + n, pa.binary())})


def send_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob) of the first anchors among SENT bytes; (bucket, doc_id, marks) of what repeats inside of them."""

    def packed(every: list[np.ndarray]) -> pa.Table:
        a, gram, _, after = ordered(np.concatenate(every))
        again = a[after]
        a, gram = a[~after], (np.cumsum(gram) - 1)[~after]  # equal places of several texts stay, so a span may have several rows
        head = np.r_[True, gram[1:] != gram[:-1]][: len(a)]
        a["hot"] = np.bincount(gram)[gram] > CROWD if len(a) else 0
        key, parts = dealt(np.where((a["hot"] > 0) & ~head, a["span"], a["gram"]), buckets)
        doc, marks = by_doc(again["doc"], marks_of(again))
        blob = [b"".join(np.ascontiguousarray(x[f]).tobytes() for f in ANCHOR.names) for x in (a[p] for p in parts)]
        return pa.table({
            "bucket": pa.array(np.concatenate([key, doc % buckets]), pa.int64()),
            "blob": pa.array(blob + [None] * len(doc), pa.binary()),
            "doc_id": pa.array([None] * len(blob) + doc.tolist(), pa.int64()),
            "marks": pa.array([None] * len(blob) + marks, pa.binary()),
        })

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for some in pieces(b.column("raw"), b.column("doc_id").to_numpy()):
                held.append(some)
                size += CHUNK
                if size >= SENT:
                    yield from packed(held).to_batches()
                    held, size = [], 0
        if held:
            yield from packed(held).to_batches()

    return docs.mapInArrow(go, "bucket long, blob binary, doc_id long, marks binary")


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // ANCHOR.itemsize
    out, at = np.empty(n, ANCHOR), 0
    for f in ANCHOR.names:
        size = n * ANCHOR[f].itemsize
        out[f] = np.frombuffer(blob[at : at + size], ANCHOR[f])
        at += size
    return out


def passed(t: pa.Table) -> pa.Table:
    """The marks that batches have found."""
    early = t.filter(pc.is_valid(t["marks"])).select(["doc_id", "marks"])
    return early.append_column("needs", pa.nulls(early.num_rows, pa.binary()))


def compare_spans(t: pa.Table) -> pa.Table:
    """A bucket's anchors: marks for all but the first of equal spans, needs for grams with several spans or a crowd. Marks pass through."""
    a, gram, first, after = ordered(np.concatenate([np.zeros(0, ANCHOR), *(unpacked(v.as_py()) for v in t["blob"] if v.is_valid)]))
    again = a[after]
    group = np.cumsum(gram) - 1
    spans = np.bincount(group[first], minlength=group[-1] + 1) if len(group) else group
    a["hot"] = ((spans > HOT) | (np.bincount(group, a["hot"]) > 0))[group]
    ask = a[~after & ((spans[group] > 1) | (a["hot"] > 0))]
    needs = np.zeros(len(ask), NEED)
    for f in NEED.names:
        needs[f] = ask[f]
    return pa.concat_tables([found(again["doc"], marks_of(again), ask["doc"], needs), passed(t)])


def windows_of(c: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window of contexts c with these bytes as a context under its own hash; where it begins in the bytes; the bytes; those that repeat another one."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = c["count"].astype(np.int64)
    owner = np.repeat(np.arange(len(c)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.cumsum(n + SPAN - 1) - (n + SPAN - 1), n) + step
    w = c[owner]
    w["gram"] = mix(Prefix(data).raw(place, place + SPAN))
    w["lo"] += step.astype(np.int32)
    w["offset"] -= step.astype(np.uint8)
    w["count"] = 1
    order = np.lexsort((w["own"], w["lo"], w["doc"], w["gram"]))
    w, place = w[order], place[order]
    first = np.ones(len(w), bool)
    like = np.flatnonzero(w["gram"][1:] == w["gram"][:-1]) + 1
    first[like[equal_bytes(data, place[like - 1], place[like])]] = False
    after = later(w["doc"], w["lo"], first)
    return w[~after], place[~after], data, w[after]


def send_contexts(rows: DataFrame, buckets: int) -> DataFrame:
    """From (doc_id, raw, needs array<binary>), (bucket, contexts, bytes); (bucket, doc_id, marks) of windows that repeat inside of a batch."""

    def packed(c: np.ndarray, bytes_of, again: np.ndarray) -> pa.Table:
        key, parts = dealt(c["gram"], buckets)
        doc, marks = by_doc(again["doc"], marks_of(again))
        return pa.table({
            "bucket": pa.array(np.concatenate([key, doc % buckets]), pa.int64()),
            "contexts": pa.array([c[p].tobytes() for p in parts] + [None] * len(doc), pa.binary()),
            "bytes": pa.array([bytes_of(p) for p in parts] + [None] * len(doc), pa.binary()),
            "doc_id": pa.array([None] * len(key) + doc.tolist(), pa.int64()),
            "marks": pa.array([None] * len(key) + marks, pa.binary()),
        })

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sent = None, set()
        for b in batches:
            some, texts, hot = [], [], []
            for doc, raw, needs in zip(b.column("doc_id").to_pylist(), b.column("raw"), b.column("needs").to_pylist(), strict=True):
                if doc != last:
                    last, sent = doc, set()
                text = raw.as_py()
                own = text_hash(text)
                if own in sent:  # a row that repeats id and text
                    continue
                sent.add(own)
                n = np.frombuffer(b"".join(needs), NEED)
                n = n[n["own"] == own]
                c = np.zeros(len(n), CONTEXT)
                for f in ("gram", "own", "lo", "offset", "count"):
                    c[f] = n[f]
                c["doc"] = doc
                some.append(c)
                hot.append(n["hot"] > 0)
                texts += [text[lo : lo + count + SPAN - 1] for lo, count in zip(n["lo"].tolist(), n["count"].tolist(), strict=True)]
            c, alone = np.concatenate([*some, np.zeros(0, CONTEXT)]), np.concatenate([*hot, np.zeros(0, bool)])
            whole = [texts[i] for i in np.flatnonzero(~alone).tolist()]
            yield from packed(c[~alone], lambda p, t=whole: b"".join(t[i] for i in p.tolist()), np.zeros(0, CONTEXT)).to_batches()
            hot_at, size, at = np.flatnonzero(alone), np.cumsum(c["count"][alone].astype(np.int64)), 0
            while at < len(hot_at):  # up to SORTED windows at a time
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SORTED, side="right")))
                w, place, data, again = windows_of(c[hot_at[at:to]], [texts[i] for i in hot_at[at:to].tolist()])
                yield from packed(w, lambda p, d=data, q=place: d[q[p][:, None] + np.arange(SPAN)].tobytes(), again).to_batches()
                at = to

    return rows.mapInArrow(go, "bucket long, contexts binary, bytes binary, doc_id long, marks binary")


#: Windows that are sorted at a time; only those of one anchor at one offset stay together.
SORTED = 1 << 17


def compare_windows(t: pa.Table) -> pa.Table:
    """A bucket's contexts: marks for windows that also start earlier. Equal windows have one anchor at one offset."""
    contexts = np.concatenate([np.zeros(0, CONTEXT), *(np.frombuffer(v.as_py(), CONTEXT) for v in t["contexts"] if v.is_valid)])
    data = np.frombuffer(b"".join(v.as_py() for v in t["bytes"] if v.is_valid), np.uint8)
    begin = np.cumsum(contexts["count"].astype(np.int64) + SPAN - 1) - (contexts["count"].astype(np.int64) + SPAN - 1)
    order = np.lexsort((contexts["own"], contexts["lo"], contexts["doc"], contexts["gram"]))
    contexts, begin = contexts[order], begin[order]
    once = np.ones(len(contexts), bool)
    once[1:] = contexts[1:] != contexts[:-1]
    contexts, begin = contexts[once], begin[once]
    new = np.r_[True, contexts["gram"][1:] != contexts["gram"][:-1]] if len(contexts) else np.zeros(0, bool)
    group = np.cumsum(new)
    docs, starts, owns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    edges = np.append(np.flatnonzero(new), len(contexts))
    ahead = np.concatenate([[0], np.cumsum(contexts["count"].astype(np.int64))])
    at = 0
    while at < len(edges) - 1:
        # whole groups up to SORTED windows, or a part of the offsets of one larger group
        to = max(at + 1, int(np.searchsorted(ahead[edges], ahead[edges[at]] + SORTED, side="right")) - 1)
        own = slice(edges[at], edges[to])
        parts = max(1, -(-int(ahead[edges[to]] - ahead[edges[at]]) // SORTED))
        for k in range(parts):
            c = contexts[own]
            most = c["offset"].astype(np.int64)
            least = most - c["count"].astype(np.int64) + 1
            lo, hi = np.maximum(least, k * REACH // parts), np.minimum(most, (k + 1) * REACH // parts - 1)
            n = np.maximum(hi - lo + 1, 0)
            owner = np.repeat(np.arange(len(c)), n)
            offset = np.repeat(lo, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            run = group[own][owner].astype(np.int64) * REACH + offset
            order = np.argsort(run, kind="stable")
            owner, offset, run = owner[order], offset[order], run[order]
            edge = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
            run = np.cumsum(edge)
            shared = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
            owner, offset, run = owner[shared], offset[shared], run[shared]
            if not len(run):
                continue
            step = most[owner] - offset
            doc, start = c["doc"][owner], c["lo"][owner].astype(np.int64) + step
            base = begin[own]
            used = np.unique(owner)
            size = c["count"][used].astype(np.int64) + SPAN - 1
            moved = np.zeros(len(c), np.int64)
            moved[used] = np.cumsum(size) - size
            take = np.repeat(base[used] - moved[used], size) + np.arange(size.sum())
            hit = repeated_windows(data[take], moved[owner] + step, doc, start, run)
            docs.append(doc[hit])
            starts.append(start[hit])
            owns.append(c["own"][owner][hit])
        at = to
    doc, start, own = np.concatenate(docs), np.concatenate(starts), np.concatenate(owns)
    order = np.lexsort((start, own, doc))
    doc, start, own = doc[order], start[order], own[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    marks = np.zeros(len(first), MARK)
    marks["own"], marks["lo"], marks["count"] = own[first], start[first], np.diff(np.append(first, len(start)))
    return pa.concat_tables([found(doc[first], marks, np.zeros(0, np.int64), np.zeros(0, NEED)), passed(t)])


def removed_spans(marks: list[bytes], text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of covered bytes; marks of other texts of the id are left out."""
    m, size = np.frombuffer(b"".join(marks), MARK), len(text)
    if len(m):
        m = m[m["own"] == text_hash(text)]
    m = m[np.argsort(m["lo"], kind="stable")]
    lo, hi = m["lo"].astype(np.int64), np.minimum(m["lo"].astype(np.int64) + m["count"] + SPAN - 1, size)
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    return lo[first], reach[np.append(first[1:], len(lo)) - 1]


def whole_characters(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans less the characters of which a byte stays."""
    inner = (np.frombuffer(text, np.uint8) & 0xC0) == 0x80
    starts = np.flatnonzero(~inner)
    starts = np.append(starts, len(text))
    return starts[np.searchsorted(starts, lo)], starts[np.searchsorted(starts, hi, side="right") - 1]


ADDED = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept": T.BinaryType()}


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the remaining bytes).

    characters: keep a character of which only some bytes are covered, so that kept is text again.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = without(docs, [*ADDED, "_raw", "_marks", "_id"]).withColumns({"_raw": raw, "_id": F.col(id_col).cast("long")})
    plain = rows.filter("_id IS NOT NULL").select(F.col("_id").alias("doc_id"), F.col("_raw").alias("raw"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(24, -(-total // BUCKET_BYTES))
    sent = send_anchors(plain.filter(F.length("raw") >= SPAN), buckets)
    first = cut(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(compare_spans, FOUND))
    needs = first.filter("needs IS NOT NULL").groupBy("doc_id").agg(F.collect_list("needs").alias("needs"))
    contexts = send_contexts(plain.join(needs, "doc_id"), buckets)
    windows = cut(contexts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(compare_windows, FOUND))
    marks = first.select("doc_id", "marks").unionByName(windows.select("doc_id", "marks")).filter("marks IS NOT NULL")
    per_doc = marks.groupBy("doc_id").agg(F.collect_list("marks").alias("_marks"))  # at most one mark for each anchor of the text
    joined_rows = rows.join(per_doc.withColumnRenamed("doc_id", "_of"), F.col("_id") == F.col("_of"), "left").drop("_of")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield cut_out(b.slice(at, 500))

    def cut_out(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {name: [] for name in ADDED}
        for raw, marks in zip(b.column("_raw"), b.column("_marks").to_pylist(), strict=True):
            text = raw.as_py()
            lo, hi = removed_spans(marks or [], text)
            if characters and len(lo):
                lo, hi = whole_characters(text, lo, hi)
                lo, hi = lo[hi > lo], hi[hi > lo]
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int((hi - lo).sum()))
            out["n_spans"].append(len(lo))
            out["kept"].append(b"".join(text[s:e] for s, e in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True)))
        kept = b.drop_columns(["_raw", "_marks", "_id"])
        for name, kind in (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())):
            kept = kept.append_column(name, pa.array(out[name], kind))
        return kept

    fields = [f for f in joined_rows.schema.fields if f.name not in ("_raw", "_marks", "_id")]
    return joined_rows.mapInArrow(go, T.StructType([*fields, *(T.StructField(n, k) for n, k in ADDED.items())]))
