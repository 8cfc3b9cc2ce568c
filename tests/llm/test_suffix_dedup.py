import random

import numpy as np
import pytest

from stowage.llm import suffix_dedup
from stowage.llm.hashing import Prefix


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        t = (t or "").encode()
        covered = bytearray(len(t))
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        out[i] = (len(t), sum(covered), sum(1 for k in range(len(t)) if covered[k] and (k == 0 or not covered[k - 1])), bytes(b for b, c in zip(t, covered, strict=True) if not c))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdé ß") for _ in range(n))
    shared = [noise(n) for n in (99, 100, 101, 130, 180, 400, 1500)]
    rows = [(k, noise(rng.randrange(0, 80)) + rng.choice(shared) + noise(rng.randrange(0, 60)) + rng.choice(shared)[rng.randrange(0, 60) :]) for k in range(60)]
    rows += [(100 + k, shared[5]) for k in range(12)] + [(200, "x" * 700), (201, "x" * 300), (202, "ab" * 400), (203, None), (204, ""), (205, "x" * 99)]
    rows += [(300, noise(50) + shared[6] + noise(30) + shared[6])]
    return rows


@pytest.mark.parametrize(("crowd", "parts"), [(suffix_dedup.CROWD, 4), (1, 1), (1, 4), (2, 13), (5, 3)])
def test_equals_brute_force(spark, corpus, monkeypatch, crowd, parts):
    """Also where anchors have a crowd, in some batches or all, so that their windows are dealt on their own."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)  # read where batches are packed, so it reaches the workers
    df = spark.createDataFrame([(i, t, 1) for i, t in corpus], "doc_id long, text string, KEPT int").repartition(parts)
    out = suffix_dedup.remove_repeats(df)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()} == brute(corpus)


def test_pieces_of_long_texts(corpus):
    """A text hashed in pieces has the same windows as in one."""
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(3 * suffix_dedup.CHUNK)).encode()
    import pyarrow as pa

    some = list(suffix_dedup.pieces(pa.array([text], pa.binary()), np.array([1])))
    starts = np.concatenate([np.repeat(a["lo"], a["count"]) + np.concatenate([np.arange(c) for c in a["count"]]) for a in some])
    assert sorted(starts.tolist()) == list(range(len(text) - suffix_dedup.SPAN + 1))


def test_suffix_order_sorts():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    place = rng.integers(0, 3900, 500)
    run = np.sort(rng.integers(0, 9, 500))
    order = suffix_dedup.suffix_order(data, Prefix(data), place, np.arange(500), run)
    text = [data[p : p + 100].tobytes() for p in place]
    assert order.tolist() == sorted(range(500), key=lambda i: (run[i], text[i], i))


def test_characters_stay_whole(spark):
    a = "é" * 60
    df = spark.createDataFrame([(1, a), (2, "x" + a + "è" + "z" * 20), (None, a)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, characters=True).collect()}
    assert bytes(out[2]["kept"]).decode() == "xè" + "z" * 20 and bytes(out[1]["kept"]).decode().startswith("é") and bytes(out[None]["kept"]).decode() == a
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_hot_anchor_without_a_crowd(monkeypatch):
    """An anchor of more than HOT spans is hot in its bucket, whatever its batches say."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    a = np.zeros(9, suffix_dedup.ANCHOR)
    a["gram"], a["span"], a["doc"], a["count"] = [7] * 4 + [8] * 2 + [9] * 3, [1, 2, 3, 4, 1, 2, 1, 1, 2], np.arange(9), 1
    a["hot"][8] = 1
    blob = b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names)
    t = pa.table({"blob": pa.array([blob, None], pa.binary()), "doc_id": pa.array([None, 50]), "marks": pa.array([None, b"m"], pa.binary())})
    out = suffix_dedup.compare_spans(t).to_pylist()
    hot = {r["doc_id"]: np.frombuffer(r["needs"], suffix_dedup.NEED)["hot"].tolist() for r in out if r["needs"]}
    assert hot == {0: [1], 1: [1], 2: [1], 3: [1], 4: [0], 5: [0], 6: [1], 8: [1]}
    assert sorted(r["doc_id"] for r in out if r["marks"]) == [7, 50]


def test_windows_on_their_own():
    text = b"".join(bytes([97 + (i * i) % 23]) for i in range(140))
    c = np.zeros(3, suffix_dedup.CONTEXT)
    c["doc"], c["lo"], c["offset"], c["count"], c["own"] = [5, 4, 5], [10, 20, 10], [50, 50, 50], [3, 2, 3], [1, 2, 3]
    w, place, data, again = suffix_dedup.windows_of(c, [text[:102], text[:101], text[:102]])
    assert sorted(again[["doc", "own", "lo"]].tolist()) == [(5, 1, 10), (5, 1, 11), (5, 3, 10), (5, 3, 11)]  # document 4 has them first
    assert sorted(w[["doc", "own", "lo", "offset"]].tolist()) == [(4, 2, 20, 50), (4, 2, 21, 49), (5, 1, 12, 48), (5, 3, 12, 48)]  # one place in two texts
    assert all(data[p : p + 100].tobytes() == text[i : i + 100] for p, i in zip(place.tolist(), (50 - w["offset"].astype(int)).tolist(), strict=True))


def brute_rows(rows):
    """For each row what is left: a window goes if it is also at a lower (id, start) of any row."""
    least = {}
    for i, t in rows:
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            least[w] = min(least.get(w, (i, p)), (i, p))
    out = []
    for i, t in rows:
        covered = bytearray(len(t))
        for p in range(len(t) - 99):
            if least[t[p : p + 100]] < (i, p):
                covered[p : p + 100] = b"\1" * 100
        out.append((i, t, bytes(b for b, c in zip(t.encode(), covered, strict=True) if not c)))
    return sorted(out)


@pytest.mark.parametrize(("crowd", "parts"), [(suffix_dedup.CROWD, 1), (suffix_dedup.CROWD, 5), (1, 1), (1, 5)])
def test_rows_that_repeat_an_id(spark, monkeypatch, crowd, parts):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b, c, d = noise(700), noise(300), noise(500), noise(400)
    rows = [(1, a), (1, a), (1, a), (2, noise(40) + a[100:500] + noise(40))]  # the same row, then a later document
    rows += [(3, b + noise(300)), (3, b + noise(200)), (3, b + noise(200) + c), (4, b), (4, c)]  # one start in several texts of an id
    rows += [(5, noise(200) + d), (5, noise(150) + d + noise(90)), (6, d), (6, noise(400)), (6, d)]  # other starts; own text beside a repeat
    rows += [(7, "xy" * 200), (7, "xy" * 200), (7, "xy" * 150 + noise(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r["doc_id"], r["text"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == brute_rows(rows) and (1, a, a.encode()) in got
