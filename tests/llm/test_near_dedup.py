import random

import numpy as np
import pytest

from stowage.llm import components, near_dedup


def brute(rows):
    """rows (id, text): components by all pairs of shingle sets."""
    sets = {}
    for i, t in rows:
        raw = (t or "").encode().lower().split()
        sets[i] = {tuple(raw[k : k + 5]) for k in range(len(raw) - 4)} if len(raw) >= 5 else {tuple(raw)} if raw else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("alpha beta gamma delta".split()) + str(rng.random())
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(100 + k, " ".join(word() for _ in range(rng.randrange(1, 200)))) for k in range(60)]
    base = [word() for _ in range(300)]
    rows += [(300 + k, edited(rng, base, rng.randrange(0, 12))) for k in range(60)]  # one group around the threshold, chains included
    rows += [(500 + k, edited(rng, base, 12).upper()) for k in range(20)]
    rows += [(700 + k, "one two\tthree") for k in range(5)] + [(710, "ONE two three"), (711, "one two"), (720, None), (721, ""), (722, " \n\t")]
    rows += [(800 + k, " ".join(base) + "\x0b") for k in range(15)]
    return rows


def test_equals_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in corpus], "doc_id long, text string, cls int, raw int")
    out = near_dedup.near_dedup(df).collect()
    want = brute(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    out = sorted(near_dedup.near_dedup(df).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in out] == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


def test_sketches_tell_similarity():
    rng = np.random.default_rng(0)
    for share, within in ((0.85, True), (0.5, False)):
        base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        cut = int(1000 * (1 - share) / 2)
        o = near_dedup.odd_sketches(near_dedup.minhashes([np.sort(base[cut:]), np.sort(base[: 1000 - cut])]))
        bits = int(np.unpackbits((o[0] ^ o[1]).view(np.uint8)).sum())
        assert (bits <= near_dedup.most_different_bits(85)) is within


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    out = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100}
