import random
import re

import numpy as np
import pytest

from stowage.llm import decontaminate
from stowage.llm.decontaminate import WindowSet, Words, scan_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC, ITEM = "doc_id long, text string, ITEMS int", "item_id long, text string, extra int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def by_hand(docs, items, size):
    """{row: (words, hit words, items)}, window by window."""
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = {}
    for r, (_, text) in enumerate(docs):
        w, hit, own = WORD.findall(lower(text)), set(), set()
        for win, who in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    own |= who - {None}
        out[r] = (len(w), len(hit), sorted(own, key=str))
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "cd9", "éà", "x", "日本", "q"])
    gap = lambda: rng.choice([" ", ", ", "\n", "--", "\x00", "'"])
    phrase = lambda n: "".join(word() + gap() for _ in range(n))
    items = [(i, phrase(rng.randrange(0, 9))) for i in range(30)] + [(10, "A b"), (10, "A b"), (None, "zz yy"), (31, None), (32, "...")]
    docs = [(i, phrase(rng.randrange(0, 60))) for i in range(60)] + [(3, "zz, YY"), (61, None), (62, ""), (63, "!!"), (64, phrase(20) + "A b"), (64, "A-B")]
    return docs, items


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_scan_against_every_window(spark, cases, most):
    docs, items = cases
    left = spark.createDataFrame([(i, t, r) for r, (i, t) in enumerate(docs)], "doc_id long, text string, r int")
    right = spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)
    out = decontaminate.scan(left, right, size=4, text="clean", most_windows=most)
    want = by_hand(docs, items, 4)
    got = {r["r"]: r for r in out.collect()}
    assert {k: (r["n_words"], r["n_hit"], r["items"]) for k, r in got.items()} == want
    assert sum(n > 0 for _, n, _ in want.values()) > 20
    for k, (_, text) in enumerate(docs):
        raw, at, rest = (text or "").encode(), 0, b""
        for s in got[k]["spans"]:
            rest, at = rest + raw[at : s["begin"]], s["stop"]
        assert got[k]["text"] == (None if text is None else (rest + raw[at:]).decode())
        assert len(WORD.findall(got[k]["text"] or "")) >= want[k][0] - want[k][1] - 2 * len(got[k]["spans"])


def test_blocks_of_words_and_of_bytes(monkeypatch):
    """Windows across the edges of blocks, and comparisons a few bytes at a time."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))).encode() for _ in range(40)]
    sets = {3: WindowSet([b"a b c", b"b b b", b"c a a"], [[1], [2], [3]])}
    n_words, found, spans = scan_texts(texts, sets)
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    monkeypatch.setattr(decontaminate, "same_spans", lambda *a, f=decontaminate.same_spans: f(*a, most=6))
    again = scan_texts(texts, sets)
    assert again[0].tolist() == n_words.tolist() and again[1:] == (found, spans)
    for t, text in enumerate(texts):
        w = text.split()
        assert found[t][1] == {k for k, win in enumerate([b"abc", b"bbb", b"caa"], 1) if any(b"".join(w[i : i + 3]) == win for i in range(len(w)))}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    class Flat(decontaminate.Prefix):
        def hash(self, start, end):
            return np.zeros(len(start), dtype=np.uint64)

    monkeypatch.setattr(decontaminate, "Prefix", Flat)
    sets = {2: WindowSet([b"a b", b"c d", b"longer words", b"e f"], [[1], [2], [3], [4]])}
    _, found, _ = scan_texts([b"x e f y", b"c d", b"a c", b"longer words"], sets)
    assert [(runs, sorted(items)) for runs, items in found] == [([(1, 3)], [4]), ([(0, 2)], [2]), ([], []), ([(0, 2)], [3])]


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "keep a b c d! rest", 7), (2, "clean", 7), (None, None, 7)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(5, "A b C d", 0)], ITEM)
    assert {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()} == {1: "keep ! rest", 2: "clean", None: None}
    assert {r["doc_id"] for r in decontaminate.remove_documents(docs, bench).collect()} == {2, None} and decontaminate.remove_spans(docs, bench).columns == docs.columns
    assert decontaminate.remove_documents(docs, bench, least=5).count() == 3
    clash = docs.withColumnRenamed("n", "ITEMS")
    assert decontaminate.scan(clash, bench).columns == ["doc_id", "n_words", "n_hit", "items", "spans"]
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in decontaminate.scan(docs, bench.limit(0)).collect())


def test_a_very_long_text():
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") * 3 for _ in range(400_000)]
    planted = [b"p%d" % i for i in range(10)]
    words = [w.encode() for w in words]
    words[399_000:399_010] = planted
    n_words, found, spans = scan_texts([b" ".join(words)], {10: WindowSet([b" ".join(planted)], [["x"]])})
    assert n_words.tolist() == [400_000] and found == [([(399_000, 399_010)], {"x"})] and spans[0][0][0] == 399_000 * 4
    assert len(Words([b"", b" "]).starts) == 0
