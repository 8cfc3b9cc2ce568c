"""Toxicity: a convolutional text classifier in numpy.

A word is a run of letters, digits, bytes above ASCII and apostrophes, ASCII-lower-cased. It has the sum of rows of a
hashed embedding table: two for itself, so that words which share one row still differ, and one for each of its
beginnings of 4 to 8 bytes, so that inflected forms of a stem share what was learnt. Filters of several widths run over all words of
the whole text, each keeps its maximum, and a logistic layer reads them. Trained on every labelled row: the counts that
the table starts from are sums over all of them, and in each round parts of about PART_ROWS rows or PART_BYTES of text
go on from one model side by side, whose moves are averaged before their mean, of a fixed size, reaches the driver.
Scored where the rows lie. Thresholds are calibrated for each language, as told from the text's function words alone, on
the fifth of all labelled rows that gives no gradients, by counts in narrow bins of the distance; a score is the logistic of
the distance from its threshold, so 0.5 always decides.

Defined results: null and empty texts have a score (that of no word); a null id is not held out; a label counts once a
document (the highest), with the first of its texts in byte order; without both classes among the labels every score is their share, or 0; an empty table gives an
empty result; columns that have the name of an added one are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, without
from stowage.llm.hashing import Prefix, joined, mix, runs

ROWS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 16, (1, 2, 3)
PAD = max(WIDTHS) - 1
CHUNK = 1 << 18
#: What one part of a training round holds, about.
PART_ROWS, PART_BYTES = 4000, 16 << 20
#: Bins a unit of a logit, between -BOUND and BOUND, in which calibration counts; table rows in a block of a model's moves.
FINE, BOUND, BLOCK = 64, 64, 1024
#: Common function words; which language's are most frequent tells the threshold.
FUNCTION_WORDS = {
    "en": "the and of to in is that it was for on are with as be this have from or by",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine auch werden",
    "fr": "le la les des et en un une du que est pour qui dans par sur pas plus avec ce",
    "es": "el los las que y en un una del se por con para es como más pero su al lo",
}
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789'"]] = True
IN_WORD[128:] = True
#: Stands between texts, so that no filter sees two of them.
NO_WORD = np.uint64(0)
BEGINNINGS = range(4, 9)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + beginnings) hashes, each text followed by PAD empty words, and where each text's words begin (the end last)."""
    data, bounds = joined([t.lower() for t in texts])
    kinds = 1 + len(BEGINNINGS)
    if not len(data):
        return np.zeros((PAD * len(texts), kinds), dtype=np.uint64), np.arange(len(texts) + 1) * PAD
    start, end = runs(IN_WORD[data], bounds)
    prefix = Prefix(data)
    owner = np.searchsorted(bounds, start, side="right") - 1
    begins = np.searchsorted(start, bounds) + PAD * np.arange(len(bounds))
    out = np.zeros((len(start) + PAD * len(texts), kinds), dtype=np.uint64)
    place = np.arange(len(start)) + PAD * owner
    out[place, 0] = prefix.hash(start, end) | np.uint64(1)
    for k, n in enumerate(BEGINNINGS, 1):
        long = end - start >= n
        out[place[long], k] = mix(prefix.hash(start[long], start[long] + n) + np.uint64(n)) | np.uint64(1)
    return out, begins


def rows_of(hashes: np.ndarray) -> np.ndarray:
    """(words, 2 + beginnings) rows of the table, which has 2**16; row 0 stands for nothing and stays zero."""
    again = np.where(hashes[:, :1] == NO_WORD, NO_WORD, mix(hashes[:, :1]) | np.uint64(1))
    every = np.concatenate([hashes, again], axis=1)
    return np.where(every == NO_WORD, 0, (every >> np.uint64(48)) % np.uint64(ROWS - 1) + np.uint64(1)).astype(np.uint16)


def different_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each different word, and which of them each word is."""
    _, first, which = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
    return rows_of(hashes[first]), which


LANGUAGES = list(FUNCTION_WORDS)
LANGUAGE_WORDS = {lang: np.sort(word_hashes([words.encode()])[0][:-PAD, 0]) for lang, words in FUNCTION_WORDS.items()}


def languages(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The index of the language whose function words are most frequent, for each text; ties to the first. A text without any of them is of none: the index after the last."""
    counts = []
    for words in LANGUAGE_WORDS.values():
        at = np.searchsorted(words, hashes[:, 0])
        hits = np.concatenate([[0], np.cumsum(words[np.minimum(at, len(words) - 1)] == hashes[:, 0])])
        counts.append(hits[begins[1:]] - hits[begins[:-1]])
    return np.where(np.max(counts, axis=0) > 0, np.argmax(counts, axis=0), len(LANGUAGES))


def in_chunks(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """The texts, null as empty, in lists of about CHUNK bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    table: np.ndarray  # (ROWS, DIM)
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    constant: float | None = None

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Every filter of this width at every word; rows past the end see the padding."""
        n = len(x) - PAD
        total = x[:n] @ self.filters[width][0]
        for j in range(1, width):
            total += x[j : n + j] @ self.filters[width][j]
        return total + self.biases[width]

    def embed(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The embeddings of the words `which`, and PAD empty ones; rows are those of each different word."""
        words = np.zeros((len(rows) + 1, DIM), np.float32)
        for k in range(rows.shape[1]):
            words[:-1] += self.table[rows[:, k]]
        return words[np.concatenate([which, np.full(PAD, len(rows))])]

    def logits(self, rows: np.ndarray, which: np.ndarray, begins: np.ndarray) -> np.ndarray:
        x = self.embed(rows, which)
        pooled = [np.maximum(np.maximum.reduceat(self.responses(x, w), begins[:-1], axis=0), 0) for w in WIDTHS]
        return np.concatenate(pooled, axis=1) @ self.out + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        hashes, begins = word_hashes(texts)
        z = self.logits(*different_words(hashes), begins) - self.thresholds[languages(hashes, begins)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def word_hits(rows: np.ndarray, docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """(2, ROWS): how many other and toxic texts hit each table row."""
    hits = np.zeros((2, ROWS))
    for d, label in zip(docs, y, strict=True):
        hits[label, np.unique(rows[np.unique(d)])] += 1
    return hits


def log_odds(hits: np.ndarray, negative: int, positive: int) -> np.ndarray:
    """For each table row, the smoothed log ratio of the shares of toxic and other texts that hit it."""
    share = (hits + 0.5) / (np.array([[negative], [positive]]) + 1)
    return np.clip(np.log(share[1] / share[0]), -3, 3) * (hits.sum(0) >= 3)


def vocabulary(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The table rows of each different word, which of them each text has (int32), and the texts' languages."""
    words, rows, docs, langs = [], [], [], []
    for part in in_chunks(texts):
        hashes, begins = word_hashes(part)
        first = np.unique(hashes[:, 0], return_index=True)[1]
        words.append(hashes[first, 0])
        rows.append(rows_of(hashes[first]))
        docs += np.split(hashes[:, 0].copy(), begins[1:-1])
        langs.append(languages(hashes, begins))
    known, first = np.unique(np.concatenate(words), return_index=True)
    return np.concatenate(rows)[first], [np.searchsorted(known, d).astype(np.int32) for d in docs], np.concatenate(langs)


def constant_model(y: float) -> Model:
    return Model(np.zeros((ROWS, DIM), np.float32), {}, {}, np.zeros(0), 0.0, constant=y)


def first_model(odds: np.ndarray, rng: np.random.Generator) -> Model:
    """One component of the table starts as the word's log odds and one filter as its reader; everything is trained from there."""
    table = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
    table[:, 0] += odds.astype(np.float32) / 4
    table[0] = 0
    filters = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    filters[1][0, 0, 0] = 1.0
    model = Model(table, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    model.out[0] = 1.0
    return model


def first_squares() -> np.ndarray:
    return np.full((ROWS, 1), 1e-3, np.float32)


def learn(model: Model, squares: np.ndarray, rows: np.ndarray, docs: list[np.ndarray], y: np.ndarray, fit: np.ndarray, weights: tuple[float, float], rng: np.random.Generator, *, epochs: int, batch: int = 32) -> None:
    """Adam on filters and output, AdaGrad on the table rows that a maximum touched; model and squares are moved in place. weights: those of a row of either class."""
    weight = np.where(y == 1, weights[1], weights[0])
    state: dict = {}
    step = 0

    def adam(name: object, value: np.ndarray, grad: np.ndarray, rate: float = 3e-3) -> None:
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    bias = np.full(1, model.bias, np.float32)
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            step += 1
            own = fit[at : at + batch]
            sizes = np.array([len(docs[i]) for i in own])
            begins = np.concatenate([[0], np.cumsum(sizes)])
            here, which = np.unique(np.concatenate([docs[i] for i in own]), return_inverse=True)
            x = model.embed(rows[here], which)
            feats, places = [], []
            for w in WIDTHS:
                r = model.responses(x, w)
                where = np.array([r[s:e].argmax(0) + s for s, e in zip(begins[:-1], begins[1:], strict=True)])
                feats.append(np.maximum(r[where, np.arange(FILTERS)], 0))
                places.append(where)
            pooled = np.concatenate(feats, axis=1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + bias[0], -30, 30)))
            delta = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
            back = delta[:, None] * model.out[None, :] * (pooled > 0)
            adam("out", model.out, pooled.T @ delta)
            adam("bias", bias, delta.sum(keepdims=True))
            word = np.concatenate([here[which], np.zeros(PAD, np.int32)])  # the words past the end aren't live
            touched, moves = [], []
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    pos = places[i] + j
                    grad = np.einsum("nf,nfd->df", g, x[pos])
                    toward = g[:, :, None] * model.filters[w][j].T[None]
                    at_rows = rows[word[pos]]
                    live = ((g != 0) & (pos < len(which)))[:, :, None] & (at_rows > 0)
                    touched.append(at_rows[live])
                    moves.append(np.broadcast_to(toward[:, :, None], (*at_rows.shape, DIM))[live])
                    adam((w, j), model.filters[w][j], grad)
                adam((w, "b"), model.biases[w], g.sum(0))
            moved, back_to = np.unique(np.concatenate(touched), return_inverse=True)
            steps = np.concatenate(moves)
            total = np.stack([np.bincount(back_to, steps[:, d], len(moved)) for d in range(DIM)], axis=1).astype(np.float32)
            squares[moved] += (total * total).mean(1, keepdims=True)
            model.table[moved] -= 0.05 * total / np.sqrt(squares[moved])
    model.bias = float(bias[0])


def train(texts: list[bytes], y: np.ndarray, *, epochs: int = 8, batch: int = 32, seed: int = 0) -> Model:
    """The model of rows that lie in one place, all in one part. A fifth of the rows calibrates."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return constant_model(float(y.mean()) if len(y) else 0.0)
    rows, docs, lang = vocabulary(texts)
    order = rng.permutation(len(docs))
    held = order[: len(docs) // 5]
    fit = order[len(docs) // 5 :]
    if len(set(y[fit].tolist())) < 2:
        held, fit = order, order
    n = ((y[fit] == 0).sum(), (y[fit] == 1).sum())
    model = first_model(log_odds(word_hits(rows, [docs[i] for i in fit], y[fit]), *n), rng)
    learn(model, first_squares(), rows, docs, y, fit, (0.5 * len(fit) / n[0], 0.5 * len(fit) / n[1]), rng, epochs=epochs, batch=batch)
    model.thresholds = calibrated(model, rows, [docs[i] for i in held], lang[held], y[held])
    return model


def best_threshold(negative: np.ndarray, positive: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """Midway between the neighbours that give the best F1; of equals the widest gap. Rising bins: rows of either class, least and greatest distance."""
    caught = positive.sum() - np.concatenate([[0], np.cumsum(positive)])  # with the threshold before each place
    called = (negative + positive).sum() - np.concatenate([[0], np.cumsum(negative + positive)])
    f1 = 2 * caught / np.maximum(1, called + positive.sum())
    mids = np.concatenate([[low[0] - 1], (low[1:] + high[:-1]) / 2, [high[-1] + 1]])
    gaps = np.concatenate([[0], low[1:] - high[:-1], [0]])
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(mids[top[gaps[top].argmax()]])


def thresholds_of(bins: pd.DataFrame) -> np.ndarray:
    """One threshold a language of (lang, bin, negative, positive, low, high); a language with fewer than 10 rows of a class keeps that of all rows, and so do texts of no known language."""
    none = np.zeros(len(LANGUAGES) + 1)
    if not len(bins) or not bins["negative"].sum() or not bins["positive"].sum():
        return none

    def best(own: pd.DataFrame) -> float:
        one = own.groupby("bin").agg({"negative": "sum", "positive": "sum", "low": "min", "high": "max"}).sort_index()
        return best_threshold(*(one[c].to_numpy() for c in ("negative", "positive", "low", "high")))

    out = none + best(bins)
    for k in range(len(LANGUAGES)):
        own = bins[bins["lang"] == k]
        if min(own["negative"].sum(), own["positive"].sum()) >= 10:
            out[k] = best(own)
    return out


def calibrated(model: Model, rows: np.ndarray, docs: list[np.ndarray], lang: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Thresholds by the rows one by one."""
    begins = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    z = model.logits(rows, np.concatenate(docs), begins).astype(np.float64) if docs else np.zeros(0)
    return thresholds_of(pd.DataFrame({"lang": lang, "bin": z, "negative": 1 - y, "positive": y, "low": z, "high": z}))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_set(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, raw, toxic) of every labelled document that isn't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).filter("raw IS NOT NULL")
    return texts.join(known, "doc_id").groupBy("doc_id").agg(F.min("raw").alias("raw"), F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, *, max_positive: int = 2000, max_negative: int = 3000) -> list:
    """Some of the training set on the driver, for a look at it: the rows of each class of lowest id hash."""
    rows = training_set(docs, labels)
    few = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_positive), (0, max_negative))]
    return few[0].unionByName(few[1]).orderBy("doc_id").collect()


def parameters(model: Model) -> np.ndarray:
    """What isn't the table, in one row."""
    return np.concatenate([*[model.filters[w].ravel() for w in WIDTHS], *[model.biases[w] for w in WIDTHS], model.out, [model.bias]]).astype(np.float64)


def put(model: Model, values: np.ndarray) -> None:
    at = 0
    for part in (*[model.filters[w] for w in WIDTHS], *[model.biases[w] for w in WIDTHS], model.out):
        part[...] = values[at : at + part.size].reshape(part.shape)
        at += part.size
    model.bias = float(values[at])


MOVES = "block int, n long, moves binary, touched binary"


def mean_move(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean move of one block: of a table row over the parts that touched it, of the other parameters over all, by their rows."""
    total, weight = 0.0, 0.0
    for n, moves, touched in sorted(zip(pdf["n"], pdf["moves"], pdf["touched"], strict=True)):
        w = n * np.frombuffer(touched, dtype=bool).astype(np.float64)[:, None]
        total = total + w * np.frombuffer(moves, dtype=np.float32).reshape(len(w), -1)
        weight = weight + w
    mean = total / np.maximum(weight, 1)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [int(pdf["n"].sum())], "moves": [mean.tobytes()], "touched": [(weight[:, 0] > 0).tobytes()]})


def one_round(fitting: DataFrame, model: Model, squares: np.ndarray, weights: tuple[float, float], seed: int, epochs: int) -> None:
    """Every part (part, items: its rows) goes on from the model; model and squares then move by the mean of the parts' moves."""
    spread = fitting.sparkSession.sparkContext.broadcast((model, squares))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, start_squares = spread.value
        for part, items in ((part, items) for b in batches for part, items in zip(b.column("part").to_pylist(), b.column("items"), strict=True)):
            own, own_squares = pickle.loads(pickle.dumps(spread.value))
            _, raw, y = zip(*sorted((r["doc_id"], r["raw"], r["toxic"]) for r in items.as_py()), strict=True)
            rows, docs, _ = vocabulary(list(raw))
            learn(own, own_squares, rows, docs, np.array(y, dtype=np.int64), np.arange(len(docs)), weights, np.random.default_rng([seed, part]), epochs=epochs)
            moves = np.concatenate([own.table - start.table, own_squares - start_squares], axis=1)
            touched = (moves != 0).any(1)
            out = [(k // BLOCK, len(docs), moves[k : k + BLOCK].tobytes(), touched[k : k + BLOCK].tobytes()) for k in range(0, ROWS, BLOCK)]
            out.append((ROWS // BLOCK, len(docs), (parameters(own) - parameters(start)).astype(np.float32).tobytes(), np.ones(1, dtype=bool).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "moves", "touched"])

    means = fitting.mapInArrow(go, MOVES).groupBy("block").applyInPandas(mean_move, MOVES).collect()  # blocks of one model
    for r in means:
        if r["block"] == ROWS // BLOCK:
            put(model, parameters(model) + np.frombuffer(r["moves"], dtype=np.float64))
        else:
            at, moves = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK), np.frombuffer(r["moves"], dtype=np.float64).reshape(BLOCK, DIM + 1)
            model.table[at] += moves[:, :DIM].astype(np.float32)
            squares[at] += moves[:, DIM:].astype(np.float32)
    spread.destroy()


def all_hits(fitting: DataFrame) -> np.ndarray:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((2, ROWS))
        for b in batches:
            y, at = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), 0
            for part in in_chunks(v.as_py() for v in b.column("raw")):
                rows, docs, _ = vocabulary(part)
                hits += word_hits(rows, docs, y[at : at + len(part)])
                at += len(part)
        label, row = np.nonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(row, pa.int32()), pa.array(hits[label, row].astype(np.int64))], names=["label", "row", "n"])

    out = np.zeros((2, ROWS))
    found = fitting.select("raw", "toxic").mapInArrow(go, "label int, row int, n long").groupBy("label", "row").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * ROWS rows
    out[found["label"], found["row"]] = found["n"]
    return out


def all_thresholds(held: DataFrame, model: Model) -> np.ndarray:
    spread = held.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for b in batches:
            z, lang = [np.zeros(0)], [np.zeros(0, np.int64)]
            for part in in_chunks(v.as_py() for v in b.column("raw")):
                hashes, begins = word_hashes(part)
                z.append(model.logits(*different_words(hashes), begins).astype(np.float64))
                lang.append(languages(hashes, begins))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lang).astype(np.int32)), pa.array(np.concatenate(z)), b.column("toxic")], names=["lang", "z", "toxic"])

    place = F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col("z"))) * FINE)
    bins = held.select("raw", F.col("toxic").cast("int").alias("toxic")).mapInArrow(go, "lang int, z double, toxic int").groupBy("lang", place.alias("bin"))
    return thresholds_of(bins.agg(F.sum(1 - F.col("toxic")).alias("negative"), F.sum("toxic").alias("positive"), F.min("z").alias("low"), F.max("z").alias("high")).toPandas())


def fit_model(docs: DataFrame, labels: DataFrame, *, rounds: int = 4, epochs: int = 2, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES, seed: int = 0) -> Model:
    """Trained on the whole training set, in rounds of parts; a fifth by id hash calibrates."""
    rows = cut(training_set(docs, labels).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0))
    sizes = rows.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("b")).collect()
    n = lambda label, which: sum(r["n"] for r in sizes if r["toxic"] == label and r["held"] in which)
    every = (False, True)
    if not n(0, every) or not n(1, every):
        return constant_model(n(1, every) / max(1, n(0, every) + n(1, every)))
    which = (False,) if n(0, (False,)) and n(1, (False,)) else every
    fitting, held = (rows.filter("NOT held"), rows.filter("held")) if which != every else (rows, rows)
    negative, positive = n(0, which), n(1, which)
    parts = max(1, -(-(negative + positive) // part_rows), -(-sum(r["b"] for r in sizes if r["held"] in which) // part_bytes))
    if parts == 1:
        rounds, epochs = 1, rounds * epochs
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(parts)).alias("part")
    dealt = cut(fitting.groupBy(place).agg(F.collect_list(F.struct("doc_id", "raw", "toxic")).alias("items")))
    model, squares = first_model(log_odds(all_hits(fitting), negative, positive), np.random.default_rng(seed)), first_squares()
    weights = (0.5 * (negative + positive) / negative, 0.5 * (negative + positive) / positive)
    for k in range(rounds):
        one_round(dealt, model, squares, weights, seed + k, epochs)
    model.thresholds = all_thresholds(held, model)
    return model


def score(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score double. The model has a fixed size and goes out as a broadcast variable; of a row, only its text goes to Python and only its score comes back."""
    spread = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = spread.value
        for raw in batches:
            out = [model.scores(part) for part in in_chunks(v.as_py() for v in raw)]
            yield pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())

    return without(df, [score_col]).withColumn(score_col, scored(F.col(text_col).cast("binary")))
