"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

A word is seen through three features: itself in lower case, its shape (runs of upper case, lower case, digits and
signs) and its ending; a word that repeats the one before it has a fourth. Each feature falls into one of BUCKETS
buckets, and each bucket has a sparse ternary index vector made from its number. A bucket's word vector is its index
vector plus the normed sum of the index vectors that stand beside it in the sample (its context vector). A document
is the mean of its words' vectors. A network of one hidden layer, fitted with Adam in numpy, gives a logit, and a temperature
fitted on a part of the sample that the network has not seen turns it into a probability.

Bound, documented: fitting uses SAMPLE_ROWS labelled documents at most, those with the smallest hash of doc_id, whole
texts each. What the driver gets from them is one vector per document and one matrix of fixed size per task (8 tasks).
Scoring is one pass over all documents without a shuffle.

Cases: null and empty texts are the zero vector and get a score like any other; texts are never cut; labels that are null are not
used, and a doc_id labelled more than once counts with its smallest label; with no usable labels, or labels of one
kind only, all scores are that kind's share (0.5 without any); an empty table gives an empty result; repeated rows are
scored one by one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, chunks, kept, texts, trimmed

SAMPLE_ROWS = 20_000
BUCKETS, DIMENSIONS, HIDDEN = 8192, 64, 32
THRESHOLD = 0.3
_PART = 1 << 20  # bytes of text read at a time
_DOCS = 128  # documents pooled at a time: a matrix of documents by buckets stands in memory meanwhile
_RUNS = re.compile(rb"([A-Z]+)|([a-z\x80-\xff]+)|([0-9]+)|([^A-Za-z0-9\x80-\xff]+)")
_TASKS = 8


def index_vectors(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """Sparse ternary: an eighth of each vector's places are +1 or -1."""
    rng = np.random.default_rng(seed)
    signs = rng.integers(0, 2, (buckets, dimensions)) * 2 - 1
    return (signs * (rng.random((buckets, dimensions)) < 1 / 8)).astype(np.float32)


class Features(dict):
    """The three buckets of a word, for words seen lately."""

    def __init__(self, buckets: int = BUCKETS, limit: int = 200_000):
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        shape = bytes(m.lastindex + (8 if len(m[0]) > 1 else 0) for m in _RUNS.finditer(word))
        third = self.buckets // 4  # shapes and endings have a quarter of the buckets each, words the rest
        a = xxhash.xxh3_64_intdigest(word.lower()) % (2 * third)
        b = 2 * third + xxhash.xxh3_64_intdigest(shape, 1) % third
        c = 3 * third + xxhash.xxh3_64_intdigest(word[-3:], 2) % third
        out = self[word] = a | b << 20 | c << 40
        return out


def buckets_of(words: list[bytes], known: Features) -> np.ndarray:
    """(3, words) buckets: word, shape, ending."""
    x = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return np.stack([x & 0xFFFFF, x >> 20 & 0xFFFFF, x >> 40])


def _flat(docs: list[bytes], known: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, the document of each word, and which words repeat the one before."""
    split = [x.split() for x in docs]
    of = np.repeat(np.arange(len(docs)), [len(x) for x in split])
    words = [w for x in split for w in x]
    b = buckets_of(words, known)
    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (b[0, 1:] == b[0, :-1]) & (of[1:] == of[:-1])
    return b, of, again


def context_sums(docs: list[bytes], known: Features, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors that stand beside each bucket's words: of the words before and after, and of the ending
    of the word after."""
    out = np.zeros_like(index)
    b, of, _ = _flat(docs, known)
    if b.shape[1] < 2:
        return out
    beside = of[1:] == of[:-1]
    left, right = b[:, :-1][:, beside], b[:, 1:][:, beside]
    for here, there in ((left[0], right[0]), (right[0], left[0]), (left[0], right[2]), (left[1], right[0]), (left[2], right[0])):
        pairs, n = np.unique(here * len(index) + there, return_counts=True)
        for i in range(0, len(pairs), 50_000):  # sorted by the first bucket: sums of stretches
            first, second = pairs[i : i + 50_000] // len(index), pairs[i : i + 50_000] % len(index)
            starts = np.flatnonzero(np.diff(first, prepend=-1))
            out[first[starts]] += np.add.reduceat(index[second] * n[i : i + 50_000, None].astype(np.float32), starts)
    return out


def pooled(docs: list[bytes], known: Features, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each document's words (drawn to zero for a few words), the share of words that repeat the
    one before, and the log of the number of words."""
    if len(docs) > _DOCS:
        return np.concatenate([pooled(docs[i : i + _DOCS], known, vectors) for i in range(0, len(docs), _DOCS)])
    b, of, again = _flat(docs, known)
    n, k = len(docs), len(vectors)
    keys = np.concatenate([(of * k + x) for x in b] + [of[again] * k + k - 1])
    counts = np.bincount(keys, minlength=n * k).reshape(n, k).astype(np.float32)
    words = np.bincount(of, minlength=n).astype(np.float32)
    mean = (counts @ vectors) / (words + 2)[:, None]
    repeats = np.bincount(of[again], minlength=n) / (words + 2)
    return np.concatenate([mean, repeats[:, None], np.log1p(words)[:, None] / 8], axis=1).astype(np.float32)


class Network:
    """tanh layer, logit, temperature."""

    def __init__(self, seed: int = 5):
        self.seed, self.temperature, self.constant = seed, 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return (h @ self.w2 + self.b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.logits(x).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3) -> Network:
        if len(y) < 10 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-3
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        xs, ys = (x - self.mean) / self.scale, y.astype(np.float64)
        best = (np.inf, p)
        for _ in range(epochs):
            rng.shuffle(used)
            for i in range(0, len(used), batch):
                k = used[i : i + batch]
                h = np.tanh(xs[k] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - ys[k, None]) / len(k)
                back = (g @ p[2].T) * (1 - h * h)
                grads = [xs[k].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], g.sum(0)]
                t += 1
                for j, q in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * q
                    v[j] = 0.999 * v[j] + 0.001 * q * q
                    p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
            self.w1, self.b1, self.w2, self.b2 = p
            if (loss := _loss(self.logits(x[held]), ys[held])) < best[0]:
                best = (loss, [a.copy() for a in p])
        self.w1, self.b1, self.w2, self.b2 = best[1]
        z = self.logits(x[held])
        self.temperature = min(np.geomspace(0.2, 8, 60), key=lambda c: _loss(z / c, ys[held]))
        return self


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors and network, from labelled rows outside the held-out fold (remainder 0 of 5)."""
    usable = labels.where(F.col(label).isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    some = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    scratch = Scratch(docs.sparkSession, "quality")
    chosen = scratch.table(some)
    # sample_rows rows of two numbers at most
    sample = scratch.table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_label").repartition(_TASKS))
    index = index_vectors()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = kept("features", Features), np.zeros_like(index)
        for batch in batches:
            for part in chunks(batch, _PART):
                total += context_sums(texts(part), known, index)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = sum((np.frombuffer(r["sums"], np.float32).reshape(index.shape) for r in sample.mapInArrow(trimmed(contexts), "sums binary").collect()), np.zeros_like(index))
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = index + np.where(norm > 0, sums / np.maximum(norm, 1e-9), 0).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("features", Features)
        for batch in batches:
            for part in chunks(batch, _PART):
                x = pooled(texts(part), known, vectors)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column("_label")], names=["x", "y"])

    rows = sample.mapInArrow(trimmed(features), "x binary, y int").collect()  # sample_rows at most, 264 bytes each
    rows.sort(key=lambda r: bytes(r["x"]))  # the fit does not depend on the order in which tasks end
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), DIMENSIONS + 2)
    model = Network().fit(x, np.array([r["y"] for r in rows], np.int64))
    scratch.drop(sample, chosen)
    return vectors, model


def score(docs: DataFrame, vectors: np.ndarray, model: Network) -> DataFrame:
    """(doc_id, text) -> doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("features", Features)
        for batch in batches:
            for part in chunks(batch, _PART):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(pooled(texts(part), known, vectors)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, vectors: np.ndarray, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("features", Features)
        for batch in batches:
            for part in chunks(batch, _PART):
                good = model.score(pooled(texts(part), known, vectors)) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(trimmed(run), docs.schema)
