"""Approximate nearest neighbours by collision counting.

Largest inner product becomes smallest distance by one more coordinate: with all vectors scaled by the greatest norm M,
a vector gets sqrt(1 - |x|^2 / M^2) and a query 0. Each of PROJECTIONS random lines has a place for each of a shard's
vectors. A query opens a window around its own place on every line and widens it (virtual rehashing). A vector inside the
windows of a THRESHOLD share of the lines is verified: its distance is measured. A query ends once the windows are so wide that a vector as near as the K-th best
one verified so far has an expected share of collisions of THRESHOLD and MARGIN standard deviations: a nearer one that
has not collided often enough yet is then unlikely. So the windows start as wide as the K-th nearest of a sample of the shard's vectors asks
for; with K verified they become as wide as these ask for, and STEP times wider, in growing steps, with fewer. The data decide what is
verified, and the rule is the same at every size.

Counting is done for 64 vectors at a time. A line is cut into STRETCHES of equally many vectors, and keeps a bit for each vector and border: whether
the vector lies below it. A window ends at the nearest borders, so the exclusive or of two rows of bits says which vectors it holds, and
counts of lines are added up digit by digit, a word for a digit of 64 counts. Queries are counted together over a block of vectors, whose bits stay in the cache.

Vectors are dealt to shards of SHARD_ROWS, and every query meets every shard once: queries are a stated set that is set
against all rows, so the work is rows times queries. A task indexes its shard once, and the queries stream past it; while there are few shards
for the tasks at a time, parts of the queries share a shard, and each part indexes it. A shard gives each query its nearest K, and these are
ranked. Vectors travel in the type they have in the table.

Equal vectors are one, with the K + 1 smallest vec_ids (others can never be among K nearest), so a vector with a third of
all rows is one entry. Sizes of tasks are fixed, whatever the input.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as query nor as
candidate, and neither do vectors whose length differs from the most common one; fewer candidates than K give all; ties go to the smaller vec_id; rows with a repeated vec_id
and vector count once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, trimmed

#: THRESHOLD: share of the lines whose windows must hold a vector. MARGIN: in standard deviations of that share.
K, PROJECTIONS, THRESHOLD, MARGIN, STEP = 20, 240, 0.78, 1.8, 1.1
#: A query's first windows are as wide as this share of a shard's vectors asks for, by a sample of 64 of them.
USUAL = 0.9
#: Stretches of a line, of equally many vectors each: a window ends at the nearest border of one.
STRETCHES = 32
SHARD_ROWS = 65_536
PART_QUERIES = 2_048
#: Vectors and queries that are counted together, so that their bits stay in a core's cache.
BLOCK_ROWS, _AT_ONCE = 16_384, 64


def last_window(threshold: float, margin: float, projections: int) -> float:
    """Half a window's width, by the distance of a vector that it is wide enough for.

    A vector at distance s lies at a normal distance of deviation s on a line, so a window of half width R holds it
    with a chance of 2 Phi(R / s) - 1."""
    share = min(0.999, threshold + margin * (threshold * (1 - threshold) / projections) ** 0.5)
    return NormalDist().inv_cdf((1 + share) / 2)


class CollisionIndex:
    """Places of the vectors of one shard on the lines: for each border of a line's stretches, a bit for each vector below it."""

    def __init__(self, vectors: np.ndarray, norm: float, projections: int = PROJECTIONS, seed: int = 17):
        n, d = vectors.shape
        lines = np.random.default_rng(seed).normal(size=(d + 1, projections))
        self.vectors, self.norm, self.lines = vectors, norm, lines[:-1]
        self.unit, place = np.empty((n, d), np.float32), np.empty((projections, n), np.float32)
        for i in range(0, n, BLOCK_ROWS):
            x = vectors[i : i + BLOCK_ROWS] / np.float64(norm)
            rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
            self.unit[i : i + BLOCK_ROWS], place[:, i : i + BLOCK_ROWS] = x, (x @ lines[:-1] + rest[:, None] * lines[-1]).T
        at = np.minimum(np.arange(STRETCHES + 1) * n // STRETCHES, n - 1)
        borders = np.stack([np.sort(line)[at] for line in place])
        self.middles = (borders[:, :-1] + borders[:, 1:]) / 2
        self.blocks = [self._below(place[:, i : i + BLOCK_ROWS], borders) for i in range(0, n, BLOCK_ROWS)]
        del place
        # the first radius fits the K-th nearest of most vectors
        some = directions(vectors[:: max(1, n // 64)][:64]).astype(np.float32)
        kth = np.array([np.partition(self.unit @ x, n - K - 1)[n - K - 1] for x in some], np.float64) if n > K else np.array([-1.0])
        self.usual = float(np.quantile(np.sqrt(np.maximum(0.0, 2 - 2 * kth)), USUAL))

    @staticmethod
    def _below(place: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """(lines, borders, words of 64 vectors); the first border is below all vectors, the last one above."""
        m, n = place.shape
        bits = np.zeros((m, STRETCHES + 1, -(-n // 64)), np.uint64)
        some = bits.view(np.uint8)[:, :, : -(-n // 8)]
        for j in range(1, STRETCHES):
            some[:, j] = np.packbits(place < borders[:, j : j + 1], axis=1, bitorder="little")
        some[:, STRETCHES] = np.packbits(np.ones(n, bool), bitorder="little")
        return bits

    def _windows(self, places: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The borders nearest to the windows' ends, by line and query."""
        low, high = (places - radius[:, None]).T, (places + radius[:, None]).T
        return (
            np.stack([m.searchsorted(x) for m, x in zip(self.middles, low, strict=True)]),
            np.stack([m.searchsorted(x, "right") for m, x in zip(self.middles, high, strict=True)]),
        )

    def candidates(self, queries: np.ndarray, k: int = K, threshold: float = THRESHOLD, margin: float = MARGIN, step: float = STEP) -> list[np.ndarray]:
        """For each query, the vectors that were verified."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        for q, found, _ in self.verified(queries, k, threshold, margin, step):
            out[q] = found
        return out

    def verified(self, queries: np.ndarray, k: int = K, threshold: float = THRESHOLD, margin: float = MARGIN, step: float = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query, once it ends: its number, the vectors that were verified, their cosines (roughly) by the greatest norm."""
        n, m = len(self.unit), len(self.middles)
        least, wide = m - int((1 - threshold) * m), last_window(threshold, margin, m)
        unit = directions(queries)
        places, rough_unit = unit @ self.lines, unit.astype(np.float32)
        radius, grows = np.full(len(unit), max(wide * self.usual, 1e-9)), np.full(len(unit), step)
        waiting = list(range(len(unit)))[::-1]
        while waiting:  # queries that go on with wider windows are counted together with new ones
            at_once, waiting = waiting[: -_AT_ONCE - 1 : -1], waiting[:-_AT_ONCE]
            low, high = self._windows(places[at_once], radius[at_once])
            held = [collisions(bits, low, high, least) for bits in self.blocks]
            for i, q in enumerate(at_once):
                near = np.concatenate([x[i] + b * BLOCK_ROWS for b, x in enumerate(held)])
                rough = np.take(self.unit, near, axis=0, mode="clip") @ rough_unit[q]
                if len(near) > k:  # k and the query's own vector
                    enough = wide * np.sqrt(max(0.0, 2 - 2 * float(np.partition(rough, len(near) - k - 1)[len(near) - k - 1])))
                else:
                    enough = radius[q] * grows[q]
                    grows[q] *= step
                if len(near) == n or radius[q] >= enough:
                    yield q, near, rough
                else:  # windows as wide as the k-th best so far asks for hold all nearer ones often enough
                    radius[q] = enough
                    waiting.append(q)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Of length one; the greatest component goes first, so that no square overflows."""
    out = vectors.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def collisions(bits: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> list[np.ndarray]:
    """For each query, the vectors of a block that at least so many lines hold between its borders low and high.

    64 vectors are counted at once: counts are kept as binary digits, a word of 64 bits for each digit, and full
    adders make two words of three."""
    shape = (low.shape[1], bits.shape[2])
    spare, digits = [np.empty(shape, np.uint64) for _ in range(2 * len(bits).bit_length() + 4)], [[]]
    xor, both, other = np.bitwise_xor, np.bitwise_and, spare.pop()
    for below, x, y in zip(bits, low, high, strict=True):
        word = spare.pop()
        below.take(y, 0, word, "clip")
        below.take(x, 0, other, "clip")
        xor(word, other, word)  # below the upper border but not below the lower one
        at = 0
        while True:
            if at == len(digits):
                digits.append([])
            held = digits[at]
            held.append(word)
            if len(held) < 3:
                break
            a, b, c = held
            total = spare.pop()
            xor(a, b, total)
            both(a, b, a)
            both(total, c, b)
            xor(a, b, a)  # never both
            xor(total, c, total)
            digits[at] = [total]
            spare += [c, b]
            word = a
            at += 1
    at = 0
    while at < len(digits):
        while len(digits[at]) > 1:
            a, b = digits[at].pop(), digits[at].pop()
            if at + 1 == len(digits):
                digits.append([])
            digits[at + 1].append(a & b)
            digits[at].append(a ^ b)
        at += 1
    enough = np.full(shape, ~np.uint64(0))
    for at in range(max(len(digits), least.bit_length())):
        digit = digits[at][0] if at < len(digits) and digits[at] else np.zeros(shape, np.uint64)
        enough = enough & digit if least >> at & 1 else enough | digit
    wide = 64 * shape[1]
    found = np.flatnonzero(np.unpackbits(enough.view(np.uint8).ravel(), bitorder="little").view(bool))
    cuts = np.searchsorted(found, np.arange(shape[0] + 1) * wide).tolist()
    return [found[a:b] - i * wide for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def exact_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.add.accumulate(vectors.astype(np.float64) * query.astype(np.float64), axis=1)[:, -1] if len(vectors) else np.zeros(0)


def _answers(built: CollisionIndex, ids: list[list[int]], queries: np.ndarray, names: list[int], k: int) -> Iterator[pa.RecordBatch]:
    """The nearest k that a shard has for each query."""
    asked, found, scores = [], [], []
    unsure = 4e-7 * (queries.shape[1] + 8)  # far above what rounding to four bytes does to a cosine
    for j, near, rough in built.verified(queries, k):
        if len(near) > k + 1:  # only those that can be among the nearest are measured exactly
            near = near[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - unsure]
        exact = exact_products(queries[j], built.vectors[near])
        best = sorted((-float(s), i) for s, row in zip(exact, near.tolist(), strict=True) for i in ids[row] if i != names[j])[:k]
        asked += [names[j]] * len(best)
        scores += [-s for s, _ in best]
        found += [i for _, i in best]
    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) and which rows are queries -> query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "neighbours")
    kind = "float" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), is_query.alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1)
    found = width.first()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = scratch.table(rows.where(F.size("v") == found["w"]).distinct())
    one = W.partitionBy("v").orderBy("vec_id")
    some = rows.select("v", "vec_id").withColumn("_r", F.row_number().over(one)).where(F.col("_r") <= k + 1)
    distinct = scratch.table(some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = scratch.table(rows.where("q").select("vec_id", "v"))
    measured = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).first()
    shards = max(1, -(-measured["n"] // SHARD_ROWS))
    # a task for each core, and smaller ones where queries are many against the vectors that each part indexes again
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-cores // shards), min(-(-4 * cores // shards), asked.count() // PART_QUERIES))
    norm = float(np.sqrt(measured["m"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = distinct.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), every(parts).alias("part"), F.lit(False).alias("asks"), "ids", "v")
    stream = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks"), F.array("vec_id").alias("ids"), "v")
    # a shard's vectors come before the queries that are dealt to it
    met = index.union(stream).repartition(8 * shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ids, built = None, [], [], None
        for batch in batches:
            shard, part, asks = (np.asarray(batch.column(c)) for c in ("shard", "part", "asks"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                vectors = np.asarray(some.column("v").flatten()).reshape(b - a, -1)
                if group != (shard[a], part[a]):
                    group, held, ids, built = (shard[a], part[a]), [], [], None
                if not asks[a]:
                    held.append(vectors)
                    ids += some.column("ids").to_pylist()
                    continue
                if not held:  # a shard that no vector fell into
                    continue
                if built is None:
                    built = CollisionIndex(np.concatenate(held), norm)
                yield from _answers(built, ids, vectors, [x[0] for x in some.column("ids").to_pylist()], k)

    met = met.mapInArrow(trimmed(search), "query_id long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
