"""Near-duplicate documents by one-permutation MinHash.

1. One pass over the texts makes, for each document, the set of its shingle hashes (64 bits), its size, a 128-bit id of
   the set and a signature: hashes fall into BINS equal ranges and each range keeps its least (one permutation); an
   empty range borrows from the range that a hash of (range, attempt) names first among the non-empty ones (optimal
   densification). BANDS bands of consecutive ranges become bucket keys. At similarity 0.85 two sets share no bucket with a
   chance under 1e-8.
2. Equal sets are one node, named by its smallest doc_id, so a third of all rows being copies is one row here.
3. In each bucket the node of smallest doc_id is the centre and all others are candidates with it alone: pairs grow
   as members, not their square.
4. Candidates are confirmed on their full sets, read from the whole texts, and links give components.
5. A star may miss a link between two members that are not the centre. Buckets whose members are still in different
   components stay open. Pairs of open nodes that share a rare shingle (one of RARE open nodes at most) are found by
   these shingles and compared where sizes and counts allow a link. In all other pairs rare shingles count for
   nothing, which bounds intersections and rules most of them out. The rest is opened with eight times as many centres each
   time, without those that were centres, until every pair of a bucket is compared, ruled out or in one component.
   Centres are drawn by a hash against the bucket's number of members, which is aggregated before the shuffle, and the
   members of a large bucket are dealt over parts of PART that each get the centres: no task holds a whole bucket.
   Nothing is capped.

Cases: null, empty or blank texts have the empty set and are linked with nothing; fewer words than a shingle make one
shingle; texts are read whole; rows that repeat are equal sets; rows that share a doc_id count as one document; rows without
doc_id are linked with nothing and kept; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, WordHash, chunks, grams, kept, mix, split_all, texts, trimmed
from quarrymill.llm.components import components

SHINGLE, SIMILARITY = 5, 85
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: A shingle of this many open nodes, or fewer, is rare.
RARE = 24
#: Members of a bucket that meet its centres in one task.
PART = 4096
_ATTEMPTS = 1024


def shingle_sets(docs: list[bytes], hashes: WordHash, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z read as a-z."""
    words, at = split_all([x.lower() for x in docs])
    h = hashes.of(words)
    g = grams(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - k + 1]) if b - a >= k else mix(grams(h[a:b], b - a) + np.uint64(b - a)) if b > a else g[:0])
    return out


class OnePermutation:
    """Densified one-permutation signatures, as bucket keys of bands."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 3):
        self.bands, self.rows, n = bands, rows, bands * rows
        self.low = np.array([(i << 64) // n for i in range(n)], np.uint64)
        self.high = np.array([((i + 1) << 64) // n - 1 for i in range(n)], np.uint64)
        rng = np.random.default_rng(seed)
        self.donor = rng.integers(0, n, (_ATTEMPTS, n), dtype=np.int32)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.odd = mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, self.low)
        value = s[np.minimum(at, len(s) - 1)]
        full = (at < len(s)) & (value <= self.high) & (value >= self.low)
        empty = np.flatnonzero(~full)
        source = np.arange(len(full))
        for row in self.donor:
            if not len(empty):
                break
            found = full[row[empty]]
            source[empty[found]] = row[empty[found]]
            empty = empty[~found]
        if len(empty):  # a few values in many ranges: the first range that has one
            source[empty] = np.flatnonzero(full)[0]
        return value[source]

    def keys(self, s: np.ndarray) -> np.ndarray:
        v = self.signature(s).reshape(self.bands, self.rows)
        return mix((mix(v) * self.odd).sum(1, dtype=np.uint64) + self.salt).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, set_id, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scheme = kept("words", WordHash), OnePermutation()
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(texts(part), hashes)
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                bands = [scheme.keys(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_shingles long, set_id binary, bands array<long>")


def confirm(pairs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(a, b, text_a, text_b) -> a, b of those whose full sets are similar enough: 100 common >= similarity * all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("words", WordHash)
        sets: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                one, two = texts(part, "text_a"), texts(part, "text_b")
                new = [t for t in {*one, *two} if t not in sets]
                if sum(map(len, sets)) + sum(map(len, new)) > 16 << 20:
                    sets.clear()
                    new = list({*one, *two})
                sets.update(zip(new, shingle_sets(new, hashes), strict=True))
                good = []
                for x, y in zip(one, two, strict=True):
                    s, t = sets[x], sets[y]
                    common = 0
                    if len(s) and len(t) and 100 * min(len(s), len(t)) >= similarity * max(len(s), len(t)):
                        common = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(common > 0 and 100 * common >= similarity * (len(s) + len(t) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(trimmed(run), "a long, b long")


def shingle_rows(texts_of: DataFrame) -> DataFrame:
    """(node, text) -> node, g: a row for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("words", WordHash)
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(texts(part), hashes)
                nodes = np.repeat(np.asarray(part.column("node"), np.int64), [len(s) for s in sets])
                g = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                for i in range(0, len(g), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(g[i : i + 100_000])], names=["node", "g"])

    return texts_of.mapInArrow(trimmed(run), "node long, g long")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    ids = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.table(signatures(docs))
    nodes = scratch.table(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("node")))
    first = signed.join(nodes, (signed["set_id"] == nodes["set_id"]) & (signed["doc_id"] == nodes["node"])).select("node", F.col("n_shingles").alias("n"), "bands")
    banded = first.select("node", "n", F.explode("bands").alias("key"))
    crowds = banded.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("_b")).where("centre < _b").select("key", "centre")
    shared = scratch.table(banded.join(crowds, "key").select("key", "node", "n", "centre").distinct())
    # the bands, most of what was written so far, have served
    signed, wide = scratch.table(signed.drop("bands")), signed
    scratch.drop(wide)
    members = shared.select("node").distinct()
    # the texts of all candidates, once: what follows reads these and no longer all documents
    whole = scratch.table(docs.join(members, docs["doc_id"] == members["node"]).select("node", "text"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that the full sets confirm."""
        left = pairs.join(whole.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(whole.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return scratch.table(confirm(both.select("a", "b", "text_a", "text_b"), similarity).distinct())

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()

    tried = scratch.table(ordered(shared.select(F.col("centre").alias("x"), F.col("node").alias("y"))))
    links = linked(tried)
    labels = scratch.table(components(links, scratch))

    def compare(pairs: DataFrame) -> None:
        """Confirms pairs that were not compared yet, and takes their links in."""
        nonlocal tried, links, labels
        fresh = scratch.table(pairs.join(tried, ["a", "b"], "left_anti"))
        old, tried = tried, scratch.table(tried.union(fresh))
        scratch.drop(old)
        found = linked(fresh)
        scratch.drop(fresh)
        if not found.isEmpty():
            links = scratch.table(links.union(found))
            labels = scratch.table(components(links, scratch))

    waiting, centres, sifted = shared.where("node <> centre").select("key", "node", "n", F.col("n").alias("m")), 1, False

    def narrowed(rows: DataFrame) -> DataFrame:
        """Of the buckets with more than one component the members that may have a link in it: m, of which no
        intersection is larger, against the smallest size and the largest m there."""
        of = rows.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.min("n").alias("_n"), F.max("m").alias("_m")).where("_a < _b")
        enough = (100 + similarity) * F.least("m", "_m") >= similarity * (F.col("n") + F.col("_n"))
        return rows.join(of, "key").where(enough).select("key", "node", "n", "m", "label")

    #: a member's place in an order of the bucket's own, from 0 to 1: a node is a centre at other times in other buckets
    drawn = F.xxhash64("key", "node").cast("double") / 2.0**64 + 0.5

    while True:
        seen = waiting.join(labels, "node", "left").select("key", "node", "n", "m", F.coalesce("label", "node").alias("label"))
        seen = scratch.table(narrowed(seen))
        if seen.isEmpty():
            break
        if not sifted:
            # rare: shingles of at most RARE open nodes. Who has so many that the rest is too little for a link can be
            # linked only with a node that shares some of them; such pairs are few, and are found by those shingles
            sizes = seen.select("node", "n", "label").distinct()
            rows = scratch.table(shingle_rows(whole.join(sizes.select("node"), "node")))
            rare = rows.join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") <= RARE), "g")
            held = scratch.table(sizes.join(rare.groupBy("node").agg(F.count(F.lit(1)).alias("r")), "node", "left").fillna(0, ["r"]))
            some = rare.where("_c > 1").select("g", "node")
            met = some.select("g", F.col("node").alias("a")).join(some.select("g", F.col("node").alias("b")), "g").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
            for x in ("a", "b"):
                met = met.join(held.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("label").alias(f"l_{x}"), (F.col("n") - F.col("r")).alias(f"m_{x}")), x)
            most = F.least("m_a", "m_b") + F.col("s")
            pairs = met.where((F.col("l_a") != F.col("l_b")) & ((100 + similarity) * most >= similarity * (F.col("n_a") + F.col("n_b")))).select("a", "b")
            compare(pairs)
            # pairs with a rare shingle in common are done: in any other, a node's rare shingles count for nothing
            waiting = scratch.table(seen.drop("m").join(held.select("node", (F.col("n") - F.col("r")).alias("m")), "node").select("key", "node", "n", "m"))
            scratch.drop(rows)
            sifted = True
            continue
        centres *= 8
        # about that many members of each bucket, and the first one always, so that every round closes on the end
        crowd = seen.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.min(drawn).alias("_first"))
        middle = seen.join(crowd, "key").where((drawn * F.col("_c") < centres) | (drawn == F.col("_first")))
        middle = scratch.table(middle.withColumn("_parts", F.ceil(F.col("_c") / PART).cast("int")).drop("_c", "_first"))
        spread = middle.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        others = seen.join(crowd.select("key", F.ceil(F.col("_c") / PART).cast("int").alias("_k")), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
        others = others.select("key", "part", F.col("node").alias("y"), F.col("n").alias("_n"), F.col("m").alias("_m"), F.col("label").alias("_other"))
        fits = (100 + similarity) * F.least("m", "_m") >= similarity * (F.col("n") + F.col("_n"))
        pairs = spread.join(others, ["key", "part"]).where((F.col("label") != F.col("_other")) & fits).select(F.col("node").alias("x"), "y")
        compare(ordered(pairs))
        waiting = seen.join(middle.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n", "m")
    names = nodes.join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("label"))
    rows = signed.select("doc_id", "n_shingles", "set_id").join(names, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    scratch.only(signed, nodes, labels)
    return rows.select(F.col("doc_id").cast(ids).alias("doc_id"), "n_shingles", component.cast(ids).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The documents, all columns, without those that a document of smaller doc_id stands for.

    The ids of these are written, so that Spark knows their size before it plans the join: it broadcasts them only if small."""
    scratch = Scratch(docs.sparkSession, "minhash")
    gone = scratch.table(near_duplicates(docs, similarity, scratch).where("NOT kept").select(F.col("doc_id").alias("_gone")))
    scratch.only(gone)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
