"""Passages that stand in an earlier document: FM-index shards that documents are streamed through.

A window is ``width`` consecutive words. A word goes if a window over it also starts in a document of smaller doc_id.

Sending every document past every shard would take documents times shards. Here content decides the shard:

1. Each document is read for its GRAM-word grams. Kept are those whose hash is among the least 1/SAMPLE, and the least
   of each window (its anchor). A gram in one document alone rules out every window over it.
2. The shared grams go back to their documents. What is left there are runs of windows all of whose kept grams are
   shared; windows with the same anchor make a segment (at most RUN windows). Equal windows have equal anchors, so
   they meet in one shard.
3. Equal segments are one, with the least doc_id of them (aggregated before the shuffle), so copies cost one segment.
4. A shard builds an FM-index of its segments and streams them through it: matching statistics name the windows that
   have their full width in the index, and of each the least doc_id that has it.
5. The answers go back to the documents that hold the segment, as intervals of words.

An anchor in more than HOT documents would make one shard large; its windows are sent one by one, by their own hash.
Shards hold about SHARD_WORDS words, so their number grows with the input and their size does not.

Cases: null, empty and short texts have no window and lose nothing; a window twice in one document is no copy; texts
are read whole; rows without doc_id are before and after nothing and lose nothing; rows that repeat a doc_id are expected to repeat its text (each loses the same words); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, WordHash, chunks, grams, kept, sha256_hex, split_all, texts, trimmed
from quarrymill.llm.fm_index import FMIndex

WIDTH, GRAM, SAMPLE, RUN = 50, 8, 16, 64
HOT, SHARD_WORDS = 16_384, 200_000


def _least_in_windows(g: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    out, width = g, 1
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:]) if len(out) > width else out[:0]
        width *= 2
    rest = k - width
    return (np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


class Windows:
    """The grams, anchors and documents of the places of some texts."""

    def __init__(self, docs: list[bytes], hashes: WordHash, width: int = WIDTH, gram: int = GRAM, sample: int = SAMPLE):
        self.words, self.bounds = split_all(docs)
        self.width, self.gram, self.limit = width, gram, np.uint64(2**64 // sample)
        self.g = grams(hashes.of(self.words), gram)
        self.anchor = _least_in_windows(self.g, width - gram + 1)

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """(gram, document) of the grams that rule windows in or out."""
        n = np.diff(self.bounds)
        doc = np.repeat(np.arange(len(n)), n)
        some = doc[: len(self.g)]
        at = np.flatnonzero((self.g < self.limit) & (some == doc[self.gram - 1 :][: len(self.g)]) & (n[some] >= self.width))
        whole = doc[: len(self.anchor)] == doc[self.width - 1 :][: len(self.anchor)]
        new = np.ones(len(self.anchor), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | ~whole[:-1]
        more = np.flatnonzero(whole & new & (self.anchor >= self.limit))
        return np.concatenate([self.g[at], self.anchor[more]]), np.concatenate([some[at], doc[more]])

    def segments(self, i: int, shared: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, windows, anchor) of document i's runs, given the shared grams that it holds, sorted."""
        b, e = int(self.bounds[i]), int(self.bounds[i + 1])
        n = e - b - self.width + 1
        if n <= 0 or not len(shared):
            return []
        known = lambda x: shared[np.minimum(np.searchsorted(shared, x), len(shared) - 1)] == x
        g, anchor = self.g[b : e - self.gram + 1], self.anchor[b : b + n]
        bad = (g < self.limit) & ~known(g)
        total = np.zeros(len(g) + 1, np.int64)
        np.cumsum(bad, out=total[1:])
        span = self.width - self.gram + 1
        good = np.flatnonzero((total[span:] == total[:-span])[:n] & known(anchor))
        if not len(good):
            return []
        new = np.flatnonzero((np.diff(good, prepend=-2) != 1) | (anchor[good] != np.roll(anchor[good], 1)))
        out = []
        for a, z in zip(new.tolist(), [*new[1:].tolist(), len(good)], strict=True):
            for s in range(a, z, RUN):
                out.append((int(good[s]), min(RUN, z - s), int(anchor[good[s]])))
        return out


def kept_grams(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) -> gram, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("words", WordHash)
        for batch in batches:
            for part in chunks(batch):
                ids = np.asarray(part.column("doc_id"), np.int64)
                g, doc = Windows(texts(part), hashes, width).kept()
                for i in range(0, len(g), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 100_000].view(np.int64)), pa.array(ids[doc[i : i + 100_000]])], names=["gram", "doc_id"])

    return docs.mapInArrow(trimmed(run), "gram long, doc_id long")


def candidate_segments(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, grams, hot) -> anchor, content_id, content, n_words, doc_id, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("words", WordHash)
        for batch in batches:
            for part in chunks(batch):
                windows = Windows(texts(part), hashes, width)
                shared, hot = part.column("grams"), part.column("hot")
                rows: list[tuple] = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    s = np.sort(np.asarray(shared[i].values, np.int64).view(np.uint64))
                    h = set(np.asarray(hot[i].values, np.int64).view(np.uint64).tolist())
                    b = int(windows.bounds[i])
                    for first, n, anchor in windows.segments(i, s):
                        pieces = [(first, n, anchor)] if anchor not in h else [(first + k, 1, None) for k in range(n)]
                        for at, m, key in pieces:
                            content = b" ".join(windows.words[b + at : b + at + m + width - 1])
                            name = xxhash.xxh3_128_digest(content)
                            key = int.from_bytes(name[:8], "little") if key is None else key
                            rows.append((key - (1 << 64) if key >= 1 << 63 else key, name, content, m + width - 1, doc_id, at))
                    if len(rows) >= 5000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return docs.mapInArrow(trimmed(run), "anchor long, content_id binary, content binary, n_words int, doc_id long, start int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "content_id", "content", "n_words", "doc_id", "start"])


def shard_answers(segments: pa.Table, width: int = WIDTH) -> pa.Table:
    """(content_id, content, least) of one shard -> content_id, runs: stretches of windows [low, high) with the least
    doc_id that holds them."""
    hashes = kept("words", WordHash)
    words, bounds = split_all(segments.column("content").to_pylist())
    symbols = hashes.of(words)
    index = FMIndex(symbols, bounds, np.asarray(segments.column("least"), np.int64), width)
    least = index.least_label(*index.matching_statistics(symbols, bounds))
    runs = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        some = least[a : b - width + 1]
        new = np.flatnonzero(np.diff(some, prepend=-1))
        runs.append([{"low": x, "high": y, "least": int(some[x])} for x, y in zip(new.tolist(), [*new[1:].tolist(), len(some)], strict=True)])
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("least", pa.int64())]))
    return pa.table({"content_id": segments.column("content_id").combine_chunks(), "runs": pa.array(runs, kind)})


def copied_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) -> doc_id, spans array<struct<low, high>>: intervals of words [low, high) that earlier documents
    hold, for the documents that have any."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = scratch.table(kept_grams(docs, width))
    shared = held.groupBy("gram").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a < _b")
    shared = shared.select("gram", (F.col("_n") > HOT).alias("hot"))
    mine = held.join(shared, "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("hot"))
    segments = scratch.table(candidate_segments(docs.join(mine, "doc_id"), width))
    scratch.drop(held)
    total = segments.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD_WORDS))
    distinct = segments.groupBy("anchor", "content_id", "content").agg(F.min("doc_id").alias("least"))
    keyed = distinct.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "content_id", "content", "least")
    answers = keyed.groupBy("shard").applyInArrow(lambda t: shard_answers(t, width), "content_id binary, runs array<struct<low:int,high:int,least:long>>")
    back = segments.select("content_id", "doc_id", "start").join(answers, "content_id").select("doc_id", "start", F.explode("runs").alias("r"))
    gone = back.where("r.least < doc_id").select("doc_id", F.struct((F.col("start") + F.col("r.low")).alias("low"), (F.col("start") + F.col("r.high") + (width - 1)).alias("high")).alias("span"))
    return gone.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def remove_copied(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept_text (what is left, joined by one space; the
    text as it was if nothing went)."""
    spans = copied_intervals(docs, width).select(F.col("doc_id").alias("_id"), "spans")
    rows = docs.select("doc_id", "text").join(spans, F.col("doc_id").cast("long") == F.col("_id"), "left").drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n, gone, digest, left = [], [], [], []
                spans = part.column("spans").to_pylist()
                raw = part.column("text").cast(pa.binary()).to_pylist()
                for text, some in zip(raw, spans, strict=True):
                    words = (text or b"").split()
                    n.append(len(words))
                    out = words
                    if some:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for s in some:
                            edge[s["low"]] += 1
                            edge[s["high"]] -= 1
                        stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                        out = [words[k] for k in stay.tolist()]
                    joined = b" ".join(out)
                    gone.append(len(words) - len(out))
                    digest.append(sha256_hex(joined))
                    left.append(text if not some else joined)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
