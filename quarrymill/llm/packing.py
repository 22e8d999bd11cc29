"""Best-fit packing by a configuration linear program over the length histogram.

Pieces are at most ``capacity`` tokens long, so their histogram has at most ``capacity`` rows whatever the input's
size: it is all that the driver gets. There,

* multiplicative weights solve the configuration LP: lengths carry prices that fall as they are covered, and
  an unbounded knapsack (dynamic programming over the capacity) finds the sequence pattern of most worth to them;
* patterns are taken as often as the rounded-down solution says, never past what is left of any length;
* what is left is packed by best fit: a pattern starts with the longest length left, takes at each step the longest
  that still fits (or, if that misses the least number there can be, the set that fills it most), and is used as
  often as the counts allow.

The outcome is a list of patterns with multiplicities, of bounded size. A piece's place follows from its rank among the pieces of its length:
ranks are given without one task seeing all pieces of a length (a third may share one), by counts of (length, bucket).

Cases: null text is empty, and an empty document is one piece of the end token alone; documents over capacity are cut
into full pieces and a rest; repeated rows are packed each on its own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, chunks, kept, texts, trimmed

CAPACITY = 2048
ROUNDS = 300
#: Pieces of a (length, bucket) group, about, once a length has more.
BUCKET_ROWS = 1000


class WordTokens(dict):
    """Token ids of a word as little-endian unsigned 32-bit numbers, by a tokenizer that drops white space, lowers
    case and marks word ends; kept for words seen lately, in a bounded table.

    Most words are letters with a run of signs after them. The tokenizer cuts between the two, so letters and runs are
    learnt apart, letters many at a time in one string: the marked word ends say where one ends."""

    SIGNS = ".,;:!?$%&*#|"

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.runs = Tokenizer.from_file(path), limit, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        probe = ["Ab", "c", "Zq,", "Éa", "12x"]
        if b"".join(self._one(_lowered(w.encode()).decode()) for w in probe) != self._one(" \n".join(probe)) or not self.ends[np.frombuffer(self._one("ab"), "<u4")[-1]]:
            raise ValueError(f"{path} is no tokenizer that drops white space, lowers case and marks word ends")

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.limit:
            kept = [(w, self[w]) for w in words if w in self]
            self.clear()
            self.update(kept)
        parts, letters, rest, runs = [], [], [], set()
        signs = self.SIGNS.encode()
        for w in new:
            core = w.rstrip(signs)
            if not core or not (core.isalpha() or core.decode("utf-8", "replace").lower().isalpha()):
                rest.append(w)
            elif len(core) == len(w):
                letters.append(w)
            else:
                parts.append((w, core, w[len(core) :]))
        known = set(letters)
        for _, core, run in parts:
            runs.add(run)
            if core not in known and core not in self:
                known.add(core)
                letters.append(core)
        self._learn_letters(letters)
        for run in runs - self.runs.keys():
            self.runs[run] = self._one(run.decode())
        for w, core, run in parts:
            self[w] = self[core] + self.runs[run]
        if len(self.runs) > 100_000:
            self.runs = {}
        for w in rest:
            self[w] = self._one(w.decode("utf-8", "replace"))

    def _one(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_letters(self, words: list[bytes]) -> None:
        lots = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for k in range(0, len(lots), 64):
            some = lots[k : k + 64]
            for lot, e in zip(some, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in some], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, "<u4")
                at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
                if len(at) != len(lot) + 1:  # a letter that lower case or composition turns into something else
                    self.update((w, self._one(w.decode())) for w in lot)
                    continue
                raw = ids.tobytes()
                self.update((w, raw[x:y]) for w, x, y in zip(lot, at[:-1], at[1:], strict=True))


def _lowered(text: bytes) -> bytes:
    """A-Z in lower case, as the tokenizer reads them, unless the text may hold a special token's string."""
    return text if b"<|" in text else text.lower()


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32: one row for each piece."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(f"pieces of {tokenizer_path}", lambda: WordTokens(tokenizer_path))
        for batch in batches:
            for part in chunks(batch):
                rows, piece, start, length, crc = [], [], [], [], []
                split = [_lowered(x).split() for x in texts(part)]
                known.learn(set().union(*split))
                for i, words in enumerate(split):
                    ids = b"".join(map(known.__getitem__, words)) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        some = ids[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(some) // 4)
                        crc.append(zlib.crc32(some))
                ids_of = part.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes, as counts, of most worth within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if fit:
            worth = best[c - sizes[:fit]] + prices[:fit]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-15:
                best[c], pick[c] = worth[k], k
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return counts


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, a fractional solution of: cover the demand by the fewest patterns.

    Multiplicative weights: a length's price starts a little above its share of the capacity and falls by exp(-step x
    share covered); what is covered has no price. Each round plays the pattern of most worth as often as the first of
    its lengths to be covered allows. Rounds are bounded; lengths that are not covered by then are left to rounding."""
    price, covered = (sizes / capacity) ** 1.05, np.zeros(len(sizes))
    out = []
    for _ in range(min(rounds, 2 * len(sizes))):
        weight = np.where(covered < 1 - 1e-9, price * np.exp(-step * covered), 0.0)
        open_ = weight > 0
        if not open_.any():
            break
        counts = np.zeros(len(sizes), np.int64)
        counts[open_] = _knapsack(weight[open_], sizes[open_], capacity)
        used = counts > 0
        amount = float((demand[used] * (1 - covered[used]) / counts[used]).min())
        covered += amount * counts / demand
        out.append((counts, amount))
    return out


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A pattern from what is left, longest first and then the longest that fits, and how often it can be used."""
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        fit = np.flatnonzero((sizes <= room) & (left > counts))
        if not len(fit):
            break
        k = fit[-1]
        n = min(room // sizes[k], left[k] - counts[k])
        counts[k] += n
        room -= n * sizes[k]
    used = counts > 0
    return counts, int((left[used] // counts[used]).min())


def _fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A pattern with the longest length left and those others that fill the sequence most, larger ones before smaller,
    and how often it can be used. The sums that can be reached are the bits of one number."""
    counts = np.zeros(len(sizes), np.int64)
    first = int(np.flatnonzero(left)[-1])
    counts[first] = 1
    room = capacity - int(sizes[first])
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for k in range(first, -1, -1):
        size, n = int(sizes[k]), int(left[k] - counts[k])
        n, m = min(n, room // size), 1
        while n > 0:
            m = min(m, n)
            steps.append((k, m, reach))
            reach |= reach << (size * m) & mask
            n, m = n - m, 2 * m
    fill = reach.bit_length() - 1
    for k, m, before in reversed(steps):
        if not before >> fill & 1:
            counts[k] += m
            fill -= m * int(sizes[k])
    used = counts > 0
    return counts, int((left[used] // counts[used]).min())


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts by size) and how many sequences each makes, that hold every piece exactly once."""
    order = np.argsort(sizes)
    sizes, demand = np.asarray(sizes)[order], np.asarray(demand)[order].astype(np.int64)
    if not len(sizes):
        return []

    def rounded(configurations: list[tuple[np.ndarray, float]], rest: Callable) -> list[tuple[np.ndarray, int]]:
        left, out = demand.copy(), []
        waste = lambda c: capacity - int((c * sizes).sum())
        for counts, amount in sorted(configurations, key=lambda x: (waste(x[0]), -x[1])):
            used = counts > 0
            n = min(int(amount), int((left[used] // counts[used]).min()))
            if n > 0:
                left -= n * counts
                out.append((counts, n))
        while left.any():
            counts, n = rest(sizes, left, capacity)
            left -= n * counts
            out.append((counts, n))
        back = np.argsort(order)
        return [(c[back], n) for c, n in out]

    total = lambda plan: sum(n for _, n in plan)
    least = -(-int((sizes * demand).sum()) // capacity)
    solved, best = solve_configurations(sizes, demand, capacity, rounds), None
    # the LP's patterns with the rest by best fit; where that isn't the least there can be, the rest by fullest
    # sequences, and either rule without the LP, whose whole parts say little where lengths occur once or twice
    for configurations, rest in ((solved, _best_fit), (solved, _fullest), ([], _fullest), ([], _best_fit)):
        plan = rounded(configurations, rest)
        if best is None or total(plan) < total(best):
            best = plan
        if total(best) == least:
            break
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, length, ...)."""
    spark = pieces.sparkSession
    pieces = Scratch(spark, "packing").table(pieces)
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    sizes = np.array(sorted(r["length"] for r in found), np.int64)
    demand = np.array([r["n"] for r in sorted(found, key=lambda r: r["length"])], np.int64)
    slots, first, taken = [], 0, dict.fromkeys(sizes.tolist(), 0)
    for counts, n in plan_patterns(sizes, demand, capacity, rounds):
        at = 0
        for k in np.flatnonzero(counts):
            size, m = int(sizes[k]), int(counts[k])
            slots.append((size, taken[size], taken[size] + m * n, m, first, at))
            taken[size] += m * n
            at += m * size
        first += n
    table = spark.createDataFrame(slots, "size long, low long, high long, per long, first long, base long")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long")
    per_length = spark.createDataFrame([(int(a), int(b)) for a, b in zip(sizes, demand, strict=True)], "size long, n long").withColumn("buckets", buckets).drop("n")
    rows = pieces.join(F.broadcast(per_length), pieces["length"] == per_length["size"]).drop("size")  # at most capacity rows
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    counts = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    rows = rows.join(counts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # one row for each pattern and length in it: bounded by the capacity, not by the input
    rows = rows.join(F.broadcast(table), (rows["length"] == table["size"]) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    k = F.col("_rank") - F.col("low")
    return rows.select(
        *pieces.columns,
        (F.col("first") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + (k % F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
