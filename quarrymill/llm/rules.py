"""Quality rules as a bitmask ledger.

measure() reads each text once and writes its measurements; ledger() evaluates every rule once on them and stores the
failures as bits of one number. A policy is a version's mask of the rules that count: verdict() and ablation() need no
text, only the ledger. Ablation counts documents by their failure bits first, so it shuffles as many rows as there
are different bit patterns, and then asks of each rule what it alone rejects.

Measuring is Python over Arrow batches, in slices of bounded size, without a shuffle: windows of words that occur again
in the same text have no cheap form in SQL. The rest is columns.

Cases: null and empty texts have no words and fail the length rule; very long texts are measured whole; an empty table
gives an empty result; repeated rows are judged one by one; further columns are carried by ledger() only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import WordHash, chunks, grams, kept, mix, split_all, texts, trimmed

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"

#: name: condition of failure; the rule's bit is its place. New rules go to the end: stored ledgers keep their meaning.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "many_symbols": "20 * n_symbols > word_chars",
    "duplicate_lines": "n_lines >= 6 AND 2 * n_dup_lines > n_lines",
    "shouting": "n_letters >= 40 AND 2 * n_upper > n_letters",
}
#: Versioned policies: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "2024.1": ("too_few_words", "repeated_windows", "long_words", "many_symbols", "duplicate_lines"),
    "2024.2": ("too_few_words", "repeated_windows", "short_words", "long_words", "many_symbols", "duplicate_lines", "shouting"),
}


def _repeat_words(h: np.ndarray, bounds: np.ndarray, k: int = 3) -> np.ndarray:
    """Per document, the words inside windows of k words that stand twice or more in it."""
    n_docs, n = len(bounds) - 1, len(h)
    if n < k:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    inside = doc[: n - k + 1] == doc[k - 1 :]
    at = np.flatnonzero(inside)
    key = mix(grams(h, k)[at] ^ mix((doc[at] + 1).astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    starts = at[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def measure_batch(docs: list[bytes], hashes: WordHash) -> list[np.ndarray]:
    words, bounds = split_all(docs)
    repeat = _repeat_words(hashes.of(words), bounds)
    n = len(docs)
    out = np.zeros((8, n), np.int64)
    out[0], out[4] = np.diff(bounds), repeat
    for i, x in enumerate(docs):
        b = np.frombuffer(x, np.uint8)
        points = np.count_nonzero((b & 0xC0) != 0x80)
        out[1, i] = points - np.count_nonzero(_IS_SPACE[b])
        out[2, i] = np.count_nonzero(_IS_SYMBOL[b])
        lines = [y for y in x.split(b"\n") if y.strip()]
        out[5, i], out[3, i] = len(lines), len(lines) - len(set(lines))
        out[6, i] = np.count_nonzero((b >= 65) & (b <= 90))
        out[7, i] = out[6, i] + np.count_nonzero((b >= 97) & (b <= 122))
    return list(out)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and MEASURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("words", WordHash)
        for batch in batches:
            for part in chunks(batch):
                got = measure_batch(texts(part), hashes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, got)], names=["doc_id", *[x.split()[0] for x in MEASURES.split(", ")]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, {MEASURES}")


def mask(policy: str | tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    names = list(rules)
    return sum(1 << names.index(x) for x in (POLICIES[policy] if isinstance(policy, str) else policy))


def failure_bits(rules: dict[str, str] = RULES) -> Column:
    out = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements and failed: a bit for each rule that the text fails."""
    return measure(docs).withColumn("failed", failure_bits(rules))


def verdict(policy: str | tuple[str, ...], rules: dict[str, str] = RULES) -> Column:
    """Does a row of the ledger pass the policy?"""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str | tuple[str, ...], rules: dict[str, str] = RULES) -> DataFrame:
    """For each rule of the policy: rule, bit, n_failed, n_only (rejected by this rule alone: what would be kept
    without it), n_rejected (by the whole policy), n_rows."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    m = F.lit(mask(policy, rules)).cast("long")
    patterns = entries.groupBy(F.col("failed").bitwiseAND(m).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << list(rules).index(x)).cast("long").alias("bit")) for x in names]))
    return patterns.withColumn("r", each).groupBy("r.rule", "r.bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum("n").alias("n_rows"),
    )
