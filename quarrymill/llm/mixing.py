"""Mixing sources to target weights by Sainte-Laguë apportionment.

Tokens are dealt in blocks of equal size. Sources get blocks by the highest quotients votes / (2 seats + 1), with
their target as votes; each source's blocks go to its shards in the same way, with the shard's words as votes. In a
shard, documents stand in a seeded order and form one stream of words, which is cut into blocks; of them as many as
the shard's quota are selected, evenly from a seeded start, each at most max_repeats times.

The mix is a DataFrame plan (only cutting the texts, for mix_texts, is Python): one pass over the texts for their sizes, one shuffle of (doc_id, source, size) by
shard; mix_texts shuffles the texts once, by shard. A source has as many shards as its size asks for, so a source with a third of all rows is
spread over many tasks; all that meets in one task are rows of sources and of one source's shards. The tables of sources and
of shards are written, so that Spark knows their sizes before it plans the joins: it broadcasts them only if small, and else
the texts are dealt by (source's number, shard) for the join, as the order within the shard asks anyway.

Cases: null text has size 0 and is taken 0 times; an empty table gives an empty result; null source is a source of
its own, last in order; rows that repeat share the order's place and get their own stretch of the stream; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, chunks, n_words, texts, trimmed

#: Words of a block; smaller where the smallest source would have fewer than 64 of them.
BLOCK = 64
#: Words of a shard.
SHARD_WORDS = 500_000
WEIGHTS = (3, 1, 2)


def seeded(seed: int, *cols: Column) -> Column:
    """63 bits of an MD5: the same order in every run, and in other engines."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> and weight, target. Water-filling in closed form: of the sources in order of
    capacity / weight, those before the level are full, the others share what is left by weight."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("capacity", F.lit(float(max_repeats)) * F.col("source_size"))
    by = W.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level).withColumn("ok", F.col("level") * F.col("weight") <= F.col("capacity"))
    # the level that holds for the first source that is not filled holds for all after it
    first = F.min(F.when(F.col("ok"), F.struct(F.col("capacity") / F.col("weight"), F.col("level"))))
    final = first.over(everything)["level"]
    return filled.withColumn("target", F.least(F.col("capacity"), F.coalesce(F.col("weight") * final, F.col("capacity")))).select(
        "source", "source_size", "weight", "target"
    )


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, into: str) -> DataFrame:
    """Adds to each party of a group its seats by highest quotients, ties to the smaller party.

    For J parties and K seats no party is further from its share q than 1/2 + q J / (2 K), so only the quotients in
    that range are ranked, about three for each party; those before it are sure."""
    g = W.partitionBy(*group)
    share = parties.withColumn("_all", F.sum(votes).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    q = F.coalesce(F.try_divide(F.col(votes) * F.col(seats), F.col("_all")), F.lit(0.0))
    slack = F.try_divide(F.col("_n"), 2.0 * F.col(seats))
    low = F.greatest(F.lit(0), F.ceil(q * (1 - slack) - 0.5) - 1).cast("long")
    high = (F.floor(q * (1 + slack) + 0.5) + 1).cast("long")
    share = share.withColumn("_low", F.when(F.col(seats) > 0, low).otherwise(0)).withColumn("_high", F.when(F.col(seats) > 0, high).otherwise(0))
    share = share.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    quotient = F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)))
    ranked = share.withColumn("_k", quotient).withColumn("_q", F.col(votes) / (2.0 * F.coalesce("_k", F.lit(0)) + 1))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.col("_q").desc(), F.col(party).asc_nulls_last(), F.col("_k")))
    won = ranked.withColumn("_won", F.col("_k").isNotNull() & (F.col(votes) > 0) & (place <= F.col("_left")))
    keys = [c for c in parties.columns]
    return won.groupBy(*keys).agg((F.max("_low") + F.sum(F.col("_won").cast("long"))).alias(into))


def _mixed(docs: DataFrame, carried: list[str], share: float, max_repeats: int, block: int, seed: int, weights: tuple[int, ...]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None).cast("string")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row.alias("_row"))
    scratch = Scratch(docs.sparkSession, "mixing")
    # sizes are needed three times and the texts should be counted once; this table has three small columns
    small_rows = scratch.table(sized.drop("_row"))
    sources = targets(small_rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, max_repeats, weights)
    # one block size for all sources: small enough that each source with words has 64 blocks to win
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy())
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.coalesce(F.floor(least / 64), F.lit(block)))).cast("long"))
    sources = sources.withColumn("_seats", F.round(F.sum("target").over(W.partitionBy()) / F.col("block")).cast("long")).withColumn("_world", F.lit(0))
    sources = sainte_lague(sources, ["_world"], "source", "target", "_seats", "source_blocks")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
    # sources by number: null is no case of its own in what follows
    sources = sources.withColumn("_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    small = scratch.table(sources.select(F.col("source").alias("_source"), "_no", "source_size", "target", "block", "source_blocks", "shards"))

    def with_shard(rows: DataFrame) -> DataFrame:
        rows = rows.join(small, rows["source"].eqNullSafe(small["_source"])).drop("_source")
        return rows.withColumn("shard", seeded(seed, F.col("doc_id")) % F.col("shards"))

    by_shard = with_shard(small_rows).groupBy("_no", "source", "shard", "source_blocks", "block").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(by_shard, ["_no"], "shard", "shard_size", "source_blocks", "quota")
    quotas = quotas.withColumn("shard_blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
    quotas = quotas.withColumn("quota", F.least(F.col("quota"), max_repeats * F.col("shard_blocks")))
    quotas = quotas.withColumn("shift", F.coalesce(F.try_mod(seeded(seed + 1, F.col("source"), F.col("shard")), F.col("shard_blocks")), F.lit(0)))
    quotas = scratch.table(quotas.select("_no", "shard", "quota", "shard_blocks", "shift"))
    rows = with_shard(sized if carried else small_rows).join(quotas, ["_no", "shard"])
    order = W.partitionBy("_no", "shard").orderBy(seeded(seed + 2, F.col("doc_id")), "doc_id", "size")
    rows = rows.withColumn("start", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return rows.withColumn("taken", _taken_before(F.col("start") + F.col("size")) - _taken_before(F.col("start")))


def mix_sources(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, block: int = BLOCK, seed: int = 7, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, text) -> doc_id, size, source_size, target, taken, and what says which blocks of the shard's
    stream are selected and where the document's words begin in it: start, shard_blocks, quota, shift, block."""
    rows = _mixed(docs, [], share, max_repeats, block, seed, weights)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "start", "shard_blocks", "quota", "shift", "block")


def mix_texts(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, block: int = BLOCK, seed: int = 7, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents: those of which something is taken, with the words of the selected blocks in order, a
    block selected twice standing twice. Words are joined by one space; a text that is taken whole, once, is as it
    was. The columns are those of docs."""
    rows = _mixed(docs, docs.columns, share, max_repeats, block, seed, weights).where("taken > 0")
    rows = rows.select("_row", "start", "size", "taken", "quota", "shard_blocks", "shift", "block")
    whole = (F.col("taken") == F.col("size")) & (F.col("quota") == F.col("shard_blocks"))
    rows = rows.select(F.col("_row"), whole.alias("_whole"), F.col("_row.text").alias("text"), "start", "size", "quota", "shard_blocks", "shift", "block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out = []
                plan = [part.column(c).to_pylist() for c in ("_whole", "start", "size", "quota", "shard_blocks", "shift", "block")]
                for text, whole, start, size, quota, n, shift, block in zip(texts(part), *plan, strict=True):
                    if whole:
                        out.append(text)
                        continue
                    words, pieces = text.split(), []
                    rounds, extra = divmod(quota, n)
                    for b in range(start // block, (start + size - 1) // block + 1):
                        times = rounds + ((b + 1) * extra + shift) // n - (b * extra + shift) // n
                        pieces += words[max(0, b * block - start) : (b + 1) * block - start] * times
                    out.append(b" ".join(pieces))
                row = part.column("_row")
                fields = [pa.array(out, pa.binary()).cast(pa.string()) if f.name == "text" else row.field(i) for i, f in enumerate(row.type)]
                yield pa.RecordBatch.from_arrays(fields, names=[f.name for f in row.type])

    return rows.mapInArrow(trimmed(cut), docs.schema)


def _picked(blocks: Column) -> Column:
    """How often blocks before this one are selected, whole rounds not counted: evenly, from a seeded start."""
    extra = F.coalesce(F.try_mod(F.col("quota"), F.col("shard_blocks")), F.lit(0))
    return F.coalesce(F.floor(F.try_divide(blocks * extra + F.col("shift"), F.col("shard_blocks"))), F.lit(0)).cast("long")


def _taken_before(x: Column) -> Column:
    """Words taken of the stream's first x."""
    rounds = F.coalesce(F.floor(F.try_divide(F.col("quota"), F.col("shard_blocks"))), F.lit(0)).cast("long")
    b = F.floor(x / F.col("block")).cast("long")
    return x * rounds + _picked(b) * F.col("block") + (x - b * F.col("block")) * (_picked(b + 1) - _picked(b))


