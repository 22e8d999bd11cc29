"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions alone.

Two lines within TAU edits share one of TAU + 1 segments of the shorter one, at a place that is off by no more than
the edits allow. So each distinct line is split into TAU + 1 even segments, hashed with their number and the line's
length (the index), and probes the indexes of its own and the TAU shorter lengths with the few substrings that can
match (multi-match-aware selection). Lines that share a key are candidates; those whose counts of common letters
differ by more than 2 TAU cannot match and go in the join's condition; the rest is verified by a bit-parallel
automaton: TAU + 1 rows of 2 TAU + 1 bits, the band around the diagonal, advanced by shifts and masks for each character.

A key that more than CROWD lines share, such as a common beginning, is not opened pair by pair. The lines that meet there
are compared by their grams of GRAM characters instead: TAU edits touch TAU * GRAM grams at most, so of two lines that match
the TAU * GRAM + 1 rarest grams of each, in one order for all, have one in common (prefix filtering). A common beginning is not among a
line's rarest grams while it has others; whatever CROWD is, the pairs found are the same.

Equal lines are one row before anything else, so a line in a third of all documents costs as much as any other, and a
key's lines are different texts. Links between lines give classes (connected components); of each class the first
occurrence, by (doc_id, line number), stays.

Lines shorter than MIN_CHARS are the same only if equal: two edits would turn them into another line. Lines without a
word take no part and stay.

Cases: null and empty texts have no lines, and rows without doc_id take no part; texts and lines of any length are compared whole; repeated rows are copies
of each other's lines, and the first stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch
from quarrymill.llm.components import components
from quarrymill.llm.minhash import SHINGLE, SIMILARITY

TAU, MIN_CHARS = 2, 24
#: Letters whose counts bound the distance from below.
LETTERS = "etaonishrdlucmpgb.,é0123456789"
#: A key of more lines is crowded.
CROWD, GRAM = 64, 4
#: Ids up to this many are sent to all executors (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def segment_keys(wide: Column, lengths: dict[int, tuple[Column, Column, Column]], tau: int = TAU) -> Column:
    """array<long>: first the tau + 1 keys of the index, then those that only probe; null where there is no room.

    wide: the line in four bytes a character, so that a substring is found without counting characters. lengths: by how
    much shorter, a length, its even share of the segments, and how many of the last segments are one longer."""
    index, probe = [], []
    n = lengths[0][0]
    for shorter, (length, share, longer) in lengths.items():
        for i in range(tau + 1):
            at = share * i + F.greatest(F.lit(0), longer - (tau + 1 - i)) + 1
            size = share + (longer > tau - i).cast("int")
            # off by at most i on the left side's account, and by what is left on the right side's
            low, high = max(-i, shorter - (tau - i)), min(i, shorter + (tau - i))
            for off in range(low, high + 1):
                p = at + off
                key = F.when((p >= 1) & (p + size - 1 <= n) & (size > 0), F.xxhash64(F.lit(i), length, F.substr(wide, 4 * p - 3, 4 * size)))
                (index if shorter == 0 and off == 0 else probe).append(key)
    return F.array(*index, *probe)


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Is the edit distance of a and b tau at most? a and b are arrays of characters.

    After j characters of b, bit k of row e says: the first j + k - tau characters of a become them with e edits."""
    width = 2 * tau + 1
    full = (1 << width) - 1

    def masks(c: Column, j: Column) -> Column:
        bits = [F.when(F.get(a, j + (k - tau)) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
        out = bits[0]
        for x in bits[1:]:
            out = out.bitwiseOR(x)
        return out

    def row(state: Column, e: int) -> Column:
        return F.shiftright(state, width * e).bitwiseAND(F.lit(full))

    def advance(state: Column, m: Column) -> Column:
        last = row(state, 0).bitwiseAND(m)
        out = last
        for e in range(1, tau + 1):
            up = row(state, e - 1)
            last = row(state, e).bitwiseAND(m).bitwiseOR(up).bitwiseOR(F.shiftright(up, 1)).bitwiseOR(F.shiftleft(last, 1)).bitwiseAND(F.lit(full))
            out = out.bitwiseOR(F.shiftleft(last, width * e))
        return out

    start = sum(((((1 << (e + 1)) - 1) << tau) & full) << (width * e) for e in range(tau + 1))
    end = F.aggregate(F.transform(b, masks), F.lit(start), advance)
    k = F.size(a) - F.size(b) + tau
    return (k >= 0) & (k < width) & (F.call_function("shiftright", row(end, tau), k).bitwiseAND(F.lit(1)) == 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, line_no, line: the lines that hold a word."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _named(rows: DataFrame) -> DataFrame:
    """128 bits that stand for the line."""
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def rarest_grams(texts: DataFrame, gram: int, tau: int = TAU) -> DataFrame:
    """(id, line, n) -> key, id: those of the tau * gram + 1 rarest grams of each line that other lines here have too."""
    at = F.sequence(F.lit(0), F.col("n") - gram)
    wide = texts.select("id", "n", F.encode("line", "UTF-32").alias("_w"))
    rows = wide.select("id", F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substr("_w", 4 * i + 1, F.lit(4 * gram)))))).alias("key"))
    counted = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_c")), "key")
    place = F.row_number().over(W.partitionBy("id").orderBy("_c", "key"))
    return counted.withColumn("_p", place).where((F.col("_p") <= tau * gram + 1) & (F.col("_c") > 1)).select("key", "id")


def linked_lines(distinct: DataFrame, scratch: Scratch, tau: int = TAU, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """(id, line) of different lines -> a, b (ids, a < b): those within tau edits of each other."""
    some = distinct.withColumn("n", F.length("line")).where(F.col("n") >= max(min_chars, tau + 1))
    # columns of their own below the explode: each is computed once for a line
    parts = {f"_l{d}": (F.col("n") - d) for d in range(tau + 1)}
    parts |= {f"_s{d}": F.floor((F.col("n") - d) / (tau + 1)).cast("int") for d in range(tau + 1)} | {f"_r{d}": F.pmod(F.col("n") - d, F.lit(tau + 1)) for d in range(tau + 1)}
    wide = some.select("id", "n", F.encode("line", "UTF-32").alias("_w")).withColumns(parts)
    lengths = {d: (F.col(f"_l{d}"), F.col(f"_s{d}"), F.col(f"_r{d}")) for d in range(tau + 1)}
    keys = wide.select("id", F.posexplode(segment_keys(F.col("_w"), lengths, tau)).alias("_k", "key")).where("key IS NOT NULL")
    keys = keys.select("key", "id", (F.col("_k") <= tau).alias("index"))
    crowded = keys.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("key"))).where("_n > 1")
    crowded = scratch.table(crowded)
    wanted = scratch.table(crowded.select("id").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    texts = some.join(F.broadcast(wanted) if few else wanted, "id")
    counts = [(F.col("n") - F.length(F.translate("line", c, ""))).alias(f"c{i}") for i, c in enumerate(LETTERS)]
    texts = scratch.table(texts.select("id", "line", "n", *counts))
    apart = F.lit(0)
    for i in range(len(LETTERS)):
        apart = apart + F.abs(F.col(f"x.c{i}") - F.col(f"y.c{i}"))
    # of equal lengths the smaller id is first; else the shorter line, which is the one in the index
    once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))

    def met(index: DataFrame, probes: DataFrame) -> DataFrame:
        """Pairs of lines with a key in common that lengths and letters allow."""
        x, y = index.join(texts, "id").alias("x"), probes.join(texts, "id").alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & once & (F.col("y.n") - F.col("x.n") <= tau) & (apart <= 2 * tau))
        return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.line").alias("_x"), F.col("y.line").alias("_y"))

    roomy = crowded.where(F.col("_n") <= crowd).select("key", "id", "index")
    pairs = met(roomy.where("index").select("key", "id"), roomy.select("key", "id"))
    packed = crowded.where(F.col("_n") > crowd).select("id").distinct()
    if not packed.isEmpty():
        rare = scratch.table(rarest_grams(texts.join(packed, "id"), max(1, min(GRAM, max(min_chars, tau + 1) // (tau + 1))), tau))
        pairs = pairs.union(met(rare, rare))
    pairs = pairs.distinct()
    # written first: verification then runs once for each pair, after all that is cheaper
    pairs = scratch.table(pairs)
    # through an array of one struct, so that the texts are split once for each pair and not at each step
    both = F.array(F.struct(F.split("_x", "").alias("a"), F.split("_y", "").alias("b")))
    good = pairs.where(F.transform(both, lambda s: within(s["a"], s["b"], tau))[0])
    return good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def line_classes(docs: DataFrame, scratch: Scratch, tau: int = TAU, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> all lines with a word (doc_id, line_no, h1, h2), and of those lines that are not alone in
    their class (h1, h2, n_links, class_doc, class_line): the number of different lines within tau edits and the
    first occurrence of the class."""
    rows = occurrences(docs)
    distinct = rows.groupBy("line").agg(F.count(F.lit(1)).alias("copies"))
    distinct = scratch.table(_named(distinct).withColumn("id", F.monotonically_increasing_id()))
    links = scratch.table(linked_lines(distinct.select("id", "line"), scratch, tau, min_chars))
    labels = components(links, scratch)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    labels = labels.join(degree, "node")
    crowd = distinct.select("id", "h1", "h2", "copies").join(labels, F.col("id") == F.col("node"), "left").where("copies > 1 OR node IS NOT NULL")
    crowd = scratch.table(crowd.select("h1", "h2", F.coalesce("label", "id").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    scratch.drop(distinct)
    found = _named(rows).drop("line")
    first = found.join(crowd, ["h1", "h2"]).groupBy("label").agg(F.min(F.struct("doc_id", "line_no")).alias("f"))
    named = crowd.join(first, "label").select("h1", "h2", "n_links", F.col("f.doc_id").alias("class_doc"), F.col("f.line_no").alias("class_line"))
    named = scratch.table(named)
    scratch.only(named)
    return found, named


def duplicate_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text) -> doc_id, line_no, class_doc, class_line, n_links, removed: one row for each line with a word."""
    found, named = line_classes(docs, Scratch(docs.sparkSession, "lines"), tau, min_chars)
    rows = found.join(named, ["h1", "h2"], "left")
    own = F.coalesce(F.struct("class_doc", "class_line") == F.struct("doc_id", "line_no"), F.lit(True))
    return rows.select(
        "doc_id", "line_no", F.coalesce("class_doc", "doc_id").alias("class_doc"), F.coalesce("class_line", "line_no").alias("class_line"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("class_doc").isNotNull() & ~own).alias("removed"),
    )


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""
    return F.concat_ws("\n", F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()))


def _shingles(text: Column, k: int = SHINGLE) -> Column:
    """The set of the near-duplicate operator, with other hashes: null without words, one shingle for less than k."""
    words = F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(w)))

    # through an array of one array, so that the text is split once and not for each shingle
    return F.array_distinct(F.transform(F.array(words), grams)[0])


def _copies(marked: DataFrame, similarity: int, scratch: Scratch) -> DataFrame:
    """_id, _of: documents that are near-duplicates of an earlier one, _of, in what the stage leaves of both, if lines
    that stand in _of stay in them. _of is no such document itself, so its text is that of the result.

    The numbers of shingles are compared first, and alone; only pairs that they allow carry texts, and sets are made of
    those where the two meet."""
    touched = marked.where("_id IS NOT NULL").select("_id", F.col("_row.text").alias("text"), "_gone", "_first")
    others = F.transform(F.filter("_gone", lambda g: g["class_doc"] != F.col("a")), lambda g: g["line_no"])
    asked = touched.where("_gone IS NOT NULL").select(F.col("_id").alias("b"), "text", "_gone", F.explode(F.array_distinct("_gone.class_doc")).alias("a")).where("a <> b")
    asked = asked.select("a", "b", _without(F.col("text"), others).alias("_y"))
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_gone.line_no")))
    firsts = touched.where("_first").select(F.col("_id").alias("a"), left.alias("_x"))

    def size(text: str) -> Column:
        return F.coalesce(F.size(_shingles(F.col(text))), F.lit(0))

    # written: a condition on a number would else be pushed below, and make each set once more
    sizes = scratch.table(asked.select("a", "b", size("_y").alias("_m")))
    fits = (F.least("_n", "_m") > 0) & (100 * F.least("_n", "_m") >= similarity * F.greatest("_n", "_m"))
    fit = scratch.table(sizes.join(scratch.table(firsts.select("a", size("_x").alias("_n"))), "a").where(fits).select("a", "b").distinct())
    few = fit.count() <= BROADCAST_ROWS
    met = asked.join(F.broadcast(fit) if few else fit, ["a", "b"]).join(firsts, "a")
    # through arrays of one struct, so that sets and their intersection are made once for each pair
    sets = F.array(F.struct(_shingles(F.col("_x")).alias("x"), _shingles(F.col("_y")).alias("y")))
    counts = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("c"), (F.size(s["x"]) + F.size(s["y"])).alias("n")))
    near = F.transform(counts, lambda s: (s["c"] > 0) & (100 * s["c"] >= similarity * (s["n"] - s["c"])))[0]
    near = scratch.table(met.where(near).select("a", "b").distinct())
    plain = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    return plain.groupBy(F.col("b").alias("_id")).agg(F.min("a").alias("_of"))


def drop_duplicate_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, similarity: int = SIMILARITY) -> DataFrame:
    """The documents, all columns, without the lines that an earlier occurrence of their class stands for.

    Only the lines that a document has from one that it is a near-duplicate of, by the near-duplicate operator's test
    on what the two become here, stay in it: so it reaches that operator as a near-duplicate, and goes there as a whole."""
    scratch = Scratch(docs.sparkSession, "lines")
    found, named = line_classes(docs, scratch, tau, min_chars)
    repeated = found.join(named, ["h1", "h2"]).where("NOT (class_doc = doc_id AND class_line = line_no)")
    gone = scratch.table(repeated.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "class_doc")).alias("_gone")).withColumnRenamed("doc_id", "_id"))
    firsts = gone.select(F.explode(F.array_distinct("_gone.class_doc")).alias("_id")).distinct().withColumn("_first", F.lit(True))
    # the documents' own columns stand in a struct meanwhile: none of their names can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(*docs.columns).alias("_row"))
    marks = scratch.table(gone.join(firsts, "_id", "full"))
    # one shuffle of the texts, for those that lose lines and for those where the lines first stand
    marked = scratch.table(rows.join(marks, F.col("_doc") == F.col("_id"), "left").drop("_doc"))
    copies = scratch.table(_copies(marked, similarity, scratch))
    scratch.only(marked, copies)
    goes = F.filter("_gone", lambda g: F.col("_of").isNull() | (g["class_doc"] != F.col("_of")))
    # only documents that lose lines meet the copies
    cut = marked.where("_gone IS NOT NULL").join(copies, "_id", "left").select("_row", F.transform(goes, lambda g: g["line_no"]).alias("_gone"))
    text = F.when(F.size("_gone") > 0, _without(F.col("_row.text"), F.col("_gone"))).otherwise(F.col("_row.text"))
    cut = cut.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
    return marked.where("_gone IS NULL").select(*[F.col("_row")[c].alias(c) for c in docs.columns]).union(cut)
