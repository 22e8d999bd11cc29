"""Line metrics of texts: one explode, one partial aggregation, one small shuffle for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.core import BLANK, rstripped, safe_ratio, split_lines
from quarrymill.operators.kept import large

LONG_LINE, PEP8_LINE, SHOWN = 80, 79, 20


def exploded_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx (from 0), line, and in_doc where files has doc_ranges (array of struct<low, high>, 0-based, inclusive)."""
    ranges = "doc_ranges" in files.columns
    cols = [key, *(["doc_ranges"] if ranges else []), F.posexplode(split_lines(F.col(text))).alias("idx", "line")]
    out = files.select(*cols)
    inside = F.exists("doc_ranges", lambda r: (F.col("idx") >= r["low"]) & (F.col("idx") <= r["high"])) if ranges else F.lit(False)
    return out.withColumn("in_doc", F.coalesce(inside, F.lit(False))).drop("doc_ranges")


def line_metrics(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """Size, style and indentation of each text. Null texts have none and don't appear."""
    lines = exploded_lines(files, key, text)
    blank, n = F.col("line").rlike(BLANK), F.length("line")
    lead = F.regexp_extract("line", r"^[ \t]*", 0)
    width = F.length(F.replace(lead, F.lit("\t"), F.lit("    ")))
    code = ~F.col("in_doc") & ~blank
    comment = F.ltrim(F.col("line")).startswith("#") | F.col("line").rlike(r"(?U)^\s*#")
    return lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("loc"),
        F.count_if(code & ~comment).alias("sloc"),
        F.count_if(code & comment).alias("cloc"),
        F.count_if("in_doc").alias("dloc"),
        F.count_if(~F.col("in_doc") & blank).alias("blank_lines"),
        (F.count_if(code & comment) / F.count(F.lit(1))).alias("comment_density"),
        F.avg(n).alias("avg_line_length"),
        F.max(n).cast("long").alias("max_line_length"),
        (100.0 * F.count_if(n > LONG_LINE) / F.count(F.lit(1))).alias("percent_lines_over_80"),
        F.count_if(~blank & lead.contains("\t")).alias("tab_lines"),
        F.count_if(~blank & lead.contains("\t") & lead.contains(" ")).alias("mixed_tabs"),
        F.coalesce(F.stddev_pop(F.when(~blank, width)), F.lit(0.0)).alias("indent_stddev"),
        F.coalesce(safe_ratio(F.stddev_pop(F.when(~blank, width)), F.avg(F.when(~blank, width))), F.lit(0.0)).alias("irregularity_score"),
    )


def style_violations(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """Long lines, all counted, and trailing white space, counted while fewer than SHOWN examples are there: of the
    events in order of line (long before trailing), all long ones and the trailing ones among the first SHOWN."""
    lines = exploded_lines(files, key, text)
    n, number = F.length("line"), (F.col("idx") + 1).cast("string")
    long_ = F.when(n > PEP8_LINE, F.struct(F.lit(0).alias("kind"), F.concat(F.lit("line "), number, F.lit(": length "), n.cast("string")).alias("what")))
    trailing = F.when(rstripped(F.col("line")) != F.col("line"), F.struct(F.lit(1).alias("kind"), F.concat(F.lit("line "), number, F.lit(": trailing whitespace")).alias("what")))
    events = lines.select(key, "idx", F.explode(F.array_compact(F.array(long_, trailing))).alias("e")).select(key, "idx", "e.kind", "e.what")
    place = F.row_number().over(W.partitionBy(key).orderBy("idx", "kind"))
    counted = events.withColumn("place", place).where((F.col("kind") == 0) | (F.col("place") <= SHOWN))
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= SHOWN, F.struct("place", "what"))))
    found = counted.groupBy(key).agg(F.count(F.lit(1)).alias("pep8_violations"), F.transform(shown, lambda x: x["what"]).alias("pep8_examples"))
    empty = F.array().cast("array<string>")
    everyone = files.select(key)
    return everyone.join(large(found), key, "left").select(key, F.coalesce("pep8_violations", F.lit(0)).alias("pep8_violations"), F.coalesce("pep8_examples", empty).alias("pep8_examples"))


def todo_metrics(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """TODO and FIXME as words, in any case."""
    todo, fixme = (F.regexp_count(F.col(text), F.lit(rf"(?i)\b{w}\b")) for w in ("TODO", "FIXME"))
    total = (todo + fixme).cast("long")
    return files.select(key, total.alias("todo_fixme_count"), (total / F.greatest(F.lit(1), F.size(split_lines(F.col(text))))).alias("todo_density"))


def merge_intervals(rows: DataFrame, keys: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """Merged intervals of whole numbers per group: a gap of more than 1 opens a new one. Null ends come last; one
    that nothing is known of opens an interval of its own. Equal rows are alike: both windows read one and the same sorted table."""
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_last(low), F.asc_nulls_last(high))
    reach = F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col(low) <= reach + 1, 0).otherwise(1)
    island = F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_opens", opens).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def comment_blocks(rows: DataFrame, keys: list[str], order: str, is_comment, is_anchor) -> DataFrame:  # noqa: ANN001
    """For each anchor row, how many comment rows stand directly before it without a break."""
    w = W.partitionBy(*keys).orderBy(order)
    last_other = F.max(F.when(~is_comment, F.col(order))).over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.min(order).over(W.partitionBy(*keys))
    out = rows.withColumn("block_lines", F.col(order) - F.coalesce(last_other + 1, first)).withColumn("_anchor", is_anchor)
    return out.where("_anchor").drop("_anchor")


def interval_lines(rows: DataFrame, keys: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """Lines that the merged intervals of each group cover."""
    return merge_intervals(rows, keys, low, high).groupBy(*keys).agg(F.sum(F.col(high) - F.col(low) + 1).alias("covered"))
