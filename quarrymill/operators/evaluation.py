"""Scores of multi-label predictions, in SQL: rows of (id, label, y, p) with y and p 0 or 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.core import safe_ratio


def long_form(df: DataFrame, key: str, labels: list[str], truth: str = "y_", predicted: str = "p_") -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"{truth}{c}").cast("int").alias("y"), F.col(f"{predicted}{c}").cast("int").alias("p")) for c in labels])
    return df.select(key, F.explode(each).alias("r")).select(key, "r.*")


def confusion(rows: DataFrame) -> DataFrame:
    y, p = F.col("y") == 1, F.col("p") == 1
    return rows.groupBy("label").agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def _scores(df: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        df.withColumn("precision", zero(safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))))
        .withColumn("recall", zero(safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))))
        .withColumn("f1", zero(safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))
    )


def report(rows: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support for each label and for the averages micro, macro and weighted."""
    each = _scores(confusion(rows)).withColumn("support", F.col("tp") + F.col("fn"))
    cols = ["label", "precision", "recall", "f1", "support"]
    micro = _scores(each.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])).select(F.lit("micro avg").alias("label"), "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
    macro = each.agg(*[F.avg(c).alias(c) for c in cols[1:4]], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *cols[1:])
    weight = lambda c: F.coalesce(safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c)
    weighted = each.agg(*[weight(c) for c in cols[1:4]], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *cols[1:])
    return each.select(*cols).union(micro).union(macro).union(weighted)


def micro_f1(rows: DataFrame) -> DataFrame:
    y, p = F.col("y") == 1, F.col("p") == 1
    both, either = F.count_if(y & p), F.count_if(y & ~p) + F.count_if(~y & p)
    return rows.agg(F.coalesce(safe_ratio(2 * both, 2 * both + either), F.lit(0.0)).alias("micro_f1"))


def subset_accuracy(rows: DataFrame, key: str) -> DataFrame:
    """Share of ids with all labels right."""
    return rows.groupBy(key).agg(F.bool_and(F.col("y") == F.col("p")).alias("right")).agg(F.avg(F.col("right").cast("int")).alias("subset_accuracy"))


def vote(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, prediction) -> keys, prediction: 1 where half of the models or more say so."""
    return predictions.groupBy(*keys).agg((2 * F.sum("prediction") >= F.count(F.lit(1))).cast("int").alias("prediction"))


def files_by_label(predictions: DataFrame, key: str, shown: int = 200) -> DataFrame:
    """label, n, files: of the ids predicted 1 their number and the first ones, by id."""
    hit = predictions.where("prediction = 1")
    counts = hit.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # the filter on the place lets each task keep its first ones only, so no label's rows meet as a whole
    first = hit.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(key))).where(F.col("place") <= shown)
    return counts.join(first.groupBy("label").agg(F.array_sort(F.collect_list(key)).alias("files")), "label").select("label", "n", "files")


def generalisation_gap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row: subset accuracy on training rows, on test rows, and the difference."""
    rows = train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False)))
    right = rows.groupBy(key, "_train").agg(F.bool_and(F.col("y") == F.col("p")).cast("int").alias("right"))
    both = right.agg(F.avg(F.when(F.col("_train"), F.col("right"))).alias("train_accuracy"), F.avg(F.when(~F.col("_train"), F.col("right"))).alias("test_accuracy"))
    return both.withColumn("gap", F.col("train_accuracy") - F.col("test_accuracy"))
