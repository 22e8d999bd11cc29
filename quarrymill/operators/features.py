"""From labelled records to a typed, scaled dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that the dataset leaves out.
DROPPED = ["abbreviation_density", "attribute_mutations_outside_init", "maintainability_score", "max_lines_per_class", "mean_lines_per_class", "vcs_available", "y_ShotgunSurgery", "smells",
           "commit_bursts", "lines_deleted", "coupled_file_changes", "god_class_proxies", "indentation_irregularity", "pep8_examples", "vcs_top_coupled", "cross_file_call_edges"]
#: Booleans that count as numbers; the other booleans stay as they are and are not scaled.
AS_INT = ["unit_test_presence", "vcs_available"]


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the columns; an error if one is missing."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.drop(*names)


def target_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("y_")]


def feature_columns(df: DataFrame) -> list[str]:
    """What models read: neither targets nor the path."""
    return [c for c in df.columns if not c.startswith("y_") and c != "file_path"]


def positional_split(df: DataFrame, n_features: int = 51) -> tuple[list[str], list[str]]:
    """The first columns and the rest, as a dataset's order has them."""
    return df.columns[:n_features], df.columns[n_features:]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers that are no targets, by name."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not f.name.startswith("y_"))


def minmax_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: low_<c> and high_<c>, NaN and null left out."""
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.agg(*[f(real(c)).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])


def minmax_scale(df: DataFrame, columns: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """Columns to [0, 1]; a constant column becomes 0. bounds: of an earlier fit, so that serving scales as training did."""
    bounds = minmax_bounds(df, columns) if bounds is None else bounds
    both = df.crossJoin(F.broadcast(bounds))  # one row
    scaled = {c: F.when(F.col(c).isNull(), None).when(F.col(f"high_{c}") == F.col(f"low_{c}"), 0.0).otherwise((F.col(c).cast("double") - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}"))) for c in columns}
    return both.withColumns(scaled).select(*df.columns)


def any_label(df: DataFrame, targets: list[str], name: str = "y_any_smell") -> DataFrame:
    return df.withColumn(name, F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in targets], F.lit(0)).cast("int")) if targets else df.withColumn(name, F.lit(0))


def engineer(records: DataFrame, bounds: DataFrame | None = None, composite_before_drop: bool = False, strict: bool = False) -> DataFrame:
    """Booleans to numbers, columns out, scaling, the composite label, the shortened path and without package markers."""
    df = records
    for c in AS_INT:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("int"))
    if composite_before_drop:
        df = any_label(df, target_columns(df))
    df = drop_columns(df, DROPPED)
    df = minmax_scale(df, numeric_columns(df), bounds)
    if not composite_before_drop:
        df = any_label(df, target_columns(df))
    if "file_path" in df.columns:
        where = r".*[\\/]temp[\\/]" if strict else r".*\\temp\\"
        df = df.withColumn("file_path", F.regexp_replace("file_path", where, "")).where(F.col("file_path").isNull() | (F.col("file_path") != "__init__.py"))
    first = [c for c in df.columns if not c.startswith("y_")]
    return df.select(*sorted(first), *sorted(c for c in df.columns if c.startswith("y_") and c != "y_any_smell"), "y_any_smell")


def correlations(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """feature, target, corr: Pearson over rows that have both; null where one is constant. One aggregation for all pairs."""
    pair = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    x = lambda a, b: F.when(pair(a, b), F.col(a).cast("double"))
    sums = df.agg(*[e.alias(f"{n}_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(targets)
                    for n, e in (("c", F.covar_pop(x(a, b), x(b, a))), ("s", F.stddev_pop(x(a, b))), ("t", F.stddev_pop(x(b, a))))])
    rows = [F.struct(F.lit(a).alias("feature"), F.lit(b).alias("target"), F.try_divide(F.col(f"c_{i}_{j}"), F.col(f"s_{i}_{j}") * F.col(f"t_{i}_{j}")).alias("corr")) for i, a in enumerate(features) for j, b in enumerate(targets)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def weak_features(corr: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Features whose correlation with every target is under the threshold."""
    return corr.groupBy("feature").agg(F.max(F.abs(F.coalesce("corr", F.lit(0.0)))).alias("strongest")).where(F.col("strongest") < threshold)


def numeric_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; '{}', other text that is no number, and nulls become 0."""
    return df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)) for c in columns})


def report(df: DataFrame) -> DataFrame:
    """column, type, n_rows, n_null."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("n_rows"), F.col(f"n_{i}").alias("n_null")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def any_of(conditions: list):  # noqa: ANN201
    return reduce(lambda a, b: a | b, conditions)
