"""Reading and writing of record and dataset files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON arrays or objects, one document a file, in a folder or a file. Broken files give no row."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Columns by name, a JSON line for each record."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    out = flat(df)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_combined(spark: SparkSession, combined: str, folder: str, schema: str | None = None) -> DataFrame:
    """The records of one combined file if it is there, else of all files of a folder; an error if neither is."""
    for path in (combined, folder):
        p, fs = _path(spark, path)
        if fs.exists(p):
            return read_records(spark, path, schema)
    raise FileNotFoundError(f"neither {combined} nor {folder} is there")


def clear_folder(spark: SparkSession, path: str) -> dict[str, str]:
    """Empties a run's folder, and says how that went: cleared, error, or that there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {"status": "run directory does not exist"}
    for x in fs.listStatus(p):
        if not fs.delete(x.getPath(), True):
            return {"status": "error", "message": f"{x.getPath()} stays"}
    return {"status": "cleared"}


def without_file_info(records: DataFrame) -> DataFrame:
    """A record's summary where it has one, else the record, without file_info."""
    out = records.select("numerical_summary.*") if "numerical_summary" in records.columns else records
    return out.drop("file_info")


def run_summary(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """scanned_files, errors, results. nodes: the files' trees, of which those that could not be parsed are errors too."""
    rows = files.select("file_id", (F.col("status") == "ok").alias("good")) if nodes is not None else files.select((F.col("status") == "ok").alias("good"))
    if nodes is not None:
        failed = nodes.where("kind = '__error__'").select("file_id").distinct().withColumn("_failed", F.lit(True))
        rows = rows.join(failed, "file_id", "left").select((F.col("good") & F.col("_failed").isNull()).alias("good"))
    good = F.count_if("good")
    return rows.agg(F.count(F.lit(1)).alias("scanned_files"), (F.count(F.lit(1)) - good).alias("errors"), good.alias("results"))
