"""The corpus pipeline: documents through five operators to packed training sequences.

Each stage works on all that the one before kept. The stages before the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import lines, minhash, mixing, packing, quality
from quarrymill.llm.common import Scratch
from quarrymill.llm.registry import tokenizer_path

#: Shared word shingles in a hundred that make near-duplicates here; the 85 of minhash is op2's.
SIMILARITY = 80


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars as it is after a stage that changes texts."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return docs.withColumn("n_chars", F.length("text").cast(kind)) if kind else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go."""
    vectors, model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, vectors, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line stands for go; near-duplicates keep those of their original, for the next stage to see."""
    return _recounted(lines.drop_duplicate_lines(docs, similarity=SIMILARITY))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id stays."""
    return minhash.drop_near_duplicates(docs, SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become what the mix takes of them."""
    return _recounted(mixing.mix_texts(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized pieces with their places in sequences."""
    return packing.pack(packing.tokenized_pieces(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses neither the classifier nor the packing; tests hold each stage against a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each one's result is written and read back, so that it is made once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.table(docs)
    return docs
