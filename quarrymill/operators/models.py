"""Multi-label tree models: one binary model for each label, searched, voted and saved."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import evaluation

#: Depth that stands for "no limit": the deepest tree that Spark grows.
DEEPEST = 30
#: Search spaces by algorithm, in Spark's parameters.
SPACES: dict[str, dict[str, list]] = {
    "random_forest": {"numTrees": [100, 200, 300], "maxDepth": [DEEPEST, 10, 20], "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["sqrt", "log2"]},
    "extra_trees": {"numTrees": [100, 200, 300], "maxDepth": [DEEPEST, 10, 20], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "all"], "minInfoGain": [0.0, 0.001, 0.01]},
    "hist_boosting": {"stepSize": [0.01, 0.05, 0.1, 0.2], "maxIter": [50, 100, 150, 200], "maxDepth": [3, 5, 7], "minInstancesPerNode": [5, 10, 20], "subsamplingRate": [0.8, 0.9, 1.0]},
    "boosting": {"maxIter": [100, 200, 300], "maxDepth": [4, 6], "stepSize": [0.05, 0.1], "subsamplingRate": [0.7, 0.8, 1.0], "featureSubsetStrategy": ["onethird", "sqrt", "all"], "minInstancesPerNode": [1, 3, 5], "minInfoGain": [0.0, 0.1, 0.2]},
}


def estimator(algorithm: str, params: dict, seed: int = 42):  # noqa: ANN201
    """extra_trees is an approximation: a forest without bootstrap samples, as Spark has no random thresholds."""
    if algorithm in ("random_forest", "extra_trees"):
        out = RandomForestClassifier(seed=seed, bootstrap=algorithm == "random_forest")
    elif algorithm in ("hist_boosting", "boosting"):
        out = GBTClassifier(seed=seed)
    else:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return out.setParams(**params)


def hash_split(df: DataFrame, key: str, test: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: the same whatever the partitions."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    return df.where(share >= test), df.where(share < test)


def fold(key: str, k: int, seed: int = 42):  # noqa: ANN201
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(k))


@dataclass
class MultiLabelModel:
    """Models by label name; predictions carry the names, never positions."""

    features: list[str]
    models: dict[str, Model]
    constants: dict[str, float] = field(default_factory=dict)

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds prob_<label> and p_<label>."""
        out = assemble(df, self.features)
        for name, model in self.models.items():
            got = model.copy({model.predictionCol: "_p", model.probabilityCol: "_prob", model.rawPredictionCol: "_raw"}).transform(out)
            out = got.withColumn(f"prob_{name}", vector_to_array("_prob")[1]).drop("_p", "_prob", "_raw")
        for name, value in self.constants.items():
            out = out.withColumn(f"prob_{name}", F.lit(value))
        names = [*self.models, *self.constants]
        return out.withColumns({f"p_{n}": (F.col(f"prob_{n}") >= threshold).cast("int") for n in names}).drop("_features")

    def importances(self, top: int | None = None) -> list[tuple[str, str, float]]:
        """(label, feature, importance), most important first for each label; the top ones only, if said."""
        out = []
        for name, model in self.models.items():
            out += sorted(((name, f, float(v)) for f, v in zip(self.features, model.featureImportances.toArray(), strict=True)), key=lambda x: (-x[2], x[1]))[:top]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/{name}")
        kinds = {n: type(m).__name__ for n, m in self.models.items()}
        spark.createDataFrame([(json.dumps({"features": self.features, "models": kinds, "constants": self.constants}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MultiLabelModel:
        from pyspark.ml import classification

        meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
        models = {n: getattr(classification, k).load(f"{path}/{n}") for n, k in meta["models"].items()}
        return MultiLabelModel(meta["features"], models, meta["constants"])


def saved(spark: SparkSession, folder: str) -> list[str]:
    """Names of the models that were saved in a folder, in order. Two or more of them can vote."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(files):
        return []
    meta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(x.getPath().getName() for x in fs.listStatus(files) if x.isDirectory() and fs.exists(meta(x.getPath(), "_meta")))


def load_saved(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, MultiLabelModel]:
    """The named models of a folder, or all."""
    return {n: MultiLabelModel.load(spark, f"{folder.rstrip('/')}/{n}") for n in (names if names is not None else saved(spark, folder))}


def rename_params(params: dict, prefix: str = "estimator__", add: bool = True) -> dict:
    """Parameters by their names inside a wrapped model, or back: those without the prefix stay as they are."""
    return {prefix + k if add else k.removeprefix(prefix): v for k, v in params.items()}


def of_repository(rows: DataFrame, repo: str, strict: bool = False) -> DataFrame:
    """Rows of one repository: whose path matches its name as a pattern, or (strict) whose column repo is it."""
    return rows.where(F.col("repo") == repo) if strict else rows.where(F.col("file_path").rlike(repo))


def predict_repository(rows: DataFrame, repo: str, key: str, models: dict[str, MultiLabelModel], labels: list[str], strict: bool = False) -> DataFrame:
    """(key, label, prediction) of one repository's rows: of the one model, or the vote of several."""
    return ensemble(of_repository(rows, repo, strict), key, models, labels)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df)


def train(df: DataFrame, features: list[str], labels: list[str], algorithm: str = "random_forest", params: dict | None = None, seed: int = 42) -> MultiLabelModel:
    """One model for each label y_<name>; a label that is the same in all rows is a constant."""
    rows = assemble(df, features).select("_features", *[F.col(f"y_{n}").cast("double").alias(f"y_{n}") for n in labels]).persist()
    try:
        means = rows.agg(*[F.avg(f"y_{n}").alias(n) for n in labels]).first()
        models, constants = {}, {}
        for n in labels:
            if means[n] in (None, 0.0, 1.0):
                constants[n] = means[n] or 0.0
            else:
                models[n] = estimator(algorithm, params or {}, seed).setFeaturesCol("_features").setLabelCol(f"y_{n}").fit(rows)
        return MultiLabelModel(features, models, constants)
    finally:
        rows.unpersist()


def grid(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, x, strict=True)) for x in product(*space.values())]


def refined(best: dict) -> dict[str, list]:
    """A grid around the best draw; what cannot be (no trees, no depth) is left out."""
    out: dict[str, list] = {}
    for k, v in best.items():
        around = {"numTrees": [v - 100, v, v + 100], "maxIter": [v - 50, v, v + 50], "maxDepth": [v - 2, v, v + 2], "stepSize": [v / 2, v, v * 1.5]}.get(k, [v]) if isinstance(v, int | float) else [v]
        out[k] = sorted({x for x in around if not isinstance(x, int | float) or (x > 0 and (k != "maxDepth" or x <= DEEPEST)) or k == "minInfoGain"}) if isinstance(v, int | float) else around
    return out


def search(df: DataFrame, key: str, features: list[str], labels: list[str], algorithm: str, candidates: list[dict], folds: int = 3, seed: int = 42) -> list[tuple[dict, float, float]]:
    """(params, mean, population deviation) of micro-F1 over all labels jointly, best first."""
    out = []
    numbered = df.withColumn("_fold", fold(key, folds, seed)).persist()
    try:
        for params in candidates:
            scores = []
            for k in range(folds):
                model = train(numbered.where(F.col("_fold") != k), features, labels, algorithm, params, seed)
                got = model.predict(numbered.where(F.col("_fold") == k))
                scores.append(evaluation.micro_f1(evaluation.long_form(got, key, labels)).first()["micro_f1"])
            mean = sum(scores) / folds
            out.append((params, mean, (sum((x - mean) ** 2 for x in scores) / folds) ** 0.5))
    finally:
        numbered.unpersist()
    return sorted(out, key=lambda x: -x[1])


def random_search(df: DataFrame, key: str, features: list[str], labels: list[str], algorithm: str, draws: int = 25, space: dict | None = None, folds: int = 3, seed: int = 42) -> list[tuple[dict, float, float]]:
    every = grid(space or SPACES[algorithm])
    return search(df, key, features, labels, algorithm, random.Random(seed).sample(every, min(draws, len(every))), folds, seed)


def soft_vote(df: DataFrame, models: list[MultiLabelModel], labels: list[str], threshold: float = 0.5) -> DataFrame:
    """Mean probability of the models, adds prob_<label> and p_<label>."""
    out = df
    for i, m in enumerate(models):
        got = m.predict(out)
        out = got.withColumns({f"_{i}_{n}": F.col(f"prob_{n}") for n in labels}).drop(*[f"prob_{n}" for n in labels], *[f"p_{n}" for n in labels])
    for n in labels:
        out = out.withColumn(f"prob_{n}", sum((F.col(f"_{i}_{n}") for i in range(len(models))), F.lit(0.0)) / len(models))
    return out.withColumns({f"p_{n}": (F.col(f"prob_{n}") >= threshold).cast("int") for n in labels}).drop(*[f"_{i}_{n}" for i in range(len(models)) for n in labels])


def ensemble(df: DataFrame, key: str, models: dict[str, MultiLabelModel], labels: list[str], warn: Callable[[str], None] = print) -> DataFrame:
    """Majority vote: (key, label, prediction). A model that fails is left out with a warning."""
    parts = []
    for name, m in models.items():
        try:
            got = m.predict(df)
            each = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"p_{n}").alias("prediction")) for n in labels])
            parts.append(got.select(key, F.lit(name).alias("model"), F.explode(each).alias("r")).select(key, "model", "r.*"))
        except (AnalysisException, IllegalArgumentException) as e:  # columns that it needs are missing, or of another type
            warn(f"{name} is left out: {e}")
    if not parts:
        raise ValueError("no model could be applied")
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    return evaluation.vote(rows, [key, "label"])
