"""Match classifier: gradient-boosted trees over the feature columns, threshold tuning, retraining on hard negatives."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import FEATURES
from ..sources.staging import written
from . import metrics


def fit(labelled: DataFrame, columns: list[str] = FEATURES, trees: int = 40, depth: int = 5, step: float = 0.1, seed: int = 42) -> PipelineModel:
    """labelled: the columns and `label`.  Classes weigh the same: n / (2 * size of the class)."""
    size = labelled.groupBy("label").agg(F.count("*").alias("size"))
    total = F.broadcast(labelled.agg(F.count("*").alias("total")))
    rows = labelled.join(F.broadcast(size), "label").join(total, F.lit(True)).withColumn("weight", F.col("total") / (2 * F.col("size")))
    trees_ = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, minInstancesPerNode=5, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="x"), trees_]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of a match."""
    out = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return out.drop("x", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, spark, columns: list[str] = FEATURES) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(columns, values)), "feature string, share double")
    return rows.orderBy(F.desc("share"), "feature")


def mine_hard(scored: DataFrame, least: float = 0.20, times: int = 2) -> DataFrame:
    """Negatives that score at least `least`, each `times` over."""
    return scored.where((F.col("label") == 0) & (F.col("p") >= least)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def refit_on_hard(labelled: DataFrame, least: float = 0.20, first: PipelineModel | None = None, **kw) -> PipelineModel:
    """Fits (unless a first model is given), adds the negatives that the model likes twice, fits again."""
    hard = mine_hard(score(first or fit(labelled, **kw), labelled), least).select(*labelled.columns)
    return fit(written(labelled.unionByName(hard), "hard"), **kw)


def tune(scored: DataFrame, s1: DataFrame, truth_pairs: DataFrame, thresholds: list[float], split: str = "validation") -> dict[str, float]:
    """Best threshold of each country.  Only the validation split may tune."""
    if split == "test":
        raise ValueError("thresholds are not tuned on the test split")
    out = {}
    for country in sorted(r.country for r in s1.select("country").distinct().collect()):  # a few countries
        swept = metrics.sweep(scored.where(F.col("country") == country), s1.where(F.col("country") == country), truth_pairs, thresholds)
        out[country] = metrics.best_threshold(swept).first().t
    return out | {"default": max(out.values(), default=0.5)}


def save(model: PipelineModel, thresholds: dict[str, float], path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(json.dumps(thresholds),)], "thresholds string").write.mode("overwrite").json(f"{path}/thresholds")


def load(spark, path: str) -> tuple[PipelineModel, dict[str, float]]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.json(f"{path}/thresholds").first().thresholds)
