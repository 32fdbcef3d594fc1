"""Hazard models over the panel with MLlib: logistic regression and boosted trees."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(panel: DataFrame, features: list[str]) -> DataFrame:
    """Missing features as zero, labels as double, classes weighted to balance."""
    rows = panel.fillna(0, features)
    rate = rows.filter("split = 'train'").agg(F.avg("y").alias("rate"))
    weight = F.when(F.col("y") == 1, (1 - F.col("rate")) / F.greatest(F.col("rate"), F.lit(1e-6))).otherwise(1.0)
    return rows.join(F.broadcast(rate)).withColumn("weight", weight).withColumn("label", F.col("y").cast("double")).drop("rate")


def logistic(features: list[str], ridge: float = 0.01) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(regParam=ridge, maxIter=100)])


def boosted(features: list[str], rounds: int = 10) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(maxIter=rounds, maxDepth=4, weightCol="weight", validationIndicatorCol="held", seed=18)])


def fit(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    return pipeline.fit(rows.filter("split != 'test'").withColumn("held", F.col("split") == "valid"))


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("actor", "m", "y", "split", vector_to_array("probability")[1].alias("prob"))


def contributions(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Additive contributions of the logistic model: standardised value times coefficient."""
    scaler, logit = model.stages[1], model.stages[2]
    out = [((F.col(f) - float(m)) / float(s) * float(c) if s else F.lit(0.0)).alias(f) for f, m, s, c in zip(features, scaler.mean, scaler.std, logit.coefficients, strict=True)]
    return rows.select("actor", "m", *out)
