"""A model's life: tuning and selection, refit, null gate, ablation, importance, contributions, saving.

Models are MLlib's; labels, splits and metrics are DataFrames.  Nothing but
metrics and models (a few rows, a few trees) comes to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.operators import evaluation, models

#: Trees win only if they rank validation rows better by this factor.
MARGIN = 1.10


@dataclass
class Bundle:
    """Both refitted models, which is selected, and what the selection saw."""

    features: list[str]
    logistic: PipelineModel
    trees: PipelineModel
    selected: str
    validation: dict[str, float]

    @property
    def model(self) -> PipelineModel:
        return self.trees if self.selected == "trees" else self.logistic


def _boosted(features: list[str], rounds: int, held: bool) -> Pipeline:
    tree = GBTClassifier(maxIter=rounds, maxDepth=4, weightCol="weight", seed=18, featuresCol="raw")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), tree.setValidationIndicatorCol("held") if held else tree])


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("actor", "m", "y", "split", vector_to_array("probability")[1].alias("score"))


def _precision(rows: DataFrame) -> float:
    return evaluation.average_precision(rows).head()["ap"] or 0.0


def fit(rows: DataFrame, features: list[str], rounds: int = 10) -> Bundle:
    """Both models on the training split, selection on the validation split, refit on both.

    rows: actor, m, y, split (train, valid, test), features; an empty split or one without both labels fails.
    """
    counts = {r["split"]: r for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}  # one row a split
    for name in ("train", "valid", "test"):
        if name not in counts or not 0 < counts[name]["p"] < counts[name]["n"]:
            raise ValueError(f"split {name} is empty or has one label only")
    x = models.matrix(rows, features).withColumn("held", F.col("split") == "valid").cache()
    valid = x.filter("held")
    logistic = models.logistic(features).fit(x.filter("split = 'train'"))
    trees = _boosted(features, rounds, True).fit(x.filter("split <> 'test'"))
    validation = {"logistic": _precision(scored(logistic, valid)), "trees": _precision(scored(trees, valid))}
    selected = "trees" if validation["trees"] > validation["logistic"] * MARGIN else "logistic"
    development = x.filter("split <> 'test'")
    best = max(1, trees.stages[-1].getNumTrees)
    bundle = Bundle(features, models.logistic(features).fit(development), _boosted(features, best, False).fit(development), selected, validation)
    x.unpersist()
    return bundle


def metrics(bundle: Bundle, rows: DataFrame) -> list[dict]:
    """A row for each model: validation and test average precision, and whether it is selected."""
    test = models.matrix(rows, bundle.features).filter("split = 'test'")
    return [{"model": n, "validation_ap": bundle.validation[n], "test_ap": _precision(scored(m, test)), "selected": n == bundle.selected} for n, m in (("logistic", bundle.logistic), ("trees", bundle.trees))]


def null_gate(rows: DataFrame, features: list[str], rounds: int = 10, seed: str = "18") -> dict:
    """Refits on labels shuffled within month; passes if ranking within months falls to near its base rate."""
    labels = evaluation.shuffled_labels(rows.select("actor", "m", "split", "y"), keep_split="", seed=seed)
    shuffled = rows.drop("y").join(labels.drop("split"), ["actor", "m"])
    bundle = fit(shuffled, features, rounds)
    got = evaluation.within_month(scored(bundle.model, models.matrix(shuffled, features).filter("split = 'test'"))).head()
    base = got["base_rate"] or 0.0
    limit = max(2 * base, base + 0.02)
    return {"within_month_ap": got["weighted_ap"] or 0.0, "base_rate": base, "limit": limit, "passed": (got["weighted_ap"] or 0.0) <= limit}


def released(rows: DataFrame, gate: dict) -> DataFrame:
    """The rows to export, withheld if the null run did not pass."""
    if not gate["passed"]:
        raise ValueError(f"within-month precision {gate['within_month_ap']:.4f} of the null run exceeds {gate['limit']:.4f}; exports are withheld")
    return rows


def ablation(rows: DataFrame, blocks: dict[str, list[str]], rounds: int = 10) -> list[dict]:
    """Blocks added one after the other, then everything but tenure: test precision and its change."""
    steps, so_far = [], []
    for name, own in blocks.items():
        so_far = [*so_far, *own]
        steps.append((f"with {name}", so_far))
    steps.append(("without tenure", [f for f in so_far if not f.startswith("tenure")]))
    out: list[dict] = []
    for name, features in steps:
        bundle = fit(rows, features, rounds)
        ap = next(m["test_ap"] for m in metrics(bundle, rows) if m["selected"])
        out.append({"step": name, "features": len(features), "selected": bundle.selected, "test_ap": ap, "marginal_ap": ap - out[-1]["test_ap"] if out else 0.0})
    return out


def importance(bundle: Bundle, top: int = 20) -> list[dict]:
    """The features that the trees gain most from, with their share of all gain."""
    gains = bundle.trees.stages[-1].featureImportances.toArray()
    whole = gains.sum() or 1.0
    order = sorted(zip(bundle.features, gains, strict=True), key=lambda x: (-x[1], x[0]))[:top]
    return [{"feature": f, "gain": float(g), "share": float(g / whole)} for f, g in order]


def _tree_arrays(tree) -> tuple[np.ndarray, ...]:
    """A tree as arrays: feature (-1 at a leaf), threshold, left, right and prediction of each node."""
    rows: list[list[float]] = []

    def walk(node) -> int:
        k = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            rows[k][0], rows[k][1] = node.split().featureIndex(), node.split().threshold()
            rows[k][2] = walk(node.leftChild())
            rows[k][3] = walk(node.rightChild())
        return k

    walk(tree._java_obj.rootNode())
    a = np.array(rows, float)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def tree_contributions(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """actor, m, one additive contribution a feature, and the trees' bias; together they are the margin.

    At each split on a row's path the change of the node's prediction goes to the split's feature.
    """
    model, features = bundle.trees.stages[-1], bundle.features
    trees = [(float(w), _tree_arrays(t)) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def run(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            out, bias, each = np.zeros_like(x), 0.0, np.arange(len(x))
            for weight, (feature, threshold, left, right, value) in trees:
                node = np.zeros(len(x), int)
                bias += weight * value[0]
                while len(at := each[feature[node] >= 0]):
                    here, f = node[at], feature[node[at]]
                    down = np.where(x[at, f] <= threshold[here], left[here], right[here])
                    np.add.at(out, (at, f), weight * (value[down] - value[here]))
                    node[at] = down
            done = pdf[["actor", "m"]].copy()
            for k, f in enumerate(features):
                done[f] = out[:, k]
            yield done.assign(bias=bias)

    x = rows.fillna(0, features).select("actor", "m", *(F.col(f).cast("double").alias(f) for f in features))
    schema = T.StructType([T.StructField("actor", T.LongType()), T.StructField("m", T.LongType()), *(T.StructField(f, T.DoubleType()) for f in [*features, "bias"])])
    return x.mapInPandas(run, schema)


def save(bundle: Bundle, path: str) -> None:
    """Both models and a description, each replacing what was there."""
    from pyspark.sql import SparkSession

    from veloria.sources.sinks import write_text

    bundle.logistic.write().overwrite().save(f"{path}/logistic")
    bundle.trees.write().overwrite().save(f"{path}/trees")
    write_text(SparkSession.active(), f"{path}/bundle.json", json.dumps({"features": bundle.features, "selected": bundle.selected, "validation": bundle.validation}, sort_keys=True))


def load(path: str, features: list[str] | None = None) -> Bundle:
    """A saved bundle; other features than the ones asked for fail."""
    from pyspark.sql import SparkSession

    text = SparkSession.active().read.text(f"{path}/bundle.json", wholetext=True).head()[0]
    about = json.loads(text)
    if features is not None and features != about["features"]:
        raise ValueError("the saved model was fitted on other features")
    return Bundle(about["features"], PipelineModel.load(f"{path}/logistic"), PipelineModel.load(f"{path}/trees"), about["selected"], about["validation"])
