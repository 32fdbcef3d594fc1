"""Queries of the model lifecycle, over the features of the whole panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions.columns import tidy
from veloria.operators import lifecycle as op
from veloria.plans import panel
from veloria.sources.shared import stored

#: Rounds of boosting; the panel's signal is weak, and more do not rank it better.
ROUNDS = 3


def blocks() -> dict[str, list[str]]:
    """The panel's features, by block, in the order in which ablation adds them."""
    kinds, others = list(panel.CLASSES), list(panel.RECEIVED)
    return {
        "levels": [*(f"{c}_{k}m" for c in kinds for k in (1, 3, 6, 12)), "new_3m", "new_6m", "new_12m", "cumulative", "tenure", "no_activity", "weekend_3m", "weekend_prior"],
        "dynamics": [*(f"{c}_{x}" for c in kinds for x in ("ratio", "delta")), "n_z", "urgent_z", "months_since", "weekend_delta", "gini", "divergence"],
        "traction": [f"traction_{k}_{x}" for k in others for x in ("3m", "12m", "ratio", "delta")],
        "ownership": ["own_3m", "own_delta", "collab_3m", "collab_delta", "collab_z"],
    }


def features() -> list[str]:
    return [f for own in blocks().values() for f in own]


def rows(s, d):
    frame = panel.flagship(s, d)
    return stored(frame.select("actor", "m", "y", "split", *(F.col(f).cast("double").alias(f) for f in features())))


def _table(s, out: list[dict]):
    return tidy(s.createDataFrame(out))


def _contributions(s, d):
    x = rows(s, d)
    bundle = op.fit(x, features(), ROUNDS)
    got = op.tree_contributions(bundle, x.filter("split = 'test'"))
    family = {f: name for name, own in blocks().items() for f in own}
    sums = [sum((F.col(f) for f in features() if family[f] == name), F.lit(0.0)).alias(name) for name in blocks()]
    return tidy(got.select("actor", "m", "bias", *sums), 4)


QUERIES = {
    "selected_model_metrics": lambda s, d: _table(s, op.metrics(op.fit(x := rows(s, d), features(), ROUNDS), x)),
    "null_gate": lambda s, d: _table(s, [op.null_gate(rows(s, d), features(), ROUNDS)]),
    "block_ablation": lambda s, d: _table(s, op.ablation(rows(s, d), blocks(), ROUNDS)),
    "importance": lambda s, d: _table(s, op.importance(op.fit(rows(s, d), features(), ROUNDS))),
    "tree_contributions": _contributions,
}

ORACLES: dict[str, str] = {}
