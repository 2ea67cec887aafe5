"""Classifiers over rows of features (an array column): softmax regression and trees, trained models as small tables.

Rows stay where they are: training adds up one gradient per step, predictions are expressions or joins with the model,
whose size depends on features, classes and nodes, not on rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import drop_table, materialize

#: Trees with more nodes in all than this are joined by a shuffle instead of a broadcast.
BROADCAST_NODES = 200_000


@dataclass(frozen=True)
class Softmax:
    """weights[c][0] is the bias of class c; means and deviations are those of the features it learned from."""

    weights: list[list[float]]
    classes: list
    means: list[float]
    deviations: list[float]
    steps: int
    loss: float


def standardize(df: DataFrame, width: int, features: str = "features") -> tuple[list[float], list[float]]:
    """Means and sample deviations of the first `width` features; a feature that doesn't vary has the deviation 1."""
    at = [F.col(features)[i] for i in range(width)]
    s = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    return [s[f"m{i}"] or 0.0 for i in range(width)], [d if (d := s[f"s{i}"]) and math.isfinite(d) else 1.0 for i in range(width)]


def _shares(features: list[Column], weights: list[list[float]]) -> Column:
    """Class probabilities of one row."""
    scores = F.array(*[sum((F.lit(w) * x for w, x in zip(row[1:], features, strict=True)), F.lit(row[0])) for row in weights])
    up = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(up, lambda e: e / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def softmax_train(rows: DataFrame, width: int, features: str = "features", label: str = "label", rate: float = 0.5, steps: int = 800, penalty: float = 1e-3, tolerance: float = 1e-7, scaled: bool = True) -> Softmax:
    """Multinomial regression by full gradient steps from zero weights, with an L2 penalty on all but the biases.

    Stops when the loss changes by less than the tolerance. Rows without a label or features are left out; classes are in
    ascending order. Each step is one aggregate of (width + 1) * classes sums.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    if not classes:
        raise ValueError("no labelled rows")
    means, devs = standardize(rows, width, features) if scaled else ([0.0] * width, [1.0] * width)
    x = [(F.col(features)[i] - means[i]) / devs[i] for i in range(width)]
    z = materialize(rows.select(F.array(*x).alias("x"), (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("int").alias("c")), "softmax-rows")
    w, before, loss, done = [[0.0] * (width + 1) for _ in classes], math.inf, 0.0, 0
    for done in range(1, steps + 1):
        t = z.select("x", "c", _shares([F.col("x")[i] for i in range(width)], w).alias("p"))
        off = [F.col("p")[c] - (F.col("c") == c).cast("double") for c in range(len(classes))]
        sums = [F.avg(o * F.col("x")[i - 1] if i else o).alias(f"g{c}_{i}") for c, o in enumerate(off) for i in range(width + 1)]
        g = t.agg(F.avg(-F.log(F.get("p", F.col("c")))).alias("loss"), *sums).first()
        loss = g["loss"] + penalty / 2 * sum(v * v for row in w for v in row[1:])
        w = [[v - rate * (g[f"g{c}_{i}"] + (penalty * v if i else 0.0)) for i, v in enumerate(row)] for c, row in enumerate(w)]
        if abs(before - loss) < tolerance:
            break
        before = loss
    drop_table(z)
    return Softmax(w, classes, means, devs, done, loss)


def softmax_predict(rows: DataFrame, model: Softmax, features: str = "features") -> DataFrame:
    """Adds shares (class probabilities in the order of the model) and predicted, the first of the likeliest classes."""
    x = [(F.col(features)[i] - m) / s for i, (m, s) in enumerate(zip(model.means, model.deviations, strict=True))]
    t = rows.withColumn("shares", _shares(x, model.weights))
    return t.withColumn("predicted", _likeliest(model.classes))


def _likeliest(classes: list) -> Column:
    return F.get(F.array(*map(F.lit, classes)), (F.array_position("shares", F.array_max("shares")) - 1).cast("int"))


def forest_predict(rows: DataFrame, nodes: DataFrame, classes: list, key: str = "id", features: str = "features", depth: int = 14) -> DataFrame:
    """Mean class shares over the trees: key, shares, predicted (the first of the likeliest classes).

    nodes: tree, node (0 is the root), feature (from 0; -1 is a leaf), threshold (up to it goes left), left, right, shares.
    Rows go down a level of all trees at once, `depth` levels at most; key must tell rows apart.
    """
    small = nodes.count() <= BROADCAST_NODES
    near = F.broadcast if small else (lambda df: df)
    trees = sorted(r["tree"] for r in nodes.where("node = 0").select("tree").collect())
    at = rows.select(F.col(key), F.col(features).alias("f"), F.explode(F.array(*map(F.lit, trees))).alias("tree"), F.lit(0).alias("node"))
    split = nodes.where("feature >= 0").select("tree", "node", "feature", "threshold", "left", "right")
    for _ in range(depth):
        go = F.when(F.col("feature").isNull(), F.col("node")).when(F.get("f", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(near(split), ["tree", "node"], "left").select(key, "f", "tree", go.alias("node"))
    t = at.join(near(nodes.select("tree", "node", "shares")), ["tree", "node"])
    means = t.groupBy(key).agg(F.array(*[F.avg(F.col("shares")[i]) for i in range(len(classes))]).alias("shares"))
    return means.withColumn("predicted", _likeliest(classes))
