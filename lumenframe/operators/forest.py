"""Training of tree classifiers, a level of all trees at once.

Features are cut into bins by edges that are found once. At each level every batch of rows walks down the trees so far
and adds up its counts by (tree, node, feature, bin, class) for the nodes that are open; one aggregate adds up the
batches, and the best cut of each node comes from cumulated counts. No row is moved or kept per node, so what travels
depends on nodes, bins and classes. Bootstrap weights and the features that a node may use come from hashes, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.session import drop_table, materialize

#: Chances that a row is drawn up to 0, 1, ... times.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
NODES = "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers by shifts and products (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap sample holds each row: Poisson with mean 1."""
    h = _mix(ids.view(np.uint64) + _mix(np.array([(seed << 20) + tree], np.uint64)))
    return np.searchsorted(POISSON, h / 2.0**64, side="right")


def features_of(tree: int, node: int, width: int, most: int, seed: int) -> list[int]:
    """The features that a node may be cut by: the `most` of them with the smallest hashes."""
    h = _mix(np.arange(width, dtype=np.uint64) + _mix(np.array([(seed << 44) + (tree << 24) + node], np.uint64)))
    return sorted(np.argsort(h, kind="stable")[:most].tolist())


def bin_edges(rows: DataFrame, width: int, bins: int = 32, features: str = "features") -> list[list[float]]:
    """For each feature the values that cut its rows into about equal parts; values up to an edge are in its bin."""
    at = [i / bins for i in range(1, bins)]
    s = rows.agg(*[F.percentile_approx(F.col(features)[i], at, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [sorted({float(v) for v in s[f"q{i}"] or []}) for i in range(width)]


def forest_train(rows: DataFrame, width: int, key: str = "id", features: str = "features", label: str = "label", n_trees: int = 64, max_depth: int = 14, min_leaf: int = 1, max_features: int | None = None, seed: int = 0, bootstrap: bool = True, edges: list[list[float]] | None = None, bins: int = 32) -> tuple[DataFrame, list]:
    """Nodes of the trees (tree, node, feature, threshold, left, right, shares), and the classes in the order of shares.

    Each node takes the cut of least Gini impurity among max_features features (the root of their number by default), the
    first by feature and threshold of equal ones, with min_leaf drawn rows or more on both sides. Pure nodes, those at max_depth
    and those without such a cut are leaves. Rows without a label, without features or with a null among them are left out.
    Cuts are sought at the edges of bins (quantiles of all rows by default). Memory of the driver: the trees themselves.
    """
    ok = F.col(label).isNotNull() & F.col(features).isNotNull() & ~F.exists(F.slice(features, 1, width), lambda v: v.isNull())
    rows = rows.where(ok)
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    if not classes:
        raise ValueError("no labelled rows")
    edges = edges or bin_edges(rows, width, bins, features)
    most = min(width, max_features or max(1, round(math.sqrt(width))))
    number = (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("int")
    z = materialize(rows.select(F.xxhash64(key).alias("h"), number.alias("c"), F.slice(F.transform(features, lambda v: v.cast("double")), 1, width).alias("f")), "forest-rows")
    spark, n_classes = rows.sparkSession, len(classes)
    nodes: list[dict[int, list]] = [{0: [-1, 0.0, -1, -1, None]} for _ in range(n_trees)]  # feature, threshold, left, right, counts
    open_nodes = {(t, 0): features_of(t, 0, width, most, seed) for t in range(n_trees)}

    for depth in range(max_depth + 1):
        if not open_nodes:
            break
        flat = [{n: tuple(v[:4]) for n, v in tree.items()} for tree in nodes]
        sent = spark.sparkContext.broadcast((flat, open_nodes, edges))

        def counts(batches: Iterator[pa.RecordBatch], sent=sent, depth=depth) -> Iterator[pa.RecordBatch]:
            trees, wanted, cut = sent.value
            size = np.array([[t, n] for t, n in wanted], np.int64)
            number_of = {tn: i for i, tn in enumerate(wanted)}
            may = np.zeros((len(size), width), bool)
            for i, tn in enumerate(wanted):
                may[i, wanted[tn]] = True
            wide = max(len(e) for e in cut) + 1
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, c = batch.column("h").to_numpy(), batch.column("c").to_numpy()
                x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                b = np.stack([np.searchsorted(np.array(e), x[:, i], side="left") for i, e in enumerate(cut)], 1)
                total: dict[str, list] = {"code": [], "w": []}
                for t, tree in enumerate(trees):
                    n = max(tree) + 1
                    table = np.full((n, 4), -1.0)
                    for k, v in tree.items():
                        table[k] = v
                    node = np.zeros(len(ids), np.int64)
                    for _ in range(depth):
                        f = table[node, 0].astype(np.int64)
                        down = np.where(x[np.arange(len(ids)), np.maximum(f, 0)] <= table[node, 1], table[node, 2], table[node, 3]).astype(np.int64)
                        node = np.where(f < 0, node, down)
                    of_node = np.full(n, -1)
                    for k in tree:
                        of_node[k] = number_of.get((t, k), -1)
                    w = draws(ids, t, seed) if bootstrap else np.ones(len(ids), np.int64)
                    at = of_node[node]
                    live = np.flatnonzero((at >= 0) & (w > 0))
                    r, f = np.nonzero(may[at[live]])
                    r = live[r]
                    total["code"].append(((at[r] * width + f) * wide + b[r, f]) * n_classes + c[r])
                    total["w"].append(w[r])
                code = np.concatenate(total["code"])
                keys, inverse = np.unique(code, return_inverse=True)
                w = np.bincount(inverse, np.concatenate(total["w"]), len(keys)).astype(np.int64)
                cls, rest = keys % n_classes, keys // n_classes
                bin_, rest = rest % wide, rest // wide
                tn = size[rest // width] if len(keys) else np.zeros((0, 2), np.int64)
                columns = [tn[:, 0], tn[:, 1], rest % width, bin_, cls]
                yield pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int32)) for v in columns], pa.array(w)], names=["tree", "node", "feature", "bin", "c", "w"])

        h = z.mapInArrow(counts, "tree int, node int, feature int, bin int, c int, w long").groupBy("tree", "node", "feature", "bin").pivot("c", list(range(n_classes))).agg(F.sum("w"))
        h = h.select("tree", "node", "feature", "bin", F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in range(n_classes)]).alias("n"))
        upto = W.partitionBy("tree", "node", "feature").orderBy("bin")
        sums = h.select("tree", "node", "feature", "bin", F.array(*[F.sum(F.col("n")[c]).over(upto) for c in range(n_classes)]).alias("l"), F.array(*[F.sum(F.col("n")[c]).over(W.partitionBy("tree", "node", "feature")) for c in range(n_classes)]).alias("t"))
        add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
        square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
        right = F.zip_with("t", "l", lambda t, v: t - v)
        s = sums.select("tree", "node", "feature", "bin", "t", "l", add("l").alias("nl"), add(right).alias("nr"), right.alias("r"))
        # Impurity of both sides: a smaller one is a larger sum of squares over the sides' sizes.
        pure = F.round(square("l") / F.col("nl") + square("r") / F.col("nr"), 9)
        good = (F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf) & (F.col("nl") > 0) & (F.col("nr") > 0)
        best = s.withColumn("score", F.when(good, pure)).groupBy("tree", "node").agg(F.first("t").alias("t"), F.max_by(F.struct("feature", "bin", "l", "r"), F.struct("score", -F.col("feature"), -F.col("bin"))).alias("b"), F.max("score").alias("score"))
        following: dict[tuple[int, int], list[int]] = {}
        for r in best.collect():
            tree, total = nodes[r["tree"]], list(r["t"])
            tree[r["node"]][4] = total
            if depth == max_depth or r["score"] is None or sum(v > 0 for v in total) <= 1:
                continue
            left, right_ = len(tree), len(tree) + 1
            tree[r["node"]][:4] = [r["b"]["feature"], edges[r["b"]["feature"]][r["b"]["bin"]], left, right_]
            for child, part in ((left, r["b"]["l"]), (right_, r["b"]["r"])):
                tree[child] = [-1, 0.0, -1, -1, list(part)]
                following[r["tree"], child] = features_of(r["tree"], child, width, most, seed)
        open_nodes = following
    drop_table(z)
    share = lambda n: [v / sum(n) for v in n] if n and sum(n) else [1 / n_classes] * n_classes
    out = [(t, n, v[0], float(v[1]), v[2], v[3], share(v[4])) for t, tree in enumerate(nodes) for n, v in tree.items()]
    return spark.createDataFrame(out, NODES), classes
