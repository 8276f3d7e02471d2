"""Extremely randomised trees (MD7): random cuts, no depth limit.

A node looks at features in the order of seeded draws until it has seen ``tried``
features that are not constant in it, draws one cut for each between the feature's
smallest and largest value there, and takes the cut with the largest fall of the Gini
impurity (of equal ones the first). A node is a leaf if it is pure or all its features
are constant. Draws are md5 numbers of (seed, purpose, node, feature), so a node's cuts
follow from its name alone, in whatever task it is grown, and SQL can recompute them.

Nodes with many rows are grown level by level without moving rows: their current node
in each tree is a column. A level takes two passes: smallest and largest values of each
node, then class weights left of each drawn cut; both are sums over tasks. A node of at
most ``ship_cells`` cells (rows x features) moves to one task, which finishes its
subtree in memory. Either way gives the same tree. So the nodes that the driver sees
have more rows than that each, and trees are grown in groups that bound their number.

The forest is a table (tree, node, feature, threshold, share, weight, gain): ``node`` is
the path from the root as zeros and ones, ``share`` the weight of class 1 among the
node's, and ``feature`` -1 in leaves. Scoring reads it in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions.lineage import cut_lineage

SHIP_CELLS = 4_000_000
GROUP_NODES = 50_000
TREES_TOGETHER = 16
BLOCK_NODES = 1_000_000
FOREST = "tree int, node string, feature int, threshold double, share double, weight double, gain double"
_NAMES = [c.split()[0] for c in FOREST.split(", ")]


def draw(seed: int, purpose: str, tree: int, node: str, feature: int) -> str:
    return hashlib.md5(f"{seed}:{purpose}:{tree}:{node}:{feature}".encode()).hexdigest()


def fraction(digest: str) -> float:
    return int(digest[:8], 16) / 2**32


def gini(ones: np.ndarray | float, weight: np.ndarray | float) -> np.ndarray | float:
    """Impurity times weight."""
    return 2 * ones * (weight - ones) / np.maximum(weight, 1e-300)


def drawn_cuts(seed: int, tree: int, node: str, low: np.ndarray, high: np.ndarray, tried: int) -> tuple[list[int], list[float]]:
    """The features that a node looks at, and a cut of each; none if all are constant."""
    open_ = np.flatnonzero(high > low).tolist()
    order = sorted(open_, key=lambda j: draw(seed, "feature", tree, node, j))[:tried]
    cuts = []
    for j in order:
        a, b = float(low[j]), float(high[j])
        cut = a + fraction(draw(seed, "cut", tree, node, j)) * (b - a)
        cuts.append(cut if cut < b else a)
    return order, cuts


def best_cut(left_w: np.ndarray, left_1: np.ndarray, w: float, ones: float) -> tuple[int, float]:
    """The place of the best cut and its gain, from class weights left of each."""
    gains = gini(ones, w) - gini(left_1, left_w) - gini(ones - left_1, w - left_w)
    at = int(np.argmax(np.round(gains, 9)))
    return at, float(gains[at])


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int, tree: int, root: str, tried: int) -> list[tuple]:
    """Rows of the forest table for the subtree of a node's rows."""
    out, stack = [], [(root, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        weight, ones = float(w[at].sum()), float((w[at] * y[at]).sum())
        feature, threshold, gain, part = -1, None, 0.0, x[at]
        if 0 < ones < weight:
            order, cuts = drawn_cuts(seed, tree, node, part.min(0), part.max(0), tried)
            if order:
                left = part[:, order] <= np.array(cuts)
                k, gain = best_cut(w[at] @ left, (w[at] * y[at]) @ left, weight, ones)
                feature, threshold = order[k], cuts[k]
                stack += [(node + "1", at[~left[:, k]]), (node + "0", at[left[:, k]])]
        out.append((tree, node, feature, threshold, ones / weight if weight else 0.0, weight, gain))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ranges(rows: DataFrame) -> dict[int, tuple[int, float, float, np.ndarray, np.ndarray]]:
    """Of each active node: rows, weight, weight of class 1, smallest and largest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w, x, at = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)), _matrix(batch.column(3)))
            for t in range(at.shape[1]):
                order = np.argsort(at[:, t], kind="stable")
                order = order[np.searchsorted(at[order, t], 0) :]
                if not len(order):
                    continue
                names, first = np.unique(at[order, t], return_index=True)
                part, weight = x[order], w[order]
                sums = [np.diff(np.append(first, len(order))), np.add.reduceat(weight, first), np.add.reduceat(weight * y[order], first)]
                low, high = np.minimum.reduceat(part, first, axis=0), np.maximum.reduceat(part, first, axis=0)
                for k, n in enumerate(names.tolist()):
                    new = [*(s[k] for s in sums), low[k], high[k]]
                    old = found.get(n)
                    found[n] = new if old is None else [*(a + b for a, b in zip(old[:3], new[:3], strict=True)), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
        yield pa.RecordBatch.from_pandas(
            pd.DataFrame([(n, int(v[0]), float(v[1]), float(v[2]), v[3].tolist(), v[4].tolist()) for n, v in found.items()], columns=["at", "n", "w", "ones", "low", "high"]).astype({"at": "int32", "n": "int64", "w": "float64", "ones": "float64"}),
            schema=pa.schema([("at", pa.int32()), ("n", pa.int64()), ("w", pa.float64()), ("ones", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]),
            preserve_index=False,
        )

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        low, high = np.min(np.stack(parts["low"].to_numpy()), 0), np.max(np.stack(parts["high"].to_numpy()), 0)
        return pd.DataFrame({"at": [key[0]], "n": [parts["n"].sum()], "w": [parts["w"].sum()], "ones": [parts["ones"].sum()], "low": [low.tolist()], "high": [high.tolist()]})

    schema = "at int, n long, w double, ones double, low array<double>, high array<double>"
    merged = rows.mapInArrow(run, schema).groupBy("at").applyInPandas(merge, schema)
    return {r["at"]: (r.n, r.w, r.ones, np.array(r.low), np.array(r.high)) for r in merged.toLocalIterator()}


def _left_sums(rows: DataFrame, drawn: dict[int, tuple[list[int], list[float]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Weights left of the drawn cuts of each node, of all rows and of class 1."""
    shared = rows.sparkSession.sparkContext.broadcast(drawn)  # GROUP_NODES nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w, x, at = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)), _matrix(batch.column(3)))
            for t in range(at.shape[1]):
                order = np.argsort(at[:, t], kind="stable")
                names, first = np.unique(at[order, t], return_index=True)
                for n, rows_of in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                    if n in shared.value:
                        features, cuts = shared.value[n]
                        left = x[np.ix_(rows_of, features)] <= np.array(cuts)
                        sums = np.stack([w[rows_of] @ left, (w[rows_of] * y[rows_of]) @ left])
                        found[n] = found[n] + sums if n in found else sums
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([v.ravel().tolist() for v in found.values()], pa.list_(pa.float64()))], names=["at", "sums"]
        )

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "sums": [np.sum(np.stack(parts["sums"].to_numpy()), 0).tolist()]})

    schema = "at int, sums array<double>"
    out = {}
    for r in rows.mapInArrow(run, schema).groupBy("at").applyInPandas(merge, schema).toLocalIterator():
        out[r["at"]] = tuple(np.array(r.sums).reshape(2, -1))
    shared.destroy()
    return out


def _moved(rows: DataFrame, steps: dict[int, tuple[int, float, int, int]]) -> DataFrame:
    """Rows with their next node: (feature, threshold, left, right) of each node; negative nodes are done."""
    shared = rows.sparkSession.sparkContext.broadcast(steps)  # GROUP_NODES nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at = _matrix(batch.column(2)), _matrix(batch.column(3)).astype(np.int64)
            names = np.array(sorted(shared.value) or [0])
            table = np.array([shared.value.get(n, (0, 0.0, -1, -1)) for n in names.tolist()], float)
            place = np.minimum(np.searchsorted(names, at), len(names) - 1)
            known = names[place] == at
            feature, cut = table[place, 0].astype(int), table[place, 1]
            left = np.take_along_axis(x, feature, 1) <= cut
            new = np.where(known, np.where(left, table[place, 2], table[place, 3]), np.where(at < 0, at, -1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(new), pa.list_(pa.int32()))], names=batch.schema.names)

    return cut_lineage(rows.mapInArrow(run, rows.schema))


def _finished(shipped: DataFrame, seed: int, tried: int) -> DataFrame:
    """Subtrees of (group, roots, y, weight, features): a group's rows grow every (tree, node) of its roots."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y, w = np.stack(rows["features"].to_numpy()), rows["y"].to_numpy(), rows["weight"].to_numpy()
        out = []
        for root in key[0].split(","):
            tree, _, node = root.partition(":")
            out += grow(x, y, w, seed, int(tree), node, tried)
        return pd.DataFrame(out, columns=_NAMES)

    return shipped.groupBy("roots").applyInPandas(run, FOREST)


def extra_trees(df: DataFrame, trees: int, seed: int = 42, tried: int | None = None, ship_cells: int = SHIP_CELLS) -> DataFrame:
    """The forest table of (y, features, optional weight); each tree sees all rows."""
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    rows = cut_lineage(df.select(F.col("y").cast("double").alias("y"), weight.alias("weight"), F.col("features").cast("array<double>").alias("features")))
    n, d = rows.agg(F.count("*"), F.max(F.size("features"))).first()
    if not n:
        raise ValueError("A forest needs rows.")
    tried = tried or max(1, math.isqrt(d))
    enough = max(1, ship_cells // d)  # rows of a node that moves to one task
    if n <= enough:
        roots = [",".join(f"{t}:" for t in range(a, min(a + TREES_TOGETHER, trees))) for a in range(0, trees, TREES_TOGETHER)]
        shipped = rows.withColumn("roots", F.explode(F.array(*map(F.lit, roots))))
        return cut_lineage(_finished(shipped.repartition(len(roots), "roots"), seed, tried))
    # a group's active nodes: more than ``enough`` rows each, so n / enough for each tree at most, and their children
    together = max(1, min(trees, GROUP_NODES * enough // (2 * n)))
    parts = [_by_levels(rows, list(range(a, min(a + together, trees))), seed, tried, enough) for a in range(0, trees, together)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_levels(rows: DataFrame, trees: list[int], seed: int, tried: int, enough: int) -> DataFrame:
    """The trees of a group: large nodes level by level, small ones in one task each."""
    spark = rows.sparkSession
    at = rows.withColumn("at", F.array(*(F.lit(k) for k in range(len(trees)))))
    active = {k: (t, "") for k, t in enumerate(trees)}
    done: list[tuple] = []
    ended: list[DataFrame] = []
    number = len(trees)
    while active:
        found = _ranges(at)
        small = {k: v for k, v in active.items() if found[k][0] <= enough}
        large = {k: v for k, v in active.items() if k not in small}
        if small:
            names = spark.createDataFrame([(k, f"{t}:{node}") for k, (t, node) in small.items()], "node int, roots string")
            shipped = at.select("y", "weight", "features", F.explode("at").alias("node")).join(F.broadcast(names), "node")
            ended.append(cut_lineage(_finished(shipped.drop("node"), seed, tried)))
        drawn = {}
        for k, (t, node) in large.items():
            _, w, ones, low, high = found[k]
            cuts = drawn_cuts(seed, t, node, low, high, tried) if 0 < ones < w else ([], [])
            if cuts[0]:
                drawn[k] = cuts
            else:
                done.append((t, node, -1, None, ones / w if w else 0.0, w, 0.0))
        sums = _left_sums(at, drawn) if drawn else {}
        steps, following = {}, {}
        for k, (features, cuts) in drawn.items():
            t, node = large[k]
            _, w, ones, _, _ = found[k]
            best, gain = best_cut(*sums[k], w, ones)
            done.append((t, node, features[best], cuts[best], ones / w, w, gain))
            steps[k] = (features[best], cuts[best], number, number + 1)
            following |= {number: (t, node + "0"), number + 1: (t, node + "1")}
            number += 2
        active = following
        if active:
            at = _moved(at, steps)
    tops = spark.createDataFrame(done, FOREST)  # nodes of more than ``enough`` rows
    for e in ended:
        tops = tops.unionByName(e)
    return cut_lineage(tops)


def forest_table(nodes: DataFrame) -> DataFrame:
    """The forest table of the saved nodes of a Spark ML forest; a task names the nodes of one tree."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = rows.set_index("id")
        children = dict(zip(at.index, zip(at["l"], at["r"], strict=True), strict=True))
        names, stack = {}, [(0, "")]
        while stack:
            n, name = stack.pop()
            names[n] = name
            left, right = children[n]
            if left >= 0:
                stack += [(left, name + "0"), (right, name + "1")]
        return rows.assign(node=rows["id"].map(names))[_NAMES]

    stats, leaf = F.col("nodeData.impurityStats"), F.col("nodeData.leftChild") < 0
    weight = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    flat = nodes.select(
        F.col("treeID").cast("int").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("l"),
        F.col("nodeData.rightChild").alias("r"), F.when(leaf, -1).otherwise(F.col("nodeData.split.featureIndex")).cast("int").alias("feature"),
        F.when(~leaf, F.col("nodeData.split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.coalesce(F.try_divide(F.get(stats, F.lit(1)), weight), F.lit(0.0)).alias("share"), weight.alias("weight"),
        F.when(leaf, 0.0).otherwise(F.col("nodeData.gain") * weight).alias("gain"),
    )
    return flat.groupBy("tree").applyInPandas(run, FOREST)


def _arrays(forest: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """For each tree: feature, threshold, place of the left and right child, share."""
    out = []
    for _, t in forest.groupby("tree", sort=True):
        place = {n: k for k, n in enumerate(t["node"])}
        left = np.array([place.get(n + "0", -1) for n in t["node"]])
        right = np.array([place.get(n + "1", -1) for n in t["node"]])
        root = place[""]
        order = np.r_[root, np.delete(np.arange(len(t)), root)]
        back = np.argsort(order)
        step = lambda c: np.where(c[order] >= 0, back[c[order]], -1)  # noqa: B023, E731
        out.append((t["feature"].to_numpy()[order], t["threshold"].fillna(0).to_numpy()[order], step(left), step(right), t["share"].to_numpy()[order]))
    return out


def _shares(x: np.ndarray, trees: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, threshold, left, right, share in trees:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            f = feature[at[rows]]
            rows = rows[f >= 0]
            f = f[f >= 0]
            here = at[rows]
            at[rows] = np.where(x[rows, f] <= threshold[here], left[here], right[here])
        total += share[at]
    return total


def _share_column(shared):
    @F.pandas_udf("double")
    def shares(x: pd.Series) -> pd.Series:
        return pd.Series(_shares(np.stack(x.to_numpy()), shared.value) if len(x) else np.empty(0))

    return shares


def score_trees(df: DataFrame, forest: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with ``score``, the mean share of class 1 of the leaves that a row falls into."""
    sizes = {r.tree: r.n for r in forest.groupBy("tree").agg(F.count("*").alias("n")).collect()}  # one row for each tree
    blocks, room = [[]], BLOCK_NODES
    for t in sorted(sizes):
        if blocks[-1] and sizes[t] > room:
            blocks.append([])
            room = BLOCK_NODES
        blocks[-1].append(t)
        room -= sizes[t]
    out = df
    for k, block in enumerate(blocks):
        part = _arrays(forest.where(F.col("tree").isin(block)).toPandas())  # BLOCK_NODES nodes, or one tree
        out = out.withColumn(f"_share{k}", _share_column(df.sparkSession.sparkContext.broadcast(part))(features))
    total = sum((F.col(f"_share{k}") for k in range(1, len(blocks))), F.col("_share0"))
    return out.withColumn("score", total / len(sizes)).drop(*(f"_share{k}" for k in range(len(blocks))))


def importances(forest: DataFrame, d: int) -> list[float]:
    """Mean over trees of each feature's share of the tree's gains."""
    gains = forest.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect()  # trees x features
    table = np.zeros((max((r.tree for r in gains), default=0) + 1, d))
    for r in gains:
        table[r.tree, r.feature] = r.gain
    total = table.sum(1, keepdims=True)
    return (table / np.where(total > 0, total, 1)).mean(0).tolist()
