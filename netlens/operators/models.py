"""Model registry and training (MD1-MD14, SC1-SC3).

Models train on ``features`` (array), ``y`` and optionally ``weight``; scoring
adds ``score`` in [0, 1]. Differences from the usual single-machine learners:
trees other than the extra trees are at most 30 deep and choose split points from
``max_bins`` histogram bins, and the intercept of logistic regression is not penalised.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.codegen import short_methods
from netlens.functions.lineage import cut_lineage, shared_folder, side_by_side
from netlens.operators import forests, gradient
from netlens.operators.boosting import boosted_stumps, flat, score_column
from netlens.operators.knn import knn_join
from netlens.operators.metrics import min_max_scores
from netlens.operators.ranks import class_counts
from netlens.operators.resample import random_undersample
from netlens.operators.trees import extra_trees, forest_table, importances, score_trees

# Neighbours of the knn model and focusing exponent of the focal loss.
KNN_K, FOCAL_GAMMA = 7, 2.0
EPS = 1e-6
DRIVER_NODES = 2_000_000
GROUP_TREES = 32
GROUPED_ROWS = 4_000
SMALL_ROWS = 4_000
TASK_CELLS = 32_000_000
STEP = 0.1


@dataclass(frozen=True)
class ModelSpec:
    name: str
    supports_class_weight: bool
    needs_scaling: bool
    family: str
    allowed_strategies: tuple[str, ...] | None = None


BASELINE_ONLY = ("baseline",)
MODELS = {
    m.name: m
    for m in (
        ModelSpec("logistic_regression", True, True, "linear"),
        ModelSpec("random_forest", True, False, "tree"),
        ModelSpec("gradient_boosting", False, False, "tree"),
        ModelSpec("extra_trees", True, False, "tree"),
        ModelSpec("linear_svm", True, True, "linear"),
        ModelSpec("knn", False, True, "distance"),
        ModelSpec("decision_tree", True, False, "tree"),
        ModelSpec("balanced_random_forest", False, False, "ensemble", BASELINE_ONLY),
        ModelSpec("easy_ensemble", False, False, "ensemble", BASELINE_ONLY),
        ModelSpec("rusboost", False, False, "ensemble", BASELINE_ONLY),
        ModelSpec("focal_logistic", False, True, "loss", BASELINE_ONLY),
    )
}


@dataclass
class Settings:
    """Sizes of the learners; smaller values make trial runs quick."""

    forest_trees: int = 250
    extra_trees: int = 300
    forest_depth: int = 30
    tree_depth: int = 30
    boosting_stages: int = 100
    boosting_rounds: int = 50
    bags: int = 20
    forest_bags: int = 10
    parallel_bags: int = 4
    max_bins: int = 32
    max_iter: int = 2000
    c: float = 1.0


@dataclass
class Fitted:
    """A trained model: Spark ML models with a rule that turns them into a score."""

    name: str
    kind: str  # probability, margin, boosted, neighbours, trees, forest, staged, pipeline
    models: list = field(default_factory=list)
    stumps: list[list[float]] = field(default_factory=list)
    bounds: tuple[float, float] | None = None
    base: DataFrame | None = None

    def score(self, df: DataFrame, per_batch_bounds: bool = False) -> DataFrame:
        """``df`` with ``score``; ``df`` needs ``id`` for the knn model."""
        if self.kind == "neighbours":
            votes = knn_join(df, self.base, KNN_K, exclude_self=False).groupBy("id").agg(
                F.avg(F.col("neighbour_y").cast("double")).alias("score")
            )
            return df.join(votes, "id", "left").na.fill(0.0, ["score"])
        if self.kind == "pipeline":
            scored = self.models[0].transform(df)
            made = _probability if "probability" in scored.columns else label_score
            return made(self.models[0], df, "score")
        if self.kind == "trees":
            return score_trees(df, self.base)
        if self.kind == "forest":
            return forests.score_forest(df, self.base)
        if self.kind == "staged":
            return df.withColumn("score", gradient.score_column(self.stumps))
        if self.kind == "boosted":
            return df.withColumn("score", score_column(self.stumps))
        out = df.withColumn("_v", array_to_vector("features"))
        if self.kind == "margin":
            raw = self.models[0].transform(out).withColumn("_raw", vector_to_array("rawPrediction")[1])
            # not clipped to [0, 1]: rows outside the training range keep their order
            scaled = min_max_scores(raw, "_raw", None if per_batch_bounds else self.bounds)
            return scaled.select(*df.columns, "score")
        columns = []
        for i, model in enumerate(self.models):
            out = _probability(model, out, f"_p{i}")
            columns.append(F.col(f"_p{i}"))
        return out.select(*df.columns, (_total(columns) / len(columns)).alias("score"))

    @property
    def default_threshold(self) -> float:
        """Where the model itself decides for class 1: above one half, or above margin 0."""
        if self.kind != "margin":
            return math.nextafter(0.5, 1.0)
        low, high = self.bounds
        return math.nextafter(-low / (high - low), math.inf) if high > low else 0.5

    def importances(self, width: int) -> list[float] | None:
        """Mean importances of ``width`` features, for models that have them."""
        if self.kind == "trees":
            return importances(self.base, width)
        if self.kind == "forest":
            return forests.importances(self.base, width)
        if self.kind == "staged":
            return gradient.importances(self.stumps, width)
        found = [m.featureImportances.toArray() for m in self.models if hasattr(m, "featureImportances")]
        return list(sum(found) / len(found)) if found and self.kind == "probability" else None


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def _clean(model, df: DataFrame, out: str, value: Column) -> DataFrame:
    made = {"rawPrediction", "probability", "prediction"}
    scored = model.transform(df).withColumn(out, value)
    return scored.select(*[c for c in scored.columns if c not in made])


def _probability(model, df: DataFrame, out: str) -> DataFrame:
    """SC1: probability of class 1, 0 when the model knows one class only."""
    p = vector_to_array("probability")
    return _clean(model, df, out, F.when(F.size(p) > 1, F.get(p, F.lit(1))).otherwise(0.0))


def label_score(model, df: DataFrame, out: str = "score") -> DataFrame:
    """SC3: the predicted label as a number, for models without probabilities."""
    return _clean(model, df, out, F.col("prediction"))


def check_strategy(name: str, strategy: str) -> None:
    """MD12, MD13: whether the pair may be trained at all."""
    spec = MODELS[name]
    if spec.allowed_strategies is not None and strategy not in spec.allowed_strategies:
        raise ValueError(f"{name} trains with {', '.join(spec.allowed_strategies)} only, not with {strategy}")
    if strategy == "class_weight" and not spec.supports_class_weight:
        raise ValueError(f"{name} takes no class weights")


def balanced_weights(df: DataFrame) -> DataFrame:
    """MD12: ``weight`` = n / (2 · rows of the class)."""
    counts = class_counts(df, "y")
    n = sum(counts.values())
    weight = F.lit(0.0)
    for c, m in counts.items():
        weight = F.when(F.col("y") == c, F.lit(n / (len(counts) * m))).otherwise(weight)
    return df.withColumn("weight", weight)


def _points(df: DataFrame) -> DataFrame:
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    return df.select(array_to_vector("features").alias("_v"), F.col("y").cast("double").alias("y"), weight.alias("weight"))


def _common() -> dict:
    return {"featuresCol": "_v", "labelCol": "y", "weightCol": "weight"}


def _logistic(df: DataFrame, s: Settings) -> object:
    points = _points(df)
    total = points.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        **_common(), maxIter=s.max_iter, regParam=1 / (s.c * total), elasticNetParam=0.0, standardization=False
    ).fit(points)


def fit_logistic(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD1."""
    return Fitted("logistic_regression", "probability", [_logistic(df, s)])


def fit_decision_tree(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD2."""
    tree = DecisionTreeClassifier(**_common(), maxDepth=s.tree_depth, maxBins=s.max_bins, seed=seed)
    return Fitted("decision_tree", "probability", [tree.fit(_points(df))])


def _forest(df: DataFrame, s: Settings, seed: int, trees: int):
    return RandomForestClassifier(
        **_common(), numTrees=trees, maxDepth=s.forest_depth, maxBins=s.max_bins, seed=seed,
        featureSubsetStrategy="sqrt", maxMemoryInMB=1024,
    ).fit(_points(df))


def _binned(df: DataFrame, s: Settings) -> tuple[DataFrame, list]:
    """Blocks of binned rows, and the cut points."""
    points = cut_lineage(df.select("y", "features", *(c for c in ("weight",) if c in df.columns)))
    cuts = forests.cut_points(points, s.max_bins)
    return forests.binned(points, cuts), cuts


def _grown(df: DataFrame, s: Settings, seed: int, trees: int, first: int = 0) -> DataFrame:
    return forests.grow_forest(*_binned(df, s), trees, seed, s.forest_depth, first)


def fit_random_forest(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD3; a forest of more than ``DRIVER_NODES`` possible nodes becomes a table.

    Beyond ``GROUPED_ROWS`` rows, tasks grow whole trees (``operators.forests``); below, Spark's
    learner grows groups. A tree has fewer than two nodes for each row, and Spark ML keeps the trees of a fit on
    the driver; so a group's trees are written before the next group is grown. A later group
    has as many trees, up to ``GROUP_TREES``, as twice the largest tree so far leaves room for.
    """
    n = df.count()
    together = max(1, DRIVER_NODES // max(1, 2 * n))
    if together >= s.forest_trees:
        return Fitted("random_forest", "probability", [_forest(df, s, seed, s.forest_trees)])
    if n > GROUPED_ROWS:
        return Fitted("random_forest", "forest", base=_grown(df, s, seed, s.forest_trees))
    points = cut_lineage(df.select("y", "features", *(c for c in ("weight",) if c in df.columns)))  # read by every group
    folder, parts, first, largest = f"{shared_folder(df.sparkSession)}/forest-{uuid.uuid4().hex}", [], 0, 0
    while first < s.forest_trees:
        trees = min(together, s.forest_trees - first)
        _forest(points, s, seed + first, trees).save(f"{folder}/{first}")
        nodes = df.sparkSession.read.parquet(f"{folder}/{first}/data")
        largest = max(largest, nodes.groupBy("treeID").count().agg(F.max("count")).first()[0])
        parts.append(forest_table(nodes.withColumn("treeID", F.col("treeID") + first)))
        first += trees
        together = max(together, min(GROUP_TREES, DRIVER_NODES // (2 * largest)))
    return Fitted("random_forest", "trees", base=cut_lineage(reduce(DataFrame.unionByName, parts)))


def fit_extra_trees(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD7: whole sample per tree, random feature subsets and cuts, no depth limit."""
    return Fitted("extra_trees", "trees", base=extra_trees(df, s.extra_trees, seed))


def fit_gradient_boosting(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD4; a frame of more than ``SMALL_ROWS`` rows that fits one task is learned there (``operators.gradient``)."""
    n, d = df.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if SMALL_ROWS < n <= TASK_CELLS // max(1, d or 0):
        blocks, cuts = _binned(df, s)
        return Fitted("gradient_boosting", "staged", stumps=gradient.boosted_trees(blocks, cuts, s.boosting_stages, STEP))
    gbt = GBTClassifier(**_common(), maxIter=s.boosting_stages, maxDepth=gradient.DEPTH, stepSize=STEP, maxBins=s.max_bins, seed=seed)
    return Fitted("gradient_boosting", "probability", [gbt.fit(_points(df))])


def fit_linear_svm(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD5; the training margins bound the score scale (SC2)."""
    points = _points(df)
    svm = LinearSVC(**_common(), maxIter=s.max_iter, regParam=1e-4, standardization=False).fit(points)
    raw = vector_to_array("rawPrediction")[1]
    low, high = svm.transform(points).agg(F.min(raw), F.max(raw)).first()
    return Fitted("linear_svm", "margin", [svm], bounds=(low, high))


def fit_knn(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD6: keeps the training rows as a written table."""
    return Fitted("knn", "neighbours", base=cut_lineage(df.select("id", "y", "features")))


def fit_balanced_forest(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD8: forests on differently under-sampled frames; of more than ``DRIVER_NODES`` possible nodes, they become one table."""
    per_bag = math.ceil(s.forest_trees / s.forest_bags)
    counts = class_counts(df, "y")
    if 2 * len(counts) * min(counts.values(), default=0) * per_bag * s.forest_bags > DRIVER_NODES:
        rows = cut_lineage(df.select("id", "y", "features"))
        grown = lambda b: _grown(random_undersample(rows, seed + b), s, seed + b, per_bag, b * per_bag)
        return Fitted("balanced_random_forest", "forest", base=reduce(DataFrame.unionByName, _each_bag(grown, s.forest_bags, s)))
    bag = lambda b: _forest(random_undersample(df, seed + b), s, seed + b, per_bag)
    return Fitted("balanced_random_forest", "probability", _each_bag(bag, s.forest_bags, s))


def _each_bag(fit: Callable[[int], object], bags: int, s: Settings) -> list:
    """Bags are independent Spark jobs; a few run side by side."""
    return side_by_side(fit, range(bags), s.parallel_bags)


def fit_easy_ensemble(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD9: boosted stumps on balanced bags."""
    bags = boosted_stumps(
        df, rounds=s.boosting_rounds, bags=s.bags, seed=seed, max_bins=s.max_bins, resampled=False
    )
    return Fitted("easy_ensemble", "boosted", stumps=flat(bags))


def fit_rusboost(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD10: every round learns from another balanced part, weights follow the pseudo-loss over all rows."""
    bags = boosted_stumps(df, rounds=s.boosting_rounds, bags=1, seed=seed, max_bins=s.max_bins, resampled=True)
    return Fitted("rusboost", "boosted", stumps=flat(bags))


def focal_weights(df: DataFrame, probability: Column, gamma: float = FOCAL_GAMMA) -> Column:
    """MD11: hard rows of the rare class weigh most."""
    counts = class_counts(df, "y")
    top = max(counts.values())
    pt = F.when(F.col("y") == 1, probability).otherwise(1.0 - probability)
    alpha = F.when(F.col("y") == 1, F.lit(top / counts[1])).otherwise(F.lit(top / counts[0]))
    return alpha * F.pow(1.0 - F.least(F.greatest(pt, F.lit(EPS)), F.lit(1.0 - EPS)), F.lit(float(gamma)))


def fit_focal_logistic(df: DataFrame, s: Settings, seed: int) -> Fitted:
    """MD11: a balanced fit measures hardness, a second fit is weighted by it."""
    counts = class_counts(df, "y")
    if len(counts) < 2:
        raise ValueError("focal_logistic has to see both classes")
    warm = _logistic(balanced_weights(df), s)
    judged = _probability(warm, df.withColumn("_v", array_to_vector("features")), "_p")
    weighted = judged.withColumn("weight", focal_weights(df, F.col("_p")))
    return Fitted("focal_logistic", "probability", [_logistic(weighted, s)])


TRAINERS: dict[str, Callable[[DataFrame, Settings, int], Fitted]] = {
    "logistic_regression": fit_logistic,
    "random_forest": fit_random_forest,
    "gradient_boosting": fit_gradient_boosting,
    "extra_trees": fit_extra_trees,
    "linear_svm": fit_linear_svm,
    "knn": fit_knn,
    "decision_tree": fit_decision_tree,
    "balanced_random_forest": fit_balanced_forest,
    "easy_ensemble": fit_easy_ensemble,
    "rusboost": fit_rusboost,
    "focal_logistic": fit_focal_logistic,
}


def fit_model(name: str, strategy: str, df: DataFrame, settings: Settings | None = None, seed: int = 42) -> Fitted:
    """Train ``name`` on an already resampled frame."""
    check_strategy(name, strategy)
    if strategy == "class_weight":
        df = balanced_weights(df)
    with short_methods(df.sparkSession):
        return TRAINERS[name](df, settings or Settings(), seed)


def available(names: list[str]) -> tuple[list[str], list[str]]:
    """MD14: configured models that exist, and those that do not."""
    return [n for n in names if n in MODELS], [n for n in names if n not in MODELS]
