"""Resampling of a preprocessed training frame (RS1-RS12).

Frames have an integer id >= 0, ``y`` and ``features`` (array of doubles).
Synthetic rows get negative ids. Every random choice is a hash of (seed, purpose,
draw), so a retried task produces the same rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.lineage import cut_lineage
from netlens.functions.numbers import hex_number
from netlens.operators.knn import knn_join
from netlens.operators.ranks import assign_segments, class_counts, class_ranks

# Neighbours used by each method.
SMOTE_K, BORDER_M, ENN_K = 5, 10, 3
CHUNK = 1000
DIGITS = 15


def draw_number(seed: int, purpose: str, *parts: Column) -> Column:
    """A 60-bit number from the md5 text of ``seed:purpose:parts``."""
    text = F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[p.cast("string") for p in parts])
    return hex_number(F.md5(text), 1, DIGITS)


def draw_fraction(seed: int, purpose: str, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[p.cast("string") for p in parts])
    return hex_number(F.md5(text), 1, 8) / F.lit(float(2**32))


def _classes(df: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Minority class, majority class, counts."""
    counts = class_counts(df, "y")
    if len(counts) < 2:
        raise ValueError("Resampling needs both classes.")
    minority = min(counts, key=lambda c: (counts[c], -c))
    return minority, next(c for c in counts if c != minority), counts


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", "y", "features")


def _draws(df: DataFrame, n: int, ranks: int, seed: int, purpose: str) -> DataFrame:
    """``n`` draws with replacement from ranks 1 … ``ranks``."""
    draws = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw")
    return draws.withColumn("rank", draw_number(seed, purpose, F.col("draw")) % ranks + 1)


def random_oversample(df: DataFrame, seed: int = 42) -> DataFrame:
    """RS2: minority rows drawn with replacement up to the majority count."""
    minority, majority, counts = _classes(df)
    need = counts[majority] - counts[minority]
    ranked = class_ranks(_rows(df).where(F.col("y") == minority), "id", "y", seed)
    copies = _draws(df, need, counts[minority], seed, "ros").join(ranked, "rank")
    return _rows(df).unionByName(copies.select((-F.col("draw")).alias("id"), "y", "features"))


def random_undersample(df: DataFrame, seed: int = 42) -> DataFrame:
    """RS8: every class to the minority count."""
    minority, _, counts = _classes(df)
    quotas = {c: [(1, counts[minority])] for c in counts}
    return _rows(assign_segments(df, "id", "y", quotas, seed))


def minority_neighbours(seeds: DataFrame, pool: DataFrame, k: int = SMOTE_K, method: str = "exact") -> DataFrame:
    """Seeds with ``neighbours``: the vectors of their k nearest rows of ``pool``, nearest first."""
    found = knn_join(seeds, pool, k, method=method)
    vectors = pool.select(F.col("id").alias("neighbour_id"), F.col("features").alias("vector"))
    listed = (
        found.join(vectors, "neighbour_id")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("ranked"))  # k entries
        .select("id", F.col("ranked.vector").alias("neighbours"))
    )
    return seeds.join(listed, "id")


def interpolate(neighbour: Column, u: Column) -> Column:
    """RS3: a point between a seed and one of its neighbours."""
    return F.zip_with("features", neighbour, lambda x, n: x + u * (n - x))


def _between(rows: DataFrame, seed: int, purpose: str, *parts: Column) -> Column:
    pick = draw_number(seed, f"{purpose}-n", *parts) % F.size("neighbours")
    return interpolate(F.get("neighbours", pick.cast("int")), draw_fraction(seed, f"{purpose}-u", *parts))


def _synthesise(
    df: DataFrame, seeds: DataFrame, pool: DataFrame, n: int, k: int, seed: int, purpose: str, first: int = 0,
    method: str = "exact",
) -> DataFrame:
    """``n`` synthetic rows from uniformly drawn seeds; ids −first−1, −first−2, …"""
    n_seeds = seeds.count()
    if n_seeds == 0 or n == 0:
        return _rows(df).limit(0)
    ranked = class_ranks(minority_neighbours(seeds, pool, k, method), "id", "y", seed)
    drawn = _draws(df, n, n_seeds, seed, purpose).join(ranked.drop("id"), "rank")
    point = _between(drawn, seed, purpose, F.col("draw"))
    return drawn.select((-F.col("draw") - first).alias("id"), "y", point.alias("features"))


def _minority(df: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """Minority rows, their number, and how many rows are missing to the majority."""
    minority, majority, counts = _classes(df)
    if counts[minority] <= k:
        raise ValueError(f"{counts[minority]} minority rows are too few for {k} neighbours.")
    return _rows(df).where(F.col("y") == minority), counts[minority], counts[majority] - counts[minority]


def smote(df: DataFrame, seed: int = 42, k: int = SMOTE_K, method: str = "exact") -> DataFrame:
    """RS3: minority up to the majority count."""
    small, _, need = _minority(df, k)
    return _rows(df).unionByName(_synthesise(df, small, small, need, k, seed, "smote", method=method))


def majority_share(df: DataFrame, k: int, method: str = "exact") -> DataFrame:
    """(id, share) of majority rows among the k nearest rows of each minority row."""
    minority, _, _ = _classes(df)
    found = knn_join(_rows(df).where(F.col("y") == minority), _rows(df), k, method=method)
    return found.groupBy("id").agg(F.avg((F.col("neighbour_y") != minority).cast("double")).alias("share"))


def borderline_smote(df: DataFrame, seed: int = 42, k: int = SMOTE_K, m: int = BORDER_M, method: str = "exact") -> DataFrame:
    """RS4: seeds are minority rows with at least half, but not all, majority neighbours."""
    small, _, need = _minority(df, k)
    danger = majority_share(df, m, method).where("share >= 0.5 and share < 1").select("id")
    seeds = cut_lineage(small.join(danger, "id", "left_semi"))
    return _rows(df).unionByName(_synthesise(df, seeds, small, need, k, seed, "border", method=method))


def svm_smote(df: DataFrame, seed: int = 42, k: int = SMOTE_K, method: str = "exact") -> DataFrame:
    """RS5: seeds are minority rows on or inside the margin of a linear SVM."""
    small, _, need = _minority(df, k)
    minority, _, _ = _classes(df)
    points = _rows(df).select("id", (F.col("y") == minority).cast("double").alias("label"), array_to_vector("features").alias("v"))
    svm = LinearSVC(featuresCol="v", maxIter=100, regParam=1e-3).fit(points)
    margin = vector_to_array("rawPrediction")[1]
    support = svm.transform(points.where("label = 1")).where(margin <= 1).select("id")
    seeds = cut_lineage(small.join(support, "id", "left_semi"))
    return _rows(df).unionByName(_synthesise(df, seeds, small, need, k, seed, "svm", method=method))


def kmeans_smote(df: DataFrame, seed: int = 42, k: int = SMOTE_K, clusters: int = 8, method: str = "exact") -> DataFrame:
    """RS6: SMOTE inside clusters with more than the overall minority share.

    A cluster's part grows with its sparsity: root mean squared distance between
    its minority rows (from their variances, no pairs), over their number.
    """
    small, _, need = _minority(df, k)
    minority, majority, counts = _classes(df)
    points = _rows(df).withColumn("v", array_to_vector("features"))
    model = KMeans(k=clusters, seed=seed, featuresCol="v", predictionCol="cluster").fit(points)
    placed = cut_lineage(model.transform(points).drop("v"))
    width = len(model.clusterCenters()[0])
    is_small = F.col("y") == minority
    spread = sum(
        (F.var_pop(F.when(is_small, F.get("features", F.lit(i)))) for i in range(width)), F.lit(0.0)
    )
    stats = (
        placed.groupBy("cluster")
        .agg(F.count_if(is_small).alias("n_min"), F.count_if(~is_small).alias("n_maj"), spread.alias("spread"))
        .collect()  # one row per cluster
    )
    limit = (counts[majority] + 1) / (counts[minority] + 1)
    chosen = [r for r in stats if r["n_min"] > k and (r["n_maj"] + 1) / (r["n_min"] + 1) < limit]
    if not chosen:
        raise ValueError("No cluster has enough minority rows.")
    sparsity = {r["cluster"]: math.sqrt(2 * r["spread"] * r["n_min"] / (r["n_min"] - 1)) / r["n_min"] for r in chosen}
    total = sum(sparsity.values()) or 1.0
    share = {c: Fraction(s / total) * need for c, s in sorted(sparsity.items())}
    quota = {c: math.floor(s) for c, s in share.items()}
    for c in sorted(share, key=lambda c: (quota[c] - share[c], c))[: need - sum(quota.values())]:
        quota[c] += 1
    out, first = _rows(df), 0
    for c, n in quota.items():
        inside = placed.where((F.col("cluster") == c) & is_small).select("id", "y", "features")
        out = out.unionByName(_synthesise(df, inside, inside, n, k, seed, f"kmeans{c}", first, method))
        first += n
    return out


def adasyn_quotas(df: DataFrame, k: int = SMOTE_K, method: str = "exact") -> DataFrame:
    """RS7, first part: (id, share, copies) per minority row."""
    _, _, need = _minority(df, k)
    share = cut_lineage(majority_share(df, k, method))
    total = share.agg(F.sum("share")).first()[0]
    if not total:
        raise ValueError("No minority row has a majority neighbour.")
    return share.withColumn("copies", F.rint(F.col("share") / F.lit(total) * need).cast("long"))


def adasyn(df: DataFrame, seed: int = 42, k: int = SMOTE_K, method: str = "exact") -> DataFrame:
    """RS7: more synthetic rows where the majority surrounds; totals about balanced.

    A row with many copies is first cut into chunks that are spread over tasks.
    """
    small, _, _ = _minority(df, k)
    quotas = adasyn_quotas(df, k, method).where("copies > 0")
    seeds = minority_neighbours(small, small, k, method).join(quotas.select("id", "copies"), "id")
    seeds = class_ranks(seeds, "id", "y", seed)
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK))).alias("chunk")
    spread = seeds.select("*", chunk).repartition(F.col("id"), F.col("chunk"))
    last = F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK)
    copies = spread.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, last)).alias("copy"))
    point = _between(copies, seed, "adasyn", F.col("id"), F.col("copy"))
    # the point is made before ``id`` gets its new meaning
    made = copies.select("rank", "copy", "y", point.alias("features"))
    number = F.shiftleft("rank", 32) + F.col("copy")  # distinct per (seed, copy)
    return _rows(df).unionByName(made.select((-number).alias("id"), "y", "features"))


def drop_tomek_links(df: DataFrame, method: str = "exact") -> DataFrame:
    """RS9, second part: both rows of mutual nearest neighbours of different class go.

    One row of each link is not of the largest class. So the nearest rows of those are
    searched, and then only of the rows of the largest class that were found.
    """
    rows = _rows(df)
    counts = class_counts(rows.where("y is not null"), "y")
    largest = max(counts, key=lambda c: (counts[c], c), default=0)

    def nearest_of(asked: DataFrame) -> DataFrame:
        found = knn_join(asked, rows, 1, method=method).join(asked.select("id", "y"), "id")
        return cut_lineage(found.select("id", "y", "neighbour_id", "neighbour_y"))

    others = rows.where(F.col("y") != largest).select("id")
    first = nearest_of(rows.join(others, "id", "left_semi"))
    met = first.select(F.col("neighbour_id").alias("id")).join(first.select("id"), "id", "left_anti")
    nearest = first.unionByName(nearest_of(rows.join(met, "id", "left_semi")))
    back = nearest.select(F.col("id").alias("neighbour_id"), F.col("neighbour_id").alias("id"))
    linked = nearest.where("y <> neighbour_y").join(back, ["id", "neighbour_id"]).select("id")
    return rows.join(linked, "id", "left_anti")


def smote_tomek(df: DataFrame, seed: int = 42, method: str = "exact") -> DataFrame:
    """RS9."""
    return drop_tomek_links(cut_lineage(smote(df, seed, method=method)), method)


def drop_noisy(df: DataFrame, k: int = ENN_K, method: str = "exact") -> DataFrame:
    """RS10, second part: rows whose k neighbours do not all share their class go."""
    rows = _rows(df)
    votes = knn_join(rows, rows, k, method=method).join(rows.select("id", "y"), "id")
    noisy = votes.groupBy("id").agg(F.max((F.col("neighbour_y") != F.col("y")).cast("int")).alias("other"))
    return rows.join(noisy.where("other = 1").select("id"), "id", "left_anti")


def smote_enn(df: DataFrame, seed: int = 42, method: str = "exact") -> DataFrame:
    """RS10."""
    return drop_noisy(cut_lineage(smote(df, seed, method=method)), method=method)


SAMPLERS = {
    "random_oversample": random_oversample,
    "smote": smote,
    "borderline_smote": borderline_smote,
    "svm_smote": svm_smote,
    "kmeans_smote": kmeans_smote,
    "adasyn": adasyn,
    "random_undersample": random_undersample,
    "smote_tomek": smote_tomek,
    "smoteenn": smote_enn,
}
UNSAMPLED = ("baseline", "class_weight")  # RS1


def resample(df: DataFrame, strategy: str, seed: int = 42, method: str = "exact") -> DataFrame:
    """RS1-RS11: the frame after ``strategy``; ``method`` is that of the neighbour join."""
    if strategy in UNSAMPLED:
        return _rows(df)
    if strategy not in SAMPLERS:
        raise ValueError(f"Unknown sampling strategy: {strategy}")
    if strategy in ("random_oversample", "random_undersample"):
        return SAMPLERS[strategy](df, seed)
    return SAMPLERS[strategy](df, seed, method=method)


def resampling_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """RS12: rows per class before and after."""
    count = lambda df, name: df.groupBy("y").agg(F.count(F.lit(1)).alias(name))
    both = count(before, "before_count").join(count(after, "after_count"), "y", "full")
    return both.select("y", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before_count", "after_count")])
