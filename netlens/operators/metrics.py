"""Ranking and threshold metrics from (y, score) tables (SC2, SC4-SC16).

Everything starts from one row per distinct score. Running totals over scores
are taken per score range with range offsets, so no ordering runs in one task
once there are many distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.functions.lineage import cut_lineage
from netlens.functions.numbers import ratio

ONE_TASK_ROWS = 500_000
RANGES = 256


def running_totals(df: DataFrame, order: str, columns: Sequence[str], few: bool) -> DataFrame:
    """Adds ``<column>_upto``: sum over rows with ``order`` at or above, for unique ``order`` values.

    ``few``: the table is known to be small enough for one task.
    """
    spec = Window.orderBy(F.desc(order))
    if few:
        return df.withColumns({f"{c}_upto": F.sum(c).over(spec) for c in columns})
    inner = sorted(set(df.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    splits = [float("-inf"), *inner, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=order, outputCol="_range").transform(df)
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        .select("_range", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in columns])
    )  # one row per range
    inside = Window.partitionBy("_range").orderBy(F.desc(order))
    out = ranged.join(F.broadcast(offsets), "_range")
    out = out.withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"_{c}") for c in columns})
    return out.drop("_range", *[f"_{c}" for c in columns])


def score_curve(scores: DataFrame, y: str = "y", score: str = "score", one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Per distinct score: its rows by class, and true / false positives at that threshold."""
    per_score = cut_lineage(
        scores.groupBy(F.col(score).cast("double").alias("threshold")).agg(
            F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
        )
    )
    n, n_pos, n_neg = per_score.agg(F.count(F.lit(1)), F.sum("pos"), F.sum("neg")).first()
    curve = running_totals(per_score, "threshold", ["pos", "neg"], n <= one_task_rows)
    totals = {"n_pos": F.lit(n_pos or 0), "n_neg": F.lit(n_neg or 0)}
    return curve.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp"}).withColumns(totals)


def pr_curve(curve: DataFrame) -> DataFrame:
    """SC4: precision, recall and F1 per threshold, and the closing point (1, 0) at 1.0."""
    recall = F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("n_pos"))
    points = curve.select(
        "threshold",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        recall.alias("recall"),
        F.lit(0).alias("closing"),
    )
    end = curve.sparkSession.createDataFrame(
        [(1.0, 1.0, 0.0, 1)], "threshold double, precision double, recall double, closing int"
    )
    p, r = F.col("precision"), F.col("recall")
    return points.unionByName(end).withColumn("f1", ratio(2 * p * r, p + r))


def best_threshold(points: DataFrame, strategy: str = "f1", recall_target: float = 0.9) -> DataFrame:
    """SC5-SC7: one row (threshold, precision, recall, f1).

    ``f1``: best F1. ``recall_priority``: best precision among points that reach
    the recall target, or best recall if none does. The lowest threshold wins ties.
    """
    if strategy == "recall_priority":
        valid = F.col("recall") >= recall_target
        order = [F.desc(valid), F.desc(F.when(valid, F.col("precision")).otherwise(F.col("recall")))]
    else:
        order = [F.desc("f1")]
    best = points.orderBy(*order, "closing", "threshold").limit(1)
    clipped = F.least(F.greatest(F.col("threshold"), F.lit(0.0)), F.lit(1.0))
    return best.select(clipped.alias("threshold"), "precision", "recall", "f1")


def at_threshold(score: Column, threshold: float | Column) -> Column:
    """SC8."""
    return (score >= threshold).cast("int")


def confusion(scores: DataFrame, threshold: float | Column, y: str = "y", score: str = "score") -> DataFrame:
    """SC9: one row tn, fp, fn, tp."""
    hit = F.col(score) >= threshold
    actual = F.col(y) == 1
    return scores.agg(
        F.count_if(~actual & ~hit).alias("tn"),
        F.count_if(~actual & hit).alias("fp"),
        F.count_if(actual & ~hit).alias("fn"),
        F.count_if(actual & hit).alias("tp"),
    )


def confusion_of_curve(curve: DataFrame, threshold: float) -> DataFrame:
    """SC9 from a score curve, without another look at the scored rows."""
    return curve.agg(*_confusion_sums(threshold))


def _confusion_sums(threshold: float) -> list[Column]:
    hit = F.col("threshold") >= threshold
    sums = {"tn": ("neg", ~hit), "fp": ("neg", hit), "fn": ("pos", ~hit), "tp": ("pos", hit)}
    return [F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).alias(k) for k, (n, c) in sums.items()]


def threshold_metrics(matrix: DataFrame) -> DataFrame:
    """SC10-SC12 from a confusion row."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall0, recall1 = F.try_divide(tn, tn + fp), F.try_divide(tp, tp + fn)
    classes = F.when(recall0.isNull() | recall1.isNull(), 1.0).otherwise(2.0)
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return matrix.select(
        "*",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((F.coalesce(recall0, F.lit(0.0)) + F.coalesce(recall1, F.lit(0.0))) / classes).alias("balanced_accuracy"),
        ratio(tp * tn - fp * fn, margins).alias("mcc"),
    )


def ranking_metrics(curve: DataFrame) -> DataFrame:
    """SC13, SC14: exact ROC AUC (ties half; NULL for one class) and average precision."""
    return curve.agg(*_ranking_sums())


def _ranking_sums() -> list[Column]:
    n_pos, n_neg = F.max("n_pos").cast("double"), F.max("n_neg").cast("double")
    below = F.col("n_neg") - F.col("fp") + F.col("neg") / 2
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return [
        F.try_divide(F.sum(F.col("pos") * below), n_pos * n_neg).alias("roc_auc"),
        ratio(F.sum(F.col("pos") * precision), n_pos).alias("pr_auc"),
    ]


def evaluate_curve(curve: DataFrame, threshold: float) -> DataFrame:
    """One row with the confusion matrix and the eight metrics, from one aggregation."""
    return threshold_metrics(curve.agg(*_confusion_sums(threshold), *_ranking_sums()))


def evaluate(scores: DataFrame, threshold: float) -> DataFrame:
    """``evaluate_curve`` over scored rows."""
    return evaluate_curve(score_curve(scores), threshold)


def roc_points(curve: DataFrame) -> DataFrame:
    """SC16: false and true positive rate per threshold."""
    return curve.select(
        "threshold",
        F.try_divide(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"),
    )


def classification_report(matrix: DataFrame) -> DataFrame:
    """SC15: rows 0, 1, accuracy, macro avg, weighted avg."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def row(label: str, hit: Column, wrong: Column, lost: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + lost).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + lost).alias("f1_score"),
            (hit + lost).cast("long").alias("support"),
        )

    both = matrix.select("*", row("0", tn, fn, fp).alias("c0"), row("1", tp, fp, fn).alias("c1"))
    total = tn + fp + fn + tp
    measures = ("precision", "recall", "f1_score")

    def mean(label: str, w0: Column, w1: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            *[ratio(F.col(f"c0.{m}") * w0 + F.col(f"c1.{m}") * w1, w0 + w1).alias(m) for m in measures],
            total.cast("long").alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("label"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        ratio(tp + tn, total).alias("f1_score"),
        total.cast("long").alias("support"),
    )
    one = F.lit(1.0)
    rows = F.array(
        "c0", "c1", accuracy, mean("macro avg", one, one), mean("weighted avg", tn + fp, tp + fn)
    )
    return both.select(F.explode(rows).alias("r")).select("r.*")


def min_max_scores(scores: DataFrame, raw: str = "raw", bounds: tuple[float, float] | None = None) -> DataFrame:
    """SC2: decision values scaled to [0, 1]; constant values give 0.

    Without stored ``bounds`` the scored set supplies them (two numbers).
    """
    low, high = scores.agg(F.min(raw), F.max(raw)).first() if bounds is None else bounds
    if low is None or high <= low:
        return scores.withColumn("score", F.lit(0.0))
    return scores.withColumn("score", (F.col(raw) - F.lit(float(low))) / F.lit(float(high) - float(low)))
