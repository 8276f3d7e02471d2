"""Times headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8);
BENCH_GRID=1 adds the 25-cell benchmark grid.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import data_queries, learning_queries, scoring_queries
from catalog.flow_queries import packets
from catalog.flow_sql import FIXTURE
from netlens.operators import knn, labels, metrics, prep, profile, resample, sampling
from netlens.operators.features import flow_records
from netlens.operators.flows import assign_flows
from netlens.plans import grid

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("netlens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def line_rows(s: SparkSession) -> DataFrame:
    """Line items as a labelled table with a row id."""
    rows = s.read.parquet(f"{SF_DIR}/lineitem.parquet")
    place = F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias("id")
    return rows.select(place, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag")


def load_label_sample(s: SparkSession) -> None:
    """Label, sample to 5,000 rows, profile."""
    y = labels.binarise(line_rows(s), "l_returnflag", "R").data.drop("l_returnflag")
    run(profile.profile(sampling.stratified_sample(y, "id", max_rows=5000), exclude=["id"]))


def fit_prep(s: SparkSession) -> None:
    df = line_rows(s)
    p = prep.fit_preprocessor(df, scale=True, exclude=["id"])
    run(p.transform(df, ["id"], vector=False))


def threshold(s: SparkSession) -> None:
    y = (F.col("l_returnflag") == "R").cast("int").alias("y")
    scores = line_rows(s).select(y, (F.col("l_extendedprice") / 110_000).alias("score"))
    curve = metrics.score_curve(scores)
    best = metrics.best_threshold(metrics.pr_curve(curve)).first()
    run(metrics.evaluate_curve(curve, best["threshold"]))


def grid_cell(s: SparkSession) -> None:
    cfg = grid.GridConfig(["logistic_regression"], ["smote"])
    data = sampling.stratified_sample(scoring_queries.flow_dataset(s, SF_DIR), "id", max_rows=5000)
    run(grid.run_cells(s, "flows", data, cfg).results)


def grid_25(s: SparkSession) -> None:
    cfg = grid.GridConfig(
        ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "knn"],
        ["baseline", "smote", "adasyn", "smote_tomek", "random_undersample"],
        parallel_cells=int(CPUS),
    )
    data = sampling.stratified_sample(scoring_queries.flow_dataset(s, SF_DIR), "id", max_rows=5000)
    done = grid.run_cells(s, "flows", data, cfg)
    grid.evaluate_best(done, cfg)


def main() -> None:
    s = session()
    run(s.read.parquet(f"{SF_DIR}/region.parquet"))  # start-up is not measured
    vectors = lambda: learning_queries.vectors(s, SF_DIR)
    cases = {
        "flow_assembly": lambda: run(assign_flows(packets(s, SF_DIR), FIXTURE)),
        "flow_records_82": lambda: run(flow_records(packets(s, SF_DIR), FIXTURE)),
        "load_label_sample_5000": lambda: load_label_sample(s),
        "split": lambda: run(data_queries.QUERIES["dl12_split"](s, SF_DIR)),
        "fit_and_apply_preprocessor": lambda: fit_prep(s),
        "threshold_and_metrics": lambda: threshold(s),
        "knn_join": lambda: run(knn.knn_join(vectors(), vectors(), 5)),
        "smote": lambda: run(resample.smote(vectors())),
        "smote_enn": lambda: run(resample.smote_enn(vectors())),
        "alerts": lambda: run(scoring_queries.QUERIES["st12_grouped_alerts"](s, SF_DIR)),
        "rank_results": lambda: run(data_queries.QUERIES["bg02_rank"](s, SF_DIR)),
        "grid_cell_logistic_smote": lambda: grid_cell(s),
    }
    if os.environ.get("BENCH_GRID") == "1":
        cases["grid_25_cells_and_best"] = lambda: grid_25(s)
    took = {}
    for name, case in cases.items():
        start = time.perf_counter()
        case()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main()
