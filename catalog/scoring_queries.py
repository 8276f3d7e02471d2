"""Queries on scoring, alerts and the benchmark grid."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import prepared, round_sql, rounded, table
from catalog.flow_queries import assigned
from catalog.flow_sql import FIXTURE, flow_ctes
from catalog.learning_queries import vectors
from netlens.functions.lineage import shared_folder
from netlens.operators import alerts, metrics, scoring
from netlens.operators.features import FLOW_COLUMNS, records_of
from netlens.operators.models import Settings, fit_model
from netlens.operators.prep import fit_preprocessor
from netlens.operators.profile import profile
from netlens.operators.sampling import split_dataset
from netlens.plans import grid
from netlens.plans.bundle import Bundle
from netlens.sources.tables import Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def flows(s, d) -> DataFrame:
    """Whole flow records of the events table."""
    return prepared(s, d, "flows", lambda: records_of(assigned(s, d), FIXTURE, keep_start=True))


FLOWS = flow_ctes(FIXTURE) + f""", fr as (select fid start_seq, min(us) start_us, arg_min(src_ip, us) src_ip, arg_min(dst_ip, us) dst_ip,
  cast(arg_min(src_port, us) as bigint) src_port, cast(arg_min(dst_port, us) as bigint) dst_port, arg_min(protocol, us) protocol,
  strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S') as timestamp, (max(us) - min(us)) / 1e6 flow_duration,
  case when max(us) = min(us) then 0 else count(*) / ((max(us) - min(us)) / 1e6) end flow_pkts_s,
  count(*) filter (where fwd) tot_fwd_pkts from ann group by fid),
sc as (select *, least(1.0, flow_pkts_s * 20000) score, case when least(1.0, flow_pkts_s * 20000) >= 0.6 then 1 else 0 end prediction from fr)
"""
LIMIT = 0.6
META = {"model_name": "knn", "sampling_strategy": "adasyn"}
ORDER = ["start_us", "start_seq"]


def scored(s, d) -> DataFrame:
    score = F.least(F.lit(1.0), F.col("flow_pkts_s") * 20000)
    return flows(s, d).withColumn("score", score).withColumn("prediction", metrics.at_threshold(score, LIMIT))


@add("st03_rename", FLOWS + f"""select start_seq, src_ip as "Src IP", protocol as "Protocol", {round_sql('flow_duration', 6)} as "Flow Duration", tot_fwd_pkts as "Total Fwd Packet" from fr""")
def _(s, d):
    picked = flows(s, d).select("start_seq", "SRC_IP", "protocol", "flow_duration", "tot_fwd_pkts")
    return rounded(scoring.rename_columns(picked))


@add("st04_drop_label", "select event_id, value from events")
def _(s, d):
    df = table(s, d, "events").select("event_id", F.col("event_type").alias("LABEL"), "value")
    return scoring.drop_label(df, "label")


@add("st05_align_columns", FLOWS + f"""select cast(protocol as double) as "Protocol", cast(null as double) as "Not There", {round_sql('flow_duration', 6)} as "Flow Duration" from fr""")
def _(s, d):
    return rounded(scoring.prepare_features(flows(s, d), ["Protocol", "Not There", "Flow Duration"]))


_TEXT = """case when event_id % 7 = 0 then 'abc' when event_id % 11 = 0 then 'inf' when event_id % 13 = 0 then '-inf'
 when event_id % 17 = 0 then null else concat(cast(event_id as {t}), '.5') end"""


@add("st06_numeric_coercion", f"select event_id, case when isinf(n) then null else n end as number from (select event_id, try_cast({_TEXT.format(t='varchar')} as double) n from events)")
def _(s, d):
    df = table(s, d, "events").selectExpr("event_id", f"{_TEXT.format(t='string')} as number")
    return scoring.prepare_features(df, ["number"], keep=["event_id"]).withColumnRenamed("keep_event_id", "event_id")


@add("st08_schema_summary", FLOWS + "select count(*) as rows, 2 as matched_count, 3 as expected_count, 'Not There' as missing, 'Dst IP' as extra from fr")
def _(s, d):
    df = flows(s, d).select("protocol", "flow_duration", "dst_ip")
    out = scoring.schema_summary(df, ["Protocol", "Not There", "Flow Duration"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing", "extra")})


_PORTS = "array_to_string(list_sort(list(distinct cast({p} as varchar))), ',')"
_FIRST = "array_to_string(list_sort(list(distinct cast({p} as varchar)))[1:{n}], ',')"


@add("st11_attack_groups", FLOWS + f"""select src_ip, dst_ip, protocol, count(*) as flow_count, {round_sql('max(score)', 9)} as max_score, {_PORTS.format(p='src_port')} as src_ports,
 {_PORTS.format(p='dst_port')} as dst_ports, arg_min(timestamp, start_us) as flow_timestamp from sc where prediction = 1 group by src_ip, dst_ip, protocol""")
def _(s, d):
    out = alerts.attack_groups(scored(s, d), ORDER).drop("first_seen")
    return rounded(out.withColumns({c: F.array_join(c, ",") for c in ("src_ports", "dst_ports")}), 9)


@add("st12_grouped_alerts", FLOWS + f"""select arg_min(timestamp, start_us) as flow_timestamp, 1 as prediction, {round_sql('max(score)', 9)} as score, {round_sql('0.6::double', 9)} as threshold, src_ip,
 {_FIRST.format(p='src_port', n=8)} as src_port, dst_ip, {_FIRST.format(p='dst_port', n=12)} as dst_port, protocol, 'knn' as model_name, 'adasyn' as sampling_strategy,
 count(*) as flow_count, {_FIRST.format(p='src_port', n=8)} as unique_src_ports, {_FIRST.format(p='dst_port', n=12)} as unique_dst_ports, {round_sql('max(score)', 9)} as max_score
 from sc where prediction = 1 group by src_ip, dst_ip, protocol""")
def _(s, d):
    return rounded(alerts.grouped_alerts(scored(s, d), ORDER, LIMIT, META).drop("logged_at"), 9)


@add("st13_flow_alerts", FLOWS + f"""select timestamp as flow_timestamp, prediction, {round_sql('score', 9)} as score, {round_sql('0.6::double', 9)} as threshold, src_ip, cast(src_port as varchar) as src_port, dst_ip,
 cast(dst_port as varchar) as dst_port, protocol, 'knn' as model_name, 'adasyn' as sampling_strategy, cast(1 as bigint) as flow_count, cast(src_port as varchar) as unique_src_ports,
 cast(dst_port as varchar) as unique_dst_ports, {round_sql('score', 9)} as max_score from sc""")
def _(s, d):
    return rounded(alerts.flow_alerts(scored(s, d), LIMIT, META, log_all=True).drop("logged_at"), 9)


@add("st14_benign_count", FLOWS + "select count(*) as benign_flows from sc where prediction = 0")
def _(s, d):
    return alerts.benign_count(scored(s, d))


# ---- trained models -------------------------------------------------------

#: Every number of the record but the flag that gives the label.
FEATURES = [c for c in FLOW_COLUMNS if c not in ("src_ip", "dst_ip", "timestamp", "rst_flag_cnt")]


def flow_dataset(s, d) -> DataFrame:
    """Flows labelled by a flag that is not among the features."""
    return flows(s, d).select(
        F.col("start_seq").alias("id"), (F.col("rst_flag_cnt") > 0).cast("int").alias("y"), *FEATURES
    )


@add("st09_score_flows")
def _(s, d):
    data = flow_dataset(s, d)
    prep = fit_preprocessor(data, scale=True, exclude=["id", "y"])
    fitted = fit_model("logistic_regression", "class_weight", prep.transform(data, ["id", "y"], vector=False), Settings())
    out = scoring.score_flows(flows(s, d), Bundle(fitted, prep, 0.5, {"feature_columns": FEATURES}))
    return out.select("start_seq", "src_ip", "dst_ip", "score", "prediction")


#: The models and strategies of the published grid.
CFG = grid.GridConfig(
    ["logistic_regression", "random_forest", "gradient_boosting", "knn", "decision_tree"],
    ["baseline", "random_undersample", "smote", "adasyn", "smote_tomek"],
)


_runs: dict[tuple, grid.DatasetRun] = {}


def grid_run(s, d) -> grid.DatasetRun:
    """The whole grid, run once per session and read by two queries."""
    key = (s.sparkContext.applicationId, d)
    if key not in _runs:
        _runs[key] = grid.run_cells(s, "flows", flow_dataset(s, d), CFG)
    return _runs[key]


@add("bg01_grid")
def _(s, d):
    return grid_run(s, d).results.drop("fit_seconds", "validation_seconds")


@add("bg09_best_on_test")
def _(s, d):
    summary, bundle, scores, report = grid.evaluate_best(grid_run(s, d), CFG)
    return report


@add("sc17_cross_validation")
def _(s, d):
    frames = grid.Frames(split_dataset(flow_dataset(s, d), "id", "y"), CFG)
    cv = grid.cross_validate(frames, "logistic_regression", "smote", CFG)
    return s.createDataFrame(sorted(cv.items()), "metric string, value double")


@add("sc20_feature_importance")
def _(s, d):
    data = flow_dataset(s, d)
    prep = fit_preprocessor(data, scale=False, exclude=["id", "y"])
    fitted = fit_model("random_forest", "baseline", prep.transform(data, ["id", "y"], vector=False), Settings())
    return grid.top_features(s, Bundle(fitted, prep))


@add("sc01_probability_score")
def _(s, d):
    data = flow_dataset(s, d)
    prep = fit_preprocessor(data, scale=False, exclude=["id", "y"])
    frame = prep.transform(data, ["id", "y"], vector=False)
    return fit_model("decision_tree", "baseline", frame, Settings()).score(frame).select("id", "y", "score")


@add("sc18_fit_and_evaluate")
def _(s, d):
    frames = grid.Frames(split_dataset(flow_dataset(s, d), "id", "y"), CFG)
    c = grid.fit_candidate(frames, "decision_tree", "random_undersample", CFG)
    values = {"threshold": c.threshold, **{m: c.metrics[m] for m in grid.VAL_METRICS}}
    return s.createDataFrame(sorted(values.items()), "metric string, value double")


@add("md15_full_refit")
def _(s, d):
    data = flow_dataset(s, d)
    mapping = data.select(F.col("y").cast("string").alias("label"), "y").distinct()
    ds = Dataset("flows", data, mapping, profile(data, "y", exclude=["id"]), [])
    best = {"model_name": "logistic_regression", "sampling_strategy": "random_oversample", "threshold": 0.5}
    bundle = grid.refit_full(s, ds, best, f"{shared_folder(s)}/refit-{uuid.uuid4().hex}")
    return scoring.score_flows(data, bundle).select("id", "score", "prediction")
