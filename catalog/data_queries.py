"""Queries on labels, sampling, preprocessing, metrics and result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog.common import prepared, round_sql, rounded, table
from netlens.operators import labels, metrics, prep, profile, sampling
from netlens.plans import tables as bg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = 42


def add(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rank_sql(id_col: str, cls: str = "y", seed: int = SEED) -> str:
    return f"row_number() over (partition by {cls} order by md5(concat('{seed}:', cast({id_col} as varchar))), {id_col})"


# ---- labels ---------------------------------------------------------------


def event_labels(s, d) -> DataFrame:
    lbl = (
        F.when(F.col("event_id") % 19 == 0, None)
        .when(F.col("event_type") == "view", "Normal")
        .when(F.col("event_type") == "click", "\tBENIGN \r")
        .when(F.col("event_type") == "purchase", "safe")
        .otherwise(F.col("event_type"))
    )
    return table(s, d, "events").select("event_id", lbl.alias("lbl"), "value")


EVENT_LABELS = """(select event_id, case when event_id % 19 = 0 then null when event_type = 'view' then 'Normal'
  when event_type = 'click' then chr(9) || 'BENIGN ' || chr(13) when event_type = 'purchase' then 'safe' else event_type end lbl, value
  from events)"""


@add("dl01_binary_numeric_label", "select doc_id, case when toxic = (select max(toxic) from labels) then 1 else 0 end y from labels")
def _(s, d):
    return labels.binarise(table(s, d, "labels").select("doc_id", "toxic"), "toxic").data.select("doc_id", "y")


@add("dl02_zero_against_rest", "select vec_id, case when label is null or label <> 0 then 1 else 0 end y from embeddings")
def _(s, d):
    df = table(s, d, "embeddings").select("vec_id", "label")
    return labels.binarise(df, "label", positive_class=3).data.select("vec_id", "y")


@add("dl03_largest_against_rest", "select vec_id, case when label + 1 = (select max(label + 1) from embeddings) then 1 else 0 end y from embeddings")
def _(s, d):
    df = table(s, d, "embeddings").select("vec_id", (F.col("label") + 1).alias("label"))
    return labels.binarise(df, "label").data.select("vec_id", "y")


@add("dl04_text_positive_class", f"select event_id, case when regexp_replace(lbl, '^\\s+|\\s+$', '', 'g') = 'error' then 1 else 0 end y from {EVENT_LABELS}")
def _(s, d):
    return labels.binarise(event_labels(s, d), "lbl", "error").data.select("event_id", "y")


_TOKENS = "('0', 'benign', 'normal', 'normality', 'legitimate', 'safe')"


@add("dl05_text_token_rule", f"select event_id, case when lower(regexp_replace(coalesce(lbl, 'nan'), '^\\s+|\\s+$', '', 'g')) in {_TOKENS} then 0 else 1 end y from {EVENT_LABELS}")
def _(s, d):
    return labels.binarise(event_labels(s, d), "lbl").data.select("event_id", "y")


@add("dl06_label_map", f"select distinct regexp_replace(coalesce(lbl, 'nan'), '^\\s+|\\s+$', '', 'g') as label, case when lower(regexp_replace(coalesce(lbl, 'nan'), '^\\s+|\\s+$', '', 'g')) in {_TOKENS} then 0 else 1 end y from {EVENT_LABELS}")
def _(s, d):
    return labels.binarise(event_labels(s, d), "lbl").mapping


@add("dl07_drop_columns", "select event_id, user_id, event_type, value from events")
def _(s, d):
    return profile.drop_present(table(s, d, "events"), ["props", "Flow ID", "ts"])[0]


# ---- sampling and splits --------------------------------------------------


def binary_events(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y"), "value")


BINARY = "(select event_id, case when event_type = 'error' then 1 else 0 end y, value from events)"


_COUNTS = f"(select y, count(*) n from {BINARY} group by y)"


def quota_ctes(size: str, counts: str = _COUNTS, prefix: str = "") -> str:
    """Largest-remainder quotas of ``size`` rows; equal remainders go to class 1."""
    p = prefix
    return f"""
{p}c as (select y, n from {counts}),
{p}t as (select cast(sum(n) as bigint) total, cast({size} as bigint) size from {p}c),
{p}f as (select y, n, (n * size) // total fl, (n * size) % total rem, size from {p}c, {p}t),
{p}q as (select y, n, fl + case when row_number() over (order by rem desc, y desc) <=
    size - cast((select sum(fl) from {p}f) as bigint) then 1 else 0 end k from {p}f)"""


@add("dl08_stratified_sample_fraction", f"with {quota_ctes('greatest(1, floor(sum(n) * 0.3))')}, r as (select *, {rank_sql('event_id')} rk from {BINARY}) select event_id, r.y from r join q on r.y = q.y where rk <= k")
def _(s, d):
    return sampling.stratified_sample(binary_events(s, d), "event_id", sample_frac=0.3).select("event_id", "y")


@add("dl08_stratified_sample_rows", f"with {quota_ctes('least(777, sum(n))')}, r as (select *, {rank_sql('event_id')} rk from {BINARY}) select event_id, r.y from r join q on r.y = q.y where rk <= k")
def _(s, d):
    return sampling.stratified_sample(binary_events(s, d), "event_id", max_rows=777).select("event_id", "y")


SPLIT = f"""with {quota_ctes('sum(n) - ceil(sum(n) * 0.2)')},
{quota_ctes('sum(n) - ceil(sum(n) * (0.2 / (1.0 - 0.2)))', '(select y, k n from q)', 'b')},
r as (select *, {rank_sql('event_id')} rk from {BINARY}),
sp as (select event_id, r.y, case when rk <= bq.k then 'train' when rk <= q.k then 'validation' else 'test' end split
  from r join q on r.y = q.y join bq on r.y = bq.y)
"""


#: Fixed value: the text of the error row.
SINGLE = "One or more splits contain a single class only."
RARE = "(select event_id, (event_id = (select min(event_id) from events))::int y from events)"


@add("dl13_no_error", SPLIT + f"select 'events' as dataset_name, 'split' as stage, {SINGLE!r} as error "
     "from (select count(distinct y) classes from sp group by split) having min(classes) < 2")  # fmt: skip
def _(s, d):
    split = sampling.split_dataset(binary_events(s, d), "event_id")
    return sampling.single_class_splits(split, "events")


@add("dl12_split", SPLIT + "select event_id, y, split from sp")
def _(s, d):
    return sampling.split_dataset(binary_events(s, d), "event_id").select("event_id", "y", "split")


@add(
    "dl13_single_class_check",
    SPLIT.replace(BINARY, RARE) + f"select 'rare' as dataset_name, 'split' as stage, {SINGLE!r} as error "
    "from (select count(distinct y) classes from sp group by split) having min(classes) < 2",
)
def _(s, d):
    # one single positive row cannot reach all three splits
    first = table(s, d, "events").agg(F.min("event_id")).first()[0]
    rare = table(s, d, "events").select("event_id", (F.col("event_id") == first).cast("int").alias("y"))
    return sampling.single_class_splits(sampling.split_dataset(rare, "event_id"), "rare")


@add(
    "dl14_folds",
    f"""with r as (select *, {rank_sql('event_id')} rk, count(*) over (partition by y) n from {BINARY}),
a as (select y, n, coalesce(lag(n) over (order by y), 0) a0 from (select distinct y, n from r)),
z as (select y, f, n // 3 + case when ((f - a0) % 3 + 3) % 3 < n % 3 then 1 else 0 end size from a, range(3) g(f)),
e as (select y, f, sum(size) over (partition by y order by f) upto, size from z)
select event_id, r.y, cast(f as int) as fold from r join e on r.y = e.y and rk <= upto and rk > upto - size""",
)
def _(s, d):
    return sampling.stratified_folds(binary_events(s, d), "event_id", 3).select("event_id", "y", "fold")


# ---- profile --------------------------------------------------------------


def mixed_orders(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        "o_orderkey",
        F.when(k % 17 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 29 != 0, F.col("o_custkey")).alias("cust"),
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") > 400000).cast("int").alias("y"),
    )


MIXED = """(select o_orderkey, case when o_orderkey % 17 <> 0 then o_totalprice end price,
  case when o_orderkey % 29 <> 0 then o_custkey end cust, case when o_orderkey % 13 <> 0 then o_orderpriority end priority,
  o_orderstatus status, case when o_totalprice > 400000 then 1 else 0 end y from orders)"""
_SEVERITY = "case when {r} <= 0.01 then 'extreme' when {r} <= 0.05 then 'severe' when {r} <= 0.20 then 'moderate' else 'mild' end"


@add(
    "dl10_profile",
    f"""with c as (select count(*) n, count(*) filter (where y = 1) p, count(*) filter (where y = 0) q,
  cast(sum((price is null)::int + (cust is null)::int + (priority is null)::int + (status is null)::int) as bigint) m from {MIXED}),
 r as (select *, case when p = 0 or q = 0 then greatest(p, q) else least(p, q) end / greatest(p, q, 1) ratio from c)
select n as rows, 4 as columns, q as class_0, p as class_1, {round_sql('ratio', 9)} as imbalance_ratio_minority_to_majority,
 {_SEVERITY.format(r='ratio')} as imbalance_severity, m as missing_values_total, cast(0 as bigint) as infinite_values_total,
 'price,cust' as numeric_columns, 'priority,status' as categorical_columns from r""",
)
def _(s, d):
    out = profile.profile(mixed_orders(s, d), "y", exclude=["o_orderkey"])
    return rounded(
        out.withColumns({c: F.array_join(c, ",") for c in ("numeric_columns", "categorical_columns")}), 9
    )


@add(
    "dl11_severity",
    f"select event_type, {_SEVERITY.format(r='r')} as severity from (select event_type, count(*) / (select count(*) from events) r from events group by event_type)",
)
def _(s, d):
    ev = table(s, d, "events")
    share = F.count("*") / F.lit(ev.count())
    return ev.groupBy("event_type").agg(profile.severity(share).alias("severity"))


# ---- preprocessing --------------------------------------------------------


def fitted(s, d, scale: bool) -> tuple[DataFrame, prep.Preprocessor]:
    df = mixed_orders(s, d)
    return df, prep.fit_preprocessor(df, scale=scale, exclude=["o_orderkey", "y"])


_MED = f"(select median(price) mp, median(cust) mc from {MIXED})"
_IMPUTED = f"(select o_orderkey, coalesce(price, mp) price, coalesce(cust, mc) cust from {MIXED}, {_MED})"


@add("pp01_median_imputation", f"select o_orderkey, {round_sql('price', 6)} as price, {round_sql('cast(cust as double)', 6)} as cust from {_IMPUTED}")
def _(s, d):
    df, p = fitted(s, d, False)
    return rounded(df.select("o_orderkey", *[p.imputed(c).alias(c) for c in p.numeric]))


@add(
    "pp02_standard_scaling",
    f"""with i as {_IMPUTED}, m as (select avg(price) ap, stddev_pop(price) sp, avg(cust) ac, stddev_pop(cust) sc from i)
select o_orderkey, {round_sql('(price - ap) / sp', 6)} as price, {round_sql('(cust - ac) / sc', 6)} as cust from i, m""",
)
def _(s, d):
    df, p = fitted(s, d, True)
    cols = [c.alias(n) for c, n in zip(p.columns(), p.numeric, strict=False)]
    return rounded(df.select("o_orderkey", *cols))


_MODE = "(select {c} from " + MIXED + " where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@add("pp03_most_frequent_imputation", f"select o_orderkey, coalesce(priority, {_MODE.format(c='priority')}) as priority, status from {MIXED}")
def _(s, d):
    df, p = fitted(s, d, False)
    return df.select("o_orderkey", *[p.imputed(c).alias(c) for c in p.categorical])


@add(
    "pp04_one_hot",
    f"""with i as (select o_orderkey, coalesce(priority, {_MODE.format(c='priority')}) priority, status from {MIXED}),
v as (select 'priority' c, priority v from (select distinct priority from i) union all select 'status', status from (select distinct status from i))
select o_orderkey, concat(c, '_', v) as feature, case when (c = 'priority' and v = priority) or (c = 'status' and v = status) then 1.0::double else 0.0::double end as value from i, v""",
)
def _(s, d):
    df, p = fitted(s, d, False)
    hot = list(zip(p.feature_names, p.columns(), strict=True))[len(p.numeric) :]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in hot])
    return df.select("o_orderkey", F.explode(cells).alias("cell")).select("o_orderkey", "cell.*")


@add(
    "pp05_assembled_features",
    f"""with i as {_IMPUTED}, m as (select avg(price) ap, stddev_pop(price) sp, avg(cust) ac, stddev_pop(cust) sc from i),
k as (select o_orderkey, coalesce(priority, {_MODE.format(c='priority')}) priority, status from {MIXED}),
s as (select (select count(distinct priority) from k) np, (select count(distinct status) from k) ns)
select i.o_orderkey, {round_sql('(price - ap) / sp', 6)} as first_value, {round_sql('(cust - ac) / sc', 6)} as second_value,
 cast(2 + np + ns as int) as width, 2.0::double as hot from i, m, s, k where i.o_orderkey = k.o_orderkey""",
)
def _(s, d):
    df, p = fitted(s, d, True)
    x = F.col("features")
    hot = F.aggregate(F.slice(x, F.lit(len(p.numeric) + 1), F.size(x)), F.lit(0.0), lambda a, b: a + b)
    wide = p.transform(df, ["o_orderkey"], vector=False)
    return rounded(
        wide.select("o_orderkey", x[0].alias("first_value"), x[1].alias("second_value"), F.size(x).alias("width"), hot.alias("hot"))
    )


# ---- scores ---------------------------------------------------------------


def event_scores(s, d) -> DataFrame:
    return table(s, d, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        (F.floor(F.col("value") / 5) / 100).alias("score"),
    )


SCORES = "(select event_id row_id, case when event_type = 'error' then 1 else 0 end y, floor(value / 5) / 100 score from events)"
CURVE = f"""with s as {SCORES}, g as (select score threshold, count(*) filter (where y = 1) pos, count(*) filter (where y = 0) neg from s group by score),
cv as (select *, cast(sum(pos) over (order by threshold desc) as bigint) tp, cast(sum(neg) over (order by threshold desc) as bigint) fp,
  cast(sum(pos) over () as bigint) n_pos, cast(sum(neg) over () as bigint) n_neg from g),
pr as (select threshold, tp / (tp + fp) "precision", tp / n_pos recall, 0 closing from cv union all select 1.0, 1.0, 0.0, 1),
pf as (select *, case when "precision" + recall = 0 then 0 else 2 * "precision" * recall / ("precision" + recall) end f1 from pr)
"""
_T = 0.25
CONFUSION = f"""with s as {SCORES}, m as (select count(*) filter (where y = 0 and score < {_T}) tn, count(*) filter (where y = 0 and score >= {_T}) fp,
 count(*) filter (where y = 1 and score < {_T}) fn, count(*) filter (where y = 1 and score >= {_T}) tp from s)
"""


def curve(s, d) -> DataFrame:
    return metrics.score_curve(event_scores(s, d))


@add("sc02_min_max_score", f"select event_id as row_id, {round_sql('(value - lo) / (hi - lo)', 9)} as score from events, (select min(value) lo, max(value) hi from events)")
def _(s, d):
    raw = table(s, d, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("raw"))
    return rounded(metrics.min_max_scores(raw).select("row_id", "score"), 9)


@add("sc04_precision_recall_curve", CURVE + f"select threshold, {round_sql('\"precision\"', 9)} as precision, {round_sql('recall', 9)} as recall, closing from pf")
def _(s, d):
    return rounded(metrics.pr_curve(curve(s, d)).drop("f1"), 9)


_PICK = f"""select least(greatest(threshold, 0.0), 1.0) as threshold, {round_sql('"precision"', 9)} as precision,
 {round_sql('recall', 9)} as recall, {round_sql('f1', 9)} as f1 from pf """


@add("sc05_threshold_f1", CURVE + _PICK + "order by pf.f1 desc, closing, pf.threshold limit 1")
def _(s, d):
    return rounded(metrics.best_threshold(metrics.pr_curve(curve(s, d)), "f1"), 9)


@add("sc06_threshold_recall_priority", CURVE + _PICK + "where pf.recall >= 0.8 order by pf.precision desc, closing, pf.threshold limit 1")
def _(s, d):
    return rounded(metrics.best_threshold(metrics.pr_curve(curve(s, d)), "recall_priority", 0.8), 9)


@add("sc07_threshold_diagnostics", CURVE + _PICK + "where pf.recall >= 0.5 order by pf.precision desc, closing, pf.threshold limit 1")
def _(s, d):
    return rounded(metrics.best_threshold(metrics.pr_curve(curve(s, d)), "recall_priority", 0.5), 9)


@add("sc08_predict", f"select row_id, case when score >= {_T} then 1 else 0 end as prediction from {SCORES}")
def _(s, d):
    return event_scores(s, d).select("row_id", metrics.at_threshold(F.col("score"), _T).alias("prediction"))


@add("sc09_confusion", CONFUSION + "select tn, fp, fn, tp from m")
def _(s, d):
    return metrics.confusion(event_scores(s, d), _T)


def _from_confusion(name: str, cols: dict[str, str]):
    items = ", ".join(f"{round_sql(sql, 9)} as {c}" for c, sql in cols.items())

    @add(name, CONFUSION + f"select {items} from m")
    def _(s, d):
        m = metrics.threshold_metrics(metrics.confusion(event_scores(s, d), _T))
        return rounded(m.select(*cols), 9)


_from_confusion(
    "sc10_accuracy_precision_recall_f1",
    {
        "accuracy": "(tp + tn) / (tp + tn + fp + fn)",
        "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
        "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
        "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    },
)
_from_confusion("sc11_balanced_accuracy", {"balanced_accuracy": "(tn / (tn + fp) + tp / (tp + fn)) / 2"})
_from_confusion(
    "sc12_matthews",
    {"mcc": "(tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn))"},
)


@add("sc13_roc_auc", CURVE + f"select {round_sql('sum(pos * (n_neg - fp + neg / 2.0)) / max(n_pos * n_neg)', 9)} as roc_auc from cv")
def _(s, d):
    return rounded(metrics.ranking_metrics(curve(s, d)).select("roc_auc"), 9)


@add("sc14_average_precision", CURVE + f"select {round_sql('sum(pos * (tp / (tp + fp))) / max(n_pos)', 9)} as pr_auc from cv")
def _(s, d):
    return rounded(metrics.ranking_metrics(curve(s, d)).select("pr_auc"), 9)


_REPORT = f"""{CONFUSION}, c as (
 select '0' as label, coalesce(tn / nullif(tn + fn, 0), 0) p, coalesce(tn / nullif(tn + fp, 0), 0) r, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) f, tn + fp n from m union all
 select '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn from m),
a as (select * from c union all select 'accuracy', null, null, (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn from m
 union all select 'macro avg', avg(p), avg(r), avg(f), cast(sum(n) as bigint) from c
 union all select 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n), cast(sum(n) as bigint) from c)
select label, {round_sql('p', 9)} as precision, {round_sql('r', 9)} as recall, {round_sql('f', 9)} as f1_score, n as support from a"""


@add("sc15_classification_report", _REPORT)
def _(s, d):
    return rounded(metrics.classification_report(metrics.confusion(event_scores(s, d), _T)), 9)


@add("sc16_roc_points", CURVE + f"select threshold, {round_sql('fp / n_neg', 9)} as fpr, {round_sql('tp / n_pos', 9)} as tpr from cv")
def _(s, d):
    return rounded(metrics.roc_points(curve(s, d)), 9)


# ---- result tables --------------------------------------------------------

_METRIC = {
    "val_accuracy": "avg(l_extendedprice) / 100000",
    "val_precision": "avg(l_quantity) / 50",
    "val_recall": "avg(l_tax) * 10",
    "val_f1": "avg(l_discount) * 10",
    "val_pr_auc": "avg(l_discount * l_tax) * 100",
    "val_balanced_accuracy": "avg(l_quantity * l_tax) / 10",
    "val_mcc": "avg(l_quantity * l_discount) / 10",
}
_RESULTS_BODY = (
    "select 'flows' as dataset_name, concat('m', cast(l_linenumber as {text})) as model_name, "
    "case when l_returnflag = 'N' then 'baseline' else l_returnflag end as sampling_strategy, "
    + ", ".join(f"round({sql}, 5) as {c}" for c, sql in _METRIC.items())
    + " from {lineitem} group by l_linenumber, l_returnflag"
)
RESULTS = "with res as (" + _RESULTS_BODY.format(text="varchar", lineitem="lineitem") + ")\n"


def results(s, d) -> DataFrame:
    body = _RESULTS_BODY.format(text="string", lineitem="{lineitem}")
    return s.sql(body, lineitem=table(s, d, "lineitem"))


_BY = "val_f1 desc, val_recall desc, val_pr_auc desc, val_balanced_accuracy desc, val_mcc desc, model_name, sampling_strategy"


@add("bg02_rank", RESULTS + f"select *, cast(row_number() over (order by {_BY}) as int) as rank from res")
def _(s, d):
    order = Window.orderBy(*[F.desc(c) for c in bg.RANKED_BY], "model_name", "sampling_strategy")
    return bg.rank_results(results(s, d)).withColumn("rank", F.row_number().over(order))


@add("bg03_top_k", RESULTS + f"select * from res order by {_BY} limit 5")
def _(s, d):
    return bg.top_ranked(results(s, d), 5)


@add(
    "bg04_improvement",
    RESULTS
    + "select r.model_name, r.sampling_strategy, "
    + ", ".join(f"{round_sql(f'r.{m} - b.{m}', 9)} as delta_{m}" for m in ("val_f1", "val_recall", "val_mcc"))
    + " from res r join res b on r.model_name = b.model_name and b.sampling_strategy = 'baseline'",
)
def _(s, d):
    return rounded(bg.improvement(results(s, d)), 9)


@add(
    "bg05_strategy_summary",
    RESULTS
    + "select sampling_strategy, "
    + ", ".join(f"{round_sql(f'avg({c})', 9)} as {c}" for c in _METRIC)
    + " from res group by sampling_strategy",
)
def _(s, d):
    return rounded(bg.strategy_summary(results(s, d)), 9)


_COLS = "model_name, sampling_strategy, " + ", ".join(_METRIC)


@add("bg06_before_handling", RESULTS + f"select {_COLS} from res where sampling_strategy = 'baseline'")
def _(s, d):
    return bg.before_handling(results(s, d))


@add("bg06_after_handling", RESULTS + f"select {_COLS} from res where sampling_strategy <> 'baseline'")
def _(s, d):
    return bg.after_handling(results(s, d))


_PAPER = "model_name as algorithm, val_accuracy as accuracy, val_f1 as f1_score, val_recall as recall, val_precision as precision"


@add("bg07_paper_before", RESULTS + f"select 'flows' as dataset, {_PAPER} from res where sampling_strategy = 'baseline'")
def _(s, d):
    return bg.paper_before(results(s, d), "flows")


@add("bg08_paper_after", RESULTS + f"select 'flows' as dataset, sampling_strategy as technique, {_PAPER} from res where sampling_strategy <> 'baseline'")
def _(s, d):
    return bg.paper_after(results(s, d), "flows")


@add(
    "bg10_concise_ranking",
    RESULTS + f"select dataset_name, {_COLS}, 0.5::double as best_test_f1, 0.25::double as best_test_mcc from res",
)
def _(s, d):
    return bg.concise_ranking(results(s, d), 0.5, 0.25)


@add(
    "bg11_union",
    RESULTS
    + f"select 'a' as dataset, {_PAPER} from res where sampling_strategy = 'baseline' union all "
    + f"select 'b' as dataset, {_PAPER} from res where sampling_strategy = 'baseline'",
)
def _(s, d):
    res = results(s, d)
    return bg.union_all([bg.paper_before(res, "a"), bg.paper_before(res, "b")])
