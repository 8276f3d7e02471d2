"""Queries on flow assembly and flow statistics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import prepared, round_sql, rounded, table
from catalog.flow_sql import DUCK_PACKETS, FIXTURE, FIXTURE_PARITY, SPARK_PACKETS, flow_ctes
from netlens.operators import extended
from netlens.operators.features import FLOW_COLUMNS, records_of
from netlens.operators.flows import assign_flows
from netlens.params import FlowParams
from netlens.sources.packets import tcp_udp, with_flow_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_PACKETS.replace("from events)", "from {events})"), events=table(spark, sf_dir, "events"))


def assigned(spark: SparkSession, sf_dir: str, p: FlowParams = FIXTURE) -> DataFrame:
    return prepared(spark, sf_dir, f"assigned-{p}", lambda: assign_flows(packets(spark, sf_dir), p))


def _record_query(
    name: str,
    cols: dict[str, str],
    digits: int = 6,
    p: FlowParams = FIXTURE,
    ctes: str = "",
    record_params: FlowParams | None = None,
    **special: int,
):
    """A projection of the flow record against SQL aggregates over ``ann``.

    ``cols`` maps record columns to SQL; integers are cast, doubles rounded.
    """

    def run(spark, sf_dir):
        recs = records_of(assigned(spark, sf_dir, p), record_params or p, cols, keep_start=True)
        return rounded(recs.withColumnRenamed("start_seq", "first_seq").drop("start_us"), digits, **special)

    QUERIES[name] = run
    items = []
    for col, sql in cols.items():
        kind, _, body = sql.partition(":")
        if kind == "int":
            body = f"cast({body} as bigint)"
        elif kind == "dbl":
            body = round_sql(f"cast({body} as double)", special.get(col, digits))
        items.append(f"{body} as {col}")
    source = ctes or "select * from ann"
    SQL[name] = flow_ctes(p) + f"select fid as first_seq, {', '.join(items)} from ({source}) group by fid"


DUR = "(max(us) - min(us)) / 1e6"


def _rate(x: str) -> str:
    return f"dbl:case when max(us) = min(us) then 0 else {x} / ({DUR}) end"


def _stats(gap: str, where: str = "true") -> dict[str, str]:
    f = f"filter (where {where})"
    more = f"count({gap}) {f} > 1"
    return {
        s: f"dbl:case when {more} then {e} {f} / 1e6 else 0 end"
        for s, e in {
            "tot": f"sum({gap})", "max": f"max({gap})", "min": f"min({gap})",
            "mean": f"avg({gap})", "std": f"stddev_pop({gap})",
        }.items()
    }


# ---- assembly -------------------------------------------------------------

QUERIES["fa01_protocol_filter"] = lambda s, d: tcp_udp(packets(s, d)).select("seq", "protocol", "length")
SQL["fa01_protocol_filter"] = f"select seq, protocol, length from ({DUCK_PACKETS}) where protocol in (6, 17)"

QUERIES["fa02_flow_key"] = lambda s, d: with_flow_key(tcp_udp(packets(s, d))).select(
    "seq", "lo_ip", "lo_port", "hi_ip", "hi_port", F.col("d").cast("int").alias("low_first")
)
SQL["fa02_flow_key"] = flow_ctes(FIXTURE) + (
    "select seq, lo_ip, lo_port, hi_ip, hi_port, cast(d as int) as low_first from keyed"
)

QUERIES["fa03_direction"] = lambda s, d: assigned(s, d).select(
    "seq", F.col("start_seq").alias("first_seq"), F.col("fwd").cast("int").alias("fwd")
)
SQL["fa03_direction"] = flow_ctes(FIXTURE) + "select seq, fid as first_seq, cast(fwd as int) as fwd from ann"


def _sessions(spark, sf_dir):
    p = replace(FIXTURE, cap_s=None)
    rows = assign_flows(packets(spark, sf_dir), p)
    return rows.groupBy("start_seq").agg(
        F.count("*").alias("n_packets"), ((F.max("us") - F.min("us")) / 1e6).alias("duration_s")
    ).withColumnRenamed("start_seq", "first_seq")


QUERIES["fa04_inactivity_split"] = _sessions
SQL["fa04_inactivity_split"] = flow_ctes(FIXTURE) + (
    "select arg_min(seq, rn) as first_seq, count(*) as n_packets, (max(us) - min(us)) / 1e6 as duration_s "
    "from pos group by kid, sid"
)

QUERIES["fa05_duration_cap"] = lambda s, d: assigned(s, d).groupBy(F.col("start_seq").alias("first_seq")).agg(
    F.count("*").alias("n_packets"), F.max("us").alias("last_us")
)
SQL["fa05_duration_cap"] = flow_ctes(FIXTURE) + (
    "select fid as first_seq, count(*) as n_packets, max(us) as last_us from ann group by fid"
)

QUERIES["fa08_start_latest_duration"] = lambda s, d: assigned(s, d).groupBy(
    F.col("start_seq").alias("first_seq"), "start_us"
).agg(F.max("us").alias("latest_us"), ((F.max("us") - F.col("start_us")) / 1e6).alias("duration_s"))
SQL["fa08_start_latest_duration"] = flow_ctes(FIXTURE) + (
    "select fid as first_seq, start_us, max(us) as latest_us, (max(us) - start_us) / 1e6 as duration_s "
    "from ann group by fid, start_us"
)

# ---- the record -----------------------------------------------------------

_record_query(
    "ff01_endpoints_protocol",
    {c: f"raw:arg_min({c}, us)" for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")},
)
_record_query(
    "ff02_timestamp",
    {"timestamp": "raw:strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S')"},
)
_record_query("ff03_flow_duration", {"flow_duration": f"dbl:{DUR}"})
_record_query("ff04_byte_rate", {"flow_byts_s": _rate("sum(length)")})
_record_query(
    "ff05_packet_rates",
    {
        "flow_pkts_s": _rate("count(*)"),
        "fwd_pkts_s": _rate("count(*) filter (where fwd)"),
        "bwd_pkts_s": _rate("count(*) filter (where not fwd)"),
    },
)
_record_query(
    "ff06_packet_counts",
    {"tot_fwd_pkts": "int:count(*) filter (where fwd)", "tot_bwd_pkts": "int:count(*) filter (where not fwd)"},
)
_record_query(
    "ff07_length_totals",
    {
        "totlen_fwd_pkts": "int:coalesce(sum(length) filter (where fwd), 0)",
        "totlen_bwd_pkts": "int:coalesce(sum(length) filter (where not fwd), 0)",
    },
)
_lengths = {}
for _side, _cond in (("fwd_", "fwd"), ("bwd_", "not fwd"), ("", "true")):
    for _s, _e in (("max", "int:max"), ("min", "int:min"), ("mean", "dbl:avg"), ("std", "dbl:stddev_pop")):
        _kind, _fn = _e.split(":")
        _lengths[f"{_side}pkt_len_{_s}"] = f"{_kind}:coalesce({_fn}(length) filter (where {_cond}), 0)"
_lengths["pkt_len_var"] = "dbl:var_pop(length)"
_record_query("ff08_packet_length_stats", _lengths, 5)
_record_query("ff09_average_packet_size", {"pkt_size_avg": "dbl:sum(length) / count(*)"})
_record_query(
    "ff10_header_lengths",
    {
        "fwd_header_len": "int:coalesce(sum(header_len) filter (where fwd), 0)",
        "bwd_header_len": "int:coalesce(sum(header_len) filter (where not fwd), 0)",
    },
)
_record_query("ff11_min_forward_header", {"fwd_seg_size_min": "int:coalesce(min(header_len) filter (where fwd), 0)"})
_record_query("ff12_forward_data_packets", {"fwd_act_data_pkts": "int:count(*) filter (where fwd and payload_len > 0)"})
_record_query(
    "ff13_flow_gaps", {f"flow_iat_{s}": e for s, e in _stats("gap").items() if s != "tot"}, 6, flow_iat_std=3
)
# the same table in order of arrival: gaps to the latest time so far
_arrival = (
    "select * replace (us - max(us) over (partition by fid order by seq rows between unbounded preceding and 1 preceding) "
    "as gap) from ann"
)
_record_query(
    "ff13_flow_gaps_by_arrival",
    {f"flow_iat_{s}": e for s, e in _stats("gap").items() if s != "tot"},
    6,
    p=FIXTURE,
    ctes=_arrival,
    record_params=replace(FIXTURE, arrival_gaps=True),
    flow_iat_std=3,
)
_record_query(
    "ff14_directional_gaps",
    {f"fwd_iat_{s}": e for s, e in _stats("dgap", "fwd").items()}
    | {f"bwd_iat_{s}": e for s, e in _stats("dgap", "not fwd").items()},
    6,
    fwd_iat_std=3,
    bwd_iat_std=3,
)
_record_query(
    "ff15_directional_flags",
    {
        f"{side}_{name}_flags": f"int:count(*) filter (where {cond} and contains(tcp_flags, '{letter}'))"
        for name, letter in (("psh", "P"), ("urg", "U"))
        for side, cond in (("fwd", "fwd"), ("bwd", "not fwd"))
    },
)
_record_query(
    "ff16_flag_counts",
    {
        f"{name}_flag_cnt": f"int:count(*) filter (where contains(tcp_flags, '{letter}'))"
        for name, letter in zip("fin syn rst psh ack urg ece".split(), "FSRPAUE", strict=True)
    },
)
_record_query(
    "ff17_down_up_ratio",
    {"down_up_ratio": "dbl:case when count(*) filter (where fwd) = 0 then 0 else "
     "count(*) filter (where not fwd) / count(*) filter (where fwd) end"},
)
_windows = {
    f"init_{side}_win_byts": f"int:coalesce(arg_min(tcp_window, us) filter (where {cond} and tcp_window <> 0), 0)"
    for side, cond in (("fwd", "fwd"), ("bwd", "not fwd"))
}
_record_query("fa09_first_window", _windows)
_record_query("ff18_initial_windows", _windows)
_activity = (
    "select *, case when gap > {a} then gap end idle, "
    "case when gap > {a} and us - gap - run_us > 0 then us - gap - run_us end active from ("
    "select *, coalesce(max(g) over (partition by fid order by us, seq rows between unbounded preceding and 1 preceding),"
    " start_us) run_us from (select *, case when gap > {a} then us end g from ann))"
).format(a=FIXTURE.active_us)
_record_query(
    "ff19_active_idle",
    {f"{n}_{s}": e for n in ("active", "idle") for s, e in _stats(n).items() if s != "tot"},
    6,
    ctes=_activity,
    active_std=3,
    idle_std=3,
)
_bulk_cte = f"""
select fid, 1 one, fwd, n, b, dur from (select distinct fid from ann) left join (
  select fid, fwd, count(*) n, sum(payload_len) b, max(us) - min(us) dur from (
    select *, sum(nb) over (partition by fid order by us, seq) run from (
      select *, case when lag(fwd) over w = fwd and us - lag(us) over w <= {FIXTURE.clump_us} then 0 else 1 end nb
      from ann where payload_len > 0 window w as (partition by fid order by us, seq)))
  group by fid, fwd, run having count(*) >= {FIXTURE.bulk_bound}) using (fid)"""
_bulk = {}
for _side, _cond in (("fwd", "fwd"), ("bwd", "not fwd")):
    _f = f"filter (where {_cond})"
    _bulk[f"{_side}_byts_b_avg"] = f"dbl:coalesce(sum(b) {_f} / nullif(count(n) {_f}, 0), 0)"
    _bulk[f"{_side}_pkts_b_avg"] = f"dbl:coalesce(sum(n) {_f} / nullif(count(n) {_f}, 0), 0)"
    _bulk[f"{_side}_blk_rate_avg"] = f"dbl:coalesce(sum(b) {_f} / (nullif(sum(dur) {_f}, 0) / 1e6), 0)"
_record_query("ff20_bulk_transfers", _bulk, ctes=_bulk_cte)
_record_query(
    "ff21_segment_sizes",
    {
        "fwd_seg_size_avg": "dbl:coalesce(avg(length) filter (where fwd), 0)",
        "bwd_seg_size_avg": "dbl:coalesce(avg(length) filter (where not fwd), 0)",
    },
)
_record_query("ff22_cwr_count", {"cwr_flag_count": "int:count(*) filter (where contains(tcp_flags, 'C'))"})
_record_query(
    "ff23_subflows",
    {
        "subflow_fwd_pkts": "int:count(*) filter (where fwd)",
        "subflow_bwd_pkts": "int:count(*) filter (where not fwd)",
        "subflow_fwd_byts": "int:coalesce(sum(length) filter (where fwd), 0)",
        "subflow_bwd_byts": "int:coalesce(sum(length) filter (where not fwd), 0)",
    },
)
# parity: the opening packet counts twice, protocol is not in the key, activity stays 0
_twice = "select * from ann union all by name select * replace (0 as gap, 0 as dgap) from ann where is_first"
_record_query(
    "q01_parity_record",
    {
        "tot_fwd_pkts": "int:count(*) filter (where fwd)",
        "tot_bwd_pkts": "int:count(*) filter (where not fwd)",
        "totlen_fwd_pkts": "int:coalesce(sum(length) filter (where fwd), 0)",
        "pkt_len_mean": "dbl:avg(length)",
        "fwd_header_len": "int:coalesce(sum(header_len) filter (where fwd), 0)",
        "flow_iat_mean": _stats("gap")["mean"],
        "flow_iat_min": _stats("gap")["min"],
        "fwd_iat_mean": _stats("dgap", "fwd")["mean"],
        "syn_flag_cnt": "int:count(*) filter (where contains(tcp_flags, 'S'))",
        "idle_max": "dbl:0",
        "cwr_flag_count": "int:count(*) filter (where fwd and contains(tcp_flags, 'U'))",
    },
    p=FIXTURE_PARITY,
    ctes=_twice,
)


def _selected(spark, sf_dir):
    names = "timestamp, tot_bwd_pkts, no_such_field, src_ip, flow_duration".split(",")
    return records_of(assigned(spark, sf_dir), FIXTURE, names)


QUERIES["io07_field_selection"] = _selected
SQL["io07_field_selection"] = flow_ctes(FIXTURE) + (
    f"select arg_min(src_ip, us) as src_ip, strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S') as timestamp, "
    f"{DUR} as flow_duration, count(*) filter (where not fwd) as tot_bwd_pkts from ann group by fid"
)


def _full_record(spark, sf_dir):
    recs = records_of(assigned(spark, sf_dir), FIXTURE)
    means = [F.round(F.avg(c), 4).alias(c) for c in FLOW_COLUMNS[6:]]
    return recs.groupBy("protocol").agg(F.count("*").alias("flows"), *means)


QUERIES["flow_record_profile"] = _full_record

# ---- extended statistics --------------------------------------------------


def _extended(name: str, cols: dict[str, str], digits: int = 6, source: str = "ann", **special):
    def run(spark, sf_dir):
        ext = prepared(
            spark, sf_dir, "extended", lambda: extended.extended_records(assigned(spark, sf_dir), FIXTURE, ())
        )
        return rounded(ext.select(F.col("start_seq").alias("first_seq"), *cols), digits, **special)

    QUERIES[name] = run
    items = []
    for col, sql in cols.items():
        kind, _, body = sql.partition(":")
        body = f"cast({body} as bigint)" if kind == "int" else round_sql(body, special.get(col, digits))
        items.append(f"{body} as {col}")
    SQL[name] = flow_ctes(FIXTURE) + f"select fid as first_seq, {', '.join(items)} from {source} group by fid"


def _rate1(x: str) -> str:
    return f"dbl:case when max(us) = min(us) then -1 else {x} / ({DUR}) end"


_sent, _recv = "coalesce(sum(length) filter (where fwd), 0)", "coalesce(sum(length) filter (where not fwd), 0)"
_hf, _hr = "coalesce(sum(header_len) filter (where fwd), 0)", "coalesce(sum(header_len) filter (where not fwd), 0)"
_extended(
    "fx01_bytes_sent_received",
    {
        "bytes_sent": f"int:{_sent}",
        "bytes_received": f"int:{_recv}",
        "sent_rate": _rate1(_sent),
        "received_rate": _rate1(_recv),
    },
)
_extended("fx02_header_rates", {"fwd_header_rate": _rate1(_hf), "bwd_header_rate": _rate1(_hr)})
_extended("fx03_header_ratio", {"header_in_out_ratio": f"dbl:case when {_hr} = 0 then -1 else {_hf} / {_hr} end"})
_extended("fx04_initial_ttl", {"initial_ttl": "int:arg_min(ttl, us)"})


def _spread_ctes(value: str, where: str) -> str:
    """Per flow: count, mean, variance, median and mode of an integral value."""
    return (
        f", val as (select fid, {value} v from ann where {where}), "
        "cnt as (select fid, v, count(*) c from val group by fid, v), "
        "md as (select fid, min(v) m from (select *, max(c) over (partition by fid) mc from cnt) where c = mc group by fid), "
        "st as (select fid, avg(v) mean, var_pop(v) var, stddev_pop(v) std, quantile_cont(v, 0.5) med from val group by fid), "
        "sp as (select f.fid, mean, var, std, med, cast(m as double) m from (select distinct fid from ann) f "
        "left join st on f.fid = st.fid left join md on f.fid = md.fid)"
    )


def _spread(name: str, prefix: str, value: str, where: str, cols: list[str], scale: float, empty: bool, **digits):
    def run(spark, sf_dir):
        ext = prepared(
            spark, sf_dir, f"extended-{prefix}", lambda: extended.extended_records(assigned(spark, sf_dir), FIXTURE, [prefix])
        )
        return rounded(
            ext.select(F.col("start_seq").alias("first_seq"), *[f"{prefix}_{c}" for c in cols]),
            5,
            **{f"{prefix}_{c}": d for c, d in digits.items()},
        )

    QUERIES[name] = run
    e = "-1" if empty else "null"
    body = {
        "mean": f"coalesce(mean / {scale}, {e})",
        "var": f"coalesce(var / {scale * scale}, {e})",
        "std": f"coalesce(std / {scale}, {e})",
        "median": f"med / {scale}",
        "mode": f"coalesce(m / {scale}, {e})",
        "skew": "case when std = 0 then -10 else 3 * (mean - med) / std end",
        "skew2": f"case when std is null then {'0' if empty else 'null'} when std = 0 then -10 else (mean - m) / std end",
        "cov": f"case when mean is null then {'1' if empty else 'null'} when mean = 0 then -1 else std / mean end",
    }
    items = [f"{round_sql(body[c], digits.get(c, 5))} as {prefix}_{c}" for c in cols]
    SQL[name] = flow_ctes(FIXTURE) + _spread_ctes(value, where) + f" select fid as first_seq, {', '.join(items)} from sp"


_spread("fx05_length_median_mode", "pkt_len", "length", "true", ["median", "mode"], 1.0, False)
_spread("fx06_length_shape", "pkt_len", "length", "true", ["skew", "skew2", "cov"], 1.0, False)
_spread(
    "fx09_time_statistics", "pkt_time", "us - start_us", "true",
    ["var", "std", "mean", "median", "mode", "skew", "skew2", "cov"], 1e6, False, var=-2, std=3,
)
_spread(
    "fx12_response_statistics", "response", "gap", "not fwd and prev_fwd",
    ["var", "mean", "median", "mode", "skew", "skew2", "std", "cov"], 1e6, True, var=-2, std=3,
)


def _first_fifty(spark, sf_dir):
    lens = extended.first_lengths(assigned(spark, sf_dir), FIXTURE, 50)
    return lens.select(
        F.col("start_seq").alias("first_seq"), F.array_join(F.col("first_lengths").cast("array<string>"), ",").alias("first_lengths")
    )


QUERIES["fx07_first_fifty_lengths"] = _first_fifty
SQL["fx07_first_fifty_lengths"] = flow_ctes(FIXTURE) + (
    "select fid as first_seq, string_agg(cast(length as varchar), ',' order by us, seq) as first_lengths from "
    "(select *, row_number() over (partition by fid order by us, seq) r from ann) where r <= 50 group by fid"
)
_extended(
    "fx08_header_totals",
    {
        "header_total": "int:sum(header_len)",
        "fwd_header_total": f"int:{_hf}",
        "bwd_header_total": f"int:{_hr}",
        "header_min": "int:min(header_len)",
        "fwd_header_min": "int:min(header_len) filter (where fwd)",
        "bwd_header_min": "int:min(header_len) filter (where not fwd)",
    },
)
QUERIES["fx10_relative_times"] = lambda s, d: extended.relative_times(assigned(s, d)).select(
    "seq", F.col("start_seq").alias("first_seq"), "relative_time"
)
SQL["fx10_relative_times"] = flow_ctes(FIXTURE) + (
    "select seq, fid as first_seq, coalesce(gap, 0) / 1e6 as relative_time from ann"
)
QUERIES["fx11_response_times"] = lambda s, d: extended.response_times(assigned(s, d)).select(
    "seq", F.col("start_seq").alias("first_seq"), "response_time"
)
SQL["fx11_response_times"] = flow_ctes(FIXTURE) + (
    "select seq, fid as first_seq, gap / 1e6 as response_time from ann where not fwd and prev_fwd"
)
