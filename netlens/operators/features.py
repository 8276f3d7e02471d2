"""Flow records: 82 statistics per flow (FF1-FF23).

All order-dependent inputs are columns of the assigned packets, so a record is
one hash aggregation with map-side combine; a flow of any size is never held in
one task. Only bulk transfers need a second level (flow, run).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.functions.numbers import ratio
from netlens.operators.flows import assign_flows
from netlens.params import MICROS, FlowParams

# The record's column names and their order.
FLOW_COLUMNS = """
src_ip dst_ip src_port dst_port protocol timestamp flow_duration flow_byts_s flow_pkts_s fwd_pkts_s
bwd_pkts_s tot_fwd_pkts tot_bwd_pkts totlen_fwd_pkts totlen_bwd_pkts fwd_pkt_len_max fwd_pkt_len_min
fwd_pkt_len_mean fwd_pkt_len_std bwd_pkt_len_max bwd_pkt_len_min bwd_pkt_len_mean bwd_pkt_len_std
pkt_len_max pkt_len_min pkt_len_mean pkt_len_std pkt_len_var fwd_header_len bwd_header_len
fwd_seg_size_min fwd_act_data_pkts flow_iat_mean flow_iat_max flow_iat_min flow_iat_std fwd_iat_tot
fwd_iat_max fwd_iat_min fwd_iat_mean fwd_iat_std bwd_iat_tot bwd_iat_max bwd_iat_min bwd_iat_mean
bwd_iat_std fwd_psh_flags bwd_psh_flags fwd_urg_flags bwd_urg_flags fin_flag_cnt syn_flag_cnt
rst_flag_cnt psh_flag_cnt ack_flag_cnt urg_flag_cnt ece_flag_cnt down_up_ratio pkt_size_avg
init_fwd_win_byts init_bwd_win_byts active_max active_min active_mean active_std idle_max idle_min
idle_mean idle_std fwd_byts_b_avg fwd_pkts_b_avg bwd_byts_b_avg bwd_pkts_b_avg fwd_blk_rate_avg
bwd_blk_rate_avg fwd_seg_size_avg bwd_seg_size_avg cwr_flag_count subflow_fwd_pkts subflow_bwd_pkts
subflow_fwd_byts subflow_bwd_byts
""".split()

FLAG_LETTERS = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "urg": "U", "ece": "E"}
FLOW_START = ["start_us", "start_seq", "start_d"]
ARRIVAL_ROWS = 65_536


def _of(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def _gap_stats(name: str, gap: Column) -> list[Column]:
    """Aggregates of a gap in microseconds, read back by ``_gap_values``."""
    gap = gap.cast("double")
    return [
        F.count(gap).alias(f"{name}_n"),
        F.sum(gap).alias(f"{name}_tot"),
        F.max(gap).alias(f"{name}_max"),
        F.min(gap).alias(f"{name}_min"),
        F.avg(gap).alias(f"{name}_mean"),
        F.stddev_pop(gap).alias(f"{name}_std"),
    ]


def _gap_values(name: str) -> dict[str, Column]:
    """Seconds; all zero unless there is more than one gap."""
    return {
        f"{name}_{s}": F.when(F.col(f"{name}_n") > 1, F.col(f"{name}_{s}") / MICROS).otherwise(F.lit(0.0))
        for s in ("tot", "max", "min", "mean", "std")
    }


def _first_packet_twice(packets: DataFrame) -> DataFrame:
    """Parity: the original meter stores the packet that opens a flow twice."""
    copies = F.sequence(F.lit(0), F.when(F.col("is_first"), 1).otherwise(0))
    doubled = packets.select("*", F.explode(copies).alias("copy"))
    again = F.col("copy") == 1
    return doubled.withColumns(
        {
            "gap_us": F.when(again, F.lit(0)).otherwise(F.col("gap_us")),
            "dir_gap_us": F.when(again, F.lit(0)).otherwise(F.col("dir_gap_us")),
        }
    ).drop("copy")


def _gaps_by_arrival(packets: DataFrame, p: FlowParams, part_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """FF13, FF14 for packets out of time order.

    The flow gap runs to the latest time so far and is negative for a late packet;
    a direction's gap runs to its packet before. Ordered inside slices of the arrival
    order; what a slice takes over from earlier ones is one row for each.
    """
    flow = [*p.key_columns, *FLOW_START]
    before = (Window.unboundedPreceding, -1)
    rows = packets.withColumn("_part", F.floor(F.col("seq") / part_rows).cast("long"))
    one = Window.partitionBy(*flow, "_part").orderBy("seq")
    way = Window.partitionBy(*flow, "_part", "fwd").orderBy("seq")
    rows = rows.withColumns({"_latest": F.max("us").over(one.rowsBetween(*before)), "_last": F.lag("us").over(way)})
    last = F.struct("seq", "us")
    carried = {"_c_latest": F.max("us"), "_c_fwd": F.max(_of(F.col("fwd"), last)), "_c_bwd": F.max(_of(~F.col("fwd"), last))}
    slices = Window.partitionBy(*flow).orderBy("_part").rowsBetween(*before)
    states = rows.groupBy(*flow, "_part").agg(*(a.alias(n) for n, a in carried.items()))
    states = states.withColumns({n: F.max(n).over(slices) for n in carried})
    rows = rows.join(states, [*flow, "_part"])
    last_us = F.coalesce("_last", F.when(F.col("fwd"), F.col("_c_fwd.us")).otherwise(F.col("_c_bwd.us")))
    gaps = {"gap_us": F.col("us") - F.greatest("_latest", "_c_latest"), "dir_gap_us": F.col("us") - last_us}
    return rows.withColumns(gaps).select(*packets.columns)


def _aggregates(p: FlowParams) -> list[Column]:
    fwd, length, header = F.col("fwd"), F.col("length"), F.col("header_len")
    aggs = [
        F.max(F.when(F.col("is_first"), F.col("protocol"))).alias("first_protocol"),
        F.max("us").alias("end_us"),
        F.count(F.lit(1)).alias("n"),
        F.sum(length).alias("bytes"),
        F.max(length).alias("pkt_len_max"),
        F.min(length).alias("pkt_len_min"),
        F.avg(length).alias("pkt_len_mean"),
        F.var_pop(length).alias("pkt_len_var"),
        F.min(_of(fwd, header)).alias("fwd_seg_size_min"),
        F.count_if(fwd & (F.col("payload_len") > 0)).alias("fwd_act_data_pkts"),
        *_gap_stats("flow_iat", F.col("gap_us")),
    ]
    for side, cond in (("fwd", fwd), ("bwd", ~fwd)):
        aggs += [
            F.count_if(cond).alias(f"tot_{side}_pkts"),
            F.sum(_of(cond, length)).alias(f"totlen_{side}_pkts"),
            F.max(_of(cond, length)).alias(f"{side}_pkt_len_max"),
            F.min(_of(cond, length)).alias(f"{side}_pkt_len_min"),
            F.avg(_of(cond, length)).alias(f"{side}_pkt_len_mean"),
            F.stddev_pop(_of(cond, length)).alias(f"{side}_pkt_len_std"),
            F.sum(_of(cond, header)).alias(f"{side}_header_len"),
            F.max(_of(cond & F.col("first_window"), F.col("tcp_window"))).alias(f"init_{side}_win_byts"),
            *_gap_stats(f"{side}_iat", _of(cond, F.col("dir_gap_us"))),
        ]
        for name in ("psh", "urg"):
            has = F.contains(F.col("tcp_flags"), F.lit(FLAG_LETTERS[name]))
            aggs.append(F.count_if(cond & has).alias(f"{side}_{name}_flags"))
    for name, letter in {**FLAG_LETTERS, "cwr": "C"}.items():
        aggs.append(F.count_if(F.contains(F.col("tcp_flags"), F.lit(letter))).alias(f"{name}_flag_cnt"))
    if _tracks_activity(p):
        idle = F.when(F.col("gap_us") > p.active_us, F.col("gap_us"))
        active = F.col("us") - F.col("gap_us") - F.col("run_us")
        aggs += _gap_stats("idle", idle)
        aggs += _gap_stats("active", F.when(idle.isNotNull() & (active > 0), active))
    return aggs


def _tracks_activity(p: FlowParams) -> bool:
    """FF19: a flow cannot hold an idle gap unless the idle timeout is the longer one."""
    return not p.parity and p.active_us < p.idle_us


def _bulks(packets: DataFrame, p: FlowParams) -> DataFrame:
    """FF20: per flow and direction the sums over runs of at least ``bulk_bound`` packets."""
    flow = [*p.key_columns, *FLOW_START]
    runs = (
        packets.where("payload_len > 0")
        .groupBy(*flow, "bulk_us", "bulk_seq")
        .agg(
            F.max("fwd").alias("fwd"),
            F.count(F.lit(1)).alias("n"),
            F.sum("payload_len").alias("bytes"),
            (F.max("us") - F.min("us")).alias("us"),
        )
        .where(F.col("n") >= p.bulk_bound)
    )
    sums = []
    for side, cond in (("fwd", F.col("fwd")), ("bwd", ~F.col("fwd"))):
        sums.append(F.count_if(cond).alias(f"{side}_bulks"))
        sums += [F.sum(_of(cond, F.col(c))).alias(f"{side}_bulk_{c}") for c in ("n", "bytes", "us")]
    return runs.groupBy(*flow).agg(*sums)


def _record(p: FlowParams, with_bulk: bool) -> dict[str, Column]:
    seconds = (F.col("end_us") - F.col("start_us")) / MICROS
    low_first = F.col("start_d")
    ends = {
        "src_ip": ("lo_ip", "hi_ip"), "dst_ip": ("hi_ip", "lo_ip"),
        "src_port": ("lo_port", "hi_port"), "dst_port": ("hi_port", "lo_port"),
    }
    rec = {c: F.when(low_first, F.col(a)).otherwise(F.col(b)) for c, (a, b) in ends.items()}
    start = F.timestamp_micros("start_us")
    rec |= {
        "protocol": F.col("first_protocol"),
        "timestamp": F.date_format(start, "yyyy-MM-dd HH:mm:ss"),
        "flow_duration": seconds,
        "flow_byts_s": ratio(F.col("bytes"), seconds),
        "flow_pkts_s": ratio(F.col("n"), seconds),
        "fwd_pkts_s": ratio(F.col("tot_fwd_pkts"), seconds),
        "bwd_pkts_s": ratio(F.col("tot_bwd_pkts"), seconds),
        "pkt_len_std": F.sqrt("pkt_len_var"),
        "down_up_ratio": ratio(F.col("tot_bwd_pkts"), F.col("tot_fwd_pkts")),
        "pkt_size_avg": ratio(F.col("bytes"), F.col("n")),
        "fwd_seg_size_min": _zero(F.col("fwd_seg_size_min")),
        "cwr_flag_count": F.col("fwd_urg_flags") if p.parity else F.col("cwr_flag_cnt"),
        **_gap_values("flow_iat"),
    }
    for side in ("fwd", "bwd"):
        for c in (f"totlen_{side}_pkts", f"{side}_header_len", f"init_{side}_win_byts"):
            rec[c] = _zero(F.col(c))
        for s in ("max", "min", "mean", "std"):
            rec[f"{side}_pkt_len_{s}"] = _zero(F.col(f"{side}_pkt_len_{s}"))
        rec |= _gap_values(f"{side}_iat")
        rec[f"{side}_seg_size_avg"] = rec[f"{side}_pkt_len_mean"]
        rec[f"subflow_{side}_pkts"] = F.col(f"tot_{side}_pkts")
        rec[f"subflow_{side}_byts"] = rec[f"totlen_{side}_pkts"]
        if with_bulk:
            bulk = {c: _zero(F.col(f"{side}_bulk_{c}")) for c in ("n", "bytes", "us")}
            count = _zero(F.col(f"{side}_bulks"))
            rec[f"{side}_byts_b_avg"] = ratio(bulk["bytes"], count)
            rec[f"{side}_pkts_b_avg"] = ratio(bulk["n"], count)
            rec[f"{side}_blk_rate_avg"] = ratio(bulk["bytes"], bulk["us"] / MICROS)
    for name in ("active", "idle"):
        if _tracks_activity(p):
            rec |= _gap_values(name)
        else:
            rec |= {f"{name}_{s}": F.lit(0.0) for s in ("max", "min", "mean", "std")}
    return rec


def flow_records(
    packets: DataFrame,
    p: FlowParams | None = None,
    fields: Iterable[str] | None = None,
    keep_start: bool = False,
) -> DataFrame:
    """One row per flow with the 82 columns, or those of them named in ``fields``.

    IO7: unknown names are ignored and the record's order is kept; what is not
    asked for is not computed. ``keep_start`` adds ``start_us`` and ``start_seq``,
    which with the endpoints identify the flow.
    """
    p = p or FlowParams()
    return records_of(assign_flows(packets, p), p, fields, keep_start)


def records_of(
    assigned: DataFrame, p: FlowParams, fields: Iterable[str] | None = None, keep_start: bool = False
) -> DataFrame:
    """``flow_records`` over packets that already went through ``assign_flows``."""
    wanted = None if fields is None else {f.strip() for f in fields}
    names = [c for c in FLOW_COLUMNS if wanted is None or c in wanted]
    flow = [*p.key_columns, *FLOW_START]
    gaps = _gaps_by_arrival(assigned, p) if p.arrival_gaps else assigned
    counted = _first_packet_twice(gaps) if p.parity else gaps
    flows = counted.groupBy(*flow).agg(*_aggregates(p))
    with_bulk = any("_b_avg" in c or "_blk_" in c for c in names)
    if with_bulk:
        flows = flows.join(_bulks(assigned, p), flow, "left")
    rec = _record(p, with_bulk)
    ids = [F.col("start_us"), F.col("start_seq")] if keep_start else []
    if p.per_file:
        ids.append(F.col("source_file"))
    return flows.select(*ids, *[rec.get(c, F.col(c)).alias(c) for c in names])
