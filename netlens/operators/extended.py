"""Flow statistics beyond the 82-column record (FX1-FX12).

Medians and modes come from counts of (flow, value): the values of a flow are cut into
at most ``BUCKETS`` equal ranges, whose counts tell in which range the middle ranks are,
and only values of those ranges are ordered, by range. No flow is held as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.functions.lineage import cut_lineage
from netlens.functions.numbers import ratio
from netlens.operators.features import FLOW_START
from netlens.params import MICROS, FlowParams

BUCKETS = 256
SPREADS = ("pkt_len", "pkt_time", "response")


def _shape(name: str) -> dict[str, Column]:
    """Skewness by median and by mode, and coefficient of variation."""
    mean, median, mode, std = (F.col(f"{name}_{s}") for s in ("mean", "median", "mode", "std"))
    return {
        f"{name}_skew": F.when(std == 0, F.lit(-10.0)).otherwise(F.try_divide(3 * (mean - median), std)),
        f"{name}_skew2": F.when(std == 0, F.lit(-10.0)).otherwise(F.try_divide(mean - mode, std)),
        f"{name}_cov": F.when(mean == 0, F.lit(-1.0)).otherwise(F.try_divide(std, mean)),
    }


def medians_and_modes(assigned: DataFrame, flow: list[str], values: dict[str, Column]) -> DataFrame:
    """(flow, name_median, name_mode) of integral values; of several modes the smallest."""
    named = F.array(*(F.struct(F.lit(n).alias("stat"), v.cast("long").alias("value")) for n, v in values.items()))
    key = [*flow, "stat"]
    cells = assigned.select(*flow, F.explode(named).alias("c")).select(*flow, "c.*").where("value is not null")
    cells = cut_lineage(cells.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n")))
    width = F.lit(1).cast("long")
    for r in cells.groupBy("stat").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect():  # one row a name
        width = F.when(F.col("stat") == r.stat, F.lit((r.high - r.low) // BUCKETS + 1)).otherwise(width)
    cells = cells.withColumn("bucket", F.floor(F.col("value") / width).cast("long"))
    counts = cells.groupBy(*key, "bucket").agg(F.sum("n").alias("m"))
    in_order = Window.partitionBy(*key).orderBy("bucket")  # BUCKETS + 1 rows at most
    counts = counts.withColumns(
        {"before": F.sum("m").over(in_order) - F.col("m"), "total": F.sum("m").over(Window.partitionBy(*key))}
    )
    middle = {"low": F.floor((F.col("total") - 1) / 2) - F.col("before"), "high": F.floor(F.col("total") / 2) - F.col("before")}
    holds = [(at >= 0) & (at < F.col("m")) for at in middle.values()]
    chosen = counts.where(holds[0] | holds[1]).select(*key, "bucket", *(at.alias(f"{n}_at") for n, at in middle.items()))
    upto = F.sum("n").over(Window.partitionBy(*key, "bucket").orderBy("value"))
    inside = cells.join(chosen, [*key, "bucket"]).withColumn("upto", upto)
    picked = lambda n: F.max(F.when((F.col(f"{n}_at") >= F.col("upto") - F.col("n")) & (F.col(f"{n}_at") < F.col("upto")), F.col("value")))
    medians = inside.groupBy(*key).agg(((picked("low") + picked("high")) / 2).alias("median"))
    # most often first, then the smallest
    modes = cells.groupBy(*key).agg((-F.max(F.struct("n", (-F.col("value")).alias("v")))["v"]).cast("double").alias("mode"))
    both = medians.join(modes, key)
    return both.groupBy(*flow).agg(
        *(F.max(F.when(F.col("stat") == n, F.col(s))).alias(f"{n}_{s}") for n in values for s in ("median", "mode"))
    )


def _spread(name: str, value: Column) -> list[Column]:
    number = value.cast("double")
    return [
        F.count(value).alias(f"{name}_n"),
        F.avg(number).alias(f"{name}_mean"),
        F.var_pop(number).alias(f"{name}_var"),
    ]


def _in_seconds(name: str, empty: float | None = None) -> dict[str, Column]:
    out = {
        f"{name}_{s}": F.col(f"{name}_{s}") / (MICROS**2 if s == "var" else MICROS)
        for s in ("mean", "var", "median", "mode")
    }
    if empty is not None:
        for s in ("mean", "var", "mode"):
            out[f"{name}_{s}"] = F.coalesce(out[f"{name}_{s}"], F.lit(empty))
    return out


def is_response() -> Column:
    """FX11: a reverse packet directly after a forward one."""
    return ~F.col("fwd") & F.coalesce(F.col("prev_fwd"), F.lit(False))


def extended_records(assigned: DataFrame, p: FlowParams | None = None, spreads: Sequence[str] = SPREADS) -> DataFrame:
    """FX1-FX6, FX8, FX9, FX12: one row per flow, identified by ``start_us, start_seq``.

    Only values named in ``spreads`` get moments, medians and modes; the flows are the same.
    """
    p = p or FlowParams()
    fwd, length, header = F.col("fwd"), F.col("length"), F.col("header_len")
    flow = [*p.key_columns, *FLOW_START]
    known = {"pkt_len": length, "pkt_time": F.col("us") - F.col("start_us"), "response": F.when(is_response(), F.col("gap_us"))}
    values = {n: v for n, v in known.items() if n in spreads}
    flows = assigned.groupBy(*flow).agg(
        F.max("us").alias("end_us"),
        F.coalesce(F.sum(F.when(fwd, length)), F.lit(0)).alias("bytes_sent"),
        F.coalesce(F.sum(F.when(~fwd, length)), F.lit(0)).alias("bytes_received"),
        F.sum(header).alias("header_total"),
        F.coalesce(F.sum(F.when(fwd, header)), F.lit(0)).alias("fwd_header_total"),
        F.coalesce(F.sum(F.when(~fwd, header)), F.lit(0)).alias("bwd_header_total"),
        F.min(header).alias("header_min"),
        F.min(F.when(fwd, header)).alias("fwd_header_min"),
        F.min(F.when(~fwd, header)).alias("bwd_header_min"),
        F.max(F.when(F.col("is_first"), F.col("ttl"))).alias("initial_ttl"),
        F.count(F.coalesce(*(v.cast("long") for v in known.values()))).alias("with_value"),
        *(c for n, v in values.items() for c in _spread(n, v)),
    )
    flows = flows.where(reduce(Column.__and__, [F.col("with_value") > 0, *(F.col(c).isNotNull() for c in flow)]))
    if values:
        flows = flows.join(medians_and_modes(assigned, flow, values), flow, "left")
    for n in values:
        if n != "pkt_len":
            flows = flows.withColumns(_in_seconds(n, -1.0 if n == "response" else None))
        std = F.sqrt(f"{n}_var")
        flows = flows.withColumn(f"{n}_std", F.when(F.col(f"{n}_n") == 0, F.lit(-1.0)).otherwise(std) if n == "response" else std)
    for n in values:
        flows = flows.withColumns(_shape(n))
    seconds = (F.col("end_us") - F.col("start_us")) / MICROS
    flows = flows.withColumns(
        {
            "sent_rate": ratio(F.col("bytes_sent"), seconds, -1),
            "received_rate": ratio(F.col("bytes_received"), seconds, -1),
            "fwd_header_rate": ratio(F.col("fwd_header_total"), seconds, -1),
            "bwd_header_rate": ratio(F.col("bwd_header_total"), seconds, -1),
            "header_in_out_ratio": ratio(F.col("fwd_header_total"), F.col("bwd_header_total"), -1),
        }
    )
    return flows.drop(*p.key_columns, "start_d", "end_us", "with_value", *(f"{n}_n" for n in values))


def first_lengths(assigned: DataFrame, p: FlowParams | None = None, n: int = 50) -> DataFrame:
    """FX7: the first ``n`` packet lengths of each flow.

    The rank limit is applied before the shuffle, so a flow sends at most ``n``
    rows per task.
    """
    p = p or FlowParams()
    flow = [*p.key_columns, *FLOW_START]
    order = Window.partitionBy(*flow).orderBy("us", "seq")
    first = assigned.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "length")))
    return first.groupBy(*flow).agg(F.transform(listed, lambda x: x["length"]).alias("first_lengths"))


def relative_times(assigned: DataFrame) -> DataFrame:
    """FX10 as rows: seconds since the packet before in the same flow, 0 for the first."""
    gap = F.coalesce(F.col("gap_us"), F.lit(0)) / MICROS
    return assigned.select("seq", "us", "start_us", "start_seq", gap.alias("relative_time"))


def response_times(assigned: DataFrame) -> DataFrame:
    """FX11 as rows: seconds between a forward packet and the reply directly after it."""
    return assigned.where(is_response()).select(
        "seq", "start_us", "start_seq", (F.col("gap_us") / MICROS).alias("response_time")
    )
