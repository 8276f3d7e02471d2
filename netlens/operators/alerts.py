"""Alerts from scored flows (ST11-ST15)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of an alert and the numbers of ports it lists.
ALERT_COLUMNS = """
logged_at flow_timestamp prediction score threshold src_ip src_port dst_ip dst_port protocol model_name
sampling_strategy flow_count unique_src_ports unique_dst_ports max_score
""".split()
LISTED_SRC_PORTS, LISTED_DST_PORTS = 8, 12


@dataclass(frozen=True)
class AlertColumns:
    """Names of the identifying columns in the flow table."""

    src_ip: str = "src_ip"
    dst_ip: str = "dst_ip"
    src_port: str = "src_port"
    dst_port: str = "dst_port"
    protocol: str = "protocol"
    timestamp: str = "timestamp"

    def get(self, df: DataFrame, name: str) -> Column:
        column = getattr(self, name)
        return F.col(f"`{column}`") if column in df.columns else F.lit("")


def attack_groups(scored: DataFrame, order: Sequence[str], columns: AlertColumns | None = None) -> DataFrame:
    """ST11: attacks per (source, destination, protocol).

    ``order`` is the arrival order, which decides the row a group shows. Port
    lists are sets of at most 65,536 texts and combine before the shuffle.
    """
    c = columns or AlertColumns()
    ports = lambda n: F.array_sort(
        F.collect_set(F.nullif(c.get(scored, n).cast("string"), F.lit("")))
    )
    first = F.struct(*order)
    return (
        scored.where("prediction = 1")
        .groupBy(*[c.get(scored, n).alias(n) for n in ("src_ip", "dst_ip", "protocol")])
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.max("score").alias("max_score"),
            ports("src_port").alias("src_ports"),
            ports("dst_port").alias("dst_ports"),
            F.min_by(c.get(scored, "timestamp"), first).alias("flow_timestamp"),
            F.min(first).alias("first_seen"),
        )
    )


def _finish(rows: DataFrame, threshold: float, metadata: dict, missing: str) -> DataFrame:
    stamped = rows.withColumns(
        {
            "logged_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
            "threshold": F.lit(float(threshold)),
            "model_name": F.lit(metadata.get("model_name", missing)),
            "sampling_strategy": F.lit(metadata.get("sampling_strategy", missing)),
        }
    )
    return stamped.select(*ALERT_COLUMNS)


def grouped_alerts(
    scored: DataFrame, order: Sequence[str], threshold: float, metadata: dict, columns: AlertColumns | None = None
) -> DataFrame:
    """ST12: one alert row per group, in order of first appearance."""
    groups = attack_groups(scored, order, columns).orderBy("first_seen")
    src = F.array_join(F.slice("src_ports", 1, LISTED_SRC_PORTS), ",")
    dst = F.array_join(F.slice("dst_ports", 1, LISTED_DST_PORTS), ",")
    rows = groups.select(
        "flow_timestamp", "src_ip", "dst_ip", "protocol", "flow_count", "max_score",
        F.lit(1).alias("prediction"), F.col("max_score").alias("score"),
        src.alias("src_port"), dst.alias("dst_port"),
        src.alias("unique_src_ports"), dst.alias("unique_dst_ports"),
    )
    return _finish(rows, threshold, metadata, "unknown")


def flow_alerts(
    scored: DataFrame, threshold: float, metadata: dict, log_all: bool = False, columns: AlertColumns | None = None
) -> DataFrame:
    """ST13: one alert row per attack, or per flow with ``log_all``."""
    c = columns or AlertColumns()
    kept = scored if log_all else scored.where("prediction = 1")
    src, dst = c.get(kept, "src_port").cast("string"), c.get(kept, "dst_port").cast("string")
    rows = kept.select(
        c.get(kept, "timestamp").alias("flow_timestamp"),
        *[c.get(kept, n).alias(n) for n in ("src_ip", "dst_ip", "protocol")],
        "prediction", "score", src.alias("src_port"), dst.alias("dst_port"),
        F.lit(1).cast("bigint").alias("flow_count"),
        src.alias("unique_src_ports"), dst.alias("unique_dst_ports"), F.col("score").alias("max_score"),
    )
    return _finish(rows, threshold, metadata, "")


def benign_count(scored: DataFrame) -> DataFrame:
    """ST14."""
    return scored.agg(F.count_if(F.col("prediction") == 0).alias("benign_flows"))
