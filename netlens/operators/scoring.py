"""Preparing and scoring flow rows of any provenance (ST3-ST10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions.lineage import cut_lineage
from netlens.functions.numbers import clean_double
from netlens.operators.metrics import at_threshold

# Flow record names and the headers of the training tables.
COLUMN_ALIASES = {
    "flow_id": "Flow ID",
    "src_ip": "Src IP",
    "dst_ip": "Dst IP",
    "src_port": "Src Port",
    "dst_port": "Dst Port",
    "protocol": "Protocol",
    "timestamp": "Timestamp",
    "flow_duration": "Flow Duration",
    "flow_byts_s": "Flow Bytes/s",
    "flow_pkts_s": "Flow Packets/s",
    "fwd_pkts_s": "Fwd Packets/s",
    "bwd_pkts_s": "Bwd Packets/s",
    "tot_fwd_pkts": "Total Fwd Packet",
    "tot_bwd_pkts": "Total Bwd packets",
    "totlen_fwd_pkts": "Total Length of Fwd Packet",
    "totlen_bwd_pkts": "Total Length of Bwd Packet",
    "fwd_pkt_len_max": "Fwd Packet Length Max",
    "fwd_pkt_len_min": "Fwd Packet Length Min",
    "fwd_pkt_len_mean": "Fwd Packet Length Mean",
    "fwd_pkt_len_std": "Fwd Packet Length Std",
    "bwd_pkt_len_max": "Bwd Packet Length Max",
    "bwd_pkt_len_min": "Bwd Packet Length Min",
    "bwd_pkt_len_mean": "Bwd Packet Length Mean",
    "bwd_pkt_len_std": "Bwd Packet Length Std",
    "pkt_len_max": "Packet Length Max",
    "pkt_len_min": "Packet Length Min",
    "pkt_len_mean": "Packet Length Mean",
    "pkt_len_std": "Packet Length Std",
    "pkt_len_var": "Packet Length Variance",
    "fwd_header_len": "Fwd Header Length",
    "bwd_header_len": "Bwd Header Length",
    "fwd_seg_size_min": "Fwd Seg Size Min",
    "fwd_act_data_pkts": "Fwd Act Data Pkts",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "flow_iat_std": "Flow IAT Std",
    "fwd_iat_tot": "Fwd IAT Total",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "bwd_iat_tot": "Bwd IAT Total",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "fin_flag_cnt": "FIN Flag Count",
    "syn_flag_cnt": "SYN Flag Count",
    "rst_flag_cnt": "RST Flag Count",
    "psh_flag_cnt": "PSH Flag Count",
    "ack_flag_cnt": "ACK Flag Count",
    "urg_flag_cnt": "URG Flag Count",
    "ece_flag_cnt": "ECE Flag Count",
    "cwr_flag_count": "CWR Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "pkt_size_avg": "Average Packet Size",
    "init_fwd_win_byts": "FWD Init Win Bytes",
    "init_bwd_win_byts": "Bwd Init Win Bytes",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "fwd_byts_b_avg": "Fwd Bytes/Bulk Avg",
    "fwd_pkts_b_avg": "Fwd Packet/Bulk Avg",
    "bwd_byts_b_avg": "Bwd Bytes/Bulk Avg",
    "bwd_pkts_b_avg": "Bwd Packet/Bulk Avg",
    "fwd_blk_rate_avg": "Fwd Bulk Rate Avg",
    "bwd_blk_rate_avg": "Bwd Bulk Rate Avg",
    "fwd_seg_size_avg": "Fwd Segment Size Avg",
    "bwd_seg_size_avg": "Bwd Segment Size Avg",
    "subflow_fwd_pkts": "Subflow Fwd Packets",
    "subflow_bwd_pkts": "Subflow Bwd Packets",
    "subflow_fwd_byts": "Subflow Fwd Bytes",
    "subflow_bwd_byts": "Subflow Bwd Bytes",
    "label": "Label",
    "attack_name": "Attack Name",
}


def rename_columns(df: DataFrame) -> DataFrame:
    """ST3: record names to training headers; a column stays if its header exists."""
    taken, out = set(df.columns), []
    for c in df.columns:
        alias = COLUMN_ALIASES.get(c.lower())
        if alias is not None and alias not in taken:
            taken.add(alias)
            out.append(F.col(f"`{c}`").alias(alias))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def label_name(columns: Sequence[str], label: str) -> str | None:
    """ST4: the label column, by exact name or else in any case."""
    if label in columns:
        return label
    return next((c for c in columns if c.lower() == label.lower()), None)


def drop_label(df: DataFrame, label: str) -> DataFrame:
    name = label_name(df.columns, label)
    return df if name is None else df.select(*[F.col(f"`{c}`") for c in df.columns if c != name])


def prepare_features(
    df: DataFrame, expected: Sequence[str], label: str = "label", keep: Sequence[str] = (), prefix: str = "keep_"
) -> DataFrame:
    """ST3-ST6: expected columns in training order, numbers or NULL.

    ``keep`` columns of the input travel along under a prefix, so that names of
    features and kept columns cannot collide.
    """
    kept = [F.col(f"`{c}`").alias(f"{prefix}{c}") if c in df.columns else F.lit(None).cast("string").alias(f"{prefix}{c}") for c in keep]
    carried = df.select("*", *kept)
    named = drop_label(rename_columns(carried), label)
    known = set(named.columns)
    cells = [
        clean_double(F.col(f"`{c}`").cast("string") if dict(named.dtypes)[c] == "boolean" else F.col(f"`{c}`")).alias(c)
        if c in known
        else F.lit(None).cast("double").alias(c)
        for c in expected
    ]
    return named.select(*[F.col(f"`{prefix}{c}`") for c in keep], *cells)


def schema_summary(df: DataFrame, expected: Sequence[str], label: str = "label") -> DataFrame:
    """ST8: one row with matched and expected counts, missing and extra columns, and the rows at hand."""
    actual = drop_label(rename_columns(df), label).columns
    missing = [c for c in expected if c not in actual]
    extra = [c for c in actual if c not in set(expected)]
    names = lambda cols: F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(expected) - len(missing)).alias("matched_count"),
        F.lit(len(expected)).alias("expected_count"),
        names(missing).alias("missing"),
        names(extra).alias("extra"),
    )


def score_flows(df: DataFrame, bundle, label: str = "label", threshold: float | None = None, per_batch_bounds: bool = False) -> DataFrame:
    """ST9: the input rows with ``score`` and ``prediction``.

    Models that search neighbours need an id per row; one is made when the input
    has none.
    """
    if "id" not in df.columns:
        # ids of one frozen copy: neighbour searches read the rows more than once
        df = df.withColumn("id", F.monotonically_increasing_id())
        if bundle.model.kind == "neighbours":
            df = cut_lineage(df)
    limit = bundle.threshold if threshold is None else threshold
    ready = prepare_features(df, bundle.expected_columns, label, keep=df.columns)
    if bundle.preprocessor is None:  # a bare ML pipeline assembles its own inputs
        scored = bundle.model.score(ready)
        kept = [F.col(f"`keep_{c}`").alias(c) for c in df.columns]
        return scored.select(*kept, "score", at_threshold(F.col("score"), limit).alias("prediction"))
    packed = bundle.preprocessor.transform(ready, [F.col(f"`keep_{c}`").alias(c) for c in df.columns], vector=False)
    scored = bundle.model.score(packed, per_batch_bounds)
    return scored.drop("features").withColumn("prediction", at_threshold(F.col("score"), limit))
