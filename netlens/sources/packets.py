"""Packet tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("header_len", T.IntegerType()),
        T.StructField("payload_len", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
    ]
)

TCP, UDP = 6, 17
MARK = 0  # protocol of rows that only tell a stream the time


def tcp_udp(packets: DataFrame) -> DataFrame:
    """FA1: only TCP and UDP packets take part; reaches the scan as a pushed filter."""
    return packets.where(F.col("protocol").isin(TCP, UDP))


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", per_file: bool = False) -> DataFrame:
    """IO2-IO4: one capture or a directory of captures.

    With ``per_file`` every row carries its file, which then belongs to the flow
    key, so flow state does not cross captures.
    """
    reader = spark.read.schema(PACKET_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    if per_file:
        df = df.select("*", F.col("_metadata.file_path").alias("source_file"))
    return tcp_udp(df)


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """IO5: packets as files land in a directory; time marks pass."""
    reader = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).where(F.col("protocol").isin(TCP, UDP, MARK))


def with_micros(packets: DataFrame) -> DataFrame:
    """Adds ``us`` (integer microseconds) unless the table already has it."""
    if "us" in packets.columns:
        return packets
    return packets.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def with_flow_key(packets: DataFrame) -> DataFrame:
    """FA2: direction-free endpoint pair, and ``d`` = packet runs from low to high end."""
    low_first = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port"))
    )
    return packets.select(
        "*",
        low_first.alias("d"),
        F.when(low_first, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("lo_ip"),
        F.when(low_first, F.col("src_port")).otherwise(F.col("dst_port")).alias("lo_port"),
        F.when(low_first, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("hi_ip"),
        F.when(low_first, F.col("dst_port")).otherwise(F.col("src_port")).alias("hi_port"),
    )
