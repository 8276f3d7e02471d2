"""Real-time scoring of a growing flow table (ST1, ST2, ST9-ST15, IO8-IO10)."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from netlens.functions.lineage import cut_lineage, path_exists, scratch
from netlens.operators.alerts import AlertColumns, benign_count, flow_alerts, grouped_alerts
from netlens.operators.features import FLOW_COLUMNS
from netlens.operators.scoring import score_flows
from netlens.plans.bundle import Bundle, read_document, write_document

TEXT_COLUMNS = {"src_ip", "dst_ip", "timestamp"}


def flow_schema(columns: Sequence[str] = tuple(FLOW_COLUMNS)) -> T.StructType:
    """Schema of flow rows in text files; numbers that do not parse become NULL later on."""
    whole = {"src_port", "dst_port", "protocol"}
    kinds = {c: T.StringType() if c in TEXT_COLUMNS else T.LongType() if c in whole else T.DoubleType() for c in columns}
    return T.StructType([T.StructField(c, t) for c, t in kinds.items()])


def stream_flows(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None, max_files: int = 1000
) -> DataFrame:
    """IO8: flow rows of files that land in a directory; names starting with ``_`` are not read.

    ``file_time`` and ``file_name`` give the arrival order of files.
    """
    reader = spark.readStream.schema(schema or flow_schema()).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    return reader.format(fmt).load(path).select(
        "*",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_name").alias("file_name"),
    )


@dataclass
class AlertStream:
    """Scores new rows and appends alerts.

    ``out`` gets one folder per batch, overwritten when a batch is repeated, so a
    restart neither loses nor doubles alerts.
    """

    bundle: Bundle
    out: str
    threshold: float | None = None
    label: str = "label"
    group_attacks: bool = True
    log_all: bool = False
    count_benign: bool = False
    columns: AlertColumns = field(default_factory=AlertColumns)
    order: tuple[str, ...] = ("file_time", "file_name", "file_place", "row_place")
    fmt: str = "parquet"

    def __post_init__(self):
        self.limit = self.bundle.threshold if self.threshold is None else float(self.threshold)  # ST10
        if self.limit <= 0:
            warnings.warn("Threshold <= 0 makes almost every flow an attack.", stacklevel=2)

    def alerts(self, scored: DataFrame) -> DataFrame:
        if self.group_attacks:
            order = [c for c in self.order if c in scored.columns]
            return grouped_alerts(scored, order, self.limit, self.bundle.metadata, self.columns)
        return flow_alerts(scored, self.limit, self.bundle.metadata, self.log_all, self.columns)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("row_place", F.monotonically_increasing_id())
        with scratch(spark):
            scored = score_flows(batch, self.bundle, self.label, self.limit)
            if self.count_benign and self.group_attacks:
                scored = cut_lineage(scored)
                benign_count(scored).write.mode("overwrite").parquet(f"{self.out}-benign/batch_id={batch_id}")
            writer = self.alerts(scored).write.mode("overwrite")
            writer = writer.option("header", True) if self.fmt == "csv" else writer
            writer.format(self.fmt).save(f"{self.out}/batch_id={batch_id}")

    def benign(self, spark: SparkSession) -> int:
        """Benign flows counted so far, in the table beside the alerts."""
        return spark.read.parquet(f"{self.out}-benign").agg(F.sum("benign_flows")).first()[0]

    def start(
        self, flows: DataFrame, checkpoint: str, tail: bool = False, reset: bool = False, **trigger
    ) -> StreamingQuery:
        """ST1, ST2, IO9: resume from the checkpoint.

        ``reset`` starts over in a new place below it; ``tail`` skips rows of files
        older than the first start, which is remembered with the checkpoint. A table
        that grows in place (``sources.growing``) has a ``tail`` of its own.
        """
        spark = flows.sparkSession
        current = f"{checkpoint}/current"
        if reset or not path_exists(spark, current):
            now = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
            write_document(spark, {"run": uuid.uuid4().hex, "started_us": now}, current)
        run = read_document(spark, current)
        if tail:
            flows = flows.where(F.unix_micros("file_time") > run["started_us"])
        writer = flows.writeStream.foreachBatch(self.process)
        writer = writer.option("checkpointLocation", f"{checkpoint}/{run['run']}")
        return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()
