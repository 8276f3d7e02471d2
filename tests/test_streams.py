"""Streams equal the batch results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens import FlowParams
from netlens.operators.alerts import ALERT_COLUMNS
from netlens.operators.features import FLOW_COLUMNS, flow_records
from netlens.operators.models import fit_model
from netlens.operators.prep import fit_preprocessor
from netlens.plans.bundle import Bundle
from netlens.sources.packets import PACKET_SCHEMA, stream_packets
from netlens.streaming.alerts import AlertStream, flow_schema, stream_flows
from netlens.streaming.flows import FlowStream, late_packets, session_totals, walk
from tests.packets import A, B, frame, packet, sequential
from tests.test_flows import random_packets


def land(df, folder, name):
    """One file that appears at once."""
    df.coalesce(1).write.mode("append").parquet(f"{folder}")


def timed(spark, rows):
    df = frame(spark, rows)
    return df.withColumn("ts", F.timestamp_micros("us")).select(PACKET_SCHEMA.fieldNames())


def key(df):
    rows = df.select(FLOW_COLUMNS).collect()
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


def started(stream, spark, tmp_path, **source):
    query = stream.start(stream_packets(spark, f"{tmp_path}/in", **source), f"{tmp_path}/checkpoint", availableNow=True)
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path):
    p = FlowParams(idle_s=5, cap_s=12)
    rows = sorted(random_packets(11, 300), key=lambda r: r[1])
    stream = FlowStream(f"{tmp_path}/out", p)
    for i in range(3):  # a restart between the files
        land(timed(spark, rows[100 * i : 100 * i + 100]), f"{tmp_path}/in", i)
        started(stream, spark, tmp_path, max_files=1)
    before = spark.read.parquet(f"{tmp_path}/out").count()
    stream.end_of_input(spark, f"{tmp_path}/in", rows[-1][1])
    started(stream, spark, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert 0 < before < got.count()
    assert key(got) == key(flow_records(timed(spark, rows), p))


def test_late_packets_join_open_flows_or_are_dropped_and_counted(spark, tmp_path):
    rows = [packet(1, 100), packet(2, 104), packet(3, 112, B, A), packet(4, 102), packet(5, 140), packet(6, 101)]
    stream = FlowStream(f"{tmp_path}/out", FlowParams(), delay_s=10)
    dropped = 0
    for k, part in enumerate([rows[:3], rows[3:4], rows[4:5], rows[5:]]):  # the fourth is late but open, the sixth too late
        land(timed(spark, part), f"{tmp_path}/in", k)
        dropped += late_packets(started(stream, spark, tmp_path))
    stream.end_of_input(spark, f"{tmp_path}/in", rows[4][1])
    dropped += late_packets(started(stream, spark, tmp_path))
    assert dropped == 1
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(flow_records(timed(spark, rows[:5]), FlowParams()))


@pytest.mark.parametrize("seed", range(4))
def test_walk_over_slices_equals_the_sequential_meter(seed):
    rng = random.Random(seed)
    p = FlowParams(idle_s=5, cap_s=12)
    times = sorted(round(rng.choice([rng.uniform(0, 90), rng.randrange(90)]) * 1_000_000) for _ in range(120))
    want = sequential([packet(k, t / 1_000_000) for k, t in enumerate(times)], p)
    width, flow, closed = 7_000_000, None, []
    for number in range(times[-1] // width + 1):
        at = [k for k, t in enumerate(times) if t // width == number]
        if at:
            done, flow = walk(flow, number, np.array([times[k] for k in at]), np.array(at), p.idle_us, p.cap_us)
            closed += done
    got = {}
    for f in [*closed, *([flow] if flow else [])]:
        for number, _, start, a_us, a, b_us, b in f.places():
            for k in range(a, b + 1):
                assert times[k] // width == number and a_us <= times[k] <= b_us
                got[k] = start
    assert got == {k: v[0] for k, v in want.items()}


def test_a_stream_needs_a_cap():
    with pytest.raises(ValueError, match="cap"):
        FlowStream("out", FlowParams(cap_s=None))


def test_session_totals(spark, tmp_path):
    rows = [packet(1, 0), packet(2, 5, B, A), packet(3, 10.000001), packet(4, 100)]
    land(timed(spark, rows), f"{tmp_path}/in", 0)
    source = stream_packets(spark, f"{tmp_path}/in")
    query = (
        session_totals(source).writeStream.format("memory").queryName("sessions").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted((r.packets, r.bytes) for r in spark.table("sessions").collect()) == [(1, 60), (2, 120)]


@pytest.fixture(scope="module")
def bundle(spark):
    rng = random.Random(2)
    rows = [(i, float(i % 2), i % 2, rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, `Flow Duration` double, y int, `Flow Packets/s` double")
    prep = fit_preprocessor(df, exclude=["id", "y"])
    fitted = fit_model("logistic_regression", "baseline", prep.transform(df, ["id", "y"], vector=False))
    return Bundle(fitted, prep, 0.5, {"model_name": "logistic_regression", "sampling_strategy": "baseline"})


def flow_rows(spark, rows):
    names = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp", "flow_duration", "LABEL"]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port long, dst_port long, protocol long, timestamp string, flow_duration string, LABEL string")
    assert df.columns == names
    return df


def test_alert_stream(spark, tmp_path, bundle):
    attack = [("a", "b", 100 + i, 80 + i, 6, "t0", "1.0", "x") for i in range(20)]
    other = [("c", "b", 1, 2, 6, "t1", "inf", "x"), ("c", "b", 1, 2, 6, "t1", "0.0", "x"), ("d", "b", 1, 2, 17, "t2", "1.0", "x")]
    folder = f"{tmp_path}/in"
    flow_rows(spark, attack + other).coalesce(1).write.option("header", True).mode("append").csv(folder)
    source = stream_flows(spark, folder, schema=flow_rows(spark, attack).schema)
    stream = AlertStream(bundle, f"{tmp_path}/out", count_benign=True)
    stream.start(source, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("src_ip").collect()
    assert [c for c in spark.read.parquet(f"{tmp_path}/out").columns if c != "batch_id"] == ALERT_COLUMNS
    assert [r.src_ip for r in got if r.flow_count > 1] == ["a"]
    top = got[0]
    assert (top.flow_count, top.protocol, top.prediction, top.flow_timestamp) == (20, 6, 1, "t0")
    assert top.unique_src_ports == ",".join(str(100 + i) for i in range(8)) == top.src_port
    assert top.unique_dst_ports == ",".join(sorted(str(80 + i) for i in range(20))[:12])
    assert top.model_name == "logistic_regression" and top.score == top.max_score >= 0.5
    assert stream.benign(spark) >= 1
    # nothing new after a restart; then one more file
    stream.start(source, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)
    flow_rows(spark, attack[:1]).coalesce(1).write.option("header", True).mode("append").csv(folder)
    stream.start(source, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got) + 1
    # reset reads everything again
    again = AlertStream(bundle, f"{tmp_path}/again")
    again.start(source, f"{tmp_path}/checkpoint", reset=True, availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/again").agg(F.sum("flow_count")).first()[0] >= 21
    # tail skips what was there before
    tail = AlertStream(bundle, f"{tmp_path}/tail")
    tail.start(source, f"{tmp_path}/tail-checkpoint", tail=True, availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/tail").count() == 0


def test_alerts_per_flow(spark, tmp_path, bundle):
    rows = flow_rows(spark, [("a", "b", 1, 2, 6, "t", "1.0", "x"), ("a", "b", 1, 2, 6, "t", "0.0", "x"), ("a", "b", 1, 2, 6, "t", "oops", "x")])
    AlertStream(bundle, f"{tmp_path}/all", group_attacks=False, log_all=True).process(rows, 0)
    got = spark.read.parquet(f"{tmp_path}/all").collect()
    assert len(got) == 3 and {r.flow_count for r in got} == {1} and {r.src_port for r in got} == {"1"}
    AlertStream(bundle, f"{tmp_path}/some", threshold=0.9999, group_attacks=False).process(rows, 0)
    assert spark.read.parquet(f"{tmp_path}/some").count() <= 1
    with pytest.warns(UserWarning):
        AlertStream(bundle, f"{tmp_path}/none", threshold=0.0)


def test_csv_flow_schema():
    names = {f.name: f.dataType.simpleString() for f in flow_schema().fields}
    assert list(names) == FLOW_COLUMNS and names["src_ip"] == "string" and names["flow_duration"] == "double"
