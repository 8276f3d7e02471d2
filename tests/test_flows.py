"""Flow assembly and the 82 statistics on hand-written packets."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from netlens import FlowParams
from netlens.operators import extended
from netlens.operators.extended import extended_records, first_lengths, response_times
from netlens.operators.features import FLOW_COLUMNS, flow_records
from netlens.operators.flows import assign_flows, with_balanced_slices
from netlens.sources.packets import PACKET_SCHEMA, read_packets
from tests.packets import A, B, frame, packet, sequential


def records(spark, rows, p=None, fields=None):
    found = flow_records(frame(spark, rows), p, fields, keep_start=True).collect()
    return sorted(found, key=lambda r: (r["start_us"], r["start_seq"]))


def test_handshake(spark):
    rows = [
        packet(1, 0.0, A, B, length=60, flags="S", window=1000),
        packet(2, 0.5, B, A, length=80, flags="SA", window=2000),
        packet(3, 1.5, A, B, length=52, flags="A", window=3000),
    ]
    (r,) = records(spark, rows)
    assert list(r.asDict())[2:] == FLOW_COLUMNS
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol) == (A[0], B[0], A[1], B[1], 6)
    assert r.timestamp == "1970-01-01 00:00:00"
    assert r.flow_duration == 1.5 and r.flow_byts_s == 192 / 1.5 and r.flow_pkts_s == 2.0
    assert (r.tot_fwd_pkts, r.tot_bwd_pkts, r.totlen_fwd_pkts, r.totlen_bwd_pkts) == (2, 1, 112, 80)
    assert (r.fwd_pkt_len_max, r.fwd_pkt_len_min, r.fwd_pkt_len_mean, r.fwd_pkt_len_std) == (60, 52, 56.0, 4.0)
    assert (r.flow_iat_mean, r.flow_iat_max, r.flow_iat_min, r.flow_iat_std) == (0.75, 1.0, 0.5, 0.25)
    assert r.fwd_iat_tot == 0 and r.fwd_iat_max == 0  # one gap is not enough
    assert (r.syn_flag_cnt, r.ack_flag_cnt, r.fin_flag_cnt) == (2, 2, 0)
    assert (r.init_fwd_win_byts, r.init_bwd_win_byts) == (1000, 2000)
    assert r.down_up_ratio == 0.5 and r.pkt_size_avg == 64.0
    assert r.fwd_header_len == 40 and r.fwd_seg_size_min == 20
    assert r.subflow_fwd_byts == 112 and r.fwd_seg_size_avg == 56.0


def test_parity_counts_first_packet_twice(spark):
    rows = [packet(1, 0, A, B, flags="SU"), packet(2, 1, B, A), packet(3, 2, A, B)]
    (r,) = records(spark, rows, FlowParams(parity=True))
    assert (r.tot_fwd_pkts, r.tot_bwd_pkts, r.syn_flag_cnt) == (3, 1, 1 + 1)
    assert r.flow_iat_min == 0.0 and r.flow_iat_mean == pytest.approx(2 / 3)
    assert r.fwd_iat_tot == 2.0 and r.fwd_iat_min == 0.0
    assert r.cwr_flag_count == r.fwd_urg_flags == 2
    assert r.idle_max == 0


def test_single_packet(spark):
    (r,) = records(spark, [packet(1, 5.0, length=100)])
    assert r.flow_duration == 0 and r.flow_byts_s == 0 and r.flow_pkts_s == 0
    assert r.bwd_pkt_len_max == 0 and r.pkt_len_std == 0 and r.flow_iat_mean == 0


def test_idle_gap_is_exclusive(spark):
    at = FlowParams().idle_s
    assert len(records(spark, [packet(1, 0), packet(2, at)])) == 1
    assert len(records(spark, [packet(1, 0), packet(2, at + 1e-6)])) == 2


@pytest.mark.parametrize("slice_s", [None, 7, 90])
def test_duration_cap_restarts_the_clock(spark, slice_s):
    rows = [packet(i, 4.0 * i) for i in range(51)]  # 0 ... 200 s
    found = records(spark, rows, FlowParams(slice_s=slice_s))
    assert [(r.start_us / 1e6, r.flow_duration) for r in found] == [(0, 92.0), (96, 92.0), (192, 8.0)]


@pytest.mark.parametrize("n,bulks", [(3, 0), (4, 1), (5, 1)])
def test_bulk_length(spark, n, bulks):
    rows = [packet(i, 0.5 * i, payload=10) for i in range(n)]
    (r,) = records(spark, rows)
    assert r.fwd_byts_b_avg == 10 * n * bulks and r.fwd_pkts_b_avg == n * bulks
    assert r.fwd_blk_rate_avg == (10 * n / (0.5 * (n - 1)) if bulks else 0)
    assert r.bwd_byts_b_avg == 0


def test_bulk_is_interrupted(spark):
    other_way = [packet(i, 0.1 * i, payload=10) for i in range(3)] + [packet(3, 0.3, B, A, payload=1)]
    rows = other_way + [packet(i, 0.1 * i, payload=10) for i in range(4, 7)]
    assert records(spark, rows)[0].fwd_pkts_b_avg == 0
    no_payload = [packet(i, 0.1 * i, *((B, A) if i == 2 else (A, B)), payload=0 if i == 2 else 10) for i in range(5)]
    assert records(spark, no_payload)[0].fwd_pkts_b_avg == 4
    pause = [packet(i, 0.1 * i + (2 if i > 1 else 0), payload=10) for i in range(4)]
    assert records(spark, pause)[0].fwd_pkts_b_avg == 0


def test_bulk_does_not_cross_flows(spark):
    p = FlowParams(cap_s=2, idle_s=5, clump_s=5)
    rows = [packet(i, float(i), payload=10) for i in range(6)]  # flows 0-2 and 3-5
    assert [r.fwd_pkts_b_avg for r in records(spark, rows, p)] == [0, 0]
    assert [r.fwd_pkts_b_avg for r in records(spark, rows, replace(p, bulk_bound=3))] == [3, 3]


def test_reply_only_segment(spark):
    rows = [packet(1, 0, A, B), packet(2, 10, B, A, header=24)]
    first, second = records(spark, rows)
    assert first.src_ip == A[0] and second.src_ip == B[0] and second.fwd_seg_size_min == 24


def test_fin_does_not_close(spark):
    rows = [packet(1, 0, flags="S"), packet(2, 1, flags="FA"), packet(3, 2, flags="A"), packet(4, 3, B, A, flags="FA")]
    (r,) = records(spark, rows)
    assert (r.tot_fwd_pkts, r.tot_bwd_pkts, r.fin_flag_cnt) == (3, 1, 2)


def test_protocol_in_key(spark):
    rows = [packet(1, 0, proto=6), packet(2, 1, proto=17), packet(3, 2, proto=1)]
    assert len(records(spark, rows)) == 2
    (merged,) = records(spark, rows, FlowParams(parity=True))
    assert merged.protocol == 6


def test_first_nonzero_window(spark):
    rows = [packet(1, 0, window=0), packet(2, 1, window=0), packet(3, 2, window=512), packet(4, 3, window=9)]
    (r,) = records(spark, rows)
    assert r.init_fwd_win_byts == 512 and r.init_bwd_win_byts == 0
    (udp,) = records(spark, [packet(1, 0, proto=17)])
    assert udp.init_fwd_win_byts == 0


def test_self_talk_is_forward(spark):
    (r,) = records(spark, [packet(1, 0, A, A), packet(2, 1, A, A)])
    assert (r.tot_fwd_pkts, r.tot_bwd_pkts) == (2, 0)


def test_equal_times_follow_seq(spark):
    rows = [packet(3, 1, B, A, window=7), packet(1, 1, A, B, window=5), packet(2, 1, A, B, window=6)]
    (r,) = records(spark, rows)
    assert r.src_ip == A[0] and r.init_fwd_win_byts == 5 and r.flow_duration == 0


def test_active_and_idle(spark):
    p = FlowParams(idle_s=20, active_s=5)
    rows = [packet(i, t) for i, t in enumerate([0, 1, 2, 10, 11, 25, 26, 40])]
    (r,) = records(spark, rows, p)
    # gaps 8, 14, 14 end runs of 2, 1 and 1 seconds
    assert (r.idle_max, r.idle_min, r.idle_mean) == (14, 8, 12)
    assert (r.active_max, r.active_min) == (2, 1) and r.active_mean == pytest.approx(4 / 3)


def test_field_selection(spark):
    got = flow_records(frame(spark, [packet(1, 0)]), None, ["tot_bwd_pkts", " src_ip", "nothing"])
    assert got.columns == ["src_ip", "tot_bwd_pkts"]


def test_extended(spark):
    rows = [
        packet(1, 0, A, B, length=10, ttl=33),
        packet(2, 1, B, A, length=10),
        packet(3, 2, A, B, length=40),
        packet(4, 4, B, A, length=20),
    ]
    assigned = assign_flows(frame(spark, rows))
    (r,) = extended_records(assigned).collect()
    assert (r.bytes_sent, r.bytes_received, r.sent_rate) == (50, 30, 12.5)
    assert (r.header_in_out_ratio, r.initial_ttl, r.pkt_len_median, r.pkt_len_mode) == (1.0, 33, 15.0, 10.0)
    assert r.pkt_len_skew == pytest.approx(3 * (20 - 15) / 150**0.5)
    assert (r.response_mean, r.response_median, r.response_mode) == (1.5, 1.5, 1.0)
    assert sorted(x.response_time for x in response_times(assigned).collect()) == [1.0, 2.0]
    assert first_lengths(assigned, n=3).first().first_lengths == [10, 10, 40]
    (lone,) = extended_records(assign_flows(frame(spark, rows[:1]))).collect()
    assert lone.response_mean == -1 and lone.response_cov == 1 and lone.response_median is None
    assert lone.pkt_len_skew == -10 and lone.sent_rate == -1


def test_extended_orders_asked_values_only(spark, monkeypatch):
    """fx06 needs lengths; times and gaps, nearly all different, are neither counted nor written for it."""
    rows = [packet(1, 0, A, B, length=10), packet(2, 1, B, A, length=10), packet(3, 2, A, B, length=40), packet(4, 900, A, B, length=7)]
    assigned = assign_flows(frame(spark, rows))
    assigned = assigned.withColumn("length", F.when(F.col("seq") < 4, F.col("length")))  # a flow without lengths and replies
    ordered, plain = [], extended.medians_and_modes
    monkeypatch.setattr(extended, "medians_and_modes", lambda df, flow, values: ordered.append(set(values)) or plain(df, flow, values))
    whole = {r.start_seq: r.asDict() for r in extended_records(assigned).collect()}
    assert len(whole) == 2 and ordered == [{"pkt_len", "pkt_time", "response"}]
    for spreads in ([], ["pkt_len"], ["pkt_time"], ["response"]):
        some = extended_records(assigned, None, spreads)
        got = {r.start_seq: r.asDict() for r in some.collect()}
        assert got == {k: {c: v for c, v in r.items() if c in some.columns} for k, r in whole.items()}
        assert {c.rpartition("_")[0] for c in some.columns if c.endswith("_skew2")} == set(spreads)
    assert ordered[1:] == [{"pkt_len"}, {"pkt_time"}, {"response"}]


def test_late_packet_in_arrival_order(spark):
    rows = [packet(1, 0), packet(2, 4), packet(3, 1), packet(4, 5)]
    (r,) = records(spark, rows, FlowParams(arrival_gaps=True))
    assert (r.flow_iat_min, r.flow_iat_max, r.fwd_iat_min, r.fwd_iat_max) == (-3.0, 4.0, -3.0, 4.0)
    (r,) = records(spark, rows)
    assert (r.flow_iat_min, r.flow_iat_max) == (1.0, 3.0)


def test_balanced_slices(spark):
    rows = [packet(i, i * 0.01) for i in range(1000)]
    p = with_balanced_slices(frame(spark, rows), FlowParams(cap_s=3), rows=60)
    assert p.slice_us < 1_000_000
    assert [r.tot_fwd_pkts for r in records(spark, rows, p)] == [301, 301, 301, 97]


def test_scan_is_pruned(spark, tmp_path):
    frame(spark, [packet(1, 0), packet(2, 1)]).withColumn("ts", F.timestamp_micros("us")).drop("us").write.parquet(f"{tmp_path}/p")
    df = flow_records(read_packets(spark, f"{tmp_path}/p"), FlowParams(cap_s=None), ["tot_fwd_pkts"])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    scans = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    filters = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert scans and all("In(protocol" in f for f in filters)
    for unused in ("length:", "tcp_flags:", "header_len:", "ttl:", "tcp_window:"):
        assert not any(unused in s for s in scans), unused


def random_packets(seed, n):
    rng = random.Random(seed)
    ends = [(f"10.0.0.{i}", 1000 + i % 2) for i in range(3)]
    hot = (ends[0], ends[1])
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0, 0, 0.001, 0.5, 1, 2, 4.9, 5.0, 6])
        src, dst = hot if rng.random() < 0.6 else rng.sample(ends, 2)
        if rng.random() < 0.4:
            src, dst = dst, src
        rows.append(packet(i, t, src, dst, proto=rng.choice([6, 6, 6, 17, 1]), payload=rng.choice([0, 5])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "p",
    [
        FlowParams(idle_s=5, cap_s=12),
        FlowParams(idle_s=5, cap_s=12, slice_s=1),
        FlowParams(idle_s=30, cap_s=3),
        FlowParams(idle_s=5, cap_s=None),
        FlowParams(idle_s=6, cap_s=40, parity=True),
    ],
    ids=str,
)
def test_against_sequential_meter(spark, p):
    rows = random_packets(7, 800)
    want = sequential(rows, p)
    got = {
        r.seq: (r.start_seq, r.fwd, r.gap_us, r.dir_gap_us)
        for r in assign_flows(frame(spark, rows), p).select("seq", "start_seq", "fwd", "gap_us", "dir_gap_us").collect()
    }
    assert got == want


def test_read_per_file_and_merged(spark, tmp_path):
    names = PACKET_SCHEMA.fieldNames()
    rows = frame(spark, [packet(1, 0), packet(2, 1), packet(3, 2, proto=1)])
    rows = rows.withColumn("ts", rows.us.cast("double").__truediv__(1e6).cast("timestamp")).select(names)
    for part in ("one", "two"):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{part}")
    path = f"{tmp_path}/*"
    merged = flow_records(read_packets(spark, path))
    assert [r.tot_fwd_pkts for r in merged.collect()] == [4]
    apart = flow_records(read_packets(spark, path, per_file=True), FlowParams(per_file=True))
    assert [r.tot_fwd_pkts for r in apart.collect()] == [2, 2]


def test_slices_are_ordered_once(spark):
    """The order inside slices was made again by each of three readers."""
    rows = [packet(i, 0.5 * i) for i in range(8)]
    plan = assign_flows(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan
