"""Flow assembly: packets to flow membership (FA1-FA5, FA8, FA9).

One endpoint pair may hold a large part of all traffic, so nothing here is
ordered per pair. Packets are spread by (pair, time slice); what a slice must
know of earlier slices (last packet, current session start, ...) is one small
row per slice, and only those rows are ordered per pair. A pair therefore costs
one task per slice, and its ordered part is bounded by the covered time.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.functions.lineage import cut_lineage
from netlens.params import MICROS, FlowParams
from netlens.sources.packets import TCP, tcp_udp, with_flow_key, with_micros

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _lag_conditions() -> dict[str, Column]:
    """Which earlier packets a packet looks back to."""
    window_set = (F.col("protocol") == TCP) & (F.col("tcp_window") != 0)
    return {
        "any": F.lit(True),
        "d1": F.col("d"),
        "d0": ~F.col("d"),
        "pay": F.col("payload_len") > 0,
        "w1": F.col("d") & window_set,
        "w0": ~F.col("d") & window_set,
    }


def _pos() -> Column:
    return F.struct("us", "seq", "d")


def _sliced(packets: DataFrame, p: FlowParams) -> DataFrame:
    """Packets with everything that can be known inside one slice."""
    spec = Window.partitionBy(*p.key_columns, "slice").orderBy("us", "seq")
    before, so_far = spec.rowsBetween(*BEFORE), spec.rowsBetween(*SO_FAR)
    rows = with_flow_key(with_micros(tcp_udp(packets))).withColumn(
        "slice", F.floor(F.col("us") / F.lit(p.slice_us))
    )
    rows = rows.withColumns(
        {
            f"l_{name}": F.lag(_pos()).over(spec)
            if name == "any"
            else F.max(F.when(cond, _pos())).over(before)
            for name, cond in _lag_conditions().items()
        }
    )
    gap = F.col("us") - F.col("l_any.us")
    bulk_break = _bulk_break("l_pay", p) & F.col("l_pay").isNotNull()
    return rows.withColumns(
        {
            "s_run": F.max(F.when(gap > p.idle_us, _pos())).over(so_far),
            "a_run": F.max(F.when(gap > p.active_us, F.col("us"))).over(before),
            "b_run": F.max(F.when(bulk_break, _pos())).over(so_far),
        }
    )


def _bulk_break(prev: str, p: FlowParams) -> Column:
    """Payload packet that cannot continue the bulk of the payload packet ``prev``."""
    return (F.col("payload_len") > 0) & (
        (F.col(f"{prev}.d") != F.col("d")) | (F.col("us") - F.col(f"{prev}.us") > p.clump_us)
    )


def _slice_states(rows: DataFrame, p: FlowParams) -> DataFrame:
    """One row per (pair, slice): what the slice inherits and where its sessions start."""
    key, pos = p.key_columns, _pos()
    gap = F.col("us") - F.col("l_any.us")
    conditions = _lag_conditions()
    own = rows.groupBy(*key, "slice").agg(
        F.min(pos).alias("first"),
        F.max("us").alias("last_us"),
        *[F.max(F.when(c, pos)).alias(f"last_{n}") for n, c in conditions.items()],
        F.min(F.when(conditions["pay"], pos)).alias("first_pay"),
        F.max("s_run").alias("s_last"),
        F.min(F.when(gap > p.idle_us, F.col("l_any.us"))).alias("s_first_end"),
        F.max(F.when(gap > p.active_us, F.col("us"))).alias("a_last"),
        F.max("b_run").alias("b_last"),
    )
    spec = Window.partitionBy(*key).orderBy("slice")
    before = spec.rowsBetween(*BEFORE)
    state = own.withColumns({f"c_{n}": F.max(f"last_{n}").over(before) for n in conditions})
    jump = F.col("first.us") - F.col("c_any.us")
    pay_jump = F.col("first_pay.us") - F.col("c_pay.us")
    state = state.withColumns(
        {
            "opens": F.col("c_any").isNull() | (jump > p.idle_us),
            "a_open": F.when(jump > p.active_us, F.col("first.us")),
            "b_open": F.when(
                F.col("c_pay").isNull()
                | (F.col("c_pay.d") != F.col("first_pay.d"))
                | (pay_jump > p.clump_us),
                F.col("first_pay"),
            ),
        }
    )
    s_open = F.when(F.col("opens"), F.col("first"))
    state = state.withColumns(
        {
            "s_carry": F.max(F.coalesce("s_last", s_open)).over(before),
            "a_carry": F.max(F.coalesce("a_last", "a_open")).over(before),
            "b_carry": F.max(F.greatest("b_last", "b_open")).over(before),
            "next_first": F.lead("first").over(spec),
            "next_opens": F.lead("opens").over(spec),
        }
    )
    return state.select(
        *key, "slice", "first", "last_us", "s_last", "s_first_end", "a_open", "a_carry",
        *[f"c_{n}" for n in conditions],
        F.coalesce(s_open, "s_carry").alias("s_begin"),
        F.greatest("b_open", "b_carry").alias("b_begin"),
        F.when(~F.col("next_opens"), F.col("next_first")).alias("s_next"),
    )


def _with_sessions(rows: DataFrame, state: DataFrame, p: FlowParams) -> DataFrame:
    """FA3, FA4: the session start of every packet."""
    joined = rows.join(state, [*p.key_columns, "slice"])
    return joined.withColumn("session", F.greatest("s_run", "s_begin"))


def _session_pieces(state: DataFrame, p: FlowParams) -> DataFrame:
    """A slice touches at most two sessions that reach beyond it: its first and its last."""
    first = F.struct(
        F.col("s_begin").alias("session"), F.coalesce("s_first_end", "last_us").alias("end_us")
    )
    last = F.when(
        F.col("s_last").isNotNull(),
        F.struct(F.col("s_last").alias("session"), F.col("last_us").alias("end_us")),
    )
    pieces = state.select(*p.key_columns, "slice", F.explode(F.array(first, last)).alias("piece"))
    return pieces.where("piece is not null").select(*p.key_columns, "slice", "piece.*")


def _restarts(rows: DataFrame, state: DataFrame, p: FlowParams) -> DataFrame | None:
    """FA5: flow starts forced by the duration cap, one row each.

    A flow closes after its first packet at or past the cap and the next packet
    restarts the clock, so starts form a chain per session. Every packet of a
    long session gets a pointer to the start that would follow it, and the
    pointers are doubled: the rounds grow with the logarithm of the longest
    session and every join key is one packet.
    """
    key, cap = p.key_columns, p.cap_us
    pieces = _session_pieces(state, p)
    long_sessions = (
        pieces.groupBy(*key, "session")
        .agg(F.max("end_us").alias("end_us"))
        .where(F.col("end_us") - F.col("session.us") >= cap)
    )
    longest = long_sessions.agg(F.max(F.col("end_us") - F.col("session.us"))).first()[0]
    if longest is None:
        return None

    long_slices = pieces.join(long_sessions, [*key, "session"], "left_semi").select(*key, "slice", "session")
    packets = _with_sessions(rows, state, p).join(long_slices, [*key, "slice", "session"], "left_semi")

    part = [*key, "session", "slice"]
    in_slice = Window.partitionBy(*part).orderBy("us", "seq")
    last_session = F.greatest("s_begin", "s_last") == F.col("session")
    packets = packets.withColumn(
        "follower",
        F.coalesce(F.lead(_pos()).over(in_slice), F.when(last_session, F.col("s_next"))),
    )
    # read twice below; narrow, and only of sessions longer than the cap
    packets = cut_lineage(packets.select(*key, "session", "us", "seq", "d", "follower"))
    # closing packet = first packet at or after us + cap: packets and look-ups run
    # through one ordering, latest first, with a running minimum
    arrival = F.struct(F.col("us").alias("at"), F.lit(0).alias("kind"))
    probe = F.struct((F.col("us") + cap).alias("at"), F.lit(1).alias("kind"))
    marks = packets.select(
        *key, "session", "us", "seq", "d", "follower", F.explode(F.array(arrival, probe)).alias("m")
    ).select(
        *key, "session", "us", "seq", "m.*",
        F.floor(F.col("m.at") / F.lit(p.slice_us)).alias("slice"),
        F.when(F.col("m.kind") == 0, F.struct("us", "seq", "follower")).alias("closer"),
    )
    latest_first = Window.partitionBy(*part).orderBy(F.desc("at"), "kind", F.desc("seq")).rowsBetween(*SO_FAR)
    later_slices = Window.partitionBy(*key, "session").orderBy(F.desc("slice")).rowsBetween(*BEFORE)
    later = (
        marks.groupBy(*part)
        .agg(F.min("closer").alias("slice_closer"))
        .withColumn("later_closer", F.min("slice_closer").over(later_slices))
    )
    pointers = (
        marks.withColumn("closer", F.min("closer").over(latest_first))
        .where("kind = 1")
        .join(later, part)
        .select(*key, "us", "seq", F.coalesce("closer", "later_closer")["follower"].alias("to"))
        .where("to is not null")
    )
    node = [*key, "us", "seq"]
    pointers = cut_lineage(pointers)
    starts = long_sessions.select(*key, "session.*", F.lit(0).alias("hop"))
    rounds = math.ceil(math.log2(longest // cap + 1))
    for i in range(rounds):
        reached = starts.join(pointers, node).select(*key, "to.*", (F.col("hop") + 2**i).alias("hop"))
        starts = cut_lineage(starts.unionByName(reached))
        if i + 1 < rounds:
            onward = pointers.select(
                *key, F.col("us").alias("to_us"), F.col("seq").alias("to_seq"), F.col("to").alias("onward")
            )
            pointers = cut_lineage(
                pointers.withColumns({"to_us": F.col("to.us"), "to_seq": F.col("to.seq")})
                .join(onward, [*key, "to_us", "to_seq"])
                .select(*node, F.col("onward").alias("to"))
            )
    return starts.where("hop > 0").select(
        *key,
        F.floor(F.col("us") / F.lit(p.slice_us)).alias("slice"),
        _pos().alias("cap_here"),
    )


def with_balanced_slices(packets: DataFrame, p: FlowParams, rows: int = 2_000_000) -> FlowParams:
    """Parameters with slices narrow enough that none holds more than ``rows`` packets.

    For traffic in which one pair sends very densely. Counting is a narrow scan
    with map-side combine; one number reaches the driver. Packets of one
    microsecond are never parted.
    """
    pairs = with_flow_key(with_micros(tcp_udp(packets)))
    width = p.slice_us
    while width > 1:
        slot = F.floor(F.col("us") / F.lit(width)).alias("slice")
        fullest = pairs.groupBy(*p.key_columns, slot).count().agg(F.max("count")).first()[0] or 0
        if fullest <= rows:
            break
        width = max(1, width // math.ceil(fullest / rows))
    return replace(p, slice_s=width / MICROS)


def assign_flows(packets: DataFrame, p: FlowParams | None = None) -> DataFrame:
    """Every TCP/UDP packet with its flow and what it needs to know of earlier packets.

    Added columns: ``start_us, start_seq, start_d`` (with the key columns: the
    flow), ``fwd``, ``is_first``, ``gap_us`` (to the previous packet of the flow),
    ``dir_gap_us`` (same direction), ``prev_fwd``, ``first_window``,
    ``run_us`` (start of the active run before a gap), ``bulk_us, bulk_seq``.
    """
    p = p or FlowParams()
    rows = _sliced(packets, p)
    if p.cap_us is not None:
        # read three times below; from files, so that neither the order inside slices nor the keys are made again
        rows = cut_lineage(rows)
    state = _slice_states(rows, p)
    restarts = None
    if p.cap_us is not None:
        state = cut_lineage(state)
        restarts = _restarts(rows, state, p)
    if restarts is None:
        flow = F.col("session")
    else:
        # slices are no wider than the cap, so a slice holds at most one restart
        before = Window.partitionBy(*p.key_columns).orderBy("slice").rowsBetween(*BEFORE)
        state = state.join(restarts, [*p.key_columns, "slice"], "left").withColumn(
            "cap_carry", F.max("cap_here").over(before)
        )
        here = F.when(F.col("cap_here") <= _pos(), F.col("cap_here"))
        flow = F.greatest(F.col("session"), here, F.col("cap_carry"))
    rows = _with_sessions(rows, state, p).withColumn("flow", flow)

    def back(name: str) -> Column:
        return F.coalesce(f"l_{name}", f"c_{name}")

    rows = rows.withColumns(
        {
            "start_us": F.col("flow.us"),
            "start_seq": F.col("flow.seq"),
            "start_d": F.col("flow.d"),
            "prev": back("any"),
            "prev_dir": F.when(F.col("d"), back("d1")).otherwise(back("d0")),
            "prev_window": F.when(F.col("d"), back("w1")).otherwise(back("w0")),
            "bulk": F.greatest("b_run", "b_begin"),
        }
    )

    def in_flow(name: str) -> Column:
        later = F.col(f"{name}.us") > F.col("start_us")
        return later | ((F.col(f"{name}.us") == F.col("start_us")) & (F.col(f"{name}.seq") >= F.col("start_seq")))

    opened = F.when(F.col("first") < _pos(), F.col("a_open"))
    state_columns = {
        "slice", "flow", "session", "prev", "prev_dir", "prev_window", "bulk", "s_run", "a_run", "b_run",
        *state.columns, *[f"l_{n}" for n in _lag_conditions()],
    } - set(p.key_columns)
    window_set = (F.col("protocol") == TCP) & (F.col("tcp_window") != 0)
    rows = rows.withColumns(
        {
            "fwd": F.col("d") == F.col("start_d"),
            "is_first": (F.col("us") == F.col("start_us")) & (F.col("seq") == F.col("start_seq")),
            "gap_us": F.when(in_flow("prev"), F.col("us") - F.col("prev.us")),
            "prev_fwd": F.when(in_flow("prev"), F.col("prev.d") == F.col("start_d")),
            "dir_gap_us": F.when(in_flow("prev_dir"), F.col("us") - F.col("prev_dir.us")),
            "first_window": window_set & ~F.coalesce(in_flow("prev_window"), F.lit(False)),
            "run_us": F.greatest("a_run", opened, "a_carry", "start_us"),
            "bulk_us": F.col("bulk.us"),
            "bulk_seq": F.col("bulk.seq"),
        }
    )
    return rows.select(*[c for c in rows.columns if c not in state_columns])
