"""Hand-written packets and a plain sequential flow meter to compare with."""

from netlens.params import FlowParams

SCHEMA = (
    "seq long, us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, "
    "header_len int, payload_len int, tcp_flags string, tcp_window int, ttl int, source_file string"
)
A, B = ("10.0.0.9", 40000), ("10.0.0.1", 80)


def packet(seq, t, src=A, dst=B, proto=6, length=60, payload=0, flags="", window=None, header=20, ttl=64, file="f"):
    return (
        seq, round(t * 1_000_000), src[0], dst[0], src[1], dst[1], proto, length, header, payload, flags, window, ttl, file,
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sequential(rows, p: FlowParams):
    """seq -> (seq of the flow's first packet, forward?, gap, gap in direction)."""
    live, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        seq, us, src, dst, proto = r[0], r[1], (r[2], r[4]), (r[3], r[5]), r[6]
        if proto not in (6, 17):
            continue
        key = (min(src, dst), max(src, dst)) + (() if p.parity else (proto,))
        flow = live.get(key)
        if flow is None or us - flow["last"] > p.idle_us or flow["closed"]:
            flow = live[key] = {"first": seq, "start": us, "src": src, "last": None, "dir": {}, "closed": False}
        fwd = src == flow["src"]
        gap = None if flow["last"] is None else us - flow["last"]
        dir_gap = us - flow["dir"][fwd] if fwd in flow["dir"] else None
        out[seq] = (flow["first"], fwd, gap, dir_gap)
        flow["last"], flow["dir"][fwd] = us, us
        flow["closed"] = p.cap_us is not None and us - flow["start"] >= p.cap_us
    return out
