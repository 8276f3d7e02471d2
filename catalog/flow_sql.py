"""SQL over ``events`` that the flow queries are compared with."""

from __future__ import annotations

from netlens.params import FlowParams

FIXTURE = FlowParams(idle_s=43200, cap_s=172800, clump_s=21600, active_s=21600, bulk_bound=4)
FIXTURE_PARITY = FlowParams(idle_s=43200, cap_s=172800, clump_s=21600, active_s=21600, bulk_bound=4, parity=True)


def packet_select(us: str, text: str) -> str:
    """The ``events`` table seen as packets; the same text for both engines."""
    return f"""
select event_id as seq, {us} as us,
  case when event_type in ('click','view','purchase') then a  else b  end src_ip,
  case when event_type in ('click','view','purchase') then b  else a  end dst_ip,
  case when event_type in ('click','view','purchase') then cp else sp end src_port,
  case when event_type in ('click','view','purchase') then sp else cp end dst_port,
  case when user_id % 5 = 0 then 17 when user_id % 11 = 7 then 1 else 6 end protocol,
  cast(60 + floor(value) as bigint) length, 20 + 4*(event_id % 2) header_len,
  case when event_type = 'signup' then 0 else cast(floor(value) as bigint) end payload_len,
  case when user_id % 5 = 0 or user_id % 11 = 7 then ''
       when event_type = 'signup' then 'S'    when event_type = 'click' then 'PA'
       when event_type = 'view'   then 'A'    when event_type = 'purchase' then 'FPA'
       else 'RAU' end tcp_flags,
  case when user_id % 5 = 0 or user_id % 11 = 7 then null else (event_id % 3)*1024 end tcp_window,
  32 + event_id % 96 ttl
from (select *, concat('10.0.', cast(cast(floor(user_id/256) as int) as {text}), '.', cast(user_id % 256 as {text})) a,
             concat('192.168.0.', cast(user_id % 8 as {text})) b, 40000 + user_id % 4 cp,
             case user_id % 4 when 0 then 80 when 1 then 443 when 2 then 22 else 53 end sp
      from events) e
"""


SPARK_PACKETS = packet_select("unix_micros(cast(ts as timestamp))", "string")
DUCK_PACKETS = packet_select("epoch_us(ts)", "varchar")


def flow_ctes(p: FlowParams) -> str:
    """Common table expressions up to ``ann``: packets with flow id, direction and gaps."""
    pair = "lo_ip, lo_port, hi_ip, hi_port" + ("" if p.parity else ", protocol")
    cap = p.cap_us
    return f"""
with recursive pk as ({DUCK_PACKETS}),
keyed as (select *, (src_ip, src_port) <= (dst_ip, dst_port) as d,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip else dst_ip end lo_ip,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then src_port else dst_port end lo_port,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_ip else src_ip end hi_ip,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_port else src_port end hi_port
  from pk where protocol in (6, 17)),
brk as (select *, case when us - lag(us) over (partition by {pair} order by us, seq) <= {p.idle_us}
    then 0 else 1 end b from keyed),
sess as (select *, sum(b) over (partition by {pair} order by us, seq) sid,
    dense_rank() over (order by {pair}) kid from brk),
pos as (select *, row_number() over (partition by kid, sid order by us, seq) rn from sess),
nxt as (select a.kid, a.sid, a.rn, min(b.rn) + 1 nx from pos a join pos b
    on a.kid = b.kid and a.sid = b.sid and b.us >= a.us + {cap} group by all),
chain as (select kid, sid, cast(1 as bigint) rn from pos group by kid, sid
  union all select c.kid, c.sid, n.nx from chain c join nxt n on c.kid = n.kid and c.sid = n.sid and c.rn = n.rn
    where exists (select 1 from pos q where q.kid = n.kid and q.sid = n.sid and q.rn = n.nx)),
marked as (select p.*, c.rn is not null as is_first from pos p left join chain c
    on p.kid = c.kid and p.sid = c.sid and p.rn = c.rn),
fl as (select *, count(*) filter (where is_first) over (partition by kid, sid order by rn) seg from marked),
fid as (select *, first_value(seq) over (partition by kid, sid, seg order by rn) fid,
    first_value(d) over (partition by kid, sid, seg order by rn) = d as fwd,
    first_value(us) over (partition by kid, sid, seg order by rn) start_us from fl),
ann as (select *, us - lag(us) over (partition by fid order by us, seq) gap,
    us - lag(us) over (partition by fid, fwd order by us, seq) dgap,
    lag(fwd) over (partition by fid order by us, seq) prev_fwd from fid)
"""
