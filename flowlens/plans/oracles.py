"""The same derived tables as common table expressions for a SQL engine."""

from __future__ import annotations

from flowlens.functions import domain
from flowlens.plans.fixtures import FLOWS, RULED, VPN, VPN_RULED

_CLASSES = ", ".join(f"'{c}'" for c in domain.ATTACK_CLASSES)

CLEANED = f"""
select flow_id, proto, service, state, sbytes, dbytes, attack_cat, label from (
 with a as (select distinct * from flows),
 c as (select flow_id, coalesce(nullif(trim(proto),''),'unknown_feature') proto, service,
  coalesce(nullif(trim(state),''),'unknown_feature') state,
  try_cast(sbytes as double) sbytes, try_cast(dbytes as double) dbytes, try_cast(label as double) label,
  case when trim(attack_cat) in ('','-','--','nan','None','NULL') then null
   when trim(attack_cat)='Backdoors' then 'Backdoor' else trim(attack_cat) end attack_cat from a),
 m as (select median(sbytes) ms, median(dbytes) md from c),
 r as (select flow_id, proto, service, state, coalesce(sbytes,ms) sbytes, coalesce(dbytes,md) dbytes,
  case when attack_cat is null and label=0 then 'Normal' else attack_cat end attack_cat,
  cast(label as int) label from c cross join m where label is not null)
 select * from r where attack_cat in ({_CLASSES})) x
"""

SCORED = """
select c.*, v.attack_cat as predicted_attack,
 case when c.service in ('ssh','-') then 'VPN' when c.service='dns' then 'vpn' else 'Non-VPN' end as predicted_vpn
from cleaned c join (
 select state, dbytes, attack_cat from (
  select state, dbytes, attack_cat, row_number() over (partition by state, dbytes order by count(*) desc, attack_cat) r
  from cleaned group by state, dbytes, attack_cat) w where r=1) v
on c.state=v.state and c.dbytes=v.dbytes
"""

HALF = "select max(flow_id)/2.0 as h from flows"
FIRST = "select c.* from cleaned c, half where flow_id<=h"
SECOND = "select c.* from cleaned c, half where flow_id>h"
BASELINE = "select attack_cat as class, count(*)/sum(count(*)) over () as share from first_half group by attack_cat"

_VIEWS = {
    "flows": (FLOWS, ()),
    "vpn": (VPN, ()),
    "cleaned": (CLEANED, ("flows",)),
    "ruled": (RULED, ("cleaned",)),
    "vpn_ruled": (VPN_RULED, ("vpn",)),
    "scored": (SCORED, ("cleaned",)),
    "half": (HALF, ("flows",)),
    "first_half": (FIRST, ("cleaned", "half")),
    "second_half": (SECOND, ("cleaned", "half")),
    "baseline": (BASELINE, ("first_half",)),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the views it needs, each after the ones it builds on."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _VIEWS[name][1]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    body = sql.strip()
    views = ",\n".join(f"{n} as materialized ({_VIEWS[n][0].strip()})" for n in order)
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"
