"""Queries over aggregates: A1-A18."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import domain
from flowlens.operators import cleaning, evaluation, stats
from flowlens.operators.drift import drift
from flowlens.operators.shared import scratch_path
from flowlens.operators.soc import percentages, soc_metrics, top_attack
from flowlens.plans.registry import query
from flowlens.sources.sinks import write_clean
from flowlens.streaming.arrivals import captures_stream
from flowlens.streaming.windows import drift_windows

_PAIR = ("attack_cat", "predicted_attack")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("A1_row_count", "select count(*) as records from cleaned")
def _(t):
    return stats.row_count(t.cleaned)


@query("A1_row_count_by", "select service, count(*) as records from cleaned group by service")
def _(t):
    return stats.row_count(t.cleaned, ["service"])


@query("A2_class_counts", "select attack_cat as class, count(*) as n from cleaned group by 1")
def _(t):
    return stats.class_counts(t.cleaned, "attack_cat")


@query("A2_class_counts_by", "select service, attack_cat as class, count(*) as n from flows where attack_cat is not null group by 1, 2", ("flows",))
def _(t):
    return stats.class_counts(t.flows, "attack_cat", ["service"])


@query("A3_class_distribution", "select attack_cat as class, round(count(*)/sum(count(*)) over (),9) as share from cleaned group by 1")
def _(t):
    return _rounded(stats.class_distribution(t.cleaned, "attack_cat"), "share")


@query("A3_class_distribution_by", "select service, attack_cat as class, round(count(*)/sum(count(*)) over (partition by service),9) as share from cleaned group by 1, 2")
def _(t):
    return _rounded(stats.class_distribution(t.cleaned, "attack_cat", ["service"]), "share")


@query("A4_distinct_classes", "select distinct attack_cat as class from flows where attack_cat is not null", ("flows",))
def _(t):
    return stats.distinct_classes(t.flows, "attack_cat")


@query(
    "A5_column_medians",
    """with v as (select try_cast(sbytes as double) s, try_cast(dbytes as double) d from flows)
    select 'sbytes' as "column", median(s) as median from v union all select 'dbytes', median(d) from v""",
    ("flows",),
)
def _(t):
    return stats.column_medians(t.flows, ["sbytes", "dbytes"])


@query(
    "A5_column_medians_by",
    " union all ".join(f"""select class1, '{c}' as "column", median({c}) as median from vpn group by class1""" for c in domain.VPN_COLUMNS),
    ("vpn",),
)
def _(t):
    return stats.column_medians(t.vpn, domain.VPN_COLUMNS, ["class1"])


@query(
    "A6_column_modes",
    " union all ".join(
        f"""select * from (select '{c}' as "column", {c} as mode from flows where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"""
        for c in ("proto", "service", "state")
    ),
    ("flows",),
)
def _(t):
    return stats.column_modes(t.flows, ["proto", "service", "state"])


@query(
    "A7_class_count_stats",
    """with c as (select attack_cat as class, count(*) as n from cleaned group by 1),
    m as (select max(case when class<>'Normal' then n end) as max_non_benign, median(n) as median_count from c)
    select max_non_benign, median_count, (select min(n) from c, m where n < greatest(floor(median_count),2000)) as smallest_boosted from m""",
)
def _(t):
    return stats.class_count_stats(t.cleaned, "attack_cat")


@query("A8_confusion_matrix", "select attack_cat as actual, predicted_attack as predicted, count(*) as n from scored group by 1, 2", ("scored",))
def _(t):
    return evaluation.confusion_matrix(t.scored, *_PAIR)


@query(
    "A8_confusion_pivot",
    "select attack_cat as actual, "
    + ", ".join(f"""count(*) filter (predicted_attack='{c}') as "{c}" """ for c in domain.ATTACK_CLASSES)
    + " from scored group by 1",
    ("scored",),
)
def _(t):
    return evaluation.confusion_pivot(evaluation.confusion_matrix(t.scored, *_PAIR), domain.ATTACK_CLASSES)


@query("A9_accuracy", "select round(avg(case when attack_cat=predicted_attack then 1.0::double else 0 end),9) as accuracy from scored", ("scored",))
def _(t):
    return _rounded(evaluation.accuracy(t.scored, *_PAIR), "accuracy")


_PER_CLASS = """k as (select attack_cat as class from scored union select predicted_attack from scored),
 a as (select attack_cat as class, count(*) as support from scored group by 1),
 p as (select predicted_attack as class, count(*) as claimed from scored group by 1),
 h as (select attack_cat as class, count(*) as hits from scored where attack_cat=predicted_attack group by 1),
 r as (select k.class, coalesce(support,0) as support, coalesce(claimed,0) as claimed, coalesce(hits,0) as hits
  from k left join a on a.class=k.class left join p on p.class=k.class left join h on h.class=k.class),
 s as (select class, support, hits, case when claimed=0 then 0 else hits/claimed end as precision,
  case when support=0 then 0 else hits/support end as recall,
  case when support+claimed=0 then 0 else 2*hits/(support+claimed) end as f1_score from r)"""


@query(
    "A10_classification_report",
    f"""with {_PER_CLASS}
    select class, round(precision,9) as precision, round(recall,9) as recall, round(f1_score,9) as f1_score, cast(support as bigint) as support from s
    union all select 'accuracy', null, null, round(sum(hits)/sum(support),9), cast(sum(support) as bigint) from s
    union all select 'macro avg', round(avg(precision),9), round(avg(recall),9), round(avg(f1_score),9), cast(sum(support) as bigint) from s
    union all select 'weighted avg', round(sum(precision*support)/sum(support),9), round(sum(recall*support)/sum(support),9), round(sum(f1_score*support)/sum(support),9), cast(sum(support) as bigint) from s""",
    ("scored",),
)
def _(t):
    return _rounded(evaluation.classification_report(t.scored, *_PAIR), "precision", "recall", "f1_score")


@query(
    "A11_f1_averages",
    f"""with {_PER_CLASS}
    select round(avg(f1_score),9) as macro_f1, round(sum(f1_score*support)/sum(support),9) as weighted_f1 from s""",
    ("scored",),
)
def _(t):
    return _rounded(evaluation.f1_averages(t.scored, *_PAIR), "macro_f1", "weighted_f1")


@query(
    "A12_per_class_recall",
    f"with {_PER_CLASS} select class, round(recall,9) as recall, cast(hits as bigint) as hits, cast(support as bigint) as support from s where support > 0",
    ("scored",),
)
def _(t):
    return _rounded(evaluation.per_class_recall(t.scored, *_PAIR), "recall")


def _drift_sql(labels: str, key: str | None) -> str:
    """Direct form: align both distributions over the union of classes, per key."""
    part = f"partition by {key}" if key else ""
    k = f"{key}, " if key else ""
    keys = f"keys as (select distinct {key} from {labels})," if key else "keys as (select 1 as one),"
    on = f"and q.{key}=g.{key}" if key else ""
    return f"""{keys}
    q as (select {k}label as class, count(*)/sum(count(*)) over ({part}) as share from {labels} group by {k}label),
    c as (select class from baseline union select class from q),
    g as (select * from keys, c),
    v as (select {"g." + key + "," if key else ""} coalesce(p.share,0) as p, coalesce(q.share,0) as q
     from g left join baseline p on p.class=g.class left join q on q.class=g.class {on}),
    d as (select {k}sqrt(greatest(0, sum(case when p>0 then p*ln(2*p/(p+q)) else 0 end + case when q>0 then q*ln(2*q/(p+q)) else 0 end)/2)) as js_distance
     from v {"group by " + key if key else ""})"""


_VERDICT = """round(js_distance,9) as js_distance, 0.2::double as threshold, js_distance>0.2 as drift_detected,
 case when js_distance>0.2 then 'Concept Drift Detected' else 'No Concept Drift Detected' end as drift_status"""


@query(
    "A13_drift",
    f"with labels as (select attack_cat as label from second_half), {_drift_sql('labels', None)} select {_VERDICT} from d",
    ("baseline", "second_half"),
)
def _(t):
    return _rounded(drift(t.baseline, t.second_half, "attack_cat"), "js_distance")


@query(
    "A13_drift_by",
    f"with labels as (select service, attack_cat as label from second_half), {_drift_sql('labels', 'service')} select service, {_VERDICT} from d",
    ("baseline", "second_half"),
)
def _(t):
    return _rounded(drift(t.baseline, t.second_half, "attack_cat", by=["service"]), "js_distance")


_TIMED = "select e.ts, s.service, s.predicted_attack as label from scored s join events e on e.event_id = s.flow_id"


@query(
    "A13_drift_windows",
    f"""with timed as ({_TIMED}), days as (select epoch_us(ts)//86400000000*86400 as window_start, label from timed),
    labels as (select * from days where (window_start+86400)*1000 <= (select epoch_us(max(ts))//1000-6*3600000 from timed)),
    {_drift_sql("labels", "window_start")} select window_start, {_VERDICT} from d""",
    ("baseline", "scored"),
)
def _(t):
    """Captures that arrive in two parts, judged per day of event time: the days that the watermark has closed."""
    place = scratch_path(t.spark, "arrivals")
    instant = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    times = t.events.select(F.col("event_id").alias("flow_id"), F.expr(instant).alias("micros"))
    rows = t.scored.join(times, "flow_id").select("micros", "service", "predicted_attack")
    middle = rows.agg(F.expr("(min(micros) + max(micros)) / 2")).scalar()
    parts = {"early": F.col("micros") < middle, "late": F.col("micros") >= middle}
    for name, part in parts.items():
        write_clean(rows.where(part), f"{place}/landing/{name}", "csv")
        arrived = captures_stream(t.spark, f"{place}/landing/*", rows.columns)
        timed = arrived.withColumn("time", F.timestamp_micros(F.col("micros").cast("long")))
        run = drift_windows(
            timed, t.baseline, f"{place}/out", f"{place}/state", "predicted_attack", "time", "1 day", "6 hours"
        )
        run.awaitTermination()
    verdicts = t.spark.read.parquet(f"{place}/out/drift")
    named = verdicts.select(F.unix_seconds("window_start").alias("window_start"), "js_distance", "threshold", "drift_detected", "drift_status")
    return _rounded(named, "js_distance")


_PERCENT = """count(*) as total_records, count(predicted_attack) as total_attacks,
 round(count(predicted_attack)/count(*)*100,{d}) as attack_percentage,
 round(count(*) filter (lower(predicted_attack) not in ('normal','unknown'))/count(*)*100,{d}) as malicious_percentage,
 round(count(*) filter (predicted_vpn in ('VPN','vpn'))/count(*)*100,{d}) as vpn_percentage"""


@query("A14_percentages", f"select {_PERCENT.format(d=9)} from scored", ("scored",))
def _(t):
    return _rounded(percentages(t.scored), "attack_percentage", "malicious_percentage", "vpn_percentage")


@query(
    "A15_top_attack",
    "select service, predicted_attack as top_attack from (select service, predicted_attack, row_number() over (partition by service order by lower(predicted_attack) in ('normal','unknown'), count(*) desc, predicted_attack) as r from scored group by 1, 2) x where r=1",
    ("scored",),
)
def _(t):
    return top_attack(stats.class_counts(t.scored, "predicted_attack", ["service"]), ["service"])


def _soc_sql(key: str | None) -> str:
    k = f"{key}, " if key else ""
    b = f"b.{key}, " if key else ""
    part = f"partition by {key}" if key else ""
    join = f"join top on top.{key}=b.{key} join d on d.{key}=b.{key}" if key else ", top, d"
    group = f"group by {key}" if key else ""
    return f"""with labels as (select {k}predicted_attack as label from scored), {_drift_sql('labels', key)},
    top as (select {k}predicted_attack as top_attack from (select {k}predicted_attack, row_number() over ({part} order by lower(predicted_attack) in ('normal','unknown'), count(*) desc, predicted_attack) as r from scored group by {k}predicted_attack) x where r=1),
    b as (select {k}{_PERCENT.format(d=2)}, count(predicted_attack)/count(*)*100 as a, count(*) filter (predicted_vpn in ('VPN','vpn'))/count(*)*100 as v from scored {group}),
    m as (select {b}total_records, total_attacks, attack_percentage, malicious_percentage, vpn_percentage, top_attack, js_distance,
     js_distance>0.2 as drift_detected, least(100, round(0.5*a+0.2*v+30*js_distance,2)) as risk_score from b {join}),
    l as (select *, case when risk_score>=70 then 'High' when risk_score>=35 or drift_detected then 'Medium' else 'Low' end as threat_level from m)
    select {k}total_records, total_attacks, attack_percentage, malicious_percentage, vpn_percentage, top_attack,
     round(js_distance,9) as js_distance, drift_detected, risk_score, threat_level,
     case threat_level when 'Low' then 'Network Status: Secure' when 'Medium' then 'Network Status: Suspicious Activity Detected'
      else 'Network Status: High Risk — Immediate Investigation Required' end as status_message from l"""


@query("A16_soc_metrics", _soc_sql(None), ("scored", "baseline"))
def _(t):
    return _rounded(soc_metrics(t.scored, t.baseline, input_type="mixed"), "js_distance")


@query("A16_soc_metrics_by", _soc_sql("service"), ("scored", "baseline"))
def _(t):
    return _rounded(soc_metrics(t.scored, t.baseline, ["service"], "mixed"), "js_distance")


@query("A17_chart_frame", "select predicted_vpn as class, count(*) as n from scored group by 1", ("scored",))
def _(t):
    return stats.chart_frame(stats.class_counts(t.scored, "predicted_vpn"))


@query(
    "A18_cleaning_audit",
    """with a as (select distinct * from flows),
    c as (select try_cast(label as double) as label, case when trim(attack_cat) in ('','-','--','nan','None','NULL') then null when trim(attack_cat)='Backdoors' then 'Backdoor' else trim(attack_cat) end as cls from a),
    r as (select label, case when cls is null and label=0 then 'Normal' else cls end as cls from c)
    select (select count(*) from flows) as rows_in, count(*) as after_dedupe, count(*) filter (label is null) as dropped_missing_label,
    count(*) filter (label is not null and cls is null) as dropped_unresolved,
    (select count(*) from r where label is not null and cls is not null) - (select count(*) from cleaned) as removed_invalid,
    (select count(*) from cleaned) as rows_out from r""",
    ("flows", "cleaned"),
)
def _(t):
    return cleaning.cleaning_audit(t.flows)


@query("A18_clean_flows", "select * from cleaned")
def _(t):
    return t.clean()
