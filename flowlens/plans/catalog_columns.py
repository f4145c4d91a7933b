"""Queries over columns, rows and sets: P*, N*, X*, M*, U*, J*, B*."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import domain, numeric, text, threat
from flowlens.operators import relational, schema
from flowlens.operators.cleaning import typed_flows
from flowlens.operators.encoding import standardised
from flowlens.operators.stats import class_counts, class_distribution, fit_medians, fit_modes
from flowlens.plans.registry import query

_CLASSES = ", ".join(f"'{c}'" for c in domain.ATTACK_CLASSES)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("P1_normalize_columns", "select flow_id, proto, sbytes from flows", ("flows",))
def _(t):
    odd = t.flows.select(
        F.col("flow_id").alias(" Flow_ID "), F.col("proto").alias("PROTO\t"), F.col("sbytes").alias(" sBytes")
    )
    return schema.normalize_columns(odd)


@query("P2_dedupe_columns", "select flow_id, sbytes, proto from flows", ("flows",))
def _(t):
    c = F.col
    twice = t.flows.select("flow_id", c("sbytes").alias(" Sbytes"), c("dbytes").alias("SBYTES "), "proto", c("state").alias("Proto"))
    return schema.dedupe_columns(twice)[0]


@query("P5_select_features", "select proto, service, state, sbytes, dbytes from cleaned")
def _(t):
    return schema.select_features(t.cleaned)


@query("P6_drop_target", "select l_orderkey, l_linenumber, duration, total_fiat, total_biat, min_flowiat, max_flowiat, mean_flowiat, std_flowiat, flowbytespersecond from vpn", ("vpn",))
def _(t):
    return schema.drop_target(t.vpn)


@query("P6_drop_target_intrusion", "select flow_id, proto, service, state, sbytes, dbytes from cleaned")
def _(t):
    return schema.drop_target(t.cleaned)


@query("P7_drop_foreign_columns", "select flow_id, attack_cat, label from cleaned")
def _(t):
    return schema.drop_foreign_columns(t.cleaned)


@query(
    "P9_filter_valid_classes",
    f"select flow_id, attack_cat from flows where attack_cat in ({_CLASSES})",
    ("flows",),
)
def _(t):
    return relational.filter_valid_classes(t.flows).select("flow_id", "attack_cat")


@query(
    "P10_drop_missing",
    "select flow_id, label, attack_cat from flows where label is not null and attack_cat is not null",
    ("flows",),
)
def _(t):
    kept = relational.drop_unresolved_class(relational.drop_missing_label(t.flows))
    return kept.select("flow_id", "label", "attack_cat")


@query("P11_non_benign", "select flow_id, attack_cat from cleaned where lower(attack_cat) not in ('normal','unknown')")
def _(t):
    return relational.malicious_rows(t.cleaned, "attack_cat").select("flow_id", "attack_cat")


_FACTS = "values " + ", ".join(
    "(" + ", ".join([_text(c), *[_text(facts[f]) for f in domain.INTELLIGENCE_FIELDS]]) + ")"
    for c, facts in domain.INTELLIGENCE.items()
)


@query(
    "J1_enrich_intelligence",
    f"""with facts(class, {', '.join(domain.INTELLIGENCE_FIELDS)}) as ({_FACTS}),
    counts as (select trim(attack_cat) as class, count(*) as n from flows where attack_cat is not null group by 1)
    select counts.class, n, case when counts.class in ('Normal') then 'Low' when counts.class in ('Analysis','Fuzzers','Generic','Reconnaissance') then 'Medium'
     when counts.class in ('Backdoor','DoS','Exploits','Shellcode') then 'High' when counts.class='Worms' then 'Critical' else 'Unknown' end as severity,
     case when counts.class='Normal' then 'Safe' when counts.class in ('Analysis','Fuzzers','Reconnaissance') then 'Moderate' when counts.class='Generic' then 'Moderate to High'
     when counts.class in ('Backdoor','DoS','Exploits','Shellcode') then 'High Risk' when counts.class='Worms' then 'Critical' else 'Unknown' end as danger_level, {', '.join(f"coalesce({f}, {_text(domain.INTELLIGENCE_DEFAULT[f])}) as {f}" for f in domain.INTELLIGENCE_FIELDS[2:])}
    from counts left join facts on counts.class = facts.class""",
    ("flows",),
)
def _(t):
    named = t.flows.withColumn("attack_cat", text.strip(F.col("attack_cat")))
    return relational.enrich_intelligence(class_counts(named, "attack_cat"), "class")


@query(
    "J2_align_distributions",
    """with p as (select attack_cat as class, count(*)/sum(count(*)) over () as share from first_half where attack_cat<>'DoS' group by 1),
    q as (select attack_cat as class, count(*)/sum(count(*)) over () as share from second_half where attack_cat<>'Worms' group by 1)
    select coalesce(p.class,q.class) as class, round(coalesce(p.share,0),9) as p, round(coalesce(q.share,0),9) as q
    from p full outer join q on p.class=q.class""",
    ("first_half", "second_half"),
)
def _(t):
    p = class_distribution(t.first_half.where("attack_cat <> 'DoS'"), "attack_cat")
    q = class_distribution(t.second_half.where("attack_cat <> 'Worms'"), "attack_cat")
    return relational.align_distributions(p, q).select("class", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(
    "U1_union_all",
    """select flow_id, proto, cast(sbytes as double) as sbytes, cast(null as varchar) as state from cleaned where flow_id % 2 = 0
    union all select flow_id, null, null, state from cleaned where flow_id % 2 = 1""",
)
def _(t):
    even = t.cleaned.where("flow_id % 2 = 0").select("flow_id", F.col("proto").alias(" Proto"), "sbytes")
    odd = t.cleaned.where("flow_id % 2 = 1").select("state", F.col("flow_id").alias("FLOW_ID"))
    return relational.union_all([even, odd])


@query("U2_distinct_rows", "select distinct * from flows", ("flows",))
def _(t):
    return relational.distinct_rows(t.flows)


@query(
    "U3_class_set_operations",
    """with a as (select distinct service as k from cleaned where attack_cat='Worms'),
    b as (select distinct service as k from cleaned where sbytes > 9000)
    select coalesce(a.k,b.k) as class, a.k is not null as in_first, b.k is not null as in_second
    from a full outer join b on a.k=b.k""",
)
def _(t):
    first = class_distribution(t.cleaned.where("attack_cat = 'Worms'"), "service")
    second = class_distribution(t.cleaned.where("sbytes > 9000"), "service")
    both = relational.align_distributions(first, second, ("a", "b"))
    return both.select("class", (F.col("a") > 0).alias("in_first"), (F.col("b") > 0).alias("in_second"))


# Spellings written out here, apart from those that the code under test knows.
_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_LOOKALIKES = ["-", "Na", "none", "na", " NA", "N/A ", "0"]
_SPELLED = "case flow_id % 26 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate([*_TOKENS, *_LOOKALIKES])) + " end"


@query(
    "N1_null_tokens_on_read",
    f"select flow_id, nullif(state,'') as state, service, case when flow_id % 26 >= {len(_TOKENS)} then {_SPELLED} end as spelled from flows",
    ("flows",),
)
def _(t):
    rows = t.flows.withColumn("spelled", F.expr(_SPELLED))
    return rows.select("flow_id", *[text.null_on_read(F.col(c)).alias(c) for c in ("state", "service", "spelled")])


@query(
    "N2_clean_categories",
    "select flow_id, coalesce(nullif(trim(proto),''),'unknown_feature') as proto, coalesce(nullif(trim(state),''),'unknown_feature') as state from flows",
    ("flows",),
)
def _(t):
    return t.flows.select("flow_id", *[text.clean_category(text.strip(F.col(c))).alias(c) for c in ("proto", "state")])


@query(
    "N3_clean_class",
    """select flow_id, case when trim(attack_cat) in ('',' ','nan','None','NULL','-','--') then null
    when trim(attack_cat)='Backdoors' then 'Backdoor' else trim(attack_cat) end as attack_cat from flows""",
    ("flows",),
)
def _(t):
    return t.flows.select("flow_id", text.clean_class(text.strip(F.col("attack_cat"))).alias("attack_cat"))


@query("N4_fill_constant", "select flow_id, coalesce(proto,'unknown') as proto from flows", ("flows",))
def _(t):
    return t.flows.select("flow_id", text.fill_constant(F.col("proto"), domain.SCORING_FILL).alias("proto"))


@query(
    "N5_resolve_class",
    "select flow_id, case when attack_cat is null and try_cast(label as int)=0 then 'Normal' else attack_cat end as attack_cat from flows",
    ("flows",),
)
def _(t):
    flag = numeric.coerce_number(F.col("label"))
    return t.flows.select("flow_id", text.resolve_class(F.col("attack_cat"), flag).alias("attack_cat"))


@query(
    "N6_impute_median",
    """with v as (select flow_id, try_cast(sbytes as double) s, try_cast(dbytes as double) d, cast(null as double) e from flows),
    m as (select median(s) ms, median(d) md, median(e) me from v)
    select flow_id, coalesce(s,ms) as sbytes, coalesce(d,md) as dbytes, coalesce(e,me,0.0) as nothing from v, m""",
    ("flows",),
)
def _(t):
    columns = ["sbytes", "dbytes", "nothing"]
    numbers = t.flows.select("flow_id", *[numeric.coerce_number(F.col(c)).alias(c) for c in columns[:2]])
    numbers = numbers.withColumn("nothing", F.lit(None).cast("double"))
    medians = fit_medians(numbers, columns)
    filled = [numeric.impute(F.col(c), F.lit(medians[c]).cast("double")).alias(c) for c in columns]
    return numbers.select("flow_id", *filled)


@query(
    "N7_impute_mode",
    """with p as (select proto as v from flows where proto is not null group by 1 order by count(*) desc, 1 limit 1),
    s as (select attack_cat as v from flows where attack_cat is not null group by 1 order by count(*) desc, 1 limit 1)
    select flow_id, coalesce(proto,(select v from p)) as proto, coalesce(attack_cat,(select v from s)) as attack_cat from flows""",
    ("flows",),
)
def _(t):
    columns = ["proto", "attack_cat"]
    modes = fit_modes(t.flows, columns)
    return t.flows.select("flow_id", *[F.coalesce(F.col(c), F.lit(modes[c])).alias(c) for c in columns])


@query("X1_strip", "select flow_id, trim(proto) as proto, trim(attack_cat) as attack_cat from flows", ("flows",))
def _(t):
    return t.flows.select("flow_id", *[text.strip(F.col(c)).alias(c) for c in ("proto", "attack_cat")])


@query("X2_lower", "select flow_id, lower(trim(proto)) as proto, lower(state) as state from flows", ("flows",))
def _(t):
    return t.flows.select("flow_id", *[text.strip_lower(F.col(c)).alias(c) for c in ("proto", "state")])


@query("X3_value_map", "select flow_id, case when trim(attack_cat)='Backdoors' then 'Backdoor' else trim(attack_cat) end as attack_cat from flows", ("flows",))
def _(t):
    mapped = text.map_values(text.strip(F.col("attack_cat")), domain.CLASS_ALIASES)
    return t.flows.select("flow_id", mapped.alias("attack_cat"))


@query("X4_stringify", "select flow_id, cast(label as varchar) as label, cast(flow_id as varchar) as id_text from cleaned")
def _(t):
    return t.cleaned.select("flow_id", text.stringify(F.col("label")).alias("label"), text.stringify(F.col("flow_id")).alias("id_text"))


@query("M1_coerce_number", "select flow_id, try_cast(sbytes as double) as sbytes, try_cast(dbytes as double) as dbytes from flows", ("flows",))
def _(t):
    return t.flows.select("flow_id", *[numeric.coerce_number(F.col(c)).alias(c) for c in ("sbytes", "dbytes")])


@query("M2_truncate_int", "select l_orderkey, l_linenumber, cast(trunc(total_biat) as int) as total_biat from vpn", ("vpn",))
def _(t):
    return t.vpn.select("l_orderkey", "l_linenumber", numeric.truncate_int(F.col("total_biat")).alias("total_biat"))


@query(
    "M3_standardise",
    """with s as (select avg(sbytes) ms, stddev_pop(sbytes) ss, avg(dbytes) md, stddev_pop(dbytes) sd from cleaned)
    select flow_id, round((sbytes-ms)/ss,6) as sbytes, round((dbytes-md)/sd,6) as dbytes from cleaned, s""",
)
def _(t):
    scaled = standardised(t.cleaned, domain.INTRUSION_NUMERIC)
    return scaled.select("flow_id", *[F.round(c, 6).alias(c) for c in domain.INTRUSION_NUMERIC])


@query(
    "M4_sqrt_ln",
    "select flow_id, round(sqrt(sbytes),9) as root, round(ln(sbytes+1),9) as log from cleaned",
)
def _(t):
    return t.cleaned.select("flow_id", F.round(F.sqrt("sbytes"), 9).alias("root"), F.round(F.ln(F.col("sbytes") + 1), 9).alias("log"))


@query(
    "M5_normalise_share",
    "select service, proto, round(case when sum(sum(sbytes)) over (partition by service) > 0 then sum(sbytes)/sum(sum(sbytes)) over (partition by service) else sum(sbytes) end, 9) as share from cleaned group by service, proto",
)
def _(t):
    from pyspark.sql import Window

    sums = t.cleaned.groupBy("service", "proto").agg(F.sum("sbytes").alias("s"))
    total = F.sum("s").over(Window.partitionBy("service"))
    return sums.select("service", "proto", F.round(numeric.normalise_share(F.col("s"), total), 9).alias("share"))


@query("M6_round_cap", "select flow_id, least(100.0::double, round(sbytes/97,2)) as points from cleaned")
def _(t):
    return t.cleaned.select("flow_id", numeric.round_capped(F.col("sbytes") / 97, domain.RISK_CEILING).alias("points"))


_LEVEL = """case when s>=70 then 'High' when s>=35 or d then 'Medium' else 'Low' end"""


@query("B1_threat_level", f"select flow_id, {_LEVEL} as threat_level from (select flow_id, round(sbytes/100,2) as s, flow_id%3=0 as d from cleaned) x")
def _(t):
    points = numeric.round_capped(F.col("sbytes") / 100, 1e9)
    level = threat.threat_level(points, F.col("flow_id") % 3 == 0, F.lit(False))
    return t.cleaned.select("flow_id", level.alias("threat_level"))


@query(
    "B2_status_message",
    f"""select flow_id, case {_LEVEL} when 'Low' then 'Network Status: Secure'
    when 'Medium' then 'Network Status: Suspicious Activity Detected'
    else 'Network Status: High Risk — Immediate Investigation Required' end as status_message
    from (select flow_id, round(sbytes/100,2) as s, false as d from cleaned) x""",
)
def _(t):
    points = numeric.round_capped(F.col("sbytes") / 100, 1e9)
    level = threat.threat_level(points, F.lit(False), F.lit(False))
    return t.cleaned.select("flow_id", threat.status_message(level).alias("status_message"))


@query(
    "B3_drift_status",
    "select flow_id, case when sbytes/10000 > 0.2 then 'Concept Drift Detected' else 'No Concept Drift Detected' end as drift_status from cleaned",
)
def _(t):
    found = threat.drift_detected(F.col("sbytes") / 10000, domain.DRIFT_THRESHOLD)
    return t.cleaned.select("flow_id", threat.drift_status(found).alias("drift_status"))


@query("P5_typed_projection", "select flow_id, coalesce(nullif(trim(proto),''),'unknown_feature') as proto, try_cast(sbytes as double) as sbytes, try_cast(label as double) as label from flows", ("flows",))
def _(t):
    return typed_flows(t.flows, ("flow_id",)).select("flow_id", "proto", "sbytes", "label")
