"""Queries that write captures to the shared folder and read them back: S*, P3, E*."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import domain
from flowlens.operators import schema
from flowlens.operators.drift import drift
from flowlens.operators.shared import scratch_path
from flowlens.plans import jobs
from flowlens.plans.recipes import evaluate
from flowlens.plans.registry import query
from flowlens.sources import captures, quarantine, sinks

_READ = "nullif(proto,'') as proto, service, nullif(state,'') as state, sbytes, dbytes, attack_cat, label"


def _place(t, name: str) -> str:
    return scratch_path(t.spark, f"captures-{name}")


def _export(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """Write a table as CSV captures, values untouched."""
    options = {
        "header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    df.write.options(**options, encoding=encoding).csv(path)
    return path


@query("S1_read_flows", f"select cast(flow_id as varchar) as flow_id, {_READ} from flows", ("flows",))
def _(t):
    return captures.read_flows(t.spark, _export(t.flows, _place(t, "flows")))


@query(
    "S1_read_quoted",
    """select cast(flow_id as varchar) as flow_id, service || ', "' || state || '"' as quoted,
    case when flow_id%3=0 then service || chr(10) || 'next' else service end as lines from flows""",
    ("flows",),
)
def _(t):
    """Text with commas, quotes and line breaks comes back as it was."""
    quoted = F.concat("service", F.lit(', "'), "state", F.lit('"')).alias("quoted")
    lines = F.when(F.col("flow_id") % 3 == 0, F.concat("service", F.lit("\nnext"))).otherwise(F.col("service"))
    rows = t.flows.select("flow_id", quoted, lines.alias("lines"))
    return captures.read_flows(t.spark, _export(rows, _place(t, "quoted")))


@query(
    "S2_read_flows_encoding",
    "select cast(flow_id as varchar) as flow_id, replace(service,'s','é') as service, 'latin' as part from flows where flow_id%2=0 union all select cast(flow_id as varchar), replace(service,'s','é'), 'utf' from flows where flow_id%2=1",
    ("flows",),
)
def _(t):
    place = _place(t, "encoded")
    rows = t.flows.select("flow_id", F.replace("service", F.lit("s"), F.lit("é")).alias("service"), "state")
    parts = (("latin", 0, "ISO-8859-1"), ("utf", 1, "UTF-8"))
    for name, rest, encoding in parts:
        part = rows.where(F.col("flow_id") % 2 == rest).withColumn("part", F.lit(name)).drop("state")
        _export(part, f"{place}/{name}", encoding)
    return captures.read_many(t.spark, [f"{place}/{name}" for name, _, _ in parts], encoding="auto")


@query(
    "S3_read_many",
    """select cast(flow_id as varchar) as flow_id, nullif(proto,'') as proto, sbytes, cast(null as varchar) as service from flows where flow_id%3=0
    union all select cast(flow_id as varchar), null, sbytes, service from flows where flow_id%3=1
    union all select cast(flow_id as varchar), nullif(proto,''), null, service from flows where flow_id%3=2""",
    ("flows",),
)
def _(t):
    place = _place(t, "many")
    parts = [t.flows.where(F.col("flow_id") % 3 == rest) for rest in range(3)]
    _export(parts[0].select("flow_id", F.col("proto").alias("Proto"), "sbytes"), f"{place}/a")
    _export(parts[1].select(F.col("sbytes").alias(" SBYTES"), "service", "flow_id"), f"{place}/b")
    _export(parts[2].select("service", "proto", F.col("flow_id").alias("Flow_ID ")), f"{place}/c")
    return captures.read_many(t.spark, [f"{place}/{x}" for x in ("a", "b", "c", "absent")])


@query(
    "S4_read_dirs",
    "select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber, class1 from vpn",
    ("vpn",),
)
def _(t):
    """All rows of two folders; a third holds copies in files with lines too long and is left out whole."""
    place = _place(t, "folders")
    rows = t.vpn.select("l_orderkey", "l_linenumber", "class1")
    for rest in (0, 1):
        _export(rows.where(F.col("l_linenumber") % 2 == rest), f"{place}/{rest}")
    torn = rows.select(F.concat_ws(",", "l_orderkey", "l_linenumber", "class1", F.lit("4")).alias("line"))
    _export_lines(torn, "l_orderkey,l_linenumber,class1", f"{place}/torn")
    return captures.read_dirs(t.spark, [f"{place}/0", f"{place}/1", f"{place}/torn", f"{place}/absent"])


def _export_lines(df: DataFrame, header: str, path: str) -> None:
    """Write the column ``line`` as it stands, below a header, as CSV captures."""
    options = {
        "header": "true", "quote": "", "sep": "\u0001", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    df.select(F.col("line").alias(header)).write.options(**options).csv(path)


def _landed(t):
    """All flows in captures of two headers; a field too many in every thirteenth row's line."""
    place = _place(t, "quarantine")
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in (F.col("flow_id").cast("string"), F.col("service"), F.col("proto"))])
    for rest, header in ((0, "flow_id,service,proto"), (1, " Flow_ID,SERVICE,proto ")):
        part = t.flows.where(F.col("flow_id") % 2 == rest)
        torn = F.when(F.col("flow_id") % 13 == 0, F.concat(line, F.lit(",stray"))).otherwise(line)
        _export_lines(part.select(torn.alias("line")), header, f"{place}/{rest}")
    return quarantine.land_captures(t.spark, [f"{place}/0", f"{place}/1", f"{place}/absent"])


@query(
    "S4_quarantine",
    f"""select cast(flow_id as varchar) as flow_id, case when flow_id%13<>0 then service end as service,
    case when flow_id%13=0 then '{quarantine.TOO_LONG}' end as reason from flows""",
    ("flows",),
)
def _(t):
    """Every line of the captures, as a row or in quarantine with its reason."""
    landing = _landed(t)
    rows = landing.captures.table().select("flow_id", "service", F.lit(None).cast("string").alias("reason"))
    lines = landing.rejected.where("line_number > 1")
    lines = lines.select(F.split("raw", ",")[0].alias("flow_id"), F.lit(None).cast("string").alias("service"), "reason")
    return rows.unionByName(lines)


@query(
    "S4_taken_back",
    "select cast(flow_id as varchar) as flow_id, service, nullif(proto,'') as proto, flow_id%13=0 as was_rejected from flows",
    ("flows",),
)
def _(t):
    """Quarantined lines without their stray field are taken back: with the rows kept at once, all flows."""
    landing = _landed(t)
    mended = landing.rejected.withColumn("raw", F.regexp_replace("raw", ",stray$", ""))
    back = quarantine.take_back(landing, mended)
    sides = ((landing.captures, False), (back.captures, True))
    parts = [c.table().select("flow_id", "service", "proto", F.lit(late).alias("was_rejected")) for c, late in sides]
    return parts[0].unionByName(parts[1])


@query(
    "S1_file_ledger",
    """select 'flow_id,service,proto' as header, count(*) as rows, max(case when flow_id%13=0 then 4 else 3 end) as longest from flows where flow_id%2=0
    union all select ' Flow_ID,SERVICE,proto ', count(*), max(case when flow_id%13=0 then 4 else 3 end) from flows where flow_id%2=1""",
    ("flows",),
)
def _(t):
    """What the ledger of files says, added up per header."""
    ledger = _landed(t).ledger
    return ledger.groupBy("header").agg(F.sum("rows").alias("rows"), F.max("longest").alias("longest"))


@query("S5_write_predictions", "select cast(flow_id as varchar) as flow_id, service, predicted_attack, predicted_vpn from scored", ("scored",))
def _(t):
    place = _place(t, "predictions")
    sinks.write_predictions(t.scored.select("flow_id", "service", "predicted_attack", "predicted_vpn"), place)
    return captures.read_flows(t.spark, place)


@query("S6_write_clean", "select * from cleaned")
def _(t):
    place = _place(t, "clean")
    sinks.write_clean(t.cleaned, place, partition_by=["attack_cat"])
    return t.spark.read.parquet(place).select(*t.cleaned.columns)


_DRIFT = """with q as (select attack_cat as class, count(*)/sum(count(*)) over () as share from second_half group by 1),
 v as (select coalesce(p.share,0) as p, coalesce(q.share,0) as q from baseline p full outer join q on p.class=q.class),
 d as (select sqrt(greatest(0, sum(case when p>0 then p*ln(2*p/(p+q)) else 0 end + case when q>0 then q*ln(2*q/(p+q)) else 0 end)/2)) as js from v)
 select round(js,9) as js_distance, 0.2::double as threshold, case when js>0.2 then 'Concept Drift Detected' else 'No Concept Drift Detected' end as drift_status from d"""


@query("S7_write_drift", _DRIFT, ("baseline", "second_half"))
def _(t):
    place = _place(t, "drift")
    sinks.write_drift(drift(t.baseline, t.second_half, "attack_cat"), place)
    back = captures.read_flows(t.spark, place)
    numbers = {c: F.round(F.col(c).cast("double"), 9) for c in ("js_distance", "threshold")}
    return back.withColumns(numbers)


@query("S9_sample_input", "select proto, service, state, sbytes, dbytes from cleaned order by flow_id limit 100")
def _(t):
    return sinks.sample_input(t.cleaned, "flow_id", 100)


@query("S10_preview", "select * from cleaned order by flow_id limit 10")
def _(t):
    return sinks.preview(t.cleaned, "flow_id", 10)


@query("S11_read_predictions", "select predicted_attack as class, count(*) as n from scored group by 1", ("scored",))
def _(t):
    from flowlens.operators.stats import class_counts

    place = _place(t, "predicted")
    sinks.write_predictions(t.scored.select("flow_id", "predicted_attack"), place)
    return class_counts(captures.read_predictions(t.spark, place), "predicted_attack")


@query(
    "P3_detect_schema",
    """select 'ids' as input_type, count(*) as records from flows union all select 'vpn', count(*) from vpn
    union all select 'mixed', count(*) from flows f join vpn v on v.l_orderkey=f.flow_id
    union all select 'unsupported', count(*) from flows""",
    ("flows", "vpn"),
)
def _(t):
    """Captures of four headers in one set of folders, told apart by their columns."""
    place = _place(t, "types")
    both = t.flows.join(t.vpn, F.col("flow_id") == F.col("l_orderkey"))
    tables = {
        "ids": t.flows.drop("dbytes"),
        "vpn": t.vpn.drop("total_biat", "min_flowiat", "max_flowiat", "mean_flowiat"),
        "mixed": both,
        "other": t.flows.select("flow_id", "proto", "service", "state"),
    }
    folders = [_export(df, f"{place}/{name}") for name, df in tables.items()]
    counted = [
        df.agg(F.count("*").alias("records")).select(F.lit(kind).alias("input_type"), "records")
        for kind, df in captures.read_by_type(t.spark, folders).items()
    ]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


@query(
    "P4_require_columns",
    """select 'flows' as name, '' as missing, count(*) as records from flows union all select 'cleaned', '', count(*) from cleaned
    union all select 'vpn', 'proto,service,state,sbytes,dbytes', count(*) from vpn""",
    ("cleaned", "vpn"),
)
def _(t):
    """Which of the intrusion columns each table lacks; requiring them fails where there are any."""
    out = None
    for name, df in (("flows", t.flows), ("cleaned", t.cleaned), ("vpn", t.vpn)):
        missing = schema.missing_columns(df, domain.INTRUSION_COLUMNS)
        if not missing:
            df = schema.require_columns(df, domain.INTRUSION_COLUMNS)
        row = df.agg(F.count("*").alias("records")).select(
            F.lit(name).alias("name"), F.lit(",".join(missing)).alias("missing"), "records"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "P8_split_by_type",
    " union all ".join(
        f"""select '{c}' as "column", 'number' as kind, count({c}) as present from cleaned""" for c in ("flow_id", "sbytes", "dbytes", "label")
    )
    + " union all "
    + " union all ".join(f"select '{c}', 'text', count({c}) from cleaned" for c in ("proto", "service", "state", "attack_cat")),
)
def _(t):
    """Number and text columns of the cleaned corpus, with the values each holds."""
    numbers, words = schema.split_by_type(t.cleaned)
    counted = t.cleaned.agg(*[F.count(c).alias(c) for c in (*numbers, *words)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(c).alias("present"))
        for kind, columns in (("number", numbers), ("text", words))
        for c in columns
    ]
    return counted.select(F.inline(F.array(*rows)))


@query("E2_build_corpus", "select attack_cat as class, service, count(*) as n, sum(sbytes) as sbytes from cleaned group by 1, 2")
def _(t):
    """Captures with different headers, merged, cleaned, written and read again."""
    place = _place(t, "corpus")
    even, odd = t.flows.where("flow_id % 2 = 0"), t.flows.where("flow_id % 2 = 1")
    _export(even, f"{place}/even")
    _export(odd.select(*[F.col(c).alias(c.upper()) for c in reversed(odd.columns)]), f"{place}/odd")
    rows = jobs.build_intrusion_corpus(t.spark, [f"{place}/even", f"{place}/odd"], f"{place}/clean")
    return rows.groupBy(F.col("attack_cat").alias("class"), "service").agg(
        F.count("*").alias("n"), F.sum("sbytes").alias("sbytes")
    )


_RULE = "case when state in ('CON','FIN','INT') then 'Normal' when service in ('http','dns') then 'DoS' when service in ('ssh','smtp') then 'Exploits' else 'Worms' end"


@query(
    "E2_corpus_to_scores",
    f"""with t as (select {_RULE} as class, coalesce(state,'')<>'' as known from flows) select case when known then class end as class, count(*) as scored, case when known then true end as learned from t group by 1, known""",
    ("flows",),
)
def _(t):
    """Captures, corpus, training, evaluation, scoring: the classes found in the captures, and that each was learned.

    Rows without a state are scored, to a class that no rule tells: they are counted under none.
    """
    place = _place(t, "chain")
    named = t.flows.withColumn("attack_cat", F.expr(_RULE)).withColumn("label", F.lit("1"))
    _export(named, f"{place}/captures")
    corpus = jobs.build_intrusion_corpus(t.spark, [f"{place}/captures"], f"{place}/corpus")
    trained = jobs.train_recipe(corpus, "forest_baseline", f"{place}/model")
    recall = evaluate(trained)["per_class_recall"].select("class", (F.col("recall") >= 0.95).alias("learned"))
    report, _, _ = jobs.score_files(t.spark, f"{place}/captures", f"{place}/out", f"{place}/model")
    told = F.when(F.coalesce("state", F.lit("")) != "", F.col("predicted_attack"))
    scored = report.scored.where("predicted_attack is not null").groupBy(told.alias("class")).agg(F.count("*").alias("scored"))
    return scored.join(recall, "class", "left")


@query(
    "E3_build_vpn_corpus",
    """select class1, count(*) as n, round(sum(duration),2) as duration, round(sum(total_fiat),2) as total_fiat, round(sum(flowbytespersecond),2) as rate
    from (select distinct duration, total_fiat, total_biat, min_flowiat, max_flowiat, mean_flowiat, std_flowiat, flowbytespersecond, class1 from vpn) x group by 1""",
    ("vpn",),
)
def _(t):
    """Folders of captures, merged, typed, deduped, written and read again."""
    place = _place(t, "vpn")
    for number, part in enumerate(("l_linenumber < 3", "l_linenumber >= 3")):
        _export(t.vpn.where(part).select(*domain.VPN_COLUMNS, "class1"), f"{place}/{number}")
    corpus = jobs.build_vpn_corpus(t.spark, [f"{place}/0", f"{place}/1"], f"{place}/corpus")
    sums = {"duration": "duration", "total_fiat": "total_fiat", "flowbytespersecond": "rate"}
    return corpus.groupBy("class1").agg(
        F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(name) for c, name in sums.items()]
    )


@query(
    "E3_corpus_to_scores",
    "select case when max_flowiat > 0.04 then 'VPN' else 'Non-VPN' end as class, count(*) as scored, true as learned from vpn group by 1",
    ("vpn",),
)
def _(t):
    """VPN captures, corpus, training, evaluation, scoring."""
    place = _place(t, "vpn-chain")
    rows = t.vpn.withColumn("class1", F.expr("case when max_flowiat > 0.04 then 'VPN' else 'Non-VPN' end"))
    _export(rows.select(*domain.VPN_COLUMNS, "class1"), f"{place}/captures")
    corpus = jobs.build_vpn_corpus(t.spark, [f"{place}/captures"], f"{place}/corpus")
    trained = jobs.train_recipe(corpus, "forest_vpn", f"{place}/model")
    recall = evaluate(trained)["per_class_recall"].select("class", (F.col("recall") >= 0.95).alias("learned"))
    report, _, _ = jobs.score_files(t.spark, f"{place}/captures", f"{place}/out", None, f"{place}/model")
    scored = report.scored.groupBy(F.col("predicted_vpn").alias("class")).agg(F.count("*").alias("scored"))
    return scored.join(recall, "class")


@query(
    "E4_offline_drift",
    _DRIFT.replace("attack_cat as class, count(*)/sum", "predicted_attack as class, count(*)/sum").replace("from second_half", "from scored"),
    ("baseline", "scored"),
)
def _(t):
    """Written predictions read again, compared with the stored distribution, the verdict written and read."""
    place = _place(t, "offline")
    sinks.write_predictions(t.scored.select("flow_id", "predicted_attack"), f"{place}/predictions")
    jobs.drift_of_predictions(t.spark, f"{place}/predictions", t.baseline, f"{place}/verdict")
    back = captures.read_flows(t.spark, f"{place}/verdict")
    return back.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in ("js_distance", "threshold")})
