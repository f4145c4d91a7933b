"""Queries over encoding, sampling, training and scoring: F*, R*, L*."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from flowlens.functions import domain
from flowlens.operators import encoding, ensembles, sampling, vocabulary
from flowlens.operators.shared import scratch_path
from flowlens.operators.smote import smote
from flowlens.operators.stats import class_counts
from flowlens.plans import jobs, recipes
from flowlens.plans.registry import query
from flowlens.plans.scoring import score_auto, score_intrusion, score_vpn
from flowlens.sources import sinks

_LABEL, _ID = domain.INTRUSION_TARGET, "flow_id"
_CATEGORIES = domain.INTRUSION_CATEGORICAL


def _encoded(fit, rows, spec):
    facts = encoding.fit_facts(fit, spec)
    encoder = encoding.fit_one_hot(encoding.prepare(fit, spec, facts), spec)
    return encoder, facts, encoding.prepare(rows, spec, facts)


def _long_sql(source: str, number: str, word: str, known: str = "") -> str:
    """(flow_id, feature, value) of every non-zero feature."""
    parts = [f"select flow_id, '{c}' as feature, {number.format(c=c)} as value from {source}" for c in domain.INTRUSION_NUMERIC]
    parts += [
        f"select flow_id, '{c}_' || {word.format(c=c)} as feature, 1.0::double as value from {source} where {word.format(c=c)} is not null {known.format(c=c, w=word.format(c=c))}"
        for c in _CATEGORIES
    ]
    return f"select flow_id, feature, round(value,6) as value from ({' union all '.join(parts)}) x where value <> 0"


@query("F1_one_hot", _long_sql("cleaned", "{c}", "lower(trim({c}))"))
def _(t):
    spec = encoding.FeatureSpec()
    encoder, _, rows = _encoded(t.cleaned, t.cleaned, spec)
    return encoding.exploded_features(rows, encoder, spec, _ID)


_SEEN = "and {w} in (select lower(trim({c})) from first_half where service <> 'dns')"


@query("F2_align_features", _long_sql("second_half", "{c}", "lower(trim({c}))", _SEEN), ("first_half", "second_half"))
def _(t):
    """Fitted on rows without one service, so that service is unseen and encodes to zeros."""
    spec = encoding.FeatureSpec()
    encoder, _, rows = _encoded(t.first_half.where("service <> 'dns'"), t.second_half, spec)
    return encoding.exploded_features(rows, encoder, spec, _ID)


_MODED = """with moded as (select f.flow_id, try_cast(sbytes as double) as s, try_cast(dbytes as double) as d,
 coalesce(proto, (select proto from (select distinct * from flows) g where proto is not null group by 1 order by count(*) desc, 1 limit 1)) as proto,
 service, state from (select distinct * from flows) f),
 filled as (select flow_id, proto, service, state, coalesce(s,(select median(s) from moded)) as sbytes, coalesce(d,(select median(d) from moded)) as dbytes from moded),
 z as (select avg(sbytes) ms, stddev_pop(sbytes) ss, avg(dbytes) md, stddev_pop(dbytes) sd from filled),
 scaled as (select flow_id, proto, service, state, (sbytes-ms)/ss as sbytes, (dbytes-md)/sd as dbytes from filled, z)
"""


@query("F3_one_hot_modes", "select flow_id, 'proto_' || coalesce(proto, (select proto from (select distinct * from flows) g where proto is not null group by 1 order by count(*) desc, 1 limit 1)) as feature, 1.0::double as value from (select distinct * from flows) f", ("flows",))
def _(t):
    spec = encoding.FeatureSpec((), ("proto",), fill="mode", lower=False)
    rows = t.flows.dropDuplicates()
    encoder, _, rows = _encoded(rows, rows, spec)
    return encoding.exploded_features(rows, encoder, spec, _ID)


@query("F4_encode_label", f"select flow_id, {_LABEL}, cast(dense_rank() over (order by {_LABEL}) - 1 as double) as code, {_LABEL} as decoded from cleaned")
def _(t):
    coded, classes = encoding.encode_label(t.cleaned, _LABEL, "code")
    return encoding.decode_label(coded, "code", classes, "decoded").select(_ID, _LABEL, "code", "decoded")


@query(
    "F5_feature_columns",
    "select cast(row_number() over (order by k, feature) as int) as slot, feature from (select 0 as k, 'dbytes' as feature union all select -1, 'sbytes' "
    + " ".join(f"union all select distinct {i + 1}, '{c}_' || lower(trim({c})) from cleaned" for i, c in enumerate(_CATEGORIES))
    + ") x",
)
def _(t):
    spec = encoding.FeatureSpec()
    encoder, _, _ = _encoded(t.cleaned, t.cleaned, spec)
    names = encoding.feature_columns(encoder, spec)
    return t.spark.createDataFrame(list(enumerate(names, 1)), "slot int, feature string")


@query(
    "F6_mixed_preprocessor",
    _MODED + _long_sql("scaled", "{c}", "{c}"),
    ("flows",),
)
def _(t):
    spec = encoding.FeatureSpec(fill="mode", lower=False, scale=True)
    rows = t.flows.dropDuplicates()
    encoder, _, rows = _encoded(rows, rows, spec)
    long = encoding.exploded_features(rows, encoder, spec, _ID)
    return long.withColumn("value", F.round("value", 6))


# A category with a value of its own for nearly every row, beside the short ones.
_WIDE = {**{c: f"lower(trim({c}))" for c in _CATEGORIES}, "endpoint": "'h' || md5(cast(flow_id as varchar))"}
_SLOTS = (
    "select row_number() over (order by k, word) as slot, feature, k, word from (select -1 as k, 'sbytes' as word, 'sbytes' as feature union all select 0, 'dbytes', 'dbytes' "
    + " ".join(f"union all select distinct {i}, {w}, '{c}_' || {w} from cleaned where {w} is not null" for i, (c, w) in enumerate(_WIDE.items(), 1))
    + ") x"
)
_WIDE_LONG = " union all ".join(
    [f"select flow_id, '{c}' as feature, cast({c} as double) as value from cleaned where {c} <> 0" for c in domain.INTRUSION_NUMERIC]
    + [f"select flow_id, '{c}_' || {w}, 1.0::double from cleaned where {w} is not null" for c, w in _WIDE.items()]
)


def _wide(t):
    spec = encoding.FeatureSpec(categories=(*_CATEGORIES, "endpoint"))
    rows = t.cleaned.withColumn("endpoint", F.concat(F.lit("h"), F.md5(F.col(_ID).cast("string"))))
    prepared = encoding.prepare(rows, spec, encoding.fit_facts(rows, spec))
    return spec, prepared, vocabulary.fit_vocabulary(prepared, spec.categories)


@query("F1_one_hot_any_size", f"select flow_id, slot, l.feature, round(value, 6) as value from ({_WIDE_LONG}) l join ({_SLOTS}) s on l.feature = s.feature")
def _(t):
    """As F1, with a text column of as many values as rows and the vocabulary kept as a table."""
    spec, prepared, words = _wide(t)
    return vocabulary.slotted_features(prepared, words, spec.numbers, _ID).withColumn("value", F.round("value", 6))


@query("F5_feature_table", f"select slot, feature from ({_SLOTS}) s")
def _(t):
    spec, _, words = _wide(t)
    return vocabulary.feature_table(words, spec.numbers)


def _rank(seed: str) -> str:
    return f"row_number() over (partition by {_LABEL} order by md5('{seed}:' || cast(flow_id as varchar)), flow_id)"


_SPLIT = f"""select *, case when {_rank('42')} <= count(*) over (partition by {_LABEL}) - ceil(0.2*count(*) over (partition by {_LABEL}))
 then 'train' else 'test' end as split from cleaned"""


@query("R1_stratified_split", f"select flow_id, {_LABEL}, split from ({_SPLIT}) x")
def _(t):
    return sampling.tag_split(t.cleaned, _LABEL, _ID).select(_ID, _LABEL, "split")


_UNDER = f"""c as (select {_LABEL} as k, count(*) as n from cleaned group by 1),
 cap as (select 3*max(n) as cap from c where k<>'Normal'),
 under as (select x.* exclude (r) from (select *, {_rank('under-42')} as r from cleaned) x, cap where {_LABEL}<>'Normal' or r<=cap)"""


@query("R2_undersample", f"with {_UNDER} select * from under")
def _(t):
    cap = sampling.three_times_largest_other(t.cleaned, _LABEL)
    return sampling.undersample(t.cleaned, _LABEL, _ID, cap)


@query("R2_undersample_fixed_cap", f"select * exclude (r) from (select *, {_rank('under-42')} as r from cleaned) x where {_LABEL}<>'Normal' or r<=1000")
def _(t):
    return sampling.undersample(t.cleaned, _LABEL, _ID, 1000)


def _over(target: str, exempt: str = "false") -> str:
    return f"""with c as (select {_LABEL} as k, count(*) as n from cleaned group by 1),
    r as (select cleaned.*, n, {target} as target, {_rank('over-42')} as r from cleaned join c on c.k=cleaned.{_LABEL}),
    m as (select *, case when {exempt} or n>=target then 1 else target//n + case when r<=target%n then 1 else 0 end end as copies from r)
    select flow_id, {_LABEL}, unnest(generate_series(0, cast(copies as bigint)-1)) as copy from m"""


@query("R3_oversample", _over("(select max(n) from c)"))
def _(t):
    return sampling.oversample(t.cleaned, _LABEL, _ID).select(_ID, _LABEL, "copy")


@query("R3_oversample_target", _over("2500", f"{_LABEL}='Normal'"))
def _(t):
    grown = sampling.oversample(t.cleaned, _LABEL, _ID, target=2500, exempt=[domain.BENIGN_CLASS])
    return grown.select(_ID, _LABEL, "copy")


def _hex(key: str, start: int) -> str:
    return f"cast('0x' || substr({key},{start},8) as bigint)"


# Brute force over all pairs of a class: possible for SQL because the classes to boost are small.
_SMOTE = f"""with c as (select {_LABEL} as k, count(*) as n from cleaned group by 1),
 f as (select greatest(cast(floor(median(n)) as bigint),2000) as floor from c),
 s as (select greatest(1,least(5,min(n)-1)) as kk from c,f where n<floor),
 m as (select cleaned.*, n, floor, {_rank('smote-42')} as r from cleaned join c on c.k=cleaned.{_LABEL}, f where n<floor),
 w as (select *, (floor-n)//n + case when r<=(floor-n)%n then 1 else 0 end as wanted from m),
 v as (select {_LABEL}, sbytes, dbytes, proto, service, state, count(*) as copies, cast(sum(wanted) as bigint) as wanted, min(flow_id) as rep from w group by all),
 pairs as (select a.rep, b.sbytes, b.dbytes, b.proto, b.service, b.state, b.copies,
  (a.sbytes-b.sbytes)*(a.sbytes-b.sbytes)+(a.dbytes-b.dbytes)*(a.dbytes-b.dbytes)
   +case when a.proto<>b.proto then 2 else 0 end+case when a.service<>b.service then 2 else 0 end+case when a.state<>b.state then 2 else 0 end as dist,
  a.rep=b.rep as self from v a join v b on a.{_LABEL}=b.{_LABEL} where a.wanted>0),
 each as (select rep, sbytes, dbytes, proto, service, state, unnest(generate_series(1, least(5, copies - case when self then 1 else 0 end))) as copy, dist, self from pairs),
 near as (select *, row_number() over (partition by rep order by self desc, dist, sbytes, dbytes, proto, service, state) as pos from each),
 draws as (select v.*, unnest(generate_series(0, wanted-1)) as draw from v where wanted>0),
 keyed as (select *, md5('42:' || cast(rep as varchar) || ':' || cast(draw as varchar)) as key from draws),
 made as (select d.{_LABEL}, d.sbytes + ({_hex('key', 9)}/4294967296.0::double)*(near.sbytes-d.sbytes) as sbytes,
  d.dbytes + ({_hex('key', 9)}/4294967296.0::double)*(near.dbytes-d.dbytes) as dbytes,
  d.proto, d.service, d.state, near.proto as proto_nb, near.service as service_nb, near.state as state_nb,
  {_hex('key', 9)}/4294967296.0::double as gap, true as synthetic
  from keyed d, s, near where near.rep=d.rep and near.pos={_hex('key', 1)}%kk+1),
 whole as (select {_LABEL}, sbytes, dbytes, proto, service, state, proto as proto_nb, service as service_nb, state as state_nb, 0.0::double as gap, false as synthetic from cleaned
  union all select * from made)
 select {_LABEL}, round(sbytes,6) as sbytes, round(dbytes,6) as dbytes, proto, service, state, proto_nb, service_nb, state_nb, round(gap,9) as gap, synthetic from whole"""


@query("R4_smote", _SMOTE)
def _(t):
    grown = smote(t.cleaned)
    return grown.withColumns({"sbytes": F.round("sbytes", 6), "dbytes": F.round("dbytes", 6), "gap": F.round("gap", 9)})


_LANES = "concat('lane-', cast(l_orderkey % 50 as varchar(20)))"
_VPN_ID = "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(cast(round(total_fiat * 100) as bigint) as varchar(20)))"
_MEASURES = ", ".join(domain.VPN_COLUMNS)
_APART = " + ".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in domain.VPN_COLUMNS)
_BETWEEN = ", ".join(f"d.{c} + d.gap*(near.{c}-d.{c}) as {c}" for c in domain.VPN_COLUMNS)


@query(
    "R4_smote_eight_numbers",
    f"""with lanes as (select {_LANES} as lane, {_VPN_ID} as flow_id, {_MEASURES} from vpn),
    c as (select lane as k, count(*) as n from lanes group by 1), f as (select max(n) as floor from c),
    s as (select greatest(1,least(5,min(n)-1)) as kk from c,f where n<floor),
    m as (select lanes.*, n, floor, row_number() over (partition by lane order by md5('smote-42:' || flow_id), flow_id) as r from lanes join c on c.k=lane, f where n<floor),
    v as (select lane, {_MEASURES}, count(*) as copies, cast(sum((floor-n)//n + case when r<=(floor-n)%n then 1 else 0 end) as bigint) as wanted, min(flow_id) as rep from m group by all),
    pairs as (select a.rep, b.* exclude (rep, wanted, lane), {_APART} as dist, a.rep=b.rep as self from v a join v b on a.lane=b.lane where a.wanted>0),
    each as (select * exclude (copies), unnest(generate_series(1, least(5, copies - case when self then 1 else 0 end))) as copy from pairs),
    near as (select *, row_number() over (partition by rep order by self desc, dist, {_MEASURES}) as pos from each),
    draws as (select v.*, unnest(generate_series(0, wanted-1)) as draw from v where wanted>0),
    keyed as (select *, md5('42:' || rep || ':' || cast(draw as varchar)) as key from draws),
    d as (select *, {_hex('key', 9)}/4294967296.0::double as gap from keyed),
    made as (select d.lane, {_BETWEEN}, d.gap, true as synthetic from d, s, near where near.rep=d.rep and near.pos={_hex('key', 1)}%kk+1),
    whole as (select lane, {_MEASURES}, 0.0::double as gap, false as synthetic from lanes union all select * from made)
    select lane, {", ".join(f"round({c},8) as {c}" for c in domain.VPN_COLUMNS)}, round(gap,9) as gap, synthetic from whole""",
    ("vpn",),
)
def _(t):
    """All rows in fifty classes, each brought up to the largest by rows between neighbours in eight measures."""
    lanes = t.vpn.select(F.expr(_LANES).alias("lane"), F.expr(_VPN_ID).alias(_ID), *domain.VPN_COLUMNS)
    floor = class_counts(lanes, "lane").agg(F.max("n")).first()[0]
    grown = smote(lanes, "lane", _ID, domain.VPN_COLUMNS, (), floor=floor)
    return grown.withColumns({**{c: F.round(c, 8) for c in domain.VPN_COLUMNS}, "gap": F.round("gap", 9)})


@query(
    "R4_smote_counts",
    f"with c as (select {_LABEL} as class, count(*) as n from cleaned group by 1), f as (select greatest(floor(median(n)),2000) as floor from c) select class, cast(greatest(n, floor) as bigint) as n from c, f",
)
def _(t):
    return class_counts(smote(t.cleaned), _LABEL)


@query("R5_class_weights", f"with c as (select {_LABEL} as class, count(*) as n from cleaned group by 1) select class, n, round((select sum(n) from c)/((select count(*) from c)*n),9) as weight from c")
def _(t):
    return sampling.class_weights(t.cleaned, _LABEL).withColumn("weight", F.round("weight", 9))


_BAGS = recipes.RECIPES["forest_fast_balanced"].params["numTrees"]
_DRAWN = " + ".join(f"cast(x >= {mark} as bigint)" for mark in ensembles.poisson_marks())


@query(
    "R5_bag_class_weights",
    f"""with keyed as (select {_LABEL} as class, cast('0x' || substr(md5('42:' || cast(flow_id as varchar)),1,15) as bigint) % {ensembles.MODULUS - 1} + 1 as key from cleaned),
    bags as (select cast(unnest(range({_BAGS})) as int) as bag, unnest({ensembles.multipliers(_BAGS).tolist()}) as f),
    draws as (select bag, class, key*f % {ensembles.MODULUS} as x from keyed, bags),
    counts as (select bag, class, cast(sum({_DRAWN}) as bigint) as n from draws group by 1,2),
    whole as (select bag, sum(n) as total, count(*) as classes from counts where n>0 group by 1)
    select bag, class, n, round(case when n>0 then total/(classes*n) else 0 end,9) as weight from counts join whole using (bag)""",
)
def _(t):
    """Draws of each class in each bag of the fast balanced forest, and the weight the bag gives it."""
    coded, classes = encoding.encode_label(t.cleaned, _LABEL, "code")
    rows = coded.select(ensembles.bag_key(42, _ID).alias("key"), F.col("code").cast("int").alias("label"))
    counts = ensembles.bag_weights(ensembles.bag_class_counts(rows, _BAGS, len(classes)))
    named = encoding.decode_label(counts, "label", classes, "class")
    return named.select("bag", "class", "n", F.round("weight", 9).alias("weight"))


def _edges_sql() -> str:
    shares = ", ".join(f"{i / ensembles.BINS!r}" for i in range(1, ensembles.BINS))
    parts = [
        f"""select '{c}' as feature, unnest(case when count(distinct {c}) <= {ensembles.BINS} then list(distinct {c})
         else list_distinct(quantile_disc({c}, [{shares}])) end) as edge, min({c}) as low from {table}"""
        for table, names in (("cleaned", domain.INTRUSION_NUMERIC), ("vpn", domain.VPN_COLUMNS))
        for c in names
    ]
    return f"select feature, cast(edge as double) as edge from ({' union all '.join(parts)}) x where edge <> low"


@query("F6_number_bins", _edges_sql(), ("cleaned", "vpn"))
def _(t):
    """Where the trees' bins of each number begin: at quantiles, or at every value where there are few."""
    rows = []
    for df, names in ((t.cleaned, domain.INTRUSION_NUMERIC), (t.vpn, domain.VPN_COLUMNS)):
        edges = ensembles.quantile_edges(df, names)
        rows += [(c, e) for c in names for e in edges[c]]
    return t.spark.createDataFrame(rows, "feature string, edge double")


@query(
    "R6_resampling_report",
    f"with {_UNDER} select 'before' as stage, {_LABEL} as class, count(*) as n from cleaned group by 2 union all select 'after', {_LABEL}, count(*) from under group by 2",
)
def _(t):
    cap = sampling.three_times_largest_other(t.cleaned, _LABEL)
    return sampling.resampling_report(t.cleaned, sampling.undersample(t.cleaned, _LABEL, _ID, cap), _LABEL)


# Models run as their recipes say. They learn classes that follow from the features, so what SQL can
# foretell is held exact: the classes, their test rows, and that each is learned to a stated degree.
_LEARNED = 0.95
_MODELS: dict[tuple[str, str, str], tuple[str, str]] = {}


def _stored(t, name: str):
    """A recipe trained once per session and data folder; later calls load the stored model and test rows."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _MODELS:
        place = scratch_path(t.spark, f"recipe-{name}")
        recipe = recipes.RECIPES[name]
        trained = recipes.train(recipe, t.vpn_ruled if recipe.target == domain.VPN_TARGET else t.ruled)
        recipes.save_recipe(trained, place)
        trained.test.write.parquet(f"{place}/test")
        _MODELS[key] = (place, f"{place}/test")
    place, test = _MODELS[key]
    trained, _ = recipes.load_recipe(t.spark, place)
    trained.test = t.spark.read.parquet(test)
    return trained


def _report(t, name: str):
    report = recipes.evaluate(_stored(t, name))["classification_report"]
    return report.select("class", "support", (F.col("f1_score") >= _LEARNED).alias("learned"))


def _tested(table: str, label: str) -> str:
    """Class and support of the test side of the split."""
    rank = f"row_number() over (partition by {label} order by md5('42:' || cast(flow_id as varchar)), flow_id)"
    size = f"count(*) over (partition by {label})"
    return f"""select {label} as class, count(*) as support from (
     select {label}, case when {rank} <= {size} - ceil(0.2*{size}) then 'train' else 'test' end as split from {table}) x
     where split='test' group by 1"""


def _report_sql(table: str, label: str) -> str:
    return f"""with tested as ({_tested(table, label)}) select class, support, true as learned from tested
     union all select unnest(['accuracy','macro avg','weighted avg']), cast((select sum(support) from tested) as bigint), true"""


def _model_query(key: str, name: str) -> None:
    vpn = recipes.RECIPES[name].target == domain.VPN_TARGET
    view, label = ("vpn_ruled", "class1") if vpn else ("ruled", _LABEL)
    query(key, _report_sql(view, label), (view,))(lambda t: _report(t, name))


for _key, _name in (
    ("L1_forest_smote", "forest_smote"),
    ("L2_forest_oversampled", "forest_oversampled"),
    ("L3_forest_fast_balanced", "forest_fast_balanced"),
    ("L4_forest_baseline", "forest_baseline"),
    ("L5_forest_vpn", "forest_vpn"),
    ("L6_boosted", "boosted"),
    ("L7_perceptron", "perceptron"),
):
    _model_query(_key, _name)


# What the models were taught, for rows whose state they know.
_RULE = """case when state in ('CON','FIN','INT') then 'Normal' when coalesce(state,'')='' then null when service in ('http','dns') then 'DoS'
 when service in ('ssh','smtp') then 'Exploits' else 'Worms' end"""


@query("L8_score_intrusion", f"select flow_id, service, state, sbytes, {_RULE} as predicted_attack from flows", ("flows",))
def _(t):
    """Every row gets the class that follows from its features; rows without a state are left open."""
    scored = score_intrusion(t.flows, _stored(t, "forest_baseline"))
    known_state = F.coalesce(F.col("state"), F.lit("")) != ""
    predicted = F.when(known_state, F.col("predicted_attack")).alias("predicted_attack")
    return scored.select(_ID, "service", "state", "sbytes", predicted)


@query("L8_score_confidence", "select flow_id, attack_cat as predicted_attack, true as sure from ruled", ("ruled",))
def _(t):
    """Every cleaned row, its class, and that the model gives that class more than half."""
    scored = score_intrusion(t.ruled.drop(_LABEL, "label"), _stored(t, "forest_baseline"), confidence=True)
    sure = (F.col("predicted_attack_confidence") > 0.5) & (F.col("predicted_attack_confidence") <= 1)
    return scored.select(_ID, "predicted_attack", sure.alias("sure"))


@query(
    "L9_score_vpn",
    "select l_orderkey, l_linenumber, max_flowiat, case when max_flowiat > 0.04 then 'VPN' else 'Non-VPN' end as predicted_vpn from vpn",
    ("vpn",),
)
def _(t):
    """Every row gets the class that follows from its one telling measure."""
    scored = score_vpn(t.vpn.drop("class1"), _stored(t, "forest_vpn"))
    return scored.select("l_orderkey", "l_linenumber", "max_flowiat", "predicted_vpn")


@query("L8_scored_rows", "select *, true as known_class from flows", ("flows",))
def _(t):
    """Scoring keeps every row and column and predicts only classes of the training rows."""
    scored = score_intrusion(t.flows, _stored(t, "forest_baseline"))
    known = F.col("predicted_attack").isin(*domain.ATTACK_CLASSES)
    return scored.withColumn("known_class", known).drop("predicted_attack")


@query("L9_scored_rows", "select l_orderkey, l_linenumber, duration, total_fiat, true as known_class from vpn", ("vpn",))
def _(t):
    """As above for VPN scoring, from four of the eight columns: the others count 0."""
    part = t.vpn.select("l_orderkey", "l_linenumber", "duration", "total_fiat")
    scored = score_vpn(part, _stored(t, "forest_vpn"))
    return scored.withColumn("known_class", F.col("predicted_vpn").isin("VPN", "Non-VPN")).drop("predicted_vpn")


@query(
    "L10_score_auto",
    f"""select service, count(*) as total_records, count(*) as total_attacks, 100.0::double as attack_percentage, round(count(*) filter (max_flowiat > 0.04)/count(*)*100,2) as vpn_percentage, true as bounded
    from flows f join vpn v on v.l_orderkey=f.flow_id group by service""",
    ("flows", "vpn"),
)
def _(t):
    """Flows joined with VPN measures: both models run, metrics roll up per service.

    Every row gets an attack class, so a scored table scores at least 50 points; the distance has
    an upper bound, and with it the score.
    """
    both = t.flows.join(t.vpn, F.col(_ID) == F.col("l_orderkey"))
    both = both.drop("l_orderkey", "l_linenumber", "class1", "label", _LABEL)
    report = score_auto(both, _stored(t, "forest_baseline"), _stored(t, "forest_vpn"))
    metrics = report.soc(["service"])
    bounded = F.col("risk_score").between(50, 100) & F.col("js_distance").between(0, 0.8326)
    return metrics.select(
        "service", "total_records", "total_attacks", "attack_percentage", "vpn_percentage", bounded.alias("bounded")
    )


@query("L11_evaluate", f"with tested as ({_tested('ruled', _LABEL)}) select class, support, true as learned from tested", ("ruled",))
def _(t):
    """Evaluation covers exactly the untouched test rows of each class."""
    scores = recipes.evaluate(_stored(t, "forest_baseline"))["per_class_recall"]
    return scores.select("class", "support", (F.col("recall") >= _LEARNED).alias("learned"))


@query(
    "S8_save_load_recipe",
    f"select {_LABEL} as class, round(count(*)/sum(count(*)) over (),9) as share, true as predicts from ({_SPLIT.replace('from cleaned', 'from ruled')}) x where split='train' group by 1",
    ("ruled",),
)
def _(t):
    """Train, store, load: the loaded class distribution, and that the loaded model scores all rows."""
    place = scratch_path(t.spark, "recipes")
    recipes.save_recipe(_stored(t, "forest_baseline"), place)
    loaded, _ = recipes.load_recipe(t.spark, place)
    missed = score_intrusion(t.cleaned, loaded).where("predicted_attack is null").agg(F.count("*")).scalar()
    return loaded.distribution.select("class", F.round("share", 9).alias("share"), (missed == 0).alias("predicts"))


@query(
    "E1_score_files",
    """select count(*) as total_records, count(*) as total_attacks, 100.0::double as attack_percentage, true as bounded,
    count(*) as written from flows""",
    ("flows",),
)
def _(t):
    """Captures on disk, scored with a stored recipe, written, rolled up."""
    place = scratch_path(t.spark, "scored")
    recipes.save_recipe(_stored(t, "forest_baseline"), f"{place}/model")
    sinks.write_clean(t.flows.drop(_LABEL, "label"), f"{place}/captures", "csv")
    report, metrics, _ = jobs.score_files(t.spark, f"{place}/captures", f"{place}/out", f"{place}/model")
    bounded = F.col("risk_score").between(50, 94.98) & F.col("js_distance").between(0, 0.8326)
    written = report.scored.agg(F.count("predicted_attack")).scalar()
    return metrics.select(
        "total_records", "total_attacks", "attack_percentage", bounded.alias("bounded"), written.alias("written")
    )


@query(
    "E1_score_folder_by",
    f"""select 'ids' as folder, count(*) as total_records, count(*) as total_attacks, 0.0::double as vpn_percentage, false as unsupported, true as judged from flows
    union all select 'vpn', count(*), 0, round(count(*) filter (max_flowiat > 0.04)/count(*)*100,2), false, true from vpn
    union all select 'mixed', count(*), count(*), round(count(*) filter (max_flowiat > 0.04)/count(*)*100,2), false, true from flows f join vpn v on v.l_orderkey=f.flow_id
    union all select 'other', count(*), 0, 0.0::double, true, true from flows""",
    ("flows", "vpn"),
)
def _(t):
    """One folder with captures of four headers: each is scored by its own schema and judged by its own rows.

    Captures without an attack model have neither attacks nor drift; unsupported ones no score at all.
    """
    place = scratch_path(t.spark, "scored")
    recipes.save_recipe(_stored(t, "forest_baseline"), f"{place}/ids-model")
    recipes.save_recipe(_stored(t, "forest_vpn"), f"{place}/vpn-model")
    flows = t.flows.drop(_LABEL, "label")
    both = flows.join(t.vpn.drop("class1", "l_linenumber"), F.col(_ID) == F.col("l_orderkey")).drop("l_orderkey")
    tables = {"ids": flows, "vpn": t.vpn.drop("class1"), "mixed": both, "other": t.flows.select(_ID, "proto", "service", "state")}
    for name, df in tables.items():
        sinks.write_clean(df, f"{place}/captures/kind={name}", "csv")
    report, _, _ = jobs.score_files(
        t.spark, f"{place}/captures", f"{place}/out", f"{place}/ids-model", f"{place}/vpn-model", by=["source_file"]
    )
    # Any number of files per folder; the stored predictions are rolled up by the folder they came from.
    folder = F.regexp_extract("source_file", "kind(?:=|%3D)([a-z]+)", 1)
    metrics = replace(report, scored=report.scored.withColumn("folder", folder)).soc(["folder"])
    quiet = ~F.col("drift_detected") & (F.col("threat_level") == "Low") & (F.col("risk_score") <= 20)
    judged = (
        F.when(F.col("folder") == "other", (F.col("threat_level") == "N/A") & (F.col("risk_score") == 0))
        .when(F.col("folder") == "vpn", quiet & F.col("js_distance").isNull())
        .otherwise(F.col("js_distance").between(0, 0.8326) & (F.col("risk_score") >= 50))
    )
    return metrics.select(
        "folder",
        "total_records",
        "total_attacks",
        "vpn_percentage",
        (F.col("threat_level") == "N/A").alias("unsupported"),
        judged.alias("judged"),
    )
