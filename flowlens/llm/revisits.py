"""Not-modified revisits of web archives, resolved against the latest earlier full response.

Records are matched by canonical URL in an as-of join. Time is cut at its quantiles into slices of
about equally many records; within a slice a window finds the last full response before each revisit,
and the last response of each earlier slice is carried over in a table of one row per URL and slice.
So a URL with a large share of all records is spread over as many tasks as there are slices, also
where a few times are far off or crawls come in bursts; only records of one URL and one time stay
together. Bodies take no part in the join by time: they are fetched afterwards by record id, and a
body that very many revisits take is copied to as many parts as these are dealt into.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.shared import written_table

# Slices of time, at least, and records of a slice beyond that.
SLICES = 256
SLICE_RECORDS = 1_000_000
# Revisits that may meet on one body, and bodies at most that have more: then each has more than its share of all.
BODY_REVISITS = 10_000
HOT_BODIES = 25_000

# Fields that a not-modified answer does not update in a stored response.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
               "proxy-connection", "trailer", "transfer-encoding", "upgrade"]
# Query parameters that only track visitors.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|jsessionid)"


def canonical_url(url: Column) -> Column:
    """One spelling per resource: no scheme, user, www., default port, fragment, tracking parameters or
    closing slash; host in lower case, the other parameters in order. Null if there is no host."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"^www\d?\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(
        F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(?:=|$)"))), "&"
    )
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def field(headers: Column, name: str) -> Column:
    """A header's value by lower-case name; the last one if names differ in case only."""
    return F.element_at(F.filter(F.map_entries(headers), lambda e: F.lower(F.trim(e["key"])) == name), -1)["value"]


def lowered(headers: Column) -> Column:
    """Headers by lower-case name, the last of equal names."""
    entries = F.transform(
        F.coalesce(F.map_entries(headers), F.expr("array()").cast("array<struct<key: string, value: string>>")),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def weak_tag(tag: Column) -> Column:
    """An entity tag without its weakness mark, for weak comparison."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def time_slices(timed: DataFrame, slices: int | None) -> Bucketizer:
    """Cuts ``micros`` into ``slice`` at its quantiles; equal times share a slice."""
    if slices is None:
        slices = max(SLICES, timed.count() // SLICE_RECORDS)
    shares = [i / slices for i in range(1, slices)] or [0.5]
    cuts = timed.agg(F.percentile_approx("micros", shares, max(10_000, 10 * slices))).first()[0] or [0]
    inner = sorted({float(c) for c in cuts})
    return Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="micros", outputCol="slice")


def with_bodies(judged: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows with the body (body_of, body) that ``taken`` names; hot bodies are copied, their takers dealt out."""
    takers = judged.where("taken is not null").groupBy(F.col("taken").alias("hot")).agg(F.count("*").alias("n"))
    most = max(BODY_REVISITS, judged.where("taken is not null").count() // HOT_BODIES)
    # Fewer than HOT_BODIES rows, as each stands for more than that share of the revisits.
    hot = F.broadcast(takers.where(F.col("n") > most).select("hot", F.ceil(F.col("n") / most).alias("parts")))
    dealt = judged.withColumn("row", F.monotonically_increasing_id()).join(hot, F.col("taken") == F.col("hot"), "left")
    dealt = dealt.withColumn("part", F.pmod("row", "parts"))
    # Rows that take no body are spread by their own id instead of meeting under one empty key.
    key = F.coalesce("taken", F.xxhash64("record_id", "row"))
    single = dealt.where("part is null").join(largest(bodies), (key == F.col("body_of")) & F.col("taken").isNotNull(), "left")
    copied = largest(bodies.join(hot, F.col("body_of") == F.col("hot"), "left_semi"))
    copied = copied.join(hot, F.col("body_of") == F.col("hot")).select(
        "body_of", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("body_part")
    )
    several = dealt.where("part is not null").join(
        copied, (F.col("taken") == F.col("body_of")) & (F.col("part") == F.col("body_part")), "left"
    )
    return single.unionByName(several.drop("body_part"))


def largest(bodies: DataFrame) -> DataFrame:
    """One body per id."""
    return bodies.groupBy("body_of").agg(F.max("body").alias("body"))


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """Each not-modified revisit with the full response it stands for.

    ``records``: record_id (long), kind ('response' or 'revisit'), url, at (timestamp), status (int),
    headers (map of strings) and body. Full responses are responses of status 200 with a URL. For a
    revisit, the latest one of the same canonical URL at an earlier time counts; of several at one
    time, that with the largest record_id. Returns, per revisit: record_id, canonical_url,
    response_id, outcome, headers and body. The outcome is

    * ``resolved``: the entity tags are equal by weak comparison or, if either is missing, the dates
      of last modification are. headers are the response's, updated by the revisit's but for fields
      that describe the transfer or the body; body is the response's.
    * ``unconfirmed``: neither validator is in both records; headers and body as if resolved.
    * ``changed``: validators differ. response_id is given, headers are the revisit's, body is null.
    * ``missing``: no earlier full response, or no URL or time. headers are the revisit's.

    Null headers count as empty. Records repeated whole give repeated rows; of several bodies
    under one id the largest counts. Other columns are ignored. An empty table gives an empty result.
    ``slices`` of time: by default one per million records, ``SLICES`` at least.
    """
    slim = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        F.col("kind").alias("kind"),
        canonical_url(F.col("url").cast("string")).alias("canonical_url"),
        F.col("at").cast("timestamp").alias("at"),
        F.col("status").cast("int").alias("status"),
        lowered(F.col("headers")).alias("headers"),
    )
    known = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    full = (F.col("kind") == "response") & (F.col("status") == 200) & known
    response = F.when(
        full, F.struct(F.unix_micros("at").alias("time"), F.col("record_id").alias("id"), F.col("headers").alias("of"))
    )
    timed = slim.withColumn("micros", F.unix_micros("at")).withColumn("response", response)
    timed = timed.where(known & (full | (F.col("kind") == "revisit")))
    timed = time_slices(timed, slices).transform(timed)
    # A revisit sees what lies strictly before it, so at equal times it comes first.
    order = Window.partitionBy("canonical_url", "slice").orderBy("at", F.col("response").isNotNull(), "record_id")
    here = F.last("response", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = timed.where("response is not null").groupBy(
        F.col("canonical_url").alias("of_url"), F.col("slice").alias("of_slice")
    ).agg(F.max_by("response", F.struct("response.time", "response.id")).alias("end"))
    spots = timed.groupBy(F.col("canonical_url").alias("of_url"), F.col("slice").alias("of_slice")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("of_url").orderBy("of_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.join(ends, ["of_url", "of_slice"], "left").select(
        "of_url", "of_slice", F.last("end", ignorenulls=True).over(before).alias("earlier")
    )
    same = (F.col("canonical_url") == F.col("of_url")) & (F.col("slice") == F.col("of_slice"))
    matched = (
        timed.withColumn("here", here).where("kind = 'revisit'").join(carried, same, "left")
        .withColumn("found", F.coalesce("here", "earlier"))
        .select("record_id", "canonical_url", "headers", "found")
    )
    alone = slim.where((F.col("kind") == "revisit") & ~known).select(
        "record_id", "canonical_url", "headers", F.lit(None).cast(matched.schema["found"].dataType).alias("found")
    )
    revisits = matched.unionByName(alone)

    tag, theirs = weak_tag(F.col("headers")["etag"]), weak_tag(F.col("found.of")["etag"])
    date, their_date = F.col("headers")["last-modified"], F.col("found.of")["last-modified"]
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(tag.isNotNull() & theirs.isNotNull(), F.when(tag == theirs, "resolved").otherwise("changed"))
        .when(date.isNotNull() & their_date.isNotNull(), F.when(date == their_date, "resolved").otherwise("changed"))
        .otherwise("unconfirmed")
    )
    updates = F.map_filter("headers", lambda k, v: ~k.isin(KEPT_FIELDS))
    stored = F.map_filter("found.of", lambda k, v: ~F.map_contains_key(updates, k))
    judged = revisits.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        F.col("found.id").alias("response_id"),
        "outcome",
        F.when(F.col("outcome").isin("resolved", "unconfirmed"), F.map_concat(stored, updates))
        .otherwise(F.col("headers"))
        .alias("headers"),
    )
    taken = F.when(F.col("outcome").isin("resolved", "unconfirmed"), F.col("response_id"))
    bodies = records.where((F.col("kind") == "response") & (F.col("status") == 200)).select(
        F.col("record_id").cast("long").alias("body_of"), "body"
    )
    judged = written_table(judged.withColumn("taken", taken), "judged-revisits")
    return with_bodies(judged, bodies).select(
        "record_id", "canonical_url", "response_id", "outcome", "headers", "body"
    )
