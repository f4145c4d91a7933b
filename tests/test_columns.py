import pytest
from pyspark.sql import functions as F

from flowlens.functions import domain, numeric, text, threat
from flowlens.operators import cleaning, relational, schema


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(df, expression):
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_strip_covers_all_whitespace(spark):
    df = column(spark, ["\t tcp\n", "\u00a0udp\u3000", "a b", "", None])
    assert apply(df, text.strip(F.col("v"))) == ["tcp", "udp", "a b", "", None]


def test_read_null_tokens_keep_dash(spark):
    df = column(spark, [*domain.READ_NULL_TOKENS, "-", "Null", "none"])
    got = apply(df, text.null_on_read(F.col("v")))
    assert got == [None] * len(domain.READ_NULL_TOKENS) + ["-", "Null", "none"]


def test_coerce_number(spark):
    df = column(spark, ["12", " 1e3 ", "1d", "2f", "0x1p3", "inf", "-Infinity", "nan", "", ".5", "5.", "1,5", None])
    got = apply(df, numeric.coerce_number(F.col("v")))
    inf = float("inf")
    assert got == [12.0, 1000.0, None, None, None, inf, -inf, None, None, 0.5, 5.0, None, None]


def test_class_cleaning(spark):
    df = column(spark, [" Backdoors", "Reconnaissance ", "--", "-", "", "NULL", "normal", None])
    got = apply(df, text.clean_class(text.strip(F.col("v"))))
    assert got == ["Backdoor", "Reconnaissance", None, None, None, None, "normal", None]


def test_threat_bands(spark):
    df = column(spark, [34.99, 35.0, 69.99, 70.0, 0.0], "double")
    no, yes = F.lit(False), F.lit(True)
    assert apply(df, threat.threat_level(F.col("v"), no, no)) == ["Low", "Medium", "Medium", "High", "Low"]
    assert apply(df, threat.threat_level(F.col("v"), yes, no)) == ["Medium", "Medium", "Medium", "High", "Medium"]
    assert apply(df, threat.threat_level(F.col("v"), yes, yes)) == ["N/A"] * 5


@pytest.mark.parametrize(
    "ids, vpn, expected",
    [(3, 0, "unsupported"), (4, 0, "ids"), (5, 3, "ids"), (3, 4, "vpn"), (0, 8, "vpn"), (4, 4, "mixed"), (5, 8, "mixed")],
)
def test_detect_schema(ids, vpn, expected):
    header = [f" {c.upper()}" for c in domain.INTRUSION_COLUMNS[:ids]] + list(domain.VPN_COLUMNS[:vpn])
    found = schema.detect_schema(header)
    assert found.input_type == expected
    assert len(found.ids_matched) == ids and len(found.ids_missing) == 5 - ids
    assert len(found.vpn_matched) == vpn and found.vpn_missing == sorted(found.vpn_missing)


def test_require_columns_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="sbytes"):
        schema.require_columns(spark.range(1).toDF("proto"), ["proto", "sbytes"])


def test_split_by_type(spark):
    df = spark.createDataFrame([("a", 1, 2.0, True)], "w string, n int, x double, b boolean")
    assert schema.split_by_type(df) == (["n", "x"], ["w"])


def test_duplicate_columns_keep_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Sbytes", "proto", "y"]).toDF("Sbytes", "proto", " sbytes ")
    kept, warnings = schema.dedupe_columns(df)
    assert kept.columns == ["sbytes", "proto"] and kept.first()["sbytes"] == 1
    assert "['sbytes']" in warnings[0]


def test_union_of_conflicting_types_is_text(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([("bad",)], "X string")
    assert sorted(r["x"] for r in relational.union_all([a, b]).collect()) == ["1", "bad"]


def raw(spark, rows):
    return spark.createDataFrame(rows, "proto string, service string, state string, sbytes string, dbytes string, attack_cat string, label string, ttl string")


ROWS = [
    ("tcp", "http", "CON", "10", "1", None, "0", "a"),
    ("tcp", "http", "CON", "10", "1", None, "0", "a"),  # whole-row copy
    ("tcp", "http", "CON", "10", "1", None, "0", "b"),  # differs outside the kept columns
    (" udp ", "-", "nan", "bad", "3", " Backdoors", "1", "a"),
    (None, None, None, "30", None, "-", "1", "a"),  # class unresolved
    ("tcp", "dns", "FIN", "40", "5", "Bogus", "1", "a"),  # class invalid
    ("tcp", "dns", "FIN", "1000", "7", "DoS", None, "a"),  # label missing, still counts for medians
]


def test_cleaning_order(spark):
    got = cleaning.clean_flows(raw(spark, ROWS)).collect()
    assert len(got) == 3
    backdoor = next(r for r in got if r["attack_cat"] == "Backdoor")
    # Median of 10, 10, 30, 40, 1000: the copy is gone, rows dropped later still count.
    assert backdoor["sbytes"] == 30.0 and backdoor["proto"] == "udp" and backdoor["state"] == "unknown_feature"
    assert [r["attack_cat"] for r in got].count("Normal") == 2


def test_cleaning_audit(spark):
    row = cleaning.cleaning_audit(raw(spark, ROWS)).first()
    assert row.asDict() == {
        "rows_in": 7,
        "after_dedupe": 6,
        "dropped_missing_label": 1,
        "dropped_unresolved": 1,
        "removed_invalid": 1,
        "rows_out": 3,
    }


def test_digest_dedupe_tells_shifted_values_apart(spark):
    df = spark.createDataFrame([("ab", "c", 1), ("a", "bc", 1), ("ab", "c", 1), (None, "-", 1), ("-", None, 1)], "a string, b string, k int")
    assert relational.distinct_projection(df, ["k"]).count() == 4


def test_intelligence_is_exact_case(spark):
    df = spark.createDataFrame([("DoS",), ("dos",)], "class string")
    got = {r["class"]: r["severity"] for r in relational.enrich_intelligence(df, "class").collect()}
    assert got == {"DoS": "High", "dos": "Unknown"}
