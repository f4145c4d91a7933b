"""Physical plans: no pairwise joins, no row-at-a-time Python, pruned and pushed-down scans."""

import pytest

import __spark_entry__ as entry_point
from conftest import SMALL
from flowlens.operators import relational, sampling, stats
from flowlens.operators.cleaning import REQUIRED
from flowlens.operators.drift import drift
from flowlens.operators.shared import written_table
from flowlens.operators.soc import soc_metrics

CHECKED = [
    "A2_class_counts_by",
    "A3_class_distribution",
    "A10_classification_report",
    "A13_drift_by",
    "A16_soc_metrics_by",
    "A18_clean_flows",
    "J1_enrich_intelligence",
    "R1_stratified_split",
    "R2_undersample",
    "R3_oversample",
    "R4_smote",
    "S1_read_flows",
    "U3_class_set_operations",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(entry_point.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_split_tags_rows_without_a_shuffle(spark, tables):
    text = plan(sampling.tag_split(tables.cleaned, "attack_cat", "flow_id"))
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_counts_read_one_column(spark, tables):
    text = plan(stats.class_counts(tables.cleaned, "attack_cat"))
    assert "ReadSchema: struct<attack_cat:string>" in text and "IsNotNull(attack_cat)" in text


def test_dedupe_shuffles_digest_and_kept_columns_only(spark, tables, tmp_path):
    wide = tables.flows
    for i in range(20):
        wide = wide.withColumn(f"extra{i}", wide["sbytes"])
    text = plan(relational.distinct_projection(wide, list(REQUIRED)))
    exchange = text[text.index("Exchange hashpartitioning") :].split("\n")[0]
    assert "__digest" in exchange and "extra" not in exchange


@pytest.mark.parametrize("by", [[], ["service"]])
def test_metrics_and_drift_read_each_input_once(spark, tables, by):
    scored, baseline = written_table(tables.scored, "scored"), written_table(tables.baseline, "shares")
    for df in (soc_metrics(scored, baseline, by, "mixed"), drift(baseline, scored, "attack_cat", by=by)):
        text = plan(df)
        assert text.count("FileScan") == 1 and "Subquery" not in text


def test_class_tables_are_counted_once(spark, tables):
    for df in (
        stats.class_distribution(tables.cleaned, "attack_cat"),
        stats.class_count_stats(tables.cleaned, "attack_cat"),
        sampling.class_weights(tables.cleaned, "attack_cat"),
    ):
        assert plan(df).count("FileScan") == 1
