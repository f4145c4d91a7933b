"""End-to-end jobs: corpus building, training, scoring with roll-up (E1-E3, offline drift)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import domain
from flowlens.operators.cleaning import clean_flows, typed_by_content
from flowlens.operators.drift import drift
from flowlens.operators.relational import distinct_rows, enrich_intelligence, row_digest
from flowlens.operators.schema import normalize_columns, require_columns
from flowlens.operators.shared import repeat_rows, written_table
from flowlens.plans.recipes import RECIPES, Trained, load_recipe, save_recipe, train
from flowlens.plans.scoring import ScoreReport, score_captures
from flowlens.sources import captures, sinks


def build_intrusion_corpus(spark: SparkSession, paths: Iterable[str], output: str) -> DataFrame:
    """Merge named capture files, clean them, write Parquet, return the written table."""
    raw = captures.read_many(spark, paths)
    sinks.write_clean(clean_flows(raw), output)
    return spark.read.parquet(output)


def build_vpn_corpus(spark: SparkSession, folders: Iterable[str], output: str) -> DataFrame:
    """Merge folders of captures, type them, drop equal rows, write Parquet.

    Numbers are parsed before rows are compared, so 1 and 1.0 of two files are equal.
    """
    merged = normalize_columns(captures.read_dirs(spark, folders))
    typed = typed_by_content(merged, domain.VPN_COLUMNS, (domain.VPN_TARGET,))
    sinks.write_clean(distinct_rows(typed), output)
    return spark.read.parquet(output)


def with_row_id(df: DataFrame, name: str = "flow_id") -> DataFrame:
    """Unique id for a table that has none: digest of the row's content plus a copy number.

    Equal rows are counted and emitted again, numbered, so the ids do not depend on how the table
    happens to be partitioned, and no row is lost.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    digested = df.select(row_digest(df.columns).alias(name), whole.alias("__row"))
    copies = written_table(
        digested.groupBy(name).agg(F.any_value("__row").alias("__row"), F.count("*").alias("__n")), "copies"
    )
    most = copies.agg(F.max("__n").alias("m")).first()["m"] or 0
    rows = repeat_rows(copies, F.col("__n"), "__copy", name, most)
    return rows.select(*[F.col("__row")[c].alias(c) for c in df.columns], F.concat_ws("-", F.col(name), F.col("__copy")).alias(name))


def train_recipe(corpus: DataFrame, recipe: str, path: str, row_id: str = "flow_id", **overrides) -> Trained:
    """Train a named recipe on a corpus and store it."""
    table = require_columns(normalize_columns(corpus), [RECIPES[recipe].target], "corpus")
    if row_id not in table.columns:
        table = with_row_id(table, row_id)
    trained = train(RECIPES[recipe], table, row_id, **overrides)
    save_recipe(trained, path)
    return trained


def score_files(
    spark: SparkSession,
    path: str,
    output: str,
    intrusion_model: str | None = None,
    vpn_model: str | None = None,
    by: Sequence[str] = (),
) -> tuple[ScoreReport, DataFrame, DataFrame | None]:
    """Read captures, score them, write the predictions; returns report, metrics and attack facts.

    Files are told apart by header: each is scored by its own schema with its own medians, and the
    metrics know which rows had a supported one. Metrics and counts read the written predictions, so
    the models run once.
    """
    found = captures.open_flows(spark, path, on_error="skip")
    loaded, notes = [], []
    for place in (intrusion_model, vpn_model):
        trained, missing = load_recipe(spark, place) if place else (None, [])
        loaded.append(trained)
        notes += missing
    report = score_captures(found, *loaded)
    report.warnings += notes
    if sinks.write_predictions(report.scored, output, "parquet"):
        report.scored, report.output = spark.read.parquet(output), output
    counts = report.attack_counts(by)
    facts = None if counts is None else enrich_intelligence(counts, "class")
    return report, report.soc(by), facts


def drift_of_predictions(spark: SparkSession, predictions: str, distribution: DataFrame, output: str) -> DataFrame:
    """Offline drift: read written predictions, compare, write the verdict."""
    verdict = drift(distribution, captures.read_predictions(spark, predictions), "predicted_attack")
    sinks.write_drift(verdict, output)
    return verdict
