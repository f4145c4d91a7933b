"""Scoring routed by detected schema, and the roll-up of a scored table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowlens.functions import domain, numeric
from flowlens.operators import schema
from flowlens.operators.drift import drift
from flowlens.operators.encoding import PREFIX, prepare
from flowlens.operators.relational import union_all
from flowlens.operators.shared import checked_lookup, join_lookup, written_table
from flowlens.operators.soc import ATTACK, KIND, VPN, soc_metrics
from flowlens.operators.stats import class_counts, column_medians, fit_medians
from flowlens.plans.recipes import Trained
from flowlens.sources import sinks
from flowlens.sources.captures import SOURCE, Captures

# ---- fixed values: warnings ----------------------------------------------------------
VPN_SKIPPED = "VPN module skipped — file matches IDS schema ({n}/5 IDS columns found)."
IDS_SKIPPED = (
    "IDS module skipped — file matches VPN schema ({n}/8 VPN columns found). "
    "Concept drift detection is only available for IDS-compatible files."
)
MIXED = (
    "Mixed schema detected — file contains both IDS and VPN columns. "
    "Both models will run independently, but results may be less reliable "
    "unless both feature sets come from the same real network capture."
)
UNSUPPORTED = (
    "Unsupported dataset schema. IDS columns matched: {i}/5 {ids}. "
    "VPN columns matched: {v}/8 {vpn}. At least 4 columns from either schema are required."
)
IDS_INCOMPLETE = "IDS prediction skipped: missing IDS columns {missing}."
NO_MODEL = "{module} prediction skipped: no model given."


# Ending of the column that tells how sure a model is of its class.
CONFIDENCE = "_confidence"
# Prefixes of numbers parsed from a text column, and of that column while a model reads the numbers in its place.
_PARSED, _TEXT = "__parsed_", "__text_"


def _apply(
    df: DataFrame, trained: Trained, source: DataFrame, impute_from: str, by: Sequence[str] = (), confidence: bool = False
) -> DataFrame:
    """Original columns plus the prediction, with ``confidence`` also the share the model gives to the predicted
    class. ``source`` is the model's view of the same rows; numbers parsed before are read in place of their text."""
    medians = None
    parsed = [c for c in trained.spec.numbers if c in source.columns and _PARSED + c in source.columns]
    if parsed:
        numbers = [F.col(_PARSED + c if c in parsed else c).alias(c) for c in source.columns]
        source = source.select(*numbers, *[F.col(c).alias(_TEXT + c) for c in parsed])
    kept = [F.col(_TEXT + c).alias(c) if c in parsed else F.col(c) for c in df.columns]
    present = [c for c in trained.spec.numbers if c in source.columns]
    if impute_from == "input" and present:
        if by:
            source, medians = _attach_medians(source, present, list(by))
        else:
            medians = fit_medians(source, present)
    prepared = prepare(source, trained.spec, trained.facts, trained.recipe.scoring_fill, medians)
    scored = trained.model.transform(prepared)
    if not confidence:
        return scored.select(*kept, trained.recipe.output)
    share = F.col("probability")
    if not isinstance(scored.schema["probability"].dataType, ArrayType):
        share = vector_to_array(share)
    return scored.select(*kept, trained.recipe.output, F.array_max(share).alias(trained.recipe.output + CONFIDENCE))


def _attach_medians(df: DataFrame, columns: Sequence[str], by: list[str]) -> tuple[DataFrame, dict]:
    """Rows with the medians of their key, found in a lookup of checked size."""
    long = column_medians(df, columns, by)
    wide = long.groupBy(*by).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"{PREFIX}median_{c}") for c in columns]
    )
    return join_lookup(df, checked_lookup(wide), by), {c: F.col(f"{PREFIX}median_{c}") for c in columns}


def score_intrusion(
    df: DataFrame, trained: Trained, impute_from: str = "input", by: Sequence[str] = (), confidence: bool = False
) -> DataFrame:
    """Add ``predicted_attack``. Missing numbers take the median of the scored table itself, per key
    if ``by`` names one (as the source file), or with ``impute_from="train"`` the stored one, which
    saves a pass. ``confidence`` adds ``predicted_attack_confidence``."""
    schema.require_columns(df, domain.INTRUSION_COLUMNS, "intrusion scoring")
    return _apply(df, trained, df, impute_from, by, confidence)


def score_vpn(
    df: DataFrame, trained: Trained, impute_from: str = "input", by: Sequence[str] = (), confidence: bool = False
) -> DataFrame:
    """Add ``predicted_vpn``; a feature the table lacks counts 0. ``confidence`` adds ``predicted_vpn_confidence``."""
    return _apply(df, trained, df, impute_from, by, confidence)


@dataclass
class ScoreReport:
    """Lazy results of scoring; nothing runs until a member is read by an action.

    ``input_type`` is "several" for captures of different schemas; ``detection`` is that of the first
    header then, and the scored table tells the type of each row. ``output`` is where the predictions
    were written.
    """

    input_type: str
    detection: schema.Detection
    scored: DataFrame
    warnings: list[str] = field(default_factory=list)
    distribution: DataFrame | None = None
    output: str | None = None

    @property
    def columns(self) -> list[str]:
        added = (ATTACK, VPN, KIND, f"{ATTACK}{CONFIDENCE}", f"{VPN}{CONFIDENCE}")
        return [c for c in self.scored.columns if c not in added]

    @property
    def has_predictions(self) -> bool:
        return ATTACK in self.scored.columns or VPN in self.scored.columns

    def total_records(self) -> int:
        return self.scored.count()

    def preview(self, order: str | Sequence[str], n: int = 10) -> DataFrame:
        """First rows in key order."""
        return sinks.preview(self.scored, order, n)

    def attack_counts(self, by=()) -> DataFrame | None:
        return class_counts(self.scored, ATTACK, by) if ATTACK in self.scored.columns else None

    def vpn_counts(self, by=()) -> DataFrame | None:
        return class_counts(self.scored, VPN, by) if VPN in self.scored.columns else None

    def concept_drift(self, by=()) -> DataFrame | None:
        if ATTACK not in self.scored.columns or self.distribution is None:
            return None
        return drift(self.distribution, self.scored, ATTACK, by=by)

    def soc(self, by=()) -> DataFrame:
        kind = None if KIND in self.scored.columns else self.input_type
        return soc_metrics(self.scored, self.distribution, by, kind)


def score_auto(
    df: DataFrame,
    intrusion: Trained | None = None,
    vpn: Trained | None = None,
    impute_from: str = "input",
    by: Sequence[str] = (),
    confidence: bool = False,
) -> ScoreReport:
    """Detect the schema, run the models it calls for, and collect the warnings.

    ``confidence`` adds how sure each model is of its class.

    Spark evaluates later, so whatever can fail is checked on the columns before a plan is built.
    """
    table, warnings = schema.dedupe_columns(df)
    found = schema.detect_schema(table.columns)
    kind = found.input_type
    report = ScoreReport(kind, found, table, warnings)
    if kind == "unsupported":
        warnings.append(
            UNSUPPORTED.format(
                i=len(found.ids_matched), ids=found.ids_matched, v=len(found.vpn_matched), vpn=found.vpn_matched
            )
        )
        return report
    if kind == "mixed":
        warnings.append(MIXED)
    scored = table
    if kind in ("ids", "mixed"):
        if found.ids_missing:
            warnings.append(IDS_INCOMPLETE.format(missing=found.ids_missing))
        elif intrusion is None:
            warnings.append(NO_MODEL.format(module="IDS"))
        else:
            scored = score_intrusion(scored, intrusion, impute_from, by, confidence)
            report.distribution = intrusion.distribution
    if kind in ("vpn", "mixed"):
        if vpn is None:
            warnings.append(NO_MODEL.format(module="VPN"))
        else:
            source = schema.drop_foreign_columns(scored) if kind == "mixed" else scored
            scored = _score_second(scored, source, vpn, impute_from, by, confidence)
    if kind == "ids":
        warnings.append(VPN_SKIPPED.format(n=len(found.ids_matched)))
    if kind == "vpn":
        warnings.append(IDS_SKIPPED.format(n=len(found.vpn_matched)))
    report.scored = scored
    return report


def score_captures(
    captures: Captures, intrusion: Trained | None = None, vpn: Trained | None = None, impute_from: str = "input"
) -> ScoreReport:
    """Score captures of any headers: each header's files by their own schema, medians per file.

    The parsed rows are stored first, as medians, both models and the predictions read them, and with them the
    models' numbers, so that each text is parsed once. The result has the columns of all files, those of
    ``captures.SOURCE`` and the type of each row.
    """
    reports = []
    for table in captures.tables:
        landed = written_table(_with_numbers(table, (intrusion, vpn)), "landed")
        reports.append(score_auto(landed, intrusion, vpn, impute_from, [SOURCE]))
    scored = [_without_numbers(r.scored).withColumn(KIND, F.lit(r.input_type)) for r in reports]
    kinds = {r.input_type for r in reports}
    notes = captures.notes()
    for report in reports:
        notes += [w for w in report.warnings if w not in notes]
    return ScoreReport(
        kinds.pop() if len(kinds) == 1 else "several",
        reports[0].detection,
        union_all(scored),
        notes,
        next((r.distribution for r in reports if r.distribution is not None), None),
    )


def _with_numbers(table: DataFrame, models: Sequence[Trained | None]) -> DataFrame:
    """Beside each text column that a model takes numbers from, its numbers."""
    wanted = {c for m in models if m is not None for c in m.spec.numbers}
    found = [c for c, kind in table.dtypes if kind == "string" and c in wanted and _PARSED + c not in table.columns]
    return table.withColumns({_PARSED + c: numeric.coerce_number(F.col(c)) for c in found})


def _without_numbers(scored: DataFrame) -> DataFrame:
    return scored.drop(*[c for c in scored.columns if c.startswith(_PARSED) and c.removeprefix(_PARSED) in scored.columns])


def _score_second(
    scored: DataFrame, source: DataFrame, vpn: Trained, impute_from: str, by: Sequence[str], confidence: bool
) -> DataFrame:
    """Score with columns hidden from the model but kept in the result."""
    hidden = [c for c in scored.columns if c not in source.columns]
    if not hidden:
        return score_vpn(scored, vpn, impute_from, by, confidence)
    # Hidden columns only matter when the model has features of those names.
    clash = [c for c in hidden if c in (*vpn.spec.numbers, *vpn.spec.categories)]
    renamed = scored.withColumnsRenamed({c: f"{PREFIX}hidden_{c}" for c in clash})
    found = score_vpn(renamed, vpn, impute_from, by, confidence)
    return found.withColumnsRenamed({f"{PREFIX}hidden_{c}": c for c in clash})
