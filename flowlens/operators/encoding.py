"""Feature preparation and one-hot encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import domain, numeric, text
from flowlens.operators.stats import fit_medians, fit_modes

PREFIX = "x_"


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns feed a model and how they are prepared."""

    numbers: tuple[str, ...] = domain.INTRUSION_NUMERIC
    categories: tuple[str, ...] = domain.INTRUSION_CATEGORICAL
    # Token for a missing category; None leaves it missing, "mode" takes the most frequent value.
    fill: str | None = domain.TRAINING_FILL
    lower: bool = True
    scale: bool = False


@dataclass(frozen=True)
class NumberFacts:
    """Values learned on the fitting rows."""

    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)


def fit_facts(df: DataFrame, spec: FeatureSpec) -> NumberFacts:
    """Medians, and where the spec asks for them modes, means and population deviations."""
    medians = {c: 0.0 if m is None else m for c, m in fit_medians(df, spec.numbers).items()}
    modes = fit_modes(df, spec.categories) if spec.fill == "mode" else {}
    if not spec.scale or not spec.numbers:
        return NumberFacts(medians, modes)
    types = dict(df.dtypes)
    filled = {c: numeric.impute(_number(c, types), F.lit(medians[c])) for c in spec.numbers}
    row = df.agg(
        *[F.avg(x).alias(f"mean_{c}") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"std_{c}") for c, x in filled.items()],
    ).first()
    return NumberFacts(
        medians,
        modes,
        {c: row[f"mean_{c}"] for c in spec.numbers},
        {c: row[f"std_{c}"] for c in spec.numbers},
    )


def _number(name: str, types: Mapping[str, str]) -> Column:
    return numeric.finite_or_null(numeric.as_number(F.col(name), types[name]))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by their population z-scores, in one scan for the statistics."""
    parts = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    facts = df.agg(F.struct(*parts).alias("s")).scalar()
    return df.withColumns({c: numeric.standardise(F.col(c), facts[c]["mean"], facts[c]["std"]) for c in columns})


def prepare(
    df: DataFrame,
    spec: FeatureSpec,
    facts: NumberFacts,
    fill: str | None = "",
    medians: Mapping[str, float | Column | None] | None = None,
) -> DataFrame:
    """Add the prepared model inputs as ``x_<column>`` next to the untouched columns.

    A column the table lacks counts 0, or a missing category. ``fill`` overrides the spec's token
    and ``medians`` the learned medians.
    """
    types = dict(df.dtypes)
    token = spec.fill if fill == "" else fill
    added = {}
    for c in spec.numbers:
        if c not in types:
            added[PREFIX + c] = F.lit(0.0)
            continue
        # A column, where the median differs from row to row.
        middle = F.lit((facts.medians if medians is None else medians)[c]).cast("double")
        value = numeric.impute(_number(c, types), middle)
        if spec.scale:
            value = numeric.standardise(value, F.lit(facts.means[c]), F.lit(facts.stds[c]))
        added[PREFIX + c] = value
    for c in spec.categories:
        if c not in types:
            added[PREFIX + c] = F.lit(None).cast("string")
            continue
        word = facts.modes.get(c) if token == "mode" else token
        value = text.prepare_category(F.col(c), word, spec.lower)
        # The encoder cannot name a slot after an empty text.
        added[PREFIX + c] = F.when(value == "", F.lit(" ")).otherwise(value)
    return df.withColumns(added)


def fit_one_hot(prepared: DataFrame, spec: FeatureSpec, output: str = "features") -> PipelineModel:
    """Numbers first, then one slot per category value in sorted order, none dropped.

    The indexer keeps one extra slot for unseen values and the encoder drops exactly that one, so
    an unseen or missing category becomes all zeros.
    """
    numbers = [PREFIX + c for c in spec.numbers]
    words = [PREFIX + c for c in spec.categories]
    stages = []
    if words:
        stages = [
            StringIndexer(
                inputCols=words,
                outputCols=[f"{c}_index" for c in words],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(inputCols=[f"{c}_index" for c in words], outputCols=[f"{c}_hot" for c in words]),
        ]
    stages.append(VectorAssembler(inputCols=[*numbers, *[f"{c}_hot" for c in words]], outputCol=output))
    return Pipeline(stages=stages).fit(prepared)


def feature_columns(encoder: PipelineModel, spec: FeatureSpec) -> list[str]:
    """Ordered names of the feature vector's slots."""
    names = list(spec.numbers)
    if spec.categories:
        for column, values in zip(spec.categories, encoder.stages[0].labelsArray):
            names += [f"{column}_{'' if value == ' ' else value}" for value in values]
    return names


def exploded_features(df: DataFrame, encoder: PipelineModel, spec: FeatureSpec, row_id: str) -> DataFrame:
    """Long form (id, feature, value) of the encoded rows, zero slots left out.

    Each column gives one entry at most, so no row is spread out over all slots.
    """
    entries = [
        F.when(F.col(PREFIX + c) != 0, F.struct(F.lit(c).alias("feature"), F.col(PREFIX + c).alias("value")))
        for c in spec.numbers
    ]
    indexed = df
    if spec.categories:
        indexed = encoder.stages[0].transform(df)
        for column, values in zip(spec.categories, encoder.stages[0].labelsArray):
            word = F.col(PREFIX + column)
            # Unseen and missing values have the index behind the last label.
            known = F.col(f"{PREFIX}{column}_index") < len(values)
            name = F.concat(F.lit(f"{column}_"), F.when(word == " ", F.lit("")).otherwise(word))
            entries.append(F.when(known, F.struct(name.alias("feature"), F.lit(1.0).alias("value"))))
    return indexed.select(row_id, F.inline(F.array_compact(F.array(*entries))))


def encode_label(df: DataFrame, column: str, output: str) -> tuple[DataFrame, list[str]]:
    """Codes in lexicographic class order, and the classes in that order."""
    indexer = StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc").fit(df)
    return indexer.transform(df), list(indexer.labels)


def decode_label(df: DataFrame, column: str, classes: Sequence[str], output: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(output, F.get(names, F.col(column).cast("int")))
