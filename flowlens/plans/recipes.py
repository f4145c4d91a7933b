"""Training recipes, evaluation and persistence."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import domain, text
from flowlens.operators import evaluation, sampling
from flowlens.operators.encoding import PREFIX, FeatureSpec, NumberFacts, feature_columns, fit_facts, fit_one_hot, prepare
from flowlens.operators.ensembles import (
    TreeModel,
    bag_key,
    bin_columns,
    bin_values,
    fit_bins,
    fit_boosted,
    fit_forest,
    other_ends,
    share_bins,
)
from flowlens.operators.perceptron import fit_perceptron
from flowlens.operators.schema import drop_target, require_columns, split_by_type
from flowlens.operators.shared import spread, written_table
from flowlens.operators.smote import smote
from flowlens.operators.stats import class_distribution
from flowlens.operators.trees import Growth

# ---- fixed values: sampling caps -----------------------------------------------------
BENIGN_CAP = 250_000
MINORITY_TARGET = 30_000

# Copies of one row that a task sees as one.
_COPIES_TOGETHER = 64

_PRED = "predicted_attack"


@dataclass(frozen=True)
class Recipe:
    name: str
    algorithm: str
    params: dict = field(default_factory=dict)
    resampling: str = "none"
    # Class weights: "all" by the counts of all training rows, "per_bag" by those of each tree's bag.
    weighted: str | None = None
    target: str = domain.INTRUSION_TARGET
    output: str = _PRED
    # None takes every column of the training table but the targets.
    features: FeatureSpec | None = field(default_factory=FeatureSpec)
    fill: str | None = domain.TRAINING_FILL
    lower: bool = True
    scale: bool = False
    # Token for missing categories when scoring; "unknown" is unseen in training and encodes to zeros.
    scoring_fill: str | None = domain.SCORING_FILL
    # "train" fits medians and categories without looking at the test rows; "all" includes them.
    fit_on: str = "train"
    seed: int = 42


_FOREST = {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 2}

RECIPES = {
    r.name: r
    for r in (
        Recipe("forest_smote", "forest", _FOREST, resampling="under_smote", weighted="all"),
        Recipe("forest_oversampled", "forest", _FOREST, resampling="oversample", weighted="all"),
        Recipe(
            "forest_fast_balanced",
            "forest",
            {"numTrees": 120, "maxDepth": 20},
            resampling="fast_balanced",
            weighted="per_bag",
        ),
        Recipe("forest_baseline", "forest", _FOREST, weighted="all"),
        Recipe(
            "forest_vpn",
            "forest",
            {"numTrees": 200, "maxDepth": 30},
            target=domain.VPN_TARGET,
            output="predicted_vpn",
            features=None,
            fill=domain.SCORING_FILL,
        ),
        Recipe(
            "boosted",
            "boosted",
            {"maxIter": 200, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.8, "columnShare": 0.8},
            fill=None,
            lower=False,
            scoring_fill=None,
        ),
        Recipe(
            "perceptron",
            "perceptron",
            {"hidden": (128, 64), "maxIter": 50},
            fill="mode",
            lower=False,
            scale=True,
            scoring_fill="mode",
        ),
    )
}


@dataclass
class Trained:
    """A fitted recipe: everything scoring needs."""

    recipe: Recipe
    spec: FeatureSpec
    facts: NumberFacts
    classes: list[str]
    model: PipelineModel | TreeModel
    distribution: DataFrame
    test: DataFrame | None = None


def feature_spec(recipe: Recipe, df: DataFrame, row_id: str | None = None) -> FeatureSpec:
    if recipe.features is not None:
        spec = recipe.features
    else:
        body = drop_target(df)
        if row_id is not None:
            body = body.drop(row_id)
        numbers, words = split_by_type(body)
        spec = FeatureSpec(tuple(numbers), tuple(words))
    return replace(spec, fill=recipe.fill, lower=recipe.lower, scale=recipe.scale)


def _resample(train: DataFrame, recipe: Recipe, spec: FeatureSpec, row_id: str) -> DataFrame:
    """Rebalanced training rows over the prepared columns."""
    label = recipe.target
    if recipe.resampling == "none":
        return train
    if recipe.resampling == "oversample":
        return sampling.oversample(train, label, row_id, seed=recipe.seed)
    if recipe.resampling == "fast_balanced":
        capped = sampling.undersample(train, label, row_id, BENIGN_CAP, seed=recipe.seed)
        return sampling.oversample(
            capped, label, row_id, target=MINORITY_TARGET, exempt=(domain.BENIGN_CLASS,), seed=recipe.seed
        )
    if recipe.resampling == "under_smote":
        cap = sampling.three_times_largest_other(train, label)
        capped = train if cap is None else sampling.undersample(train, label, row_id, cap, seed=recipe.seed)
        return smote(
            capped,
            label,
            row_id,
            [PREFIX + c for c in spec.numbers],
            [PREFIX + c for c in spec.categories],
            seed=recipe.seed,
            keep_id=True,
        )
    raise ValueError(f"unknown resampling {recipe.resampling!r}")


def _classifier(recipe: Recipe, params: Mapping, inputs: int, classes: int):
    common = {"featuresCol": "features", "labelCol": "__label", "predictionCol": "prediction"}
    params = dict(params)
    if recipe.algorithm == "perceptron":
        hidden = params.pop("hidden")
        return MultilayerPerceptronClassifier(
            **common, layers=[inputs, *hidden, classes], seed=recipe.seed, **params
        )
    raise ValueError(f"unknown algorithm {recipe.algorithm!r}")


def _fit_trees(
    recipe: Recipe, params: Mapping, rows: DataFrame, fitting: DataFrame, spec: FeatureSpec, indexer, row_id: str
) -> TreeModel:
    """The recipe's forest or boosted trees over binned columns; ``rows`` are prepared and rebalanced.

    Rows between two others hold shares of category values: each value is a column of its own then.
    """
    encoder = fit_bins(fitting, spec)
    drawn = [row_id, *(["copy"] if "copy" in rows.columns else [])]
    shares = "gap" in rows.columns
    coded = indexer.transform(encoder.transform(rows))
    if shares:
        coded = other_ends(coded, encoder, spec)
        bins = share_bins(encoder, spec).alias("bins")
    else:
        bins = F.array(*[F.col(c).cast("smallint") for c in bin_columns(spec)]).alias("bins")
    coded = coded.select(*drawn, bag_key(recipe.seed, *drawn).alias("key"), F.col("__label").cast("int").alias("label"), bins)
    dealt = spread(coded)
    if "copy" in drawn:
        # Copies of a row stay together, so that tasks see them as one; a row of very many fills several tasks.
        dealt = spread(coded, [F.floor(F.col("copy") / _COPIES_TOGETHER), "bins", row_id]).sortWithinPartitions("label", "bins")
    table = written_table(dealt.select("key", "label", "bins"), "binned")
    classes = list(indexer.labels)
    values = bin_values(encoder, spec)
    growth = Growth((0,) * sum(v or 1 for v in values) if shares else values, params["maxDepth"], recipe.seed)
    if recipe.algorithm == "boosted":
        growth = replace(growth, boosting=True, per_tree=params["columnShare"], step=params["stepSize"])
        found = fit_boosted(table, growth, len(classes), params["maxIter"], params["subsamplingRate"])
    else:
        tried = max(1, int(math.sqrt(growth.offsets[-1])))
        growth = replace(growth, per_node=tried, least_rows=params.get("minInstancesPerNode", 1))
        found = fit_forest(table, growth, len(classes), params["numTrees"], recipe.weighted)
    return TreeModel(encoder, spec, growth, classes, found, recipe.output, shares)


def train(recipe: Recipe, df: DataFrame, row_id: str = "flow_id", test: float = 0.2, **overrides) -> Trained:
    """Split, fit the encoder, rebalance the training side, fit the classifier.

    ``overrides`` replace single parameters of the recipe. The split is written to the shared
    folder, since every later step scans it several times; the test side is never resampled.
    """
    spec = feature_spec(recipe, df, row_id)
    label = recipe.target
    needed = [*spec.numbers, *spec.categories, label, row_id]
    require_columns(df, needed, "training table")
    rows = df.select(*needed).withColumn(label, text.strip(text.stringify(F.col(label))))
    rows = rows.where(F.col(label).isNotNull())
    split = written_table(sampling.tag_split(rows, label, row_id, test, recipe.seed), "split", ["split"])
    train_rows = split.where("split = 'train'").drop("split")
    test_rows = split.where("split = 'test'").drop("split")

    fitting = split.drop("split") if recipe.fit_on == "all" else train_rows
    facts = fit_facts(fitting, spec)
    indexer = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(fitting)
    params = {**recipe.params, **overrides}

    prepared = prepare(train_rows, spec, facts)
    inputs = [PREFIX + c for c in (*spec.numbers, *spec.categories)]
    resampled = _resample(prepared.select(label, row_id, *inputs), recipe, spec, row_id)
    if recipe.algorithm in ("boosted", "forest"):
        model = _fit_trees(recipe, params, resampled, prepare(fitting, spec, facts), spec, indexer, row_id)
    else:
        model = _fit_vectors(recipe, params, resampled, prepare(fitting, spec, facts), spec, indexer)
    # The distribution is that of the split's training side, before any rebalancing.
    distribution = class_distribution(train_rows, label)
    return Trained(replace(recipe, params=params), spec, facts, list(indexer.labels), model, distribution, test_rows)


def _fit_vectors(
    recipe: Recipe, params: Mapping, rows: DataFrame, fitting: DataFrame, spec: FeatureSpec, indexer
) -> PipelineModel:
    """The recipe's classifier over one-hot vectors; ``rows`` are prepared and rebalanced.

    Tasks make the vectors from numbers and codes, a block of rows at a time.
    """
    encoder = fit_one_hot(fitting, spec)
    width = len(feature_columns(encoder, spec))
    classifier = _classifier(recipe, params, width, len(indexer.labels))
    ready = indexer.transform(encoder.transform(rows))
    if classifier.getSolver() == "l-bfgs":
        numbers = [PREFIX + c for c in spec.numbers]
        codes = [f"{PREFIX}{c}_index" for c in spec.categories]
        values = [len(x) for x in encoder.stages[0].labelsArray] if codes else []
        fitted = fit_perceptron(classifier, ready, numbers, codes, values)
    else:
        fitted = classifier.fit(ready.select("features", "__label"))
    decode = IndexToString(inputCol="prediction", outputCol=recipe.output, labels=list(indexer.labels))
    return PipelineModel(stages=[*encoder.stages, fitted, decode])


def evaluate(trained: Trained, test: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores on the untouched test rows. The model runs once: its pair counts are stored."""
    rows = trained.test if test is None else test
    prepared = prepare(rows, trained.spec, trained.facts)
    scored = trained.model.transform(prepared)
    pairs = written_table(evaluation.pair_counts(scored, trained.recipe.target, trained.recipe.output), "pairs")
    return {
        "confusion_matrix": evaluation.sorted_matrix(pairs),
        "accuracy": evaluation.accuracy_of(pairs),
        "classification_report": evaluation.report_of(pairs),
        "f1_averages": evaluation.f1_averages_of(pairs),
        "per_class_recall": evaluation.recall_of(pairs),
    }


_PARTS = ("model", "distribution", "metadata")
_VERSIONS = "version long, place string"


def save_recipe(trained: Trained, path: str) -> int:
    """Store a recipe as the next version below ``path``; returns the version.

    All parts are written to a folder of their own, then one row of the list of versions names it. A reader
    takes what the list names, so it sees the version before until the new one is whole.
    """
    path = path.rstrip("/")
    spark = trained.distribution.sparkSession
    version = max((v for v, _ in _versions(spark, path)), default=0) + 1
    place = f"{path}/v{version}-{uuid.uuid4().hex}"
    _write_parts(trained, place)
    spark.createDataFrame([(version, place)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def _write_parts(trained: Trained, place: str) -> None:
    spark = trained.distribution.sparkSession
    if isinstance(trained.model, TreeModel):
        trained.model.save(f"{place}/model")
    else:
        trained.model.write().overwrite().save(f"{place}/model")
    trained.distribution.coalesce(1).write.mode("overwrite").parquet(f"{place}/distribution")
    facts = {
        "recipe": asdict(replace(trained.recipe, features=None)),
        "spec": asdict(trained.spec),
        "facts": asdict(trained.facts),
        "classes": trained.classes,
        "trees": isinstance(trained.model, TreeModel),
    }
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{place}/metadata"
    )


def recipe_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions stored below ``path``, oldest first."""
    return sorted({v for v, _ in _versions(spark, path.rstrip("/"))})


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    try:
        listed = spark.read.schema(_VERSIONS).parquet(f"{path}/versions").collect()
    except AnalysisException:
        return []
    return [(r["version"], r["place"]) for r in listed]


def load_recipe(spark: SparkSession, path: str, version: int | None = None) -> tuple[Trained | None, list[str]]:
    """The latest version of a stored recipe, or the one asked for; None and a warning where parts are missing.

    Of two writers that stored one version at a time, the place that sorts last counts for all readers.
    """
    path = path.rstrip("/")
    places = [(v, p) for v, p in _versions(spark, path) if version is None or v == version]
    place = max(places)[1] if places else path
    missing = [p for p in _PARTS if not places or not _exists(spark, f"{place}/{p}")]
    if missing:
        return None, [f"Model files missing under {path}: {', '.join(missing)}. Train the recipe again."]
    stored = json.loads(spark.read.text(f"{place}/metadata").first()["value"])
    spec = FeatureSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored["spec"].items()})
    recipe = Recipe(**{**stored["recipe"], "features": spec})
    trained = Trained(
        recipe,
        spec,
        NumberFacts(**stored["facts"]),
        stored["classes"],
        TreeModel.load(spark, f"{place}/model") if stored["trees"] else PipelineModel.load(f"{place}/model"),
        spark.read.parquet(f"{place}/distribution"),
    )
    return trained, []


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException:
        return False
    return True
