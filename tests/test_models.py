import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from flowlens.operators import encoding, ensembles, perceptron
from flowlens.operators.encoding import prepare
from flowlens.operators.ensembles import TreeModel
from flowlens.operators.stats import fit_medians
from flowlens.plans import jobs, recipes
from flowlens.plans.scoring import score_auto, score_intrusion, score_vpn

TREES = {"numTrees": 5, "maxDepth": 6}


@pytest.fixture(scope="module")
def flows(spark):
    """Classes that follow from the features, one class in ten rare."""
    i = F.col("id")
    return spark.range(1200).select(
        i.alias("flow_id"),
        F.when(i % 10 == 0, " TCP ").when(i % 3 == 0, "udp").otherwise("tcp").alias("proto"),
        F.when(i % 10 == 0, "dns").otherwise("http").alias("service"),
        F.when(i % 2 == 0, "CON").otherwise("FIN").alias("state"),
        (i % 7 + F.when(i % 3 == 0, 1000).otherwise(0)).cast("double").alias("sbytes"),
        (i % 5).cast("double").alias("dbytes"),
        F.when(i % 10 == 0, "DoS").when(i % 3 == 0, "Worms").otherwise("Normal").alias("attack_cat"),
        F.lit(1).alias("label"),
    )


@pytest.fixture(scope="module")
def vpn_rows(spark):
    i = F.col("id")
    return spark.range(600).select(
        i.alias("flow_id"),
        *[(i % (n + 3)).cast("double").alias(c) for n, c in enumerate(recipes.domain.VPN_COLUMNS)],
        F.when(i % 4 == 0, "a").otherwise("b").alias("extra"),
        F.when(i % 3 == 0, "VPN").otherwise("Non-VPN").alias("class1"),
    )


@pytest.fixture(scope="module")
def baseline(flows):
    return recipes.train(recipes.RECIPES["forest_baseline"], flows, **TREES)


@pytest.fixture(scope="module")
def vpn_model(vpn_rows):
    return recipes.train(recipes.RECIPES["forest_vpn"], vpn_rows, **TREES)


@pytest.mark.parametrize("name", ["forest_smote", "forest_oversampled", "forest_baseline", "boosted", "perceptron"])
def test_recipes_learn(flows, name, monkeypatch):
    recipe = recipes.RECIPES[name]
    params = {"forest": TREES, "boosted": {"maxIter": 3, "maxDepth": 3}, "perceptron": {"maxIter": 60}}[recipe.algorithm]
    scores = recipes.evaluate(recipes.train(recipe, flows, **params))
    assert scores["accuracy"].first()["accuracy"] > 0.95
    assert {r["class"] for r in scores["per_class_recall"].collect()} == {"Normal", "DoS", "Worms"}


def test_fast_balanced_counts(flows, monkeypatch):
    monkeypatch.setattr(recipes, "BENIGN_CAP", 300)
    monkeypatch.setattr(recipes, "MINORITY_TARGET", 500)
    recipe = recipes.RECIPES["forest_fast_balanced"]
    spec = recipes.feature_spec(recipe, flows)
    rows = recipes._resample(flows, recipe, spec, "flow_id")
    counts = {r["attack_cat"]: r["count"] for r in rows.groupBy("attack_cat").count().collect()}
    assert counts == {"Normal": 300, "DoS": 500, "Worms": 500}


def test_recipe_parameters_are_the_published_ones():
    r = recipes.RECIPES
    assert r["forest_smote"].params == {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 2}
    assert r["forest_fast_balanced"].params == {"numTrees": 120, "maxDepth": 20}
    assert r["forest_vpn"].params["numTrees"] == 200
    assert (r["boosted"].params["maxIter"], r["boosted"].params["maxDepth"]) == (200, 8)
    assert r["perceptron"].params == {"hidden": (128, 64), "maxIter": 50}


def test_fitting_rows(flows):
    """By default a category that only test rows have is unseen; fit_on="all" sees it."""
    train_ids = recipes.train(recipes.RECIPES["forest_baseline"], flows, **TREES).test.select("flow_id").limit(1)
    odd = flows.join(train_ids.withColumn("hit", F.lit(True)), "flow_id", "left")
    odd = odd.withColumn("service", F.when(F.col("hit"), "rare").otherwise(F.col("service"))).drop("hit")
    for fit_on, seen in (("train", False), ("all", True)):
        recipe = recipes.replace(recipes.RECIPES["forest_baseline"], fit_on=fit_on)
        trained = recipes.train(recipe, odd, **TREES)
        names = encoding.feature_columns(recipes.PipelineModel(stages=trained.model.stages[:3]), trained.spec)
        assert ("service_rare" in names) == seen


def test_distribution_is_that_of_the_original_split(baseline, flows):
    shares = {r["class"]: r["share"] for r in baseline.distribution.collect()}
    assert shares["DoS"] == pytest.approx(0.1, abs=0.002) and sum(shares.values()) == pytest.approx(1.0)


def test_test_rows_are_untouched(baseline, flows):
    assert baseline.test.count() == 240
    assert baseline.test.select("flow_id").subtract(flows.select("flow_id")).isEmpty()


def test_unseen_category_encodes_to_zeros(spark, baseline):
    odd = spark.createDataFrame([(1, "sctp", None, "CON", None, 1.0)], "flow_id int, proto string, service string, state string, sbytes double, dbytes double")
    spec = baseline.spec
    encoder = recipes.PipelineModel(stages=baseline.model.stages[:3])
    rows = encoding.prepare(odd, spec, baseline.facts, fill="unknown")
    features = {r["feature"] for r in encoding.exploded_features(rows, encoder, spec, "flow_id").collect()}
    assert features == {"sbytes", "dbytes", "state_con"}


def test_scoring_keeps_rows_and_columns(spark, flows, baseline):
    plain = flows.drop("attack_cat", "label")
    scored = score_intrusion(plain, baseline)
    assert scored.columns == [*plain.columns, "predicted_attack"]
    assert scored.drop("predicted_attack").exceptAll(plain).isEmpty() and scored.count() == plain.count()
    text = plain.select(*[F.col(c).cast("string").alias(c) for c in plain.columns])
    assert score_intrusion(text, baseline).groupBy("predicted_attack").count().collect() is not None


def test_imputation_source(spark, baseline):
    """Missing numbers take the median of the scored table, or on request that of training."""
    rows = [("udp", "http", "CON", s, 1.0) for s in (None, 1005.0, 1005.0, 1005.0)]
    df = spark.createDataFrame(rows, "proto string, service string, state string, sbytes double, dbytes double")
    by_input = [r["predicted_attack"] for r in score_intrusion(df, baseline).collect()]
    assert len(set(by_input)) == 1
    empty = spark.createDataFrame([("udp", "http", "CON", None, None)], df.schema)
    assert score_intrusion(empty, baseline).count() == 1
    assert score_intrusion(df, baseline, impute_from="train").count() == 4


@pytest.mark.parametrize("name", ["forest_baseline", "perceptron"])
def test_confidence_is_the_share_of_the_predicted_class(flows, name):
    """For tree ensembles, whose shares are arrays, and for vector models alike."""
    params = TREES if name == "forest_baseline" else {"maxIter": 20}
    trained = recipes.train(recipes.RECIPES[name], flows, **params)
    rows = score_intrusion(flows, trained, confidence=True)
    assert rows.columns == [*flows.columns, "predicted_attack", "predicted_attack_confidence"]
    prepared = prepare(flows, trained.spec, trained.facts, trained.recipe.scoring_fill, fit_medians(flows, trained.spec.numbers))
    shares = {r["flow_id"]: list(r["probability"]) for r in trained.model.transform(prepared).select("flow_id", "probability").collect()}
    for r in rows.collect():
        share = shares[r["flow_id"]]
        assert r["predicted_attack_confidence"] == max(share)
        assert share[trained.classes.index(r["predicted_attack"])] == max(share)


def test_confidence_of_both_models(spark, flows, vpn_rows, baseline, vpn_model):
    both = flows.join(vpn_rows.drop("class1").withColumnRenamed("flow_id", "vpn_id"), F.col("flow_id") == F.col("vpn_id"))
    report = score_auto(both, baseline, vpn_model, confidence=True)
    added = {"predicted_attack", "predicted_vpn", "predicted_attack_confidence", "predicted_vpn_confidence"}
    assert set(report.scored.columns) - set(both.columns) == added and report.columns == both.columns
    low, high = report.scored.agg(F.min("predicted_vpn_confidence"), F.max("predicted_vpn_confidence")).first()
    assert low is None or 0.5 <= low <= high <= 1


def test_vpn_scoring_fills_absent_features(vpn_rows, vpn_model):
    part = vpn_rows.select("duration", "total_fiat", "total_biat", "min_flowiat")
    scored = score_vpn(part, vpn_model)
    assert scored.columns == [*part.columns, "predicted_vpn"] and scored.count() == 600


def test_routing(spark, flows, vpn_rows, baseline, vpn_model):
    ids = score_auto(flows.drop("attack_cat", "label"), baseline, vpn_model)
    assert ids.input_type == "ids" and ids.warnings == ["VPN module skipped — file matches IDS schema (5/5 IDS columns found)."]
    assert ids.concept_drift().first()["js_distance"] < 0.2 and ids.vpn_counts() is None
    assert ids.soc().first()["attack_percentage"] == 100.0

    vpn = score_auto(vpn_rows, baseline, vpn_model)
    assert vpn.input_type == "vpn" and vpn.concept_drift() is None and "IDS module skipped" in vpn.warnings[0]
    assert vpn.soc().first()["risk_score"] <= 20

    both = score_auto(flows.join(vpn_rows.drop("class1"), "flow_id"), baseline, vpn_model)
    assert both.input_type == "mixed" and both.warnings[0].startswith("Mixed schema detected")
    assert {"predicted_attack", "predicted_vpn"} <= set(both.scored.columns) and both.scored.count() == 600

    four = score_auto(flows.select("proto", "service", "state", "sbytes"), baseline, vpn_model)
    assert four.input_type == "ids" and not four.has_predictions and "['dbytes']" in four.warnings[0]

    none = score_auto(spark.range(3), baseline, vpn_model)
    assert none.input_type == "unsupported" and none.soc().first()["threat_level"] == "N/A"
    assert none.warnings[0].startswith("Unsupported dataset schema.")

    no_model = score_auto(flows.drop("attack_cat", "label"))
    assert not no_model.has_predictions and "no model" in no_model.warnings[0]


def test_save_and_load(spark, tmp_path, flows, baseline):
    path = str(tmp_path / "recipe")
    recipes.save_recipe(baseline, path)
    loaded, missing = recipes.load_recipe(spark, path)
    assert missing == [] and loaded.classes == baseline.classes and loaded.spec == baseline.spec
    first = sorted(tuple(r) for r in score_intrusion(flows, baseline).select("flow_id", "predicted_attack").collect())
    again = sorted(tuple(r) for r in score_intrusion(flows, loaded).select("flow_id", "predicted_attack").collect())
    assert first == again
    nothing, missing = recipes.load_recipe(spark, str(tmp_path / "void"))
    assert nothing is None and "model, distribution, metadata" in missing[0]


def test_jobs_end_to_end(spark, tmp_path, tables):
    from flowlens.sources import sinks

    raw = tables.flows
    sinks.write_clean(raw.drop("flow_id"), str(tmp_path / "raw"), "csv")
    corpus = jobs.build_intrusion_corpus(spark, [str(tmp_path / "raw"), str(tmp_path / "gone")], str(tmp_path / "corpus"))
    # Rows that only differ in their id became copies, which the whole-row dedupe removes.
    assert 0 < corpus.count() <= tables.cleaned.count()
    trained = jobs.train_recipe(corpus, "forest_baseline", str(tmp_path / "model"), **TREES)
    assert trained.test.count() > 0
    report, metrics, facts = jobs.score_files(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "model"))
    assert report.has_predictions and metrics.first()["total_records"] == raw.count()
    assert facts.where("severity is null").isEmpty()
    per_file = jobs.score_files(spark, str(tmp_path / "raw"), str(tmp_path / "out2"), str(tmp_path / "model"), by=["source_file"])
    assert per_file[1].agg(F.sum("total_records")).first()[0] == raw.count()
    sinks.write_predictions(report.scored, str(tmp_path / "csv"))
    verdict = jobs.drift_of_predictions(spark, str(tmp_path / "csv"), trained.distribution, str(tmp_path / "drift"))
    assert verdict.first()["threshold"] == 0.2


def test_vpn_job_types_text_captures(spark, tmp_path, vpn_rows):
    """Numbers that came as text are features by value; text that is no number is a category."""
    from flowlens.sources import sinks

    sinks.write_clean(vpn_rows.drop("flow_id").withColumn("empty", F.lit(None).cast("string")), str(tmp_path / "raw"), "csv")
    corpus = jobs.build_vpn_corpus(spark, [str(tmp_path / "raw")], str(tmp_path / "corpus"))
    kinds = dict(corpus.dtypes)
    assert kinds["duration"] == "double" and kinds["extra"] == "string" and kinds["class1"] == "string"
    assert corpus.count() == vpn_rows.drop("flow_id").distinct().count()
    trained = jobs.train_recipe(corpus, "forest_vpn", str(tmp_path / "model"), **TREES)
    assert trained.spec.categories == ("extra",) and set(recipes.domain.VPN_COLUMNS) <= set(trained.spec.numbers)
    report, metrics, facts = jobs.score_files(spark, str(tmp_path / "raw"), str(tmp_path / "out"), None, str(tmp_path / "model"))
    assert report.input_type == "vpn" and facts is None and metrics.first()["total_records"] == 600


def test_row_ids_are_unique_and_partition_free(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None), ("b", 2)], "x string, n int")
    ids = [sorted(r["id"] for r in jobs.with_row_id(df.repartition(p), "id").collect()) for p in (1, 5)]
    assert len(set(ids[0])) == 5 and ids[0] == ids[1]


def test_folders_of_several_schemas(spark, tmp_path, flows, vpn_rows, baseline, vpn_model):
    """Each file is scored by its own header, filled with its own medians, and judged by its own rows."""
    from flowlens.sources import sinks

    plain = flows.drop("attack_cat", "label")
    tables = {
        "ids": plain.limit(40),
        "gaps": plain.where("proto = 'udp'").limit(30).withColumn("sbytes", F.when(F.col("flow_id") % 4 > 0, F.col("sbytes"))),
        "vpn": vpn_rows.drop("class1").limit(60),
        "mixed": plain.join(vpn_rows.drop("class1"), "flow_id").limit(20),
        "other": plain.select("flow_id", "proto", "service", "state").limit(50),
        "twice": plain.select("proto", "service", "state", "sbytes", "dbytes", F.lit("9").alias("SBYTES ")).limit(10),
    }
    for name, df in tables.items():
        sinks.write_clean(df.coalesce(1), f"{tmp_path}/in/{name}", "csv")
    with open(f"{tmp_path}/in/broken.csv", "w") as f:
        f.write("a,b\n1,2\n1,2,3\n")
    recipes.save_recipe(baseline, f"{tmp_path}/ids-model")
    recipes.save_recipe(vpn_model, f"{tmp_path}/vpn-model")
    report, metrics, facts = jobs.score_files(
        spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/ids-model", f"{tmp_path}/vpn-model", by=["source_file"]
    )
    got = {r["source_file"].split("/")[-2]: r for r in metrics.collect()}
    counts = {name: (r["total_records"], r["total_attacks"]) for name, r in got.items()}
    assert counts == {"ids": (40, 40), "gaps": (30, 30), "vpn": (60, 0), "mixed": (20, 20), "other": (50, 0), "twice": (10, 10)}
    assert got["vpn"]["js_distance"] is None and not got["vpn"]["drift_detected"] and got["vpn"]["risk_score"] <= 20
    assert (got["other"]["threat_level"], got["other"]["risk_score"], got["other"]["top_attack"]) == ("N/A", 0.0, "N/A")
    assert got["mixed"]["vpn_percentage"] > 0 and got["ids"]["vpn_percentage"] == 0
    assert report.input_type == "several" and report.total_records() == 210 and report.output == f"{tmp_path}/out"
    assert report.preview("flow_id", 3).count() == 3 and not facts.where("class is null").count()
    for note in ("Duplicate columns detected", "broken.csv: Line longer", "VPN module skipped", "IDS module skipped", "Mixed schema", "Unsupported dataset"):
        assert any(note in w for w in report.warnings), note
    # The udp file's missing numbers take its own median, which is that of its class.
    gaps = report.scored.where("source_file like '%gaps%' and sbytes is null").select("predicted_attack").distinct().collect()
    assert [r["predicted_attack"] for r in gaps] == ["Worms"]


def test_a_version_that_is_not_whole_is_never_loaded(spark, tmp_path, baseline, monkeypatch):
    """A writer that stops between parts leaves the version before in force."""
    path = str(tmp_path / "store")
    assert recipes.save_recipe(baseline, path) == 1
    other = recipes.replace(baseline, classes=[*baseline.classes, "Other"])
    whole = recipes._write_parts

    def torn(trained, place):
        whole(trained, place)
        raise RuntimeError("lost")

    monkeypatch.setattr(recipes, "_write_parts", torn)
    with pytest.raises(RuntimeError):
        recipes.save_recipe(other, path)
    assert recipes.load_recipe(spark, path)[0].classes == baseline.classes and recipes.recipe_versions(spark, path) == [1]
    monkeypatch.setattr(recipes, "_write_parts", whole)
    assert recipes.save_recipe(other, path) == 2
    assert recipes.load_recipe(spark, path)[0].classes == other.classes
    assert recipes.load_recipe(spark, path, version=1)[0].classes == baseline.classes
    assert recipes.load_recipe(spark, path, version=3)[0] is None and recipes.recipe_versions(spark, path) == [1, 2]


def test_smote_forest_is_grown_from_shares_of_category_values(spark, flows, tmp_path):
    """The rebalanced forest is an ensemble over bins, like the others, and scores alike once stored."""
    trained = recipes.train(recipes.RECIPES["forest_smote"], flows, numTrees=5, maxDepth=6)
    assert isinstance(trained.model, TreeModel) and not any(trained.model.growth.values)
    recipes.save_recipe(trained, str(tmp_path / "m"))
    loaded, _ = recipes.load_recipe(spark, str(tmp_path / "m"))
    a, b = (score_intrusion(flows, t).select("flow_id", "predicted_attack") for t in (trained, loaded))
    assert a.exceptAll(b).isEmpty() and a.count() == flows.count()


def test_shares_of_category_values(spark):
    spec = recipes.FeatureSpec((), ("w",))
    rows = [("a", "a", 0.0), ("a", "a", 0.4), ("a", "b", 0.0), ("a", "b", 0.25), ("b", "c", 0.9999), (None, "c", 0.5)]
    df = spark.createDataFrame(rows, "x_w string, x_w_nb string, gap double")
    fit = spark.createDataFrame([("a",), ("b",), ("c",)], "x_w string")
    encoder = ensembles.fit_bins(fit, spec)
    bins = [r[0] for r in ensembles.other_ends(encoder.transform(df), encoder, spec).select(ensembles.share_bins(encoder, spec)).collect()]
    assert bins == [[127, 0, 0], [127, 0, 0], [127, 0, 0], [95, 32, 0], [0, 1, 126], [0, 0, 64]]


def test_texts_of_captures_are_parsed_once(spark, tmp_path, vpn_rows, vpn_model):
    """Medians and model read the numbers that were stored with the rows; the result has the texts as they were."""
    from flowlens.plans.scoring import score_captures
    from flowlens.sources import captures

    spelled = vpn_rows.drop("class1", "extra").withColumn("duration", F.concat(F.col("duration").cast("string"), F.lit("e0")))
    spelled.write.csv(f"{tmp_path}/in", header=True)
    found = captures.open_flows(spark, f"{tmp_path}/in")
    scored = score_captures(found, None, vpn_model).scored
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan
    assert not [c for c in scored.columns if c.startswith("__")]
    got = {r["flow_id"]: (r["duration"], r["predicted_vpn"]) for r in scored.collect()}
    plain = {str(r["flow_id"]): r["predicted_vpn"] for r in score_vpn(vpn_rows, vpn_model).collect()}
    assert {i: p for i, (_, p) in got.items()} == plain and got["1"][0] == "1.0e0"


def test_rows_are_scored_many_at_a_time(spark, vpn_rows, vpn_model, monkeypatch):
    """Arrow batches are put together before trees are walked; shares are those of batches one by one."""
    asked = spark.createDataFrame([(i,) for i in range(50)], "id long").coalesce(1)
    columns = [F.col("id").cast("int")] * len(vpn_model.model.growth.values)
    trees = ensembles.nodes_of(vpn_model.model.found)
    rows = {}
    for most in (1, 1 << 17):
        monkeypatch.setattr(ensembles, "SCORED_ROWS", most)
        score = ensembles._scorer(vpn_model.model.growth, trees, 2, len(columns), None)
        walked = list(score.func(iter([tuple(ensembles.pa.array(range(n, n + 10)) for _ in columns) for n in range(0, 50, 10)])))
        rows[most] = ([len(x) for x in walked], [v for x in walked for v in x.to_pylist()])
    assert rows[1][0] == [10] * 5 and rows[1 << 17][0] == [50]
    assert rows[1][1] == rows[1 << 17][1]
    scored = asked.select(score(*columns).alias("p")).collect()
    assert [r["p"] for r in scored] == rows[1][1]


def test_perceptron_is_spark_mls(spark, monkeypatch):
    """Start, slope, steps and model equal those of Spark ML's solver; no pass of it reads the rows."""
    drawn = np.random.default_rng(1).standard_normal((1024, 2)).tolist()
    # The last code has no slot, as an unseen category.
    rows = spark.createDataFrame([(float((a > 0.2) + (b > 0.5)), a, b, float(i % 6)) for i, (a, b) in enumerate(drawn)], "y double, a double, b double, c double")
    hot = OneHotEncoder(inputCol="c", outputCol="hot").fit(rows).transform(rows)
    ready = VectorAssembler(inputCols=["a", "b", "hot"], outputCol="x").transform(hot).coalesce(1)
    network = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[7, 16, 8, 3], seed=42, maxIter=15)
    theirs = network.fit(ready).weights.toArray()
    fit, sizes = MultilayerPerceptronClassifier._fit, []
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: sizes.append(df.count()) or fit(self, df))
    single = perceptron.fit_perceptron(network, ready, ["a", "b"], ["c"], [5])
    assert np.abs(single.weights.toArray() - theirs).max() < 1e-4 and single.getMaxIter() == 15
    solve = perceptron.minimise
    monkeypatch.setattr(perceptron, "minimise", lambda cost, *rest: solve(lambda w, kind: cost(w, np.float64), *rest))
    double = perceptron.fit_perceptron(network, ready, ["a", "b"], ["c"], [5])
    assert np.abs(double.weights.toArray() - theirs).max() < 1e-9
    assert sizes == [1] * 4


def test_solver_goes_on_in_double_precision():
    """Where single precision shows nothing to gain, the search is repeated in double; it ends where both fail."""
    asked = []

    def cost(weights, kind):
        asked.append(kind)
        moved = weights - 1
        return (1.0, moved) if kind is np.float32 else (float(moved @ moved) / 2, moved)

    assert np.abs(perceptron.minimise(cost, np.zeros(3), 50, 1e-6) - 1).max() < 1e-6
    assert asked[0] is np.float32 and asked[-1] is np.float64
    stuck = perceptron.minimise(lambda w, kind: (1.0, np.ones(3)), np.zeros(3), 50, 1e-6)
    assert stuck.tolist() == [0, 0, 0]
