import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from inkspect.catalog import queries
from inkspect.operators import classifiers, clean, metrics
from inkspect.plans import features as ft
from inkspect.plans import scoring, selection
from inkspect.sources.tables import labelled
from inkspect.streaming import scorer

FAST = {
    "LogisticRegression": {"maxIter": 20}, "RandomForest": {"numTrees": 5, "maxDepth": 4},
    "ExtraTrees": {"trees": 10, "depth": 5}, "GradientBoosting": {"maxIter": 3},
    "HistBoosting": {"rounds": 4, "depth": 2}, "MLP": {"maxIter": 30, "layers": [2, 4, 2]},
    "AdaBoost": {"rounds": 4}, "SVM_Linear": {"maxIter": 5, "folds": 2},
}


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, i % 2, [float(i % 2) * 3 + (i * 37 % 11) / 10, (i * 53 % 17) / 10]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, label int, v array<double>")
    return df.withColumn("features", array_to_vector("v")).cache()


@pytest.mark.parametrize("name", classifiers.NAMES)
def test_classifier_separates_toy_classes_and_is_stored(toy, spark, tmp_path, name):
    test = toy.where("doc_id >= 80")
    model = classifiers.fit(name, toy.where("doc_id < 80"), **FAST.get(name, {}))
    columns = ["doc_id", "label", "prediction", "p1"]
    rows = model.apply(test).select(*columns).collect()
    assert len(rows) == 40 and all(0 <= r.p1 <= 1 for r in rows)
    assert sum(r.prediction == r.label for r in rows) >= 36
    classifiers.save(model, str(tmp_path / "model"), spark)
    again = classifiers.load(str(tmp_path / "model"), spark)
    assert again.name == name
    assert sorted(map(tuple, again.apply(test).select(*columns).collect())) == sorted(map(tuple, rows))


def test_rows_of_a_forest_keep_their_nodes_and_give_the_same_trees(toy):
    assert classifiers.ESTIMATORS["RandomForest"](120, 2).getCacheNodeIds()
    noisy = toy.withColumn("label", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))

    def predictions(**options):
        found = classifiers.fit_predict("RandomForest", noisy, noisy, numTrees=5, **options)
        return sorted((r["doc_id"], r["prediction"], r["p1"]) for r in found.collect())

    assert predictions() == predictions(cacheNodeIds=False)


def test_unknown_name_falls_back():
    assert classifiers.resolve("nothing") == classifiers.FALLBACK


def test_screening_stability_and_final(toy, spark, tmp_path):
    skewed = toy.where("label = 0 OR doc_id % 6 = 1")
    parts = selection.folds.holdout(skewed)
    train = parts.where("split = 'train'")
    per_fold = selection.screen(train, ["GaussianNB", "DecisionTree"], k=2, metric_path=str(tmp_path / "m"))
    assert per_fold.count() == 4 and spark.read.parquet(str(tmp_path / "m")).count() == 4
    assert per_fold.columns == ["model", "fold", *metrics.METRICS]
    ranked = metrics.fold_summary(per_fold)
    seeds = selection.stability(train, ["GaussianNB"], seeds=[42, 123])
    assert seeds.count() == 2 and selection.best_stable(metrics.stability_summary(seeds)) == "GaussianNB"
    name, held, report = selection.train_final(parts, ranked, str(tmp_path / "model"))
    assert name in ("GaussianNB", "DecisionTree")
    rows = report.collect()
    values = {r.metric: r.value for r in rows if r.section == "metrics"}
    assert set(values) == set(metrics.METRICS) and values["accuracy"] > 0.9
    assert {r.model for r in rows} == {name}
    assert sum(r.value for r in rows if r.section == "confusion") == held.count()
    assert {r.metric for r in rows if r.section == "classes"} >= {"0 f1", "1 recall", "macro avg precision", "weighted avg support"}
    assert held.join(train, "doc_id").count() == 0


def test_a_champion_of_any_kind_is_saved_as_it_is(toy, spark, tmp_path):
    ranked = spark.createDataFrame([("kNN", 0.9), ("GaussianNB", 0.8)], "model string, ranking_score double")
    name, _, report = selection.train_final(toy, ranked, str(tmp_path / "model"))
    assert name == "kNN" and {r.model for r in report.collect()} == {"kNN"}


def test_a_killed_screening_goes_on_where_it_stopped(toy, tmp_path, monkeypatch):
    names, ledger = ["GaussianNB", "DecisionTree", "kNN"], str(tmp_path / "ledger")
    true_fit, fits = classifiers.fit_predict, []

    def fails(name, *rest, **options):
        fits.append(name)
        if name == "kNN":
            raise RuntimeError("killed")
        return true_fit(name, *rest, **options)

    monkeypatch.setattr(classifiers, "fit_predict", fails)
    with pytest.raises(RuntimeError, match="killed"):
        selection.screen(toy, names, k=2, metric_path=ledger, workers=1)
    finished = {(r.model, r.part) for r in toy.sparkSession.read.parquet(ledger).collect()}
    assert finished and all(m != "kNN" for m, _ in finished)

    def counted(name, *rest, **options):
        fits.append(name)
        return true_fit(name, *rest, **options)

    fits.clear()
    monkeypatch.setattr(classifiers, "fit_predict", counted)
    resumed = selection.screen(toy, names, k=2, metric_path=ledger, workers=3)
    assert len(fits) == 6 - len(finished)
    fits.clear()
    again = selection.screen(toy, names, k=2, metric_path=ledger)
    assert not fits
    plain = selection.screen(toy, names, k=2, workers=2)
    assert [tuple(r) for r in resumed.collect()] == [tuple(r) for r in again.collect()] == [tuple(r) for r in plain.collect()]
    fits.clear()
    selection.screen(toy.where("doc_id < 119"), ["GaussianNB"], k=2, metric_path=ledger)
    assert len(fits) == 2  # other rows, other units


def test_no_holdout_text_in_any_state(spark, sf):
    """Holdout texts replaced by others: every count, weight and training feature stays."""
    texts = clean.clean(labelled(spark, sf, "quality")).select("doc_id", "text", "label").cache()
    splits = selection.Splits(texts, k=3)
    held = {r.doc_id for r in splits.texts.where("split = 'holdout'").collect()}
    other = F.when(F.col("doc_id").isin(*held), F.lit("entirely other words of the holdout")).otherwise(F.col("text"))
    again = selection.Splits(texts.withColumn("text", other), k=3)
    assert held and again.counts.idf == splits.counts.idf and again.counts.sizes == splits.counts.sizes
    total = lambda s: {r.doc_id: round(sum(r.v), 9) for r in s.final().where("split = 'train'").collect()}
    assert total(again) == total(splits)
    assert splits.final().agg(F.min(F.size("v")), F.max(F.size("v"))).first()[0] == ft.DIMS


@pytest.fixture(scope="module")
def trained(spark, sf):
    docs = clean.clean(labelled(spark, sf, "quality"))
    intent = clean.clean(labelled(spark, sf, "toxic"))
    return scoring.train(docs, intent, iterations=5)


def test_feature_matrix_width(spark, sf, trained):
    docs = clean.clean(labelled(spark, sf, "quality"))
    row = ft.feature_table(docs, trained.state).agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    assert tuple(row) == (ft.DIMS, ft.DIMS) == (412, 412)


def test_stream_equals_batch_and_saved_models_agree(spark, sf, trained, tmp_path):
    scoring.save(trained, str(tmp_path / "models"), spark)
    models = scoring.load(str(tmp_path / "models"), spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    view = lambda r: (r["reason"], r["mode"], r.p_ai and round(r.p_ai, 9), r.intent)
    batch = {r.doc_id: view(r) for r in scoring.score(docs, models).collect()}
    stream = scorer.arriving(spark, sf, pattern="documents.parquet")
    query = scorer.score_stream(stream, models, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    again = {r.doc_id: view(r) for r in scorer.scored(spark, str(tmp_path / "out")).collect()}
    assert again == batch
    assert len(batch) == docs.count()
    assert all((reason is None) == (p_ai is not None) for reason, _, p_ai, _ in batch.values())


@pytest.fixture
def loops(toy, spark, tmp_path, monkeypatch):
    """What the registered loops give to their models: (loop or model, its options) instead of fits."""
    given = []

    def run_units(spark, names, sides, parts, mark, id_col, options, ledger, workers):
        given.append((len(names), len(parts), options))
        rows = [(n, p, mark, *([1 / (1 + i)] * len(metrics.METRICS))) for i, n in enumerate(names) for p in parts]
        return spark.createDataFrame(rows, selection.UNIT)

    class Parts:
        def __init__(self, *_, **__):
            pass

        def screen(self, names, **settings):
            return selection.screen(toy, names, **settings)

        def final(self):
            return toy

    monkeypatch.setattr(selection, "run_units", run_units)
    monkeypatch.setattr(selection, "Splits", Parts)
    monkeypatch.setattr(queries, "_cleaned", lambda *_: toy.withColumn("text", F.lit("some words")))
    monkeypatch.setattr(queries, "_split_tables", {})
    return given


def test_registered_screening_fits_every_model_with_its_defaults(loops, spark):
    assert queries.screening(spark, "nowhere").count() == len(classifiers.NAMES)
    assert loops == [(len(classifiers.NAMES), 5, {})]


def test_registered_stability_fits_every_model_with_its_defaults(loops, spark):
    assert queries.stability_run(spark, "nowhere").count() == 5 * 5
    assert loops[1:] == [(5, 5, {})]


def test_registered_final_model_is_fitted_with_its_defaults(loops, spark, monkeypatch):
    fits = []
    monkeypatch.setattr(selection, "train_final", lambda *table, **options: (None, None, fits.append(options)))
    queries.final_model(spark, "nowhere")
    assert fits == [{}]


def test_registered_scoring_models_are_fitted_with_their_defaults(loops, spark, monkeypatch):
    fits, rounds = [], []
    monkeypatch.setattr(classifiers, "fit", lambda name, rows, **options: fits.append((name, options)))
    monkeypatch.setattr(scoring.ft, "fit_state", lambda *_: None)
    monkeypatch.setattr(scoring, "train_detector", lambda texts, which, iterations, id_col: rounds.append(iterations))
    queries._models(spark, "nowhere")
    assert fits == [(classifiers.NAMES[0], {}), ("LogisticRegression", {})] and rounds == [100, 100]
