"""Models on planted signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlark.models import boosting, hazards, lambda_rank, reorder, snapshots, texts
from orderlark.operators import tfidf
from orderlark.operators.evaluate import best_model, binary_metrics, ndcg, regression_metrics, roc_auc
from orderlark.operators.pair_features import feature_columns


@pytest.fixture(scope="module")
def split(spark):
    """Rows whose label follows one feature, split by position."""
    names = feature_columns(30)
    noise = [F.rand(i).alias(c) for i, c in enumerate(names)]
    rows = spark.range(600).select("id", *noise)
    label = (F.col("order_count") + 0.2 * F.rand(99) > 0.6).cast("int")
    return rows.select(
        "*",
        label.alias("will_reorder"),
        (10 * F.col("qty_rolling_mean_3") + F.rand(98)).alias("next_order_quantity"),
        F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train").alias("split"),
    ).cache()


@pytest.fixture(scope="module")
def models(split):
    short = reorder.Boosting(rounds=5, depth=3, rate=0.3, min_rows=5)
    out = reorder.ReorderModels(30, reorder.fit_reorder(split, 30, short, reorder.Dense(hidden=(8,), rounds=40)))
    out.quantity = reorder.fit_quantity(split, 30, short, 50)
    return out


def test_members_learn(split, models):
    found = {(r["component"], r["model"], r["metric"]): r["value"] for r in reorder.evaluate_models(models, split, split).collect()}
    for m in ("dense", "boosted", "ensemble"):
        assert found["reorder", m, "roc_auc"] > 0.85
        assert found["quantity", m, "r2"] > 0.7


def test_importance_names(models):
    top = reorder.feature_importance(models.reorder["boosted"], 3).collect()
    assert top[0]["feature"] == "order_count" and len(top) == 3


def test_save_and_load(spark, split, models, tmp_path):
    models.save(spark, str(tmp_path))
    again = reorder.ReorderModels.load(spark, str(tmp_path))
    test = split.where("split = 'test'").orderBy("id")
    a = [r[0] for r in models.score(test).select("reorder_ensemble").collect()]
    b = [r[0] for r in again.score(test).select("reorder_ensemble").collect()]
    assert a == b and again.horizon == 30


def test_ensemble_of_one_member(split, models):
    alone = reorder.ReorderModels(30, {"boosted": models.reorder["boosted"]})
    row = alone.score(split.limit(1)).first()
    assert row["reorder_ensemble"] == pytest.approx(row["reorder_boosted"])


def test_calibrated_and_quantiles(spark):
    rows = spark.range(900).select(F.col("id").alias("key"), F.rand(1).alias("x"), F.rand(2).alias("z"))
    rows = rows.withColumns({"y": (F.rand(3) < F.col("x")).cast("int"), "q": 1 + 10 * F.col("x") * F.rand(4)}).cache()
    model = snapshots.fit_calibrated(rows, ["x", "z"], "y", "key", rounds=3)
    scored = model.score(rows).cache()
    assert roc_auc(scored, "p_reorder", "y").first()[0] > 0.75
    gap = scored.agg(F.avg("p_reorder") - F.avg("y")).first()[0]
    assert abs(gap) < 0.05
    quantity = snapshots.fit_quantity(rows, ["x", "z"], "q", growth=boosting.Growth(rounds=30))
    out = quantity.score(rows).select("q", "qty_mean", "qty_p50", "qty_p90").toPandas()
    assert (out.qty_p90 >= out.qty_p50).all() and (out.qty_mean > 0).all()
    assert np.mean(out.q <= out.qty_p90) == pytest.approx(0.9, abs=0.06)
    assert np.mean(out.q <= out.qty_p50) == pytest.approx(0.5, abs=0.08)


def test_calibration_works_its_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(300).select(F.col("id").alias("key"), F.rand(1).alias("x"), (F.rand(2) < 0.5).cast("int").alias("y"))
    snapshots.fit_calibrated(rows.mapInPandas(counted, rows.schema), ["x"], "y", "key", rounds=2)
    assert seen.value == 300


def test_survival_median_follows_the_covariate(spark):
    rows = spark.range(300).select(F.rand(1).alias("x"), F.lit(1).alias("event"))
    rows = rows.withColumn("time_to_next", F.floor(F.exp(1 + 3 * F.col("x")) * (0.5 + F.rand(2))))
    model = hazards.fit_hazards(rows, ["x"])
    assert model.score(rows).agg(F.corr("median_days", "x")).first()[0] > 0.8


def test_ranker_beats_chance(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("c"), F.col("id").alias("item"), F.rand(1).alias("x"), F.rand(2).alias("z"))
    rows = rows.withColumn("label", (F.col("x") + 0.3 * F.rand(3) > 0.9).cast("int")).cache()
    model = lambda_rank.fit_lambda_rank(rows, "c", ["x", "z"], "label", "item")
    good = ndcg(model.score(rows), "c", "score", "label", "item").first()
    poor = ndcg(rows.withColumn("score", F.col("z")), "c", "score", "label", "item").first()
    assert good["ndcg_at_5"] > 0.8 > poor["ndcg_at_5"]


def test_text_pipeline(spark, tmp_path):
    rows = [(i, "red apple pie" if i % 2 else "Blue ocean wave", "food" if i % 2 else "sea") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import NaiveBayes

    model = texts.fit_text_model(df, "text", "label", NaiveBayes())
    model.write().overwrite().save(str(tmp_path / "m"))
    out = texts.score_texts(PipelineModel.load(str(tmp_path / "m")), spark.createDataFrame([(1, "  OCEAN "), (2, "apple")], "id int, text string"), "text")
    assert dict(out.select("id", "prediction").collect()) == {1: "sea", 2: "food"}


def test_auc_ties_and_metrics(spark, forced_skew):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.9, 1), (0.2, 0)] * 10
    df = spark.createDataFrame(rows, "s double, y int")
    assert roc_auc(df, "s", "y").first()[0] == pytest.approx(8.5 / 9)
    m = binary_metrics(df, "s", "y", 0.4).first()
    assert (m["tp"], m["fp"], m["fn"]) == (20, 0, 10)
    none = binary_metrics(df, "s", "y", 2.0).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    flat = regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "p double, t double"), "p", "t").first()
    assert flat["mae"] == 0.5 and flat["r2"] is None
    table = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "model string, f1 double")
    assert best_model(table).first()["model"] == "a"


def test_train_and_resume(spark, tmp_path, monkeypatch):
    from conftest import SF_SMALL

    from orderlark.models import training
    from orderlark.models.training import train_all
    from orderlark.plans.views import EVENT_TIES, sales_long

    sales = sales_long(spark, SF_SMALL).withColumn("date", F.expr("date + make_dt_interval(cast(event_id % 300 as int))"))
    sizes = {"boosting": reorder.Boosting(rounds=2, depth=2, min_rows=1), "dense": reorder.Dense(hidden=(4,), rounds=3), "robust_rounds": 3}
    models, metrics = train_all(sales, str(tmp_path), 20, EVENT_TIES, **sizes)
    assert {(r["component"], r["model"]) for r in metrics.collect()} == {(c, m) for c in ("reorder", "quantity") for m in ("dense", "boosted", "ensemble")}
    # Nothing is left to build from: the resumed run reads the store alone.
    again, found = train_all(sales.limit(0), str(tmp_path), 20, EVENT_TIES, resume=True, **sizes)
    assert again.horizon == 20 and found.count() == metrics.count()
    assert set(again.reorder) == set(models.reorder) and set(again.quantity) == set(models.quantity)

    # A member whose marker is missing, as after a lost run, is fitted again, and it alone.
    fits = []
    for name in ("fit_reorder", "fit_quantity"):
        real = getattr(training, name)
        monkeypatch.setattr(training, name, lambda rows, h, b, d, real=real, name=name: fits.append((name, b is not None)) or real(rows, h, b, d))
    present = training.is_complete
    with monkeypatch.context() as lost:
        lost.setattr(training, "is_complete", lambda s, path: "quantity/dense-" not in path and present(s, path))
        train_all(sales.limit(0), str(tmp_path), 20, EVENT_TIES, resume=True, **sizes)
    assert fits == [("fit_quantity", False)] and not present(spark, str(tmp_path))
    # Other sizes mean other members; the rest is taken from the store.
    fits.clear()
    train_all(sales.limit(0), str(tmp_path), 20, EVENT_TIES, resume=True, **{**sizes, "dense": reorder.Dense(hidden=(3,), rounds=3)})
    assert fits == [("fit_reorder", False)]
    loaded = reorder.ReorderModels.load(spark, str(tmp_path / "models" / "h=20"))
    assert loaded.reorder["dense"].stages[-1].getLayers()[1] == 3 and set(loaded.quantity) == {"dense", "boosted"}


def test_text_bayes_as_tables(spark, tmp_path):
    """The same labels as the pipeline's, with ids that repeat and texts that are missing; nothing
    but tables is kept."""
    from conftest import rows_of
    from pyspark.ml.classification import NaiveBayes

    rows = [(1, "red apple pie", "food"), (1, "apple tart", "food"), (None, "deep ocean wave", "sea"), (4, "ocean ship", "sea"), (5, "apple ocean", "sea")]
    train = spark.createDataFrame(rows, "id int, text string, label string")
    texts_in = spark.createDataFrame([(1, "  OCEAN "), (1, "Apple tart"), (None, "red"), (3, "zebra")], "id int, text string")
    model = texts.fit_text_model(train, "text", "label", NaiveBayes(), tables=True)
    model.save(str(tmp_path / "tables"))
    again = texts.TextBayes.load(spark, str(tmp_path / "tables"))
    plain = texts.score_texts(texts.fit_text_model(train, "text", "label", NaiveBayes()), texts_in, "text")
    assert rows_of(texts.score_texts(again, texts_in, "text")) == rows_of(plain)
    missing = spark.createDataFrame([(9, None)], "id int, text string")
    assert [r["prediction"] for r in texts.score_texts(model, missing, "text").collect()] == ["sea"]
    with pytest.raises(ValueError, match="tables"):
        texts.fit_text_model(train, "text", "label", NaiveBayes(modelType="gaussian"), tables=True)


def test_rows_that_differ_are_counted_from_one_pass_a_side(spark):
    from orderlark.plans.model_queries import n_different

    a = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, None), (3, float("nan"))], "k int, v double")
    b = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan")), (4, 1.0)], "k int, v double")
    assert spark.range(1).select(n_different(a, b)).first()[0] == 2
    assert spark.range(1).select(n_different(a, a.limit(0))).first()[0] == 4
    assert spark.range(1).select(n_different(a, a)).first()[0] == 0


def test_terms_are_counted_and_weighed_in_tasks_of_bounded_size(spark, monkeypatch):
    """However few parts the input has; a document whose id repeats is one document."""
    monkeypatch.setattr(tfidf, "TASK_CHARS", 100, raising=False)
    monkeypatch.setattr(tfidf, "TASK_TERMS", 20, raising=False)
    parts = []
    monkeypatch.setattr(tfidf, "stored", lambda df, label: parts.append(df.rdd.getNumPartitions()) or df)
    rows = [(i, f"common word{i % 7} word{i} word{i}") for i in range(100)] + [(5, "common again"), (None, "common"), (200, None)]
    docs = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    out = tfidf.tfidf(docs, "id", "text", F.lit(True))
    assert parts[0] >= 20 and out.rdd.getNumPartitions() >= 12
    found = {(r["id"], r["token"]): r["weight"] for r in out.collect()}
    n = len(rows)

    def weights(doc):
        words = [w for i, t in rows if i == doc and t for w in t.split()]
        idf = {w: math.log((n + 1) / (len({i for i, t in rows if t and w in t.split()}) + 1)) + 1 for w in words}
        raw = {w: words.count(w) * idf[w] for w in idf}
        return {(doc, w): v / math.sqrt(sum(x * x for x in raw.values())) for w, v in raw.items()}

    for doc in (5, 13, None):
        for key, weight in weights(doc).items():
            assert found[key] == pytest.approx(weight)
    assert len(found) == sum(len(weights(d)) for d in {i for i, _ in rows})


def test_every_classifier_fit_reads_a_finished_split(spark):
    """Jobs of the fits neither read the table again nor carry the counters of the whole plan."""
    from orderlark.plans.model_queries import _embedding_split

    rows = _embedding_split(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Scan parquet" not in plan and "Exchange" not in plan
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "test"}


def test_classifier_comparison_takes_the_full_sizes(spark, monkeypatch):
    from orderlark.models import texts
    from orderlark.plans import model_queries

    rows = spark.createDataFrame([("train",), ("test",)], "split string")
    monkeypatch.setattr(model_queries, "_embedding_split", lambda spark, d: rows)
    monkeypatch.setattr(texts, "compare_classifiers", lambda train, test, label, models: models)
    models = model_queries.QUERIES["M9_classifier_comparison"](spark, "")
    assert models["logistic_regression"].getMaxIter() >= 1000
    assert models["linear_svm"].getClassifier().getMaxIter() >= 1000
    assert models["random_forest"].getNumTrees() == 100
    assert models["gradient_boosting"].getClassifier().getMaxIter() == 100
