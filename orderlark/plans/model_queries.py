"""Registered queries that fit and apply models. Most fits are kept short here (fewer rounds,
smaller nets); the library's own defaults are the full sizes, which M8, M9 and M12 take."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.sql import functions as F

from orderlark.models import hazards, lambda_rank, reorder, snapshots as v1, texts, training
from orderlark.models.boosting import Growth
from orderlark.models.reorder import Boosting, Dense, ReorderModels
from orderlark.operators import evaluate, lookup, rank, snapshots, splits
from orderlark.operators.pair_features import build_features, latest_features
from orderlark.plans import views
from orderlark.plans.order_queries import FEATURES_SQL, ID_SQL, ID, PRODUCT_COLUMNS, TIES_SQL, W16_SQL, _v1
from orderlark.plans.text_queries import _bayes_sql, _tfidf_sql
from orderlark.plans.views import SALES_TIES, near, near_sql
from orderlark.session import scratch_path, shared_root, stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SHORT = Boosting(rounds=5, depth=4, rate=0.2)
SMALL = Dense(hidden=(16, 8), rounds=15)
ROUNDS = 15


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return keep


def _features(spark, d, horizon=30):
    """Features are built once, stored, and read by every fit."""
    return training.cached_features(views.sales(spark, d), scratch_path(spark, "train"), horizon, SALES_TIES, resume=False)


def _training_rows(spark, d, horizon=30):
    return stored(reorder.split_for_training(_features(spark, d, horizon), horizon, SALES_TIES), "split")


def _quantity_rows(spark, d, horizon=30):
    wanted = _features(spark, d, horizon).where("next_order_quantity IS NOT NULL")
    return stored(reorder.split_for_training(wanted, horizon, SALES_TIES), "split")


def _models(spark, d, dense=SMALL, robust_rounds=ROUNDS):
    store = scratch_path(spark, "train")
    return training.train_all(views.sales(spark, d), store, 30, SALES_TIES, boosting=SHORT, dense=dense, robust_rounds=robust_rounds)


SCALED = ["order_count", "cumulative_quantity", "qty_trend"]


@register(
    "M1_standardise",
    f"""WITH {FEATURES_SQL} SELECT {ID_SQL}, """
    + ", ".join(f"{near_sql(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS {c}" for c in SCALED)
    + " FROM features",
)
def m1(spark, d):
    rows = stored(build_features(views.sales(spark, d), targets=False, ties=SALES_TIES).select(*ID, *SCALED), "scaled")
    out = reorder.standardise(rows, SCALED)
    return out.select(*ID, *[near(F.col("scaled")[i]).alias(c) for i, c in enumerate(SCALED)])


def n_different(a, b):
    """Rows that one side has more often than the other; each side is worked out once."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    counted = both.groupBy(*a.columns).agg(F.abs(F.sum("_n")).alias("_n"))
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("bigint"))).scalar()


@register("M2_boosted_classifier")
def m2(spark, d):
    rows = _training_rows(spark, d)
    models = ReorderModels(30, reorder.fit_reorder(rows, 30, SHORT, None))
    return reorder.evaluate_models(models, rows)


@register("M3_dense_classifier")
def m3(spark, d):
    rows = _training_rows(spark, d)
    models = ReorderModels(30, reorder.fit_reorder(rows, 30, None, SMALL))
    return reorder.evaluate_models(models, rows)


@register("M4_boosted_regressor")
def m4(spark, d):
    rows = _quantity_rows(spark, d)
    fitted = reorder.fit_quantity(rows, 30, SHORT, None)
    held = fitted["boosted"].transform(rows.where("split = 'test'"))
    return evaluate.regression_metrics(held, "quantity_boosted", "next_order_quantity")


@register("M5_robust_regressor")
def m5(spark, d):
    rows = _quantity_rows(spark, d)
    fitted = reorder.fit_quantity(rows, 30, None, ROUNDS)
    held = fitted["dense"].transform(rows.where("split = 'test'"))
    return evaluate.regression_metrics(held, "quantity_dense", "next_order_quantity")


@register("M6_ensemble_test_metrics")
def m6(spark, d):
    return _models(spark, d)[1]


@register("M15_feature_importance")
def m15(spark, d):
    rows = _training_rows(spark, d)
    return reorder.feature_importance(reorder.fit_reorder(rows, 30, SHORT, None)["boosted"])


@register("M16_trained_model_comparison")
def m16(spark, d):
    models, _ = _models(spark, d)
    latest = latest_features(views.sales(spark, d), 30, SALES_TIES)
    scored = models.score(latest).select("customer_id", "product_id", *_score_columns())
    return rank.compare_models(scored, ["dense", "boosted", "ensemble"])


def _score_columns():
    return [f"{kind}_{m}" for kind in ("reorder", "quantity") for m in ("dense", "boosted", "ensemble")]


@register("M17_recommend_for_all_customers")
def m17(spark, d):
    models, _ = _models(spark, d)
    sales = views.sales(spark, d)
    scored = models.predict(latest_features(sales, models.horizon, SALES_TIES))
    slim = scored.select("customer_id", "product_id", "category_h1", "reorder_probability", "predicted_quantity", "days_since_last_order", "avg_discount")
    # Names change no rank, so only the few ranked rows are joined to them.
    top = rank.recommend_products(slim, 20, 0.2)
    return lookup.with_lookup(top, views.raw_sales(spark, d), "product_id", PRODUCT_COLUMNS, ["DATE", *SALES_TIES], lookup.PRODUCT_DEFAULTS, "Product Code")


@register("M17_stock_forecast")
def m17_stock(spark, d):
    """The plan takes the horizon the models were trained for, and the boosted members."""
    models, _ = _models(spark, d, None, None)
    scored = models.predict(latest_features(views.sales(spark, d), models.horizon, SALES_TIES), "boosted")
    slim = scored.select("customer_id", "product_id", "reorder_probability", "predicted_quantity")
    return rank.stock_plan(slim, views.raw_sales(spark, d), PRODUCT_COLUMNS, ["DATE", *SALES_TIES], "Product Code", 0.2)


@register(
    "M19_resumed_models_score_the_same",
    f"WITH {FEATURES_SQL} SELECT count(*) AS n_rows, 0::BIGINT AS n_different, 30 AS horizon FROM (SELECT DISTINCT customer_id, product_id FROM features)",
)
def m19(spark, d):
    """Train, then resume from the store: rows whose scores differ, of all latest rows."""
    sales, store = views.sales(spark, d), scratch_path(spark, "train")
    sizes = {"boosting": SHORT, "dense": SMALL, "robust_rounds": ROUNDS}
    models, _ = training.train_all(sales, store, 30, SALES_TIES, **sizes)
    again, _ = training.train_all(sales, store, 30, SALES_TIES, resume=True, **sizes)
    latest = stored(latest_features(sales, 30, SALES_TIES), "latest")
    keys = [*ID, "reorder_ensemble", "quantity_ensemble"]
    a, b = models.score(latest).select(*keys), again.score(latest).select(*keys)
    different = n_different(a, b)
    total = latest.agg(F.count(F.lit(1)).alias("n_rows"))
    return total.withColumns({"n_different": different, "horizon": F.lit(again.horizon)})


@register("M22_scale_then_score")
def m22(spark, d):
    rows = _training_rows(spark, d)
    model = reorder.fit_reorder(rows, 30, SHORT, None)["boosted"]
    scored = model.transform(rows.where("split = 'test'"))
    return scored.select(*ID, reorder.probability("_boosted_p").alias("probability"))


# --- first generation ---------------------------------------------------------------

V1_KEY = ["customer_id", "sku_id"]
SKUS = 25


def _v1_models(tables):
    rows = stored(snapshots.order_snapshots(*tables), "snapshots")
    keyed = snapshots.classification_rows(rows, SALES_TIES).withColumn("_key", F.concat_ws("|", *SALES_TIES))
    likelihood = v1.fit_calibrated(keyed, snapshots.SNAPSHOT_FEATURES, "label_reorder_in_N", "_key", rounds=3)
    quantity = v1.fit_quantity(snapshots.regression_rows(rows, SALES_TIES), v1.QUANTITY_FEATURES, "target_qty_next", growth=Growth(rounds=10))
    return rows, likelihood, quantity


@register("M7_calibrated_classifier")
def m7(spark, d):
    # Spark's boosting draws its bins by partition, so these stay as the unshared joins leave them.
    stored_rows = stored(snapshots.order_snapshots(*_v1(spark, d, SKUS, shared=False)), "snapshots")
    rows = snapshots.classification_rows(stored_rows, SALES_TIES)
    keyed = rows.withColumn("_key", F.concat_ws("|", *SALES_TIES))
    split = splits.stratified_split(keyed, "label_reorder_in_N", "_key", [("train", 0.8), ("test", 0.2)])
    model = v1.fit_calibrated(split.where("split = 'train'"), snapshots.SNAPSHOT_FEATURES, "label_reorder_in_N", "_key", rounds=5)
    held = model.score(split.where("split = 'test'"))
    return evaluate.roc_auc(held, "p_reorder", "label_reorder_in_N")


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _held_out(rows):
    """Mark a fifth of the rows by hash: they are scored but take no part in the fit."""
    keyed = rows.withColumn("_line", F.concat_ws("|", *LINE_KEY))
    return keyed.withColumn("held_out", splits.hash_bucket("_line", 5, "held") == 0).drop("_line")


HELD_OUT_SQL = f"""s AS ({W16_SQL.replace('l_partkey AS sku_id', f'l_partkey % {SKUS} AS sku_id')}),
held AS (SELECT *, ('0x' || substr(md5('held' || concat_ws('|', {', '.join(LINE_KEY)})), 1, 8))::BIGINT % 5 = 0 AS held_out FROM s WHERE time_to_next IS NOT NULL)"""


def _quantity_scores(spark, d):
    stored_rows = stored(snapshots.order_snapshots(*_v1(spark, d, SKUS)), "snapshots")
    rows = stored(_held_out(snapshots.regression_rows(stored_rows, SALES_TIES)), "quantities")
    model = v1.fit_quantity(rows.where("NOT held_out"), v1.QUANTITY_FEATURES, "target_qty_next")
    return model.score(rows)


@register("M8_quantity_quantiles", f"""WITH {HELD_OUT_SQL} SELECT {TIES_SQL}, held_out, target_qty_next, true AS in_order FROM held WHERE target_qty_next IS NOT NULL""")
def m8(spark, d):
    """All rows scored by the full fit; `in_order`: a positive mean, and quantiles that rise."""
    in_order = F.expr("coalesce(qty_mean > 0 AND qty_p50 > 0 AND qty_p50 <= qty_p90, false)")
    return _quantity_scores(spark, d).select(*SALES_TIES, "held_out", "target_qty_next", in_order.alias("in_order"))


@register(
    "M8_quantile_coverage",
    f"""WITH {HELD_OUT_SQL} SELECT held_out, count(*) AS n_rows, true AS half_below_p50, true AS nine_tenths_below_p90 FROM held
WHERE target_qty_next IS NOT NULL GROUP BY held_out""",
)
def m8_coverage(spark, d):
    """Shares of targets at or below their quantiles, fitted rows and held-out rows apart."""
    below = {q: F.avg((F.col("target_qty_next") <= F.col(q)).cast("int")) for q in ("qty_p50", "qty_p90")}
    return _quantity_scores(spark, d).groupBy("held_out").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.abs(below["qty_p50"] - 0.5) <= 0.08).alias("half_below_p50"),
        (F.abs(below["qty_p90"] - 0.9) <= 0.05).alias("nine_tenths_below_p90"),
    )


@register("M12_time_to_next_order", f"""WITH {HELD_OUT_SQL} SELECT {TIES_SQL}, held_out, time_to_next, true AS scored FROM held""")
def m12(spark, d):
    """`scored`: a finite hazard, and a median that is a time or, beyond the baseline, null."""
    rows = snapshots.survival_rows(snapshots.order_snapshots(*_v1(spark, d, SKUS)), SALES_TIES)
    rows = stored(_held_out(rows), "survival")
    model = hazards.fit_hazards(rows.where("NOT held_out"), snapshots.SNAPSHOT_FEATURES)
    scored = F.expr("coalesce(abs(log_hazard) < 1e9, false) AND coalesce(median_days >= 0, true)")
    return model.score(rows).select(*SALES_TIES, "held_out", "time_to_next", scored.alias("scored"))


def _ranker_rows(spark, d):
    """Snapshots with stand-in scores; relevant is what the customer orders again."""
    rows = stored(snapshots.order_snapshots(*_v1(spark, d, SKUS)), "snapshots")
    return rows.withColumns(
        {
            "p_reorder": 1 / (1 + F.col("time_since_prev") / 30.0),
            "qty_p50": F.col("qty_rolling_mean_30"),
            "qty_p90": F.col("qty_rolling_mean_30") * 1.5,
            "margin_proxy": 1 - F.col("discount_pct"),
            "relevant": F.col("time_to_next").isNotNull().cast("int"),
            "item": F.concat_ws("|", *SALES_TIES),
        }
    )


@register("M13_ranker_ndcg")
def m13(spark, d):
    """Fitted on four fifths of the customers by hash, judged on the others."""
    rows = stored(_ranker_rows(spark, d).withColumn("held_out", F.pmod(F.xxhash64("customer_id", F.lit(1)), F.lit(5)) == 0), "ranker")
    model = lambda_rank.fit_lambda_rank(rows.where("NOT held_out"), "customer_id", v1.RANK_FEATURES, "relevant", "item")
    return evaluate.ndcg(model.score(rows.where("held_out")), "customer_id", "score", "relevant", "item")


@register("M18_snapshot_recommendations")
def m18(spark, d):
    tables = _v1(spark, d, SKUS, shared=False)
    _, likelihood, quantity = _v1_models(tables)
    latest = snapshots.latest_snapshot(*tables)
    scored = v1.score_snapshot(latest, likelihood, quantity)
    out = v1.recommend(scored, 10)
    return out.select(*V1_KEY, "p_reorder", "qty_mean", "qty_p50", "qty_p90", "score", "suggested_qty", "on_hand", "stockout_flag", "lead_time", "discount_pct")


# --- texts --------------------------------------------------------------------------


def _embedding_split(spark, d):
    rows = texts.vectors_of(views.table(spark, d, "embeddings").withColumn("label", F.col("label").cast("string")))
    split = splits.stratified_split(rows, "label", "vec_id", [("train", 0.7), ("test", 0.3)])
    scaler = texts.scaled_vectors(split.where("split = 'train'"))
    scaled = scaler.transform(split).drop("features").withColumnRenamed("_scaled", "features")
    # Every job of every fit reads these rows. A checkpoint, unlike a table, keeps partitions and
    # their order, from which Spark's forests draw their rows.
    shared_root(spark)
    return scaled.select("label", "features", "split").checkpoint()


@register("M9_classifier_comparison")
def m9(spark, d):
    """All families at their full sizes."""
    rows = _embedding_split(spark, d)
    return texts.compare_classifiers(rows.where("split = 'train'"), rows.where("split = 'test'"), "label", texts.classifiers())


@register("E5_best_classifier")
def e5(spark, d):
    rows = _embedding_split(spark, d)
    models = {"logistic_regression": LogisticRegression(maxIter=50), "naive_bayes": NaiveBayes(modelType="gaussian")}
    found = texts.compare_classifiers(rows.where("split = 'train'"), rows.where("split = 'test'"), "label", models)
    return evaluate.best_model(found)


@register("M11_dense_on_embeddings")
def m11(spark, d):
    rows = _embedding_split(spark, d)
    train = rows.where("split = 'train'")
    net = texts.dense_text_classifier(64, 10, rounds=30)
    scored = texts.fit_classifier(train, "label", net).transform(rows.where("split = 'test'"))
    return evaluate.weighted_metrics(scored.select("label", "prediction"), "label", "prediction")


@register("M20_cluster_embeddings")
def m20(spark, d):
    return texts.cluster(texts.vectors_of(views.table(spark, d, "embeddings")), 10).select("vec_id", "cluster")


M21_SPLIT_SQL = _tfidf_sql(None).replace(
    "rk <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE", "rk <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE"
)


@register("M21_score_texts", f"""WITH {M21_SPLIT_SQL}, {_bayes_sql('split', "split = 'train'", "split = 'test'")} SELECT doc_id, label, prediction FROM nb""")
def m21(spark, d):
    rows = splits.stratified_split(views.intents(spark, d), "label", "doc_id", [("train", 0.8), ("test", 0.2)])
    model = texts.fit_text_model(rows.where("split = 'train'"), "text", "label", NaiveBayes(), tables=True)
    return texts.score_texts(model, rows.where("split = 'test'").select("doc_id", "label", "text"), "text").drop("text")
