"""Classifiers and clusters of texts and embeddings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlark.functions.strings import strip
from orderlark.operators.evaluate import weighted_metrics
from orderlark.operators.tfidf import term_counts, text_vocabulary, tfidf_pipeline, weigh
from orderlark.session import stored


def classifiers(seed: int = 42, steps: int = 1000, trees: int = 100, rounds: int = 100) -> dict:
    """The compared families at the sizes of the reference. Binary-only ones are wrapped one
    against the rest; linear ones end where they converge."""
    return {
        "logistic_regression": LogisticRegression(maxIter=steps),
        "naive_bayes": NaiveBayes(modelType="gaussian"),
        "random_forest": RandomForestClassifier(numTrees=trees, seed=seed),
        "gradient_boosting": OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed), parallelism=4),
        "linear_svm": OneVsRest(classifier=LinearSVC(maxIter=steps), parallelism=4),
    }


def label_stages(train: DataFrame, label: str, estimator, prediction: str = "prediction") -> tuple:
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    back = IndexToString(inputCol="_p", outputCol=prediction, labels=index.labels)
    return index, estimator.copy().setLabelCol("_y").setPredictionCol("_p"), back


def fit_classifier(train: DataFrame, label: str, estimator) -> PipelineModel:
    """Label index, model on column `features`, and the label text as `prediction`."""
    index, model, back = label_stages(train, label, estimator)
    fitted = model.fit(index.transform(train))
    return PipelineModel([fitted, back])


def vectors_of(rows: DataFrame, column: str = "embedding", output: str = "features") -> DataFrame:
    return rows.withColumn(output, array_to_vector(F.col(column).cast("array<double>")))


def compare_classifiers(train: DataFrame, test: DataFrame, label: str, models: dict) -> DataFrame:
    """Weighted test metrics per model."""
    scored = None
    for name, estimator in models.items():
        out = fit_classifier(train, label, estimator).transform(test)
        out = out.select(F.lit(name).alias("model"), F.col(label).alias("label"), "prediction")
        scored = out if scored is None else scored.unionByName(out)
    return weighted_metrics(scored, "label", "prediction", by=["model"])


def dense_text_classifier(n_inputs: int, n_classes: int, hidden: int = 64, rounds: int = 300, seed: int = 42):
    return MultilayerPerceptronClassifier(layers=[n_inputs, hidden, n_classes], maxIter=rounds, seed=seed)


def scaled_vectors(train: DataFrame, column: str = "features") -> PipelineModel:
    scaler = StandardScaler(inputCol=column, outputCol="_scaled", withMean=True)
    return Pipeline(stages=[scaler]).fit(train)


def bayes_grid(train: DataFrame, label: str, alphas: Sequence[float] = (0.1, 0.5, 1.0), folds: int = 3, seed: int = 42) -> CrossValidatorModel:
    """Cross-validated choice of the smoothing of a multinomial Bayes model."""
    index, bayes, _ = label_stages(train, label, NaiveBayes(modelType="multinomial"))
    grid = ParamGridBuilder().addGrid(bayes.smoothing, list(alphas)).build()
    judge = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="_p", metricName="accuracy")
    search = CrossValidator(estimator=bayes, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed, parallelism=2)
    return search.fit(index.transform(train))


@dataclass(frozen=True)
class TokenBayes:
    """Multinomial Bayes over an open vocabulary, as tables: the weight of each token in
    each class, and per class its log prior and the logarithm of its smoothed total."""

    mass: DataFrame  # label, token, mass
    classes: DataFrame  # label, prior, total
    alpha: float

    def predict(self, weights: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
        """(doc, prediction) of all docs; those without a known token take the likeliest class
        beforehand. Equal scores go to the smaller label."""
        return predict_each([self], weights, docs, doc).withColumnRenamed("prediction_0", "prediction")


def predict_each(models: Sequence[TokenBayes], weights: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """(doc, prediction_0, ...) of models that share their masses and differ in smoothing. A term
    moves once to its token's masses, and once back to its document with one number per class."""
    known = weights.groupBy(doc).agg(F.sum("weight").alias("_w"))
    # One entry per class travels with every document.
    classes, zero = [m.classes.orderBy("label").collect() for m in models], F.lit(0.0)
    kind = models[0].classes.schema["label"].dataType
    labels = [F.lit(c["label"]).cast(kind) for c in classes[0]]
    entries = [F.struct(label.alias("label"), F.lit(c["prior"]).alias("prior"), *[F.lit(t[k]["total"]).alias(f"_t{i}") for i, t in enumerate(classes)]) for k, (label, c) in enumerate(zip(labels, classes[0]))]
    if not entries:
        return docs.select(doc, *[F.lit(None).cast(kind).alias(f"prediction_{i}") for i in range(len(models))]).limit(0)
    masses = models[0].mass.where("label IS NOT NULL").groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("label", "mass"))).alias("_by"))
    masses = masses.select("token", F.array(*[F.coalesce(F.try_element_at("_by", label), zero) for label in labels]).alias("_m"))
    # Classes are taken apart only where the terms lie by document.
    terms = weights.join(masses, "token").select(doc, "weight", "_m").repartition(doc).select(doc, "weight", F.posexplode("_m").alias("_k", "_c"))
    # A token that a class lacks adds only the smoothing, which all tokens share.
    gains = terms.groupBy(doc, "_k").agg(*[F.sum(F.col("weight") * F.log1p(F.col("_c") / m.alpha)).alias(f"_g{i}") for i, m in enumerate(models)])
    rows = docs.select(doc).join(known, doc, "left").select(doc, "_w", F.posexplode(F.array(*entries)).alias("_k", "c")).select(doc, "_w", "_k", "c.*")

    def score(i: int, alpha: float) -> Column:
        return F.round(F.col("prior") + F.coalesce("_w", zero) * (math.log(alpha) - F.col(f"_t{i}")) + F.coalesce(f"_g{i}", zero), 9)

    scored = rows.join(gains, [doc, "_k"], "left")
    return scored.groupBy(doc).agg(*[F.min_by("label", F.struct(-score(i, m.alpha), "label")).alias(f"prediction_{i}") for i, m in enumerate(models)])


def placed_weights(weights: DataFrame, rows: DataFrame, doc: str, part: Column) -> DataFrame:
    """(doc, token, weight, part, labels): the weights with the part and the labels of their rows,
    written once for all fits. Weights that are still dealt by document do not move for it."""
    docs = rows.select(doc, "label", part.alias("part")).groupBy(doc, "part").agg(F.collect_list(F.struct("label")).alias("labels"))
    return stored(weights.join(docs, doc), "placed")


def placed_mass(placed: DataFrame) -> DataFrame:
    """(part, label, token, mass)."""
    each = placed.select("part", "token", "weight", F.inline("labels"))
    return each.groupBy("part", "label", "token").agg(F.sum("weight").alias("mass"))


def token_bayes(weights: DataFrame, labels: DataFrame, doc: str, alphas: Sequence[float] = (1.0,)) -> list[TokenBayes]:
    """One model per smoothing from (doc, token, weight) and the (doc, label) of the training
    rows. Nothing but sums per class and token is shuffled, and no vocabulary is collected."""
    mass = weights.join(labels.select(doc, "label"), doc).groupBy("label", "token").agg(F.sum("weight").alias("mass"))
    return bayes_of(stored(mass, "mass"), labels, alphas)


def bayes_of(mass: DataFrame, labels: DataFrame, alphas: Sequence[float] = (1.0,)) -> list[TokenBayes]:
    """The models of a stored table of masses (label, token, mass) and the labels of the training rows."""
    n_tokens = mass.agg(F.count_distinct("token")).scalar()
    n_docs = labels.agg(F.count(F.lit(1))).scalar()
    sums = mass.groupBy("label").agg(F.sum("mass").alias("_m"))
    classes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).join(sums, "label", "left")
    prior = F.log(F.col("_n") / n_docs).alias("prior")
    return [
        TokenBayes(mass, classes.select("label", prior, F.log(F.coalesce("_m", F.lit(0.0)) + alpha * n_tokens).alias("total")), alpha)
        for alpha in alphas
    ]


def token_bayes_grid(weights: DataFrame, rows: DataFrame, doc: str, fold: Column, folds: int, alphas: Sequence[float]) -> DataFrame:
    """(alpha, accuracy): mean accuracy over the folds per smoothing. Masses are summed once per
    fold; those of a fit are the sums of the other folds."""
    folded = rows.select(doc, "label", fold.alias("_fold"))
    placed = placed_weights(weights, rows, doc, fold)
    mass = stored(placed_mass(placed), "mass")
    every = None
    for f in range(folds):
        held = folded.where(F.col("_fold") == f)
        seen = placed.where(F.col("part") == f).select(doc, "token", "weight")
        others = mass.where(F.col("part") != f).groupBy("label", "token").agg(F.sum("mass").alias("mass"))
        models = bayes_of(stored(others, "mass"), folded.where(F.col("_fold") != f), alphas)
        out = predict_each(models, seen, held, doc).join(held, doc)
        right = [F.avg((F.col(f"prediction_{i}") == F.col("label")).cast("double")).alias(f"_a{i}") for i in range(len(models))]
        each = F.inline(F.array(*[F.struct(F.lit(float(m.alpha)).alias("alpha"), F.col(f"_a{i}").alias("_a")) for i, m in enumerate(models)]))
        one = out.agg(*right).select(each)
        every = one if every is None else every.unionByName(one)
    return every.groupBy("alpha").agg(F.avg("_a").alias("accuracy"))


@dataclass(frozen=True)
class TextBayes:
    """From raw text to label over an open vocabulary, all of it tables."""

    vocabulary: DataFrame  # token, idf
    bayes: TokenBayes

    def transform(self, texts: DataFrame, text: str) -> DataFrame:
        """Adds `prediction`. Rows are numbered, so ids may repeat or be missing."""
        rows = stored(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
        counts = stored(term_counts(rows, "_row", text), "terms")
        weights = stored(weigh(counts, self.vocabulary, "_row"), "weights")
        return rows.join(self.bayes.predict(weights, rows, "_row"), "_row").drop("_row")

    def save(self, path: str) -> None:
        tables = {"vocabulary": self.vocabulary, "mass": self.bayes.mass, "classes": self.bayes.classes.withColumn("alpha", F.lit(self.bayes.alpha))}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextBayes:
        vocabulary, mass, classes = (spark.read.parquet(f"{path}/{name}") for name in ("vocabulary", "mass", "classes"))
        return TextBayes(vocabulary, TokenBayes(mass, classes.drop("alpha"), classes.first()["alpha"]))


def _fit_text_bayes(train: DataFrame, text: str, label: str, alpha: float, max_features: int | None) -> TextBayes:
    rows = stored(train.select(F.monotonically_increasing_id().alias("_row"), text, F.col(label).alias("label")), "texts")
    vocabulary = text_vocabulary(rows, text, rows.agg(F.count(F.lit(1))).scalar(), max_features)
    vocabulary = stored(vocabulary.select("token", "idf"), "vocabulary")
    weights = weigh(stored(term_counts(rows, "_row", text), "terms"), vocabulary, "_row", max_features)
    (bayes,) = token_bayes(weights, rows, "_row", [alpha])
    return TextBayes(vocabulary, bayes)


def fit_text_model(
    train: DataFrame, text: str, label: str, estimator, max_features: int | None = None, tables: bool = False
) -> PipelineModel | TextBayes:
    """From raw text to label in one saved pipeline. A pipeline holds its vocabulary, and Bayes
    one number for each token and class beside it, on the driver; with `tables`, a multinomial
    NaiveBayes keeps both as tables instead."""
    if tables:
        if not isinstance(estimator, NaiveBayes) or estimator.getModelType() != "multinomial":
            raise ValueError("only a multinomial NaiveBayes can be kept as tables")
        return _fit_text_bayes(train, text, label, estimator.getSmoothing(), max_features)
    vectors = tfidf_pipeline(train, text, max_features=max_features)
    model = fit_classifier(vectors.transform(train), label, estimator)
    return PipelineModel([*vectors.stages, *model.stages])


def score_texts(model: PipelineModel | TextBayes, texts: DataFrame, text: str) -> DataFrame:
    """Labels of a batch of raw texts, which are lowered and trimmed first."""
    cleaned = texts.withColumn(text, F.lower(strip(text)))
    kept = [c for c in texts.columns]
    scored = model.transform(cleaned, text) if isinstance(model, TextBayes) else model.transform(cleaned)
    return scored.select(*kept, "prediction")


def cluster(rows: DataFrame, k: int, seed: int = 42, column: str = "features") -> DataFrame:
    """Cluster number per row, to propose labels from."""
    model = KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster").fit(rows)
    return model.transform(rows)
