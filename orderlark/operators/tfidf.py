"""TF-IDF with smoothed document frequencies and unit-length documents."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.operators.skew import attach, heavy_hashes
from orderlark.session import stored

# Fixed value: runs of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
BROADCAST_TOKENS = 1_000_000
#: A task counts the tokens of texts of about so many characters.
TASK_CHARS = 8_000_000
#: A task weighs about so many terms.
TASK_TERMS = 2_000_000


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(TOKEN), F.lit(0))


def term_counts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, token, tf)."""
    exploded = df.select(doc, F.explode(tokens(text)).alias("token"))
    return exploded.groupBy(doc, "token").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(train_counts: DataFrame, n_docs: Column, max_features: int | None = None) -> DataFrame:
    """(token, df, corpus_tf, idf) of the training documents.

    `max_features` keeps the most frequent tokens of the corpus, ties by token.
    """
    vocabulary = train_counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf"))
    return _with_idf(vocabulary, n_docs, max_features)


def text_vocabulary(train: DataFrame, text: str, n_docs: Column, max_features: int | None = None) -> DataFrame:
    """The same straight from texts, without numbering documents: each token is counted
    once per text and once per occurrence, and only sums per token are shuffled."""
    found = train.select(tokens(text).alias("_t"))
    once = F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("df"), F.lit(0).alias("tf")))
    each = F.transform("_t", lambda t: F.struct(t.alias("token"), F.lit(0).alias("df"), F.lit(1).alias("tf")))
    rows = found.select(F.explode(F.concat(once, each)).alias("r")).select("r.*")
    vocabulary = rows.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("corpus_tf"))
    return _with_idf(vocabulary, n_docs, max_features)


def _with_idf(vocabulary: DataFrame, n_docs: Column, max_features: int | None) -> DataFrame:
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.col("corpus_tf").desc(), "token").limit(max_features)
    return vocabulary.withColumn("idf", F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0)


def weigh(counts: DataFrame, vocabulary: DataFrame, doc: str, max_features: int | None = None) -> DataFrame:
    """(doc, token, weight) with unit length per document; unknown tokens are dropped. Where the
    vocabulary has a `code`, this number takes the token's place.

    A capped vocabulary is small by its cap and is broadcast. Without a cap, tokens that
    occur in very many documents are spread by the salted join, which holds the tokens of a
    task and streams the terms past them. Documents are dealt into tasks of even size.
    """
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, math.ceil(counts.count() / TASK_TERMS))
    coded = "code" in vocabulary.columns
    idf = vocabulary.select("token", "idf", *(["code"] if coded else []))
    if max_features is not None and max_features <= BROADCAST_TOKENS:
        joined = counts.join(F.broadcast(idf), "token")
    else:
        joined = attach(counts, idf.hint("shuffle_hash"), ["token"], heavy_hashes(counts, ["token"])[0]).where(F.col("idf").isNotNull())
    raw = joined.select(doc, F.col("code").alias("token") if coded else "token", (F.col("tf") * F.col("idf")).alias("_raw")).repartition(tasks, doc)
    # A document's tokens came out of one row, so its window is no larger than that row.
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(doc)))
    return raw.withColumn("weight", F.col("_raw") / norm).select(doc, "token", "weight")


def _fitted(df: DataFrame, doc: str, text: str, train: Column, max_features: int | None, chars: str | None) -> tuple[DataFrame, DataFrame]:
    """Term counts of all documents, written once because the vocabulary, the sizes of
    the tokens and the weights all read them; and the vocabulary of the training rows.

    Counting takes memory for every token of a task's documents, so texts are dealt out by
    document into tasks of even size, however large the parts of the input are."""
    flagged = df.select(doc, text, train.alias("_train"))
    facts = df.select(train.alias("_train"), (F.col(chars) if chars else F.length(text)).alias("_chars"))
    facts = facts.agg(F.count_if("_train").alias("n"), F.sum("_chars").alias("chars")).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil((facts["chars"] or 0) / TASK_CHARS))
    dealt = flagged.repartition(tasks, doc)
    exploded = dealt.select(doc, "_train", F.explode(tokens(text)).alias("token"))
    counts = exploded.groupBy(doc, "_train", "token").agg(F.count(F.lit(1)).alias("tf"))
    counts = stored(counts, "terms")
    return counts, fit_vocabulary(counts.where("_train"), F.lit(facts["n"]), max_features)


def tfidf(df: DataFrame, doc: str, text: str, train: Column, max_features: int | None = None, chars: str | None = None, numbered: bool = False) -> DataFrame:
    """Weights of all documents under a vocabulary fitted on the training rows only. `chars`
    names a column with the lengths of the texts, where reading the texts twice is dear. With
    `numbered`, tokens are the numbers that the vocabulary gives them, one for each."""
    counts, vocabulary = _fitted(df, doc, text, train, max_features, chars)
    if numbered:
        # Written once: every task must read the same numbers.
        vocabulary = stored(vocabulary.select("token", "idf").withColumn("code", F.monotonically_increasing_id()), "vocabulary")
    return weigh(counts, vocabulary, doc, max_features)


def tfidf_pipeline(train: DataFrame, text: str, output: str = "features", max_features: int | None = None) -> PipelineModel:
    """The same weights as a Spark ML pipeline model, for classifiers.

    Such a model holds its vocabulary, so this one table reaches the driver; cap it where
    it would not fit, or keep the weights as a table (`tfidf`, `token_bayes`). Documents are weighed by JVM
    transformers: token counts, times idf, scaled to unit length.
    """
    vocabulary = text_vocabulary(train, text, F.lit(train.count()), max_features)
    rows = vocabulary.select("token", "idf").orderBy("token").collect()
    words = [r["token"] for r in rows]
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="_tokens", outputCol="_counts")
    return PipelineModel(
        [
            RegexTokenizer(pattern=TOKEN, gaps=False, toLowercase=True, inputCol=text, outputCol="_tokens"),
            counter,
            ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_counts", outputCol="_raw"),
            Normalizer(p=2.0, inputCol="_raw", outputCol=output),
        ]
    )


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns."""

    def dot(x: str, y: str) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))

