"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed into BUCKETS buckets. Two multinomials over the buckets are
counted: one over all documents, one over all trusted documents (labelled quality 1). A document
is held against the others only: its own counts are taken out of the corpus, and out of the
target if it is trusted, so being counted makes no difference. Each bucket's count in the target
is compared with the one its share of the corpus leads to expect, both with SMOOTHING added,
which leaves buckets too rare to tell near 0 at every size of the target. A document's score is
the mean of ln((target + SMOOTHING) / (expected + SMOOTHING)) over its features, and every
document whose score is below MIN_SCORE is rejected, as are those that fail the base rules. The
threshold is a constant, so equal counts give equal verdicts. All of it is DataFrame code.

The counts are arrays of BUCKETS places, which reach the tasks as scalar subqueries. Each text gives
one row for each of its distinct buckets, and these rows are added up per text where they arise, in
compiled code, once as a trusted text and once as another one; which of the two holds is asked of
the ids afterwards. Only sums are shuffled, and texts whose id passes a Bloom filter of the trusted
ids, to count the target.

Defined results: null and blank texts have no words and fail the base rules; repeated rows are
scored each for itself (the copies count as other documents); without any other trusted document
a score is 0 and the base rules alone decide; labels with a null id or quality are ignored; an
empty table gives an empty result; all columns pass through kept_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import packed, table, words_column
from orderlark.session import stored

BUCKETS = 1 << 16  # a power of two
#: Added to a bucket's count in the target and to the expected one.
SMOOTHING = 8
#: Least mean log-likelihood ratio per feature, in nats.
MIN_SCORE = -0.1

#: A Bloom filter of the trusted ids keeps most other texts from moving; 8 MB at most.
BLOOM_BITS_PER_ID = 8
MOST_BLOOM_BITS = 1 << 26

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add words and the base measures n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumns({"words": words_column(text_col), "_lines": lines, "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")})
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.expr("transform(slice(words, 3, size(words)), (w, i) -> xxhash64(words[i], words[i + 1], w))"),
        }
    )
    # Most texts repeat no window; only the others are sorted with positions.
    out = out.withColumn("_some", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    out = out.withColumn(
        "_places",
        F.expr("IF(_some, sort_array(transform(_windows, (x, i) -> struct(x AS x, i AS i))), CAST(array() AS array<struct<x: bigint, i: int>>))"),
    )
    out = out.withColumn(
        "_repeated",
        F.expr("sort_array(transform(filter(_places, (e, i) -> (i > 0 AND get(_places, i - 1).x = e.x) OR coalesce(get(_places, i + 1).x = e.x, false)), e -> e.i))"),
    )
    covered = "aggregate(_repeated, struct(-3 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)"
    out = out.withColumn("n_repeat_words", F.expr(covered)).drop("_lines", "_windows", "_some", "_places", "_repeated")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _bucket(words: str) -> str:
    # The low bits of the hash. Unlike pmod, Spark knows them to be never null, and sorts such arrays as plain ints.
    return f"CAST(xxhash64({words}) & {BUCKETS - 1} AS int)"


def bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    """(bucket, name): places of each bucket in the words and word pairs of all texts."""
    words = docs.select(words_column("text").alias("w"))
    each = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("z")).select("z.*")
    both = f"IF(b IS NULL, array({_bucket('a')}), array({_bucket('a')}, {_bucket('a, b')}))"
    return each.select(F.explode(F.expr(both)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled quality 1 and never otherwise."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("_id")


def filled(rows: DataFrame, at: str, n: int, **values: Column) -> DataFrame:
    """One row: an array of n values for each name, 0 where `rows` has no row at that place."""
    every = rows.sparkSession.range(n).withColumnRenamed("id", "_at").join(rows, F.col("_at") == F.col(at), "left")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("_at", *[F.coalesce(v, F.lit(0)).alias(k) for k, v in values.items()]))).alias("l"))
    return listed.select(F.struct(*[F.transform("l", lambda x: x[k]).alias(k) for k in values]).alias("filled"))


def bloom(trusted: DataFrame) -> tuple[DataFrame, int]:
    """The bits that trusted ids set, as one row of 64-bit words, and their number."""
    wanted = BLOOM_BITS_PER_ID * trusted.count()
    bits = min(MOST_BLOOM_BITS, 1 << max(12, (wanted - 1).bit_length() if wanted else 0))
    at = F.pmod(F.xxhash64("_id"), F.lit(bits))
    words = trusted.groupBy(F.floor(at / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(pmod(xxhash64(_id), {bits}), 64) AS int))")).alias("set"))
    return filled(words, "word", bits // 64, set=F.col("set")), bits


class Scorer:
    """Counts of a corpus and its trusted texts, and the scores that follow from them."""

    def __init__(self, docs: DataFrame, labels: DataFrame, text_col: str, id_col: str):
        slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.trusted = stored(trusted_ids(labels), "trusted")
        set_bits, bits = bloom(self.trusted)
        at = F.pmod(F.xxhash64("id"), F.lit(bits))
        word = F.get(set_bits.scalar()["set"], F.floor(at / 64).cast("int"))
        # A bit that is not set proves that an id is not trusted.
        set_ = F.expr(f"shiftleft(1L, CAST(pmod(pmod(xxhash64(id), {bits}), 64) AS int))")
        self.maybe = F.col("id").isNotNull() & (word.bitwiseAND(set_) != 0)
        # The texts of few other ids move here, once, and in the same way at every size.
        known = slim.where(self.maybe).join(self.trusted.hint("merge"), F.col("id") == F.col("_id"), "left_semi")
        counted = bucket_counts(slim, "raw").join(bucket_counts(known, "target"), "bucket", "left").withColumn("target", F.coalesce("target", F.lit(0)))
        # At most BUCKETS rows, whatever the corpus.
        counted = stored(counted, "counts")
        total = counted.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
        self.all_raw, self.all_target = (F.lit(float(total[c] or 0)) for c in ("raw", "target"))
        listed = filled(counted, "bucket", BUCKETS, raw=F.col("raw").cast("double"), target=F.col("target").cast("double"))
        # As scalar subqueries they show in no plan; a constant of this size would, in every plan that the driver keeps.
        self.raw, self.target = (listed.select(F.col("filled")[c]).scalar() for c in ("raw", "target"))

    def rows(self, docs: DataFrame, *kept: str) -> DataFrame:
        """The columns kept, the base measures, maybe_trusted, and the scores `other` (for a text that is not
        trusted) and `own` (for one that is; without meaning, or null, for others) of rows with id and text."""
        based = base_rules(docs.withColumn("_place", F.monotonically_increasing_id()))
        pairs = f"transform(slice(words, 2, size(words)), (w, i) -> {_bucket('words[i], w')})"
        based = based.withColumn("_all", F.expr(f"sort_array(concat(transform(words, w -> {_bucket('w')}), {pairs}))"))
        # Each distinct bucket of the text starts at one of these places in the sorted list.
        based = based.withColumn("_starts", F.expr("filter(transform(_all, (b, i) -> IF(b = get(_all, i - 1), -1, i)), p -> p >= 0)"))
        size, smooth = F.size("_all"), F.lit(float(SMOOTHING))
        others = self.all_raw - size
        share = lambda target: F.when(others > 0, target / others).otherwise(F.lit(0.0))
        based = based.withColumns({"maybe_trusted": self.maybe, "_size": size, "_share_other": share(self.all_target), "_share_own": share(self.all_target - size)})
        # A text without words keeps one row, whose bucket is null.
        runs = F.explode_outer(F.arrays_zip(F.col("_starts").alias("p"), F.slice("_starts", 2, F.size("_starts")).alias("q")))
        each = based.withColumn("_run", runs)
        bucket, n = F.get("_all", F.col("_run.p")), (F.coalesce("_run.q", "_size") - F.col("_run.p")).cast("double")
        each = each.withColumns({"_n": n, "_raw": F.get(self.raw, bucket), "_target": F.get(self.target, bucket)})

        def score(own: bool) -> Column:
            share = F.col("_share_own" if own else "_share_other")
            # Of a text that is not trusted, the target holds nothing to take out.
            target = F.col("_target") - F.col("_n") if own else F.col("_target")
            expected = F.col("_raw") * share - F.col("_n") * share
            weight = F.col("_n") * (F.log(target + smooth) - F.log(expected + smooth))
            return F.sum(F.when(F.col("maybe_trusted"), weight) if own else weight)

        # The rows of a text are one after the other in one task, which sums them before anything moves.
        firsts = [F.first(c).alias(c) for c in (*MEASURES, "maybe_trusted", "_size")]
        out = each.groupBy("_place", *kept).agg(score(False).alias("other"), score(True).alias("own"), *firsts)
        mean = lambda c: F.when(F.col("_size") > 0, F.col(c) / F.col("_size")).otherwise(F.lit(0.0))
        return out.withColumns({"other": mean("other"), "own": F.when(F.col("maybe_trusted"), mean("own"))}).drop("_place", "_size")


def passes(score: str) -> Column:
    return ~F.col("base_failed") & (F.round(score, 9) >= MIN_SCORE)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _judged(docs: DataFrame, scorer: Scorer, *kept: str) -> DataFrame:
    """The columns kept, the base measures, score and verdict of rows with id and text."""
    # Only these short rows meet the ids. Written once, so that a caller's filter reads them.
    short = stored(scorer.rows(docs, *kept, "id").drop("maybe_trusted"), "scores")
    met = short.join(scorer.trusted.hint("merge"), F.col("id") == F.col("_id"), "left")
    return met.withColumn("score", F.when(F.col("_id").isNotNull(), F.col("own")).otherwise(F.col("other"))).withColumn("kept", passes("score")).drop("id", "_id", "other", "own")


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Base measures, score and verdict of every document (doc_id, measures, score, kept)."""
    scorer = Scorer(docs, labels, text_col, id_col)
    return _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), scorer, "doc_id")


def kept_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that pass, unchanged."""
    scorer = Scorer(docs, labels, text_col, id_col)
    # A verdict follows from id and text, so the texts themselves need not be written out with numbers.
    key = {"id": F.col(id_col).cast("long"), "hash": F.xxhash64(text_col)}
    slim = docs.select(*[c.alias(n) for n, c in key.items()], key["id"].alias("kept_id"), F.col(text_col).alias("text"))
    passing = _judged(slim, scorer, "kept_id", "hash").where("kept").select("kept_id", F.col("hash").alias("kept_hash"))
    met = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    return packed(docs, **key).hint("merge").join(passing, met, "left_semi").select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *MEASURES, "kept", "score")


QUERIES = {"op6_quality": op6_quality}
ORACLE = {}
