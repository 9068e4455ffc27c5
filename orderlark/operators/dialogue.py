"""Turns of a call: cleaning, merging, speakers, emotions and topics.

Results have one row per run or call at every size: the joined text is the result. Lists
that need not be one value, as the taxonomy's, stay rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.functions.strings import strip
from orderlark.operators.skew import (
    attach,
    carried,
    cut_blocks,
    heavy_hashes,
    is_heavy,
    null_safe_join,
    running_rank,
    with_halo,
)

# Phrase that speech recognition invents in silence, customer names as they
# occur in analyses (compared in lower case), emotion codes, and the sentence texts.
BOILERPLATE = ("zlədiyiniz üçün təşəkkürlər",)
CUSTOMER_NAMES = ("müştəri", "mustəri", "müşteri", "customer")
EMOTION_NAMES = {"hap": "Happy", "neu": "Neutral", "sad": "Sad", "ang": "Angry"}
NO_CUSTOMER = "No customer speech detected to analyze emotion."
TREND_HEAD = "Customer emotion trend: "
TREND_ARROW = " -> "
TOO_SHORT_FOR_TOPIC = "Not enough data for topic classification."
ROLES = ("customer", "operator")


def turn_filter(turns: DataFrame, min_seconds: float = 0.2, phrases: Sequence[str] = BOILERPLATE) -> DataFrame:
    """Drops very short turns, empty texts and texts that contain a boiler-plate phrase."""
    out = turns.withColumn("text", strip("text")).where(F.col("end") - F.col("start") >= min_seconds)
    out = out.where(F.col("text") != "")
    for phrase in phrases:
        out = out.where(~F.lower("text").contains(phrase))
    return out


def format_turn(speaker: str = "speaker", emotion: str = "emotion", text: str = "text") -> Column:
    return F.concat(
        F.coalesce(F.col(speaker), F.lit("unknown")),
        F.lit(" ("),
        F.coalesce(F.col(emotion), F.lit("neu")),
        F.lit("): "),
        F.coalesce(F.col(text), F.lit("")),
    )


def ordered_join(order: str, text: str, separator: str) -> Column:
    """Aggregate: texts joined in row order."""
    rows = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.array_join(rows[text], separator)


def _runs(turns: DataFrame, call: str, order: Sequence[str]) -> DataFrame:
    """Adds `_rn`, the turn's place in its call, and `_run`, the place where its run of
    one speaker starts."""

    def changed(w) -> Column:
        alone = F.lag(F.lit(1)).over(w).isNull()
        return alone | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))

    def run_start(w) -> Column:
        return F.max(F.when(F.col("_new"), F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))

    (heavy,) = heavy_hashes(turns, [call])
    w = Window.partitionBy(call).orderBy(*order)
    cold = turns.where(~is_heavy([call], heavy)) if heavy else turns
    cold = cold.withColumns({"_new": changed(w), "_rn": F.row_number().over(w).cast("bigint")})
    cold = cold.withColumn("_run", run_start(w)).drop("_new")
    if not heavy:
        return cold
    blocks = cut_blocks(turns.where(is_heavy([call], heavy)), [call], order)
    part = [call, "_block"]
    wb = Window.partitionBy(*part).orderBy(*order, "_spread")
    live = with_halo(blocks, [call], order, before=1, after=0).withColumn("_new", changed(wb)).where("_live").drop("_live")
    live = null_safe_join(live, carried(blocks, [call], {"_before": F.lit(1)}), part)
    live = live.withColumn("_rn", F.row_number().over(wb) + F.col("_before"))
    open_runs = carried(live, [call], {}, {"_open": F.when(F.col("_new"), F.col("_rn"))})
    live = null_safe_join(live, open_runs, part).withColumn("_run", F.coalesce(run_start(wb), F.col("_open")))
    return cold.unionByName(live.select(*cold.columns))


def merge_turns(turns: DataFrame, call: str = "conv_id", order: Sequence[str] = ("turn",)) -> DataFrame:
    """Consecutive turns of one speaker as one: texts joined, first start, last end and
    last emotion. `run` is the place of the run's first turn in the call."""
    return _runs(turns, call, order).groupBy(call, F.col("_run").alias("run"), "speaker").agg(
        ordered_join("_rn", "text", " ").alias("text"),
        F.max_by("emotion", "_rn").alias("emotion"),
        F.min_by("start", "_rn").alias("start"),
        F.max_by("end", "_rn").alias("end"),
        F.count(F.lit(1)).alias("n_turns"),
    )


def is_customer(speaker: Column) -> Column:
    return F.lower(strip(F.coalesce(speaker, F.lit("")))).isin(*CUSTOMER_NAMES)


def emotion_name(emotion: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EMOTION_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, emotion), emotion)


def _closing(n: Column, first: Column, last: Column) -> Column:
    return (
        F.when(n <= 1, F.concat(F.lit("The customer's emotion was "), first, F.lit(".")))
        .when(first == last, F.concat(F.lit("The customer's emotion remained "), last, F.lit(".")))
        .otherwise(F.concat(F.lit("The customer started "), first, F.lit(" and finished "), last, F.lit(".")))
    )


def emotion_sentence(emotions: Column) -> Column:
    """The trend sentence of an array of emotions that one row holds."""
    n = F.size(emotions)
    text = F.concat(
        F.lit(TREND_HEAD),
        F.array_join(emotions, TREND_ARROW),
        F.lit(". "),
        _closing(n, F.get(emotions, F.lit(0)), F.get(emotions, n - 1)),
    )
    return F.when(n > 0, text).otherwise(F.lit(NO_CUSTOMER))


def emotion_trend(turns: DataFrame, call: str = "conv_id", order: str = "turn", named: bool = True) -> DataFrame:
    """Per call: number of customer emotions, the first and last one, and the trend sentence."""
    label = emotion_name(F.col("emotion")) if named else F.col("emotion")
    # Turns of others are null and left out, so that silent calls keep an empty list.
    heard = F.collect_list(F.when(is_customer(F.col("speaker")), F.struct(order, label.alias("_emotion"))))
    calls = turns.groupBy(call).agg(F.sort_array(heard)["_emotion"].alias("_list"))
    n = F.size("_list")
    return calls.select(
        call,
        n.cast("bigint").alias("n_emotions"),
        F.get("_list", F.lit(0)).alias("start_emotion"),
        F.get("_list", n - 1).alias("end_emotion"),
        emotion_sentence(F.col("_list")).alias("trend"),
    )


def speaker_texts(turns: DataFrame, call: str = "conv_id", order: str = "turn") -> DataFrame:
    """All texts of a speaker in a call, joined by spaces."""
    return turns.groupBy(call, "speaker").agg(
        ordered_join(order, "text", " ").alias("text"), F.min(order).alias("first_turn"), F.count(F.lit(1)).alias("n_turns")
    )


def speaker_pairs(turns: DataFrame, call: str = "conv_id", order: str = "turn") -> DataFrame:
    """Calls with exactly two speakers: who spoke first (a) and the other one (b)."""
    firsts = turns.groupBy(call, "speaker").agg(F.min(order).alias("_first"))
    return (
        firsts.groupBy(call)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min_by("speaker", "_first").alias("speaker_a"),
            F.max_by("speaker", "_first").alias("speaker_b"),
        )
        .where("_n = 2")
        .drop("_n")
    )


def assign_roles(scored: DataFrame, sure_a: float = 0.98, sure_b: float = 0.95) -> DataFrame:
    """Roles of a speaker pair from (label, confidence) of each: a decides when sure, else
    b when sure, else both get b's label and the row is flagged."""

    def role(label: Column) -> Column:
        return F.when(label == 0, ROLES[0]).otherwise(ROLES[1])

    def other(label: Column) -> Column:
        return F.when(label == 0, ROLES[1]).otherwise(ROLES[0])

    a, b = F.col("label_a"), F.col("label_b")
    by_a, by_b = F.col("conf_a") > sure_a, F.col("conf_b") > sure_b
    return scored.withColumns(
        {
            "role_a": F.when(by_a, role(a)).when(by_b, other(b)).otherwise(role(b)),
            "role_b": F.when(by_a, other(a)).otherwise(role(b)),
            "low_confidence": ~by_a & ~by_b,
        }
    )


def label_speakers(turns: DataFrame, roles: DataFrame, call: str = "conv_id") -> DataFrame:
    """Turns with the role as speaker; calls without a pair of speakers get
    `speaker_` and the last two characters of the original name."""
    named = attach(turns, roles.select(call, "speaker_a", "speaker_b", "role_a", "role_b"), [call])
    short = F.concat(F.lit("speaker_"), F.substring("speaker", -2, 2))
    speaker = (
        F.when(F.col("role_a").isNull(), F.when(F.length("speaker") < 2, F.concat(F.lit("speaker_"), "speaker")).otherwise(short))
        .when(F.col("speaker") == F.col("speaker_a"), F.col("role_a"))
        .when(F.col("speaker") == F.col("speaker_b"), F.col("role_b"))
        .otherwise("unknown")
    )
    return named.withColumn("speaker", speaker).drop("speaker_a", "speaker_b", "role_a", "role_b")


# --- topics -------------------------------------------------------------------------


def taxonomy(topics: DataFrame, order: Sequence[str], cls: str = "Class", sub: str = "Sub_class") -> DataFrame:
    """(class, position, sub_class): each class's sub-classes without null rows, repeats
    kept, in the order of the file."""
    named = topics.dropna(subset=[cls, sub]).select(F.col(cls).alias("class"), F.col(sub).alias("sub_class"), *order)
    return running_rank(named, ["class"], order, "position").select("class", "position", "sub_class")


def normalise_scores(scores: DataFrame, doc: str, multi_label: bool = False) -> DataFrame:
    """Raw label scores to probabilities: softmax over the labels of a document, or an
    independent sigmoid per label. A document has one row per label of the taxonomy."""
    if multi_label:
        return scores.withColumn("probability", 1 / (1 + F.exp(-F.col("score"))))
    w = Window.partitionBy(doc)
    shifted = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("_e", shifted).withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def best_label(scores: DataFrame, doc: str, score: str = "score", label: str = "label") -> DataFrame:
    """The label with the greatest score; equal scores go to the smallest label."""
    return scores.groupBy(doc).agg(
        F.min_by(label, F.struct(-F.col(score), F.col(label))).alias(label), F.max(score).alias(score)
    )


def two_stage_topic(class_scores: DataFrame, sub_scores: DataFrame, doc: str, text_words: DataFrame | None = None) -> DataFrame:
    """Best class, then the best sub-class among that class's own.

    `sub_scores` holds (doc, class, sub_class, score). With `text_words` (doc, n_words),
    texts of fewer than three words get the fixed refusal.
    """
    first = best_label(class_scores, doc).select(doc, F.col("label").alias("class"))
    options = sub_scores.join(first, [doc, "class"], "left_semi")
    second = best_label(options, doc, label="sub_class").select(doc, "sub_class")
    out = first.join(second, doc, "left")
    nothing = F.concat(F.col("class").cast("string"), F.lit(": (No sub-classes found)"))
    topic = F.coalesce(F.concat_ws(": ", F.col("class").cast("string"), F.when(F.col("sub_class").isNotNull(), F.col("sub_class").cast("string"))), nothing)
    topic = F.when(F.col("sub_class").isNull(), nothing).otherwise(topic)
    if text_words is not None:
        out = out.join(text_words, doc, "left")
        topic = F.when(F.coalesce("n_words", F.lit(0)) < 3, TOO_SHORT_FOR_TOPIC).otherwise(topic)
    return out.withColumn("topic", topic)
