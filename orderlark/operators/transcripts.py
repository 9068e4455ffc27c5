"""Transcript lines, clips, analysis answers and transcription quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlark.functions.scoring import service_label
from orderlark.functions.strings import SPACE, strip
from orderlark.operators.dialogue import emotion_sentence, is_customer
from orderlark.operators.skew import bounded_window

# A line is a bracket and what follows it. The bracket holds a clock, or one or two spans
# (amounts with a unit) with a hyphen between and perhaps more words.
BRACKET = r"(?s)\A\[([^\]]*)\](.*)"
CLOCK = r"\A(\d\d):(\d\d)\z"
AMOUNTS = rf"(?:\d+{SPACE}*(?:ms|m|s)(?!\p{{L}}){SPACE}*)+"
SPEAKER_PREFIX = r"(?U)^\s*\w+:\s*"

# Texts of failed or incomplete analyses.
BAD_JSON = "Invalid JSON format received from the API."
NO_SUMMARY = "No summary provided."
NO_TOPIC = "No topic classified."
FAILED = "Analysis failed."
ANALYSIS_SCHEMA = (
    "dialogue array<struct<speaker string, text string, emotion string>>, topic string, summary string, "
    "quality_assessment struct<score string, label string>, _corrupt string"
)


def lines_of(files: DataFrame, file: str, content: str) -> DataFrame:
    """One row per line of whole-text files."""
    lines = files.select(file, F.posexplode(F.split(content, "\r\n|\r|\n")).alias("line_no", "line"))
    return lines.where(F.col("line") != "")


def _seconds(amounts: Column) -> Column:
    """Minutes, seconds and milliseconds of a run of amounts; a missing one counts 0."""

    def number(unit: str) -> Column:
        digits = F.regexp_extract(amounts, rf"(\d+){SPACE}*{unit}(?!\p{{L}})", 1)
        return F.coalesce(digits.try_cast("double"), F.lit(0.0))

    return number("m") * 60 + number("s") + number("ms") / 1000


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Start, optional end and text of each timed line; other lines are dropped.

    Lines `[MM:SS] Speaker: text` are tried first, then `[1m 2s 500ms - 1m 5s] text`, whose
    first span must name seconds. Words after the spans belong to the text.
    """
    inside, rest = F.regexp_extract(line, BRACKET, 1), F.regexp_extract(line, BRACKET, 2)
    body = strip(inside)
    clock = body.rlike(CLOCK) & rest.contains(":")
    minutes, seconds = (F.regexp_extract(body, CLOCK, i).try_cast("double") for i in (1, 2))
    begin = F.regexp_extract(inside, rf"\A{SPACE}*({AMOUNTS})", 1)
    after = F.regexp_replace(inside, rf"\A{SPACE}*{AMOUNTS}", "")
    finish = F.regexp_extract(after, rf"\A-{SPACE}*({AMOUNTS})", 1)
    words = F.regexp_replace(after, rf"\A-{SPACE}*(?:{AMOUNTS})?", "")
    spoken = strip(F.concat_ws(" ", words, F.regexp_replace(rest, rf"\A{SPACE}+", "")))
    span = begin.rlike(rf"\d{SPACE}*s(?!\p{{L}})")
    parsed = lines.where(clock | span).withColumns(
        {
            "start": F.when(clock, minutes * 60 + seconds).otherwise(_seconds(begin)),
            "end": F.when(~clock & (finish != ""), _seconds(finish)),
            "text": F.when(clock, strip(F.regexp_replace(rest, r"(?s)\A[^:]*:", ""))).otherwise(strip(F.regexp_replace(spoken, SPEAKER_PREFIX, ""))),
        }
    )
    return parsed.where(F.col("text") != "").drop(line)


def fill_ends(segments: DataFrame, file: str, order: Sequence[str], heavy: Sequence[int] | None = None) -> DataFrame:
    """A missing end becomes the next start if that is strictly later."""

    def compute(rows, w):
        following = F.lead("start").over(w)
        end = F.coalesce(F.col("end"), F.when(following > F.col("start"), following))
        return rows.withColumn("_end", end)

    out = bounded_window(segments, [file], ["start", *order], compute, before=0, after=1, heavy=heavy)
    return out.withColumn("end", F.col("_end")).drop("_end")


def clip_windows(segments: DataFrame, duration: Column, min_seconds: float = 0.1) -> DataFrame:
    """Clips within a record: a missing end is the record's end; empty and very short
    clips go. Times count in whole milliseconds."""
    begin = F.floor(F.col("start") * 1000)
    finish = F.least(F.floor(F.coalesce(F.col("end"), duration) * 1000), F.floor(duration * 1000))
    out = segments.withColumns({"start_ms": begin, "end_ms": finish})
    return out.where((F.col("start_ms") < F.col("end_ms")) & (F.col("end_ms") - F.col("start_ms") >= min_seconds * 1000))


def overlap_chunks(records: DataFrame, duration: str, length: int = 30, stride: int = 6) -> DataFrame:
    """Overlapping windows over long records. Each step is the length less the stride on
    both sides; the first window that reaches past the end is the last."""
    step = length - 2 * stride
    d = F.col(duration)
    last = F.when(d >= length, F.floor((d - length) / step) + 1).otherwise(F.lit(0)).cast("int")
    chunked = records.where(d > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    begin = F.col("chunk") * step
    return chunked.withColumns(
        {"chunk_start": begin.cast("double"), "chunk_end": F.least(begin + F.lit(length), d).cast("double")}
    )


def good_segments(segments: DataFrame, text: str = "text", duration: str = "duration") -> DataFrame:
    return segments.where(F.length(text).between(3, 400) & F.col(duration).between(0.5, 25.0))


def segment_issue(text: str = "text", duration: str = "duration") -> Column:
    return (F.col(duration) < 0.5) | (F.col(duration) > 30.0) | (F.length(text) < 3)


# --- analysis answers ---------------------------------------------------------------


def parse_analysis(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Decode analysis answers: code fences removed, missing fields defaulted, and an
    `error` instead of a failure where the text is no JSON object. Scores may be whole or
    not, also quoted; one that is no number counts as missing."""
    bare = strip(F.replace(F.replace(strip(column), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    decoded = F.from_json(bare, ANALYSIS_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = answers.withColumn("_a", decoded)
    broken = F.col("_a").isNull() | F.col("_a._corrupt").isNotNull()
    empty = F.array().cast("array<struct<speaker string, text string, emotion string>>")
    return rows.withColumns(
        {
            "error": F.when(broken, BAD_JSON),
            "dialogue": F.when(~broken, F.coalesce("_a.dialogue", empty)),
            "topic": F.when(~broken, F.coalesce("_a.topic", F.lit(NO_TOPIC))),
            "summary": F.when(~broken, F.coalesce("_a.summary", F.lit(NO_SUMMARY))),
            "score": F.when(~broken, F.coalesce(F.col("_a.quality_assessment.score").try_cast("double"), F.lit(0.0))),
            "quality_label": F.when(~broken, F.coalesce("_a.quality_assessment.label", F.lit("N/A"))),
        }
    ).drop("_a", column)


def call_stages(parsed: DataFrame) -> DataFrame:
    """The results a finished call publishes, one row per stage in order; failed calls
    publish the failure texts. Results are strings, structured ones as JSON."""
    failed = F.col("error").isNotNull()

    def line(turn: Column) -> Column:
        return F.concat(
            F.coalesce(turn["speaker"], F.lit("unknown")),
            F.lit(" ("),
            F.coalesce(turn["emotion"], F.lit("neu")),
            F.lit("): "),
            F.coalesce(turn["text"], F.lit("")),
        )

    customer = F.filter("dialogue", lambda t: is_customer(t["speaker"]))
    emotions = F.transform(customer, lambda t: t["emotion"])
    lines = F.when(failed, F.array(F.concat(F.lit("ERROR: "), "error"))).otherwise(F.transform("dialogue", line))
    label = F.when(failed, "Error").otherwise(service_label(F.col("score")))
    score = F.when(failed, 0.0).otherwise(F.col("score"))
    # Whole scores are written without a fraction.
    plain = F.when(score == F.floor(score), score.cast("bigint").cast("string")).otherwise(score.cast("string"))
    verdict = F.concat(F.lit('{"label":"'), label, F.lit('","score":'), plain, F.lit("}"))

    def unless_failed(result: Column) -> Column:
        return F.when(failed, FAILED).otherwise(result)

    stages = [
        ("identified_dialogue", F.to_json(lines)),
        ("emotion_analysis", unless_failed(emotion_sentence(emotions))),
        ("summary", unless_failed(F.col("summary"))),
        ("topic_classification", unless_failed(F.col("topic"))),
        ("classification", verdict),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), result.alias("result"))
            for i, (name, result) in enumerate(stages)
        ]
    )
    keep = [c for c in parsed.columns if c not in ("error", "dialogue", "topic", "summary", "score", "quality_label")]
    return parsed.select(*keep, "error", F.explode(rows).alias("s")).select(*keep, "error", "s.*")


# --- transcription quality ----------------------------------------------------------


#: Positions of a text that one machine word holds.
WORD = 64
#: Characters of the pairs that are compared together; a longer pair is compared alone.
CHARS_AT_ONCE = 1 << 23


def _columns(codes: np.ndarray, starts: np.ndarray, long: np.ndarray, short: np.ndarray, n_codes: int) -> np.ndarray:
    """Edits of pairs (rows of `long`, `short`: text numbers), the longer text of each laid
    down bit rows, the shorter one read word by word.

    A block row is 64 words of a longer text. Each step moves every block row of every pair
    by one word: block k is k words behind the first, so what it needs from the block above
    is what that block gave one step before. Bits hold the steps of +1 and -1 down a column.
    """
    sizes = starts[1:] - starts[:-1]
    n_blocks = -(-sizes[long] // WORD)
    first = np.cumsum(n_blocks) - n_blocks
    pair = np.repeat(np.arange(len(long)), n_blocks)
    row = np.arange(len(pair))
    behind = row - first[pair]
    # For each block row and word in it: the bits at which that word stands, sorted by both.
    lengths = sizes[long]
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = codes[np.repeat(starts[long], lengths) + at]
    key = (np.repeat(first, lengths) + at // WORD) * n_codes + words
    order = np.argsort(key, kind="stable")
    known, begins = np.unique(key[order], return_index=True)
    masks = np.bitwise_or.reduceat((np.uint64(1) << (at % WORD).astype(np.uint64))[order], begins)

    one, zero = np.uint64(1), np.uint64(0)
    plus, minus = np.full(len(row), ~zero), np.zeros(len(row), dtype=np.uint64)
    out = np.zeros(len(row), dtype=np.int8)
    is_first = behind == 0
    last = first + n_blocks - 1
    top = np.full(len(row), WORD - 1, dtype=np.uint64)
    top[last] = ((lengths - 1) % WORD).astype(np.uint64)
    score = lengths.copy()
    n_steps = sizes[short][pair]
    offset = starts[short][pair] - behind
    for step in range(int((n_steps + behind).max(initial=0))):
        live = np.flatnonzero((behind <= step) & (step - behind < n_steps))
        wanted = row[live] * n_codes + codes[offset[live] + step]
        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        equal = np.where(known[place] == wanted, masks[place], zero)
        given = np.where(is_first[live], 1, out[live - 1])
        up, down = (given > 0).astype(np.uint64), (given < 0).astype(np.uint64)
        p, m = plus[live], minus[live]
        vertical = equal | m
        equal |= down
        across = (((equal & p) + p) ^ p) | equal
        higher = m | ~(across | p)
        lower = p & across
        moved = ((higher >> top[live]) & one).astype(np.int8) - ((lower >> top[live]) & one).astype(np.int8)
        higher, lower = (higher << one) | up, (lower << one) | down
        plus[live], minus[live] = lower | ~(vertical | higher), higher & vertical
        # Rows of one pair are handed on after all were read: `given` is a copy.
        out[live] = moved
        ends = live == last[pair[live]]
        score[pair[live][ends]] += moved[ends]
    return score


def edit_distances(references: Sequence[Sequence[str]], hypotheses: Sequence[Sequence[str]]) -> np.ndarray:
    """Word edits of many pairs of texts at once, bit-parallel."""
    n = len(references)
    if not n:
        return np.zeros(0, dtype=np.int64)
    texts = [*references, *hypotheses]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes, known = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    mine, other = np.arange(n), np.arange(n, 2 * n)
    swap = sizes[mine] < sizes[other]
    long, short = np.where(swap, other, mine), np.where(swap, mine, other)
    out = sizes[long].copy()  # right where the shorter text has no words
    # Pairs with about as many steps go together, so that few rows wait for the longest.
    kind = np.where(sizes[short] > 0, np.log2(np.maximum(sizes[short], 1)).astype(np.int64), -1)
    for k in np.unique(kind[kind >= 0]):
        these = np.flatnonzero(kind == k)
        out[these] = _columns(codes.astype(np.int64), starts, long[these], short[these], len(known))
    return out


def edit_distance(reference: Sequence[str], hypothesis: Sequence[str]) -> int:
    """Word edits between two texts."""
    return int(edit_distances([reference], [hypothesis])[0])


def with_word_edits(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds `edits` and `n_words`. Equal texts never leave the JVM; the pairs of an Arrow
    batch are compared together, up to CHARS_AT_ONCE. A null text has no words."""

    @F.pandas_udf("bigint")
    def edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        both = pd.DataFrame({"ref": ref.fillna(""), "hyp": hyp.fillna("")})
        piece = (both.ref.str.len() + both.hyp.str.len()).cumsum() // CHARS_AT_ONCE
        found = [edit_distances([x.split() for x in g.ref], [x.split() for x in g.hyp]) for _, g in both.groupby(piece, sort=True)]
        return pd.Series(np.concatenate(found) if found else [], dtype="int64")

    words = F.regexp_count(F.col(reference), F.lit(r"\S+"))
    same = F.col(reference) == F.col(hypothesis)
    counted = edits(F.when(same, F.lit("")).otherwise(F.col(reference)), F.when(same, F.lit("")).otherwise(F.col(hypothesis)))
    return pairs.withColumns({"edits": counted, "n_words": words.cast("bigint")})


def word_error_rate(pairs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Corpus-level rate in percent: all edits over all reference words."""
    sums = with_word_edits(pairs).groupBy(*by).agg(F.sum("edits").alias("edits"), F.sum("n_words").alias("n_words"))
    return sums.withColumn("wer", 100 * F.try_divide(F.col("edits").cast("double"), F.col("n_words").cast("double")))
