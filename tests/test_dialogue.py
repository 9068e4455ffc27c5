"""Turns, transcripts and transcription quality."""

import random

import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from orderlark.operators import dialogue, transcripts
from orderlark.plans import views

TURN = "conv_id int, turn int, speaker string, text string, emotion string, start double, end double"


def turns(spark, rows):
    return spark.createDataFrame([(c, t, s, x, e, float(t), t + 1.0) for c, t, s, x, e in rows], TURN)


def trend(df):
    return {r["conv_id"]: r["trend"] for r in df.collect()}


def test_emotion_trend(spark):
    df = turns(
        spark,
        [
            (1, 0, " Customer", "a", "ang"),
            (1, 1, "operator", "b", "hap"),
            (1, 2, "customer", "c", "odd"),
            (2, 0, "MÜŞTƏRİ".lower(), "a", "sad"),
            (3, 0, "operator", "a", "sad"),
            (4, 0, "customer", "a", "neu"),
            (4, 1, "customer", "a", "neu"),
        ],
    )
    assert trend(dialogue.emotion_trend(df)) == {
        1: "Customer emotion trend: Angry -> odd. The customer started Angry and finished odd.",
        2: "No customer speech detected to analyze emotion.",
        3: "No customer speech detected to analyze emotion.",
        4: "Customer emotion trend: Neutral -> Neutral. The customer's emotion remained Neutral.",
    }


def test_long_calls_have_the_shape_of_short_ones(spark):
    n = 3500
    rows = [(1, t, "customer", str(t), random.Random(t).choice(["hap", "sad"])) for t in range(n)] + [(2, 0, "customer", "x", "neu")]
    df = turns(spark, rows)
    whole = " ".join(str(t) for t in range(n))
    merged = {r["conv_id"]: (r["run"], r["n_turns"], r["text"]) for r in dialogue.merge_turns(df).collect()}
    assert merged == {1: (1, n, whole), 2: (1, 1, "x")}
    said = {r["conv_id"]: (r["n_turns"], r["text"]) for r in dialogue.speaker_texts(df).collect()}
    assert said == {1: (n, whole), 2: (1, "x")}
    (long, short) = dialogue.emotion_trend(df).orderBy("conv_id").collect()
    assert (long["n_emotions"], long["trend"].count(" -> "), short["n_emotions"]) == (n, n - 1, 1)


def test_taxonomy_keeps_order_and_repeats(spark, forced_skew):
    rows = [(i, "a" if i % 2 else "b", None if i == 4 else f"s{i % 3}") for i in range(12)]
    out = dialogue.taxonomy(spark.createDataFrame(rows, "at int, Class string, Sub_class string"), ["at"])
    got = [(r["class"], r["sub_class"]) for r in out.orderBy("class", "position").collect()]
    assert got == [("a", f"s{i % 3}") for i in range(1, 12, 2)] + [("b", f"s{i % 3}") for i in range(0, 12, 2) if i != 4]


def test_blank_turns_go(spark):
    df = turns(spark, [(1, 0, "a", "\t\n", "neu"), (1, 1, "a", "\u00a0x y\u2003\n", "neu")])
    assert [r["text"] for r in dialogue.turn_filter(df).collect()] == ["x y"]


def test_merge_turns_heavy_equals_plain(spark):
    from orderlark.operators.skew import GROUP_ROWS_CONF

    runs = views.event_runs(spark, SF).withColumn("conv_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("conv_id")))
    plain = rows_of(dialogue.merge_turns(runs, order=["ts", "event_id"]))
    spark.conf.set(GROUP_ROWS_CONF, "300")
    try:
        heavy = rows_of(dialogue.merge_turns(runs, order=["ts", "event_id"]))
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert heavy == plain


def test_roles(spark):
    rows = [(1, 0, 0.99, 0, 0.1), (2, 0, 0.5, 1, 0.96), (3, 0, 0.98, 1, 0.95)]
    df = spark.createDataFrame(rows, "conv_id int, label_a int, conf_a double, label_b int, conf_b double")
    out = [(r["role_a"], r["role_b"], r["low_confidence"]) for r in dialogue.assign_roles(df).orderBy("conv_id").collect()]
    assert out == [("customer", "operator", False), ("customer", "operator", False), ("operator", "operator", True)]


def test_unpaired_speakers_keep_their_tail(spark):
    df = turns(spark, [(1, 0, "SPEAKER_07", "a", "neu"), (2, 0, "x", "a", "neu"), (2, 1, "y", "b", "neu")])
    scored = dialogue.speaker_pairs(df).select("*", *[F.lit(v).alias(c) for c, v in (("label_a", 0), ("conf_a", 1.0), ("label_b", 0), ("conf_b", 0.0))])
    out = dialogue.label_speakers(df, dialogue.assign_roles(scored)).orderBy("conv_id", "turn").collect()
    assert [r["speaker"] for r in out] == ["speaker_07", "customer", "operator"]


LINES = [
    ("[00:05] Operator: Salam: necəsiniz", (5.0, None, "Salam: necəsiniz")),
    ("[ 01:10 ] A:  x ", (70.0, None, "x")),
    ("[00:05] text without a speaker", None),
    ("[5s] hello", (5.0, None, "hello")),
    ("[1m 2s500ms] Ayan: hi", (62.5, None, "hi")),
    ("[2s 500ms - 4s 250ms] hi", (2.5, 4.25, "hi")),
    ("[2s - 500ms] hi", (2.0, 0.5, "hi")),
    ("[1m 2s - 1m 5s inside] outside", (62.0, 65.0, "inside outside")),
    ("[3s - 6s]", None),
    ("plain", None),
    ("[5s 3 men] talk", (5.0, None, "3 men talk")),
    ("[5s -] hi\t", (5.0, None, "hi")),
    ("[\u00a01m\u00a02s\u00a0-\u00a03s\u00a0]\u00a0hi\u00a0", (62.0, 3.0, "hi")),
    ("[1m] no seconds", None),
    ("[00:05] : ", None),
    ("  [00:01] a: leading space", None),
]


@pytest.mark.parametrize("line,expected", LINES)
def test_parse_line(spark, line, expected):
    out = transcripts.parse_lines(spark.createDataFrame([(1, line)], "f int, line string")).collect()
    found = (out[0]["start"], out[0]["end"], out[0]["text"]) if out else None
    assert found == expected


def test_end_fill_and_clips(spark):
    rows = [(1, 0, 0.0, None), (1, 1, 5.0, None), (1, 2, 5.0, None), (1, 3, 9.95, None)]
    df = spark.createDataFrame(rows, "f int, line_no int, start double, end double")
    filled = transcripts.fill_ends(df, "f", ["line_no"])
    assert [r["end"] for r in filled.orderBy("line_no").collect()] == [5.0, None, 9.95, None]
    clips = transcripts.clip_windows(filled, F.lit(10.0)).orderBy("line_no").collect()
    # Equal starts leave the first of them open to the record's end; 50 ms is too short.
    assert [(r["line_no"], r["start_ms"], r["end_ms"]) for r in clips] == [(0, 0, 5000), (1, 5000, 10000), (2, 5000, 9950)]


def test_lines_of_whole_files(spark):
    df = spark.createDataFrame([("f", "[1s] a\r\n[2s] b\n\nx")], "f string, content string")
    assert [r["line"] for r in transcripts.lines_of(df, "f", "content").orderBy("line_no").collect()] == ["[1s] a", "[2s] b", "x"]


@pytest.mark.parametrize("duration,expected", [(10, [(0, 10)]), (30, [(0, 30), (18, 30)]), (50, [(0, 30), (18, 48), (36, 50)])])
def test_overlap_chunks(spark, duration, expected):
    out = transcripts.overlap_chunks(spark.createDataFrame([(1, float(duration))], "id int, d double"), "d")
    assert [(r["chunk_start"], r["chunk_end"]) for r in out.orderBy("chunk").collect()] == expected


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        assert transcripts.edit_distance(a, b) == brute_edits(a, b)


def test_edits_of_many_pairs_at_once():
    """Texts over several machine words, of very different lengths, in one call."""
    rng = random.Random(2)
    lengths = [0, 1, 2, 63, 64, 65, 127, 128, 129, 200, 300]
    pairs = [([rng.choice("abcdefgh"[:k]) for _ in range(n)], [rng.choice("abcdefgh"[:k]) for _ in range(m)]) for n in lengths for m in lengths for k in (1, 3, 8)]
    for n in (70, 250):  # near copies
        a = [str(rng.randrange(1000)) for _ in range(n)]
        pairs.append((a, [w for w in a if rng.random() > 0.1]))
        pairs.append((a, a[5:] + ["x"] * 7))
    got = transcripts.edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [brute_edits(a, b) for a, b in pairs]
    assert transcripts.edit_distances([], []).tolist() == []


def test_word_edits_of_null_and_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "CHARS_AT_ONCE", 8)
    rows = [(0, None, "a b"), (1, "a b c", None), (2, "", ""), (3, "a b c d e f", "a x c e f g"), (4, "same", "same"), (5, None, None)]
    out = transcripts.with_word_edits(spark.createDataFrame(rows, "id int, reference string, hypothesis string"))
    assert [r["edits"] for r in out.orderBy("id").collect()] == [2, 3, 0, 3, 0, 0]


def test_analysis_defaults(spark):
    answers = [("```json\n{\"dialogue\": [], \"topic\": \"T\"}\n```",), ("{broken",), ("[1]",)]
    out = transcripts.parse_analysis(spark.createDataFrame(answers, "answer string")).collect()
    assert (out[0]["error"], out[0]["topic"], out[0]["summary"], out[0]["score"], out[0]["quality_label"]) == (None, "T", transcripts.NO_SUMMARY, 0, "N/A")
    assert out[1]["error"] == transcripts.BAD_JSON


def test_scores_of_any_writing(spark):
    answers = [(i, '{"topic": "T", "quality_assessment": {"score": %s}}' % x) for i, x in enumerate(["4.5", '"5"', "3", '"abc"', "null"])]
    parsed = transcripts.parse_analysis(spark.createDataFrame(answers, "id int, answer string"))
    out = parsed.orderBy("id").collect()
    assert [(r["error"], r["topic"], r["score"]) for r in out] == [(None, "T", x) for x in (4.5, 5.0, 3.0, 0.0, 0.0)]
    results = transcripts.call_stages(parsed).where("stage = 'classification'").orderBy("id").collect()
    assert [r["result"].split(",")[1] for r in results] == ['"score":4.5}', '"score":5}', '"score":3}', '"score":0}', '"score":0}']
