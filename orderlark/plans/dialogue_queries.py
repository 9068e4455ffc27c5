"""Registered queries over calls, transcripts and the BI tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlark.functions.scoring import service_label
from orderlark.operators import bi, dialogue, transcripts
from orderlark.operators.skew import heavy_hashes
from orderlark.plans import views
from orderlark.plans.views import near, near_sql, rounded, rounded_sql, strip_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return keep


DIALOGUE_SQL = """
dialogue AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'operator' ELSE role END AS speaker, text,
    (['hap', 'neu', 'sad', 'ang'])[length(text) % 4 + 1] AS emotion, turn * 30.0::DOUBLE AS start,
    turn * 30.0::DOUBLE + length(text) / 15.0::DOUBLE AS end FROM conversations)"""

# Texts between no-break spaces, tabs and newlines; every fifth turn holds nothing else.
PADDED_SQL = "chr(160) || chr(9) || CASE WHEN turn % 5 = 4 THEN chr(10) || chr(160) ELSE text END || chr(8195) || chr(10)"


@register(
    "P7_segment_quality_filter",
    f"""WITH {DIALOGUE_SQL} SELECT conv_id, turn FROM dialogue WHERE length(text) BETWEEN 3 AND 400
AND "end" - start BETWEEN 0.5 AND 25.0""",
)
def p7(spark, d):
    turns = views.dialogue(spark, d).withColumn("duration", F.col("end") - F.col("start"))
    return transcripts.good_segments(turns).select("conv_id", "turn")


@register(
    "P8_segment_issue_flag",
    f"""WITH {DIALOGUE_SQL} SELECT conv_id, turn, ("end" - start < 0.5 OR "end" - start > 30.0 OR length(text) < 3) AS issue FROM dialogue""",
)
def p8(spark, d):
    turns = views.dialogue(spark, d).withColumn("duration", F.col("end") - F.col("start"))
    return turns.select("conv_id", "turn", transcripts.segment_issue().alias("issue"))


@register(
    "P9_turn_filter",
    f"""WITH {DIALOGUE_SQL}, s AS (SELECT * REPLACE ({strip_sql(PADDED_SQL)} AS text) FROM dialogue)
SELECT conv_id, turn, text FROM s WHERE "end" - start >= 5.0 AND text <> ''
AND NOT contains(lower(text), 'zlədiyiniz üçün təşəkkürlər') AND NOT contains(lower(text), ' the the')""",
)
def p9(spark, d):
    phrases = (*dialogue.BOILERPLATE, " the the")
    blank = F.when(F.col("turn") % 5 == 4, "\n\u00a0").otherwise(F.col("text"))
    turns = views.dialogue(spark, d).withColumn("text", F.concat(F.lit("\u00a0\t"), blank, F.lit("\u2003\n")))
    return dialogue.turn_filter(turns, 5.0, phrases).select("conv_id", "turn", "text")


@register(
    "P12_format_turn",
    f"""WITH {DIALOGUE_SQL} SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 <> 0 THEN speaker END, 'unknown') || ' (' ||
  coalesce(CASE WHEN turn % 4 <> 0 THEN emotion END, 'neu') || '): ' || text AS formatted FROM dialogue""",
)
def p12(spark, d):
    turns = views.dialogue(spark, d).withColumns(
        {"speaker": F.when(F.col("turn") % 3 != 0, F.col("speaker")), "emotion": F.when(F.col("turn") % 4 != 0, F.col("emotion"))}
    )
    return turns.select("conv_id", "turn", dialogue.format_turn().alias("formatted"))


@register(
    "P14_service_label",
    """SELECT conv_id, turn, CASE WHEN coalesce(CASE WHEN turn % 6 <> 0 THEN length(text) % 6 END, 0) >= 4
  THEN 'Operator tərəfindən yaxşı cavablandırıldı' ELSE 'Operator tərəfindən pis cavablandırıldı' END AS label FROM conversations""",
)
def p14(spark, d):
    score = F.when(F.col("turn") % 6 != 0, F.length("text") % 6)
    return views.table(spark, d, "conversations").select("conv_id", "turn", service_label(score).alias("label"))


ANSWER_SQL = f"""{DIALOGUE_SQL},
a AS (SELECT *, turn % 7 = 5 AS broken, turn % 5 <> 3 AS has_quality, length(text) % 5 + 1 AS whole, length(text) % 5 + 1 + CASE WHEN turn % 3 = 1 THEN 0.5 ELSE 0 END::DOUBLE AS score,
  (length(text) % 5 + 1) || CASE WHEN turn % 3 = 1 THEN '.5' ELSE '' END AS written FROM dialogue)"""


@register(
    "P15_parse_analysis_json",
    f"""WITH {ANSWER_SQL} SELECT conv_id, turn, CASE WHEN broken THEN 'Invalid JSON format received from the API.' END AS error,
  CASE WHEN NOT broken THEN 2 END AS n_turns, CASE WHEN NOT broken THEN text END AS first_text,
  CASE WHEN broken THEN NULL WHEN turn % 5 <> 2 THEN 'Card' ELSE 'No topic classified.' END AS topic,
  CASE WHEN NOT broken THEN 'Call ' || conv_id END AS summary,
  CASE WHEN broken THEN NULL WHEN has_quality THEN score ELSE 0 END::DOUBLE AS score,
  CASE WHEN broken THEN NULL WHEN has_quality THEN 'x' ELSE 'N/A' END AS quality_label FROM a""",
)
def p15(spark, d):
    parsed = transcripts.parse_analysis(views.analysis_json(spark, d))
    return parsed.select(
        "conv_id", "turn", "error", F.when(F.col("error").isNull(), F.size("dialogue")).alias("n_turns"),
        F.get("dialogue", F.lit(0))["text"].alias("first_text"), "topic", "summary", "score", "quality_label",
    )


@register(
    "R2_call_stages",
    f"""WITH {ANSWER_SQL},
e AS (SELECT *, CASE WHEN speaker = 'customer' THEN [emotion, 'neu'] ELSE ['neu'] END AS es FROM a)
SELECT conv_id, turn, 0 AS stage_no, 'identified_dialogue' AS stage, CASE WHEN broken THEN '["ERROR: Invalid JSON format received from the API."]'
  ELSE to_json([speaker || ' (' || emotion || '): ' || text, 'Customer (neu): ok'])::VARCHAR END AS result FROM e
UNION ALL SELECT conv_id, turn, 1, 'emotion_analysis', CASE WHEN broken THEN 'Analysis failed.'
  ELSE 'Customer emotion trend: ' || array_to_string(es, ' -> ') || '. ' || CASE WHEN len(es) = 1 THEN 'The customer''s emotion was neu.'
  WHEN emotion = 'neu' THEN 'The customer''s emotion remained neu.' ELSE 'The customer started ' || emotion || ' and finished neu.' END END AS result FROM e
UNION ALL SELECT conv_id, turn, 2, 'summary', CASE WHEN broken THEN 'Analysis failed.' ELSE 'Call ' || conv_id END FROM a
UNION ALL SELECT conv_id, turn, 3, 'topic_classification', CASE WHEN broken THEN 'Analysis failed.' WHEN turn % 5 <> 2 THEN 'Card' ELSE 'No topic classified.' END FROM a
UNION ALL SELECT conv_id, turn, 4, 'classification', CASE WHEN broken THEN '{{"label":"Error","score":0}}' WHEN has_quality AND score >= 4
  THEN '{{"label":"Operator tərəfindən yaxşı cavablandırıldı","score":' || written || '}}'
  ELSE '{{"label":"Operator tərəfindən pis cavablandırıldı","score":' || CASE WHEN has_quality THEN written ELSE '0' END || '}}' END FROM a""",
)
def r2_stages(spark, d):
    stages = transcripts.call_stages(transcripts.parse_analysis(views.analysis_json(spark, d)))
    return stages.select("conv_id", "turn", "stage_no", "stage", "result")


LINES_SQL = r"""
t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'operator' ELSE role END AS speaker,
    """ + strip_sql(r"regexp_replace(text, '[\r\n:\[\]]', ' ', 'g')") + r""" AS text, turn * 7 + conv_id % 50 AS s FROM conversations),
parsed AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN s + 0.25 ELSE s END::DOUBLE AS start,
    CASE WHEN turn % 4 = 1 THEN (s // 60 + 1) * 60 + s % 60 END::DOUBLE AS end, text FROM t WHERE turn % 4 <> 3 AND text <> '')"""


@register("P16_parse_transcript", f"WITH {LINES_SQL} SELECT * FROM parsed")
def p16(spark, d):
    return transcripts.parse_lines(views.transcript_lines(spark, d)).select("conv_id", "turn", "start", "end", "text")


def _filled(spark, d):
    """Parsed lines with ends; busy files are found on the lines, before any parsing."""
    lines = views.transcript_lines(spark, d)
    (heavy,) = heavy_hashes(lines, ["conv_id"])
    return transcripts.fill_ends(transcripts.parse_lines(lines), "conv_id", ["turn"], heavy)


@register(
    "W13_transcript_end_fill",
    f"""WITH {LINES_SQL}, n AS (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, turn) AS nx FROM parsed)
SELECT conv_id, turn, start, coalesce("end", CASE WHEN nx > start THEN nx END) AS end FROM n""",
)
def w13(spark, d):
    return _filled(spark, d).select("conv_id", "turn", "start", "end")


@register(
    "P18_clip_window",
    f"""WITH {LINES_SQL}, n AS (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, turn) AS nx FROM parsed),
c AS (SELECT conv_id, turn, floor(start * 1000)::BIGINT AS start_ms,
  least(floor(coalesce("end", CASE WHEN nx > start THEN nx END, 60.0) * 1000), 60000)::BIGINT AS end_ms FROM n)
SELECT * FROM c WHERE start_ms < end_ms AND end_ms - start_ms >= 100""",
)
def p18(spark, d):
    return transcripts.clip_windows(_filled(spark, d), F.lit(60.0)).select("conv_id", "turn", "start_ms", "end_ms")


@register(
    "P17_overlap_chunks",
    """WITH r AS (SELECT doc_id, length(text) / 15.0::DOUBLE AS dur FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, dur, unnest(range(0, CASE WHEN dur >= 30 THEN floor((dur - 30) / 18)::INT + 2 ELSE 1 END)) AS chunk FROM r)
SELECT doc_id, chunk, (chunk * 18.0)::DOUBLE AS chunk_start, """
    + near_sql("least(chunk * 18.0 + 30.0, dur)", 6)
    + " AS chunk_end FROM c",
)
def p17(spark, d):
    records = views.table(spark, d, "documents").select("doc_id", (F.length("text") / 15.0).alias("duration"))
    out = transcripts.overlap_chunks(records, "duration")
    return out.select("doc_id", "chunk", "chunk_start", near("chunk_end", 6).alias("chunk_end"))


@register(
    "W14_merge_turns",
    """WITH e AS (SELECT user_id AS conv_id, ts, event_id, event_type AS speaker, format('{:.2f}', value) AS text,
    (['hap', 'neu', 'sad'])[event_id % 3 + 1] AS emotion, row_number() OVER w AS rn,
    coalesce(lag(event_type) OVER w <> event_type, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, max(CASE WHEN new THEN rn END) OVER (PARTITION BY conv_id ORDER BY rn) AS run FROM e)
SELECT conv_id, run, speaker, string_agg(text, ' ' ORDER BY rn) AS text, arg_max(emotion, rn) AS emotion,
  arg_min(event_id, rn)::DOUBLE AS start, arg_max(event_id, rn) + 0.5::DOUBLE AS end, count(*) AS n_turns
FROM r GROUP BY conv_id, run, speaker""",
)
def w14(spark, d):
    return dialogue.merge_turns(views.event_runs(spark, d), order=["ts", "event_id"])


@register(
    "W14_merge_conversation_turns",
    f"""WITH {DIALOGUE_SQL}, e AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(speaker) OVER w <> speaker, true) AS new
  FROM dialogue WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, max(CASE WHEN new THEN rn END) OVER (PARTITION BY conv_id ORDER BY rn) AS run FROM e)
SELECT conv_id, run, speaker, string_agg(text, ' ' ORDER BY rn) AS text, arg_max(emotion, rn) AS emotion FROM r GROUP BY 1, 2, 3""",
)
def w14_conversations(spark, d):
    return dialogue.merge_turns(views.dialogue(spark, d)).select("conv_id", "run", "speaker", "text", "emotion")


@register(
    "A11_emotion_trend",
    f"""WITH {DIALOGUE_SQL}, c AS (SELECT conv_id, turn, {{'hap': 'Happy', 'neu': 'Neutral', 'sad': 'Sad', 'ang': 'Angry'}}[emotion] AS e
  FROM dialogue WHERE speaker = 'customer'),
g AS (SELECT conv_id, count(*) AS n, string_agg(e, ' -> ' ORDER BY turn) AS l, arg_min(e, turn) AS a, arg_max(e, turn) AS z FROM c GROUP BY 1)
SELECT conv_id, coalesce(n, 0) AS n_emotions, a AS start_emotion, z AS end_emotion,
  CASE WHEN n IS NULL THEN 'No customer speech detected to analyze emotion.' ELSE 'Customer emotion trend: ' || l || '. ' ||
    CASE WHEN n = 1 THEN 'The customer''s emotion was ' || a || '.' WHEN a = z THEN 'The customer''s emotion remained ' || z || '.'
    ELSE 'The customer started ' || a || ' and finished ' || z || '.' END END AS trend
FROM (SELECT DISTINCT conv_id FROM dialogue) LEFT JOIN g USING (conv_id)""".replace(
        "{'hap': 'Happy', 'neu': 'Neutral', 'sad': 'Sad', 'ang': 'Angry'}[emotion]",
        "CASE emotion WHEN 'hap' THEN 'Happy' WHEN 'neu' THEN 'Neutral' WHEN 'sad' THEN 'Sad' ELSE 'Angry' END",
    ),
)
def a11(spark, d):
    return dialogue.emotion_trend(views.dialogue(spark, d))


@register(
    "A12_speaker_texts",
    f"""WITH {DIALOGUE_SQL} SELECT conv_id, speaker, string_agg(text, ' ' ORDER BY turn) AS text, min(turn) AS first_turn,
  count(*) AS n_turns FROM dialogue GROUP BY 1, 2""",
)
def a12(spark, d):
    return dialogue.speaker_texts(views.dialogue(spark, d))


ROLES_SQL = f"""WITH {DIALOGUE_SQL},
f AS (SELECT conv_id, speaker, min(turn) AS first, sum(length(text)) AS len FROM dialogue GROUP BY 1, 2),
p AS (SELECT conv_id, arg_min(speaker, first) AS speaker_a, arg_max(speaker, first) AS speaker_b,
  arg_min(len, first) AS la, arg_max(len, first) AS lb FROM f GROUP BY 1 HAVING count(*) = 2),
s AS (SELECT conv_id, speaker_a, speaker_b, la % 2 AS label_a, lb % 2 AS label_b, (9000 + la % 1000) / 10000.0::DOUBLE AS conf_a,
  (9000 + lb % 1000) / 10000.0::DOUBLE AS conf_b FROM p),
r AS (SELECT *, CASE WHEN conf_a > 0.98 THEN label_a WHEN conf_b > 0.95 THEN 1 - label_b ELSE label_b END AS ra,
  CASE WHEN conf_a > 0.98 THEN 1 - label_a ELSE label_b END AS rb, NOT (conf_a > 0.98 OR conf_b > 0.95) AS low_confidence FROM s),
roles AS (SELECT conv_id, speaker_a, speaker_b, (['customer', 'operator'])[(ra + 1)::INT] AS role_a, (['customer', 'operator'])[(rb + 1)::INT] AS role_b, low_confidence FROM r)"""


def _roles(spark, d):
    """Speaker pairs under a stand-in classifier that looks at text lengths."""
    turns = views.dialogue(spark, d)
    pairs = dialogue.speaker_pairs(turns)
    sizes = turns.groupBy("conv_id", "speaker").agg(F.sum(F.length("text")).alias("_len"))
    for side in ("a", "b"):
        own = sizes.select("conv_id", F.col("speaker").alias(f"speaker_{side}"), F.col("_len").alias(f"_len_{side}"))
        pairs = pairs.join(own, ["conv_id", f"speaker_{side}"])
    scored = pairs.select(
        "conv_id",
        "speaker_a",
        "speaker_b",
        *[(F.col(f"_len_{s}") % 2).alias(f"label_{s}") for s in "ab"],
        *[((9000 + F.col(f"_len_{s}") % 1000) / 10000.0).alias(f"conf_{s}") for s in "ab"],
    )
    return dialogue.assign_roles(scored)


@register("A13_speaker_roles", ROLES_SQL + " SELECT * FROM roles")
def a13(spark, d):
    return _roles(spark, d).select("conv_id", "speaker_a", "speaker_b", "role_a", "role_b", "low_confidence")


@register(
    "A13_labelled_dialogue",
    ROLES_SQL
    + """ SELECT conv_id, turn, CASE WHEN role_a IS NULL THEN 'speaker_' || right(speaker, 2) WHEN speaker = speaker_a THEN role_a
  ELSE role_b END AS speaker FROM dialogue LEFT JOIN roles USING (conv_id)""",
)
def a13_labelled(spark, d):
    return dialogue.label_speakers(views.dialogue(spark, d), _roles(spark, d)).select("conv_id", "turn", "speaker")


@register(
    "A14_taxonomy",
    """SELECT split_part(p_type, ' ', 1) AS class, row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY p_partkey) AS position,
  p_type AS sub_class FROM part WHERE p_size <> 7""",
)
def a14(spark, d):
    part = views.table(spark, d, "part")
    topics = part.select(
        "p_partkey", F.split("p_type", " ")[0].alias("Class"), F.when(F.col("p_size") != 7, F.col("p_type")).alias("Sub_class")
    )
    return dialogue.taxonomy(topics, ["p_partkey"])


@register(
    "A10_describe_segments",
    f"""WITH {DIALOGUE_SQL}, s AS (SELECT "end" - start AS duration, length(text) AS text_length FROM dialogue)
"""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {rounded_sql([f'avg({c})']).split(' AS ')[0]} AS mean,
  {near_sql(f'stddev_samp({c})')} AS std, {near_sql(f'min({c})')} AS min, {near_sql(f'quantile_cont({c}, 0.25)')} AS q25,
  {near_sql(f'quantile_cont({c}, 0.5)')} AS q50, {near_sql(f'quantile_cont({c}, 0.75)')} AS q75, {near_sql(f'max({c})')} AS max FROM s"""
        for c in ("duration", "text_length")
    ),
)
def a10(spark, d):
    from orderlark.operators.summary import describe

    turns = views.dialogue(spark, d).select((F.col("end") - F.col("start")).alias("duration"), F.length("text").alias("text_length"))
    out = describe(turns, ["duration", "text_length"])
    return out.select("column", "count", *rounded(["mean", "std", "min", "q25", "q50", "q75", "max"]))


DOT_SQL = """
m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY pos) AS mean FROM m GROUP BY 1),
s AS (SELECT vec_id, c.label, list_dot_product(c.mean, embedding::DOUBLE[]) AS score FROM embeddings, c)"""


@register(
    "W20_softmax_scores",
    f"""WITH {DOT_SQL}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM s)
SELECT vec_id, label, {near_sql('e / sum(e) OVER (PARTITION BY vec_id)', 5)} AS probability FROM e""",
)
def w20(spark, d):
    out = dialogue.normalise_scores(views.label_scores(spark, d), "vec_id")
    return out.select("vec_id", "label", *rounded(["probability"], 5))


@register("W20_sigmoid_scores", f"WITH {DOT_SQL} SELECT vec_id, label, {near_sql('1 / (1 + exp(-score))', 5)} AS probability FROM s")
def w20_sigmoid(spark, d):
    out = dialogue.normalise_scores(views.label_scores(spark, d), "vec_id", multi_label=True)
    return out.select("vec_id", "label", *rounded(["probability"], 5))


@register(
    "W21_two_stage_topic",
    f"""WITH {DOT_SQL}, best AS (SELECT vec_id, arg_min(label, (-round(score, 9), label)) AS class FROM s GROUP BY 1),
m2 AS (SELECT label, vec_id % 3 AS sub, pos, avg(x) AS x FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2, 3),
c2 AS (SELECT label, sub, list(x ORDER BY pos) AS mean FROM m2 GROUP BY 1, 2),
s2 AS (SELECT e.vec_id, class, sub, round(list_dot_product(c2.mean, embedding::DOUBLE[]), 9) AS score
  FROM embeddings e JOIN best USING (vec_id) JOIN c2 ON c2.label = class)
SELECT vec_id, class, arg_min(sub, (-score, sub)) AS sub_class, class || ': ' || arg_min(sub, (-score, sub)) AS topic FROM s2 GROUP BY 1, 2""",
)
def w21(spark, d):
    rows = views.table(spark, d, "embeddings")
    class_scores = views.label_scores(spark, d).withColumn("score", F.round("score", 9))
    packed = rows.withColumn("_pair", F.col("label") * 3 + F.col("vec_id") % 3)
    sub = views._centroid_scores(packed, packed, "_pair")
    sub = sub.select(
        "vec_id",
        F.floor(F.col("label") / 3).cast("int").alias("class"),
        (F.col("label") % 3).alias("sub_class"),
        F.round("score", 9).alias("score"),
    )
    return dialogue.two_stage_topic(class_scores, sub, "vec_id").select("vec_id", "class", "sub_class", "topic")


@register(
    "T5_word_error_rate",
    r"""WITH w AS (SELECT conv_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT CASE WHEN conv_id % 2 = 0 THEN 'dropping' ELSE 'replacing' END AS model, sum(n // 7)::BIGINT AS edits, sum(n)::BIGINT AS n_words,
  round(100 * sum(n // 7) / sum(n), 6) AS wer FROM w GROUP BY 1""",
)
def t5(spark, d):
    out = transcripts.word_error_rate(views.wer_pairs(spark, d))
    return out.withColumn("wer", F.round("wer", 6))


# --- business questions -------------------------------------------------------------

BI_SQL = """customers AS (SELECT c_custkey AS id, c_name AS name, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey),
ord AS (SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderdate AS order_date, o_orderpriority AS payment_type, o_totalprice AS amount FROM orders),
reviews AS (SELECT l_orderkey AS order_id, (1 + l_quantity % 5)::INT AS score FROM lineitem)"""


def _bi(spark, d):
    return views.bi_customers(spark, d), views.bi_orders(spark, d), views.bi_reviews(spark, d)


@register(
    "J7_orders_with_reviews",
    f"""WITH {BI_SQL}, r AS (SELECT order_id, sum(score)::BIGINT AS score_sum, count(*) AS n_reviews FROM reviews GROUP BY 1)
SELECT ord.id, customer_id, name, city, amount, payment_type, score_sum, n_reviews FROM ord JOIN customers ON customers.id = customer_id
JOIN r ON r.order_id = ord.id""",
)
def j7(spark, d):
    out = bi.orders_with_reviews(*_bi(spark, d))
    return out.select("id", "customer_id", "name", "city", "amount", "payment_type", "score_sum", "n_reviews")


@register(
    "A15_top_cities_by_orders",
    f"""WITH {BI_SQL} SELECT city, count(*) AS order_count FROM ord JOIN customers ON customers.id = customer_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def a15_cities(spark, d):
    customers, orders, _ = _bi(spark, d)
    return bi.top_cities(customers, orders)


@register(
    "A15_average_review_by_city",
    f"""WITH {BI_SQL} SELECT city, {near_sql('avg(score)', 6)} AS avg_review FROM ord JOIN customers ON customers.id = customer_id
JOIN reviews ON order_id = ord.id GROUP BY 1""",
)
def a15_reviews(spark, d):
    return bi.average_review_by_city(*_bi(spark, d)).select("city", *rounded(["avg_review"], 6))


@register(
    "A15_most_used_payment",
    f"WITH {BI_SQL} SELECT payment_type, count(*) AS order_count FROM ord GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
def a15_payment(spark, d):
    return bi.most_used_payment(views.bi_orders(spark, d))


PAYMENT_SQL = f"""WITH {BI_SQL}, p AS (SELECT city, round(sum(amount), 2) AS total_payment FROM ord JOIN customers ON customers.id = customer_id GROUP BY 1)"""


@register("A15_payment_by_city", PAYMENT_SQL + " SELECT * FROM p")
def a15_total(spark, d):
    customers, orders, _ = _bi(spark, d)
    return bi.payment_by_city(customers, orders).withColumn("total_payment", F.round("total_payment", 2))


@register(
    "W19_bar_heights",
    PAYMENT_SQL + " SELECT city, total_payment, floor(total_payment / (SELECT max(total_payment) FROM p) * 140 + 0.5)::BIGINT AS height FROM p",
)
def w19(spark, d):
    return bi.bar_heights(a15_total(spark, d), "total_payment")
