"""Registered queries over labelled texts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlark.functions.strings import SPACE_CLASS, strip
from orderlark.models import texts
from orderlark.operators import evaluate, neighbors, prepare, splits, text_neighbors, tfidf
from orderlark.plans import views
from orderlark.plans.views import near_sql, rounded, strip_sql
from orderlark.session import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return keep


SPACES = f"[^{SPACE_CLASS}]+"
LABELLED_SQL = """lab AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' ' || lang || ' ' WHEN 1 THEN chr(9) || lang || chr(160) || chr(10) ELSE lang END AS label,
  CASE WHEN doc_id % 31 <> 0 THEN text END AS text FROM documents)"""


def _labelled(spark, d):
    docs = views.table(spark, d, "documents")
    padded = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(" "), "lang", F.lit(" ")))
    padded = padded.when(F.col("doc_id") % 9 == 1, F.concat(F.lit("\t"), "lang", F.lit("\u00a0\n"))).otherwise(F.col("lang"))
    return docs.select("doc_id", padded.alias("label"), F.when(F.col("doc_id") % 31 != 0, F.col("text")).alias("text"))


@register("P4_trim_labels", f"WITH {LABELLED_SQL} SELECT doc_id, {strip_sql('label')} AS label FROM lab")
def p4(spark, d):
    return prepare.trim_labels(_labelled(spark, d), "label").select("doc_id", "label")


@register(
    "P4_missing_and_duplicates",
    f"""WITH {LABELLED_SQL}, g AS (SELECT text, {strip_sql('label')} AS label, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT coalesce(sum(n) FILTER (text IS NULL), 0)::BIGINT AS missing_text, coalesce(sum(n) FILTER (label IS NULL), 0)::BIGINT AS missing_label,
  sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates FROM g""",
)
def p4_counts(spark, d):
    return prepare.missing_and_duplicates(prepare.trim_labels(_labelled(spark, d), "label"), ["text", "label"])


@register("P4_drop_duplicates", f"WITH {LABELLED_SQL} SELECT DISTINCT text, {strip_sql('label')} AS label FROM lab")
def p4_distinct(spark, d):
    return prepare.trim_labels(_labelled(spark, d), "label").select("text", "label").dropDuplicates()


@register(
    "P5_label_remap",
    """SELECT d.doc_id, coalesce('checked ' || l.quality, CASE lang WHEN 'fr' THEN 'Other' ELSE lang END) AS label
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1""",
)
def p5(spark, d):
    mapped = prepare.remap_labels(views.intents(spark, d), "label", {"fr": "Other"})
    fixes = views.table(spark, d, "labels").where("toxic = 1")
    fixes = fixes.select("doc_id", F.concat(F.lit("checked "), F.col("quality").cast("string")).alias("label"))
    return prepare.correct_labels(mapped, fixes, "doc_id", "label").select("doc_id", "label")


SHORT_SQL = rf"""src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 2000000000 + event_id, event_type FROM events),
n AS (SELECT *, len(regexp_extract_all(text, '{SPACES}')) AS words, regexp_full_match(text, '[\p{{L}}\p{{N}}_\s.,''-]{{0,10}}') AS plain FROM src)"""


def _texts(spark, d):
    """Documents, turns and bare event names: long, short and gibberish-like texts."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    turns = views.table(spark, d, "conversations").select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    names = views.table(spark, d, "events").select((F.lit(2000000000) + F.col("event_id")).alias("id"), F.col("event_type").alias("text"))
    return docs.unionByName(turns).unionByName(names)


@register("P6_short_text_filter", f"WITH {SHORT_SQL} SELECT id, text FROM n WHERE NOT (words < 24 OR plain)")
def p6(spark, d):
    return prepare.drop_short_texts(_texts(spark, d), "text")


@register("J8_meaningless_anti_join", f"WITH {SHORT_SQL} SELECT id, text FROM n WHERE text NOT IN (SELECT text FROM n WHERE words < 24 OR plain)")
def j8(spark, d):
    rows = _texts(spark, d)
    return prepare.without(rows, prepare.short_texts(rows, "text"), ["text"])


@register(
    "T3_text_measures",
    rf"""SELECT doc_id, len(regexp_extract_all(text, '{SPACES}')) AS words, length(text) AS characters, md5(lower({strip_sql('text')})) AS lowered FROM documents""",
)
def t3(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id",
        prepare.word_count("text").alias("words"),
        F.length("text").alias("characters"),
        F.md5(F.lower(strip("text"))).alias("lowered"),
    )


@register("A7_label_distribution", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1")
def a7(spark, d):
    from orderlark.operators.summary import top_values

    return top_values(views.intents(spark, d), "label", count="n")


SPLIT_SQL = """ranked AS (SELECT doc_id, text, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rk,
  count(*) OVER (PARTITION BY lang) AS n FROM documents),
split AS (SELECT doc_id, text, label, CASE WHEN rk <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked)"""
PARTS = [("train", 0.6), ("val", 0.2), ("test", 0.2)]


def _split(spark, d):
    return splits.stratified_split(views.intents(spark, d), "label", "doc_id", PARTS)


def _sized(spark, d):
    """The split with the lengths of the texts, so that adding them up moves no text."""
    return splits.stratified_split(views.intents(spark, d).withColumn("chars", F.length("text")), "label", "doc_id", PARTS)


@register("X2_stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, label, split FROM split")
def x2(spark, d):
    return _split(spark, d).select("doc_id", "label", "split")


@register(
    "X2_stratified_split_70_30",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def x2_vectors(spark, d):
    rows = views.table(spark, d, "embeddings").select("vec_id", "label")
    return splits.stratified_split(rows, "label", "vec_id", [("train", 0.7), ("test", 0.3)]).select("vec_id", "split")


@register(
    "X3_random_split",
    "SELECT doc_id, CASE WHEN ('0x' || substr(md5('90' || doc_id), 1, 8))::BIGINT % 1000 < 100 THEN 'test' ELSE 'train' END AS split FROM documents",
)
def x3(spark, d):
    return splits.random_split(views.table(spark, d, "documents"), "doc_id", 0.1, salt="90").select("doc_id", "split")


def _tfidf_sql(cap: int | None) -> str:
    order = f"ORDER BY corpus_tf DESC, token LIMIT {cap}" if cap else ""
    return rf"""{SPLIT_SQL},
tok AS (SELECT doc_id, split, token, count(*) AS tf FROM (SELECT doc_id, split, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS token FROM split) GROUP BY 1, 2, 3),
voc AS (SELECT token, count(*) AS df, sum(tf) AS corpus_tf FROM tok WHERE split = 'train' GROUP BY 1 {order}),
idf AS (SELECT token, df, corpus_tf, ln((1.0 + (SELECT count(*) FROM split WHERE split = 'train')) / (1.0 + df)) + 1 AS idf FROM voc),
raw AS (SELECT doc_id, split, token, tf * idf AS raw FROM tok JOIN idf USING (token)),
w AS (SELECT doc_id, split, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@register("T1_tfidf", f"WITH {_tfidf_sql(None)} SELECT doc_id, token, {near_sql('weight', 5)} AS weight FROM w")
def t1(spark, d):
    out = tfidf.tfidf(_sized(spark, d), "doc_id", "text", F.col("split") == "train", chars="chars")
    return out.select("doc_id", "token", *rounded(["weight"], 5))


@register("T1_tfidf_capped", f"WITH {_tfidf_sql(300)} SELECT doc_id, token, {near_sql('weight', 5)} AS weight FROM w")
def t1_capped(spark, d):
    out = tfidf.tfidf(_sized(spark, d), "doc_id", "text", F.col("split") == "train", 300, chars="chars")
    return out.select("doc_id", "token", *rounded(["weight"], 5))


@register("T2_vocabulary", f"WITH {_tfidf_sql(5000)} SELECT token, df, corpus_tf::BIGINT AS corpus_tf, {near_sql('idf', 6)} AS idf FROM idf")
def t2(spark, d):
    train = _split(spark, d).where("split = 'train'")
    n = train.agg(F.count(F.lit(1))).scalar()
    out = tfidf.text_vocabulary(train, "text", n, 5000)
    return out.select("token", "df", "corpus_tf", *rounded(["idf"], 6))


@register(
    "T4_vector_distance",
    f"""SELECT a.vec_id, {near_sql('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 5)} AS cosine,
  {near_sql('list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 5)} AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def t4(spark, d):
    rows = views.table(spark, d, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    out = rows.join(following, "vec_id").select(
        "vec_id", tfidf.cosine("embedding", "other").alias("cosine"), tfidf.euclidean("embedding", "other").alias("distance")
    )
    return out.select("vec_id", *rounded(["cosine", "distance"], 5))


# --- neighbours ---------------------------------------------------------------------


def _vectors(spark, d):
    rows = views.table(spark, d, "embeddings")
    parted = splits.stratified_split(rows, "label", "vec_id", [("train", 0.7), ("test", 0.3)])
    return parted.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("val"), F.col("label").cast("string").alias("label"), "split"
    )


VECTOR_KNN_SQL = """r AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
p AS (SELECT *, rk <= floor(n * 0.7::DOUBLE) AS train FROM r),
dist AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, b.label::VARCHAR AS neighbor_label, q.label::VARCHAR AS label, round(list_distance(q.v, b.v) ** 2, 9) AS d2
  FROM p q JOIN p b ON NOT q.train AND b.train),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rank FROM dist QUALIFY rank <= 5)"""


def _vector_neighbors(spark, d, k=5):
    rows = _vectors(spark, d)
    return neighbors.knn_join(rows.where("split = 'test'"), rows.where("split = 'train'"), k, dim=64)


@register("J9_nearest_vectors", f"WITH {VECTOR_KNN_SQL} SELECT query_id, neighbor_id, rank, {near_sql('sqrt(d2)', 5)} AS distance FROM nn")
def j9(spark, d):
    return _vector_neighbors(spark, d).select("query_id", "neighbor_id", "rank", *rounded(["distance"], 5))


@register(
    "M10_knn_vectors",
    f"""WITH {VECTOR_KNN_SQL}, v AS (SELECT query_id, neighbor_label, count(*) AS c FROM nn GROUP BY 1, 2)
SELECT query_id, arg_min(neighbor_label, (-c, neighbor_label)) AS prediction FROM v GROUP BY 1""",
)
def m10(spark, d):
    return neighbors.knn_vote(_vector_neighbors(spark, d))


@register(
    "M10_knn_vectors_distance",
    f"""WITH {VECTOR_KNN_SQL}, v AS (SELECT query_id, neighbor_label, count(*) FILTER (d2 = 0) AS same,
  round(coalesce(sum(1 / sqrt(d2)) FILTER (d2 > 0), 0), 9) AS c FROM nn GROUP BY 1, 2)
SELECT query_id, arg_min(neighbor_label, (-same, -c, neighbor_label)) AS prediction FROM v GROUP BY 1""",
)
def m10_distance(spark, d):
    return neighbors.knn_vote(_vector_neighbors(spark, d), weights="distance")


def _weighted(spark, d):
    """All rows with their split, and the weights of their numbered tokens, both written once."""
    rows = stored(_split(spark, d), "texts")
    return rows, stored(tfidf.tfidf(rows, "doc_id", "text", F.col("split") == "train", numbered=True), "weights")


def _text_neighbors(spark, d, k=5):
    rows, weights = _weighted(spark, d)
    rows = rows.select(F.col("doc_id").alias("id"), "label", "split")
    return text_neighbors.sparse_knn(weights.withColumnRenamed("doc_id", "id"), rows.where("split = 'test'"), rows.where("split = 'train'"), k)


TEXT_KNN_SQL = f"""{_tfidf_sql(None)},
dot AS (SELECT q.doc_id AS query_id, b.doc_id AS neighbor_id, sum(q.weight * b.weight) AS dot FROM w q JOIN w b USING (token) WHERE q.split = 'test' AND b.split = 'train' GROUP BY 1, 2),
len AS (SELECT s.doc_id, s.split, s.label, CASE WHEN count(w.token) > 0 THEN 1 ELSE 0 END AS len FROM split s LEFT JOIN w ON w.doc_id = s.doc_id GROUP BY 1, 2, 3),
dist AS (SELECT q.doc_id AS query_id, b.doc_id AS neighbor_id, b.label AS neighbor_label, q.label, round(greatest(q.len + b.len - 2 * coalesce(dot, 0), 0), 9) AS d2
  FROM len q JOIN len b ON q.split = 'test' AND b.split = 'train' LEFT JOIN dot ON query_id = q.doc_id AND neighbor_id = b.doc_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rank FROM dist QUALIFY rank <= 5),
votes AS (SELECT query_id, label, neighbor_label, count(*) AS c FROM nn GROUP BY 1, 2, 3),
pred AS (SELECT query_id, label, arg_min(neighbor_label, (-c, neighbor_label)) AS prediction FROM votes GROUP BY 1, 2)"""


@register("J9_nearest_texts", f"WITH {TEXT_KNN_SQL} SELECT query_id, neighbor_id, rank, {near_sql('sqrt(d2)', 4)} AS distance FROM nn")
def j9_texts(spark, d):
    return _text_neighbors(spark, d).select("query_id", "neighbor_id", "rank", *rounded(["distance"], 4))


def _text_predictions(spark, d):
    truth = _split(spark, d).where("split = 'test'").select(F.col("doc_id").alias("query_id"), "label")
    return neighbors.knn_vote(_text_neighbors(spark, d)).join(truth, "query_id")


@register("M10_knn_texts", f"WITH {TEXT_KNN_SQL} SELECT query_id, label, prediction FROM pred")
def m10_texts(spark, d):
    return _text_predictions(spark, d).select("query_id", "label", "prediction")


def _bayes_sql(rows: str, fitted: str, scored: str, alpha: str = "1.0") -> str:
    """Class per scored document, from w (doc_id, token, weight) and rows (doc_id, label)."""
    return f"""prior AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM {rows} WHERE {fitted} GROUP BY 1),
mass AS (SELECT r.label, token, sum(weight) AS m FROM w JOIN {rows} r USING (doc_id) WHERE {fitted.replace('split', 'r.split')} GROUP BY 1, 2),
total AS (SELECT p.label, lp, coalesce(sum(m), 0) + {alpha} * (SELECT count(DISTINCT token) FROM mass) AS t FROM prior p LEFT JOIN mass USING (label) GROUP BY 1, 2),
sc AS (SELECT r.doc_id, r.label AS truth, total.label, round(lp + coalesce(sum(w.weight * ln((coalesce(m, 0) + {alpha}) / t)), 0), 9) AS s FROM {rows} r JOIN total ON {scored.replace('split', 'r.split')}
  LEFT JOIN w ON w.doc_id = r.doc_id LEFT JOIN mass ON mass.label = total.label AND mass.token = w.token GROUP BY 1, 2, 3, lp),
nb AS (SELECT doc_id, truth AS label, arg_min(label, (-s, label)) AS prediction FROM sc GROUP BY 1, 2)"""


@register("M9_multinomial_bayes", f"""WITH {_tfidf_sql(None)}, {_bayes_sql('split', "split = 'train'", "split = 'test'")} SELECT doc_id, label, prediction FROM nb""")
def m9_bayes(spark, d):
    rows = stored(_split(spark, d), "texts")
    weights = tfidf.tfidf(rows, "doc_id", "text", F.col("split") == "train")
    placed = texts.placed_weights(weights, rows, "doc_id", F.col("split"))
    mass = stored(texts.placed_mass(placed.where("part = 'train'")).drop("part"), "mass")
    (model,) = texts.bayes_of(mass, rows.where("split = 'train'"))
    held = rows.where("split = 'test'").select("doc_id", "label")
    return model.predict(placed.where("part = 'test'").select("doc_id", "token", "weight"), held, "doc_id").join(held, "doc_id")


ALPHAS = [0.1, 0.5, 1.0]
# All rows make the vocabulary; the column `split` holds the fold.
BAYES_GRID_ROWS_SQL = rf"""split AS (SELECT doc_id, lower({strip_sql('text')}) AS text, lang AS label, ('0x' || substr(md5('fold' || doc_id), 1, 8))::BIGINT % 3 AS split FROM documents),
tok AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]{{2,}}')) AS token FROM split) GROUP BY 1, 2),
idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM split)) / (1.0 + count(*))) + 1 AS idf FROM tok GROUP BY 1),
raw AS (SELECT doc_id, token, tf * idf AS raw FROM tok JOIN idf USING (token)),
w AS (SELECT doc_id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def _bayes_grid_sql() -> str:
    runs = [
        f"SELECT {a}::DOUBLE AS alpha, acc FROM (WITH {_bayes_sql('split', f'split <> {f}', f'split = {f}', f'{a}::DOUBLE')} SELECT avg((label = prediction)::INT) AS acc FROM nb)"
        for a in ALPHAS
        for f in range(3)
    ]
    return f"WITH {BAYES_GRID_ROWS_SQL}, a AS ({' UNION ALL '.join(runs)}) SELECT alpha, {near_sql('avg(acc)', 6)} AS accuracy FROM a GROUP BY 1"


@register("X4_bayes_grid", _bayes_grid_sql())
def x4_bayes(spark, d):
    rows = views.intents(spark, d).withColumn("text", F.lower(strip("text")))
    weights = tfidf.tfidf(rows, "doc_id", "text", F.lit(True))
    out = texts.token_bayes_grid(weights, rows, "doc_id", splits.fold_of("doc_id"), 3, ALPHAS)
    return out.select("alpha", *rounded(["accuracy"], 6))


@register(
    "E4_class_report",
    f"""WITH {VECTOR_KNN_SQL}, v AS (SELECT query_id, label, neighbor_label, count(*) AS c FROM nn GROUP BY 1, 2, 3),
pr AS (SELECT query_id, label, arg_min(neighbor_label, (-c, neighbor_label)) AS p FROM v GROUP BY 1, 2),
k AS (SELECT DISTINCT label AS class FROM pr UNION SELECT DISTINCT p FROM pr),
m AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (p = class) AS pc, count(*) FILTER (p = class AND label = class) AS tp FROM k, pr GROUP BY 1)
SELECT class, support, {near_sql('CASE WHEN pc = 0 THEN 0 ELSE tp / pc END', 6)} AS precision, {near_sql('CASE WHEN support = 0 THEN 0 ELSE tp / support END', 6)} AS recall,
  {near_sql('2 * tp / (pc + support)', 6)} AS f1 FROM m""",
)
def e4(spark, d):
    truth = _vectors(spark, d).select(F.col("id").alias("query_id"), "label")
    predicted = neighbors.knn_vote(_vector_neighbors(spark, d)).join(truth, "query_id")
    out = evaluate.class_report(predicted, "label", "prediction")
    return out.select("class", "support", *rounded(["precision", "recall", "f1"], 6))


@register(
    "E4_weighted_metrics",
    f"""WITH {TEXT_KNN_SQL}, k AS (SELECT DISTINCT label AS class FROM pred UNION SELECT DISTINCT prediction FROM pred),
m AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS pc, count(*) FILTER (prediction = class AND label = class) AS tp FROM k, pred GROUP BY 1),
r AS (SELECT support, CASE WHEN pc = 0 THEN 0 ELSE tp / pc END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r, 2 * tp / (pc + support) AS f FROM m)
SELECT {near_sql('sum(r * support) / sum(support)', 6)} AS accuracy, {near_sql('sum(p * support) / sum(support)', 6)} AS precision,
  {near_sql('sum(r * support) / sum(support)', 6)} AS recall, {near_sql('sum(f * support) / sum(support)', 6)} AS f1 FROM r""",
)
def e4_weighted(spark, d):
    out = evaluate.weighted_metrics(_text_predictions(spark, d), "label", "prediction")
    return out.select(*rounded(["accuracy", "precision", "recall", "f1"], 6))


GRID_KS, GRID_WEIGHTS = [3, 5, 7], ["uniform", "distance"]
GRID_SQL = """p AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS v, ('0x' || substr(md5('fold' || vec_id), 1, 8))::BIGINT % 3 AS fold FROM embeddings),
dist AS (SELECT q.vec_id AS query_id, q.fold, q.label, b.vec_id AS neighbor_id, b.label AS neighbor_label, round(list_distance(q.v, b.v) ** 2, 9) AS d2
  FROM p q JOIN p b ON q.fold <> b.fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rank FROM dist QUALIFY rank <= 7),
ks AS (SELECT unnest([3, 5, 7])::INT AS k),
v AS (SELECT k, query_id, fold, label, neighbor_label, count(*) AS n, count(*) FILTER (d2 = 0) AS same,
  round(coalesce(sum(1 / sqrt(d2)) FILTER (d2 > 0), 0), 9) AS c FROM nn JOIN ks ON rank <= k GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT k, 'uniform' AS weights, query_id, fold, label, arg_min(neighbor_label, (-n, neighbor_label)) AS pred FROM v GROUP BY 1, 3, 4, 5
  UNION ALL SELECT k, 'distance', query_id, fold, label, arg_min(neighbor_label, (-same, -c, neighbor_label)) FROM v GROUP BY 1, 3, 4, 5),
f AS (SELECT k, weights, fold, avg((pred = label)::INT) AS a FROM w GROUP BY 1, 2, 3)"""


@register("X4_knn_grid", f"WITH {GRID_SQL} SELECT k, weights, {near_sql('avg(a)', 6)} AS accuracy FROM f GROUP BY 1, 2")
def x4(spark, d):
    rows = _vectors(spark, d).select("id", "val", "label")
    out = neighbors.knn_grid(rows, 64, splits.fold_of("id"), 3, GRID_KS, GRID_WEIGHTS)
    return out.select("k", "weights", *rounded(["accuracy"], 6))
