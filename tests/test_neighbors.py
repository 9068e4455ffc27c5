"""The neighbour join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlark.operators.neighbors import _packs, knn_join, knn_vote
from orderlark.operators.text_neighbors import block_max_pairs, sparse_knn


def brute(q, b, ids, k):
    d2 = np.round(((q[:, None, :] - b[None, :, :]) ** 2).sum(-1), 9)
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]
    return ids[order], np.sqrt(np.take_along_axis(d2, order, 1))


@pytest.mark.parametrize("copies", [0, 60])
def test_exact_with_small_blocks(spark, copies):
    rng = np.random.default_rng(3)
    base, queries = rng.normal(size=(180, 4)), rng.normal(size=(40, 4))
    base[:copies] = base[0]  # a third of the base rows are copies
    queries[0] = base[0]
    label = [str(i % 3) for i in range(len(base))]
    b = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(base, label))], "id bigint, val array<double>, label string")
    q = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(queries)], "id bigint, val array<double>")
    out = knn_join(q, b, 7, dim=4, pivots=8, block_rows=16).orderBy("query_id", "rank").collect()
    ids, dist = brute(queries, base, np.arange(len(base)), 7)
    assert [r["neighbor_id"] for r in out] == ids.ravel().tolist()
    assert [r["distance"] for r in out] == pytest.approx(dist.ravel().tolist(), abs=1e-6)


def test_fewer_base_rows_than_k(spark):
    b = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b")], "id bigint, val array<double>, label string")
    q = spark.createDataFrame([(9, [0.2])], "id bigint, val array<double>")
    assert [r["neighbor_id"] for r in knn_join(q, b, 5, dim=1).orderBy("rank").collect()] == [1, 2]


def test_sparse_rows(spark):
    schema = "id bigint, idx array<int>, val array<double>, label string"
    b = spark.createDataFrame([(1, [0], [1.0], "a"), (2, [1], [1.0], "b"), (3, [], [], "c")], schema)
    q = spark.createDataFrame([(9, [1], [1.0], None)], schema)
    out = knn_join(q, b, 2, dim=3).orderBy("rank").collect()
    assert [(r["neighbor_id"], round(r["distance"], 6)) for r in out] == [(2, 0.0), (3, 1.0)]


def test_votes(spark):
    rows = [(1, "a", 2.0, 1), (1, "b", 2.0, 2), (2, "b", 0.0, 1), (2, "a", 0.1, 2), (2, "a", 0.1, 3)]
    near = spark.createDataFrame(rows, "query_id bigint, neighbor_label string, distance double, rank int")
    assert dict(knn_vote(near, 5).collect()) == {1: "a", 2: "a"}
    assert dict(knn_vote(near, 5, "distance").collect()) == {1: "a", 2: "b"}
    assert dict(knn_vote(near, 1).collect()) == {1: "a", 2: "b"}


def test_inverted_index_is_exact(spark):
    """Frequent tokens, rare ones, empty rows and copies against brute force."""
    rng = np.random.default_rng(5)
    dense = np.zeros((120, 60))
    for row in dense[:112]:
        row[0] = 1
        row[rng.zipf(1.3, 14).clip(1, 59)] += rng.random(14)
    dense[10:25] = dense[9]
    dense[:112] /= np.sqrt((dense[:112] ** 2).sum(1))[:, None]
    cells = [(int(i), f"t{j:02d}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    weights = spark.createDataFrame(cells, "id bigint, token string, weight double")
    q, b = [i for i in range(120) if i % 3 == 0], np.array([i for i in range(120) if i % 3])
    queries = spark.createDataFrame([(i,) for i in q], "id bigint")
    base = spark.createDataFrame([(int(i), "x") for i in b], "id bigint, label string")
    out = sparse_knn(weights, queries, base, 4, block_rows=10).orderBy("query_id", "rank").collect()
    ids, dist = brute(dense[q], dense[b], b, 4)
    assert [r["distance"] for r in out] == pytest.approx(dist.ravel().tolist(), abs=1e-4)
    assert [r["neighbor_id"] for r in out] == ids.ravel().tolist()
    few = sparse_knn(weights, queries, base.limit(2), 4)
    assert few.groupBy("query_id").count().select("count").distinct().collect() == [(2,)]
    # Whole blocks hand on k rows a query, far fewer than the pairs that share a token.
    shared = weights.join(queries, "id").select(F.col("id").alias("q"), "token").join(weights.join(base, "id").select(F.col("id").alias("b"), "token"), "token").select("q", "b").distinct().count()
    one_block = block_max_pairs(weights, queries, base, 2).count()
    assert one_block <= 2 * len(q) < shared / 10


def test_a_query_meets_large_blocks(spark):
    """Fifteen hundred base rows are one visit: k rows a query leave it, and nothing is written
    for each small block of base rows."""
    rng = np.random.default_rng(6)
    cells = [(i, f"t{j}", float(w)) for i in range(1520) for j, w in enumerate(rng.random(3) / 2)]
    weights = spark.createDataFrame(cells, "id bigint, token string, weight double")
    ids = spark.range(1520)
    assert block_max_pairs(weights, ids.where("id >= 1500"), ids.where("id < 1500"), 3).count() == 60


def test_a_query_travels_once_to_each_pack(spark):
    """Cells share packs, so that queries are copied for each pack and not for each cell."""
    first, pieces, packs = _packs([4, 25, 3, 9, 2], [2, 0, 1, 3, 4], 10)
    assert (first.tolist(), pieces.tolist(), packs) == ([0, 1, 0, 4, 5], [1, 3, 1, 1, 1], 6)
    rng = np.random.default_rng(7)
    base, queries = rng.normal(size=(900, 8)), rng.normal(size=(50, 8))
    b = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(base)], "id bigint, val array<double>, label string")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "id bigint, val array<double>")
    out = knn_join(q, b, 5, dim=8, pivots=30, block_rows=30).orderBy("query_id", "rank").collect()
    assert [r["neighbor_id"] for r in out] == brute(queries, base, np.arange(900), 5)[0].ravel().tolist()


def test_visits_come_in_rounds_of_bounded_copies(spark, monkeypatch):
    """Many blocks: the parts of the queries take turns, and the pairs are those of one round."""
    from orderlark.operators import text_neighbors as t

    assert t._rounds(2, 16, 32) == [(0, 16)]
    assert t._rounds(115, 38, 32) == [(i, i + 1) for i in range(38)]
    # Where more visits are wanted, the larger side is cut, so that the smaller one is copied.
    assert t._cut((10_000, 3_000_000, 1), (30_000, 9_000_000, 2)) == (10, 4)
    assert t._cut((20, 60, 1), (1500, 4500, 1)) == (1, 1)
    assert t._rounds(20, 5, 32) == [(0, 2), (2, 4), (4, 5)]
    rng = np.random.default_rng(8)
    cells = [(i, int(j), float(w)) for i in range(90) for j, w in zip(rng.choice(12, 3, replace=False), rng.random(3) / 2)]
    weights = spark.createDataFrame(cells, "id bigint, token bigint, weight double")
    ids = spark.range(90)
    queries, base = ids.where("id % 3 = 0"), ids.where("id % 3 > 0").withColumn("label", F.lit("x"))

    def run():
        return sorted(tuple(r) for r in sparse_knn(weights, queries, base, 4, block_rows=10).select("query_id", "neighbor_id", "rank").collect())

    monkeypatch.setattr(t, "QUERY_ROWS", 5)
    one = run()
    asked = []
    monkeypatch.setattr(t, "_rounds", lambda blocks, parts, least: asked.append(parts) or [(i, i + 1) for i in range(parts)])
    assert run() == one and len(one) == 120 and asked[0] > 1


def test_numbered_tokens_are_not_numbered_again(spark):
    from orderlark.operators.text_neighbors import numbered
    from orderlark.operators.tfidf import tfidf

    rows = spark.createDataFrame([(1, "aa bb bb"), (2, "aa cc"), (3, None)], "id bigint, text string")
    named = {(r["id"], r["token"]): r["weight"] for r in tfidf(rows, "id", "text", F.lit(True)).collect()}
    coded = tfidf(rows, "id", "text", F.lit(True), numbered=True)
    assert sorted(r["weight"] for r in coded.collect()) == sorted(named.values())
    assert coded.select("token").distinct().count() == 3
    assert numbered(coded).columns == ["id", "code", "weight"]
    assert "Join" not in numbered(spark.createDataFrame([(1, 5, 1.0)], "id bigint, token bigint, weight double"))._jdf.queryExecution().toString()
