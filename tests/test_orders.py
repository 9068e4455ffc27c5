"""Hand-made order histories for the edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlark.functions import scoring
from orderlark.operators import prepare, rank, snapshots, splits
from orderlark.operators.pair_features import build_features, feature_columns, latest_features, sequences
from orderlark.sources import tables


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def history(spark, rows):
    """(customer, product, date, quantity) rows; row order is the tie-break."""
    full = [(c, p, d, float(q), float(q) * 2, 0.0, i) for i, (c, p, d, q) in enumerate(rows)]
    schema = "customer_id string, product_id string, date timestamp_ntz, quantity double, sales_value double, discount_pct double, seq int"
    return spark.createDataFrame(full, schema)


def by_seq(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("seq").collect()]


def test_feature_names():
    names = feature_columns(30)
    assert len(names) == 32 and len(set(names)) == 32
    assert "orders_last_45d" in feature_columns(15)


def test_first_gap_feeds_the_means(spark):
    df = build_features(history(spark, [("a", "x", day(0), 1), ("a", "x", day(10), 3)]), targets=False, ties=["seq"])
    rows = by_seq(df, "days_since_last_order", "avg_order_interval", "order_interval_std", "momentum")
    assert rows[0] == (90, 90.0, 0.0, 0.0)
    assert rows[1][:2] == (10, 50.0)
    assert rows[1][2] == pytest.approx(56.568542)
    assert rows[1][3] == pytest.approx(90 / 10.01)


def test_lookback_edge_and_ties(spark):
    rows = [("a", "x", day(0), 1), ("a", "x", day(30), 1), ("a", "x", day(30), 1), ("a", "x", day(61), 1)]
    df = build_features(history(spark, rows), targets=False, ties=["seq"])
    # A row exactly 30 days back counts; of same-day rows only the earlier ones do.
    assert by_seq(df, "orders_last_30d", "orders_last_60d") == [(0, 0), (1, 1), (2, 2), (0, 2)]


def test_clock_times_floor_to_days(spark):
    rows = [("a", "x", day(0, 20), 1), ("a", "x", day(2, 6), 1)]
    assert by_seq(build_features(history(spark, rows), targets=False, ties=["seq"]), "days_since_last_order") == [(90,), (1,)]


def test_targets_and_censoring(spark):
    rows = [
        ("a", "x", day(0), 5),  # next after 40 days: no reorder, no quantity
        ("a", "x", day(40), 6),  # next after exactly 30 days: reorder
        ("a", "x", day(70), 7),  # last, horizon fully seen (100 - 70 = 30): kept as 0
        ("b", "x", day(71), 8),  # last, 29 days seen: dropped
        ("c", "x", day(100), 9),
    ]
    df = build_features(history(spark, rows), ties=["seq"])
    assert by_seq(df, "seq", "will_reorder", "next_order_quantity") == [(0, 0, None), (1, 1, 7.0), (2, 0, None)]


def test_latest_is_last_in_total_order(spark):
    rows = [("a", "x", day(0), 1), ("a", "x", day(5), 2), ("a", "x", day(5), 3), ("b", "x", day(1), 4)]
    assert by_seq(latest_features(history(spark, rows), ties=["seq"]), "seq", "order_count") == [(2, 3), (3, 1)]


def test_filter_on_customer_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "sales.parquet")
    history(spark, [("a", "x", day(i), 1) for i in range(5)]).write.parquet(path)
    out = latest_features(spark.read.parquet(path), ties=["seq"]).where("customer_id = 'a'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(customer_id,a)" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_sequences_need_ten_predecessors(spark):
    rows = [("a", "x", day(i), i) for i in range(1, 13)] + [("b", "x", day(i), 1) for i in range(5)]
    feats = build_features(history(spark, rows + [("z", "x", day(200), 1)]), ties=["seq"])
    out = sequences(feats, ["quantity"], ties=["seq"]).orderBy("seq").collect()
    assert [r["seq"] for r in out] == [10, 11]
    assert out[0]["sequence"] == [[float(i)] for i in range(1, 11)]


def test_prepare_sales(spark):
    schema = "`DATE` string, `Partner Customer Code` string, `Product Code` string, `NetSalesQty` double, `Discount %` double, `Net Sales Value LC` double"
    rows = [
        ("2024-01-01", "c", "p", 2.0, None, None),
        ("2024-01-01", "c", "p", -1.0, 0.1, 1.0),
        ("2024-01-01", "c", "p", None, 0.1, 1.0),
        ("2024-01-01", None, "p", 1.0, 0.1, 1.0),
        ("2024-01-01", "c", "p", float("nan"), 0.1, 1.0),
    ]
    out = prepare.prepare_sales(spark.createDataFrame(rows, schema)).collect()
    assert [(r["quantity"], r["discount_pct"], r["sales_value"]) for r in out] == [(2.0, 0.0, 0.0)]
    assert out[0]["date"] == dt.datetime(2024, 1, 1)


def test_load_sales_checks(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported"):
        tables.load_sales(spark, str(tmp_path / "x.xlsx"))
    path = str(tmp_path / "x.csv")
    spark.createDataFrame([("2024-01-01", 1.0)], "`DATE` string, NetSalesQty double").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="Product Code"):
        tables.load_sales(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.load_features(spark, str(tmp_path), 30)


def test_time_split_positions(spark):
    rows = spark.createDataFrame([(day(i // 4), i) for i in range(40)], "date timestamp_ntz, seq int")
    out = splits.time_based_split(rows, ties=["seq"])
    labels = [r["split"] for r in out.orderBy("seq").collect()]
    assert labels == ["train"] * 25 + ["val"] * 7 + ["test"] * 8
    gapped = splits.time_based_split(rows, gap_days=2, ties=["seq"])
    kept = [(r["seq"], r["split"]) for r in gapped.orderBy("seq").collect()]
    # Eight rows before the test start go; the cut is then taken anew, at row 25 of 32.
    assert [s for s, _ in kept] == [*range(24), *range(32, 40)]
    assert [s for s, x in kept if x == "test"] == [33, 34, 35, 36, 37, 38, 39]
    strict = splits.time_based_split(rows, gap_days=2, ties=["seq"], strict_gap=True)
    assert strict.where("split = 'test'").count() == 8


def test_time_split_of_exact_copies(spark, forced_skew):
    """Copies cannot be told apart, yet the shares come out exact."""
    rows = spark.createDataFrame([(day(0), 1)] * 100, "date timestamp_ntz, seq int")
    counts = {r["split"]: r["count"] for r in splits.time_based_split(rows, ties=["seq"]).groupBy("split").count().collect()}
    assert counts == {"train": 64, "val": 16, "test": 20}


def test_gate_and_priority(spark):
    rows = [("a", "x", 0.9, 10.5), ("a", "y", 0.6, 3.2), ("a", "z", 0.4, 100.0), ("b", "x", 0.1, 1.0)]
    df = spark.createDataFrame(rows, "customer_id string, product_id string, reorder_probability double, predicted_quantity double")
    out = rank.recommend_products(df, 2, 0.5).orderBy("rank").collect()
    # 10.5 rounds to even; the gated-out 100 does not set the scale.
    assert [(r["product_id"], r["predicted_quantity"]) for r in out] == [("x", 10), ("y", 3)]
    assert out[0]["priority_score"] == pytest.approx(0.9 * 0.6 + 10 / 11 * 0.4)
    assert rank.recommend_products(df, 2, 0.99).count() == 0


def test_scoring_expressions(spark):
    row = spark.range(1).select(
        scoring.ensemble({"a": F.lit(0.2), "b": F.lit(None).cast("double")}).alias("one"),
        scoring.ensemble({"a": F.lit(0.2), "b": F.lit(0.6)}).alias("two"),
        scoring.whole_quantity(F.lit(-2.0)).alias("none"),
        scoring.whole_quantity(F.lit(2.5)).alias("even"),
        scoring.suggested_quantity(F.lit(0.2)).alias("least"),
        scoring.finite_or_zero(F.lit(float("inf"))).alias("inf"),
        scoring.finite_or_zero(F.lit(float("nan"))).alias("nan"),
        scoring.service_label(F.lit(None).cast("int")).alias("label"),
    ).first()
    assert row["one"] == pytest.approx(0.2) and row["two"] == pytest.approx(0.4)
    assert (row["none"], row["even"], row["least"], row["inf"], row["nan"]) == (0, 2, 1, 0.0, 0.0)
    assert row["label"] == scoring.POOR_SERVICE


def test_next_quantity_needs_a_second_successor(spark):
    rows = [(1, day(0), 1, 1, 5.0), (2, day(3), 1, 1, 6.0), (3, day(40), 1, 1, 7.0)]
    df = spark.createDataFrame(rows, "order_id int, order_dt timestamp_ntz, customer_id int, sku_id int, qty double")
    out = snapshots.order_history(df, ["order_id"]).orderBy("order_id").collect()
    assert [r["target_qty_next"] for r in out] == [6.0, None, None]
    assert [r["label_reorder_in_N"] for r in out] == [1, 0, 0]
    assert [r["qty_rolling_mean_30"] for r in out] == [5.0, 5.5, 6.0]


def test_ranking_limits_groups_before_the_shuffle(spark):
    rows = [(c, p, 0.9, float(p)) for c in range(3) for p in range(9)]
    df = spark.createDataFrame(rows, "customer_id int, product_id int, reorder_probability double, predicted_quantity double")
    plan = rank.recommend_products(df, 2, 0.5)._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index("Partial"), plan.index("Exchange hashpartitioning(customer_id")
    assert "WindowGroupLimit" in plan and exchange < partial


def test_split_does_not_depend_on_the_session_zone(spark):
    rows = spark.createDataFrame([(day(i, 2), i) for i in range(60, 120)], "date timestamp_ntz, seq int")
    expected = sorted((r["seq"], r["split"]) for r in splits.time_based_split(rows, gap_days=5, ties=["seq"]).collect())
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = sorted((r["seq"], r["split"]) for r in splits.time_based_split(rows, gap_days=5, ties=["seq"]).collect())
        gaps = by_seq(build_features(history(spark, [("a", "x", day(69, 1), 1), ("a", "x", day(70, 2), 1)]), targets=False, ties=["seq"]), "days_since_last_order")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == expected and gaps == [(90,), (1,)]


def test_stratified_split_against_brute_force(spark):
    import hashlib
    import math

    rows = [(i, None if i % 7 == 0 else "big" if i % 5 else "small") for i in range(900)] + [(900, "one"), (901, "two"), (902, "two")]
    parts = [("train", 0.6), ("val", 0.2), ("test", 0.2)]
    out = splits.stratified_split(spark.createDataFrame(rows, "id int, c string"), "c", "id", parts)
    expected = {}
    for c in {x[1] for x in rows}:
        ids = sorted((x[0] for x in rows if x[1] == c), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        a, b = math.floor(len(ids) * 0.6), math.floor(len(ids) * 0.8)
        expected |= {i: "train" if at < a else "val" if at < b else "test" for at, i in enumerate(ids)}
    assert {r["id"]: r["split"] for r in out.collect()} == expected
    every = splits.stratified_split(spark.createDataFrame(rows, "id int, c string"), "c", "id", [("all", 1.0)])
    assert every.where("split = 'all'").count() == len(rows)


def test_interaction_features_move_only_what_is_read(spark, monkeypatch):
    from conftest import SF_SMALL

    from orderlark.operators import entity
    from orderlark.plans.order_queries import ID, a4

    written = []
    monkeypatch.setattr(entity, "stored", lambda df, label: written.append(df.columns) or df)
    assert a4(spark, SF_SMALL).columns[: len(ID)] == ID
    assert set(written[0]) == {*ID, "sales_value", "quantity"}


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time

    from orderlark.session import SWEEP_CONF, stored

    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    time.sleep(1)  # files of earlier queries may still be on their way out
    before = _shuffle_files(spark)
    out = stored(rows.groupBy("k").agg(F.max("id").alias("m")), "swept")
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert out.count() == 7 and spark.conf.get(SWEEP_CONF) == "false"


def test_first_generation_tables_share_one_join_of_lines_and_orders(spark):
    from orderlark.plans.order_queries import _v1

    orders, prices, inventory, _, ties = _v1(spark, "/root/testdata/sf0.001", 25)
    for df in (orders, prices, inventory):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_last_row_of_a_key_in_some_columns(spark):
    rows = spark.createDataFrame([(1, "a", 2, 5.0), (1, "b", 3, 6.0), (2, "c", 1, None)], "k int, other string, seq int, v double")
    out = prepare.last_per_key(rows, ["k"], ["seq"], ["v"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 6.0), (2, None)] and out.columns == ["k", "v"]


def test_packed_csv_holds_the_same_sales(spark, tmp_path):
    import os

    rows = spark.createDataFrame(
        [(day(1), "c1", 'a "b", c', 2.0, 3.5, None), (day(2, 5), None, "p\u00e9", None, 1e-9, 0.1)],
        "DATE timestamp_ntz, `Partner Customer Referans Code` string, `Product Code` string, NetSalesQty double, `Net Sales Value LC` double, `Discount %` double",
    )
    plain, packed = str(tmp_path / "plain.csv"), str(tmp_path / "packed.csv")
    tables.save_csv(rows, plain)
    tables.save_csv(rows, packed, compression="gzip")
    assert all(f.endswith(".csv.gz") for f in os.listdir(packed) if f.startswith("part-"))
    assert sorted(map(repr, tables.load_sales(spark, packed).collect())) == sorted(map(repr, tables.load_sales(spark, plain).collect())) == sorted(map(repr, rows.collect()))
