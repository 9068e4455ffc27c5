"""Every query that SQL can express gives the rows of its DuckDB counterpart."""

import __spark_entry__ as entry
import pytest
from conftest import SF_SMALL
from oracle import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_registry():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 120


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


# At the smallest scale no customer of these gets past the gate or the length.
MAY_BE_EMPTY = {"P9_turn_filter"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    found = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert found is None or (found == "both empty" and name in MAY_BE_EMPTY)


SPREAD = [
    "A3_entity_features",
    "A4_interaction_features",
    "A11_emotion_trend",
    "A12_speaker_texts",
    "A13_labelled_dialogue",
    "A14_taxonomy",
    "E1_roc_auc",
    "J3_order_inventory",
    "J5_customer_lookup",
    "J7_orders_with_reviews",
    "J8_meaningless_anti_join",
    "T1_tfidf",
    "W11_events_targets",
    "W13_transcript_end_fill",
    "W14_merge_turns",
    "W16_order_snapshots_long",
    "W17_priority_score",
    "W18_top_products_per_customer",
    "X1_events_clock_split",
    "X2_stratified_split",
]


@pytest.mark.parametrize("name", SPREAD)
def test_matches_sql_with_heavy_keys(spark, con, forced_skew, name):
    assert compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name]) is None
