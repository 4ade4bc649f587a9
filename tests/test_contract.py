"""A cross-section of the registered queries against the same question in plain SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from retroscope.sources.readers import TABLES

FOLDER = os.environ.get("RETROSCOPE_DATA", "/root/testdata/sf0.001")
CHECKED = ["reversal_rate_by_domain", "structured_posts", "refined_durations_and_events", "psycholinguistic_scores", "sentiment_of_posts",
           "scored_texts", "comment_threads_from_json", "dedupe_keep_first", "year_status_rates", "price_box_summary", "quintile_rates",
           "event_labels", "coerced_and_filled", "parsed_years", "chi_square_era_by_domain", "two_group_report", "mann_whitney_price", "kaplan_meier_orders", "concordance_posts",
           "log_odds_quality", "tfidf_weights", "cox_score_orders", "bootstrap_means", "bootstrap_correlations", "reversal_rate_intervals", "duration_median_intervals", "auc_interval_posts",
           "kaplan_meier_eras", "logit_score_posts", "logit_slopes_at_estimate", "stated_topics", "sentence_vectors", "emotion_by_model", "nearest_pairs", "stream_window_rates"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{round(v, 5):.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def plain():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_plain_sql(spark, plain, name):
    df = entry.queries()[name](spark, FOLDER)
    found = plain.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), found.columns)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["domain", "rate", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
