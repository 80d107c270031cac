"""Registered queries against their SQL on the smallest tables.

By default one query per operator family runs; ``CANDELA_ALL=1`` runs all.
"""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "a01_resample_1h", "a02_resample_floor_1w", "a04_news_window_stats", "a10_consolidate_settings", "a19_scaler", "a25_source_health",
    "f06_factor_distribution", "f10_lexicon_sentiment_test", "f21_canonical_url", "f30_alert_decision", "f42_novelty",
    "j01_latest_prediction", "j04_articles_for_decisions", "j05_last_closed_bars", "j10_lookup_labels", "j19_nearest_join",
    "m04_ece", "m07_macro_auc", "m13_search_policy", "m25_signal_pnl", "m29_trade_ledger", "m30_equity_curve",
    "o01_top_k_news", "o10_walk_forward", "o12_balanced_batches", "p09_article_quality", "p14_validate_strategies",
    "s05_normalize_klines", "s06_f18_normalize_news", "s10_import_weighted_news", "s17_extract_articles", "t01_stream_klines",
    "t03_stream_news", "t09_stream_candles", "t12_stream_alerts", "w00_technical_indicators", "w03_rsi_ch", "w17_adx_ch", "w19_supertrend",
    "w27_feature_vector", "w33_indicator_flags", "a03_indicator_rows", "a20_apply_bar_scaler", "f19_unwrap_raw", "f23_discover_links",
    "f42_novelty_content", "f37_advice_class", "f38_explanation_text", "a20_bar_scaler", "j06_asof_tail", "m28_barrier_touch", "s07_normalize_insights", "o09_sample_cases", "t07_last_n_state",
)
NAMES = sorted(entry.QUERIES) if os.environ.get("CANDELA_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.compare(df, con, sql) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert "rsi_14" in df.columns and df.count() > 0
