"""Registered queries against their SQL. Every query with TIDEMARK_ALL=1, otherwise one or two per area."""

import os

import pytest

from tests.compare import compare, connect
from tests.conftest import SMALL

SAMPLE = (
    "bars_hourly resample_h4 m1_orderflow read_bar_csv read_journal_quarantine asof_htf_close enrich_closes match_entities trade_metrics perf_panel ticket_r "
    "external_trades psi quartile_spread kama adx_seeded macd_kama volume_filter_daily day_loss_limit hysteresis_gate pullback_signal triple_barrier signal_outcome "
    "chandelier_stop walk_forward_score plateau_pick best_threshold ml_gate bootstrap_ruin stream_closed_bars stream_regime_gate"
).split()


def names():
    from tidemark.plans import catalog

    return sorted(catalog.SQL) if os.environ.get("TIDEMARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(name, tables, con):
    from tidemark.plans import catalog

    ok, why, _ = compare(catalog.QUERIES[name](tables), con, catalog.SQL[name])
    assert ok, why


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 150"], check=True, timeout=120)
