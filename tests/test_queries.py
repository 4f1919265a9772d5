"""Registered queries against their SQL in DuckDB on the smallest tables.

By default one query of every family; TIDEWATCH_ALL=1 runs all of them.
"""

import os

import pytest
from check_queries import check, duck

from tidewatch.plans import ORACLES, QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"
FAST = ["cycle_series", "score_runs", "trend_alarm", "run_rows", "cell_summary", "comparator_matching", "multiplicity_adjustment", "bootstrap_mean",
        "permutation_heterogeneity", "win_probability", "floor_crossings", "lagging_pick", "team_pairs", "components", "pathway_reach", "dual_stream",
        "mnar_mask", "two_stream_alarm", "recovery_fit", "table_difference", "stream_cycle_means", "stream_revocation"]


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("TIDEWATCH_ALL") else FAST)
def test_query_matches_sql(spark, name):
    ok, text = check(spark, duck(SF), name, SF)
    assert ok, text


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100
