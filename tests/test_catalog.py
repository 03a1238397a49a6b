"""Registered queries next to their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from windrow import catalog  # noqa: E402
from check_queries import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = [
    "mobility_index", "room_biomarkers", "transition_any_zones", "window_index_partial", "point_in_window", "audio_windows", "event_phase_labels", "phase_summary",
    "phase_metric_long", "recovery_metrics", "resilience_overlay", "state_runs", "smooth_states", "merged_table", "describe_groups", "bh_adjust", "probe_shape", "twin_frames",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, connection, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    cursor = connection.execute(entry.oracle_sql()[name])
    assert got == rows_of(cursor.fetchall(), [d[0] for d in cursor.description]) and got[0]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, sql = catalog.QUERIES, catalog.ORACLES
    assert len(queries) > 100
    assert set(queries) - set(sql) == {"hmm_states", "gmm_states"}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "window_id"
