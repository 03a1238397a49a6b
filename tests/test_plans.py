"""Shape of executed plans: what is read and shuffled, counted as tools/plan_shape.py does."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from plan_shape import PATTERNS  # noqa: E402

from windrow import catalog  # noqa: E402


def shape(spark, name):
    catalog.load()
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    return {k: len(re.findall(p, final)) for k, p in PATTERNS.items()}


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("nearest_event_fallback", 2, 8), ("recovery_metrics", 2, 8), ("resilience_overlay", 3, 8)])
def test_recovery_reads_each_table_once(spark, name, scans, exchanges):
    """The overlay reads the windows once more, for the columns that the rows keep."""
    got = shape(spark, name)
    assert got["scans"] <= scans and got["exchanges"] - got["reused"] <= exchanges and not got["cartesian"] + got["nested_loop"]
