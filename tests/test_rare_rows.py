"""Queries next to their SQL on rows that the small tables lack."""

import itertools
import sys
from datetime import datetime
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import rows_of  # noqa: E402
from windrow.models import hmm  # noqa: E402
from windrow.operators import nearby, windowing as wn  # noqa: E402


def compare(spark, folder, name, exact=False):
    df = entry.queries()[name](spark, str(folder))
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert rows_of(got, df.columns) == rows_of(want, columns) and got
    if exact:  # not a number and null apart
        def text(rows, names):
            return sorted(repr([r[names.index(n)] for n in columns]) for r in rows)

        assert text(got, df.columns) == text(want, columns)


def write(folder, name, sql):
    duckdb.execute(f"COPY ({sql}) TO '{folder / name}.parquet' (FORMAT parquet)")


def quiet_events(folder):
    """Room 1 has a window without activity between two others, room 2 begins with one."""
    rows = [(1, 1, 0, "click", 5.0), (2, 1, 0, "view", 15.0), (3, 1, 7, "error", 0.0), (4, 1, 13, "click", 4.0), (5, 1, 19, "view", 4.0), (6, 2, 1, "view", 0.0), (7, 2, 8, "view", 3.0)]
    values = ", ".join(f"({i}, TIMESTAMP '{datetime(2024, 1, 1, h)}', {u}, '{t}', {v}::DOUBLE, '{{\"k\": {i}}}')" for i, u, h, t, v in rows)
    write(folder, "events", f"SELECT * FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value, props)")


def test_event_from_media_ties(spark, tmp_path):
    write(tmp_path, "orders", "SELECT k AS o_orderkey, k * 10 AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '1995-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM (VALUES (10::BIGINT), (9::BIGINT)) v(k)")
    write(tmp_path, "lineitem", "SELECT 9::BIGINT AS l_orderkey, 40.0::DOUBLE AS l_quantity")
    compare(spark, tmp_path, "event_from_media")


def test_occupancy_imbalance_without_activity(spark, tmp_path):
    quiet_events(tmp_path)
    compare(spark, tmp_path, "occupancy_imbalance", exact=True)


def test_transition_any_zones_without_activity(spark, tmp_path):
    quiet_events(tmp_path)
    compare(spark, tmp_path, "transition_any_zones", exact=True)


def test_room_biomarkers_without_activity(spark, tmp_path):
    quiet_events(tmp_path)
    compare(spark, tmp_path, "room_biomarkers", exact=True)


def parts_of(df):
    return df.rdd.getNumPartitions()


def test_points_spread_by_count(spark):
    points = spark.createDataFrame([("m", float(i)) for i in range(90)], "media_id string, center_sec double")
    media = spark.createDataFrame([("m", 90.0)], "media_id string, duration_seconds double")
    for bounds in ("center", "end", "closed"):
        assert parts_of(wn.aggregate_points(points, media, {"n": F.count(F.lit(1))}, bounds=bounds, rows=2_500_000)) == 10


def test_line_spread_by_count(spark):
    windows = spark.createDataFrame([("1", 0, 10, "w")], "room_id string, start_us bigint, end_us bigint, window_id string")
    events = spark.createDataFrame([("1", 5, 6, "e")], "room_id string, event_start_us bigint, event_end_us bigint, event_id string")
    assert parts_of(nearby._line(windows, events, F.lit(None).cast("double"), 86_400, 1_250_000)) == 10
    assert [r["matched"] for r in nearby.met_or_nearest(events, windows, count=1_250_000).collect()] == ["overlap"]


def many_parts(folder):
    write(folder, "part", "SELECT i AS p_partkey, CAST(i % 50 + 1 AS INT) AS p_size, 900.0 + i / 100 AS p_retailprice FROM range(200000) r(i)")


def test_probe_documents_spread(spark, tmp_path):
    many_parts(tmp_path)
    assert parts_of(entry.queries()["probe_shape"](spark, str(tmp_path))) == 10


def test_manifest_spread(spark, tmp_path):
    many_parts(tmp_path)
    assert parts_of(entry.queries()["manifest_cleaning"](spark, str(tmp_path))) == 10


def test_scan_of_many_sequences_at_once():
    """Sequences of different lengths in one batch: messages and states as of each sequence alone."""
    rng, k = np.random.default_rng(5), 3
    model = hmm.GaussianHmm(np.array([0.5, 0.3, 0.2]), np.full((k, k), 1 / k), np.zeros((k, 1)), np.ones((k, 1)))
    sizes = [2, 5, 3, 2]
    frame = pd.DataFrame({"_seq": list("abcd"), "chunks": [np.arange(n) for n in sizes], "matrix": [rng.random(n * k * k) for n in sizes], "best": [np.log(rng.random(n * k * k)) for n in sizes]})
    got = pd.concat(hmm._scan_sequences(model, True)(iter([frame]))).sort_values(["_seq", "_chunk"])
    assert len(got) == sum(sizes)
    for _, row in frame.iterrows():
        part = got[got["_seq"] == row["_seq"]]
        matrices, best = row["matrix"].reshape(-1, k, k), row["best"].reshape(-1, k, k)
        message = model.start
        for i, m in enumerate(matrices):
            assert np.allclose(part["entry"].iloc[i], message)
            message = message @ m / (message @ m).sum()
        back = np.ones(k)
        for i in range(len(matrices) - 1, -1, -1):
            assert np.allclose(part["exit"].iloc[i], back)
            back = matrices[i] @ back / (matrices[i] @ back).sum()
        paths = list(itertools.product(range(k), repeat=len(best) + 1))
        score = [np.log(model.start[p[0]]) + sum(best[i][p[i], p[i + 1]] for i in range(len(best))) for p in paths]
        path = paths[int(np.argmax(score))]
        assert part["last_state"].tolist() == list(path[1:]) and part["first_state"].tolist() == [-1, *path[1:-1]]
