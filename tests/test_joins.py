"""Checked joins, matrices and the time tree against plain loops."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from windrow.operators import merge as mg, stats as st, timetree as tt


def test_one_to_one_join_raises_on_either_side(spark):
    left = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), (None, 3, 3.0)], "k string, j int, v double")
    right = spark.createDataFrame([("a", 1, 9.0), (None, 3, 8.0), ("z", 0, 7.0)], "k string, j int, v double")
    got = sorted(map(str, (tuple(r) for r in mg.join_one_to_one(left, right, ["k", "j"]).collect())))
    assert got == sorted(map(str, [("a", 1, 1.0, 9.0), ("b", 2, 2.0, None), (None, 3, 3.0, 8.0)]))
    plan = mg.join_one_to_one(left, right, ["k", "j"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    for one, two, side in ((left.union(left.limit(1)), right, "left"), (left, right.union(right.filter("k IS NULL")), "right")):
        with pytest.raises(PySparkException, match=f"{side} side has more than one row"):
            mg.join_one_to_one(one, two, ["k", "j"]).collect()


def test_override_and_matrix(spark):
    left = spark.createDataFrame([("w1", "r", 1.0), ("w1", "r", 2.0), ("w2", "r", 3.0), ("w3", "r", 4.0)], "window_id string, room_id string, v double")
    right = spark.createDataFrame([("w1", "x"), ("w1", "y"), ("w3", None), ("w9", "z")], "window_id string, room_id string")
    got = {r["window_id"]: (r["room_id"], r["v"]) for r in mg.inner_override(left, right, "window_id", ["room_id"], [F.desc("room_id")]).collect()}
    assert got == {"w1": ("y", 1.0), "w3": (None, 4.0)}
    long = spark.createDataFrame([("b", "m", 1.0), ("a", "n", 2.0), ("c", "m", 5.0)], "row string, col string, v double")
    assert [tuple(r) for r in st.matrix(long, "row", ["b", "x", "a"], "col", ["n", "m"], "v").orderBy("position").collect()] == [(0, "b", None, 1.0), (1, "x", None, None), (2, "a", 2.0, None)]


def test_fallback_keeps_one_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, j int")
    right = spark.createDataFrame([("a", 2, 5.0), ("x", 1, 6.0)], "k string, j int, v double")
    first = mg.join_with_fallback(left, right, ["k"], ["j"], "v", [F.col("v")])
    assert {r["k"]: r["v"] for r in first.collect()} == {"a": 5.0, "b": None}
    second = mg.join_with_fallback(left, right.filter("k = 'x'"), ["k"], ["j"], "v", [F.col("v")])
    assert {r["k"]: r["v"] for r in second.collect()} == {"a": 6.0, "b": None}
    assert all(f._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 for f in (first, second))


def test_time_tree(spark):
    draw = random.Random(3)
    place = lambda: draw.choice([draw.randrange(-40, 400), draw.randrange(10**13), 10**13 + draw.randrange(50)])
    events = []
    for i in range(70):
        lo = place()
        events.append((lo, lo + draw.choice([0, 1, 15, 16, 300, 10**7, 3 * 16**10, -5]), i))
    spans = [(i, lo := place(), lo + draw.choice([0, 7, 255, 10**12, -1])) for i in range(80)]
    ev = spark.createDataFrame(events, "lo long, hi long, seq int")
    sp = spark.createDataFrame(spans, "id int, a long, b long")
    got = {r["a"]: r["seq"] for r in tt.least_at(sp, "a", ev, F.col("lo"), F.col("hi"), "seq").collect()}
    assert got == {a: min(s for lo, hi, s in events if lo <= a <= hi) for _, a, _ in spans if any(lo <= a <= hi for lo, hi, _ in events)}
    got = {r["id"]: r["seq"] for r in tt.least_meeting(sp, ["id"], F.col("a"), F.col("b"), ev, F.col("lo"), F.col("hi"), "seq").collect()}
    meets = {i: [s for lo, hi, s in events if lo <= hi and a <= b and lo <= b and hi >= a] for i, a, b in spans}
    assert got == {i: min(m) for i, m in meets.items() if m}
    sizes = ev.filter("lo <= hi").select(F.size(tt.covering(F.col("lo"), F.col("hi"))).alias("n"), "lo", "hi", tt.covering(F.col("lo"), F.col("hi")).alias("c")).collect()
    assert max(r["n"] for r in sizes) <= 30 * 10 + 4
    assert all(sum(16 ** n["level"] for n in r["c"]) == r["hi"] - r["lo"] + 1 for r in sizes)
