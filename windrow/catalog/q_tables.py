"""Joins, guards, summaries and exports over the tables as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.settings import PHASES
from windrow.operators import diagnostics as dg, merge as mg, quantiles as qt, stats as st, timeline as tl
from windrow.operators.ordered import join_same, time_axis

_H = f"WITH {tb.HOURS}"


@query("left_merge_dedupe", """WITH r AS (SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1)
SELECT o.o_orderkey AS window_id, o.o_orderstatus AS status, r.l_partkey, round(r.l_quantity, 6) AS quantity FROM orders o LEFT JOIN r ON r.l_orderkey = o.o_orderkey""")
def left_merge_dedupe(spark, sf):
    """Left join against the first row per key of a table with repeated keys."""
    left = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("window_id"), F.col("o_orderstatus").alias("status"))
    right = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("window_id"), "l_partkey", F.col("l_quantity").alias("quantity"), "l_shipdate", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("status")
    )
    df = mg.left_merge(left, right, ["window_id"], "_right", [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")])
    return rounded(df.select("window_id", "status", "l_partkey", "quantity"))


@query("null_safe_keys", """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s FROM orders),
b AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT a.o_orderkey, b.n FROM a LEFT JOIN b ON a.s IS NOT DISTINCT FROM b.s""")
def null_safe_keys(spark, sf):
    """A missing key matches a missing key."""
    orders = tb.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"))
    return join_same(orders, st.count_by(orders, "s"), ["s"]).select("o_orderkey", "n")


@query("outer_metadata", """WITH a AS (SELECT c_custkey AS window_id, c_nationkey AS media_id FROM customer WHERE c_acctbal > 3000),
b AS (SELECT o_custkey AS window_id, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT window_id, CAST(media_id AS BIGINT) AS media_id, n_orders, n_name FROM a FULL JOIN b USING (window_id) LEFT JOIN nation ON n_nationkey = media_id""")
def outer_metadata(spark, sf):
    selected = tb.table(spark, sf, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("window_id"), F.col("c_nationkey").alias("media_id"))
    index = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("window_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    manifest = tb.table(spark, sf, "nation").select(F.col("n_nationkey").alias("media_id"), "n_name")
    return rounded(mg.outer_metadata(selected, index, manifest).select("window_id", "media_id", "n_orders", "n_name"))



@query("fallback_join", """WITH b AS (SELECT o_custkey, min(o_orderdate) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT o.o_orderkey, round(b.v, 6) AS v FROM orders o LEFT JOIN b ON b.o_custkey = o.o_custkey AND b.d = o.o_orderdate""")
def fallback_join(spark, sf):
    """The first key pair matches nothing anywhere, so the second one is used."""
    orders = tb.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("room"), F.col("o_orderdate").alias("at"), F.concat(F.lit("x"), F.col("o_orderkey")).alias("wid"))
    right = orders.groupBy("room").agg(F.min("at").alias("at"), F.min("wid").alias("any"))
    prices = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("room")).agg(F.avg("o_totalprice").alias("v"))
    right = right.join(prices, "room").select("room", "at", "v", F.concat(F.lit("y"), "any").alias("wid"))
    df = mg.join_with_fallback(orders, right, ["wid"], ["room", "at"], "v", [F.col("v").asc_nulls_last()])
    return rounded(df.select("o_orderkey", "v"))


@query("fallback_unused", """WITH b AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT c_custkey, round(b.v, 6) AS v FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def fallback_unused(spark, sf):
    """The first key matches some rows, so unmatched rows stay empty."""
    customers = tb.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("wid"), F.col("c_nationkey").cast("bigint").alias("room"))
    right = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("wid")).agg(F.avg("o_totalprice").alias("v"))
    right = right.withColumn("room", F.col("wid") % 25)
    return rounded(mg.join_with_fallback(customers, right, ["wid"], ["room"], "v", [F.col("wid")]).select("c_custkey", "v"))


@query("validated_join", "SELECT c_custkey AS key, c_name AS name, n.total, n.orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def validated_join(spark, sf):
    """Customers and their order totals, one row each by a check inside the join."""
    totals = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    customers = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return rounded(mg.join_one_to_one(customers, totals, ["key"]))


@query("inner_override", f"""WITH {tb.HOURS},
b AS (SELECT window_id, min(room_id) AS room_id, min(session_id) AS session_id, min(start_us) + 1 AS start_us FROM hw WHERE n_rows > 1 GROUP BY 1)
SELECT window_id, b.room_id || '!' AS room_id, b.session_id, b.start_us, round(hw.activity_mean, 6) AS activity_mean FROM hw JOIN b USING (window_id)""")
def inner_override(spark, sf):
    """Windows that the other table knows, with its room, session and start."""
    hours = tb.hour_windows(spark, sf)
    other = hours.filter("n_rows > 1").select("window_id", F.concat("room_id", F.lit("!")).alias("room_id"), "session_id", (F.col("start_us") + 1).alias("start_us"))
    other = other.unionByName(other.withColumn("room_id", F.concat("room_id", F.lit("?"))))  # the later row of a key is not used
    mine = hours.select("window_id", "room_id", "session_id", "start_us", "activity_mean")
    return rounded(mg.inner_override(mine, other, "window_id", ["room_id", "session_id", "start_us"], [F.col("room_id")]))


@query("matrix_pivots", f"""WITH {tb.LABELLED},
long AS (SELECT event_phase, unnest(['activity_mean', 'k_mean']) AS metric, unnest([activity_mean, k_mean]) AS value FROM lab WHERE event_id IS NOT NULL),
ph AS (SELECT * FROM (VALUES (0, 'pre_entry_baseline'), (1, 'during_entry'), (2, 'post_entry_recovery'), (3, 'not_a_phase')) v(position, phase))
SELECT CAST(position AS BIGINT) AS position, phase, round(avg(value) FILTER (metric = 'activity_mean'), 6) AS activity_mean, round(avg(value) FILTER (metric = 'k_mean'), 6) AS k_mean
FROM ph LEFT JOIN long ON event_phase = phase GROUP BY 1, 2""")
def matrix_pivots(spark, sf):
    """Phase by metric in a fixed order of rows, present or not."""
    labelled = tb.labelled_hours(spark, sf).filter("event_id IS NOT NULL")
    long = qt.long_values(labelled, ["event_phase"], ["activity_mean", "k_mean"]).groupBy(F.col("event_phase").alias("phase"), "metric").agg(F.avg("value").alias("value"))
    return rounded(st.matrix(long, "phase", [*PHASES, "not_a_phase"], "metric", ["activity_mean", "k_mean"], "value"))


@query("semi_pending", "SELECT o_orderkey AS window_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_pending(spark, sf):
    done = tb.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("window_id"))
    return mg.reusable(tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("window_id")), done)


@query("anti_completed", "SELECT o_orderkey AS window_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_completed(spark, sf):
    done = tb.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("window_id"))
    return mg.pending(tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("window_id")), done)


@query("having_complete", "SELECT l_orderkey AS window_id, count(DISTINCT l_returnflag) AS zones FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 3")
def having_complete(spark, sf):
    return mg.completed_windows(tb.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("window_id"), F.col("l_returnflag").alias("zone_id")), 3)


@query("lookup_default", "SELECT o_orderkey, coalesce(c_mktsegment, 'unlabeled_state') AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def lookup_default(spark, sf):
    labels = tb.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("state_id"), F.col("c_mktsegment").alias("label"))
    df = tb.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("state_id"))
    return mg.lookup(df, labels, "state_id", "label", "unlabeled_state").select("o_orderkey", "label")


@query("union_failed", """WITH a AS (SELECT 'text' AS stage, CAST(doc_id AS VARCHAR) AS window_id, source AS media_id, lang AS room_id, 'short_text' AS issue FROM documents WHERE n_chars < 400),
b AS (SELECT 'label' AS stage, CAST(doc_id AS VARCHAR) AS window_id, CAST(toxic AS VARCHAR) AS media_id, '' AS room_id, 'low_quality' AS issue FROM labels WHERE quality = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY stage, window_id, issue ORDER BY media_id, room_id) = 1""")
def union_failed(spark, sf):
    a = tb.table(spark, sf, "documents").filter("n_chars < 400").selectExpr("'text' stage", "cast(doc_id as string) window_id", "source media_id", "lang room_id", "'short_text' issue")
    b = tb.table(spark, sf, "labels").filter("quality = 0").selectExpr("'label' stage", "cast(doc_id as string) window_id", "cast(toxic as string) media_id", "'' room_id", "'low_quality' issue")
    return mg.combine_failed(a, b, a)


@query("merge_warning_texts", """WITH t AS (SELECT doc_id, coalesce(source, '') || ';' || lang AS a, lang || '; ' || coalesce(CAST(quality AS VARCHAR), 'nan') AS b FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, array_to_string(list_transform(list_filter(list_distinct_ordered, lambda x: x.t <> ''), lambda x: x.t), ';') AS warnings FROM (
  SELECT doc_id, list_sort(list({'p': p, 't': t})) AS list_distinct_ordered FROM (
    SELECT doc_id, t, min(p) AS p FROM (SELECT doc_id, trim(unnest(string_split(a || ';' || b, ';'))) AS t, generate_subscripts(string_split(a || ';' || b, ';'), 1) AS p FROM t) GROUP BY 1, 2) GROUP BY 1)""")
def merge_warning_texts(spark, sf):
    """Token lists of two columns merged in first-seen order."""
    from windrow.functions.text import combine_warnings

    docs = tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels"), "doc_id", "left")
    a = F.concat(F.col("source"), F.lit(";"), F.col("lang"))
    b = F.concat(F.col("lang"), F.lit("; "), F.coalesce(F.col("quality").cast("string"), F.lit("nan")))
    return docs.select("doc_id", combine_warnings(a, b).alias("warnings"))


@query("describe_exact", """WITH v AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)
SELECT metric, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM v GROUP BY 1""")
def describe_exact(spark, sf):
    return rounded(qt.describe(tb.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("describe_groups", """SELECT l_returnflag, l_linestatus, 'l_extendedprice' AS metric, count(*) AS count, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(max(l_extendedprice), 6) AS max FROM lineitem GROUP BY 1, 2""")
def describe_groups(spark, sf):
    return rounded(qt.describe(tb.table(spark, sf, "lineitem"), ["l_extendedprice"], ["l_returnflag", "l_linestatus"]))


@query("column_medians", """SELECT 'value' AS metric, round(median(value), 6) AS median FROM events UNION ALL SELECT 'event_id', round(median(CAST(event_id AS DOUBLE)), 6) FROM events""")
def column_medians(spark, sf):
    return rounded(qt.column_medians(tb.table(spark, sf, "events"), ["value", "event_id"]))


@query("missingness_long", """SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL
SELECT 'quality', count(*) FILTER (quality IS NULL) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM documents LEFT JOIN labels USING (doc_id)""")
def missingness_long(spark, sf):
    docs = tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels"), "doc_id", "left")
    return st.missing_counts(docs, ["doc_id", "lang", "quality", "toxic"])


@query("coverage_pct", """SELECT count(*) AS rows, round(100.0 * avg(CAST(coalesce(quality = 1, false) AS INT)), 6) AS good, round(100.0 * avg(CAST(toxic IS NOT NULL AS INT)), 6) AS labelled FROM documents LEFT JOIN labels USING (doc_id)""")
def coverage_pct(spark, sf):
    docs = tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels"), "doc_id", "left")
    return rounded(st.coverage(docs, {"good": F.col("quality") == 1, "labelled": F.col("toxic").isNotNull()}))


@query("token_frequency", """SELECT token, count(*) AS n FROM (SELECT trim(unnest(string_split(text, ' ')), ' ') AS token FROM documents) WHERE token <> '' GROUP BY 1""")
def token_frequency(spark, sf):
    """Token counts over whole texts."""
    return st.token_counts(tb.table(spark, sf, "documents"), "text", " ")


@query("count_by_missing", """SELECT quality, toxic, count(*) AS n FROM (SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2""")
def count_by_missing(spark, sf):
    docs = tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels"), "doc_id", "left")
    return rounded(st.count_by(docs, "quality", "toxic"))


@query("session_coverage", _H + """ SELECT room_id, session_id, min(window_id) AS start_time_min, max(window_id) AS end_time_max, count(*) AS window_count FROM hw GROUP BY 1, 2""")
def session_coverage(spark, sf):
    df = tb.hour_windows(spark, sf).withColumns({"start_time": F.col("window_id"), "end_time": F.col("window_id")})
    return st.session_coverage(df)


@query("zone_stats", f"""WITH {tb.ZONE_ROWS} SELECT zone_id, count(activity_mean) AS count, round(avg(activity_mean), 6) AS mean, round(stddev_samp(activity_mean), 6) AS std, round(max(activity_mean), 6) AS max FROM zr GROUP BY 1""")
def zone_stats(spark, sf):
    return rounded(st.zone_stats(tb.zone_rows(spark, sf)))


@query("duplicate_keys", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return rounded(dg.duplicate_keys(tb.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("sequence_diagnostics", """WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS room_id, CAST(l_linenumber AS VARCHAR) AS window_id, l_shipdate AS start_time, l_returnflag AS state_id FROM lineitem),
a AS (SELECT sum(n) FILTER (n > 1) AS d, count(*) FILTER (k > 1) AS m, count(*) AS u FROM (SELECT count(*) AS n, count(DISTINCT state_id) AS k FROM s GROUP BY room_id, window_id)),
b AS (SELECT sum(n) FILTER (n > 1) AS d, count(*) FILTER (k > 1) AS m, count(*) AS u FROM (SELECT count(*) AS n, count(DISTINCT state_id) AS k FROM s GROUP BY room_id, start_time))
SELECT (SELECT count(*) FROM s) AS row_count, (SELECT count(DISTINCT room_id) FROM s) AS unique_room_count, (SELECT count(DISTINCT window_id) FROM s) AS unique_window_count,
CAST(a.d AS BIGINT) AS duplicate_room_window_rows, a.m AS multi_state_room_window_groups, a.u AS unique_room_window_count, CAST(b.d AS BIGINT) AS duplicate_start_time_rows, b.m AS multi_state_start_time_groups, b.u AS unique_start_time_count,
a.d IS NULL AND b.d IS NULL AND b.m = 0 AS is_valid_temporal_sequence FROM a, b""")
def sequence_diagnostics(spark, sf):
    df = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("room_id"), F.col("l_linenumber").cast("string").alias("window_id"), F.col("l_shipdate").alias("start_time"), F.col("l_returnflag").alias("state_id")
    )
    return dg.sequence_diagnostics(df)


@query("sequence_summary", _H + " SELECT room_id, session_id, count(*) AS row_count, count(DISTINCT window_id) AS unique_windows, min(window_id) AS start_time_min, max(window_id) AS start_time_max FROM hw GROUP BY 1, 2")
def sequence_summary(spark, sf):
    return dg.sequence_summary(tb.hour_windows(spark, sf).withColumn("start_time", F.col("window_id")))


_P = """WITH c AS (SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(1 - abs(corr(l_quantity, l_extendedprice)), 9) END AS p FROM lineitem GROUP BY 1),
q AS (SELECT *, CASE WHEN isnan(p) THEN NULL ELSE p END AS pv FROM c)"""


@query("bh_adjust", _P + """,
r AS (SELECT l_orderkey, pv, pv * count(pv) OVER () / row_number() OVER (ORDER BY pv, l_orderkey) AS raw FROM q WHERE pv IS NOT NULL),
a AS (SELECT l_orderkey, least(greatest(min(raw) OVER (ORDER BY pv, l_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 1) AS adj FROM r)
SELECT q.l_orderkey, round(q.pv, 6) AS p, round(a.adj, 6) AS p_adjusted FROM q LEFT JOIN a USING (l_orderkey)""")
def bh_adjust(spark, sf):
    """False-discovery adjustment over one score per order; no task sees the whole column."""
    lines = tb.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), st.correlation("l_quantity", "l_extendedprice").alias("r"))
    p = F.when(F.col("n") >= 3, F.round(1 - F.abs("r"), 9))
    df = lines.select("l_orderkey", p.alias("p"))
    return rounded(st.with_benjamini_hochberg(df, "p", "p_adjusted", ["l_orderkey"]))


@query("pivot_zone_time", f"""WITH {tb.ZONE_ROWS} SELECT window_id, {', '.join(f"round(avg(activity_mean) FILTER (zone_id = '{z}'), 6) AS {z}" for z in tb.ZONES)} FROM zr GROUP BY 1""")
def pivot_zone_time(spark, sf):
    return rounded(tl.timeline_pivot(tb.zone_rows(spark, sf), tb.ZONES, ["window_id"]))


_GRID = f"""WITH {tb.ZONE_ROWS}, z AS (SELECT unnest({tb.ZONES}) AS zone_id, unnest([0, 0, 1, 1, 2]) AS row, unnest([0, 1, 0, 1, 0]) AS col),
mm AS (SELECT min(activity_mean) AS lo, max(activity_mean) AS hi FROM zr), w AS (SELECT DISTINCT window_id, start_us FROM zr)"""


@query("timeline_zones", _GRID + """
SELECT w.window_id, CAST(row_number() OVER (PARTITION BY w.window_id ORDER BY z.row, z.col) - 1 AS BIGINT) AS place, z.zone_id, round((zr.activity_mean - lo) / (hi - lo), 6) AS activity, round(zr.activity_mean, 6) AS activity_raw
FROM w CROSS JOIN z CROSS JOIN mm LEFT JOIN zr ON zr.window_id = w.window_id AND zr.zone_id = z.zone_id""")
def timeline_zones(spark, sf):
    """Timeline frames opened up again: every configured zone in its place, scaled over the whole table."""
    frames = tl.grid_timeline(tb.zone_rows(spark, sf), _layout(spark))
    df = frames.select("window_id", F.posexplode("zones").alias("place", "z"))
    return rounded(df.select("window_id", "place", "z.zone_id", "z.activity", "z.activity_raw"))


def _layout(spark):
    return spark.createDataFrame([(z, i // 2, i % 2) for i, z in enumerate(tb.ZONES)], "zone_id string, row int, col int")


@query("timeline_json", _GRID + ", k AS (SELECT window_id, count(*) AS n FROM zr GROUP BY 1) SELECT window_id, 5 AS zones, 5 - n AS empty_zones FROM k")
def timeline_json(spark, sf):
    """JSON text per frame; nulls are written out, so empty zones can be counted in it."""
    lines = tl.to_json_lines(tl.grid_timeline(tb.zone_rows(spark, sf), _layout(spark)))
    back = F.from_json("value", "struct<window_id: string, zones: array<struct<zone_id: string>>>")
    empty = F.regexp_count("value", F.lit('"activity_raw":null'))
    return rounded(lines.select(back["window_id"].alias("window_id"), F.size(back["zones"]).alias("zones"), empty.alias("empty_zones")))


@query("twin_frames", f"""WITH {tb.ZONE_ROWS}, mm AS (SELECT min(activity_mean) AS lo, max(activity_mean) AS hi FROM zr),
w AS (SELECT window_id, room_id, start_us, avg(activity_mean) AS am, count(*) AS nz, max(activity_mean) AS mx FROM zr GROUP BY ALL)
SELECT row_number() OVER (ORDER BY start_us, window_id) - 1 AS frame_index, window_id, round(am, 6) AS activity_mean, CASE WHEN am < 25 THEN 0 WHEN am < 70 THEN 1 ELSE 2 END AS state_id,
       nz AS zones, round((mx - lo) / (hi - lo), 6) AS top_overlay, 'normal' AS event_phase FROM w, mm""")
def twin_frames(spark, sf):
    """Twin frames numbered in time order over the whole table, with zone and state parts."""
    zones = tb.zone_rows(spark, sf)
    windows = zones.groupBy("window_id", "room_id", "start_us").agg(F.avg("activity_mean").alias("activity_mean"))
    states = windows.select("window_id", "room_id", tb.state_of(F.col("activity_mean")).alias("state_id"))
    frames = tl.twin_timeline(zones, windows, states, time_axis((), "start_us", "window_id"))
    top = F.array_max(F.transform("zones", lambda z: z["overlay_intensity"]))
    return rounded(frames.select("frame_index", "window_id", "metrics.activity_mean", "state.state_id", F.size("zones").alias("zones"), top.alias("top_overlay"), "event.event_phase"))


@query("first_warning", f"""WITH {tb.SEMANTIC_ROWS},
x AS (SELECT room_id, start_us, zone_id, CASE WHEN activity_mean < 2 THEN 'no_interval_overlap' WHEN activity_mean > 200 THEN 'loud;no_interval_overlap' END AS w FROM sq)
SELECT r.room_id, f.w AS warnings FROM (SELECT DISTINCT room_id FROM x) r LEFT JOIN (SELECT room_id, w FROM x WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY start_us, zone_id) = 1) f USING (room_id)""")
def first_warning(spark, sf):
    return st.first_warning(tb.semantic_rows(spark, sf), ["room_id"], ["start_us", "zone_id"])


@query("source_summary", f"""WITH {tb.ZONE_ROWS}, {tb.SLOTS1}
SELECT (SELECT count(*) FROM zr) AS feature_rows, (SELECT count(DISTINCT window_id) FROM zr) AS feature_windows, (SELECT count(DISTINCT room_id) FROM zr) AS feature_media, (SELECT min(session_id) FROM zr) AS first_start,
(SELECT max(session_id) FROM zr) AS last_start, (SELECT count(DISTINCT window_id) FROM slots1) AS index_rows, (SELECT count(DISTINCT window_id) FROM slots1) AS index_windows,
round(100.0 * (SELECT count(DISTINCT window_id) FROM zr) / (SELECT count(DISTINCT window_id) FROM slots1), 6) AS covered_pct""")
def source_summary(spark, sf):
    features = tb.zone_rows(spark, sf).withColumns({"media_id": F.col("room_id"), "start_time": F.col("session_id")})
    return rounded(st.source_summary(features, tb.hour_windows(spark, sf)))


@query("sequence_counts_by_zone", f"""WITH {tb.ZONE_ROWS} SELECT zone_id, session_id, count(*) AS n FROM zr GROUP BY 1, 2""")
def sequence_counts_by_zone(spark, sf):
    return st.count_by(tb.zone_rows(spark, sf), "zone_id", "session_id")


@query("cache_pending", """SELECT o_orderkey AS media_id FROM orders WHERE o_orderstatus = 'P' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def cache_pending(spark, sf):
    """Recordings whose cached fingerprint differs (changed status) or is absent."""
    from windrow.sources.cache import fingerprint, split_by_cache

    orders = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("media_id"), "o_orderstatus", "o_totalprice")
    now = orders.select("media_id", fingerprint({"status": F.col("o_orderstatus"), "price": F.col("o_totalprice")}).alias("fingerprint"))
    old_status = F.when(F.col("o_orderstatus") == "P", F.lit("O")).otherwise(F.col("o_orderstatus"))
    measured = tb.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("media_id")).distinct()
    cached = orders.select("media_id", fingerprint({"status": old_status, "price": F.col("o_totalprice")}).alias("fingerprint")).join(measured, "media_id", "left_semi")
    return split_by_cache(now, cached)[0].select("media_id")
