"""State models over the window biomarkers, and the rules that read them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.functions import arrays
from windrow.models import gmm, hmm, metrics as mm, preprocess as pp, risk as rk
from windrow.models.states import GMM, HMM, fit_states
from windrow.operators import biomarkers as bm
from windrow.operators.ordered import time_axis
from windrow.session import cut_lineage, spread
from windrow.settings import ModelSettings



def _summary_input(spark, sf):
    """One state per event type and hour of the day; indices derived from its readings."""
    df = tb.hour_windows(spark, sf).withColumn("state_id", (F.floor(F.col("start_us") / tb.HOUR_US) % 24).cast("int"))
    return df.withColumns(
        {
            "mobility_index": F.col("activity_mean") / 500, "spatial_freedom_index": F.col("k_mean") / 100,
            "occupancy_imbalance_index": F.abs(F.col("k_mean") - 50) / 80, "normalized_activity": F.least(F.col("activity_mean") / 150, F.lit(1.0)),
            "resilience_pressure_index": F.lit(None).cast("double"), "state_run_length": F.col("n_rows"),
        }
    )


_MEANS = ["mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "activity_mean", "normalized_activity", "resilience_pressure_index"]

_SUM = f"""WITH {tb.HOURS},
s AS (SELECT CAST((start_us // 3600000000) % 24 AS BIGINT) AS state_id, count(*) AS window_count, avg(activity_mean / 500) AS mob, avg(k_mean / 100) AS spa, avg(abs(k_mean - 50) / 80) AS imb, avg(least(activity_mean / 150, 1.0)) AS act, avg(n_rows) AS run,
             avg(activity_mean) AS raw FROM hw GROUP BY 1),
c AS (SELECT *, least(greatest(act, 0), 1) AS c_act, (mob - min(mob) OVER ()) / (max(mob) OVER () - min(mob) OVER ()) AS c_mob, least(imb, 1) AS c_imb, least(greatest(1 - spa, 0), 1) AS c_low, 0.5 AS c_res,
             (run - min(run) OVER ()) / (max(run) OVER () - min(run) OVER ()) AS c_per, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS c_raw, window_count / sum(window_count) OVER () AS frac FROM s),
r AS (SELECT *, (c_act + c_mob) / 2 AS c_am, least(greatest(0.30 * (c_act + c_mob) / 2 + 0.25 * c_imb + 0.20 * c_low + 0.15 * c_res + 0.10 * c_per, 0), 1) AS w FROM c)"""


@query("state_risk_weights", _SUM + """
SELECT state_id, window_count, round(frac, 6) AS window_fraction, round(c_am, 6) AS component_activity_mobility, round(c_per, 6) AS component_persistence, round(w, 6) AS state_risk_weight,
       round(0.35 * c_raw + 0.35 * c_mob + 0.20 * c_imb + 0.10 * c_low, 6) AS context_risk_weight FROM r""")
def state_risk_weights(spark, sf):
    summary = rk.state_summary(_summary_input(spark, sf), _MEANS)
    twin = rk.with_twin_risk(summary).select("state_id", "window_count", "window_fraction", "component_activity_mobility", "component_persistence", "state_risk_weight")
    context = rk.with_context_risk(summary).select("state_id", F.col("state_risk_weight").alias("context_risk_weight"))
    return rounded(twin.join(context, "state_id"))


@query("state_labels", _SUM + """,
l AS (SELECT *, CASE WHEN w >= 0.70 AND c_per >= 0.55 AND (c_am >= 0.50 OR c_imb >= 0.35 OR c_low >= 0.35) THEN 'sustained_deviation'
  WHEN c_am >= 0.60 AND c_res >= 0.45 THEN 'disturbance_or_transition' WHEN c_act <= 0.18 AND c_mob <= 0.25 AND c_imb <= 0.20 THEN 'stable_low_activity'
  WHEN c_act <= 0.22 AND c_imb >= 0.30 AND (c_low >= 0.25 OR spa <= 0.80) THEN 'localized_low_activity_concentration' WHEN c_act >= 0.45 AND c_imb >= 0.30 AND c_low >= 0.25 THEN 'concentrated_high_activity'
  WHEN c_act >= 0.28 AND spa >= 0.65 AND c_imb <= 0.35 THEN 'normal_distributed_activity' WHEN c_act <= 0.25 AND spa >= 0.65 THEN 'distributed_low_activity'
  WHEN c_low >= 0.35 THEN 'localized_activity_shift' ELSE 'mixed_activity_pattern' END AS b FROM r)
SELECT state_id, b || CASE WHEN row_number() OVER (PARTITION BY b ORDER BY state_id) > 1 THEN '_' || state_id ELSE '' END AS state_label FROM l""")
def state_labels(spark, sf):
    summary = rk.with_twin_risk(rk.state_summary(_summary_input(spark, sf), _MEANS))
    return rounded(rk.with_labels(summary, rk.twin_label()).select("state_id", "state_label"))


_SEM = f"""WITH {tb.SEMANTIC_ROWS},
t AS (SELECT *, (start_us // 21600000000) % 4 * 3 + CASE WHEN pd >= pf AND pd >= pg THEN 0 WHEN pf >= pg THEN 1 ELSE 2 END AS state_id, coalesce(0.5 * (abs(pd - lag(pd) OVER o) + abs(pf - lag(pf) OVER o) + abs(pg - lag(pg) OVER o)), 0) AS tr,
             min(activity_mean) OVER (PARTITION BY room_id) AS lo, max(activity_mean) OVER (PARTITION BY room_id) AS hi,
             -((CASE WHEN pd > 0 THEN pd * ln(pd) ELSE 0 END) + (CASE WHEN pf > 0 THEN pf * ln(pf) ELSE 0 END) + (CASE WHEN pg > 0 THEN pg * ln(pg) ELSE 0 END)) / ln(3) AS spa,
             0.5 * (abs(pd - 1.0 / 3) + abs(pf - 1.0 / 3) + abs(pg - 1.0 / 3)) AS imb FROM sp WINDOW o AS (PARTITION BY room_id ORDER BY start_us)),
u AS (SELECT *, CASE WHEN lo = hi THEN CASE WHEN lo = 0 THEN 0.0 ELSE 0.5 END ELSE (activity_mean - lo) / (hi - lo) END AS na FROM t),
s AS (SELECT state_id, avg(na) AS act, avg(least(greatest(0.7 * na + 0.3 * tr, 0), 1)) AS mob, avg(spa) AS spa, avg(imb) AS imb, avg(tr) AS tr, avg(pd) AS d, avg(pf) AS f, avg(pg) AS g FROM u GROUP BY 1),
c AS (SELECT *, 0.22 * (act - min(act) OVER ()) / (max(act) OVER () - min(act) OVER ()) + 0.24 * (mob - min(mob) OVER ()) / (max(mob) OVER () - min(mob) OVER ()) + 0.20 * imb + 0.16 * (1 - spa)
             + 0.13 * (tr - min(tr) OVER ()) / (max(tr) OVER () - min(tr) OVER ()) + 0.05 * (d + f) AS w FROM s),
l AS (SELECT *, CASE WHEN w >= 0.68 AND (mob >= 0.45 OR tr >= 0.40) THEN 'disturbance_or_transition' WHEN act <= 0.18 AND mob <= 0.22 AND imb <= 0.22 THEN 'distributed_low_activity'
  WHEN act <= 0.22 AND (imb >= 0.30 OR spa <= 0.72) THEN 'localized_low_activity_concentration' WHEN d >= greatest(f, g) AND d >= 0.42 THEN 'drinker_concentrated_activity'
  WHEN f >= greatest(d, g) AND f >= 0.42 THEN 'feeder_concentrated_activity' WHEN d + f >= 0.60 AND act >= 0.24 THEN 'functional_area_activity' WHEN g >= 0.55 AND act >= 0.28 THEN 'general_area_activity'
  ELSE 'mixed_semantic_activity_pattern' END AS b FROM c)
SELECT CAST(state_id AS BIGINT) AS state_id, round(w, 6) AS state_risk_weight, b || CASE WHEN row_number() OVER (PARTITION BY b ORDER BY state_id) > 1 THEN '_' || state_id ELSE '' END AS state_label FROM l"""


@query("semantic_state_labels", _SEM)
def semantic_state_labels(spark, sf):
    """States from slot and leading zone, weighed and named by the semantic rules."""
    df = bm.semantic_biomarkers(tb.semantic_rows(spark, sf).drop("warnings"))
    d, f, g = (F.col(f"{z}_activity_fraction") for z in ("drinking", "feeding", "general"))
    lead = F.when((d >= f) & (d >= g), 0).when(f >= g, 1).otherwise(2)
    df = df.withColumn("state_id", ((F.floor(F.col("start_us") / (6 * tb.HOUR_US)) % 4) * 3 + lead).cast("int"))
    means = [
        "normalized_activity", "mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "semantic_transition_proxy",
        "drinking_activity_fraction", "feeding_activity_fraction", "general_activity_fraction", "feeding_plus_drinking_activity_fraction",
    ]
    summary = rk.with_semantic_risk(rk.state_summary(df, means))
    return rounded(rk.with_labels(summary, rk.semantic_label()).select("state_id", "state_risk_weight", "state_label"))


@query("row_risk", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings), q AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM p)
SELECT vec_id, round(least(greatest(list_sum(list_transform(v, lambda x, i: x * [0.1, 0.35, 0.6, 0.9][(i - 1) % 4 + 1])), 0), 1), 6) AS risk, round(list_max(v), 6) AS state_probability_max FROM q""")
def row_risk(spark, sf):
    """Posteriors from all coordinates, weighed by state risks that repeat along them."""
    df = tb.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v")).withColumn("v", arrays.distribution(F.col("v")))
    levels = F.array(*[F.lit(w) for w in (0.1, 0.35, 0.6, 0.9)])
    weights = F.transform("v", lambda _, i: F.get(levels, i % 4))
    return rounded(df.select("vec_id", rk.row_risk(F.col("v"), weights).alias("risk"), F.array_max("v").alias("state_probability_max")))


@query("array_measures", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0)) AS v FROM embeddings),
q AS (SELECT vec_id, len(v) AS n, list_transform(v, lambda x: x / list_sum(v)) AS v FROM p)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)) / ln(n), 6) AS spatial_freedom_index, round(0.5 * list_sum(list_transform(v, lambda x: abs(x - 1.0 / n))), 6) AS occupancy_imbalance_index FROM q""")
def array_measures(spark, sf):
    """Distribution, freedom and imbalance over whole vectors."""
    df = tb.table(spark, sf, "embeddings").select("vec_id", arrays.distribution(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return rounded(df.select("vec_id", arrays.spatial_freedom(F.col("v")).alias("spatial_freedom_index"), arrays.occupancy_imbalance(F.col("v")).alias("occupancy_imbalance_index")))


@query("standardised_features", f"""WITH {tb.HOURS}, g AS (SELECT window_id, CASE WHEN n_rows > 1 THEN activity_mean END AS a, k_mean AS k FROM hw), m AS (SELECT median(a) AS ma, median(k) AS mk FROM g),
f AS (SELECT window_id, coalesce(a, ma) AS a, coalesce(k, mk) AS k, CAST(a IS NULL AS INT) AS i FROM g, m)
SELECT window_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 5) AS f0, round((k - avg(k) OVER ()) / stddev_pop(k) OVER (), 5) AS f1, round((i - avg(i) OVER ()) / stddev_pop(i) OVER (), 5) AS f2 FROM f""")
def standardised_features(spark, sf):
    """Median imputation, indicators of missing values, zero mean and unit deviation."""
    df = tb.hour_windows(spark, sf).select("window_id", F.when(F.col("n_rows") > 1, F.col("activity_mean")).alias("a"), F.col("k_mean").alias("k"))
    ready = pp.with_features(df, pp.fit_scaling(df, ["a", "k"]))
    return rounded(ready.select("window_id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]), 5)


def _biomarkers(spark, sf):
    return bm.semantic_biomarkers(tb.semantic_rows(spark, sf).drop("warnings"))


# --- one step and one decoding of models with given parameters, which SQL can repeat ---------------

_START = [0.5, 0.3, 0.2]
_MOVE = [[0.7, 0.2, 0.1], [0.15, 0.7, 0.15], [0.1, 0.25, 0.65]]
_MEANS_F = [[0.3, 0.5], [0.9, 1.0], [2.2, 1.4]]
_VARS_F = [[0.1, 0.3], [0.2, 0.4], [1.1, 0.5]]
FIXED_HMM = hmm.GaussianHmm(np.array(_START), np.array(_MOVE), np.array(_MEANS_F), np.array(_VARS_F))
FIXED_MIXTURE = gmm.DiagonalMixture(np.array(_START), np.array(_MEANS_F), np.array(_VARS_F), float("-inf"), 0)


def _pairs_of_features(spark, sf):
    hours = tb.hour_windows(spark, sf)
    return hours.select("window_id", "room_id", "start_us", F.array(F.col("activity_mean") / 50, F.coalesce("k_mean", F.lit(50.0)) / 50).alias("features"))


def _fixed_packed(spark, sf):
    """Chunks of twenty rows, so that messages cross chunks in every sequence; written, because they are read several times."""
    packed = hmm.pack_sequences(_pairs_of_features(spark, sf), time_axis(("room_id",)), "window_id", chunk_rows=20)
    return cut_lineage(spread(packed, "_seq", "_chunk"))


def _log_b(j, x0="x0", x1="x1"):
    (m0, m1), (v0, v1) = _MEANS_F[j], _VARS_F[j]
    return f"(-0.5 * (ln(2 * pi() * {v0}) + ln(2 * pi() * {v1}) + ({x0} - {m0}) * ({x0} - {m0}) / {v0} + ({x1} - {m1}) * ({x1} - {m1}) / {v1}))"


_three = range(3)
_ROWS_F = f"""{tb.HOURS},
xs AS (SELECT window_id, room_id, activity_mean / 50 AS x0, coalesce(k_mean, 50.0) / 50 AS x1, row_number() OVER (PARTITION BY room_id ORDER BY start_us, window_id) AS t, count(*) OVER (PARTITION BY room_id) AS n FROM hw),
em AS (SELECT *, {", ".join(f"{_log_b(j)} AS l{j}" for j in _three)} FROM xs),
pr AS (SELECT *, greatest(l0, l1, l2) AS top, {", ".join(f"exp(l{j} - greatest(l0, l1, l2)) AS b{j}" for j in _three)} FROM em)"""

# forward and backward messages by recursion over the rows of all rooms at once, scaled to a sum of one
_MESSAGES_F = f"""fw AS (
  SELECT room_id, t, {", ".join(f"{_START[j]} * b{j} / ({' + '.join(f'{_START[i]} * b{i}' for i in _three)}) AS a{j}" for j in _three)}, ln({" + ".join(f"{_START[i]} * b{i}" for i in _three)}) + top AS ll FROM pr WHERE t = 1
  UNION ALL
  SELECT room_id, t, {", ".join(f"g{j} / (g0 + g1 + g2) AS a{j}" for j in _three)}, ln(g0 + g1 + g2) + top AS ll FROM (
    SELECT p.room_id, p.t, p.top, {", ".join(f"({' + '.join(f'f.a{i} * {_MOVE[i][j]}' for i in _three)}) * p.b{j} AS g{j}" for j in _three)} FROM fw f JOIN pr p ON p.room_id = f.room_id AND p.t = f.t + 1)),
bw AS (
  SELECT room_id, t, 1.0::DOUBLE AS z0, 1.0::DOUBLE AS z1, 1.0::DOUBLE AS z2 FROM pr WHERE t = n
  UNION ALL
  SELECT room_id, t, {", ".join(f"h{i} / (h0 + h1 + h2) AS z{i}" for i in _three)} FROM (
    SELECT room_id, p.t - 1 AS t, {", ".join(f"({' + '.join(f'{_MOVE[i][j]} * p.b{j} * q.z{j}' for j in _three)}) AS h{i}" for i in _three)} FROM bw q JOIN pr p USING (room_id, t) WHERE p.t > 1)),
po AS (SELECT p.*, f.a0, f.a1, f.a2, f.ll, q.z0, q.z1, q.z2, {", ".join(f"a{j} * z{j} / (a0 * z0 + a1 * z1 + a2 * z2) AS c{j}" for j in _three)} FROM pr p JOIN fw f USING (room_id, t) JOIN bw q USING (room_id, t))"""


def _argmax(values, results):
    return f"CASE WHEN {values[0]} >= greatest({values[1]}, {values[2]}) THEN {results[0]} WHEN {values[1]} >= {values[2]} THEN {results[1]} ELSE {results[2]} END"


_SCORES = [[f"v.s{i} + ln({_MOVE[i][j]})" for i in _three] for j in _three]


@query("hmm_decode_fixed", f"""WITH RECURSIVE {_ROWS_F}, {_MESSAGES_F},
vt AS (
  SELECT room_id, t, {", ".join(f"ln({_START[j]}) + l{j} AS s{j}" for j in _three)}, {", ".join(f"[{j}] AS p{j}" for j in _three)} FROM pr WHERE t = 1
  UNION ALL
  SELECT p.room_id, p.t, {", ".join(f"greatest({', '.join(_SCORES[j])}) + p.l{j} AS s{j}" for j in _three)},
         {", ".join(f"list_append({_argmax(_SCORES[j], [f'v.p{i}' for i in _three])}, {j}) AS p{j}" for j in _three)}
  FROM vt v JOIN pr p ON p.room_id = v.room_id AND p.t = v.t + 1),
ends AS (SELECT room_id, {_argmax(["s0", "s1", "s2"], ["p0", "p1", "p2"])} AS path FROM vt JOIN (SELECT room_id, max(t) AS t FROM pr GROUP BY 1) USING (room_id, t))
SELECT window_id, CAST(path[t] AS BIGINT) AS state_id, round(c0, 5) AS posterior_0, round(c1, 5) AS posterior_1, round(c2, 5) AS posterior_2 FROM po JOIN ends USING (room_id)""")
def hmm_decode_fixed(spark, sf):
    """Most likely states and posteriors of all hours of a room under a model with given parameters."""
    states = hmm.decode(_fixed_packed(spark, sf), FIXED_HMM, "window_id")
    return rounded(states.select("window_id", "state_id", *[F.col("posterior")[j].alias(f"posterior_{j}") for j in _three]), 5)


def _parameters(spark, model, start):
    """Parameters as rows: ``parameter``, ``i``, ``j``, ``value``."""
    table = [(start[0], i, 0, float(v)) for i, v in enumerate(start[1])]
    for name, values in (("mean", model.means), ("variance", model.variances)):
        table += [(name, i, j, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)]
    return table, "parameter string, i bigint, j bigint, value double"


def _moments(weight, prior, floor):
    """SQL rows of new means and variances from rows with weights ``weight(j)``."""
    out = []
    for j in _three:
        for d in (0, 1):
            mean = f"sum({weight(j)} * x{d}) / sum({weight(j)})"
            scatter = f"sum({weight(j)} * x{d} * x{d}) - 2 * ({mean}) * sum({weight(j)} * x{d}) + ({mean}) * ({mean}) * sum({weight(j)})"
            out.append(f"SELECT 'mean' AS parameter, {j} AS i, {d} AS j, {mean} AS value FROM po")
            out.append(f"SELECT 'variance', {j}, {d}, ({prior} + {scatter}) / sum({weight(j)}) + {floor} FROM po")
    return " UNION ALL ".join(out)


def _joint(i, j):
    """Expected moves from state i at t - 1 to j at t."""
    total = " + ".join(f"l.a{x} * {_MOVE[x][y]} * r.b{y} * r.z{y}" for x in _three for y in _three)
    return f"sum(l.a{i} * {_MOVE[i][j]} * r.b{j} * r.z{j} / ({total}))"


@query("hmm_step_fixed", f"""WITH RECURSIVE {_ROWS_F}, {_MESSAGES_F},
mv AS (SELECT {", ".join(f"{_joint(i, j)} AS m{i}{j}" for i in _three for j in _three)} FROM po l JOIN po r ON r.room_id = l.room_id AND r.t = l.t + 1),
pa AS (
  {" UNION ALL ".join(f"SELECT 'start' AS parameter, {j} AS i, 0 AS j, avg(c{j}) AS value FROM po WHERE t = 1" for j in _three)} UNION ALL
  {" UNION ALL ".join(f"SELECT 'transition', {i}, {j}, m{i}{j} / (m{i}0 + m{i}1 + m{i}2) FROM mv" for i in _three for j in _three)} UNION ALL
  {_moments(lambda j: f"c{j}", hmm.VARIANCE_PRIOR, 0)} UNION ALL
  SELECT 'log_likelihood', 0, 0, sum(ll) / count(*) FROM po)
SELECT parameter, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(value, 5) AS value FROM pa""")
def hmm_step_fixed(spark, sf):
    """Parameters after one step of expectation and maximisation from given ones, and the log-likelihood a row."""
    packed = _fixed_packed(spark, sf)
    model = hmm.stepped(packed, FIXED_HMM)
    table, shape = _parameters(spark, model, ("start", model.start))
    table += [("transition", i, j, float(v)) for i, row in enumerate(model.transition) for j, v in enumerate(row)]
    size = packed.agg(F.sum(F.size("ids")).alias("n")).first()["n"]
    return rounded(spark.createDataFrame([*table, ("log_likelihood", 0, 0, model.log_likelihood / size)], shape), 5)


_JOINT_M = [f"({_START[j]} * exp({_log_b(j)}))" for j in _three]


@query("gmm_step_fixed", f"""WITH {tb.HOURS},
xs AS (SELECT activity_mean / 50 AS x0, coalesce(k_mean, 50.0) / 50 AS x1 FROM hw),
jo AS (SELECT *, {", ".join(f"{_JOINT_M[j]} AS g{j}" for j in _three)} FROM xs),
po AS (SELECT *, {", ".join(f"g{j} / (g0 + g1 + g2) AS c{j}" for j in _three)}, ln(g0 + g1 + g2) AS ll FROM jo),
pa AS (
  {" UNION ALL ".join(f"SELECT 'weight' AS parameter, {j} AS i, 0 AS j, avg(c{j}) AS value FROM po" for j in _three)} UNION ALL
  {_moments(lambda j: f"c{j}", 0, gmm.REGULARISER)} UNION ALL SELECT 'log_likelihood', 0, 0, avg(ll) FROM po)
SELECT parameter, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(value, 5) AS value FROM pa""")
def gmm_step_fixed(spark, sf):
    """Mixture parameters after one step from given ones, and the mean log-likelihood."""
    model = gmm.stepped(gmm.row_blocks(_pairs_of_features(spark, sf)), FIXED_MIXTURE)
    table, shape = _parameters(spark, model, ("weight", model.weights))
    return rounded(spark.createDataFrame([*table, ("log_likelihood", 0, 0, model.mean_log_likelihood)], shape), 5)


@query("hmm_states")
def hmm_states(spark, sf):
    """Sequence model over the window biomarkers (an iterative fit; no SQL form)."""
    df = _biomarkers(spark, sf)
    result = fit_states(df, ModelSettings(), kind=HMM)
    return rounded(result.sequence.select("window_id", "state_id", "state_label", "state_run_length", "state_probability_max", "welfare_risk_score", "risk_level", "sustained_risk_flag"), 4)


@query("gmm_states")
def gmm_states(spark, sf):
    """Mixture model with smoothing over the window biomarkers (an iterative fit; no SQL form)."""
    result = fit_states(_biomarkers(spark, sf), ModelSettings(), kind=GMM)
    return rounded(result.sequence.select("window_id", "state_id", "state_label", "state_run_length", "welfare_risk_score", "risk_level", "sustained_risk_flag"), 4)


@query("model_comparison", f"""WITH {tb.LABELLED}, v AS (SELECT avg(least(k_mean / 100, 1.0)) FILTER (event_phase = 'during_entry') - avg(least(k_mean / 100, 1.0)) FILTER (event_phase = 'pre_entry_baseline') AS a,
avg(least(activity_mean / 200, 1.0)) FILTER (event_phase = 'during_entry') - avg(least(activity_mean / 200, 1.0)) FILTER (event_phase = 'pre_entry_baseline') AS b FROM lab)
SELECT round(a, 6) AS left_value, round(b, 6) AS right_value, CASE WHEN b > a THEN 'greater' WHEN b < a THEN 'smaller' ELSE 'equal' END AS verdict FROM v""")
def model_comparison(spark, sf):
    """Event contrast of two scores over the same labelled windows."""
    df = tb.labelled_hours(spark, sf).withColumn("state_probability_max", F.lit(1.0))
    left = mm.model_metrics(df.withColumn("risk_score", F.least(F.col("k_mean") / 100, F.lit(1.0)))).withColumn("model_name", F.lit("left"))
    right = mm.model_metrics(df.withColumn("risk_score", F.least(F.col("activity_mean") / 200, F.lit(1.0)))).withColumn("model_name", F.lit("right"))
    return rounded(mm.compare_models(left.unionByName(right), "left", "right"))


