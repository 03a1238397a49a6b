"""State models, risk rules, kernels, zones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windrow.kernels import audio, video, zones as zn
from windrow.models import gmm, hmm, lockstep, metrics as mm, preprocess as pp, risk as rk, states
from windrow.models.states import GMM, HMM, fit_states
from windrow.operators.ordered import time_axis
from windrow.operators.windowing import sliding_windows
from windrow.settings import MICROS, ModelSettings


@pytest.fixture(scope="module")
def observed(spark):
    rng = np.random.default_rng(0)
    rows = []
    for room, n in (("hot", 240), ("a", 60), ("b", 1)):
        state = 0
        for i in range(n):
            if rng.random() < 0.1:
                state = 1 - state
            x = rng.normal([0.2, 0.8][state], 0.05)
            rows.append((f"{room}{i:03d}", room, "s", i * 10 * MICROS, state, float(x), float(1 - x), float(rng.normal(0.3, 0.1)), float(x * 0.9)))
    ddl = "window_id string, room_id string, session_id string, start_us bigint, truth int, mobility_index double, spatial_freedom_index double, occupancy_imbalance_index double, normalized_activity double"
    return spark.createDataFrame(rows, ddl).cache()


def with_vectors(df):
    return pp.with_features(df, pp.fit_scaling(df, pp.twin_features(df), indicators=False))


def test_state_count():
    settings = ModelSettings(max_states=4)
    assert [pp.state_count(n, settings) for n in (0, 1, 5, 20, 200)] == [1, 1, 2, 3, 4]
    assert pp.state_count(3, ModelSettings(n_states=9)) == 3


def test_scaling_imputes_and_marks(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (5.0, None)], "a double, b double")
    s = pp.fit_scaling(df, ["a", "b"])
    assert s.names == ("a", "a__missing", "b__missing") and s.medians[0] == 3.0
    got = np.array([r["features"] for r in pp.with_features(df, s).collect()])
    assert got[:, 0].mean() == pytest.approx(0) and got[:, 0].std() == pytest.approx(1) and np.all(got[:, 2] == 0)


def test_likelihood_never_falls_and_states_are_found(observed):
    ready = with_vectors(observed)
    axis = time_axis(("room_id", "session_id"))
    model, packed = hmm.fit_hmm(ready, axis, "window_id", 2, ModelSettings(max_iterations=12))
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:]))
    assert model.transition.sum(axis=1) == pytest.approx(np.ones(2)) and model.start.sum() == pytest.approx(1)
    got = hmm.decode(packed, model, "window_id").join(observed, "window_id").toPandas()
    assert len(got) == 301
    agree = (got["state_id"] == got["truth"]).mean()
    assert max(agree, 1 - agree) > 0.97
    assert np.stack(got["posterior"]).sum(axis=1) == pytest.approx(np.ones(301))


def test_chunks_change_nothing(observed):
    ready = with_vectors(observed)
    axis = time_axis(("room_id", "session_id"), seconds=300)
    settings = ModelSettings(max_iterations=3)
    whole, packed = hmm.fit_hmm(ready, axis, "window_id", 3, settings)
    cut, small = hmm.fit_hmm(ready, axis, "window_id", 3, settings, chunk_rows=7)
    assert cut.history == pytest.approx(whole.history, rel=1e-9) and cut.means == pytest.approx(whole.means, rel=1e-7)
    a = hmm.decode(packed, whole, "window_id").toPandas().set_index("window_id").sort_index()
    b = hmm.decode(small, whole, "window_id").toPandas().set_index("window_id").sort_index()
    assert (a["state_id"] == b["state_id"]).all() and np.stack(a["posterior"]) == pytest.approx(np.stack(b["posterior"]))


def test_decoding_against_enumeration(spark):
    model = hmm.GaussianHmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.0], [1.0]]), np.array([[0.3], [0.2]]))
    x = np.array([[0.1], [0.7], [0.4], [0.9], [0.2]])
    log_b = model.log_emission(x)
    paths = np.array(np.meshgrid(*[[0, 1]] * 5)).T.reshape(-1, 5)
    score = [np.log(model.start[p[0]]) + log_b[np.arange(5), p].sum() + sum(np.log(model.transition[p[i], p[i + 1]]) for i in range(4)) for p in paths]
    weight = np.exp(score - np.logaddexp.reduce(score))
    post = np.array([[weight[paths[:, t] == k].sum() for k in (0, 1)] for t in range(5)])
    df = spark.createDataFrame([(f"w{i}", "r", i * MICROS, [float(v) for v in x[i]]) for i in range(5)], "window_id string, room_id string, start_us bigint, features array<double>")
    for rows in (2, 100):
        got = hmm.decode(hmm.pack_sequences(df, time_axis(("room_id",)), "window_id", chunk_rows=rows), model, "window_id").orderBy("window_id").toPandas()
        assert list(got["state_id"]) == list(paths[int(np.argmax(score))]) and np.stack(got["posterior"]) == pytest.approx(post)


def plain_messages(model, x, entry, end, first):
    """Forward and backward messages and the best path of one chunk, a row at a time."""
    log_b = model.log_emission(x)
    b = np.exp(log_b)
    alpha, message, loglik = [], entry, 0.0
    for t in range(len(x)):
        message = (message if t == 0 and first else message @ model.transition) * b[t]
        loglik += np.log(message.sum())
        message = message / message.sum()
        alpha.append(message)
    beta = [end]
    for t in range(len(x) - 1, 0, -1):
        beta.insert(0, model.transition @ (b[t] * beta[0]))
    gamma = np.array(alpha) * np.array(beta)
    pairs = np.zeros_like(model.transition)
    for t in range(1 if first else 0, len(x)):
        joint = (alpha[t - 1] if t else entry)[:, None] * model.transition * (b[t] * beta[t])
        pairs += joint / joint.sum()
    return gamma / gamma.sum(axis=1, keepdims=True), pairs, loglik


def test_lockstep_equals_one_chunk_at_a_time():
    draw = np.random.default_rng(3)
    k, d = 3, 2
    model = hmm.GaussianHmm(draw.dirichlet(np.ones(k)), draw.dirichlet(np.ones(k), size=k), draw.normal(size=(k, d)), draw.uniform(0.3, 2, size=(k, d)))
    chunks = [draw.normal(size=(n, d)) for n in (9, 9, 5, 1, 1)]
    first = np.array([True, False, False, True, False])
    entry, end = draw.dirichlet(np.ones(k), size=5), draw.uniform(0.1, 1, size=(5, k))
    entry[first] = model.start
    step = lockstep.Lockstep(model, chunks, first)
    gamma, pairs, loglik = step.smoothed(entry, end)
    want = [plain_messages(model, *args) for args in zip(chunks, entry, end, first)]
    assert gamma == pytest.approx(np.concatenate([w[0] for w in want])) and pairs == pytest.approx(sum(w[1] for w in want)) and loglik == pytest.approx([w[2] for w in want])
    alone = [lockstep.Lockstep(model, [c], np.array([f])) for c, f in zip(chunks, first)]
    assert step.products() == pytest.approx(np.concatenate([s.products() for s in alone])) and step.best() == pytest.approx(np.concatenate([s.best() for s in alone]))
    before, last = np.array([-1, 2, 0, -1, 1]), np.array([1, -1, 2, -1, -1])
    assert list(step.paths(before, last)) == [s for one, b, x in zip(alone, before, last) for s in one.paths(np.array([b]), np.array([x]))]
    parts = list(lockstep.slabs(np.array([3, 50, 7, 7, 1]), cells=21))
    assert [list(p) for p in parts] == [[1], [2, 3, 0], [4]]


def test_an_expectation_step_reads_few_rows_for_many_sequences(spark):
    draw = np.random.default_rng(7)
    k, d = 3, 2
    model = hmm.GaussianHmm(draw.dirichlet(np.ones(k)), draw.dirichlet(np.ones(k), size=k), draw.normal(size=(k, d)), draw.uniform(0.3, 2, size=(k, d)))
    sequences = {f"r{i}": draw.normal(size=(int(draw.integers(1, 5)), d)) for i in range(900)} | {"long": draw.normal(size=(30, d))}
    rows = [(f"{name}_{t}", name, t * MICROS, [float(v) for v in x]) for name, part in sequences.items() for t, x in enumerate(part)]
    df = spark.createDataFrame(rows, "window_id string, room_id string, start_us bigint, features array<double>")
    want = np.zeros(k + k * k + k + 2 * k * d + 1)
    for x in sequences.values():
        gamma, pairs, loglik = plain_messages(model, x, model.start, np.ones(k), True)
        want += np.concatenate([gamma[0], pairs.ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel(), (gamma.T @ (x * x)).ravel(), [loglik]])
    for chunk_rows, alone in ((7, 900), (100, 901)):
        packed = hmm.pack_sequences(df, time_axis(("room_id",)), "window_id", chunk_rows=chunk_rows).coalesce(2).cache()
        blocks = hmm.whole_blocks(packed, d)
        read = blocks.toPandas()
        assert len(read) <= 4 and sum(len(s) for s in read["sizes"]) == 4 * alone
        assert hmm.expected(blocks, packed.filter("_chunks > 1") if chunk_rows == 7 else None, model) == pytest.approx(want)


def test_mixture_takes_over_when_the_sequence_model_fails(observed, monkeypatch):
    def broken(*args):
        raise np.linalg.LinAlgError("no convergence")

    monkeypatch.setattr(states, "fit_hmm", broken)
    result = fit_states(observed, ModelSettings(max_iterations=2), kind=HMM)
    assert result.model_type == GMM and "no convergence" in result.note and result.sequence.count() == 301


def test_mixture(observed):
    model = gmm.fit_gmm(with_vectors(observed), 2, ModelSettings())
    assert all(b >= a - 1e-9 for a, b in zip(model.history, model.history[1:])) and model.weights.sum() == pytest.approx(1)
    got = gmm.assign(with_vectors(observed), model, "window_id").join(observed, "window_id").toPandas()
    agree = (got["state_id"] == got["truth"]).mean()
    assert max(agree, 1 - agree) > 0.97


def test_a_mixture_step_reads_few_rows_for_many_vectors(spark):
    draw = np.random.default_rng(9)
    k, d, x = 3, 2, draw.normal(size=(2_000, 2))
    model = gmm.DiagonalMixture(draw.dirichlet(np.ones(k)), draw.normal(size=(k, d)), draw.uniform(0.3, 2, size=(k, d)), float("-inf"), 0)
    blocks = gmm.row_blocks(spark.createDataFrame([([float(v) for v in row],) for row in x], "features array<double>").coalesce(2))
    assert 0 < blocks.count() <= 2 and blocks.agg(F.sum("n")).first()[0] == len(x)
    joint = model.weights * np.exp(-0.5 * ((x[:, None, :] - model.means) ** 2 / model.variances).sum(axis=2)) / np.sqrt((2 * np.pi * model.variances).prod(axis=1))
    r = joint / joint.sum(axis=1, keepdims=True)
    means = (r.T @ x) / r.sum(axis=0)[:, None]
    got = gmm.stepped(blocks, model)
    assert got.mean_log_likelihood == pytest.approx(np.log(joint.sum(axis=1)).mean()) and got.weights == pytest.approx(r.mean(axis=0))
    assert got.means == pytest.approx(means) and got.variances == pytest.approx((r.T @ (x * x)) / r.sum(axis=0)[:, None] - means**2 + gmm.REGULARISER)


def test_the_mixture_brings_states_to_rows_without_a_join(spark):
    draw = np.random.default_rng(5)
    model = gmm.DiagonalMixture(draw.dirichlet(np.ones(3)), draw.normal(size=(3, 2)), draw.uniform(0.3, 2, size=(3, 2)), float("-inf"), 0)
    x = draw.normal(size=(60, 2)) * 3
    ready = spark.createDataFrame([(f"w{i:02d}", i, [float(v) for v in row]) for i, row in enumerate(x)], "window_id string, at int, features array<double>")
    rows = states.with_states(ready, states.Assigned(GMM, model, gmm.assign(ready, model, "window_id"), 0.0))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got, want = rows.orderBy("at").toPandas(), gmm._responsibility(model, x)[0]
    assert np.stack(got["posterior"]) == pytest.approx(want) and list(got["state_id"]) == list(want.argmax(axis=1))
    assert list(got.columns) == ["window_id", "at", "state_id", "posterior", "state_probability_max"] and got["state_probability_max"].to_numpy() == pytest.approx(want.max(axis=1))


@pytest.mark.parametrize("kind", [HMM, GMM])
def test_states_end_to_end(observed, kind):
    result = fit_states(observed, ModelSettings(max_iterations=4), kind=kind)
    got = result.sequence.toPandas()
    assert len(got) == 301 and result.n_states == 4 and result.model_type == kind
    assert got["welfare_risk_score"].between(0, 1).all() and set(got["risk_level"]) <= {"low", "medium", "high"}
    assert got[[f"posterior_state_{i}" for i in range(4)]].sum(axis=1).to_numpy() == pytest.approx(np.ones(301))
    assert result.summary.agg(F.sum("window_fraction")).first()[0] == pytest.approx(1.0)
    if kind == GMM:
        assert (got["state_probability_max"] == 1.0).all()


def summary_frame(spark, rows):
    names = ["state_id", "normalized_activity_mean", "mobility_index_mean", "occupancy_imbalance_index_mean", "spatial_freedom_index_mean", "resilience_pressure_index_mean", "state_run_length_mean"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names))


def test_labels_and_weights(spark):
    rows = [(0, 0.1, 0.1, 0.1, 0.95, None, 2.0), (1, 0.1, 0.1, 0.1, 0.95, None, 2.0), (2, 0.9, 0.9, 0.5, 0.4, None, 8.0)]
    df = rk.with_labels(rk.with_twin_risk(summary_frame(spark, rows)), rk.twin_label())
    got = {r["state_id"]: r for r in df.collect()}
    assert got[0]["state_label"] == "stable_low_activity" and got[1]["state_label"] == "stable_low_activity_1"
    assert got[2]["component_mobility_level"] == 1.0 and got[2]["component_resilience_pressure"] == 0.5 and got[2]["component_persistence"] == 1.0
    assert got[2]["state_risk_weight"] == pytest.approx(0.30 * 0.95 + 0.25 * 0.5 + 0.20 * 0.6 + 0.15 * 0.5 + 0.10)
    assert got[2]["state_label"] == "sustained_deviation"


def test_first_detection_is_first_in_order(spark):
    rows = [
        ("a", "pre_entry_baseline", 0.1, None, 1), ("b", "pre_entry_baseline", 0.2, None, 2), ("c", "during_entry", 0.15, 60.0, 3),
        ("d", "during_entry", 0.9, 300.0, 4), ("e", "during_entry", 0.9, 120.0, 5), ("f", "outside_event_window", 0.5, None, 6), ("g", "outside_event_window", 0.1, None, 7),
    ]
    df = spark.createDataFrame(rows, "window_id string, event_phase string, risk_score double, seconds_from_event_start double, start_us bigint").withColumns(
        {"room_id": F.lit("r"), "session_id": F.lit("s"), "state_id": F.lit(0), "state_probability_max": F.lit(0.5)}
    )
    got = {r["metric_name"]: r["value"] for r in mm.model_metrics(df, -1.5).collect()}
    assert got["time_to_detect_minutes"] == 5.0 and got["false_positive_rate_outside_event_window"] == 0.5 and got["log_likelihood_per_sample"] == -1.5
    assert got["event_detection_contrast"] == pytest.approx(0.65 - 0.15) and got["state_purity_by_event_phase"] == 1.0


def pcm(wave):
    return np.round(np.asarray(wave) * 32768).clip(-32768, 32767).astype("<i2").tobytes()


def test_sine_features(spark):
    rate = 22_050
    t = np.arange(2 * rate) / rate
    df = spark.createDataFrame([("m", pcm(0.5 * np.sin(2 * np.pi * 440 * t)))], "media_id string, pcm binary")
    got = audio.audio_frames(df, rate).orderBy("frame_start_sec").toPandas()
    assert list(got["frame_center_sec"]) == [0.5, 1.5] and got["audio_rms"].to_numpy() == pytest.approx([0.5 / np.sqrt(2)] * 2, abs=1e-3)
    assert (got["audio_spectral_centroid"] > 100).all() and got["audio_zero_crossing_rate"].to_numpy() == pytest.approx([880 / rate] * 2, abs=1e-3)
    assert got["audio_spectral_rolloff"].to_numpy() == pytest.approx([440, 440], abs=2) and (got["audio_short_time_energy"] > 0.12).all()


@pytest.mark.parametrize(("hop", "block"), [(None, 256), (0.5, 3), (0.25, 1), (0.75, 2)])
def test_frames_overlap_across_rows_and_blocks(spark, hop, block):
    """A recording in many rows of odd lengths, over several Arrow batches, against frames cut from the whole."""
    rate, draw = 8, np.random.default_rng(4)
    sounds = {m: np.round(draw.uniform(-1, 1, n) * 32000) / 32768 for m, n in (("long", 3_001), ("short", 5), ("one", 1), ("even", 16))}
    rows = [("none", 0, b"")]
    for m, sound in sounds.items():
        at = 0
        while at < len(sound):
            n = int(draw.integers(1, 9))
            rows.append((m, at, pcm(sound[at : at + n])))
            at += n
    draw.shuffle(rows)
    df = spark.createDataFrame([(m, int(a), bytes(p)) for m, a, p in rows], "media_id string, chunk_start bigint, pcm binary").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r["media_id"], r["frame_start_sec"]): r for r in audio.audio_frames(df, rate, 1.0, hop, block).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    step = round(rate * (hop or 1.0))
    want = {}
    for m, sound in sounds.items():
        for i in range(len(sound)):
            if i == 0 or i * step + rate - step < len(sound):
                frame = np.zeros((1, rate))
                part = sound[i * step : i * step + rate]
                frame[0, : len(part)] = part
                want[m, i * step / rate] = {k: float(v[0]) for k, v in audio.spectral_features(frame, rate).items()}
    assert got.keys() == want.keys()
    assert all(got[key][n] == pytest.approx(v, abs=1e-12) for key, values in want.items() for n, v in values.items())


def grid(n=2):
    return [{"zone_id": f"zone_{chr(65 + r * n + c)}", "row": r, "col": c} for r in range(n) for c in range(n)]


def test_frame_differences(spark):
    frames = []
    for i, level in enumerate((0.0, 1.0, 128 / 255)):
        image = np.zeros((20, 20))
        image[10:, 10:] = level
        frames.append(("m", i * 2.0, 20, 20, np.round(image * 255).astype(np.uint8).tobytes()))
    df = spark.createDataFrame(frames, "media_id string, frame_time_sec double, height int, width int, pixels binary")
    metrics = video.frame_differences(df, {None: zn.grid_masks(grid(), 20, 20)}, block_seconds=2)
    got = {(r["interval_center_sec"], r["zone_id"]): r for r in metrics.collect()}
    assert got[1.0, "zone_D"]["activity_mean"] == pytest.approx(1.0) and got[1.0, "zone_A"]["activity_mean"] == 0.0
    assert got[3.0, "zone_D"]["activity_mean"] == pytest.approx(127 / 255) and got[3.0, "zone_D"]["activity_sum"] == pytest.approx(100 * 127 / 255)
    assert got[3.0, "zone_D"]["motion_ratio"] == 1.0 and len(got) == 8

    media = spark.createDataFrame([("m", 40.0, "r", "s", "2025-08-16T06:00:00-03:00", "v", False, "ok", "")], "media_id string, duration_seconds double, room_id string, session_id string, start_time string, video_path string, has_audio boolean, quality_status string, warnings string")
    areas = spark.createDataFrame([(z["zone_id"],) for z in grid()], "zone_id string")
    rows = video.zone_features(sliding_windows(media), metrics, media, areas).orderBy("window_id", "zone_id").toPandas()
    assert len(rows) == 8 and rows.loc[3, "frame_count_used"] == 2 and rows.loc[3, "activity_norm"] == pytest.approx(1.0)
    failed = rows[rows["window_index"] == 1]
    assert (failed["quality_status"] == "failed").all() and (failed["warnings"] == "no_interval_overlap").all() and failed["activity_norm"].to_numpy() == pytest.approx([0.25] * 4)


@pytest.mark.parametrize(("block", "slab"), [(3, 64), (10_000, 2)])
def test_frame_differences_use_the_masks_of_the_room(spark, block, slab):
    draw = np.random.default_rng(8)
    halves, quarters = np.zeros((4, 6), bool), zn.grid_masks(grid(), 6, 4)
    halves[:, :3] = True
    masks = {"r1": {"left": halves, "right": ~halves, "nothing": np.zeros((4, 6), bool)}, None: quarters}
    rows, rooms = [], {"a": "r1", "b": "r2", "c": None, "d": "r1"}
    for m, n in (("a", 9), ("b", 5), ("c", 1), ("d", 4)):
        size = 24 if m != "d" else 12  # no mask fits the small frames
        rows += [(m, rooms[m], float(i * 1.5), draw.integers(0, 256, size).astype(np.uint8).tobytes()) for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(m, r, float(t), bytes(p)) for m, r, t, p in rows], "media_id string, room_id string, frame_time_sec double, pixels binary").repartition(3)
    got = {(r["media_id"], r["interval_start_sec"], r["zone_id"]): r for r in video.frame_differences(df, masks, 0.3, block, slab).collect()}
    want = {}
    for m in ("a", "b"):
        frames = sorted((float(t), np.frombuffer(p, np.uint8) / 255.0) for k, _, t, p in rows if k == m)
        for (t0, f0), (_, f1) in zip(frames, frames[1:]):
            for zone, mask in masks["r1" if m == "a" else None].items():
                part = np.abs(f1 - f0)[mask.ravel()]
                want[m, t0, zone] = (part.mean(), part.std(), part.sum(), (part > 0.3).mean()) if len(part) else (None,) * 4
    assert got.keys() == want.keys()
    for key, values in want.items():
        r = got[key]
        assert (r["activity_mean"], r["activity_std"], r["activity_sum"], r["motion_ratio"]) == (values if values[0] is None else pytest.approx(values))


CONFIG = {
    "room_id": "room_1", "zone_config_id": "c", "image_width": 10, "image_height": 10,
    "zones": [
        {"zone_id": "drinking_zone", "semantic_type": "drinking", "polygon": zn.rectangle_polygon(0, 0, 2, 2)},
        {"zone_id": "feeding_zone", "semantic_type": "feeding", "polygon": zn.rectangle_polygon(2, 0, 4, 2)}, {"zone_id": "general_zone", "semantic_type": "general"},
    ],
}


def test_zone_masks_and_checks():
    masks = zn.zone_masks(CONFIG)
    assert masks["drinking_zone"].sum() == 4 and masks["feeding_zone"].sum() == 4 and masks["general_zone"].sum() == 92
    assert zn.check_config(CONFIG) == (True, [])
    clash = {**CONFIG, "zones": [CONFIG["zones"][0], {"zone_id": "feeding_zone", "polygon": zn.rectangle_polygon(1, 0, 3, 2)}]}
    assert zn.check_config(clash) == (False, ["drinking_feeding_overlap"])
    assert zn.choose_config(clash, CONFIG)[1] == ["automatic_detection_invalid", "manual_fallback_used"]
    assert zn.choose_config(clash, None) == (None, ["automatic_detection_invalid", "no_valid_zone_config"])
    assert zn.polygon_mask([[0, 0], [10, 0], [0, 10]], 10, 10).sum() == pytest.approx(50, abs=6)
    assert zn.signature(CONFIG) != zn.signature(clash) and zn.signature(CONFIG) == zn.signature({**CONFIG, "zones": CONFIG["zones"][::-1]})
    assert {a["zone_id"]: a["zone_area_fraction"] for a in zn.zone_areas(CONFIG)}["general_zone"] == pytest.approx(0.92)


def test_grid_layouts():
    masks = zn.grid_masks(grid(), 5, 5)
    assert sum(m.sum() for m in masks.values()) == 25 and masks["zone_A"].sum() == 4 and masks["zone_D"].sum() == 9
    zn.validate_grid(grid(3), "3x3")
    with pytest.raises(ValueError):
        zn.validate_grid(grid()[:3], "2x2")
    with pytest.raises(ValueError):
        zn.validate_grid(grid(), "4x4")


def test_marked_image():
    plain = np.full((40, 60, 3), 90, dtype=np.uint8)
    marked = plain.copy()
    marked[5:15, 10:30] = (250, 20, 20)
    marked[20:35, 35:55] = (20, 200, 60)
    config = zn.config_from_images("room_1", plain, marked)
    assert config["zones"][0]["polygon"] == zn.rectangle_polygon(12, 7, 28, 13) and config["zones"][1]["polygon"] == zn.rectangle_polygon(37, 22, 53, 33)
    with pytest.raises(ValueError, match="red"):
        zn.config_from_images("room_1", plain, plain)


def test_shrinking_averages_areas():
    frame = np.arange(16, dtype=float).reshape(4, 4)
    assert video.shrink(frame, 2) == pytest.approx(frame.reshape(2, 2, 2, 2).mean(axis=(1, 3)))
    assert video.shrink(np.full((5, 7), 0.3), 3) == pytest.approx(np.full((2, 3), 0.3))
    assert video.grey(np.full((1, 1, 3), 255.0)) == pytest.approx(np.ones((1, 1)))
