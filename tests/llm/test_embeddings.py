"""Near-duplicate embeddings against all pairs, and the error bound on its own."""

import math

import numpy as np
import pyarrow as pa
import pytest
from awkward import CLASHING
from pyspark.sql import functions as F

from windrow.llm import embeddings


def plain(rows, cosine):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if label is None or label != other or not sound(v) or not sound(w) or len(v) != len(w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            a, b = a / abs(a).max(), b / abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(map(str, out))


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    return df.withColumns({c: F.lit("clash") for c in [*CLASHING, "class", "vector", "width", "cell", "tile", "i", "j", "side", "many", "links"]})


def sample(seed, n):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 16))
    rows = []
    for i in range(n):
        v = centres[draw.integers(12)] + draw.normal(size=16) * draw.choice([0.02, 0.25, 0.4])
        rows.append((i, [float(x) for x in v * 10.0 ** draw.integers(-3, 4)], str(draw.integers(2))))
    rows += [(n, rows[0][1], rows[0][2])] * 3 + [(None, rows[1][1], rows[1][2]), (n + 1, rows[2][1], None), (n + 2, None, "0"), (n + 3, [0.0] * 16, "0"), (n + 4, [1.0, None] * 8, "0"), (n + 5, [math.nan] + [1.0] * 15, "0")]
    rows += [(n + 6, [math.inf] + [1.0] * 15, "0"), (n + 7, [], "0"), (n + 8, [1.0, 2.0], "0"), (n + 9, [2.0, 4.0], "0"), (n + 10, [1e-300, 2e-300], "0"), (None, [5.0] * 3, "9"), (n + 11, [1e300] * 16, "0")]
    return rows


@pytest.mark.parametrize(("pivots", "tile"), [(32, 4096), (5, 13), (0, 7)])
def test_near_vectors(spark, pivots, tile):
    rows = sample(pivots, 150)
    out = embeddings.near_vectors(table(spark, rows).repartition(3), 0.93, pivots=pivots, tile=tile)
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in out.collect()) == plain(rows, 0.93)


def test_no_vectors(spark):
    assert embeddings.near_vectors(table(spark, [])).count() == 0


def test_error_bound_holds_and_links_are_exact():
    draw = np.random.default_rng(5)
    base = draw.normal(size=(40, 24))
    unit = np.concatenate([base + draw.normal(size=base.shape) * s for s in (0, 0.1, 0.25, 0.3, 0.4)])
    unit[3] = 0
    unit[3, 5] = 1  # all in one component
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes, scale, error = embeddings.quantised(unit)
    about = codes.astype(float) @ codes.T * scale[:, None] * scale
    bound = error * (1 + error[:, None]) + error[:, None] + embeddings.SLACK
    assert (np.abs(about - unit @ unit.T) <= bound).all()
    half = len(unit) // 2
    rows = {"class": range(len(unit)), "many": [1 + i % 3 for i in range(len(unit))], "width": [24] * len(unit), "codes": [c.tobytes() for c in codes], "scale": scale, "error": error, "unit": [u.tobytes() for u in unit]}
    true = unit @ unit.T >= 0.93
    np.fill_diagonal(true, False)
    for side in ([0] * len(unit), [int(i >= half) for i in range(len(unit))]):
        wanted = true if not any(side) else true & (np.array(side)[:, None] != np.array(side))
        got = embeddings.tile_links(pa.table(rows | {"side": side}), 0.93).to_pydict()
        counts = wanted @ np.array(rows["many"])
        assert dict(zip(got["class"], got["links"])) == {i: c for i, c in enumerate(counts) if c}
        root = embeddings._roots(len(unit), *np.nonzero(wanted))
        assert dict(zip(got["class"], got["root"])) == {i: r for i, r in enumerate(root) if counts[i]}
