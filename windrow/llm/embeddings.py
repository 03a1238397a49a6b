"""Near-duplicate embeddings within a label, by products of int8 tiles with error bounds.

1. Equal vectors of a label become one class, so copies are combined before anything else.
2. A class vector is scaled to length 1 and rounded to int8: ``u = s * q + e``, with ``s``
   and the length of ``e`` known. For two vectors, ``|u.v - s s' q.q'| <= |e'| (1 + |e|) + |e|``.
3. Classes of a label are laid out by their nearest of ``pivots`` vectors and cut into tiles of
   about ``tile`` rows. Two tiles meet if a pair of their cells may hold a link by the triangle
   inequality of angles (pivots only save work; the result does not depend on them).
4. A pair of tiles is one bounded task: products of the int8 codes (exact in
   single precision), the bound on top, and cosines in double precision for the pairs
   that may reach the threshold. Out come the links of each row, counted, and its
   local root, at most one row a member; no pair of vectors is written.
5. Roots of all tasks are joined into components; members take the smallest id.

All pairs of tiles that the bounds leave open are compared, so the work inside one
label without structure grows with the square of its distinct vectors.

Cases: null vectors or labels, vectors that are zero or hold null or non-finite numbers, and
empty vectors link with nothing; vectors of different lengths never link; equal rows
link with one another (repeated ids too); null ids are passed over when the smallest is chosen (a component of
null ids alone has a null id); ``kept`` compares ids with null equal to null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from windrow.llm.components import components
from windrow.llm.store import saved

SLACK = 1e-9  # above the rounding of the double-precision sums below


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of ``width`` numbers each as a table of doubles (codes stay int8)."""
    data = b"".join(column.to_pylist())
    out = np.frombuffer(data, kind).reshape(len(column), width)
    return out if kind is np.int8 else out.astype(np.float64)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and lengths of the rounding errors of unit rows."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))


def _prepared(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Codes of (class, vector) rows, and the nearest pivot with the angle to it; cell -1 where no pivot has the length."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            part = batch.slice(begin, 4096)
            lists = part["vector"].to_pylist()
            rows: list[tuple] = [()] * len(lists)
            for width in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == width]
                full = np.array([lists[i] for i in at], np.float64)
                largest = np.abs(full).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
                unit = full / largest
                unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                codes, scale, error = quantised(unit)
                cell, angle = np.full(len(at), -1), np.full(len(at), math.pi)
                if width in pivots:
                    cosines = np.clip(unit @ pivots[width].T, -1, 1)
                    cell = cosines.argmax(axis=1)
                    angle = np.arccos(cosines[np.arange(len(at)), cell])
                for k, i in enumerate(at):
                    rows[i] = codes[k].tobytes(), scale[k], error[k], unit[k].tobytes(), int(cell[k]), angle[k]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([part["class"], part["label"], part["width"], part["many"], *columns], names=["class", "label", "width", "many", "codes", "scale", "error", "unit", "cell", "angle"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` can reach over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(table: pa.Table, cosine: float) -> pa.Table:
    """Links (weighted by copies) and local roots of the rows of a pair of tiles that have any."""
    width = table["width"][0].as_py()
    side = table["side"].to_numpy()
    codes = _matrix(table["codes"], np.int8, width).astype(np.float32 if width <= 1000 else np.float64)
    unit = _matrix(table["unit"], np.float64, width)
    scale, error = table["scale"].to_numpy(), table["error"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    same = right is left
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(0, len(left), 256):
        rows = left[begin : begin + 256]
        about = (codes[rows] @ codes[right].T).astype(np.float64) * scale[rows, None] * scale[right]
        about += error[right] * (1 + error[rows, None]) + error[rows, None] + SLACK
        i, j = np.nonzero(about >= cosine)
        if same:
            i, j = i[j > i + begin], j[j > i + begin]
        for at in range(0, len(i), 16_384):
            a, b = rows[i[at : at + 16_384]], right[j[at : at + 16_384]]
            exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            found.append((a[exact].astype(np.int32), b[exact].astype(np.int32)))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int32) for k in (0, 1))
    many = table["many"].to_numpy()
    links = np.bincount(a, many[b], len(side)) + np.bincount(b, many[a], len(side))
    linked = np.flatnonzero(links)
    root = _roots(len(side), a, b)[linked]
    ids = table["class"].combine_chunks() if isinstance(table["class"], pa.ChunkedArray) else table["class"]
    return pa.table({"class": ids.take(pa.array(linked)), "root": ids.take(pa.array(root)), "links": pa.array(links[linked].astype(np.int64))})


def _tiled(classes: DataFrame, cosine: float, pivots: int, tile: int) -> DataFrame:
    """Rows of ``classes`` once for each pair of tiles (``i`` <= ``j``) that their tile is in; ``side`` is 1 in the second."""
    sample: dict[int, list] = {}
    for row in classes.orderBy(F.xxhash64("vector"), "vector").limit(pivots).select("vector").collect():
        sample.setdefault(len(row.vector), []).append(row.vector)
    units = {w: np.array(v, np.float64) / np.abs(v).max(axis=1, keepdims=True) for w, v in sample.items()}
    units = {w: v / np.linalg.norm(v, axis=1, keepdims=True) for w, v in units.items()}
    kind = classes.schema["label"].dataType.simpleString()
    shape = f"class long, label {kind}, width int, many long, codes binary, scale double, error double, unit binary, cell int, angle double"
    rows = saved(classes.select("class", "label", F.size("vector").alias("width"), "many", "vector").mapInArrow(lambda b: _prepared(b, units), shape), "codes")

    space = ["label", "width"]
    cells = rows.groupBy(*space, "cell").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*space).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = saved(cells.withColumn("before", before), "cells")  # at most `pivots` + 1 rows a space
    rows = rows.join(cells.select(*space, "cell", "size", "before"), [*space, "cell"])
    rows = rows.withColumn("tile", F.expr(f"(before + pmod(xxhash64(class), size)) div {tile}"))

    between = [(w, a, b, float(np.arccos(np.clip(v[a] @ v[b], -1, 1)))) for w, v in units.items() for a in range(len(v)) for b in range(len(v))]
    gaps = classes.sparkSession.createDataFrame(between, "width int, cell int, cell_b int, gap double") if between else None
    spans = cells.select(*space, "cell", "radius", F.expr(f"before div {tile}").alias("first"), F.expr(f"(before + size - 1) div {tile}").alias("last"))
    second = spans.toDF(*space, "cell_b", "radius_b", "first_b", "last_b")
    pairs = spans.join(second, space)
    if gaps is not None:
        pairs = pairs.join(F.broadcast(gaps), ["width", "cell", "cell_b"], "left")  # pivots squared, a parameter
    else:
        pairs = pairs.withColumn("gap", F.lit(None).cast("double"))
    open_ = F.col("gap").isNull() | (F.col("gap") - F.col("radius") - F.col("radius_b") <= math.acos(min(cosine, 1.0)) + 1e-6)
    pairs = pairs.filter(open_).select(*space, F.explode(F.sequence("first", "last")).alias("i"), "first_b", "last_b")
    pairs = saved(pairs.select(*space, "i", F.explode(F.sequence("first_b", "last_b")).alias("j")).filter("i <= j").distinct(), "tile-pairs")
    data = ["class", *space, "many", "codes", "scale", "error", "unit"]
    one = rows.join(pairs.withColumn("tile", F.col("i")), [*space, "tile"]).select(*data, "i", "j", F.lit(0).alias("side"))
    two = rows.join(pairs.filter("i < j").withColumn("tile", F.col("j")), [*space, "tile"]).select(*data, "i", "j", F.lit(1).alias("side"))
    return one.union(two)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int = 32, tile: int = 4096) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row. Only rows with equal labels are compared."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    sound = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = rows.withColumn("vector", F.when(sound, F.col("vector")))
    classes = rows.filter("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"))
    classes = saved(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    met = _tiled(classes, cosine, pivots, tile).groupBy("label", "width", "i", "j").applyInArrow(lambda t: tile_links(t, cosine), "class long, root long, links long")
    met = saved(met, "links")
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    reach = components(met.filter("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v")).distinct())
    reach = reach.withColumnRenamed("id", "class")
    least = reach.join(classes.select("class", "least"), "class").groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(links, "class", "left").join(reach, "class", "left").join(least, "component", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.join(known.withColumn("known", F.lit(True)), ["label", "vector"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
