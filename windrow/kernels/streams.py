"""Rows of one key that arrive in order, handed on in groups without holding more than one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, its rows as dicts) for rows that are sorted by ``keys``, across the borders of batches.

    The rows of a key must be used before the next key is asked for.
    """
    rows = (row for batch in batches for start in range(0, batch.num_rows, 256) for row in batch.slice(start, 256).to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        key = tuple(ahead[k] for k in keys)

        def same(key: tuple = key) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and tuple(ahead[k] for k in keys) == key:
                row, ahead = ahead, next(rows, None)
                yield row

        group = same()
        yield key, group
        for _ in group:  # what the caller left
            pass


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


Emit = Callable[[tuple, Iterator[dict]], Iterator[tuple]]


def grouped(emit: Emit, keys: list[str], schema: pa.Schema):
    """A function for ``mapInArrow`` that applies ``emit`` to every key of sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row for key, rows in by_key(batches, keys) for row in emit(key, rows)), schema)

    return run
