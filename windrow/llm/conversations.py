"""Repair of conversations at least cost, with the least record of the edits.

A repaired conversation is empty or has an optional system turn, then user and
assistant turns in pairs. Rows are kept (K), get another role (R) or are deleted
(D); turns without text are inserted (I). The record (audit) is the cheapest
edits' letters in order, and of equally cheap ones the least in ASCII.

1. Faults come from column expressions and one aggregate over equal messages of a
   conversation. Rows without their texts are sorted by range, so a conversation
   with a third of all rows is many partitions, and each stretch of at most
   ``block`` rows becomes one byte string.
2. Cost: a block acts on the four states of the grammar as a matrix of least
   costs. Blocks of one conversation are scanned level by level, at most ``fan`` in a
   group; the scan gives every block the costs of all that follows it.
3. Prefix doubling: the nodes (row, state) of a block keep the arcs that lie on
   cheapest paths. They are ranked by the least audit of length 1, 2, 4, ... from
   there: a rank of length 2n is the order of (own rank of length n, rank of length n
   of the node that n letters lead to), and pointers double alongside. A letter leads
   from a node to one node only, since inserted and new roles are fixed by the state,
   so the node that n letters lead to is a function. The doubled pointers mark the nodes of the least
   path and count its letters. A second scan carries the state at each block's start.
4. Texts are shuffled once, by conversation and in order, and rewritten as they pass;
   no conversation is held in memory but for its audit, a letter a turn. A digest of one conversation
   is sequential, so its rows pass one task, as a stream.

Cases: null ids form one conversation; null turns come first; rows of one turn go by
role, then by the SHA-256 of their text; null role or text count as one space; texts
of any length pass as they are; repeated rows are duplicates but the first; roles are known
by their first letter (s, u, a), others can only be reroled or deleted; a conversation
without rows has zeros and an empty audit; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from windrow.llm.rows import named
from windrow.llm.store import saved

WHITE = " \t\n\x0b\x0c\r"
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # by the first letter of the role
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, RECAST, INSERT, CUT = 2, 1, 5, 5  # costs; CUT is added to a truncated row that stays
FAR = 1 << 50

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, BEGUN, OPEN, CLOSED = range(4)
NEXT = np.array([OPEN, OPEN, CLOSED, OPEN])  # after a turn of the role that the state asks for
KEPT = np.full((4, 4), -1)  # [state, kind of the row]
KEPT[EMPTY, SYSTEM] = BEGUN
KEPT[[EMPTY, BEGUN, CLOSED], USER] = OPEN
KEPT[OPEN, ASSISTANT] = CLOSED
LAST = np.array([0, 2 * INSERT, INSERT, 0])  # cost of ending in a state
START = np.array([0, FAR, FAR, FAR])
LETTERS = np.frombuffer(b"DIKR", np.uint8)  # in ASCII order
ROLES = {EMPTY: "user", BEGUN: "user", OPEN: "assistant", CLOSED: "user"}


# --- one batch of blocks -------------------------------------------------------------------------


def _costs(codes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Least cost from every node (block, row, state) on, given that after the blocks; ``codes`` is 255 before a block's first row."""
    n, length = codes.shape
    kind, fault = codes % 4, codes // 4
    out = np.empty((n, length + 1, 4), np.int64)
    out[:, length] = tails
    extra = np.select([fault == TRUNCATED, (fault == BLANK) | (fault == DUPLICATE)], [CUT, FAR], 0)
    for t in range(length - 1, -1, -1):
        after = out[:, t + 1]
        kept = np.take_along_axis(after, np.maximum(KEPT.T[kind[:, t]], 0), 1) + np.where(KEPT.T[kind[:, t]] < 0, FAR, 0)
        base = np.minimum(DELETE + after, extra[:, t, None] + np.minimum(kept, RECAST + after[:, NEXT]))
        step = np.minimum(base, np.minimum(INSERT + base[:, NEXT], 2 * INSERT + base[:, NEXT[NEXT]]))
        out[:, t] = np.minimum(np.where(codes[:, t, None] == 255, after, step), FAR)
    return out


def _ranked(codes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Letter, rank, doubled pointers and letters to come of every node, numbered by block, row and state."""
    n, length = codes.shape
    kind, fault = (codes % 4)[..., None], (codes // 4)[..., None]
    state = np.arange(4)
    here, after = costs[:, :-1], costs[:, 1:]
    node = np.arange(n * (length + 1) * 4).reshape(n, length + 1, 4)
    extra = np.select([fault == TRUNCATED, (fault == BLANK) | (fault == DUPLICATE)], [CUT, FAR], 0)
    keeps = KEPT[state, kind]
    cost = np.stack([
        DELETE + after,
        INSERT + here[..., NEXT],
        extra + np.take_along_axis(after, np.maximum(keeps, 0), 2) + np.where(keeps < 0, FAR, 0),
        extra + RECAST + after[..., NEXT],
    ])
    target = np.stack([node[:, 1:], node[:, :-1, NEXT], np.take_along_axis(node[:, 1:], np.maximum(keeps, 0), 2), node[:, 1:, NEXT]])
    first = np.argmax(cost == here, axis=0)  # the least letter of an optimal arc
    letter = np.full(node.shape, -1)
    pointer = node.copy()
    letter[:, :-1] = np.where((codes == 255)[..., None], -1, first)
    pointer[:, :-1] = np.where((codes == 255)[..., None], node[:, :-1], np.take_along_axis(target, first[None], 0)[0])
    letter, jump = letter.ravel(), pointer.ravel()
    rank, left, jumps = letter + 1, (letter >= 0).astype(np.int64), []
    while True:
        jumps.append(jump)
        if not (letter[jump] >= 0).any():
            return letter, rank, jumps, left
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)
        left = left + left[jump]
        jump = jump[jump]


def _laid(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``codes`` and a table with a row each, ends aligned, of at most some 10^5 cells."""
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(-sizes, kind="stable")
    while len(order):
        width = int(sizes[order[0]])
        part, order = np.split(order, [max(1, (1 << 17) // max(width, 1))])
        table = np.full((len(part), width), 255, np.uint8)
        for row, at in zip(table, part):
            row[width - len(codes[at]) :] = np.frombuffer(codes[at], np.uint8)
        yield part, table


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least cost between the states before and after each block."""
    for f in frames:
        out = [None] * len(f)
        for part, table in _laid(list(f["codes"])):
            costs = np.stack([_costs(table, np.where(np.arange(4) == s, 0, FAR))[:, 0] for s in range(4)], axis=2)
            for at, m in zip(part, costs):
                out[at] = m.ravel().tolist()
        yield pd.DataFrame({"name": f["name"], "place": f["place"], "matrix": out})


def _exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matrix of 0 from each state before a block to the one that the least path leaves it in."""
    for f in frames:
        out = [None] * len(f)
        tails = np.array(f["tail"].tolist(), np.int64).reshape(-1, 4)
        for part, table in _laid(list(f["codes"])):
            jumps = _ranked(table, _costs(table, tails[part]))[2]
            begin = np.arange(len(part)) * (table.shape[1] + 1) + table.shape[1] - np.array([len(f["codes"].iloc[a]) for a in part])
            ends = jumps[-1][begin[:, None] * 4 + np.arange(4)] % 4
            for at, e in zip(part, ends):
                out[at] = np.where(np.arange(4) == e[:, None], 0, FAR).ravel().tolist()
        yield pd.DataFrame({"name": f["name"], "place": f["place"], "matrix": out})


def _audits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Letters of the least path through each block."""
    for f in frames:
        out = [b""] * len(f)
        tails, entries = (np.array(f[c].tolist(), np.int64).reshape(-1, 4) for c in ("tail", "entry"))
        for part, table in _laid(list(f["codes"])):
            letter, _, jumps, left = _ranked(table, _costs(table, tails[part]))
            width = table.shape[1]
            begin = np.arange(len(part)) * (width + 1) + width - np.array([len(f["codes"].iloc[a]) for a in part])
            marked = np.zeros(len(letter), bool)
            marked[begin * 4 + np.argmin(entries[part], axis=1)] = True
            for jump in jumps:
                marked[jump[marked]] = True
            path = np.flatnonzero(marked & (letter >= 0))
            owner = path // ((width + 1) * 4)
            path = path[np.lexsort((-left[path], owner))]
            texts = LETTERS[letter[path]].tobytes()
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            for at, a, b in zip(part, ends, ends[1:]):
                out[at] = texts[a:b]
        yield pd.DataFrame({"name": f["name"], "place": f["place"], "codes": f["codes"], "letters": out})


# --- blocks of a conversation --------------------------------------------------------------------


def _scan(blocks: DataFrame, edge: np.ndarray, forward: bool, fan: int) -> DataFrame:
    """``name``, ``place``, ``vector``: least costs from ``edge`` to each block (``matrix``), from before it or from after it.

    At most ``fan`` blocks are one group; longer conversations go through groups of ``fan`` blocks and a scan over those.
    """
    side = (lambda m: m.T) if forward else (lambda m: m)  # row: the side of the result

    def joined(f: pd.DataFrame) -> list[np.ndarray]:
        return [side(np.array(m, np.int64).reshape(4, 4)) for m in f.sort_values("place", ascending=forward)["matrix"]]

    def composed(f: pd.DataFrame) -> pd.DataFrame:
        total = np.where(np.eye(4, dtype=bool), 0, FAR)
        for m in joined(f):
            total = np.minimum((m[:, :, None] + total[None]).min(axis=1), FAR)
        return pd.DataFrame({"name": [f["name"].iloc[0]], "place": [f["cell"].iloc[0]], "matrix": [side(total).ravel().tolist()]})

    def walked(f: pd.DataFrame) -> pd.DataFrame:
        vector, out = np.array(f["edge"].iloc[0], np.int64), []
        for m in joined(f):
            out.append(vector.tolist())
            vector = np.minimum((m + vector).min(axis=1), FAR)
        return pd.DataFrame({"name": f["name"], "place": f["place"].sort_values(ascending=forward).to_numpy(), "vector": out})

    many = blocks.groupBy("name").agg(F.count(F.lit(1)).alias("many"))
    cell = F.expr(f"if(many <= {fan}, -1L, place div {fan})")
    cells = saved(blocks.join(many, "name").select("name", "place", "matrix", cell.alias("cell")), "cells")
    if cells.filter("cell >= 0").isEmpty():
        edged = cells.withColumn("edge", F.array(*[F.lit(int(x)).cast("bigint") for x in edge]))
    else:
        over = cells.groupBy("name", "cell").applyInPandas(composed, "name string, place long, matrix array<long>")
        outer = _scan(over, edge, forward, fan)
        apart = outer.select("name", F.col("place").alias("cell"), F.col("vector").alias("edge"))
        edged = cells.join(apart, ["name", "cell"])
    return edged.groupBy("name", "cell").applyInPandas(walked, "name string, place long, vector array<long>")


def _stretches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Byte strings of at most ``block`` codes from rows (name, code) in order, numbered upwards over the whole table."""
    place = TaskContext.get().partitionId() << 33
    name, codes = None, b""
    for batch in batches:
        names, values = batch[0].to_pylist(), batch[1].to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        done: list[tuple[str, bytes]] = []
        begin = 0
        for at in range(1, len(names) + 1):
            if at == len(names) or names[at] != names[begin]:
                if names[begin] != name and codes:
                    done.append((name, codes))
                    codes = b""
                name, codes = names[begin], codes + values[begin:at]
                while len(codes) > block:
                    done.append((name, codes[:block]))
                    codes = codes[block:]
                begin = at
        yield _block_rows(done, place)
        place += len(done)
    if codes:
        yield _block_rows([(name, codes)], place)


def _block_rows(done: list[tuple[str, bytes]], place: int) -> pa.RecordBatch:
    columns = [pa.array([n for n, _ in done], pa.string()), pa.array(range(place, place + len(done)), pa.int64()), pa.array([c for _, c in done], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["name", "place", "codes"])


def _messages(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Named conversations with nulls filled: ``name``, ``conv``, ``turn``, ``role``, ``text``, ``digest`` (SHA-256 of the text)."""
    role, text = (F.coalesce(turns[c], F.lit(" ")) for c in (role_col, text_col))
    return turns.select(named(turns[conv_col]).alias("name"), turns[conv_col].alias("conv"), turns[turn_col].cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def edits(messages: DataFrame, block: int = 4096, fan: int = 1024) -> DataFrame:
    """``name``, ``place`` (upwards in a conversation), ``codes`` (kind and fault a row) and ``letters`` of each block."""
    tail = F.rtrim(F.col("text"), F.lit(WHITE))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", SYSTEM, "u", USER, "a", ASSISTANT)]), F.substring("role", 1, 1)), F.lit(OTHER))
    fault = F.when(tail == "", BLANK).when(~F.substring(tail, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    light = messages.select("name", "turn", "role", "digest", kind.alias("kind"), fault.alias("fault"), F.monotonically_increasing_id().alias("row"))
    light = saved(light, "messages")
    same = ["name", "role", "digest"]
    first = light.groupBy(*same).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    judged = light.join(first.select(*same, F.col("first.row").alias("first")), same, "left")
    again = F.coalesce(F.col("row") != F.col("first"), F.lit(False))
    code = F.col("kind") + 4 * F.when(F.col("fault") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("fault"))
    order = ["name", F.asc_nulls_first("turn"), "role", "digest", again]
    placed = judged.withColumn("code", code.cast("tinyint")).repartitionByRange(*order).sortWithinPartitions(*order).select("name", "code")
    blocks = saved(placed.mapInArrow(lambda rows: _stretches(rows, block), "name string, place long, codes binary"), "blocks")

    several = blocks.groupBy("name").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("name")
    long = saved(blocks.join(several, "name", "left_semi"), "blocks")
    shape = "name string, place long, matrix array<long>"
    tails = saved(_scan(long.mapInPandas(_matrices, shape), LAST, False, fan).withColumnRenamed("vector", "tail"), "tails")
    entries = _scan(long.join(tails, ["name", "place"]).mapInPandas(_exits, shape), START, True, fan).withColumnRenamed("vector", "entry")
    whole = lambda edge: F.array(*[F.lit(int(x)).cast("bigint") for x in edge])
    known = blocks.join(tails, ["name", "place"], "left").join(entries, ["name", "place"], "left")
    known = known.select("name", "place", "codes", F.coalesce("tail", whole(LAST)).alias("tail"), F.coalesce("entry", whole(START)).alias("entry"))
    return known.mapInPandas(_audits, "name string, place long, codes binary, letters binary")


# --- texts ---------------------------------------------------------------------------------------


class _Walk:
    """One conversation as it passes: letters first, then rows in order."""

    def __init__(self, conv: object):
        self.conv, self.state, self.at, self.position = conv, EMPTY, 0, 0
        self.codes, self.letters = bytearray(), bytearray()
        self.turns = [None, None, 0]  # least, last, distinct

    def _turn(self, role: str, text: str, letter: str, turn: int | None) -> tuple:
        self.position += 1
        return self.conv, self.position, letter, turn, role, text

    def _filled(self) -> Iterator[tuple]:
        """Turns inserted before the next row."""
        while self.at < len(self.letters) and self.letters[self.at] == ord("I"):
            yield self._turn(ROLES[self.state], "", "I", None)
            self.state = NEXT[self.state]
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        yield from self._filled()
        letter = chr(self.letters[self.at])
        if letter != "D":
            kind = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
            yield self._turn(role if letter == "K" else ROLES[self.state], text, letter, turn)
            self.state = KEPT[self.state, kind] if letter == "K" else NEXT[self.state]
        self.at += 1

    def close(self) -> Iterator[tuple]:
        self.letters += b"I" * (LAST[self.state] // INSERT)
        yield from self._filled()

    def totals(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        letters = np.frombuffer(bytes(self.letters), np.uint8)
        faults = np.bincount(codes // 4, minlength=4)
        joints = codes[:-1] % 4 * 4 + codes[1:] % 4
        legal = np.isin(joints, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
        rows = letters[letters != ord("I")]
        cost = DELETE * int((rows == ord("D")).sum()) + RECAST * int((rows == ord("R")).sum()) + INSERT * (len(letters) - len(rows)) + CUT * int(((rows != ord("D")) & (codes // 4 == TRUNCATED)).sum())
        gaps = 0 if self.turns[0] is None else self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return (self.conv, gaps, *(int(faults[k]) for k in (BLANK, DUPLICATE, TRUNCATED)), int((~legal).sum()), cost, self.letters.decode())


def _walked(batches: Iterator[pa.RecordBatch], digests: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repaired turns, or a row of totals and a digest a conversation, of rows sorted by name, mark and order."""
    out, weight, name, walk, hashed = [], 0, None, None, None

    def put(turns: Iterator[tuple]) -> None:
        nonlocal weight
        for t in turns:
            if digests:
                hashed.update((("\n" if t[1] > 1 else "") + t[4] + ":" + t[5]).encode())
            else:
                out.append(t)
                weight += len(t[5]) + 50

    def close() -> None:
        put(walk.close())
        if digests:
            out.append((*walk.totals(), hashed.hexdigest()))

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        out.clear()
        return batch

    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            for key, mark, conv, turn, role, text, codes, letters in zip(*(part[c].to_pylist() for c in ("name", "mark", "conv", "turn", "role", "text", "codes", "letters"))):
                if key != name:
                    if walk:
                        close()
                    name, walk, hashed = key, _Walk(conv), sha256()
                if mark == 1:
                    walk.codes += codes
                    walk.letters += letters
                elif mark == 2:
                    put(walk.row(turn, role, text))
                if weight > 4_000_000:
                    yield rows()
                    weight = 0
            if len(out) > 2_000:
                yield rows()
    if walk:
        close()
    yield rows()


def _stream(turns: DataFrame, names: DataFrame, columns: tuple[str, str, str, str], digests: bool, block: int, fan: int) -> DataFrame:
    messages = _messages(turns, *columns)
    kind = turns.schema[columns[0]].dataType.simpleString()
    done = edits(messages, block, fan)
    nothing = lambda t: F.lit(None).cast(t)
    ids = names.select(named(names[columns[0]]).alias("name"), F.lit(0).alias("mark"), names[columns[0]].alias("conv")).distinct()
    ids = ids.select("*", nothing("long").alias("place"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("binary").alias("digest"), nothing("binary").alias("codes"), nothing("binary").alias("letters"))
    blocks = done.select("name", F.lit(1).alias("mark"), nothing(kind).alias("conv"), "place", nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("binary").alias("digest"), "codes", "letters")
    rows = messages.select("name", F.lit(2).alias("mark"), "conv", nothing("long").alias("place"), "turn", "role", "text", "digest", nothing("binary").alias("codes"), nothing("binary").alias("letters"))
    order = ["name", "mark", "place", F.asc_nulls_first("turn"), "role", "digest"]
    stream = ids.union(blocks).union(rows).repartition("name").sortWithinPartitions(*order)
    columns_out = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" if digests else "position long, edit string, turn long, role string, text string"
    out = f"conv {kind}, {columns_out}"
    schema = to_arrow_schema(StructType.fromDDL(out))
    return stream.mapInArrow(lambda batches: _walked(batches, digests, schema), out).withColumnRenamed("conv", "conv_id")


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 4096, fan: int = 1024) -> DataFrame:
    """The turns of every repaired conversation: ``conv_id``, ``position`` (from 1), ``edit`` (K, R or I), ``turn`` (null if inserted), ``role``, ``text``."""
    return _stream(turns, turns, (conv_col, turn_col, role_col, text_col), False, block, fan)


def audited(turns: DataFrame, names: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 4096, fan: int = 1024) -> DataFrame:
    """One row a conversation of ``turns`` and of ``names`` (a table with ``conv_col``).

    ``conv_id``, ``gaps`` (turn numbers missing between least and greatest), ``blank``, ``duplicate``, ``truncated`` (rows by first
    fault), ``illegal`` (adjacent rows out of order), ``cost``, ``audit``, ``repaired_sha256`` (of ``role:text`` lines).
    """
    return _stream(turns, turns if names is None else names, (conv_col, turn_col, role_col, text_col), True, block, fan)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Test damage by crc32 of ``conv:turn``: rows dropped, emptied, stripped of end marks, repeated, given to the user."""
    said = [F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in (conv_col, turn_col, role_col, text_col)]
    fate = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3])
    rows = turns.filter(fate != 0).select(turns[conv_col], turns[turn_col], F.when(fate == 4, "user").otherwise(said[2]).alias(role_col), text.alias(text_col), F.when(fate == 3, 2).otherwise(1).alias("_windrow_times"))
    return rows.withColumn("_windrow_times", F.explode(F.sequence(F.lit(1), "_windrow_times"))).drop("_windrow_times")
