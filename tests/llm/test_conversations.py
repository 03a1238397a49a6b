"""Conversation repair against a plain recursion over all edits."""

from functools import lru_cache
from hashlib import sha256
from random import Random
from zlib import crc32

import numpy as np
import pytest
from awkward import CLASHING
from pyspark.sql import functions as F

from windrow.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def step(state, kind):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, kind))

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if to := step(state, role[0]):
                    cost, audit, lines = best(i, to, inserts + 1)
                    options.append((cost + 5, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                cut = 5 if faults[i] == "truncated" else 0
                for letter, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if to := step(state, new[:1]):
                        cost, audit, lines = best(i + 1, to, 0)
                        options.append((cost + price + cut, letter + audit, (f"{new}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *best(0, "", 0))


def random_rows(seed, conversations_, most):
    pick = Random(seed)
    texts = ["Yes.", "no", "What?", "", " \t", "Go on!  \n", "cut off", None, "a.b", "éè 汉."]
    rows = []
    for c in range(conversations_):
        size = pick.randrange(most)
        role = 0
        for t in range(size):
            role = 1 - role if pick.random() < 0.7 else role
            name = pick.choice(["system", None, "other", "", "User"]) if pick.random() < 0.15 else ("user", "assistant")[role]
            rows.append((c if c else None, pick.choice([t, t, t, t * 2, None]), name, pick.choice(texts) if pick.random() < 0.6 else f"text {pick.random()}."))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in [*CLASHING, "name", "mark", "place", "first", "many"]})


def grouped(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


@pytest.mark.parametrize(("block", "fan", "most"), [(4096, 1024, 14), (2, 2, 30)])
def test_repair(spark, block, fan, most):
    rows = random_rows(block, 60, most)
    want = {c: plain(r) for c, r in grouped(rows).items()}
    turns = table(spark, rows).repartition(3)
    got = {r.conv_id: r for r in conversations.audited(turns, block=block, fan=fan).collect()}
    assert got.keys() == want.keys()
    for c, (*counts, cost, audit, lines) in want.items():
        r = got[c]
        assert ([r.gaps, r.blank, r.duplicate, r.truncated, r.illegal], r.cost, r.audit) == (counts, cost, audit), grouped(rows)[c]
        assert r.repaired_sha256 == sha256("\n".join(lines).encode()).hexdigest()
    lines = {}
    for r in sorted(conversations.repaired(turns, block=block, fan=fan).collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: list(w[-1]) for c, w in want.items() if w[-1]}


def test_long_conversation_and_none(spark):
    long = [(7, t, ("user", "assistant")[t % 2], f"turn {t}" + "." * (t % 5 > 0)) for t in range(3000)] + [(8, 0, "user", "x" * 2_000_000 + ".")] + [(9, 1, "user", "Again.")] * 50
    whole = {r.conv_id: r for r in conversations.audited(table(spark, long)).collect()}
    cut = {r.conv_id: r for r in conversations.audited(table(spark, long), block=100, fan=4).collect()}
    assert whole == cut and whole[8].audit == "D" and whole[9].audit == "D" * 50 and whole[9].duplicate == 49 and whole[9].cost == 100
    none = table(spark, [])
    assert conversations.audited(none).count() == 0 and conversations.repaired(none).count() == 0
    alone = conversations.audited(none, names=table(spark, [(3, 0, "user", "a"), (None, 0, "user", "b")])).collect()
    assert sorted((str(r.conv_id), r.gaps, r.blank, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in alone) == [(c, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for c in ("3", "None")]


def test_ranks_order_audits():
    codes = np.frombuffer(bytes(Random(1).choices([0, 1, 2, 3, 4 + 1, 8 + 2, 12 + 1, 12 + 2], k=40)), np.uint8)[None]
    letter, rank, jumps, left = conversations._ranked(codes, conversations._costs(codes, conversations.LAST[None]))
    audits = []
    for node in range(len(letter)):
        text = ""
        while letter[node] >= 0:
            text, node = text + "DIKR"[letter[node]], jumps[0][node]
        audits.append(text)
    assert [len(a) for a in audits] == list(left)
    by_rank = sorted(range(len(rank)), key=lambda v: rank[v])
    assert [audits[v] for v in by_rank] == sorted(audits)


def test_damage(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Hm. {t}?!") for c in range(6) for t in range(12)] + [(None, 3, None, None), (4, None, "user", "a.")]
    want = []
    for c, t, r, x in rows:
        fate = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fate == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if fate == 2 else x
        want += [(c, t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = [tuple(r) for r in conversations.damaged(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
