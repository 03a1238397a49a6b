"""Source divergence against counts and sums written out in Python."""

import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest
from awkward import CLASHING
from pyspark.sql import functions as F

from windrow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    terms = lambda text: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    docs, uses, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = terms(text)
        docs[lang].update(set(words))
        uses[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter({t: sum(uses[lang, s][t] for s in sources) for t in kept})

        def rates(counts, kept=kept):
            size = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // size for t in kept}

        p, q = {s: rates(uses[lang, s]) for s in sources}, rates(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            best = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if uses[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(best[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in [*CLASHING, "term", "uses", "total", "value", "item", "docs"]})


def sample(seed, n):
    pick = Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "é", "汉", "zeta", "\U0001f600") for b in ("a", "b", "C", "ü", "x", "yy")]
    rows = []
    for _ in range(n):
        lang, source = pick.choice(["en", "de", None]), pick.choice(["s1", "s2", "S", "", None, "é"])
        some = pick.sample(words, 9) if source == "s1" else words
        rows.append((pick.choice([" ", "-1_", "\n", "`"]).join(pick.choices(some, k=pick.randrange(12))), lang, source))
    return rows + [(None, "en", "s3"), ("", "xx", "only"), ("one two", "yy", "a"), ("...", "yy", "b"), ("\x00 \x7f{}[]", "yy", "b"), ("long " * 300_000 + "é" * 100_000, "en", "s1")]


@pytest.mark.parametrize(("least", "top", "block", "table_size"), [(3, 50, 1 << 15, 400_000), (2, 4, 16, 20)])
def test_audit(spark, least, top, block, table_size):
    rows = sample(least, 160)
    got = divergence.audit(table(spark, rows).repartition(3), least, top, block=block, table=table_size).collect()
    assert sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in got) == plain(rows, least, top)


def test_no_documents(spark):
    assert divergence.audit(table(spark, [])).count() == 0


def test_rates_are_exact(spark):
    cases = [(0, 5), (0, 10**15), (3, 8), (10**12, 10**15 + 7), (8 * 10**14, 9 * 10**14), (17, 23), (2, 3 * 5 + 2)]
    want = [1 + 10**9 * (c + 5) // s for c, s in cases]
    assert divergence.rate(*np.array(cases, np.int64).T).tolist() == want
    df = spark.createDataFrame(cases, "c long, s long")
    assert [r[0] for r in df.select(divergence.rate_of("c", "s")).collect()] == want
