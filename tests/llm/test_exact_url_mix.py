"""Exact duplicates, URL rules and the mix against plain versions."""

import re
from collections import defaultdict
from fractions import Fraction
from hashlib import sha256

import pytest
from awkward import split, table, texts
from pyspark.sql import functions as F

from windrow.llm import exact_dedup, mixing, rows, url_filter


@pytest.mark.parametrize("limit", [500_000, 0])
def test_exact_groups(spark, limit):
    docs = table(spark).repartition(3)
    got = exact_dedup.exact_groups(docs, carry={"text_sha256": F.sha2(exact_dedup.normalised(docs["text"]), 256)}, broadcast_pairs=limit).collect()
    groups = defaultdict(list)
    for i, t, _ in texts():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(texts())
    kept = defaultdict(int)
    for r in got:
        ids = next(v for k, v in groups.items() if sha256(k.encode()).hexdigest() == r.text_sha256)
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_groups_refine_equal_prefixes(spark):
    long = "p" * 300
    data = [(k, long + tail, "s") for k, tail in enumerate(["aa", "ab", "aa", "b", "ba"])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(table(spark, data)).collect()}
    assert got == {0: (0, 2), 2: (0, 2), 1: (1, 1), 3: (3, 1), 4: (4, 1)}
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_rows_kept(spark):
    docs = table(spark)
    digest = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    kept = rows.only(docs, exact_dedup.exact_groups(docs, carry={"digest": digest}).filter("kept"), digest=digest)
    assert kept.columns == docs.columns
    left = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(left) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in texts()})


RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]
URLS = [
    None, "", "no scheme.org/x", "http://", "http://Example.ORG/es/1", "https://example.org/es", "http://a.b.example.org/en/12?x=/es/", "http://xexample.org/es/", "ftp://org/", "ftp://org", "http://evil.com/x.org/a",
    "http://q.com/fr/#a", "http://q.com/fr", "http://com/de/x", "http://example.org#/es/", "http://a?b://c.org/", "http://spam-farm.net/x", "http://ok.net/spam-farm", "x://y\u00e9.org/\u00fc", "http://h.org/" + "a" * 3000, "http://a\nb.org/en/1",
]


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.action if best else "block" if "spam-farm" in host else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "c", "d") for k, u in enumerate(URLS)] + [(None, URLS[4], "c", "d")], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, RULES, ["*spam-farm*/**", "*spam-farm*"]).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_rule(URLS[4 if r.page_id is None else r.page_id]), r
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


def test_automaton_against_regular_expressions():
    import random

    pick = random.Random(5)
    globs = ["".join(pick.choice(["a", "b", "/", "*", "**", "?", ".", "\\*"]) for _ in range(pick.randint(0, 9))) for _ in range(60)]

    def expression(glob):
        kinds = {"*": "[^/]*", "**": ".*", "?": "."}
        return re.compile("".join(kinds.get(t) or re.escape(t[1]) for t in url_filter.parsed(glob)), re.S)

    strings = ["".join(pick.choice("ab/.*\u00e9") for _ in range(pick.randint(0, 12))) for _ in range(400)]
    fits = url_filter.Automaton(tuple(globs)).fits(strings)
    assert len(url_filter.Automaton(tuple(globs)).masks[3]) > 1  # more than one word of bits
    for g, glob in enumerate(globs):
        one = expression(glob)
        assert [bool(one.fullmatch(s)) for s in strings] == fits[:, g].tolist(), glob


def test_mix_targets(spark):
    data = [(k, " ".join(["w"] * (5 + k * 7 % 90)), None if k % 5 == 0 else f"s{k % 4}") for k in range(600)] + [(None, "a b c", "s1"), (7, None, "zero"), (7, "x y", "s1"), (7, "x y", "s1")]
    got = mixing.mix(table(spark, data), block=4, shard_docs=50).collect()
    again = mixing.mix(table(spark, data).repartition(5), block=4, shard_docs=50).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.source_size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(split(t))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    left, total, target = set(order), Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        free = total - sum(target.values())
        level = free / sum(weight[s] for s in left)
        full = {s for s in left if 2 * sizes[s] <= level * weight[s]}
        if not full:
            break
        target.update({s: Fraction(2 * sizes[s]) for s in full})
        left -= full
    target.update({s: level * weight[s] for s in left})
    expected = {(sizes[s], round(float(target[s]), 6)) for s in order}
    assert {(r.source_size, round(r.target, 6)) for r in got} == expected
    source = {(i, len(split(t))): s for i, t, s in data}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id, r["size"]]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 40), s


def test_apportionment_against_listing_quotients(spark):
    import random

    pick = random.Random(2)
    weights = [pick.randint(0, 50) for _ in range(9)] + [7, 7, 400]
    for seats in (0, 1, 5, 12, 97):
        takers = spark.createDataFrame([(f"t{k:02}", float(w)) for k, w in enumerate(weights)], "_taker string, w double")
        got = {r._taker: r.q for r in mixing.apportioned(takers, "w", F.lit(seats), [], [F.col("_taker")], "q").collect()}
        quotients = sorted((-w / (2 * k + 1), f"t{t:02}", k) for t, w in enumerate(weights) if w for k in range(seats))[:seats]
        want = defaultdict(int)
        for _, t, _ in quotients:
            want[t] += 1
        assert got == {f"t{k:02}": want[f"t{k:02}"] for k in range(len(weights))}, seats


def test_mixed_documents(spark):
    docs = table(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    original = {(i, t) for i, t, _ in texts()}
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert set(got) <= original and all(split(t) for _, t in got)
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixed(table(spark, [(1, None, None)])).count() == 0
