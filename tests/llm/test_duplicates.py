"""Repeated passages, near-duplicates and the pipeline against plain versions."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from awkward import split, table, texts, words
from pyspark.sql import functions as F

from windrow.llm import near_dedup, phrase_dedup
from windrow.llm.components import components
from windrow.llm.hash_filter import built
from windrow.llm.words import mix

SF = "/root/testdata/sf0.001"


def plain_passages(rows, size):
    count = Counter()
    for _, t in rows:
        w = split(t)
        count.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = Counter()
    for i, t in rows:
        w = split(t)
        gone = {p for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for p in range(k, k + size)}
        out[i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()] += 1
    return out


@pytest.mark.parametrize(("size", "gram"), [(35, 8), (5, 2)])
def test_passages(spark, size, gram):
    rows = [(i, t) for i, t, _ in texts() if i != 40] + [(500 + k, " ".join(words(k % 5, 20 + k % 9, 30) + words(99, 50, 60)[k % 7 :])) for k in range(60)]
    docs = table(spark, [(i, t, None) for i, t in rows])
    got = phrase_dedup.deduplicated(docs, size=size, gram=gram, shard_pieces=3).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain_passages(rows, size)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed for r in got)


def test_passages_without_windows(spark):
    assert phrase_dedup.deduplicated(table(spark, [])).count() == 0
    assert [r.n_removed for r in phrase_dedup.deduplicated(table(spark, [(1, "a b", None), (2, None, None)])).collect()] == [0, 0]


def shingles(text, width):
    w = [x.lower() for x in split(text)]
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def plain_groups(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    smallest = lambda k: min([i for i in least[root(k)] if i is not None], default=None) if sets[k] else rows[k][0]
    return Counter((i, len(sets[k]), smallest(k), i == smallest(k)) for k, (i, _) in enumerate(rows))


def families():
    """Two large families of edited copies, whose members are often unlike each other, and chains."""
    rows, base = [], words(77, 60, 10_000)
    for k in range(120):
        w = list(base if k % 2 else base[:30] + words(78, 30, 10_000))
        for e in range(k % 7):
            w[(k * 11 + e * 17) % 60] = f"edit{k}x{e}"
        rows.append((1000 - k, " ".join(w)))
    chain = words(80, 40, 10_000)
    for k in range(12):
        rows.append((2000 + (k * 5) % 12, " ".join(chain[2 * k :] + words(81, 40, 10_000)[: 2 * k])))
    return rows


@pytest.mark.parametrize(("width", "block"), [(2, 512), (5, 7)])
def test_near_groups(spark, width, block):
    rows = [(i, t) for i, t, _ in texts()] + families()
    got = near_dedup.near_groups(table(spark, [(i, t, None) for i, t in rows]), shingle=width, block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain_groups(rows, width)


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(table(spark, [])).count() == 0
    got = near_dedup.near_groups(table(spark, [(5, None, None), (None, "", None), (7, "a", None)])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(5, 5, True), (None, None, True), (7, 7, True)])


def test_near_stage_drops_what_is_marked_whatever_the_ids(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(200)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (20, 90, 150)]
    apart = " ".join(f"v{k}" for k in range(80))
    data = [(5, near[0], "s"), (3, " ".join(base), "s"), (5, apart, "s"), (None, near[1], "s"), (None, "a text of its own without an id", "s"), (7, near[2], None)]
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, data), SF)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, " ".join(base)), (5, apart), (None, "a text of its own without an id")])


def test_tables_from_pairs_of_half_keys():
    halves = near_dedup.half_keys(mix(np.arange(1, 51, dtype=np.uint64)), mix(np.arange(1, 73, dtype=np.uint64)) | np.uint64(1), 3)
    keys = near_dedup.table_keys(np.stack([halves, halves[::-1]]))
    assert halves.shape == (24,) and keys.shape == (2, 144) and len(np.unique(keys)) == 288


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(-7, 500), (500, -7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 140)} | {-7: -7, 500: -7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_filter_passes_its_hashes(spark):
    hashes = mix(np.arange(5000, dtype=np.uint64)).view(np.int64)
    table_of = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    small, none = built(table_of, 5000), built(table_of.limit(0), 0)
    assert small.passing(hashes.view(np.uint64)).all() and not none.passing(hashes.view(np.uint64)).any()
    assert small.passing(mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))).mean() < 0.01


@pytest.mark.skipif(not Path(SF).exists(), reason="the supplied tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
    toxic, exact, near, mixed = counts[1:]
    assert counts[0] >= toxic >= exact >= near > 0
    assert docs.select("doc_id").distinct().count() <= near
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == mixed and out.filter("n_tokens != size(ids)").count() == 0
    assert corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").exceptAll(out.select("doc_id", "ids_sha256")).count() == 0


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, texts() + [(i, t, None) for i, t in families()], extra=False).withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_groups_of_loose_variants(spark):
    """Pairs above the similarity whose entries belong to hubs that are like neither of them."""
    import random

    pick, rows = random.Random(4), []
    for k in range(300):
        one = [f"w{x}" if pick.random() < 0.9 else f"v{k}x{x}" for x in range(80)]
        two = [f"u{k}x{x}" if x < 8 else w for x, w in enumerate(one)]
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    got = near_dedup.near_groups(table(spark, [(i, t, None) for i, t in rows]), shingle=1, near=0.75).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain_groups(rows, 1)
