"""The Jaccard join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from folioscope.llm import components, near
from tests.llm.fixtures import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    by = {}
    for x, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(x)
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    copies = [0] * len(sets)
    for x, (_, s) in enumerate(sets):
        both = {}
        for g in s:
            for y in by[g]:
                if y > x:
                    both[y] = both.get(y, 0) + 1
        for y, n in both.items():
            if 5 * n >= 4 * (len(s) + len(sets[y][1]) - n):
                links[x] += 1
                links[y] += 1
                same = s == sets[y][1]
                copies[x] += same
                copies[y] += same
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, least[find(x)], links[x], copies[x]) for x, (i, _) in enumerate(sets))


def near_copies(n, seed, words=120):
    rng = random.Random(seed)
    base = ["w%d" % rng.randrange(9999) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(99999)
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    hot = [(10_000 + i, t) for i, t in enumerate(near_copies(60, 1) + near_copies(3, 2, 30) * 5)]
    odd = [(r.doc_id + 20_000, r.text) for r in documents(spark).collect()] + [(None, "a b c d e f g"), (None, None)]
    rows = real + hot + odd
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", near.F.lit("clash")).withColumn("n", near.F.lit("clash"))
    back = list(map(tuple, near.jaccard_join(df, block=8).collect()))
    assert [r for r in back if r[0] is None] == [(None, None, 0, 0)] * 2  # rows without an id come back without links
    got = sorted(r for r in back if r[0] is not None)
    want = brute(rows)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    lost = [w - g for (_, _, g, _), (_, _, w, _) in zip(got, want)]
    assert min(lost) == 0 and sum(lost) <= 0.0005 * sum(r[2] for r in want)


def test_one_of_each_group_stays(spark):
    texts = near_copies(9, 3) + ["short text", "short text", None, None, ""]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)] + [(9, "short text", "en", None, None), (None, "short text", "en", None, None), (50, "other words here", "en", None, None), (50, "other words here", "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = near.one_of_each(df)
    assert out.columns == df.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
    stay = {c for _, c, _, _ in brute([r[:2] for r in rows])}
    assert [i for ok, i in ids if ok] == sorted(stay) and len(ids) == len(stay) + 1
    assert near.one_of_each(df.limit(0)).count() == 0


def test_blocks_follow_shingles(spark, monkeypatch):
    """Buckets of long texts are cut by their shingles, and nothing changes."""
    rows = list(enumerate(near_copies(40, 7, 400))) + [(100 + i, t) for i, t in enumerate(near_copies(2, 7, 400) * 3)] + [(100, near_copies(1, 7, 400)[0])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, near.jaccard_join(df).collect()))
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 2000)
    assert sorted(map(tuple, near.jaccard_join(df).collect())) == want == [tuple(r) for r in brute(rows)]


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="doc_id must hold whole numbers"):
        near.jaccard_join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_sieve_lets_every_id_pass(spark, monkeypatch):
    from folioscope.llm import sieve

    monkeypatch.setattr(sieve, "MOST_WORDS", 128)
    ids = spark.range(0, 3000, 3).withColumn("id", near.F.when(near.F.col("id") > 0, near.F.col("id")))
    for n in (1000, 20, 0):
        got = sieve.maybe(spark.range(3000), near.F.nullif(near.F.col("id"), near.F.lit(0)), ids.limit(n), near.F.col("id"), "in").collect()
        passed = {r.id for r in got if r["in"]}
        assert len(got) == 3000 and {r.id or 0 for r in ids.limit(n).collect()} <= passed
        assert n > 100 or len(passed) < 60


def test_bands_reach_the_recall():
    assert near.BANDS == near.bands_for(0.8) and 1 - (1 - 0.8**near.ROWS) ** near.BANDS >= 0.9999
    rng = np.random.default_rng(5)
    hits = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 90).astype(np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 2**63, 10).astype(np.uint64)])
        s = near.signatures([a, b], near.BANDS, near.ROWS)
        hits += bool((s[0] == s[1]).any())
    assert hits >= 0.98 * 300


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    while True:
        new = dict(label)
        for a, b in edges:
            m = min(new[a], new[b])
            new[a] = new[b] = m
        if new == label:
            break
        label = new
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {v: label[v] for v in linked}
