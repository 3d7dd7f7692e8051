"""Exact search against all pairs in plain Python."""

import math

import numpy as np

from folioscope.llm import search


def brute(rows, asks, k):
    ok = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, w in ok:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(w, x)), i) for i, x in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_search_equals_brute_force(spark, sf_dir):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (rng.random(6) < 0.6)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [rows[50], rows[100]]
    rows += [(2000, None), (2050, [1.0, None, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2200, []), (2250, [1.5, -2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "vec_id")
    got = search.top_k(df.filter("vec_id % 50 = 0"), df, k=5, query_chunk=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0, 5)
    real = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in real.collect()], lambda i: i % 50 == 0, 5)
    assert sorted(map(tuple, search.top_k(real.filter("vec_id % 50 = 0"), real).collect())) == want


def test_few_candidates_and_large_values(spark):
    df = spark.createDataFrame([(0, [3.0e9, 1.0]), (1, [3.0e9, 2.0]), (50, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, search.top_k(df.filter("vec_id % 50 = 0"), df).collect()))
    assert got == [(0, 1, 1, min(2**63 - 1, (3 * 10**9 * 256) ** 2 + 256 * 512)), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0
