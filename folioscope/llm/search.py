"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer weights, floor(scale * x). Queries and candidates are dealt into chunks, and every chunk of
queries meets every chunk of candidates in one task. There a query is a sparse row of (term, weight): term by term, its
weight times the postings of that term is scattered into a dense array of scores, one per candidate; a partition around
the k-th score selects the best, ties to the smaller id. The best of all chunks are merged by rank.

Scale: queries grow with the table, so nothing is broadcast. Of n candidates and q queries, in chunks of C and Q, n*(q/Q)
+ q*(n/C) rows move, against n*q*terms multiplications; a task holds one chunk of each and a tile of scores.

Nulls: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Short
vectors count as filled up with zeros. A query's own id is no candidate of it. Rows equal in id and vector count once.
Empty tables give no rows; with fewer than k candidates all are returned. Extra columns are ignored. Scores are exact
also beyond 64 bits while they are compared, and limited to the range of long when returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256.0
K = 5
QUERY_CHUNK = 4096
TILE = 64
#: Bounds on a chunk of candidates; between them there are about 64 chunks.
CANDIDATE_CHUNK = (1024, 65_536)
PARTIAL = "query_id long, vec_id long, score long"


def weights(vector: Column, scale: float = SCALE) -> Column:
    """Integer weights, or null where the vector can't take part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(ids: np.ndarray, rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their weights, rows equal in both once."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    both = np.unique(np.column_stack([ids, out]), axis=0) if len(rows) else np.zeros((0, width + 1), np.int64)
    return both[:, 0], both[:, 1:]


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all pairs, term at a time: each query's weight times the postings of the term."""
    most = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in (queries, candidates)]
    bound = most[0] * most[1] * max(1, queries.shape[1])
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    queries, postings = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    scores = np.zeros((len(queries), candidates.shape[0]), kind)
    for term in range(queries.shape[1]):
        asking = np.flatnonzero(queries[:, term])
        held = np.flatnonzero(postings[term])
        if len(asking) == len(queries) and len(held) == candidates.shape[0]:
            scores += queries[:, term, None] * postings[term]
        elif len(asking) and len(held):
            scores[np.ix_(asking, held)] += queries[asking, term, None] * postings[term][held]
    return scores


def select(query_ids, scores, ids, k: int):
    """(query, id, score) of each query's k best: a partition around the k-th score, then the order of what passes."""
    for q, row in zip(query_ids, scores):
        at = np.flatnonzero(ids != q)
        if len(at) > k:
            own = row[at]
            least = np.partition(own, len(own) - k)[len(own) - k]
            at = at[own >= least]
        best = at[np.lexsort((ids[at], -row[at]))][:k]
        for j in best:
            yield int(q), int(ids[j]), max(-(2**63), min(2**63 - 1, int(row[j])))


def _cell(k: int):
    def run(cell: pa.Table) -> pa.Table:
        asks = np.array(cell.column("asks").to_pylist(), bool)
        ids = cell.column("id").to_numpy()
        rows = cell.column("w").to_pylist()
        width = max(map(len, rows))
        qi, q = _matrix(ids[asks], [r for r, a in zip(rows, asks) if a], width)
        ci, c = _matrix(ids[~asks], [r for r, a in zip(rows, asks) if not a], width)
        out = [x for i in range(0, len(qi), TILE) for x in select(qi[i : i + TILE], accumulate(q[i : i + TILE], c), ci, k)]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE, query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k candidates with the largest inner product with each query."""
    q = queries.select(F.col(key).cast("long").alias("id"), weights(F.col(vector), scale).alias("w")).filter("id is not null and w is not null")
    c = candidates.select(F.col(key).cast("long").alias("id"), weights(F.col(vector), scale).alias("w")).filter("id is not null and w is not null")
    n_q, n_c = q.count(), c.count()
    size = min(max(n_c // 64, CANDIDATE_CHUNK[0]), CANDIDATE_CHUNK[1])
    a, b = max(1, math.ceil(n_q / query_chunk)), max(1, math.ceil(n_c / size))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    cells = q.select(F.lit(True).alias("asks"), "id", "w", own(a).alias("a"), every(b).alias("b")).unionByName(
        c.select(F.lit(False).alias("asks"), "id", "w", every(a).alias("a"), own(b).alias("b"))
    )
    partial = cells.groupBy("a", "b").applyInArrow(_cell(k), PARTIAL)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
