"""Connected components of an edge table by alternating stars, all in joins and aggregations.

A round moves every larger neighbour of a vertex to its least neighbour, then every vertex's smaller neighbours; after a
few rounds each component is a star around its least vertex. Minima are partly aggregated before they move, so a vertex
with a third of all edges is no obstacle; joins deal each vertex's edges over SALTS tasks, and adaptive execution can split
these further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import forget, kept

SALTS = 16


def _met(e: DataFrame, least: DataFrame) -> DataFrame:
    """e with the least of u, dealt over salts, so that a vertex with very many edges isn't one task's."""
    each = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(each, ["u", "salt"]).drop("salt")


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _met(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(e, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60, made: list | None = None) -> DataFrame:
    """(vertex, component) of all vertices of edges (a, b); a component is named by its least vertex. The table that is read is put on ``made``."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = kept(e, "edges")
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        new = kept(_small(_large(e)), "edges")
        after = _state(new)
        forget(e)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    if made is not None:
        made.append(e)
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
