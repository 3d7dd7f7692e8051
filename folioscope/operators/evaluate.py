"""Confusion matrices and the figures drawn from them, in long form (gold, pred, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.schemas import NONE


def _labels(spark, labels: Sequence[str], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred", labels: Sequence[str] | None = None, default: str = NONE) -> DataFrame:
    """(gold, pred, n). A null prediction counts as the default. With labels, every cell is there, and an unknown label is an error."""
    both = df.select(F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit(default)).alias("pred"))
    counts = both.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    if labels is None:
        return counts
    every = [*labels, default] if default not in labels else list(labels)
    # The check is a part of the plan: it looks at the counts, when they are computed.
    known = lambda c: F.when(F.col(c).isin(every), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(c), F.lit("null")))).cast("string")).alias(c)
    counts = counts.select(known("gold"), known("pred"), "n")
    cells = _labels(df.sparkSession, every, "gold").crossJoin(_labels(df.sparkSession, every, "pred"))  # labels are a short list
    return cells.join(counts, ["gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def merge(*matrices: DataFrame) -> DataFrame:
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out.groupBy("gold", "pred").agg(F.sum("n").alias("n"))


def _rates(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f", F.when(p + r <= 1e-6, 0.0).otherwise(2 * p * r / (p + r)))


def label_stats(matrix: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f) of every label that is gold or predicted; from one explode, without a self-join."""
    sides = matrix.select(
        F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(True).alias("is_gold")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("is_gold")))).alias("s"),
        (F.col("gold") == F.col("pred")).alias("right"), "n",
    )
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    is_gold = F.col("s.is_gold")
    out = sides.groupBy(F.col("s.label").alias("label")).agg(
        count(is_gold & F.col("right")).alias("tp"), count(~is_gold & ~F.col("right")).alias("fp"), count(is_gold & ~F.col("right")).alias("fn")
    )
    return _rates(out)


def macro_f(matrix: DataFrame, compat: bool = False) -> DataFrame:
    """One row, macro_f: the mean F over gold labels; compat counts all labels that occur, and the default, as the label set."""
    stats = label_stats(matrix)
    if not compat:
        stats = stats.filter(F.col("tp") + F.col("fn") > 0)
    return stats.agg(F.avg("f").alias("macro_f"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """One row: total, correct, accuracy (NaN where there is nothing to count)."""
    out = matrix.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).cast("long").alias("correct"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(float("nan")))


def binary(df: DataFrame, gold: str, system: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f of two boolean columns."""
    g, s = F.col(gold), F.col(system)
    return _rates(df.agg(F.count_if(g & s).alias("tp"), F.count_if(~g & s).alias("fp"), F.count_if(g & ~s).alias("fn"), F.count_if(~g & ~s).alias("tn")))


def add_counters(df: DataFrame) -> DataFrame:
    """Counters of several runs as one."""
    return _rates(df.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def by_group(df: DataFrame, groups: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The same pairs at group level: labels replaced by their groups; groups: (label, grp)."""
    own = lambda c: groups.select(F.col("label").alias(c), F.col("grp").alias(f"{c}_group"))
    out = df.join(own(gold), gold, "left").join(own(pred), pred, "left")
    return out.drop(gold, pred).withColumnRenamed(f"{gold}_group", gold).withColumnRenamed(f"{pred}_group", pred)


def report(matrix: DataFrame) -> str:
    """Rows of counts by letter, a dot for 0, then each label's figures. Small: as many rows as there are labels."""
    rows = matrix.collect()
    names = sorted({r.gold for r in rows} | {r.pred for r in rows})
    n = {(r.gold, r.pred): r.n for r in rows}

    def letter(i: int) -> str:
        return (letter(i // 26) if i >= 26 else "") + chr(65 + i % 26)

    head = " ".join(f"{letter(i):>5}" for i in range(len(names)))
    body = [" ".join(f"{n.get((g, p), 0) or '.':>5}" for p in names) + f" | {letter(i)} = {g}" for i, g in enumerate(names)]
    stats = [f"{r.label}: {stats_line(r)}" for r in label_stats(matrix).orderBy("label").collect()]
    return "\n".join([head, *body, *stats])


def stats_line(r) -> str:
    return f"P={r.precision:.3f} R={r.recall:.3f} F={r.f:.3f} tp={r.tp} fp={r.fp} fn={r.fn}"
