"""Information gain of binarised features, and the features with the most of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, hit, label, n): one pass over the table, counts combined before they move. A null feature counts as 0; rows without a label go."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) != 0).alias("hit")) for f in features]))
    return df.filter(F.col(label).isNotNull()).select(pairs.alias("p"), F.col(label).cast("string").alias("label")).groupBy("p.feature", "p.hit", "label").agg(F.count("*").alias("n"))


def gain(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, gain) in bits from (by..., feature, hit, label, n): H(label) - H(label | hit)."""
    keys = [*by, "feature"]
    total = F.sum("n").over(Window.partitionBy(*keys))
    of_hit = F.sum("n").over(Window.partitionBy(*keys, "hit"))
    of_label = F.sum("n").over(Window.partitionBy(*keys, "label"))
    n = F.col("n")
    # H(label) = -sum over cells of n/N log2(n_label/N); H(label | hit) = -sum over cells of n/N log2(n/n_hit).
    cell = n / F.col("total") * (F.log2(n / F.col("of_hit")) - F.log2(F.col("of_label") / F.col("total")))
    return counts.withColumn("total", total).withColumn("of_hit", of_hit).withColumn("of_label", of_label).groupBy(*keys).agg(F.sum(cell).alias("gain"))


def info_gain(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return gain(contingency(df, features, label))


def one_vs_rest(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(target, feature, gain) of the question 'is the label target?', from the margins of the same counts.

    Of a cell (hit, target) with n rows, the rest of the hit's rows are the answer no; hits that the target never has are all no."""
    counts = contingency(df, features, label)
    total, of_hit = F.sum("n").over(Window.partitionBy("feature")), F.sum("n").over(Window.partitionBy("feature", "hit"))
    cells = counts.withColumn("total", total).withColumn("of_hit", of_hit).withColumn("of_label", F.sum("n").over(Window.partitionBy("feature", "label")))
    n, all_, hit, own = (F.col(c) for c in ("n", "total", "of_hit", "of_label"))
    yes = n / all_ * (F.log2(n / hit) - F.log2(own / all_))
    no = F.when(hit > n, (hit - n) / all_ * (F.log2((hit - n) / hit) - F.log2((all_ - own) / all_))).otherwise(0.0)
    out = cells.groupBy(F.col("label").alias("target"), "feature").agg(F.sum(yes + no).alias("met"), F.first(all_).alias("total"), F.first(own).alias("own"), F.sum("of_hit").alias("seen"))
    never = (F.col("total") - F.col("seen")) / F.col("total")
    return out.select("target", "feature", (F.col("met") + F.when(never > 0, -never * F.log2((F.col("total") - F.col("own")) / F.col("total"))).otherwise(0.0)).alias("gain"))


def top(gains: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The n features with the most gain (for each of ``by``), with their rank; ties to the smaller name."""
    order = (F.desc(F.round("gain", 12)), "feature")
    if not by:
        if gains.count() < n:
            raise ValueError(f"there are fewer than {n} features")
        best = gains.orderBy(*order).limit(n)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows
    return gains.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def select_features(df: DataFrame, features: Sequence[str], label: str, n: int, per_class: bool = False) -> list[str]:
    """Names of the selected features, in table order: the n best, or the union of each label's n best."""
    best = top(one_vs_rest(df, features, label), n, ["target"]) if per_class else top(info_gain(df, features, label), n)
    chosen = {r.feature for r in best.select("feature").distinct().collect()}
    return [f for f in features if f in chosen]


def ranges(indices: Sequence[int]) -> str:
    """1,2,3,7 -> 1-3,7."""
    out: list[list[int]] = []
    for i in sorted(indices):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return ",".join(f"{a}-{b}" if a < b else f"{a}" for a, b in out)


def parse_ranges(text: str, columns: Sequence[str]) -> list[str]:
    """``first,3,5-last`` (from 1) -> column names."""
    place = lambda x: 1 if x == "first" else len(columns) if x == "last" else int(x)
    out: list[str] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = part.partition("-")
        for i in range(place(a), place(b or a) + 1):
            if not 1 <= i <= len(columns):
                raise ValueError(f"no column {i}")
            out.append(columns[i - 1])
    return list(dict.fromkeys(out))


def by_prefix(df: DataFrame, prefix: str, *always: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c.startswith(prefix) or c in always])


def require_numeric(df: DataFrame, *but: str) -> None:
    wrong = [c for c, kind in df.dtypes if c not in but and kind not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kind.startswith("decimal")]
    if wrong:
        raise TypeError(f"not numeric: {wrong}")
