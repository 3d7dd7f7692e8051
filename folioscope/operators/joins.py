"""Joins, splits and enrichment. Small sides aren't forced: adaptive execution broadcasts what its statistics show to be small."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.shared import written


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pick: Callable) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return out.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order, ascending; each task hands on one row a key, so frequent keys don't meet in one."""
    return _extreme(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    return _extreme(df, keys, order, F.max_by)


def merge_outer(tables: Sequence[DataFrame], order: str | None = None, complete: bool = False, guard: str | None = "cluster_") -> DataFrame:
    """N-way full outer merge on the first column, whose name all tables share.

    Of a table's rows with one key the first by ``order`` (a column of each, then dropped) wins. Columns follow in table
    order. ``complete`` keeps rows whose last column is neither null nor empty. A value that contains ``guard`` is an
    error: a header has slipped into the data.
    """
    key = tables[0].columns[0]
    if any(t.columns[0] != key for t in tables):
        raise ValueError(f"the first columns differ: {[t.columns[0] for t in tables]}")
    names = [key, *(c for t in tables for c in t.columns[1:] if c != order)]
    if len(set(names)) != len(names):
        raise ValueError("columns share a name")
    once = [(first_by(t, [key], order).drop(order) if order else t.dropDuplicates([key])) for t in tables]
    out = reduce(lambda a, b: a.join(b, key, "full"), once)
    if guard:
        text = [c for c, kind in out.dtypes if kind == "string" and c != key]
        check = lambda c: F.when(F.col(c).contains(guard), F.raise_error(F.concat(F.lit("header in data: "), F.col(c))).cast("string")).otherwise(F.col(c))
        out = out.select(*[check(c).alias(c) if c in text else F.col(c) for c in out.columns])
    if complete:
        out = out.filter(F.length(F.col(out.columns[-1]).cast("string")) > 0)
    return out


def positional_join(tables: Sequence[DataFrame], key: str, value: str, order: str) -> DataFrame:
    """N-way outer join that pairs the k-th row of a key with the k-th of the other tables: key, rn, v1..vN.

    Rows of a table are numbered within a key by ``order``, so duplicates never multiply.
    """
    numbered = [
        t.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("rn"), F.col(value).alias(f"v{i}")) for i, t in enumerate(tables, 1)
    ]
    return reduce(lambda a, b: a.join(b, [key, "rn"], "full"), numbered)


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, how: str = "left", default=None, name: str | None = None) -> DataFrame:
    """df with the value that a key has in a table; ``default`` where it has none."""
    own = table.select(F.col(table_key).alias("__key"), F.col(value).alias("__value"))
    out = df.join(own, F.col(key) == F.col("__key"), how).drop("__key")
    got = F.col("__value") if default is None else F.coalesce("__value", F.lit(default))
    return out.withColumn(name or value, got).drop("__value")


def resolve(df: DataFrame, key: str, alias: DataFrame, old: str, new: str) -> DataFrame:
    """Keys replaced by what an alias table says, else as they are."""
    own = alias.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(own, F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).drop("__old", "__new")


def resolve_keys(df: DataFrame, key: str, value: str, alias: DataFrame, old: str, new: str) -> DataFrame:
    """A map with its keys resolved; of keys that become one the last original key wins."""
    both = resolve(df.withColumn("__original", F.col(key)), key, alias, old, new)
    return last_by(both, [key], "__original").select(key, value)


def assert_empty(df: DataFrame, message: str) -> None:
    row = df.first()
    if row is not None:
        raise ValueError(f"{message}: {row}")


def _or_error(ok: Column, value: Column, kind: str, message: str) -> Column:
    """value, or an error when the row is computed."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(value.cast("string"), F.lit("null")))).cast(kind))


def keep_ids(df: DataFrame, key: str, ids: DataFrame, drop_key: bool = False, strict: bool = True) -> DataFrame:
    """Rows whose key is listed; a listed key that no row has is an error, raised by the rows' own plan."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    if strict:
        there = wanted.join(df.withColumn("__there", F.lit(True)), key, "left")
        checked = _or_error(F.col("__there").isNotNull(), F.col(key), dict(df.dtypes)[key], "listed but not in the table")
        out = there.select(*[checked.alias(c) if c == key else F.col(c) for c in df.columns])
        if drop_key:  # the check has to stay in the plan
            out = out.filter(F.col(key).isNotNull())
    else:
        out = df.join(wanted, key, "left_semi")
    return out.drop(key) if drop_key else out


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Keys that are in both lists."""
    return train.select(F.col(train.columns[0])).intersect(test.select(F.col(test.columns[0])))


def train_test(df: DataFrame, key: str, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two lists of keys make two tables; the lists must not meet, and every listed key must exist. Either fault is an error of the rows' own plan."""
    name = train.columns[0]
    both = overlap(train, test).withColumn("__both", F.lit(True))
    checked = _or_error(F.col("__both").isNull(), F.col(name), dict(train.dtypes)[name], "in both lists")
    apart = train.select(name).distinct().join(both, name, "left").select(checked.alias(name))
    return keep_ids(df, key, apart), keep_ids(df, key, test)


def split_by_lists(df: DataFrame, key: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """Adds split: train where the key is in the first list, else test where it is in the second; other rows go."""
    mark = lambda ids, name: ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    out = df.join(mark(train, "__a"), key, "left").join(mark(test, "__b"), key, "left")
    return out.withColumn("split", F.when(F.col("__a"), "train").when(F.col("__b"), "test")).filter("split is not null").drop("__a", "__b")


def enrich(keys: DataFrame, key: str, known: DataFrame, fetch: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(key, terms) from a table, the missing or empty ones fetched; what was fetched and isn't empty is appended.

    ``fetch`` takes distinct missing keys and returns (key, terms). With ``append``, what it returned is written once and read
    by both uses, so each key is fetched once.
    """
    wanted = keys.select(key).distinct()
    have = known.filter(F.size("terms") > 0)
    missing = wanted.join(have, key, "left_anti")
    got = fetch(missing).filter(F.size("terms") > 0).select(key, "terms")
    if append is not None:
        got = written(got, "fetched")
        append(got)
    return wanted.join(have.select(key, "terms").unionByName(got), key, "left")


def fetch_with(call: Callable[[object], list[str] | None], key: str, kind: str = "string") -> Callable[[DataFrame], DataFrame]:
    """A fetch for ``enrich`` that calls a function for each key on the executors; None and errors of the network give null."""

    def run(batches):
        import pandas as pd

        for b in batches:
            got = []
            for k in b[key]:
                try:
                    got.append(call(k))
                except OSError:
                    got.append(None)
            yield pd.DataFrame({key: b[key], "terms": got})

    return lambda df: df.select(key).mapInPandas(run, f"{key} {kind}, terms array<string>")
