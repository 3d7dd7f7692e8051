"""Column builders that the native operators share: only Spark SQL functions, no Python code on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: What separates words: the space and the five ASCII control characters from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SPAN = "array<struct<s:int,e:int,m:string>>"


def prefix(df: DataFrame) -> str:
    """What no column's name begins with, for columns of an operator's own."""
    out = "__"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def whole_id(df: DataFrame, key: str) -> Column:
    """The id column as a long; a TypeError where it holds no whole numbers."""
    if not isinstance(df.schema[key].dataType, IntegralType | NullType):
        raise TypeError(f"{key} must hold whole numbers, not {df.schema[key].dataType.simpleString()}")
    return F.col(f"`{key}`").cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def keep_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """df.filter(condition), where the condition's columns are computed once, below the filter.

    The optimizer would move a filter below the projection that makes its columns and so write their expressions out in
    it, once for each mention. It doesn't move a filter past a column that isn't deterministic.
    """
    condition = F.expr(condition) if isinstance(condition, str) else condition
    at = f"{prefix(df)}at"
    return df.withColumn(at, F.monotonically_increasing_id()).filter(condition & (F.col(at) >= 0)).drop(at)


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null, empty and blank texts."""
    core = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def found(text: Column, pattern: str) -> Column:
    """All matches of pattern, leftmost and non-overlapping, as (s, e, m): code points, end exclusive.

    Java gives no positions to SQL, but the pieces between matches have lengths: a running sum of
    piece and match lengths places each match. Texts without a match pay for one scan only.
    """
    parts = F.zip_with(
        F.split(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("m")),
    )
    none = F.array().cast(SPAN)

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + p["gap"]
        end = start + F.coalesce(p["n"], F.lit(0))
        one = F.array(F.struct(start.alias("s"), end.alias("e"), p["m"].alias("m")))
        return F.struct(end.alias("pos"), F.when(p["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    placed = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), placed).otherwise(none)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind, in the sort order start, kind, end."""
    return F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k"), x["m"].alias("m")
        ),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def apart(spans: Column, key: str = "out") -> Column:
    """Of sorted spans, those that don't overlap one kept before them."""
    kind = "array<struct<s:int,o:int,e:int,k:string,m:string>>"

    def step(acc: Column, x: Column) -> Column:
        keep = x["s"] >= acc["end"]
        return F.struct(
            F.when(keep, x["e"]).otherwise(acc["end"]).alias("end"),
            F.when(keep, F.concat(acc[key], F.array(x))).otherwise(acc[key]).alias(key),
        )

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias(key)), step, lambda acc: acc[key])


def masked(text: Column, spans: Column) -> Column:
    """The text with what the spans cover replaced by <KIND>; overlapping spans become one, named by the first."""
    merged = "array<struct<s:int,e:int,k:string>>"

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"])
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["k"].alias("k"))
        own = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(acc, F.array(own))
        )

    blocks = F.aggregate(spans, F.array().cast(merged), merge)
    body = let(
        blocks,
        lambda b: F.concat(
            F.array_join(
                F.transform(
                    b,
                    lambda x, i: F.concat(
                        F.substring(text, F.coalesce(F.get(b, i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get(b, i - 1)["e"], F.lit(0))),
                        F.concat(F.lit("<"), F.upper(x["k"]), F.lit(">")),
                    ),
                ),
                "",
            ),
            F.substring(text, F.element_at(b, -1)["e"] + 1, F.length(text)),
        ),
    )
    return F.when(F.size(spans) > 0, body).otherwise(text)
