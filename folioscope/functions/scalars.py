"""Scalar functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def basename(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]+$", 0), r"\.[^.]*$", "")


def strip_suffix(x: Column, suffix: str = ".jpg") -> Column:
    return F.replace(x, F.lit(suffix), F.lit(""))


def strip_index(key: Column) -> Column:
    """``image:3`` -> ``image`` (the last colon counts)."""
    return F.regexp_replace(key, ":[^:]*$", "")


def vector_key(key: Column) -> Column:
    """``image:3`` -> (image_id, vec_idx); a key without an index is an error."""
    ok = key.rlike("^.*:[0-9]+$")
    bad = F.raise_error(F.concat(F.lit("not a vector key: "), F.coalesce(key, F.lit("null"))))
    image = F.when(ok, F.regexp_extract(key, "^(.*):([0-9]+)$", 1)).otherwise(bad.cast("string"))
    return F.struct(image.alias("image_id"), F.regexp_extract(key, "^(.*):([0-9]+)$", 2).try_cast("int").alias("vec_idx"))


def to_int(x: Column) -> Column:
    return F.trim(x).try_cast("int")


def to_float(x: Column) -> Column:
    return F.trim(x).try_cast("float")


def to_double(x: Column) -> Column:
    """A number only where the text is one: ``3D`` and ``3f`` stay text, so null."""
    return F.when(F.trim(x).rlike(NUMBER), F.trim(x).try_cast("double"))


def number_text(x: Column) -> Column:
    """A double as text, integral values without ``.0``."""
    whole = (x == F.floor(x)) & (F.abs(x) < 9e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def heading_terms(heading: Column, qualifiers: Column) -> Column:
    """D with qualifiers Q1, Q2 -> D, D:Q1, :Q1, D:Q2, :Q2."""
    pairs = F.flatten(F.transform(qualifiers, lambda q: F.array(F.concat(heading, F.lit(":"), q), F.concat(F.lit(":"), q))))
    return F.concat(F.array(heading), F.coalesce(pairs, F.array().cast("array<string>")))


def underscore(term: Column) -> Column:
    return F.translate(term, " ", "_")


def clean_header(x: Column) -> Column:
    return F.regexp_replace(x, r'["\\]', "_")


def small_label(i: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> BA: digits to base 26."""
    digits = F.split(F.conv(i.cast("string"), 10, 26), "")
    letter = lambda d: F.when(d.rlike("[0-9]"), F.chr(F.ascii(d) + 17)).otherwise(F.chr(F.ascii(d) + 10))
    return F.array_join(F.transform(F.filter(digits, lambda d: d != ""), letter), "")


def dot_if_zero(n: Column) -> Column:
    return F.when(n == 0, ".").otherwise(n.cast("string"))


def x_log_x(x: Column, base: float | None = None) -> Column:
    """x ln x, 0 where x is next to nothing."""
    return F.when(x < 1e-6, 0.0).otherwise(x * (F.log(x) if base is None else F.log(base, x)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def argmax(v: Column) -> Column:
    """The first place (from 0) of the largest element."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)) - 1)


def by_largest(v: Column) -> Column:
    """Elements over the largest; all 0 if that is 0."""
    return F.when(F.array_max(v) > 0, F.transform(v, lambda x: x / F.array_max(v))).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def map_get(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def map_greatest(a: Column, b: Column) -> Column:
    """Both maps' keys, the larger value where they share one."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def sparse(v: Column, least: int = 10, share: int = 4) -> Column:
    """(index, value) of non-zero elements where a vector is long and sparse enough, else null."""
    entries = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    return F.when((F.size(v) > least) & (F.size(entries) * share < F.size(v)), entries)


def descriptor_vector(text: Column) -> Column:
    """``name n v...`` (n is checked), ``name;v...``, or numbers alone."""
    parts = F.split(F.trim(text), r"[\s;]+")
    numbers = F.transform(F.filter(parts, lambda p: p != ""), to_double)
    first_is_name = F.get(numbers, F.lit(0)).isNull()
    semicolon = text.contains(";")
    counted = F.slice(numbers, 3, F.greatest(F.size(numbers) - 2, F.lit(0)))
    wrong = F.raise_error(F.concat(F.lit("wrong number of values: "), text)).cast("array<double>")
    named = F.when(semicolon, F.slice(numbers, 2, F.size(numbers))).when(F.size(counted) == F.get(numbers, F.lit(1)).cast("int"), counted).otherwise(wrong)
    return F.when(first_is_name, named).otherwise(numbers)
