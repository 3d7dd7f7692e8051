"""Line dedup over a corpus: a deletion-neighbourhood join with an edit bound of one unit.

A line goes if an earlier line (by id, then line number) equals it, or lies within the edit bound of it. Lines are compared
without blanks at their ends; blank lines stay. The bound follows the line's length by one rule, about a tenth of it:
nothing in lines under ``min_fuzzy`` (10) characters, one character inserted, deleted or changed in longer ones, and one
word in lines of ``word_lines`` (10) words or more. Words are what single spaces separate; a line under ten words and one
of ten or more are never near.

Equal lines are one by two hashes. For the rest, two lines within one edit agree outside one stretch. First, each line
hashes its halves, in characters or words; only lines that share a half with another can have a neighbour, and only their
text moves. These hash everything outside each of about sqrt(length) segments; where that is shared, all variants of the
segment with one unit deleted are emitted as hashed keys. Equal keys join: lines of one length with the same unit deleted at
the same place are all neighbours, and a line is a neighbour of those that become it by a deletion, so the earliest of a
key's other side decides, and no pairs within a key are formed. The pair with that earliest line is verified by its edit
distance on both texts, so hashes that collide delete nothing. No step loses a neighbour, whatever the line's length.

Scale: hashes and positions move; a text moves only where a sieve of bounded size can't rule out that its document holds a
line of interest, or loses one. Frequent lines and keys are reduced to minima before they move. Each step is a table in the
shared folder, written once, and read by those that follow.

Nulls: a null text stays null and has no lines; an empty one stays empty. Rows with a null id come last in order. Rows
equal in all columns are one document and come back once; rows that differ in any other column stay apart, in the order of
a hash of the whole row. Very long lines need time that grows as length to the power 1.5. Ties can't arise: id, row hash
and line number order all lines. Empty tables give no rows. Extra columns stay, whatever their names, and those named like
a result are replaced. Ids may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from folioscope.llm._native import BLANKS, let, prefix
from folioscope.llm.sieve import maybe
from folioscope.llm.storage import forget, kept

MIN_CHARS = 1
MIN_FUZZY = 10
WORD_LINES = 10
LAST_ID = 2**63 - 1


class Characters:
    """Lines as strings."""

    size = staticmethod(F.length)

    @staticmethod
    def part(text: Column, start: Column, end: Column) -> Column:
        """Units start..end-1, counted from 0."""
        return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))

    @staticmethod
    def units(norm: Column) -> Column:
        return norm

    @staticmethod
    def near(a: Column, b: Column) -> Column:
        return F.levenshtein(a, b, 1).between(0, 1)


class Words:
    """Lines as arrays of hashes of words; pairs are verified on the words."""

    size = staticmethod(F.size)

    @staticmethod
    def part(text: Column, start: Column, end: Column) -> Column:
        return F.slice(text, start + 1, F.greatest(end - start, F.lit(0)))

    @staticmethod
    def units(norm: Column) -> Column:
        return F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))

    @staticmethod
    def near(a: Column, b: Column) -> Column:
        """At most one word inserted, deleted or changed: what follows the first difference is equal but for one word."""

        def judge(x: Column) -> Column:
            one, two = x["a"], x["b"]
            at = F.array_position(F.zip_with(one, two, lambda p, q: p.eqNullSafe(q)), False).cast("int")
            rest = lambda words, skip: F.slice(words, at + skip, F.greatest(F.size(words) - at - skip + 1, F.lit(0)))
            by = F.size(one) - F.size(two)
            return (at == 0) | F.when(by == 0, rest(one, 1) == rest(two, 1)).when(by == 1, rest(one, 1) == rest(two, 0)).when(by == -1, rest(one, 0) == rest(two, 1)).otherwise(False)

        return let(F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b")), judge)


def _n_words(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def _halves(norm: Column, chars: Column, n_words: Column, min_fuzzy: int, word_lines: int) -> Column:
    """Hashes of both halves, as the shorter or equal line of a pair (d = 0) and as the longer (d = 1); nulls where the line is too short."""
    by_characters, by_words = [], []
    index = lambda k: F.call_function("substring_index", norm, F.lit(" "), k)
    for d in (0, 1):
        s = chars - d
        half = F.floor(s / 2).cast("int")
        by_characters += [F.when(s >= min_fuzzy, F.xxhash64(F.lit(0), s, Characters.part(norm, F.lit(0), half))), F.when(s >= min_fuzzy, F.xxhash64(F.lit(1), s, Characters.part(norm, half + d, s + d)))]
        s = n_words - d
        half = F.floor(s / 2).cast("int")
        by_words += [F.when(s >= word_lines, F.xxhash64(F.lit(2), s, index(half))), F.when(s >= word_lines, F.xxhash64(F.lit(3), s, index(half - s)))]
    return F.when(n_words >= word_lines, F.array(*by_words)).otherwise(F.array(*by_characters))


def _outside(units, norm: Column, d: int) -> Column:
    """For each segment: the hash of all outside it, and the segment, which has one more unit if d is 1."""
    s = units.size(norm) - d
    width = F.ceil(F.sqrt(s.cast("double"))).cast("int")

    def one(j: Column) -> Column:
        start, end = j * width, F.least((j + 1) * width, s)
        return F.struct(
            F.xxhash64(s, j, units.part(norm, F.lit(0), start), units.part(norm, end + d, s + d)).alias("k"), F.lit(d).alias("d"), units.part(norm, start, end + d).alias("mid")
        )

    return F.transform(F.sequence(F.lit(0), F.ceil(s / width).cast("int") - 1), one)


def _variants(units, k: Column, d: Column, mid: Column) -> Column:
    """(key, side): 0 changed in place, 1 the shorter, 2 the longer of a pair."""
    places = F.sequence(F.lit(0), units.size(mid) - 1)
    without = lambda i: F.concat(units.part(mid, F.lit(0), i), units.part(mid, i + 1, units.size(mid)))
    pair = lambda key, side: F.struct(key.alias("key"), F.lit(side).alias("side"))
    same = F.transform(places, lambda i: pair(F.xxhash64(k, F.lit(0), i, without(i)), 0))
    shorter = F.array(pair(F.xxhash64(k, F.lit(1), mid), 1))
    longer = F.transform(places, lambda i: pair(F.xxhash64(k, F.lit(1), without(i)), 2))
    return F.when(d == 0, F.concat(same, shorter)).otherwise(longer)


def _shared(df: DataFrame, key: str) -> DataFrame:
    """Keys that two or more different lines hold."""
    return df.groupBy(key).agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b").select(key)


def _neighbours(units, lines: DataFrame) -> DataFrame:
    """Of lines (line, more, at, norm), those that an earlier one lies within one edit of: (line, more)."""
    cut = lines.select("line", "at", units.units(F.col("norm")).alias("u"))
    segments = cut.select("line", "at", F.explode(F.concat(_outside(units, F.col("u"), 0), _outside(units, F.col("u"), 1))).alias("g")).select("line", "at", "g.k", "g.d", "g.mid")
    live = segments.join(_shared(segments.select("line", "k"), "k"), "k")
    keys = live.select("line", "at", F.explode(_variants(units, F.col("k"), F.col("d"), F.col("mid"))).alias("v")).select("line", "at", "v.key", "v.side").distinct()
    mark = F.struct("at", "line")
    least = keys.groupBy("key").agg(*[F.min(F.when(F.col("side") == side, mark)).alias(f"m{side}") for side in (0, 1, 2)])
    other = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = keys.join(least, "key").select("line", "at", other.alias("o")).filter("o.at < at").select("line", F.col("o.line").alias("earlier")).distinct()
    texts = lines.select("line", "more", "at", "norm")
    both = pairs.join(texts, "line").join(texts.select(F.col("line").alias("earlier"), F.col("at").alias("earlier_at"), F.col("norm").alias("earlier_norm")), "earlier")
    return both.filter((F.col("earlier_at") < F.col("at")) & units.near(F.col("norm"), F.col("earlier_norm"))).select("line", "more")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_fuzzy: int = MIN_FUZZY, word_lines: int = WORD_LINES) -> DataFrame:
    """The rows of df with their text's later lines gone, and n_lines and n_removed added."""
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    column = {c: F.col(f"`{c}`") for c in names}
    p = prefix(df)
    docs = df.select(*column.values())
    id_, row = _id(df, key), F.xxhash64(*column.values())
    split = F.split(column[text], "\n")
    norm = lambda raw: F.btrim(raw, F.lit(BLANKS))
    counts = lambda raw: F.length(norm(raw)) >= min_chars
    made: list[DataFrame] = []

    # A document's lines, and one more that stands for itself, with their number.
    source = docs.filter(column[text].isNotNull()).select(id_.alias("id"), row.alias("row"), split.alias("all"))
    source = source.select("id", "row", F.size(F.filter("all", counts)).alias("n"), F.concat("all", F.array(F.lit(None).cast("string"))).alias("all"))
    source = source.select("id", "row", "n", F.posexplode("all").alias("no", "raw"))
    source = source.select("id", "row", "n", "no", norm(F.col("raw")).alias("norm")).filter(F.col("norm").isNull() | (F.length("norm") >= min_chars))
    source = source.select("*", F.length("norm").alias("chars"), _n_words(F.col("norm")).alias("words"))  # in columns of their own, so that each is computed once
    own = F.col("norm").isNull()
    lines = source.select(
        F.when(own, F.xxhash64("id", "row")).otherwise(F.xxhash64("norm")).alias("line"), F.when(own, F.lit(-1)).otherwise(F.hash("norm")).alias("more"), own.alias("own"),
        F.struct("id", "row", "no").alias("at"), F.when(~own, _halves(F.col("norm"), F.col("chars"), F.col("words"), min_fuzzy, word_lines)).alias("ks"), F.when(own, F.col("n")).alias("n"),
    )
    firsts = kept(lines.groupBy("line", "more", "own").agg(F.min("at").alias("at"), F.max("ks").alias("ks"), F.max("n").alias("n"), F.sum(F.when(F.col("own"), 1)).alias("times")), "firsts", made)

    keyed = firsts.filter("not own").select("line", F.explode("ks").alias("k")).filter("k is not null")
    near = keyed.join(_shared(keyed, "k"), "k").select("line").distinct()
    wanted = firsts.filter("not own").join(near, "line").groupBy("at.id", "at.row").agg(F.collect_list(F.struct("line", "more", "at.no")).alias("want"))
    wanted = kept(wanted, "wanted", made)
    read = maybe(docs, id_, wanted, F.col("id"), f"{p}in").filter(f"{p}in").select(id_.alias("id"), row.alias("row"), split.alias("all"))
    found = read.join(wanted, ["id", "row"]).select("id", "row", F.explode(F.transform("want", lambda w: F.struct(w["line"].alias("line"), w["more"].alias("more"), w["no"].alias("no"), norm(F.get("all", w["no"])).alias("norm")))).alias("x"))
    picked = kept(found.select("x.line", "x.more", F.struct("id", "row", "x.no").alias("at"), "x.norm").dropDuplicates(["line", "more"]), "picked", made)
    long = _n_words(F.col("norm")) >= word_lines
    gone = _neighbours(Words, picked.filter(long)).unionByName(_neighbours(Characters, picked.filter(~long))).distinct()

    stay = firsts.join(gone, ["line", "more"], "left_anti").groupBy("at.id", "at.row").agg(F.collect_list(F.when(~F.col("own"), F.col("at.no"))).alias("keep"), F.max("n").alias("n"), F.max("times").alias("times"))
    changed = kept(stay.filter("size(keep) < n or times > 1").select("id", "row", "keep", "times"), "changed")
    forget(*made)

    def rebuilt(all_: Column) -> Column:
        short = F.filter(F.transform(all_, lambda x, i: F.when(~counts(x), i)), lambda i: i.isNotNull())
        return let(F.array_sort(F.concat(short, F.col(f"{p}keep"))), lambda k: F.struct(F.size(k).alias("k"), F.array_join(F.transform(k, lambda i: F.get(all_, i)), "\n").alias("t")))

    def finished(part: DataFrame) -> DataFrame:
        new = F.when(F.col(f"{p}keep").isNotNull(), let(split, rebuilt))
        part = part.withColumn(f"{p}new", new).withColumn(f"{p}n", F.when(column[text].isNotNull(), F.size(split)).otherwise(0))
        out = {c: F.coalesce(F.col(f"{p}new.t"), column[c]).alias(c) if c == text else column[c] for c in names}
        return part.select(*out.values(), F.col(f"{p}n").cast("long").alias("n_lines"), F.coalesce(F.col(f"{p}n") - F.col(f"{p}new.k"), F.lit(0)).cast("long").alias("n_removed"))

    # Documents that may lose lines move, by themselves those that may be repeated rows; the others are read once more.
    flagged = maybe(docs, id_, changed, F.col("id"), f"{p}odd")
    flagged = maybe(flagged, id_, changed.filter("times > 1"), F.col("id"), f"{p}again")
    moving = flagged.filter(f"{p}odd").withColumn(f"{p}id", id_).withColumn(f"{p}row", row)
    held = changed.select(F.col("id").alias(f"{p}id"), F.col("row").alias(f"{p}row"), F.col("keep").alias(f"{p}keep"))
    met = lambda part: finished(part.join(held, [f"{p}id", f"{p}row"], "left"))
    none = F.lit(None).cast("array<int>").alias(f"{p}keep")
    alone = finished(flagged.filter(f"not {p}odd").select(*column.values(), none))
    once = met(moving.filter(f"not {p}again"))
    return alone.unionByName(once).unionByName(met(moving.filter(f"{p}again").dropDuplicates([f"{p}id", f"{p}row"])))


def _id(df: DataFrame, key: str) -> Column:
    """What orders documents, nulls last."""
    column = F.col(f"`{key}`")
    if isinstance(df.schema[key].dataType, IntegralType):
        return F.coalesce(column.cast("long"), F.lit(LAST_ID))
    return F.struct(column.isNull().alias("none"), column.alias("id"))
