"""Secret scans: three base patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of 20 or more key characters. Each is put into a character class (hex, base64, mixed); a window
moves over it, and both its counts, kept by character, and the sum of c*log2(c) over them are updated as one character
enters and one leaves, so no window is counted anew. A candidate whose highest window entropy passes its class's threshold becomes a span of
kind ``entropy``, unless the allow-list knows it or a base span overlaps it. Words of the allow-list cut a candidate into
parts that are judged by themselves, so a key joined to such a word is found. A part without a digit or without a letter is
suppressed whole.

Nulls: a null text counts as empty and has no spans. Empty texts: none. Very long texts are scanned whole; patterns use
possessive repeats, so a match costs linear time and no stack. Ties: spans are sorted by start, then kind as listed.
Repeated rows are scanned one by one. Empty tables give no rows. Extra columns stay, whatever their names; columns named
like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm._native import apart, found, let, listed, masked, prefix, tagged, whole

#: The base kinds; fixed values. Minimum lengths stand in the pattern where a shorter match can only fail.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

WINDOW = 20
#: Class, pattern that the whole candidate must match, least entropy in bits of its best window.
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("base64", r"^[A-Za-z0-9+/]+={0,2}$", 3.5),
    ("mixed", r"^[A-Za-z0-9_+/=-]+$", 3.5),
)
#: Well-known harmless strings: UUIDs, digests of nothing, paths, and words without digits.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^/?(?:[a-z0-9._-]{1,15}/)+[a-z0-9._-]{0,15}$",
)
#: Words of harmless strings; what stands before, between and after them is looked at by itself.
ALLOWED_WORDS = r"(?i)example|sample|placeholder|changeme|xxxxx|01234567|abcdefgh"


def entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of a window of the candidate."""

    def part(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)

    def walk(places: Column) -> Column:
        """places: each character's place among the candidate's different ones, from 1. The counts are kept by place."""

        def step(acc: Column, i: Column) -> Column:
            enters, leaves, counts = F.get(places, i), F.coalesce(F.get(places, i - window), F.lit(0)), acc["counts"]
            leaving = F.coalesce(F.get(counts, leaves - 1), F.lit(0))
            out = F.when(leaves == 0, 0.0).otherwise(part(leaving) - part(leaving - 1))
            had = F.get(counts, enters - 1) - (enters == leaves).cast("int")
            total = acc["sum"] - out + part(had + 1) - part(had)
            return F.struct(
                total.alias("sum"),
                F.when(i >= window - 1, F.greatest(acc["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(acc["best"]).alias("best"),
                F.transform(counts, lambda n, k: n + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int")).alias("counts"),
            )

        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.transform(F.sequence(F.lit(1), F.array_max(places)), lambda _: F.lit(0)).alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), zero, step, lambda a: a["best"])

    chars = F.filter(F.split(candidate, ""), lambda x: x != "")
    places = let(F.struct(chars.alias("all"), F.array_distinct(chars).alias("own")), lambda c: F.transform(c["all"], lambda x: F.array_position(c["own"], x).cast("int")))
    return F.when(F.length(candidate) > 0, let(places, walk)).otherwise(0.0)


def _suspicious(m: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | m.rlike(pattern)
    least = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(m.rlike(pattern), bits).otherwise(least)
    return F.when((F.length(m) < WINDOW) | allowed, False).otherwise(entropy(m) >= least)


def _long_enough(m: Column) -> Column:
    value = F.regexp_extract(m, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$""", 1)
    return F.length(value) >= 6


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans and spans (arrays of s, o, e, k, m sorted by start, then kind)."""
    made = ["base_spans", "spans"]
    kept, p = [F.col(f"`{c}`") for c in df.columns if c not in made], prefix(df)
    t = whole(F.col(text))
    out = df.select(
        *kept,
        F.filter(found(t, ASSIGN), lambda x: _long_enough(x["m"])).alias(f"{p}assign"),
        found(t, ACCESS).alias(f"{p}access"),
        found(t, HEX).alias(f"{p}hex"),
        F.filter(found(t, CANDIDATE), lambda x: F.exists(F.split(x["m"], ALLOWED_WORDS), _suspicious)).alias(f"{p}more"),
    )
    out = out.select(
        *kept, f"{p}more",
        F.array_sort(F.concat(tagged(F.col(f"{p}assign"), "assign", 0), tagged(F.col(f"{p}access"), "access", 1), tagged(F.col(f"{p}hex"), "hex", 2))).alias("base_spans"),
    )
    base = F.col("base_spans")
    more = F.filter(
        tagged(F.col(f"{p}more"), "entropy", 3), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    )
    return out.select(*kept, "base_spans", F.array_sort(F.concat(base, apart(more))).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with each secret replaced by <KIND>; a null text stays null."""
    t = whole(F.col(text))
    hit = scan(df, text)
    changed = F.when(F.size("spans") > 0, masked(t, F.col("spans"))).otherwise(F.col(text))
    return hit.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def digest(spans: Column) -> Column:
    return F.sha2(listed(spans), 256)

