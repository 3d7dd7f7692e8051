"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``measures`` adds word, symbol, line and repetition counts of the whole text; ``quality`` adds the ratios,
whether the base rules fail, the names of the broken thresholds and the verdict.

Nulls: a null text counts as empty. Empty and blank texts have no words and fail the base rules. Very long
texts are read whole; repeated windows are found by sorting the hashes of one text's windows. Ties and
repeated rows: every row is judged by itself. Empty tables give no rows. Extra columns stay, whatever their names; columns
that bear the name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm._native import let, prefix, whole, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the corpus' four languages; fixed values.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es "
    "le la les de des et en un une du que qui dans pour par sur au avec ne pas "
    "el la los las de y que en un una por con para del se su al lo es no mi"
).split()


@dataclass(frozen=True)
class Threshold:
    """A ratio of two measures must lie within [low, high]; None: no bound. An undefined ratio breaks no rule."""

    name: str
    above: str
    below: str
    low: float | None = None
    high: float | None = None


#: The method's rules. The bounds were set by hand, between the labelled good and bad texts of the sample tables, on the loose side.
RULES = (
    Threshold("mean_word_length", "word_chars", "n_words", 3.0, 12.0),
    Threshold("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Threshold("shouts_per_word", "n_shouts", "n_words", None, 0.3),
    Threshold("letter_words", "n_letter_words", "n_words", 0.7, None),
    Threshold("stop_words", "n_stop_words", "n_words", 0.02, None),
    Threshold("echoes", "n_echoes", "n_words", None, 0.3),
    Threshold("dup_lines", "n_dup_lines", "n_lines", None, 0.4),
)


def _windows(w: Column) -> Column:
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return let(
        hashes,
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: sort windows by hash, keep those with an equal neighbour, join their places."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = let(
        pairs,
        lambda a: F.filter(
            a, lambda x, k: x["h"].eqNullSafe(F.get(a, k - 1)["h"]) | x["h"].eqNullSafe(F.get(a, k + 1)["h"])
        ),
    )
    places = F.array_sort(F.transform(twins, lambda x: x["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shouts, n_letter_words, n_stop_words and n_echoes (words equal to the one before)."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts", "n_letter_words", "n_stop_words", "n_echoes"]
    kept, p = [F.col(f"`{c}`") for c in df.columns if c not in made], prefix(df)
    w, lines, win = F.col(f"{p}w"), F.col(f"{p}lines"), F.col(f"{p}win")
    t = whole(F.col(text))
    staged = df.select(
        *kept,
        words(F.col(text)).alias(f"{p}w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias(f"{p}lines"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).alias(f"{p}symbols"),
        F.regexp_count(t, F.lit("!")).alias(f"{p}shouts"),
    )
    staged = staged.withColumn(f"{p}win", F.when(F.size(w) > WINDOW, _windows(w)))
    repeats = F.when(F.size(F.array_distinct(win)) < F.size(win), _covered(win)).otherwise(0)
    return staged.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.col(f"{p}symbols").cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col(f"{p}shouts").cast("long").alias("n_shouts"),
        F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_echoes"),
    )


def broken(rules: tuple[Threshold, ...] = RULES) -> Column:
    """The names of the rules that a row's measures break: the whole table as one expression."""

    def one(r: Threshold) -> Column:
        ratio = F.when(F.col(r.below) > 0, F.col(r.above) / F.col(r.below))
        out = F.lit(False)
        if r.low is not None:
            out = out | (ratio < r.low)
        if r.high is not None:
            out = out | (ratio > r.high)
        return F.when(out, F.lit(r.name))

    return F.filter(F.array(*[one(r) for r in rules]), lambda x: x.isNotNull())


def quality(df: DataFrame, text: str = "text", rules: tuple[Threshold, ...] = RULES) -> DataFrame:
    """Adds the measures, base_failed, broken_rules and kept. To filter by them use ``_native.keep_where``, which keeps them computed once."""
    out = measures(df, text)
    out = out.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    out = out.withColumn("broken_rules", broken(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
