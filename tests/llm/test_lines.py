"""Line dedup against plain comparison of all lines."""

import random

import pytest

from folioscope.llm import lines
from tests.llm.fixtures import documents

BLANKS = " \t\n\x0b\f\r"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def near(a, b, min_fuzzy, word_lines=lines.WORD_LINES):
    """One unit apart: a character in lines of min_fuzzy characters or more, a word in those of word_lines words or more."""
    x, y = a.split(" "), b.split(" ")
    if min(len(x), len(y)) >= word_lines:
        return within_one(x, y)
    return max(len(x), len(y)) < word_lines and min(len(a), len(b)) >= min_fuzzy and within_one(a, b)


def brute(rows, min_chars, min_fuzzy):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for r, (_, text) in enumerate(rows):
        for no, raw in enumerate(text.split("\n") if text is not None else []):
            n = raw.strip(BLANKS)
            if len(n) >= min_chars:
                first.setdefault(n, (r, no))
    order = sorted(first, key=first.get)
    gone = {x for k, x in enumerate(order) if any(near(x, y, min_fuzzy) for y in order[:k])}
    for r, (i, text) in enumerate(rows):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        parts = text.split("\n")
        keep = [p for no, p in enumerate(parts) if len(n := p.strip(BLANKS)) < min_chars or (first[n] == (r, no) and n not in gone)]
        out.append((i, "\n".join(keep), len(parts), len(parts) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_lines(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(1, 40))) for _ in range(25)] + ["item %d of the list" % i for i in range(20)] + ["x" * n for n in (300, 301, 302, 20, 21)]

    def edit(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s[:i] + rng.choice("abz") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abz") + s[i + 1 :], s, " " + s + "\t"])

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[3][1]), (204, "a b"), (204, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", lines.F.lit(7)).withColumn("line", lines.F.lit("x"))
    out = lines.dedup_lines(df, min_chars=3, min_fuzzy=8)
    assert out.columns == ["doc_id", "text", "row", "line", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert got == brute(rows, 3, 8)


def test_near_lines_by_words(spark):
    rng = random.Random(3)
    base = [[rng.choice(["a", "word", "of", "längere", "", "tab\t"]) for _ in range(rng.randint(8, 24))] for _ in range(20)] + [["x"] * 400]

    def edit(w):
        i = rng.randrange(len(w))
        return " ".join(rng.choice([w[:i] + ["new"] + w[i:], w[:i] + w[i + 1 :], w[:i] + ["old", "new"] + w[i + 1 :], w[:i] + ["old"] + w[i + 1 :], w]))

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(1, 5)))) for i in range(80)]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = brute(rows, lines.MIN_CHARS, lines.MIN_FUZZY)
    assert got == want and 0 < sum(r[3] for r in want) < sum(r[2] for r in want)


def test_short_lines(spark):
    """No line is too short to be compared; one edit needs ten characters."""
    rows = [(1, "short\nshort\nshort"), (2, "shore\ncolor of trees"), (3, "colour of trees\n-\n-\n\n\n")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("short", 2), 2: ("shore\ncolor of trees", 0), 3: ("-\n\n\n", 2)}


def test_rows_that_differ_elsewhere_stay_apart(spark):
    rows = [(1, "one line", "en"), (1, "one line", "de"), (1, "one line", "de"), (2, None, "en"), (2, None, "de"), (3, "", "en")]
    got = sorted(map(tuple, lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "lang", "n_removed").collect()))
    assert [r[:2] for r in got] == [(1, "de"), (1, "en"), (2, "de"), (2, "en"), (3, "en")] and [r[2] for r in got if r[0] == 1] in ([0, 1], [1, 0])


def test_ids_and_columns_of_any_kind(spark):
    rows = [("b", "line of text", 1, 2, "x"), ("a", "line of text", 1, 2, "x"), (None, "line of text", 1, 2, "x"), ("c", "line of test", 1, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string, __row int, __keep int, `n.dot` string")
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r["__row"]) for r in out.collect()), key=str) == sorted([("a", "line of text", 1), ("b", "", 1), ("c", "", 1), (None, "", 1)], key=str)


def test_awkward_documents(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    nulls = spark.createDataFrame([(None, "same line here again"), (None, None)], "doc_id long, text string")
    both = df.select("doc_id", "text").unionByName(nulls).unionByName(spark.createDataFrame([(500, "same line here again")], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(both).collect()), key=str)
    assert got == brute([*rows, (None, "same line here again"), (None, None), (500, "same line here again")], lines.MIN_CHARS, lines.MIN_FUZZY)
    assert lines.dedup_lines(df.limit(0)).count() == 0
