"""Bags of visual words, or of any terms: frequencies, TF-IDF, and their text exports, in long form until export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_COLUMNS = 10_000


def term_frequency(df: DataFrame, doc: str, term: str) -> DataFrame:
    return df.filter(F.col(doc).isNotNull() & F.col(term).isNotNull()).groupBy(doc, term).agg(F.count("*").alias("tf"))


def collection_frequency(tf: DataFrame, term: str) -> DataFrame:
    return tf.groupBy(term).agg(F.sum("tf").alias("cf"))


def document_frequency(tf: DataFrame, term: str) -> DataFrame:
    return tf.groupBy(term).agg(F.count("*").alias("df"))


def tf_idf(df: DataFrame, doc: str, term: str, norm: str | None = None) -> DataFrame:
    """(doc, term, tf, df, tfidf): tf over the document's length, times ln((N + 1) / df); norm 'l1' makes a document's values sum to 1."""
    tf = term_frequency(df, doc, term)
    freq = document_frequency(tf, term)
    n = tf.agg(F.countDistinct(doc).alias("__docs"))
    out = tf.join(freq, term).crossJoin(n)  # one row: the number of documents
    length = F.sum("tf").over(Window.partitionBy(doc))
    out = out.withColumn("tfidf", F.col("tf") / length * F.log((F.col("__docs") + 1) / F.col("df"))).drop("__docs")
    if norm == "l1":
        out = out.withColumn("tfidf", F.col("tfidf") / F.sum("tfidf").over(Window.partitionBy(doc)))
    return out.select(doc, term, "tf", "df", "tfidf")


def wide(values: DataFrame, doc: str, term: str, value: str = "tfidf", terms: list | None = None, name: str = "cluster_{}_tfidf", kind: str = "float") -> DataFrame:
    """One column a term, terms ascending, 0 where absent. The list of terms bounds the width; without one it is read first, and more than MOST_COLUMNS terms are an error."""
    if terms is None:
        found = values.select(term).distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} terms: name those that are wanted")
        terms = sorted(r[0] for r in found)
    pivoted = values.groupBy(doc).pivot(term, terms).agg(F.first(value))
    return pivoted.select(doc, *[F.coalesce(F.col(f"`{t}`").cast(kind), F.lit(0).cast(kind)).alias(name.format(t)) for t in terms])


def lda_lines(tf: DataFrame, doc: str, term: str, labels: DataFrame | None = None, label: str = "label") -> DataFrame:
    """(doc, line): the number of terms, the label or ?, and term:count, terms ascending."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(term).alias("t"), F.col("tf").alias("n"))))
    out = tf.groupBy(doc).agg(entries.alias("e"))
    out = out.join(labels.select(doc, F.col(label).alias("__label")), doc, "left") if labels is not None else out.withColumn("__label", F.lit(None).cast("string"))
    body = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["t"].cast("string"), x["n"].cast("string"))), " ")
    return out.select(doc, F.concat_ws(" ", F.size("e").cast("string"), F.coalesce("__label", F.lit("?")), body).alias("line"))


def sorted_entries(entries: Column) -> Column:
    """Sparse entries (index, value) by index."""
    return F.array_sort(entries)
