"""Writers and the exact text lines of the export formats. Line builders return columns or frames; ``write_*`` write them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.functions.scalars import clean_header, number_text
from folioscope.operators.joins import lookup
from folioscope.operators.rules_engine import predict_articles
from folioscope.sources import articles as art


def _unquoted(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def libsvm_lines(df: DataFrame, features: Sequence[str], label: str, classes: DataFrame | None = None) -> DataFrame:
    """Adds line: the class's number (-1 where it has none), then index:value of every feature from 1, zeros too."""
    out = lookup(df, label, classes, "label", "id", default=-1, name="__class") if classes is not None else df.withColumn("__class", F.col(label).cast("int"))
    cells = [F.concat(F.lit(f"{i}:"), _text(out, f)) for i, f in enumerate(features, 1)]
    return out.withColumn("line", F.concat_ws(" ", F.col("__class").cast("string"), *cells)).drop("__class")


def smlr_lines(df: DataFrame, features: Sequence[str], label: str, classes: DataFrame | None = None) -> DataFrame:
    """Adds line: the features, then the class's number, or its name where it has none."""
    out = lookup(df.withColumn("__own", _unquoted(F.col(label).cast("string"))), "__own", classes, "label", "id", name="__class") if classes is not None else df.withColumn("__own", F.col(label).cast("string")).withColumn("__class", F.lit(None).cast("string"))
    return out.withColumn("line", F.concat_ws(" ", *[_text(out, f) for f in features], F.coalesce(F.col("__class").cast("string"), "__own"))).drop("__class", "__own")


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return number_text(F.col(name)) if kind in ("double", "float") else _unquoted(F.col(name).cast("string"))


def trec_lines(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.select(F.format_string("%s %s 1.0", F.col(key).cast("string"), F.col(label).cast("string")).alias("line"))


def debug_lines(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    return df.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(gold).cast("string"), F.col(pred).cast("string"), F.lit("1.0")).alias("line"))


def validation_lines(df: DataFrame, key: str, labels: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The log of a cross-validation, a line a row: fold, true and predicted class with their numbers from 1, ``+`` where they differ, id."""
    named = lambda c: F.concat(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)).cast("string"), F.lit(":"), F.col(c))
    wrong = F.when(F.col(gold) == F.col(pred), "").otherwise("+")
    return df.select(F.concat_ws("\t", F.col("fold").cast("string"), F.coalesce(named(gold), F.lit("?")), F.coalesce(named(pred), F.lit("?")), wrong, F.concat(F.lit("("), F.col(key).cast("string"), F.lit(")"))).alias("line"))


def distribution(df: DataFrame, key: str, probability: str, classes: Sequence[str], least: float = 1e-5) -> DataFrame:
    """key and one float column a class; next to nothing becomes 0."""
    cell = lambda i: F.when(F.col(probability)[i] > least, F.col(probability)[i]).otherwise(0.0).cast("float")
    return df.select(key, *[cell(i).alias(c.replace('"', "_").replace("\\", "_")) for i, c in enumerate(classes)])


def vector_lines(df: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """Numbers joined by commas, after the key if there is one; an empty vector gives an empty line."""
    body = F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")
    return df.select((F.concat_ws(",", F.col(key).cast("string"), body) if key else body).alias("line"))


def arff_lines(df: DataFrame, relation: str, classes: Sequence[str] | None = None) -> tuple[str, DataFrame]:
    """The header, and the rows as lines; null is ``?``."""
    kind = lambda c, k: "NUMERIC" if k in ("double", "float", "int", "bigint") else "{" + ",".join(classes) + "}" if classes and c == df.columns[-1] else "STRING"
    head = "\n".join([f"@RELATION {relation}", "", *[f"@ATTRIBUTE {c} {kind(c, k)}" for c, k in df.dtypes], "", "@DATA"])
    return head, df.select(F.concat_ws(",", *[F.coalesce(_text(df, c), F.lit("?")) for c in df.columns]).alias("line"))


def term_lines(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """``key<TAB>a|b``, blanks in terms as underscores."""
    return df.select(F.concat_ws("\t", F.col(key).cast("string"), F.translate(F.array_join(terms, "|"), " ", "_")).alias("line"))


def citation_name(doi: Column) -> Column:
    return F.concat(F.lit("doi_"), F.translate(doi, "/", "_"), F.lit(".xml"))


def header(names: Column) -> Column:
    return F.transform(names, clean_header)


def write_lines(df: DataFrame, path: str, line: str = "line", **options) -> None:
    df.select(F.col(line).alias("value")).write.mode("overwrite").options(**options).text(path)


def write_vectors(df: DataFrame, path: str, vector: str, single: bool = False, per_file: int | None = None, by: str | None = None, as_float: bool = True) -> None:
    """Vectors as Parquet with their names as a column: as floats, in one file, so many to a file, or by a column of few values."""
    out = df.withColumn(vector, F.col(vector).cast("array<float>")) if as_float else df
    writer = (out.coalesce(1) if single else out).write.mode("overwrite").option("compression", "zstd")
    writer = writer.option("maxRecordsPerFile", per_file) if per_file else writer
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_counted(df: DataFrame, path: str) -> int:
    """Parquet whose number of rows is checked against those that went into the writer, counted on their way."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    there, found = seen.get["rows"], df.sparkSession.read.parquet(path).count()
    if found != there:
        raise RuntimeError(f"{found} rows written of {there}")
    return found


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_terms(df: DataFrame, url: str, table: str, properties: dict | None = None, key: str = "pmid", terms: str = "terms", term: str = "descriptor_name") -> None:
    """Appends one row a term to a database table."""
    df.select(F.col(key), F.explode(terms).alias(term)).write.mode("append").jdbc(url, table, properties=properties or {})


def write_predicted(articles: DataFrame, path: str, **rules) -> None:
    """The flat form of articles, with what the rules predict for their graphics merged in."""
    art.write_flat(predict_articles(articles, **rules), path)


def write_training_tree(articles: DataFrame, truth: DataFrame, groups: DataFrame, path: str) -> None:
    """Captions of labelled graphics by label and by group, and the articles that have one. groups: (label, grp)."""
    pairs = art.captions(articles).join(truth.withColumnRenamed("code", "label"), "graphic_id").join(groups.select("label", "grp"), "label")
    text = F.concat_ws("\t", "graphic_id", "caption").alias("value")
    for folder, column in (("label", "label"), ("group", "grp")):
        pairs.select(F.col(column).alias(folder), text).write.mode("overwrite").partitionBy(folder).text(f"{path}/{folder}")
    art.write_flat(art.with_labelled_graphic(articles, truth), f"{path}/articles")
