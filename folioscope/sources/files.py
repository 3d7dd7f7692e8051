"""Readers of text, binary, delimited, sequence, tar, descriptor and database inputs."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence
from itertools import zip_longest
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import scalars
from folioscope.operators.joins import last_by
from folioscope.operators.selection import parse_ranges

DESCRIPTOR_WIDTH = 128


def whole_texts(spark: SparkSession, path, charset: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """(key, value): one row a file, keyed by its name without extension, in any charset that Java knows."""
    raw = binary_files(spark, path, glob)
    return raw.select("key", F.decode("value", charset).alias("value"))


def binary_files(spark: SparkSession, path, glob: str | None = None, files_per_task: int | None = None) -> DataFrame:
    """(key, value): one row a file. ``files_per_task`` packs so many files into a task, 0 as many as give every core one task; without it Spark packs by size."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    out = raw.select(scalars.basename(F.col("path")).alias("key"), F.col("content").alias("value"), "path")
    if files_per_task is not None:
        # Only paths are counted and dealt; each task then reads its files' contents.
        if files_per_task < 0:
            raise ValueError("files_per_task must not be negative")
        tasks = -(-raw.select("path").count() // files_per_task) if files_per_task else spark.sparkContext.defaultParallelism
        out = out.repartition(max(1, tasks), "path")
    return out.drop("path")


def matching_paths(df: DataFrame, column: str = "path", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Files whose name, as a whole, matches one pattern and not another."""
    name = F.regexp_extract(column, "[^/]+$", 0)
    out = df.filter(name.rlike(f"^(?:{include})$")) if include else df
    return out.filter(~name.rlike(f"^(?:{exclude})$")) if exclude else out


def sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a Hadoop sequence file of text keys and byte values."""
    rows = spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), bytes(kv[1])))
    return spark.createDataFrame(rows, "key string, value binary")


def plain_csv(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    out = spark.read.csv(path, header=True, sep=sep, mode="FAILFAST", nullValue="")
    if not out.columns:
        raise ValueError(f"empty file: {path}")
    return out


def typed_csv(spark: SparkSession, path, sep: str | None = None, missing: str = "?", nominal: str = "", text: str = "", quote: str = '"') -> DataFrame:
    """A table with typed columns: a column is numeric until a value isn't a number, then text as a whole.

    Comma or tab; values in ``quote``, which may be ``'``; ``%`` begins a comment line; empty and ``missing`` are null; a row of the wrong length is
    an error; ``3D`` is no number. ``nominal`` and ``text`` are ranges (first-last, from 1) that are never numeric.
    Metadata says what a column became. Types come from one aggregation over the table.
    """
    options = dict(header=True, comment="%", nullValue=missing, mode="FAILFAST", inferSchema=False, quote=quote)
    if sep is None:
        head = spark.read.text(path).filter(~F.col("value").startswith("%")).first()
        sep = "\t" if head and "\t" in head[0] else ","
    raw = spark.read.csv(path, sep=sep, **options)
    raw = raw.select(*[F.when(F.length(F.trim(f"`{c}`")) > 0, F.trim(f"`{c}`")).alias(c) for c in raw.columns])
    forced = {c: "nominal" for c in parse_ranges(nominal, raw.columns)} | {c: "string" for c in parse_ranges(text, raw.columns)}
    free = [c for c in raw.columns if c not in forced]
    ok = raw.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").rlike(scalars.NUMBER)), F.lit(True)).alias(c) for c in free]).first() if free else {}
    kinds = {c: forced.get(c) or ("numeric" if ok[c] else "nominal") for c in raw.columns}
    cell = lambda c: scalars.to_double(F.col(f"`{c}`")) if kinds[c] == "numeric" else F.col(f"`{c}`")
    return raw.select(*[cell(c).alias(c, metadata={"kind": kinds[c]}) for c in raw.columns])


def codes_by_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): nominal codes in the order in which values first appear; a table to join, whatever its size."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.min(order).alias("__first"))
    return first.select("value", (F.row_number().over(Window.orderBy("__first", "value")) - 1).cast("int").alias("code"))  # one row a distinct value


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(path, line, value), lines from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def delimited_map(spark: SparkSession, path, delimiter: str, skip: int = 0) -> DataFrame:
    """(key, value) lines; # comments and the first lines skipped; under two fields is an error; of equal keys the last line wins."""
    rows = numbered_lines(spark, path).filter((F.col("line") > skip) & (F.length("value") > 0) & ~F.col("value").startswith("#"))
    parts = F.split("value", _quoted(delimiter))
    rows = rows.withColumn("value", _or_error(F.size(parts) >= 2, "a line without a value"))
    return last_by(rows.select("line", parts[0].alias("key"), parts[1].alias("value")), ["key"], "line").select("key", "value")


def _or_error(ok: Column, message: str, column: str = "value") -> Column:
    """The column, or an error when the row is computed."""
    return F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.col(column))).cast("string"))


def _quoted(delimiter: str) -> str:
    return r"\Q" + delimiter + r"\E"


def ground_truth(spark: SparkSession, path, codes: Sequence[str]) -> DataFrame:
    """(graphic_id, code) of lines ``<id>.jpg, CODE``; other lines and unknown codes are errors; the last line of an id wins."""
    rows = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0)
    line = r"^(.*)\.jpg\s*,\s*(\S+)\s*$"
    rows = rows.withColumn("value", _or_error(F.col("value").rlike(line), "not a line of ground truth"))
    out = rows.select("line", F.trim(F.regexp_extract("value", line, 1)).alias("graphic_id"), F.regexp_extract("value", line, 2).alias("code"))
    out = out.withColumn("code", _or_error(F.col("code").isin(*codes), "unknown code", "code"))
    return last_by(out, ["graphic_id"], "line").select("graphic_id", "code")


def id_list(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def class_map(spark: SparkSession, path) -> DataFrame:
    parts = F.split(F.trim("value"), " ", 2)
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(parts[0].alias("label"), F.trim(parts[1]).try_cast("int").alias("id"))


def caption_lines(spark: SparkSession, path) -> DataFrame:
    """(id, caption) of tab-separated lines; blank lines skipped."""
    return tab_pairs(spark.read.text(path))


def tab_pairs(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    return lines.filter(F.length(F.trim("value")) > 0).select(parts[0].alias("id"), F.get(parts, F.lit(1)).alias("caption"))


def descriptors(spark: SparkSession, path, width: int = DESCRIPTOR_WIDTH) -> DataFrame:
    """(name, image_id, vec_idx, vector) of lines of numbers, named ``file:line``; another width is an error."""
    rows = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0)
    v = F.transform(F.split(F.trim("value"), r"\s+"), scalars.to_double)
    bad = F.raise_error(F.concat(F.lit("wrong number of values in line "), F.col("line").cast("string"))).cast("array<double>")
    out = rows.withColumn("__v", v).withColumn("vector", F.when((F.size("__v") == width) & F.forall("__v", lambda x: x.isNotNull()), F.col("__v")).otherwise(bad))
    image = scalars.basename(F.col("path"))
    return out.select(F.concat_ws(":", image, F.col("line").cast("string")).alias("name"), image.alias("image_id"), F.col("line").alias("vec_idx"), "vector")


def vector_dataset(df: DataFrame, key: str, vector: str, width: int | None = None, label: str | None = None) -> DataFrame:
    """id, attr_0.., label of rows of vectors; a width unlike the first row's, or an empty input, is an error."""
    if width is None:
        row = df.select(F.size(vector)).first()
        if row is None:
            raise ValueError("no vectors")
        width = row[0]
    bad = F.raise_error(F.concat(F.lit("a vector of another width: "), F.size(vector).cast("string"))).cast("array<double>")
    checked = df.withColumn("__v", F.when(F.size(vector) == width, F.col(vector).cast("array<double>")).otherwise(bad))
    last = F.col(label) if label else F.lit(None).cast("string")
    return checked.select(F.col(key).cast("string").alias("id"), *[F.col("__v")[i].alias(f"attr_{i}") for i in range(width)], last.alias("label"))


def tar_entries(spark: SparkSession, path) -> DataFrame:
    """(name, content) of the files in tar archives, plain, gz or bz2; a cut-off archive is an error.

    An archive is read by one task, entry by entry; archives are the unit of parallel reading.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    while (entry := archive.next()) is not None:
                        if entry.isfile():
                            data = archive.extractfile(entry).read()
                            if len(data) != entry.size:
                                raise EOFError(f"cut off within {entry.name}")
                            yield pd.DataFrame({"name": [entry.name], "content": [data]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, content binary")


def tar_to_parquet(spark: SparkSession, path, to: str) -> DataFrame:
    """The files of tar archives, written as compressed Parquet (name, content) and read again."""
    tar_entries(spark, path).write.mode("overwrite").option("compression", "zstd").parquet(to)
    return spark.read.parquet(to)


def term_table(spark: SparkSession, url: str, table: str, properties: dict | None = None, key: str = "pmid", term: str = "descriptor_name", **partitioning) -> DataFrame:
    """(key, terms) of a database table of (key, term) rows; ``partitioning`` splits the read by a column's ranges."""
    rows = spark.read.jdbc(url, table, properties=properties or {}, **partitioning)
    return rows.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(F.col(term))).alias("terms"))


def medline_terms(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds terms: what follows ``MH  - `` in a record's lines; a body that isn't a record gives none, an empty term is an error."""
    found = F.transform(F.filter(F.split(body, "[\r\n]+"), lambda l: l.startswith("MH  - ")), lambda l: F.substr(l, F.lit(7)))
    bad = F.raise_error(F.lit("an empty term")).cast("array<string>")
    checked = F.when(F.exists(found, lambda t: F.length(F.trim(t)) == 0), bad).otherwise(found)
    return df.withColumn("terms", F.when(F.col(body).contains("PMID- "), checked).otherwise(F.array().cast("array<string>")))


#: Where a citation keeps its parts.
CITATION = {"title": "//ArticleTitle/text()", "journal": "//Journal/ISOAbbreviation/text()", "year": "//JournalIssue/PubDate/Year/text()", "volume": "//JournalIssue/Volume/text()", "issue": "//JournalIssue/Issue/text()", "pages": "//Pagination/MedlinePgn/text()", "abstract": "//AbstractText/text()"}
#: Where it keeps what its authors are called.
AUTHOR = {"last": "//AuthorList/Author/LastName/text()", "initials": "//AuthorList/Author/Initials/text()"}


def _text_nodes(text: str, ends: dict[str, list[tuple[str, list[str]]]]) -> dict[str, list[str]]:
    """The text nodes of one XML text by name, in document order, from one parse; ends: (name, path) by a path's last element.

    As in XPath, comments, instructions and elements part text nodes; entities and CDATA sections don't."""
    found: dict[str, list[str]] = {name: [] for own in ends.values() for name, _ in own}
    path: list[str] = []
    pieces: list[str] = []

    def close(*_) -> None:
        if pieces:
            for name, wanted in ends.get(path[-1], ()):
                if path[-len(wanted) :] == wanted:
                    found[name].append("".join(pieces))
            pieces.clear()

    def start(name: str, _) -> None:
        if pieces:
            close()
        path.append(name.rpartition(":")[2] if ":" in name else name)

    def end(_) -> None:
        if pieces:
            close()
        path.pop()

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, pieces.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = close
    parser.Parse(text, True)
    return found


def citation(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds title, authors (``Last, Initials``), source and abstract of a citation; a missing part is an error.

    A text is parsed once for all parts; an XPath function for each would parse it again each time."""
    ends: dict[str, list[tuple[str, list[str]]]] = {}
    for name, path in (CITATION | AUTHOR).items():
        steps = path.removeprefix("//").removesuffix("/text()").split("/")
        ends.setdefault(steps[-1], []).append((name, steps))

    @F.pandas_udf(", ".join(f"{k} string" for k in (*CITATION, "authors")))
    def parts(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if not text:
                rows.append([None] * (len(CITATION) + 1))
                continue
            found = _text_nodes(text, ends)
            authors = "; ".join(", ".join(x for x in pair if x is not None) for pair in zip_longest(found["last"], found["initials"]))
            rows.append([*(found[k][0] if found[k] else None for k in CITATION), authors])
        return pd.DataFrame(rows, columns=[*CITATION, "authors"], dtype=object)

    part = F.col("__citation")
    need = lambda k: F.when(F.length(part[k]) > 0, part[k]).otherwise(F.raise_error(F.lit(f"no {k}")).cast("string"))
    source = F.format_string("%s %s;%s(%s):%s", need("journal"), need("year"), need("volume"), need("issue"), need("pages"))
    out = df.withColumn("__citation", parts(F.col(xml)))
    return out.select("*", need("title").alias("title"), part["authors"].alias("authors"), source.alias("source_text"), need("abstract").alias("abstract")).drop("__citation")


def headings(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds terms of a citation's subject headings, each with its qualifiers: D, D:Q, :Q."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for b in batches:
            rows = []
            for text in b[xml]:
                root = ET.fromstring(text) if text else None
                own = [] if root is None else [(h.findtext("DescriptorName"), [q.text for q in h.findall("QualifierName")]) for h in root.iter("MeshHeading")]
                rows.append([{"heading": d, "qualifiers": q} for d, q in own])
            yield b.assign(__h=rows)

    schema = T.StructType([*df.schema.fields, T.StructField("__h", T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("qualifiers", T.ArrayType(T.StringType()))])))])
    out = df.mapInPandas(run, schema)
    return out.withColumn("terms", F.flatten(F.transform("__h", lambda h: scalars.heading_terms(h["heading"], h["qualifiers"])))).drop("__h")
