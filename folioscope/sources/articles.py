"""Articles with figures and graphics: reading journal XML, the flat form and two record lists, and writing the flat form."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.schemas import ARTICLE, GROUPS, LABELS
from folioscope.shared import written

ATTRIBUTES = ("pmcid", "pmid", "publisher", "journal", "doi", "id", "dir", "title", "subject")
#: Where a journal article keeps its fields, below <article>: path, and the attribute test of the last step.
JOURNAL_FIELDS = {
    "pmcid": "front/article-meta/article-id[@pub-id-type='pmc']",
    "pmid": "front/article-meta/article-id[@pub-id-type='pmid']",
    "doi": "front/article-meta/article-id[@pub-id-type='doi']",
    "title": "front/article-meta/title-group/article-title",
    "subject": "front/article-meta/article-categories/subj-group[@subj-group-type='heading']/subject",
    "journal": "front/journal-meta/journal-id[@journal-id-type='nlm-ta']",
    "publisher": "front/journal-meta/publisher/publisher-name",
}


def _local(root: ET.Element) -> ET.Element:
    """Names without their namespaces."""
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
        for name in [n for n in e.attrib if n.startswith("{")]:
            e.attrib.setdefault(name.rpartition("}")[2], e.attrib.pop(name))
    return root


def _figure(fig: ET.Element) -> dict:
    caption = fig.find("caption")
    label = fig.find("label")
    return {
        "id": fig.get("id"), "label": (label.text or "").strip() if label is not None else "",
        "caption": "".join(caption.itertext()).strip() if caption is not None else "",
        "references": [], "graphics": [{"id": g.get("href"), "predictions": {}} for g in fig.iter("graphic")],
    }


def parse_journal(content: bytes, folder: str) -> list[dict]:
    """All articles of one file. A number that isn't one is an error."""
    root = _local(ET.parse(io.BytesIO(content)).getroot())
    out = []
    for a in root.iter("article"):
        row = {k: (e.text or "").strip() if (e := a.find(p)) is not None and e.text else None for k, p in JOURNAL_FIELDS.items()}
        row |= {k: int(row[k]) if row[k] else None for k in ("pmcid", "pmid")}
        body = a.find("body")
        row |= {"id": a.get("id"), "dir": folder, "figures": [_figure(f) for f in body.iter("fig")] if body is not None else []}
        out.append(row)
    return out


def read_journal(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Articles of journal XML files; the tree of a file is built in the task that reads it. dir is the file's folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = parse_journal(content, path.rpartition("/")[0])
                yield pd.DataFrame(rows, columns=ARTICLE.names).astype({"pmcid": "Int32", "pmid": "Int32"})

    files = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    return files.select("path", "content").mapInPandas(run, ARTICLE)


PREDICTION_SET = "array<struct<_group:string,prediction:array<struct<_label:string,_confidence:float>>>>"
FIGURES = f"array<struct<_id:string,_label:string,_caption:string,reference:array<struct<_text:string>>,graphic:array<struct<_id:string,`prediction-set`:{PREDICTION_SET}>>>>"
FLAT = ", ".join(f"_{a} {'int' if a in ('pmcid', 'pmid') else 'string'}" for a in ATTRIBUTES) + f", figure {FIGURES}"


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.array())


def read_flat(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Articles of the flat, attribute-only form."""
    raw = spark.read.format("xml").option("rowTag", "article").option("attributePrefix", "_").schema(FLAT).load(path)
    cell = lambda p: F.struct(p["_label"], p["_confidence"])

    def graphic(g: Column) -> Column:
        found = F.flatten(F.transform(F.coalesce(g["prediction-set"], F.array().cast(PREDICTION_SET)), lambda s: F.coalesce(s["prediction"], F.array().cast("array<struct<_label:string,_confidence:float>>"))))
        return F.struct(g["_id"].alias("id"), F.map_from_entries(F.transform(found, cell)).cast("map<string,float>").alias("predictions"))

    def figure(f: Column) -> Column:
        return F.struct(
            f["_id"].alias("id"), f["_label"].alias("label"), f["_caption"].alias("caption"),
            F.transform(F.coalesce(f["reference"], F.array().cast("array<struct<_text:string>>")), lambda r: r["_text"]).alias("references"),
            F.transform(f["graphic"], graphic).alias("graphics"),
        )

    figures = F.coalesce(F.transform("figure", figure), F.array().cast(ARTICLE["figures"].dataType))
    return raw.select(*[F.col(f"_{a}").alias(a) for a in ATTRIBUTES], figures.alias("figures"))


def write_flat(articles: DataFrame, path: str) -> None:
    """The flat form: attributes, null ones left out; a graphic's predictions in one set for each group, empty sets too."""
    group = {code or name: g for name, code, g in LABELS}
    of = F.create_map(*[x for k, g in group.items() for x in (F.lit(k), F.lit(g))])

    def graphic(g: Column) -> Column:
        entries = F.map_entries(F.coalesce(g["predictions"], F.create_map().cast("map<string,float>")))

        def one(name: str) -> Column:
            own = F.filter(entries, lambda e: F.try_element_at(of, e["key"]) == name)
            cells = F.transform(F.array_sort(own), lambda e: F.struct(e["key"].alias("_label"), e["value"].alias("_confidence")))
            return F.struct(F.lit(name).alias("_group"), cells.alias("prediction"))

        return F.struct(g["id"].alias("_id"), F.array(*[one(n) for n in GROUPS]).alias("prediction-set"))

    def figure(f: Column) -> Column:
        return F.struct(
            f["id"].alias("_id"), f["label"].alias("_label"), f["caption"].alias("_caption"),
            F.transform(f["references"], lambda r: F.struct(r.alias("_text"))).alias("reference"), F.transform(f["graphics"], graphic).alias("graphic"),
        )

    flat = articles.select(*[F.col(a).alias(f"_{a}") for a in ATTRIBUTES], F.transform("figures", figure).alias("figure"))
    flat.write.format("xml").option("rootTag", "articles").option("rowTag", "article").option("attributePrefix", "_").mode("overwrite").save(path)


def _articles(df: DataFrame, **fields: Column) -> DataFrame:
    kinds = {f.name: f.dataType for f in ARTICLE.fields}
    return df.select(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _one_figure(id_: Column, caption: Column, graphic: Column) -> Column:
    none = F.create_map().cast("map<string,float>")
    return F.struct(
        id_.alias("id"), F.lit(None).cast("string").alias("label"), caption.alias("caption"), F.array().cast("array<string>").alias("references"),
        F.array(F.struct(graphic.alias("id"), none.alias("predictions"))).alias("graphics"),
    )


def read_articles_2011(spark: SparkSession, path: str) -> DataFrame:
    """The article list whose figures carry an iri: dir is the full text's name, id the url."""
    schema = "`_fulltext-filename` string, _url string, _doi string, _pmid int, _title string, _journal string, figures struct<figure:array<struct<_iri:string,caption:string>>>"
    raw = spark.read.format("xml").option("rowTag", "article").option("attributePrefix", "_").schema(schema).load(path)
    figures = F.transform("figures.figure", lambda f: _one_figure(f["_iri"], f["caption"], f["_iri"]))
    return _articles(raw, dir=F.col("_fulltext-filename"), id=F.col("_url"), doi=F.col("_doi"), pmid=F.col("_pmid"), title=F.col("_title"), journal=F.col("_journal"), figures=F.coalesce(figures, F.array().cast(ARTICLE["figures"].dataType)))


def read_records_2010(spark: SparkSession, path: str) -> DataFrame:
    """The record list: one article with one figure a record."""
    raw = spark.read.format("xml").option("rowTag", "record").schema("pmid string, articleURL string, imageLocalName string, figureID string, caption string").load(path)
    figure = _one_figure(F.col("figureID"), F.col("caption"), F.col("figureID"))
    return _articles(raw, pmid=F.trim("pmid").try_cast("int"), id=F.col("articleURL"), dir=F.col("imageLocalName"), figures=F.array(figure))


def graphics(articles: DataFrame) -> DataFrame:
    """One row a graphic, with its figure's caption."""
    figures = articles.select(*[c for c in articles.columns if c != "figures"], F.explode("figures").alias("f"))
    own = [F.col(c) for c in articles.columns if c not in ("figures", "id")]
    return figures.select(F.col("id").alias("article_id"), *own, F.col("f.id").alias("figure_id"), F.col("f.caption").alias("caption"), F.explode("f.graphics").alias("g")).select(
        "article_id", *[c for c in articles.columns if c not in ("figures", "id")], "figure_id", "caption", F.col("g.id").alias("graphic_id"), F.col("g.predictions").alias("predictions")
    )


def captions(articles: DataFrame) -> DataFrame:
    return graphics(articles).select("graphic_id", "caption")


def graphic_doi(articles: DataFrame) -> DataFrame:
    return graphics(articles).select(F.concat_ws(" ", "graphic_id", "doi").alias("value"))


def with_labelled_graphic(articles: DataFrame, truth: DataFrame, graphic: str = "graphic_id") -> DataFrame:
    """Articles that have a graphic in the table of labels. Articles need no identity of their own: rows are numbered, and written once with their numbers."""
    numbered = written(articles.withColumn("__row", F.monotonically_increasing_id()), "articles")
    ids = numbered.select("__row", F.explode(F.flatten(F.transform("figures", lambda f: F.transform(f["graphics"], lambda g: g["id"])))).alias(graphic))
    has = ids.join(truth.select(graphic).distinct(), graphic, "left_semi").select("__row").distinct()
    return numbered.join(has, "__row", "left_semi").drop("__row")
