"""Rule matching over captions: one projection of literal patterns, so each text is scanned once and no row is multiplied."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import let
from folioscope.rules import CAPTION_RULES, Rule

#: A predictor turns a text column into array<struct<rule int, label string, confidence double>>.
Predictor = Callable[[Column], Column]


def vector(text: Column, rules: Sequence[Rule] = CAPTION_RULES) -> Column:
    """0/1 by rule; a null text hits nothing."""
    return F.array(*[F.coalesce(text.rlike(r.pattern), F.lit(False)).cast("double") for r in rules])


def hits(text: Column, rules: Sequence[Rule] = CAPTION_RULES) -> Column:
    one = lambda i, r: F.when(text.rlike(r.pattern), F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(float(r.confidence)).alias("confidence")))
    return F.filter(F.array(*[one(i, r) for i, r in enumerate(rules)]), lambda x: x.isNotNull())


def best_by_label(found: Column) -> Column:
    """map label -> highest confidence among hits."""
    def merged(all_: Column) -> Column:
        best = lambda n: F.array_max(F.transform(F.filter(all_, lambda h: h["label"] == n), lambda h: h["confidence"]))
        names = F.array_distinct(F.transform(all_, lambda h: h["label"]))
        return let(names, lambda x: F.map_from_arrays(x, F.transform(x, best)))

    return let(found, merged)


def wide(df: DataFrame, key: str, text: str, rules: Sequence[Rule] = CAPTION_RULES) -> DataFrame:
    """key and one 0/1 column a rule, ``regex_<i>``; the pattern is in the column's metadata."""
    return df.select(key, *[F.coalesce(F.col(text).rlike(r.pattern), F.lit(False)).cast("int").alias(f"regex_{i}", metadata={"pattern": r.pattern, "label": r.label}) for i, r in enumerate(rules)])


def predict(df: DataFrame, text: str = "caption", rules: Sequence[Rule] = CAPTION_RULES, predictor: Predictor | None = None) -> DataFrame:
    """Adds predictions, map label -> confidence."""
    make = predictor or (lambda c: hits(c, rules))
    return df.withColumn("__hits", make(F.col(text))).withColumn("predictions", best_by_label(F.col("__hits"))).drop("__hits")


def predict_articles(articles: DataFrame, rules: Sequence[Rule] = CAPTION_RULES, predictor: Predictor | None = None) -> DataFrame:
    """Articles whose graphics got the hits of their figure's caption; a higher confidence that a graphic already has stays."""
    make = predictor or (lambda c: hits(c, rules))

    def graphic(g: Column, found: Column) -> Column:
        had = F.coalesce(g["predictions"].cast("map<string,float>"), F.create_map().cast("map<string,float>"))
        merged = F.map_zip_with(had, found, lambda k, a, b: F.greatest(a, b))
        return F.struct(g["id"].alias("id"), merged.alias("predictions"))

    def figure(f: Column) -> Column:
        found = best_by_label(make(f["caption"])).cast("map<string,float>")
        merged = let(found, lambda m: F.transform(f["graphics"], lambda g: graphic(g, m)))
        return F.struct(*[f[c].alias(c) for c in ("id", "label", "caption", "references")], merged.alias("graphics"))

    return articles.withColumn("figures", F.transform("figures", figure))


def argmax_label(predictions: Column, ordinals: Sequence[str], default: str | None = None) -> Column:
    """The label of the highest confidence, ties to the first of ``ordinals``; without any, the default."""
    place = F.create_map(*[x for i, n in enumerate(ordinals) for x in (F.lit(n), F.lit(i))])
    entries = F.transform(F.map_entries(predictions), lambda e: F.struct(e["value"].alias("c"), (-F.coalesce(F.try_element_at(place, e["key"]), F.lit(len(ordinals)))).alias("o"), e["key"].alias("label")))
    return F.coalesce(F.array_max(entries)["label"], F.lit(default))


def unknown(df: DataFrame, text: str = "caption", rules: Sequence[Rule] = CAPTION_RULES, longer_than: int = 5) -> DataFrame:
    """Captions that no rule hits, longer than a few characters."""
    return df.filter((F.size(hits(F.col(text), rules)) == 0) & (F.length(text) > longer_than))


def hit_listing(articles: DataFrame, rules: Sequence[Rule] = CAPTION_RULES) -> DataFrame:
    """(kind, label, confidence, what): CAP a hit of a caption, GRAPHIC a hit for each graphic, ??? a caption without hits."""
    figures = articles.select("dir", F.explode("figures").alias("f")).select("dir", "f.caption", "f.graphics", F.explode_outer(hits(F.col("f.caption"), rules)).alias("h"))
    caption = figures.select(F.when(F.col("h").isNull(), "???").otherwise("CAP").alias("kind"), "h.label", "h.confidence", F.col("caption").alias("what"))
    graphics = figures.filter("h is not null").select("dir", "h", F.explode("graphics").alias("g"))
    return caption.unionByName(graphics.select(F.lit("GRAPHIC").alias("kind"), "h.label", "h.confidence", F.concat_ws("/", "dir", "g.id").alias("what")))


def rule_table(spark, rules: Sequence[Rule] = CAPTION_RULES) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(float(r.confidence)).alias("confidence")) for i, r in enumerate(rules)])))
