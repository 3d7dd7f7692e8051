"""Rules over a stream of tab-separated captions, enrichment of each micro-batch, and windowed counts of events.

The rule projection is the batch one, so batch and stream have the same plan and no state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.joins import enrich
from folioscope.operators.rules_engine import wide
from folioscope.rules import CAPTION_RULES, Rule
from folioscope.sources.files import tab_pairs


def caption_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(id, caption) of text files as they arrive in a folder."""
    return tab_pairs(spark.readStream.text(folder))


def rule_lines(captions: DataFrame, rules: Sequence[Rule] = CAPTION_RULES, sep: str = "\t") -> DataFrame:
    """One line a caption: its id and a 0 or 1 a rule."""
    table = wide(captions, "id", "caption", rules)
    return table.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in table.columns]).alias("value"))


def enrich_stream(keys: DataFrame, key: str, known: Callable[[], DataFrame], fetch, append, sink: Callable[[DataFrame, int], None]):
    """A started query's writer: each micro-batch is looked up, what is missing is fetched and appended, and the result goes to sink."""
    return keys.writeStream.foreachBatch(lambda batch, epoch: sink(enrich(batch, key, known(), fetch, append), epoch))


def event_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their total value by window and type; in a stream, windows close once ``late`` has passed."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
