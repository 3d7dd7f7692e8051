"""The corpus pipeline: quality rules, line dedup, one document of each near-duplicate group, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the folder in spark.checkpoint.dir and reads them again, so a lost
executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import lines, near, packing, quality, secrets
from folioscope.llm._native import keep_where
from folioscope.llm.storage import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_where(quality.quality(docs), "kept").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a line go, and documents that had nothing else; n_chars follows the text."""
    out = keep_where(lines.dedup_lines(docs.select(COLUMNS)), (F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near duplicates, the one with the least id stays."""
    return near.one_of_each(docs.select(COLUMNS))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become their kind in angle brackets; n_chars follows the text."""
    out = secrets.redact(docs.select(*COLUMNS, F.col("text").alias("was")))
    changed = ~F.col("text").eqNullSafe(F.col("was"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, with their places in sequences."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("secret_scans", hide_secrets),
    ("best_fit_packing", pack),
]

#: The last stage packs token ids, which SQL can't make; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
