"""The registered queries of this subpackage, thin wrappers that derive each contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, hmm, lines, near, packing, pii, quality, search, secrets, urls

#: The rules that the query judges pages by; fixed values.
URL_RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _spans(found: DataFrame, kinds: tuple[str, ...], digest) -> DataFrame:
    from folioscope.llm._native import listed

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, digest(F.col("base_spans")).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")), pii.KINDS[:4], pii.digest)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")), ("assign", "access", "hex"), secrets.digest)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_top_k_search, op3_quality_rules, op4_pii, op5_url_filters, op6_ngram_jaccard, op7_secret_scans, op8_byte_bpe, op9_lm_scoring, op10_best_fit_packing)}
