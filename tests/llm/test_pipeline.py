"""The pipeline's stages against the brute-force versions of the operators' tests."""

import re
import zlib
from array import array

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import lines, quality
from tests.llm import test_lines, test_native, test_near
from tests.llm.fixtures import documents


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    df = documents(spark, False).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(corpus_pipeline.COLUMNS).withColumn("doc_id", F.col("doc_id") + 1000))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.quality(df).filter("kept").collect()}  # its measures are tested by themselves
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id in good]
    assert all(not test_native.brute_quality(t)[-1] for _, t in rows)
    rows = [(i, t) for i, t, _, gone in test_lines.brute(rows, lines.MIN_CHARS, lines.MIN_FUZZY) if not gone or test_native.WORD.search(t)]
    stay = {c for _, c, _, _ in test_near.brute(rows)}
    want = []
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in sorted(rows):
        if i in stay:
            for s, o, e, k in reversed([x for x in test_native.brute_secrets(t) if not any(y != x and y[0] <= x[0] and x[2] <= y[2] for y in test_native.brute_secrets(t))]):
                t = t[:s] + f"<{k.upper()}>" + t[e:]
            ids = array("I", [*hf.encode(t, add_special_tokens=False).ids, 2])
            first = len(ids) % 1024 or min(len(ids), 1024)
            cuts = [(0, first)] + [(x, 1024) for x in range(first, len(ids), 1024)]
            want += [(i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cuts)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 1024 and sorted(b)[0][0] == 0 for b in bins.values())


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = documents(spark)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, empty, "").count() == 0, name
    assert re.match(r"<ASSIGN>", {r.doc_id: r.text for r in corpus_pipeline.hide_secrets(spark, docs, "").collect()}[13])
