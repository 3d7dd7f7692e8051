"""Encoding, decoding and packing against the tokenizer libraries and plain Python."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import bpe, packing
from tests.llm.fixtures import documents

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return t


def ids_of(data):
    return list(memoryview(data).cast("I")) if data else []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghijklmnopqrstuvwxyzABC '.,0123\n\t\r  \x85\x1c　é漢😀ñß-=_"), max_size=80))
def test_transducer_equals_library(text):
    import tiktoken

    enc = test_transducer_equals_library.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}))
    c = bpe.codec(RANKS, P.PATTERN)
    got = c.encode(text)
    assert ids_of(got) == enc.encode_ordinary(text)
    assert "".join(c.decode(got, 2)) == text


def test_long_pieces_and_full_memos(tik):
    c = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)
    c.memo.room = c.memo.after_blank.room = 5
    rng = random.Random(1)
    for s in ["a" * 9000, "ab" * 4000, " " * 2000, "=" * 3000 + "x", "\n" * 999 + "x", "0123456789" * 500, *(" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 14))) for _ in range(40)) for _ in range(50))]:
        assert ids_of(c.encode(s)) == tik.encode_ordinary(s)


def test_utf8_machine():
    data = "aé漢😀".encode() + b"\xff\xe6\xbc" + b"x"
    for step in (1, 2, 3, 5):
        m = bpe.Utf8()
        assert "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.end() == data.decode("utf-8", "replace")


def test_encode_query(spark, sf_dir, tik):
    df = documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))
    rows = df.collect()
    want = sorted((r.doc_id, len(i := tik.encode_ordinary(r.text or "")), hashlib.sha256(array("I", i).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted(map(tuple, bpe.digests(df, RANKS, P.PATTERN).collect())) == want
    out = bpe.encode(df.withColumnRenamed("lang", "ids"), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "ids"] and all(r.ids == tik.encode_ordinary(r.text or "") for r in out.limit(30).collect())
    assert bpe.digests(df.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut(n, want):
    assert packing.cut(n, 1024) == want


def sum_of_squares_brute(lengths, capacity):
    gaps, used = [], 0
    for n in lengths:
        best = None
        for g in {g for g in gaps if g >= n}:
            after = list(gaps)
            after.remove(g)
            after += [g - n] if g > n else []
            cost = (sum(after.count(x) ** 2 for x in set(after)), g)
            best = min(best, cost) if best else cost
        if best is None:
            used += 1
            g = capacity
        else:
            g = best[1]
            gaps.remove(g)
        gaps += [g - n] if g > n else []
    return used


def test_placement_follows_the_sum_of_squares():
    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 20) for _ in range(60)), reverse=True)
        where, offset, used = packing.place(np.array(lengths), 20)
        assert used == sum_of_squares_brute(lengths, 20)
        assert used <= -(-sum(lengths) // 20) * 1.2 + 1


def test_packing_query(spark, sf_dir, hf):
    df = documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars"))
    docs = df.collect()
    rows = packing.best_fit(df, JSON, P.PATTERN, group_docs=100).collect()
    want = []
    for d in docs:
        ids = array("I", [*hf.encode(d.text or "", add_special_tokens=False).ids, 2])
        want += [(d.doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(bins) <= total / 1024 * 1.03 + 4
    assert packing.best_fit(df.limit(0), JSON, P.PATTERN).count() == 0
    nulls = spark.createDataFrame([(None, None), (2**60 + 1, "a b")], "doc_id long, text string")
    assert {r.doc_id for r in packing.best_fit(nulls, JSON, P.PATTERN).collect()} == {None, 2**60 + 1}


def test_added_tokens_and_repeated_ids(spark, hf):
    """What the library makes one id of is one id; null and repeated ids don't gather in one group."""
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endof")] + [(None, "same words " * 30)] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.best_fit(df, JSON, P.PATTERN, group_docs=50).collect()
    for i, t in rows[:3]:
        ids = array("I", [*hf.encode(t, add_special_tokens=False).ids, 2])
        assert [(r.length, r.ids_crc32) for r in got if r.doc_id == i] == [(len(ids), zlib.crc32(ids.tobytes()))]
    own = {r.sequence_id >> 40 for r in got if r.doc_id is None}
    assert len(got) == len(rows) and len(own) > 4
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 1024 for b in bins.values())
