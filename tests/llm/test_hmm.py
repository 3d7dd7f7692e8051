"""The language model against plain sums, all paths, and held-out likelihood."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import hmm
from tests.llm.fixtures import documents


def test_forward_equals_sum_over_paths():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    start, move, emit = norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0)
    texts = [np.array(x) for x in ([0, 4, 2, 2], [1], [3, 3, 0], [0, 1, 2, 3, 4, 0])]
    got = hmm.forward(texts, start, move, emit)
    for t, g in zip(texts, got):
        p = sum(start[s[0]] * emit[t[0], s[0]] * math.prod(move[s[i - 1], s[i]] * emit[t[i], s[i]] for i in range(1, len(t))) for s in itertools.product(range(3), repeat=len(t)))
        assert g == pytest.approx(math.log10(p), abs=1e-9)


def test_expected_counts_equal_sum_over_paths():
    rng = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    k, v = 2, 4
    start, move, emit = norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0)
    texts = [[0, 3, 2], [1, 1]]
    ids, lengths = np.full((2, 3), v), np.array([3, 2])
    for i, t in enumerate(texts):
        ids[i, : len(t)] = t
    starts, moves, emits, total = hmm.expected(ids, lengths, start, move, emit, v)
    s0, m0, e0, ll = np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), 0.0
    for t in texts:
        paths = {s: start[s[0]] * emit[t[0], s[0]] * math.prod(move[s[i - 1], s[i]] * emit[t[i], s[i]] for i in range(1, len(t))) for s in itertools.product(range(k), repeat=len(t))}
        z = sum(paths.values())
        ll += math.log10(z)
        for s, p in paths.items():
            s0[s[0]] += p / z
            for i, x in enumerate(s):
                e0[t[i], x] += p / z
                if i:
                    m0[s[i - 1], x] += p / z
    assert np.allclose(starts, s0) and np.allclose(moves, m0) and np.allclose(emits, e0) and total == pytest.approx(ll)


@pytest.mark.parametrize("symbols", [1 << 15, 20])
def test_scores(spark, sf_dir, symbols):
    df = documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars"))
    df = df.unionByName(spark.createDataFrame([(None, "null id words", None, None, None)], df.schema))
    rows = df.collect()
    cut = lambda t: [*(x for x in (t or "").encode().lower().split()), b"</s>"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not held(r.doc_id) for w in cut(r.text))
    n, v = sum(c.values()), len(c)
    out = hmm.language_model(df, symbols=symbols, rounds=3).collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0, held(r.doc_id), len(w := cut(r.text)), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for r in rows))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert np.allclose([g[-1] for g in got], [w[-1] for w in want], rtol=1e-9)
    long = [r for r in out if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in long) > sum(r.base_score for r in long)  # the states help on texts not seen, whatever the head


def test_empty_and_untrained(spark):
    df = documents(spark, False)
    assert hmm.language_model(df.limit(0)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = hmm.language_model(spark.createDataFrame([(only, "never seen")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score)


def test_rounds_raise_the_likelihood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    ids = [np.array([hash(w) % 50 for w in hmm.tokens(r.text)] + [51], np.uint16) for r in docs.collect()]
    enc = spark.createDataFrame([(i.tobytes(), False) for i in ids], "ids binary, held_out boolean")
    _, history = hmm.train(enc, np.full(52, 1 / 52), 3, 4)
    assert all(b > a for a, b in zip(history, history[1:]))


def plain_model(rows, symbols, rounds, states=hmm.STATES):
    """The model and all scores by loops over single tokens: rounds with a shared tail, then one in which each token counts by itself."""
    texts = [(i, [*hmm.tokens(t), hmm.END]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [w for i, w in texts if not held(i)]
    c = Counter(x for w in train for x in w)
    level = lambda n: n if n <= 64 else math.floor(math.log2(n) * 16) - 32
    words = {x: n for x, n in c.items() if x != hmm.END}
    levels = sorted({level(n) for n in words.values()}, reverse=True)
    fit = [v for v in levels if sum(level(n) >= v for n in words.values()) <= symbols]
    head = sorted((x for x, n in words.items() if level(n) >= fit[-1]), key=lambda x: (-words[x], x)) if fit else []
    tail = [x for x in words if x not in set(head)]
    total, all_ = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    rest = "the rest"
    hashes = [np.uint64(xxhash.xxh64_intdigest(x, seed=42)).view(np.int64) for x in head] + [1, 2]
    own = np.array([*(c[x] for x in head), sum(c[x] for x in tail) + 0.5 * len(tail), c[hmm.END]]) + 0.5
    names = [*head, rest, hmm.END]
    e = own[:, None] / all_ * np.exp(hmm.noise(np.array(hashes), states))
    emit, unigram = dict(zip(names, e / e.sum(0))), dict(zip(names, own / all_))
    start, move = hmm._first_moves(states)
    each = {x: 1 for x in names} | {rest: 1 + len(tail)}

    def passes(symbol):
        """Expected counts of one round; symbol: which emissions a token takes, and under which name it is counted."""
        starts, moves, emits, like = np.zeros(states), np.zeros((states, states)), {}, 0.0
        flow = np.linalg.matrix_power(move, 4096)[0]
        for w in train:
            for at in range(0, len(w), hmm.SEGMENT):
                o = [symbol(x) for x in w[at : at + hmm.SEGMENT]]
                alpha, scale = [], []
                for t, (x, _) in enumerate(o):
                    a = (alpha[-1] @ move if t else flow if at else start) * emit[x]
                    scale.append(a.sum())
                    alpha.append(a / a.sum())
                beta = np.ones(states)
                for t in reversed(range(len(o))):
                    g = alpha[t] * beta
                    emits[o[t][1]] = emits.get(o[t][1], 0) + g
                    if t:
                        b = emit[o[t][0]] * beta / scale[t]
                        moves += alpha[t - 1][:, None] * move * b
                        beta = move @ b
                    elif not at:
                        starts += g
                like += np.log10(scale).sum()
        return starts, moves, emits, like

    known, history = set(names), []

    def maximised(starts, moves, emits, names, unigram, each):
        mass = sum(emits.values())
        e = {x: emits.get(x, 0) + 0.5 * each.get(x, 1) * mass / mass.sum() + hmm.COMMON * mass * unigram[x] for x in names}
        norm = sum(e.values())
        return (starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), {x: v / norm for x, v in e.items()}

    for _ in range(rounds):
        starts, moves, emits, like = passes(lambda x: (x, x) if x in known else (rest, rest))
        start, move, emit = maximised(starts, moves, emits, names, unigram, each)
        history.append(like)
        if len(history) > 1 and history[-1] - history[-2] < -hmm.TOLERANCE * history[-2]:
            break
    starts, moves, emits, _ = passes(lambda x: (x, x) if x in known else (rest, x))
    every = [*c, rest]
    start, move, emit = maximised(starts, moves, emits, every, {x: (c[x] + 0.5) / all_ for x in every}, {})
    out = {}
    for i, w in texts:
        a, like = start, 0.0
        for t, x in enumerate(w):
            a = (a @ move if t else a) * emit.get(x, emit[rest])
            like += math.log10(a.sum())
            a = a / a.sum()
        out[i] = like
    return out


@pytest.mark.parametrize("symbols", [1 << 15, 40])
def test_scores_equal_plain_training(spark, sf_dir, monkeypatch, symbols):
    """Every score, of seen and unseen texts, against training by loops; blocks are small, so the tail's table is joined in many."""
    monkeypatch.setattr(hmm, "BLOCK", 2000)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 700).alias("text")).limit(60)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = plain_model(rows, symbols, 3)
    got = {r.doc_id: r.score for r in hmm.language_model(df, symbols=symbols, rounds=3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in got)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "some words here", 1), ("b", "some other words", 2), (None, "words", 3)], "doc_id string, text string, held_out int")
    got = {r.doc_id: r for r in hmm.language_model(df).collect()}
    assert got.keys() == {"a", "b", None} and all(got[i].held_out == (zlib.crc32(i.encode()) % 5 == 1) for i in "ab") and not got[None].held_out
