"""A hidden Markov language model: Baum-Welch counts over partitions, exact likelihoods by the scaled forward recursion.

Tokens are words with A-Z in lower case, and one end a text. Counts of all training tokens give the base score. Every
token of the training texts ends up with emissions of its own, however many there are; one more symbol stands for all
unseen ones; so the model gives every text a probability. Scores come from one forward pass over each whole text, with one
scaling factor a token, whose logarithms add up to the likelihood.

Training takes every training text in every round, cut into stretches of SEGMENT tokens; starts are counted where a text
starts, other stretches begin with the chain's long-run distribution. While the states are found, the tokens outside the
head (the SYMBOLS most frequent ones or fewer, as all tokens of one frequency are in it or none) share one profile over
states, each with its own share of it; rounds go on until the likelihood rises by less than TOLERANCE of itself, at most
ROUNDS. A last round unties them: one more pass adds up the expected emissions of each of them by itself, wherever it occurs.

Scale: the head's emissions go to the driver and the workers. Those of all other tokens (the tail) are a table in the shared
folder, by the token's 64-bit hash. It joins the distinct tail tokens of each block of about BLOCK tokens, once, to score;
none of them can be frequent, so that join has no hot key. Blocks are scored in PARTS parts, so that only a part of these
pairs is on disk at once. Which counts the head has is read from a histogram of counts, so
nothing is sorted or met in one task. Encoded texts are written once to the shared folder, so rounds do not read texts again.
What a step wrote is deleted after its last use.

Nulls: a null text counts as empty, and is one end token. A null id is no held-out one (its checksum is null) and trains.
Rows equal in id and text are scored alike, and each counts in training. Empty tables give no rows; without any training
text all counts are 0. Ties in frequency are in the head together or not at all. Very long texts are read whole; their time
is linear. Ids may be of any type. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import forget, kept

FOLDS, HELD_OUT = 5, 1
SYMBOLS = 1 << 15
STATES = 6
#: Rounds with a shared tail, and the rise of the likelihood, as a share of it, that ends them.
ROUNDS, TOLERANCE = 8, 0.002
SEGMENT = 64
STAY = 0.95
COMMON = 0.05
#: Segments worked on at once, and distinct tokens counted before they are handed on.
SLAB, COUNTED = 4096, 400_000
BLOCK = 1 << 21
#: Rows of a batch that a worker handles at once, and parts in which blocks are scored, each with its own shuffle.
ROWS, PARTS = 1024, 4
#: Symbols are 16-bit numbers in encoded texts; the last ones are kept free.
MOST_SYMBOLS = 65_000
END = b"\n"  # no word holds a line feed


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
        seen.clear()
        return made

    for b in _fewer(batches):
        for text in b.column(0).to_pylist():
            seen.update(tokens(text))
            seen[END] += 1
            if len(seen) > COUNTED:
                yield out()
    yield out()


def _level(c: Column) -> Column:
    """Counts up to 64 by themselves, larger ones in steps of a sixteenth of an octave."""
    return F.when(c <= 64, c).otherwise(F.floor(F.log2(c.cast("double")) * 16) - 32).cast("long")


def head_level(words: DataFrame, symbols: int) -> int:
    """The least level such that at most ``symbols`` words have it or a higher one."""
    sizes = sorted(((r.level, r.n) for r in words.groupBy(_level(F.col("c")).alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = (sizes[0][0] + 1 if sizes else 1), 0
    for level, n in sizes:
        total += n
        if total > symbols:
            break
        least = level
    return least


_HEADS: dict = {}


def _lookup(head) -> tuple[dict[bytes, int], np.ndarray]:
    """Symbol of each token of the head, and log10(c + 0.5) by symbol, with 0 for all others; built once a worker."""
    name, names, counts = head.value
    if name not in _HEADS:
        _HEADS.clear()
        _HEADS[name] = {t: s for s, t in enumerate(names)}, np.append(np.log10(np.asarray(counts, float) + 0.5), 0.0)
    return _HEADS[name]


ENCODED = "doc_id {kind}, held_out boolean, p long, block boolean, n_tokens long, head_tokens long, head_base double, ids binary, tail array<binary>"


def _encode(head, rest: int, end: tuple, block: int):
    """Symbols of each text, the head's share of its sums, and the tokens outside the head, each of which has the symbol ``rest``.

    Texts that follow one another make blocks p of about ``block`` tokens; a row of its own holds a block's distinct tokens outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = _lookup(head)
        p, size, seen, kind = TaskContext.get().partitionId() << 32, 0, set(), None

        def made(doc, held, rows) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([doc, held, *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "held_out", "p", "block", "n_tokens", "head_tokens", "head_base", "ids", "tail"])

        def closed() -> pa.RecordBatch:
            return made(pa.nulls(1, kind), pa.nulls(1, pa.bool_()), [(p, True, 0, 0, 0.0, b"", list(seen))])

        for b in _fewer(batches):
            rows, kind, ended = [], b.column(0).type, []
            for text in b.column(2).to_pylist():
                words = tokens(text)
                found = np.fromiter(map(known.get, words, repeat(rest)), np.uint16, len(words))
                tail = list(compress(words, (found == rest).tolist()))
                ids = np.append(found, np.uint16(end[0]))
                rows.append((p, False, len(ids), len(words) - len(tail) + end[1], float(logs[found].sum()) + end[2], ids.tobytes(), tail))
                seen.update(tail)
                size += len(ids)
                if size >= block:
                    ended.append(closed())
                    p, size, seen = p + 1, 0, set()
            yield made(b.column(0), b.column(1), rows)
            yield from ended
        if size:
            yield closed()

    return run


def long_run(move: np.ndarray) -> np.ndarray:
    """The distribution over states that a chain of these moves tends to."""
    return np.linalg.matrix_power(move, 1 << 12).mean(0)


def expected(ids: np.ndarray, lengths: np.ndarray, start, move, emit, symbols: int, opens: np.ndarray | None = None, watch: int | None = None):
    """Expected starts, transitions, emissions and log-likelihood of segments: rows of ids, padded with ``symbols``.

    opens: which segments open a text (all, if not given). watch: a symbol whose occurrences' states are returned as well, in order.
    """
    opens = np.ones(len(ids), bool) if opens is None else opens
    n, width = ids.shape
    k = len(start)
    at = np.ascontiguousarray(ids.T)
    likely = np.take(np.vstack([emit, np.ones(k)]).T.copy(), at, axis=1)  # k, width, n: every step works on long rows
    alpha = np.empty((k, width, n))
    scale = np.empty((width, n))
    a = np.where(opens, start[:, None], long_run(move)[:, None]) * likely[:, 0]
    for t in range(width):
        if t:
            a = move.T @ alpha[:, t - 1]
            a *= likely[:, t]
        np.sum(a, axis=0, out=scale[t])
        np.divide(a, scale[t], out=alpha[:, t])
    beta = np.ones((k, n))
    moves = np.zeros((k, k))
    for t in range(width - 2, -1, -1):
        inside = likely[:, t + 1] * beta
        inside /= scale[t + 1]
        moves += (alpha[:, t] * (t + 1 < lengths)) @ inside.T
        beta = move @ inside
        alpha[:, t] *= beta  # from here on the states' probabilities
    gamma, flat = alpha, at.ravel()
    emits = np.stack([np.bincount(flat, gamma[j].ravel(), symbols + 1)[:symbols] for j in range(k)], 1)
    out = gamma[:, 0, opens].sum(1), moves * move, emits, np.log10(scale).sum()
    if watch is None:
        return out
    i, t = np.nonzero(ids == watch)
    return *out, gamma[:, t, i].T


def segments(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of texts, one a row, their lengths, and which of them open a text."""
    parts = [(i == 0, t[i : i + SEGMENT]) for t in texts for i in range(0, len(t), SEGMENT)]
    out = np.full((len(parts), SEGMENT), pad, np.int64)
    for i, (_, p) in enumerate(parts):
        out[i, : len(p)] = p
    return out, np.array([len(p) for _, p in parts], int), np.array([first for first, _ in parts], bool)


def _decoded(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in column.to_pylist()]


def _estep(model, rest: int | None = None):
    """One row a symbol: its expected emissions by state. Symbols -1.. hold transitions, -1000 the starts, -1001 the likelihood.

    With ``rest``, also one row of kind 1 for each hash of a tail token, in the slabs that hold it, with how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = model.value
        k, symbols = len(start), len(emit)
        starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k)), 0.0

        def out(kind: int, symbol, c, rows) -> pa.RecordBatch:
            n = len(symbol)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(symbol, pa.int64()), pa.array(c, pa.int64()), *(pa.array(rows[:, j].astype(np.float32 if kind else float).astype(float)) for j in range(k))], ["kind", "symbol", "c", *(f"s{j}" for j in range(k))])

        for b in _fewer(batches):
            ids, lengths, opens = segments(_decoded(b.column(0)), symbols)
            tail, done = (b.column(1).flatten().to_numpy(), 0) if rest is not None else (None, 0)
            for i in range(0, len(ids), SLAB):
                at = slice(i, i + SLAB)
                s, m, e, x, *own = expected(ids[at], lengths[at], start, move, emit, symbols, opens[at], rest)
                starts, moves, emits, total = starts + s, moves + m, emits + e, total + x
                if own and len(own[0]):  # a slab at a time, so that little is held
                    h, place = np.unique(tail[done : done + len(own[0])], return_inverse=True)
                    done += len(own[0])
                    yield out(1, h, np.bincount(place), np.stack([np.bincount(place, own[0][:, j]) for j in range(k)], 1))
        if rest is not None:
            emits[rest] = 0  # its tokens are counted by themselves
        some = np.flatnonzero(emits.sum(1))
        names = np.concatenate([some, -1 - np.arange(k), [-1000, -1001]])
        yield out(0, names, np.zeros(len(names), int), np.vstack([emits[some], moves, starts, np.full(k, total)]))

    return run


def noise(hashes: np.ndarray, states: int) -> np.ndarray:
    """Normal numbers that depend on a token's hash alone, so that they are the same in the head and in the tail."""
    x = np.asarray(hashes, np.int64).view(np.uint64)[:, None] + np.arange(1, 2 * states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = (((x ^ (x >> np.uint64(31))) >> np.uint64(11)) + 0.5) / 2.0**53
    return np.sqrt(-2 * np.log(u[:, :states])) * np.cos(2 * np.pi * u[:, states:])


def first_model(unigram: np.ndarray, states: int, hashes: np.ndarray | None = None):
    hashes = np.arange(len(unigram)) if hashes is None else hashes
    emit = unigram[:, None] * np.exp(noise(hashes, states))
    return *_first_moves(states), emit / emit.sum(0)


def _first_moves(states: int):
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return np.full(states, 1 / states), move


def _updated(symbol: np.ndarray, values: np.ndarray, unigram: np.ndarray, tail_mass, others: int, weight: np.ndarray | None = None):
    """(start, move, emit), the mass and the norm of each state, and the likelihood, from a round's sums.

    ``others`` symbols are in the tail; weight: how many tokens each symbol stands for (one, if not given)."""
    states = values.shape[1]
    weight = np.ones(len(unigram)) if weight is None else weight
    at = {int(s): v for s, v in zip(symbol[symbol < 0], values[symbol < 0])}
    emits = np.zeros((len(unigram), states))
    emits[symbol[symbol >= 0]] = values[symbol >= 0]
    mass = emits.sum(0) + tail_mass
    # Half a count a token, dealt over states, as in the base score; and a share of all states' common frequencies.
    emits += 0.5 * weight[:, None] * mass / mass.sum() + COMMON * mass * unigram[:, None]
    norm = emits.sum(0) + tail_mass + 0.5 * others * mass / mass.sum() + COMMON * mass * (1 - unigram.sum())
    moves = np.vstack([at[-1 - j] for j in range(states)]) + 0.1
    starts = at[-1000] + 0.1
    return (starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / norm), mass, norm, float(at[-1001][0])


def _names(states: int) -> list[str]:
    return [f"s{j}" for j in range(states)]


def _schema(states: int) -> str:
    return "kind int, symbol long, c long, " + ", ".join(f"{n} double" for n in _names(states))


def _summed(sums: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray]:
    return sums.column("symbol").to_numpy(), np.column_stack([sums.column(n).to_numpy() for n in _names(states)])


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS, hashes: np.ndarray | None = None, weight: np.ndarray | None = None, tolerance: float = 0.0):
    """(start, move, emit) after some rounds over all training texts, and each round's log10-likelihood."""
    spark = encoded.sparkSession
    model = first_model(unigram, states, hashes)
    ids = encoded.filter("not held_out").select("ids")
    history: list[float] = []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        sums = ids.mapInArrow(_estep(sent), _schema(states)).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in _names(states)]).toArrow()
        sent.unpersist()
        symbol, values = _summed(sums, states)
        if not values[symbol >= 0].size:
            break
        model, _, _, likelihood = _updated(symbol, values, unigram, 0.0, 0, weight)
        history.append(likelihood)
        _sweep(spark)
        if len(history) > 1 and likelihood - history[-2] < tolerance * -history[-2]:
            break
    return model, history


def untie(encoded: DataFrame, model, unigram: np.ndarray, others: int, all_: float, rest: int):
    """The head's model after one more round, and the table (h, c, v) of the emissions of each tail token by itself."""
    spark = encoded.sparkSession
    states = len(model[0])
    names = _names(states)
    sent = spark.sparkContext.broadcast(model)
    each = encoded.filter("not held_out").select("ids", "hs").mapInArrow(_estep(sent, rest), _schema(states))
    done = kept(each.groupBy("kind", "symbol").agg(F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in names]).select("kind", "symbol", "c", *[F.col(n).cast("double") for n in names]), "round")
    sent.unpersist()
    _sweep(spark)
    tail = done.filter("kind = 1")
    symbol, values = _summed(done.filter("kind = 0").select("symbol", *names).toArrow(), states)
    share, mass, norm = 0.0, np.zeros(states), np.ones(states)
    if values[symbol >= 0].size:
        tail_mass = np.array([x or 0.0 for x in tail.agg(*[F.sum(n) for n in names]).first()], float)
        model, mass, norm, _ = _updated(symbol, values, unigram, tail_mass, others)
        share = float(0.5 / mass.sum())
    own = F.lit(share) + COMMON * (F.col("c") + 0.5) / F.lit(all_)
    emissions = tail.select(F.col("symbol").alias("h"), "c", F.array(*[((F.col(n) + own * float(mass[j])) / float(norm[j])).cast("float") for j, n in enumerate(names)]).alias("v"))
    emissions.__dict__["path"] = done.__dict__["path"]
    return model, emissions


def _sweep(spark, wait: float = 0.0) -> None:
    """Lets Spark's cleaner delete the shuffles of what is written and no longer used; wait: seconds that it gets before the next step begins."""
    for _ in range(2 if wait else 1):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def _own_symbols(texts: pa.Table, found: pa.Table, emit: np.ndarray, rest: int):
    """Of a block: its texts in symbols of its own, the emissions of these, and the counts of its tail's symbols."""
    h, first = np.unique(found.column("h").to_numpy(), return_index=True)
    c = found.column("c").to_numpy()[first]
    table = np.empty((len(emit) + len(h), emit.shape[1]))
    table[: len(emit)] = emit
    table[len(emit) :] = found.column("v").combine_chunks().flatten().to_numpy().reshape(-1, emit.shape[1])[first]
    parts = [np.frombuffer(x, np.uint16) for x in texts.column("ids").to_pylist()]
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    if len(h):
        t = texts.column("hs").combine_chunks().flatten().to_numpy()  # one for each symbol ``rest``, in order
        i = np.minimum(np.searchsorted(h, t), len(h) - 1)
        flat[flat == rest] = np.where(h[i] == t, len(emit) + i, rest)
    return np.split(flat, np.cumsum([len(x) for x in parts])[:-1]) if parts else [], table, c


def forward(texts: list[np.ndarray], start, move, emit) -> np.ndarray:
    """log10 probability of each whole text: scaled forward recursion, all texts a step at a time, the longest last to end."""
    out = np.zeros(len(texts))
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    if not order:
        return out
    lengths = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order])
    begin = np.cumsum([0, *lengths[:-1]])
    got = np.zeros(len(order))
    live = len(order)
    a, table = np.tile(start[:, None], live), emit.T.copy()
    for t in range(int(lengths[0])):
        while lengths[live - 1] <= t:
            live -= 1
        a = (move.T @ a[:, :live] if t else a[:, :live]) * np.take(table, flat[begin[:live] + t], axis=1)
        s = a.sum(0)
        got[:live] += np.log10(s)
        a /= s
    out[order] = got
    return out


SCORED = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, states double"


def _score(sent, rest: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        start, move, emit = sent.value
        own, table, c = _own_symbols(texts, found, emit, rest)
        logs = np.log10(np.concatenate([[0.5], c + 0.5]))
        n = len(emit)
        places = [x[(x >= n) | (x == rest)] for x in own]
        base = [logs[np.where(x == rest, 0, x - n + 1)].sum() for x in places]
        known = [int((x >= n).sum()) for x in places]
        add = lambda name, more, kind: pa.array(texts.column(name).to_numpy() + np.array(more, kind))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": texts.column("n_tokens"), "n_known": add("head_tokens", known, np.int64),
            "base": add("head_base", base, float), "states": pa.array(forward(own, start, move, table)),
        })

    return run


def language_model(df: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc_id"), is_held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    counts = kept(docs.filter("not held_out").select("text").mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    _sweep(spark)
    total, kinds, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == END, F.col("c"))), F.lit(0))).first()
    words = counts.filter(F.col("token") != END).select(F.xxhash64("token").alias("symbol"), "token", "c")
    top = words.filter(_level(F.col("c")) >= head_level(words, min(symbols, MOST_SYMBOLS))).toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    names, c = top.column("token").to_pylist(), top.column("c").to_pylist()
    forget(counts)
    rest, end = len(names), len(names) + 1
    # All tokens, the end, and one that stands for the unseen.
    others = kinds - len(names) - (ends > 0)
    all_ = total + 0.5 * (len(names) + 2 + others)
    unigram = (np.array([*c, 0, ends], float) + 0.5) / all_
    shared = unigram.copy()
    shared[rest] += (total - ends - sum(c) + 0.5 * others) / all_
    weight = np.ones(len(unigram))
    weight[rest] += others
    hashes = np.array([*top.column("symbol").to_pylist(), 1, 2], np.int64)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, names, c))
    encoded = docs.mapInArrow(_encode(sent, rest, (end, int(ends > 0), float(np.log10(ends + 0.5))), BLOCK), ENCODED.format(kind=kind))
    encoded = kept(encoded.select(*[x.split()[0] for x in ENCODED.split(", ")[:-1]], F.transform("tail", lambda t: F.xxhash64(t)).alias("hs")), "encoded")
    texts, blocks = encoded.filter("not block"), encoded.filter("block")
    model, _ = train(texts, shared, states, rounds, hashes, weight, tolerance)
    model, emissions = untie(texts, model, unigram, others, all_, rest)
    final = spark.sparkContext.broadcast(model)
    done = []
    for part in range(PARTS):
        _sweep(spark, 1.0)  # what the last step shuffled is large
        mine = f"pmod((p >> 32) + (p & {(1 << 32) - 1}), {PARTS}) = {part}"
        pairs = blocks.filter(mine).select(F.col("p").alias("q"), F.explode("hs").alias("h"))
        scored = texts.filter(mine).groupBy("p").cogroup(pairs.join(emissions, "h").groupBy("q")).applyInArrow(_score(final, rest), SCORED.format(kind=kind))
        kept(scored, "scored", done)
    forget(encoded, emissions)
    scored = reduce(DataFrame.unionAll, done)
    per_token = float(np.log10(total + 0.5 * (kinds + 1)))
    return scored.select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), F.col("states").alias("score"),
    )
