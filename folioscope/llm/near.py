"""N-gram Jaccard join by MinHash banding.

Words are hashed in the JVM; five of them in a row make a shingle (a text of one to four words is one shingle). Texts
with equal shingle sets form a class, represented by its least id, so copies are never paired. For a class, the least
values of BANDS * ROWS permutations make a signature; equal bands meet in a bucket, and every pair of a bucket is verified
on its full shingle sets. At similarity s a pair is missed with probability (1 - s**ROWS)**BANDS: 0.0001 at the
threshold of 0.8, less above it; ``bands_for`` chooses the bands for a wanted recall.

Scale: only hashes move until buckets with two or more classes are known; then the sets of their classes move, and no
text ever does: a sieve of bounded size tells which texts to read again. Buckets with equal members are verified once.
A bucket is cut into blocks of BLOCK classes or fewer, as their shingles allow; each pair of blocks is a task-sized cell,
and within a cell intersections are counted by a matrix product, so no pair becomes a row: a cell returns one row a class,
with its number of links and one edge of a spanning forest. A pair that meets in several buckets counts in the first they
share.

Nulls: a null text counts as empty; texts without words have no shingles and no links. Rows with a null id take no part
and come back without links or class. Repeated rows (equal id and text) are copies of one another. Ties don't arise:
similarity is compared in integers. Empty tables give no rows. Texts of any length are read whole. Extra columns are
ignored, whatever their names. Ids must be whole numbers; other types raise a TypeError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._native import prefix, whole_id, words
from folioscope.llm.components import components
from folioscope.llm.sieve import maybe
from folioscope.llm.storage import forget, kept

N = 5
SIMILARITY = (4, 5)  # a fraction, so that comparisons are exact
ROWS = 3
RECALL = 0.9999
#: Classes of a block, and shingles (of 8 bytes) that blocks hold on average at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Words that are hashed at once, which bounds a worker's buffers.
SLAB = 1 << 20
COLUMNS = 1 << 14


def bands_for(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands that finds a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(SIMILARITY[0] / SIMILARITY[1])
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(hashes: np.ndarray, n: int = N) -> np.ndarray:
    """The sorted distinct shingles of one text's word hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(out)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash per band of each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    a, b = permutations(bands * rows)
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat(flat * a[k] + b[k], starts)
        out[:, k // rows] = mix(out[:, k // rows] + least + np.uint64(k))
    return out


def _slabs(column) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of word-hash arrays of about SLAB words, with the place of the first."""
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    i = 0
    while i < len(column):
        j = i + 1
        while j < len(column) and ends[j + 1] - ends[i] <= SLAB:
            j += 1
        yield i, [flat[ends[x] : ends[x + 1]] for x in range(i, j)]
        i = j


def _sketch(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, docs in _slabs(batch.column(1)):
                sets = [shingle_sets(h, n) for h in docs]
                full = [i for i, s in enumerate(sets) if len(s)]
                key = np.zeros((len(sets), 2), np.uint64)
                sig = np.zeros((len(sets), bands), np.uint64)
                if full:
                    sig[full] = signatures([sets[i] for i in full], bands, rows)
                    key[full, 0] = [np.bitwise_xor.reduce(sets[i]) for i in full]
                    key[full, 1] = [np.add.reduce(mix(sets[i])) for i in full]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), sizes, pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(sig.view(np.int64).ravel()))],
                    ["id", "n", "k1", "k2", "bands"],
                )

    return run


def _gather(n: int):
    """The whole sets of texts; rows equal in id and set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, docs in _slabs(batch.column(1)):
                rows = []
                for i, h in zip(ids[at:], docs):
                    s = shingle_sets(h, n)
                    k1 = int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0
                    if (i, k1) not in seen:
                        seen.add((i, k1))
                        rows.append((i, k1, s.tobytes()))
                cols = zip(*rows) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["rep", "k1", "shingles"])

    return run


def linked(a: list[np.ndarray], b: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets reach the similarity: intersections by a product over the shingles that both sides hold."""
    ids, inverse = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    left = owner < len(a)
    in_both = (np.bincount(inverse[left], minlength=len(ids)) > 0) & (np.bincount(inverse[~left], minlength=len(ids)) > 0)
    column = np.cumsum(in_both) - 1
    use = in_both[inverse]
    owner, inverse, left = owner[use], column[inverse[use]], left[use]
    order = np.argsort(inverse, kind="stable")
    owner, inverse, left = owner[order], inverse[order], left[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    width = int(in_both.sum())
    for start in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(inverse, [start, start + COLUMNS])
        x, y = np.zeros((len(a), min(COLUMNS, width - start)), np.float32), np.zeros((len(b), min(COLUMNS, width - start)), np.float32)
        l, o, c = left[lo:hi], owner[lo:hi], inverse[lo:hi] - start
        x[o[l], c[l]] = 1
        y[o[~l] - len(a), c[~l]] = 1
        shared += x @ y.T
    both = shared.astype(np.int64)
    up, down = similarity
    return down * both >= up * (na[:, None] + nb[None, :] - both)


def verify(cell: dict, similarity: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(class, its root in this cell, links to documents, links to classes) of a cell's classes that have links."""
    ids, band, weight = cell["rep"], cell["band"], cell["weight"]
    sides, same = cell["side"], cell["same"]
    rows = np.arange(len(ids))
    ia, ib = (rows, rows) if same else (rows[sides == 0], rows[sides == 1])
    if not len(ia) or not len(ib):
        return []
    sets = cell["shingles"]
    hit = linked([sets[i] for i in ia], [sets[i] for i in ib], similarity)
    keys = cell["buckets"]
    if same:
        hit &= np.triu(np.ones_like(hit), 1)
    first = np.full(hit.shape, True)
    for k in range(band):  # a bucket of an earlier band that both are in has counted the pair
        first &= ~((keys[ia, k][:, None] == keys[ib, k][None, :]) & (keys[ia, k][:, None] != 0))
    p, q = np.nonzero(hit & first)
    p, q = ia[p], ib[q]
    docs, texts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for x, y in ((p, q), (q, p)):
        np.add.at(docs, x, weight[y])
        np.add.at(texts, x, 1)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(p.tolist(), q.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y, key=lambda i: ids[i])] = min(x, y, key=lambda i: ids[i])
    return [(int(ids[i]), int(ids[find(i)]), int(docs[i]), int(texts[i])) for i in np.flatnonzero(texts)]


def _cells(similarity: tuple[int, int]):
    """Rows sorted by cell; a cell at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell, last = [], None, None
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                weight = np.array([h[3] for h in held], np.int64)
                out.extend(verify({"rep": np.array([h[1] for h in held]), "side": np.array([h[2] for h in held]), "weight": weight, "buckets": np.array([h[4] for h in held]), "shingles": [np.frombuffer(h[5], np.uint64) for h in held], "band": cell[1], "same": cell[2] == cell[3]}, similarity))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 4)], ["rep", "root", "docs", "texts"])
            out.clear()
            return made

        for b in batches:
            for bucket, band, i, j, rep, side, weight, buckets, shingles in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                if (bucket, band, i, j) != cell:
                    close()
                    held, cell, last = [], (bucket, band, i, j), None
                if (rep, side) != last:  # repeated rows come from several tasks
                    held.append((None, rep, side, weight, buckets, shingles))
                    last = rep, side
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()

    return run


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, similarity: tuple[int, int] = SIMILARITY, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK, made: list | None = None) -> DataFrame:
    """One row per row of df: id, class_id, n_links (other documents at or above the similarity), n_copies (of them, with an equal set).

    class_id is the least id of all documents that links connect. Written tables are put on the list ``made``.
    """
    made = [] if made is None else made
    bands = bands_for(similarity[0] / similarity[1], rows, recall)
    hashed = lambda d: d.select(whole_id(df, key).alias("id"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))
    docs = df.select(key, text).filter(F.col(key).isNotNull())
    sketch = kept(hashed(df.select(key, text)).mapInArrow(_sketch(bands, rows, n), "id long, n long, k1 long, k2 long, bands array<long>"), "sketches", made)
    same = ["n", "k1", "k2"]
    classes = kept(sketch.filter("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.max("bands").alias("bands")), "classes", made)

    buckets = classes.select("rep", "n", F.posexplode("bands").alias("band", "h"))
    full = buckets.groupBy("band", "h").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s")).filter("size > 1")
    # Buckets with the same members are one: the first band's stays. A bucket's blocks hold few classes, and few shingles.
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(block)), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")
    full = full.groupBy("size", "shingles", "x", "s").agg(F.min(F.struct("band", "h")).alias("b")).select(F.col("b.band").alias("band"), F.col("b.h").alias("h"), blocks)
    members = buckets.join(full, ["band", "h"]).select("rep", "band", F.when(F.col("h") == 0, 1).otherwise(F.col("h")).alias("h"), "blocks")
    per_class = members.groupBy("rep").agg(F.collect_list(F.struct("band", "h", "blocks")).alias("in"))
    slots = F.sequence(F.lit(0), F.lit(bands - 1))
    per_class = per_class.select("rep", "in", F.transform(slots, lambda b: F.coalesce(F.get(F.filter("in", lambda x: x["band"] == b), F.lit(0))["h"], F.lit(0).cast("long"))).alias("buckets"))
    per_class = kept(per_class.join(classes.select("rep", "k1", "weight"), "rep"), "members", made)

    # Only texts that may stand for such a class are read again; they don't move, their sets do.
    wanted = maybe(docs, whole_id(df, key), per_class, F.col("rep"), "near").filter("near")
    ready = per_class.join(hashed(wanted).mapInArrow(_gather(n), "rep long, k1 long, shingles binary"), ["rep", "k1"])
    placed = ready.withColumn("b", F.explode("in"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("b.blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)))
    cells = placed.select(
        F.col("b.h").alias("bucket"), F.col("b.band").alias("band"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep",
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "weight", "buckets", "shingles",
    )
    dealt = cells.repartition("bucket", "band", "i", "j").sortWithinPartitions("bucket", "band", "i", "j", "rep", "side")
    found = kept(dealt.mapInArrow(_cells(similarity), "rep long, root long, docs long, texts long"), "links", made)
    links = found.groupBy("rep").agg(F.sum("docs").alias("docs"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), made=made)
    by_class = classes.select(*same, "rep", "weight").join(links, "rep", "left").join(named, F.col("rep") == F.col("vertex"), "left")
    by_class = by_class.select(*same, F.coalesce("component", "rep").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("weight") - 1).alias("n_links"), (F.col("weight") - 1).alias("n_copies"))
    # Classes of one text without links need no join: only the others are looked up.
    odd = kept(by_class.filter("n_links > 0"), "linked", made)
    zero = F.lit(0).cast("long")
    out = sketch.select("id", *[F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in same]).join(odd, same, "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df but for those that a class's least id represents. Of rows equal in id and text one stays. Rows without an id stay."""
    made: list[DataFrame] = []
    found = jaccard_join(df, key, text, made=made).select(F.col(key).alias("id"), "class_id").filter("id is not null")
    flags = found.groupBy("id").agg(F.max(F.col("class_id") < F.col("id")).alias("gone"), (F.count("*") > 1).alias("again")).filter("gone or again")
    odd = kept(flags, "later")
    forget(*made)
    # Only rows whose id may be on that list move.
    p = prefix(df)
    flagged = maybe(df, whole_id(df, key), odd, F.col("id"), f"{p}odd")
    odd = odd.select(F.col("id").alias(f"{p}id"), F.col("gone").alias(f"{p}gone"), F.col("again").alias(f"{p}again"))
    met = flagged.filter(f"{p}odd").join(odd, whole_id(df, key) == F.col(f"{p}id"), "left").filter(~F.coalesce(F.col(f"{p}gone"), F.lit(False)))
    again = F.coalesce(F.col(f"{p}again"), F.lit(False))
    same = [F.col(f"`{c}`") for c in df.columns]
    out = flagged.filter(~F.col(f"{p}odd")).select(same).unionByName(met.filter(~again).select(same))
    return out.unionByName(met.filter(again).select(same).dropDuplicates([key, text]))
