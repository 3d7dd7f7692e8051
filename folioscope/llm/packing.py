"""Best-fit packing by sums of squares.

Documents become token ids, an end id each, and pieces of at most ``capacity`` tokens; only longer documents are cut, and
only their first piece may be shorter. Full pieces fill a sequence alone. The others are placed one at a time, longest
first: of all open bins that a piece fits it takes the one that leaves the sum of squared counts of open bins per residual
gap smallest, and it opens a new bin only where none fits, as fewer sequences are wanted. Taking a bin of gap g and leaving gap h changes the sum by 2*(N[h] - N[g]) + 2, so one vector
over the gaps finds the place; ties go to the smallest gap left.

Scale: no ids leave the task that made them, only lengths and checksums. Pieces are dealt by a hash of their document
and of themselves over groups of about ``group_docs`` documents' pieces, whose number follows a count of the input, so
neither null or repeated ids nor long documents make one group large; each group is packed by itself in memory that its
size bounds. Full pieces take a sequence each, before the others are placed.

Nulls: a null text packs as the end id alone, as an empty one does; a null id stays null. Repeated rows are packed as
documents of their own. Empty tables give no rows. Texts that hold an added token of the vocabulary (as ``<|endoftext|>``) are
encoded by the library itself, which makes one id of it. Extra columns aren't carried; texts of any length are encoded whole.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

CAPACITY = 1024
END = 2
GROUP_DOCS = 16_384
NEVER = 1 << 60
PIECES = "{key} {kind}, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _memo(path: str, pattern: str):
    """Parts of texts to ids by the tokenizers library, each part once; one a Python worker."""
    import regex
    from tokenizers import Tokenizer

    from folioscope.llm.bpe import PartMemo, with_spaces

    pieces = regex.compile(with_spaces(pattern))
    whole, letters = Tokenizer.from_file(path), byte_letters()
    model = whole.model

    def make(part: str) -> bytes:
        found = pieces.findall(part)
        if len(found) > 1:
            return memo.join(found)
        written = part.encode("utf-8").decode("latin-1").translate(letters)
        return array("I", [t.id for t in model.tokenize(written)]).tobytes()

    memo = PartMemo(make)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    return memo, added, whole


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, piece, start, length and ids_crc32 of every piece."""
    tail = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, added, library = _memo(path, pattern)

        def encode(t: str) -> bytes:
            if any(a in t for a in added):
                return array("I", library.encode(t, add_special_tokens=False).ids).tobytes()
            return memo.encode(t)

        for b in batches:
            rows = []
            for at, t in enumerate(b.column(1).to_pylist()):
                ids = (encode(t) if t else b"") + tail
                rows += [(at, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            at, *made = zip(*rows) if rows else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *map(pa.array, made, kinds)], [key, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, PIECES.format(key=key, kind=kind))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, in the given order, and the number of bins."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; gap 0 (full) counts for nothing
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        had, left = counts[n:], counts[: capacity + 1 - n]  # by the gap before, n..capacity, and the gap it would leave
        change = np.where(had > 0, 2 * (left - had) + 2, NEVER)
        if had[0]:
            change[0] = 1 - 2 * had[0]  # a full bin is no longer open
        at = int(change.argmin())
        if change[at] == NEVER:
            gap, b = capacity, used
            used += 1
        else:
            gap = at + n
            b = bins[gap].pop()
            counts[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        rest = gap - n
        if rest:
            counts[rest] += 1
            bins[rest].append(b)
    return where, offset, used


def pack(found: DataFrame, docs: int, key: str = "doc_id", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Adds sequence_id and offset to pieces (see ``pieces``); docs: about how many documents there are."""
    groups = max(1, math.ceil(docs / group_docs))
    schema = found.schema

    def run(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in (key, "piece", "ids_crc32"))]
        group = group.take(pc.sort_indices(group, sort_keys=order))
        lengths = group.column("length").to_numpy()
        n_full = int((lengths == capacity).sum())
        where, offset, _ = place(lengths[n_full:], capacity)
        number = np.concatenate([np.arange(n_full), n_full + where]) + (group.column("__group")[0].as_py() << 40)
        made = pa.array(number, pa.int64()), pa.array(np.concatenate([np.zeros(n_full, np.int64), offset]), pa.int64())
        return group.drop_columns(["__group"]).append_column("sequence_id", made[0]).append_column("offset", made[1])

    dealt = found.withColumn("__group", F.pmod(F.xxhash64(F.col(key), "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(run, StructType(schema.fields).add("sequence_id", LongType()).add("offset", LongType()))


def best_fit(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, group_docs: int = GROUP_DOCS) -> DataFrame:
    return pack(pieces(df, path, pattern, key, text, capacity, end), df.count(), key, capacity, group_docs)
