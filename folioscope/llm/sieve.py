"""A sieve of bounded size: which rows of a large table can't be among some ids, found without moving the table.

A blocked Bloom filter as a table: each id sets BITS of the 64 bits of one word, words are combined by ``bit_or``, and
their table, of at most MOST_WORDS rows (some 50 MB), is broadcast. Rows that the sieve holds back are surely not among the
ids; the others may be, and are joined as usual. With a sixteenth of an id a bit, some 0.3 per cent of strangers pass.
Beyond MOST_WORDS * 4 ids more and more pass, so more rows move, and no result changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 20
IDS_A_WORD = 4
BITS = 4


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word of an id, and its bits there."""
    one = F.lit(1).cast("long")
    dice = F.xxhash64(key, F.lit(words))
    bits = [F.call_function("shiftleft", one, F.call_function("shiftright", dice, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.pmod(F.xxhash64(key), F.lit(words).cast("long")), out


def maybe(df: DataFrame, key: Column, ids: DataFrame, of: Column, flag: str) -> DataFrame:
    """df with the boolean ``flag``: false where key is none of the ids' ``of``. ids is read twice; let it be a written table."""
    words = 64
    count = ids.count()
    while words < MOST_WORDS and words * IDS_A_WORD < count:
        words *= 2
    word, bits = _place(of, words)
    held = ids.select(word.alias(f"{flag}_word"), bits.alias(f"{flag}_bits")).groupBy(f"{flag}_word").agg(F.bit_or(f"{flag}_bits").alias(f"{flag}_bits"))
    word, bits = _place(key, words)
    met = df.join(F.broadcast(held), word == F.col(f"{flag}_word"), "left")
    hit = F.coalesce(F.col(f"{flag}_bits").bitwiseAND(bits) == bits, F.lit(False))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(flag))
