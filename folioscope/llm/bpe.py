"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. The BPE tokens of a text are the only sequence whose neighbours are all compatible: the merges, applied to two
neighbours' bytes alone, give back just these two. So one left-to-right pass suffices. A nondeterministic transducer
keeps, for each place where a token may still begin, the tokens up to that place and the bytes since; on the next byte a
hypothesis grows or, if its bytes are a token compatible with the one before, closes. All hypotheses together, relative
to the last token that went out, are one state of a deterministic machine. Its transitions are computed when first
needed and kept (bounded). A token goes out once every live hypothesis agrees on it; as no token is longer than the
longest vocabulary entry, that needs a bounded lookahead. ``\\p{...}`` pieces are encoded separately.

Decoding. Token bytes go through an incremental UTF-8 machine, which holds back an unfinished character until the next
token completes it; bytes that are not UTF-8 become U+FFFD, as Python's decoder has it.

Memory: vocabulary, transitions, pairs and piece memo are bounded and emptied when full. Nulls: a null text counts as
empty and gives no tokens. Very long texts and very long pieces take linear time. Repeated rows and ties don't interact:
each row is encoded by itself. Extra columns stay (``encode``); those named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: Unicode white space, spelled out so that every regex library agrees on it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Parts of a text that pieces never cross: a run without white space and the blank before it, or white space.
PART = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Two white characters in a row, or one at either end.
DOUBLE = re.compile(f"[{SPACE}](?:[{SPACE}]|\\Z)|\\A[{SPACE}]")
MEMO = 400_000
LONG = 48


def with_spaces(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelled out."""
    inside = re.sub(r"\[\^?[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE), pattern)
    return inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes one piece of bytes at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        #: What begins a longer token, with the token that it is itself, or -1; and the other tokens.
        self.open = {p: ranks.get(p, -1) for t in ranks for p in (t[:k] for k in range(1, len(t)))}
        self.closed = {t: i for t, i in ranks.items() if t not in self.open}
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.states.clear()
        self.numbers.clear()
        self.steps.clear()
        self._number((((-1,), b""),))

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def merges(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first: the plain definition, for the few bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self.made:
            data, ranks = self.tokens[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: (r if (r := ranks.get(parts[i] + parts[i + 1], token)) < token else 1 << 60))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.made[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.made[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when a's and b's bytes are merged together.

        Undoing both tokens' merges from the last made, the pairs that once met at the border come up; a pair
        whose merge would have come before the undone ones would have crossed it.
        """
        pair = a << 20 | b
        known = self.pairs.get(pair)
        if known is not None:
            return known
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()
        left, right, ranks, tokens = a, b, self.ranks, self.tokens
        limit, known = 1 << 60, True
        while True:
            crossing = ranks.get(tokens[left] + tokens[right])
            if crossing is not None and crossing < limit:
                known = False
                break
            l, r = self.halves(left), self.halves(right)
            if l is None and r is None:
                break
            if r is None or (l is not None and left > right):
                limit, left = left, l[1]
            else:
                limit, right = right + 1, r[0]
        self.pairs[pair] = known
        return known

    def _step(self, n: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state's number and what goes out, both kept."""
        live, whole = [], None
        last, opened, closed = bytes((byte,)), self.open, self.closed
        for path, tail in self.states[n]:
            grown = tail + last
            token = opened.get(grown)
            if token is None:
                token = closed.get(grown, -1)
            else:
                live.append((path, grown))
            if token >= 0 and whole is None and (path[-1] < 0 or self.compatible(path[-1], token)):
                whole = (*path, token)
        if whole is not None:
            live.append((whole, b""))
        agreed, (model, _) = 0, min(live, key=lambda h: len(h[0]))
        while agreed + 1 < len(model) and all(p[agreed + 1] == model[agreed + 1] for p, _ in live):
            agreed += 1
        out = model[1 : agreed + 1]
        to = self._number(tuple((p[agreed:], t) for p, t in live))
        self.steps[n << 8 | byte] = to, out
        return to, out

    def encode(self, data: bytes) -> list[int]:
        if len(self.steps) > 2 * MEMO:
            self._reset()
        ids: list[int] = []
        n, steps = 0, self.steps
        for byte in data:
            got = steps.get(n << 8 | byte)
            n, out = got if got is not None else self._step(n, byte)
            if out:
                ids += out
        for path, tail in self.states[n]:
            if not tail:
                return ids + list(path[1:])
        raise ValueError("the vocabulary lacks a byte")


class Memo(dict):
    """What ``make`` gives for a string, remembered in two generations of ``room`` entries: those still asked for move on, the rest are forgotten."""

    def __init__(self, make, room: int = MEMO):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.make(part)
        if len(part) <= LONG:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class PartMemo(Memo):
    """Ids as little-endian unsigned 32-bit integers, by part; and, by what follows a blank, of the blank and it."""

    def __init__(self, make, room: int = MEMO):
        super().__init__(make, room)
        self.after_blank = Memo(self._after_blank, room)

    def _after_blank(self, rest: str) -> bytes:
        return b"".join(map(self.__getitem__, PART.findall(" " + rest))) if DOUBLE.search(rest) else self.make(" " + rest)

    def join(self, pieces: list[str]) -> bytes:
        """Ids of the pieces of a part."""
        first = self.after_blank[pieces[0][1:]] if len(pieces[0]) > 1 and pieces[0][0] == " " else self[pieces[0]]
        return first + b"".join(map(self.__getitem__, pieces[1:]))

    def encode(self, text: str) -> bytes:
        """Text without two white characters in a row falls apart at blanks, which is quicker than a pattern."""
        if DOUBLE.search(text):
            return b"".join(map(self.__getitem__, PART.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.__getitem__, PART.findall(first)), *map(self.after_blank.__getitem__, rest)])


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pieces = regex.compile(with_spaces(pattern))
        self.memo = PartMemo(self._part)

    def _part(self, part: str) -> bytes:
        pieces = self.pieces.findall(part)
        if len(pieces) == 1:
            return array("I", self.piece(part)).tobytes()
        return self.memo.join(pieces)

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.machine.ranks.get(data)
        return [whole] if whole is not None else self.machine.encode(data)

    def encode(self, text: str | None) -> bytes:
        return self.memo.encode(text) if text else b""

    def decode(self, ids: bytes, block: int = 4096) -> Iterator[str]:
        """Text, block by block of tokens; a character that a block leaves unfinished comes with the next."""
        numbers = array("I")
        numbers.frombytes(ids)
        machine, tokens = Utf8(), self.machine.tokens
        for i in range(0, len(numbers), block):
            yield machine.feed(b"".join(map(tokens.__getitem__, numbers[i : i + block])))
        yield machine.end()


class Utf8:
    """Incremental UTF-8: the state is the bytes of an unfinished character, three at most."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            lead = data[cut - back]
            if lead & 0xC0 == 0x80:
                continue
            wants = 4 if 0xF0 <= lead <= 0xF4 else 3 if 0xE0 <= lead < 0xF0 else 2 if 0xC2 <= lead < 0xE0 else 1
            if wants > back:
                cut -= back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a Python worker."""
    return Codec(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids (array of int) to the rows of df."""
    kept = [c for c in df.columns if c != "ids"]
    schema = StructType(df.select(*kept).schema.fields).add("ids", ArrayType(IntegerType()))
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            coded = [own.encode(t) for t in b.column(at).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*kept, "ids"])

    return df.select(*kept).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: a round trip of every text, one text's ids at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            n, coded, decoded = [], [], []
            for t in b.column(1).to_pylist():
                ids = own.encode(t)
                back = hashlib.sha256()
                for part in own.decode(ids):
                    back.update(part.encode("utf-8"))
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(back.hexdigest())
            made = pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *made], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
