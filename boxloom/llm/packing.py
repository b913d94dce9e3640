"""Hierarchical multi-length packing of tokenized documents.

Each document's ids (and the end id) are cut into full windows; what remains is routed to
the tier of the next power of two (1024, 512, 256, ... tokens). Tiers are packed from the
longest down, each into sequences of its own length: a piece of the tier opens a sequence,
and the gap behind it takes the longest fitting pieces of shorter tiers; where none fits, one
is cut to the gap and its rest goes back to its own tier. Pieces for whose gaps the shorter
tiers hold too little are joined into full windows, cut where they must. Only what is left at
the end of a partition is below one window; it is cut along the bits of its length. So each
sequence is a power of two long and none needs padding.

Sequences of a tier are dealt into step groups of equal tokens whose costs (sum of squared
piece lengths, as in attention) are close. All is one narrow pass: no shuffle, memory bounded
by UNIT_TOKENS and the longest document. Sequence ids hold the partition's number, so a task
that runs again gives the same rows.

Null and empty texts are the end id alone. Very long texts are cut into windows like any
other. Repeated rows are packed each; null ids stay. Pieces of equal length are taken last
come, first served. Empty tables give no rows. Other columns aren't read, so their names
can't clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import blocks, sliced

WINDOW = 1024
END_ID = 0
#: Tokens that are packed together, the bound of a task's memory.
UNIT_TOKENS = 2_000_000
#: Windows of tokens of a training step.
STEP = 8
#: Ids that a worker keeps for the chunks it has met, before it starts anew.
CACHE = 2_000_000
#: Chunks that are encoded in one call: its results hold far more than the ids.
CALL = 4096
#: Bytes of text whose distinct chunks are looked up together.
BLOCK = 4 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_tokens long, step_group long"
)
def _blank(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character may start at these places of the padded bytes (ASCII controls count too)."""
    one, two, three = raw[at], raw[at + 1], raw[at + 2]
    wide = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80)
    wide |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    return (one <= 0x20) | wide | (one == 0xE2) & (two == 0x81) & (three == 0x9F) | (one == 0xE3) & (two == 0x80) & (three == 0x80)


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts start, and where a blank stands between two characters that aren't white space."""
    if not len(raw):
        return np.zeros(0, np.int64)
    padded = np.r_[np.full(3, 0x21, np.uint8), raw, np.zeros(3, np.uint8)]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(raw == 0x20)
    at = at[~edge[at] & ~edge[at + 1]]
    before = (padded[at + 2] <= 0x20) | (padded[at + 2] >= 0x80) & (_blank(padded, at) & (padded[at] >= 0xE1) | _blank(padded, at + 1) & (padded[at + 1] == 0xC2))
    edge[at[~before & ~_blank(padded, at + 4)]] = True
    return np.flatnonzero(edge[:-1])


class Encoder:
    """Ids of whole texts. A blank between two other characters always starts a token of the
    byte-level pattern, so texts are cut there; only distinct chunks are looked up and encoded,
    and a text's ids are gathered from theirs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _places(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in chunks if c not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            ids, sizes = [], []
            for i in range(0, len(new), CALL):
                found = [e.ids for e in self.model.encode_batch_fast(new[i : i + CALL], add_special_tokens=False)]
                ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
                sizes += map(len, found)
            self.ids = np.concatenate([self.ids, *ids])
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes)]
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for _, raw, offsets in blocks(texts, BLOCK):
            if len(self.ids) > CACHE:
                self.clear()
            start = chunk_starts(raw, offsets)
            if not len(start):
                yield from [np.zeros(0, "<u4")] * (len(offsets) - 1)
                continue
            ends = pa.py_buffer(np.r_[start, len(raw)].astype(np.int64))
            coded = pa.LargeStringArray.from_buffers(len(start), ends, pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
            place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            begin, size = self.ends[place], self.ends[place + 1] - self.ends[place]
            upto = np.r_[0, np.cumsum(size)]
            ids = self.ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
            cut = upto[np.searchsorted(start, offsets)].tolist()
            yield from (ids[a:b] for a, b in zip(cut[:-1], cut[1:]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Tiers:
    """Pieces (document, start, length) by length; a tier holds the lengths up to it and above the next shorter one."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0
        self.held: dict[int, int] = {}  # tokens of each tier

    @staticmethod
    def tier_of(length: int) -> int:
        return 1 << (length - 1).bit_length()

    @property
    def total(self) -> int:
        return sum(self.held.values())

    def below(self, tier: int) -> int:
        return sum(n for t, n in self.held.items() if t < tier)

    def add(self, doc: int, start: int, length: int) -> None:
        self.by.setdefault(length, []).append((doc, start))
        self.bits |= 1 << length
        tier = self.tier_of(length)
        self.held[tier] = self.held.get(tier, 0) + length

    def _pop(self, length: int) -> tuple[int, int, int]:
        doc, start = self.by[length].pop()
        if not self.by[length]:
            self.bits &= ~(1 << length)
        self.held[self.tier_of(length)] -= length
        return doc, start, length

    def open(self, tier: int) -> tuple[int, int, int] | None:
        """The tier's longest piece."""
        own = (self.bits & ((2 << tier) - 1)) >> (tier // 2 + 1)
        return self._pop(tier // 2 + own.bit_length()) if own else None

    def fill(self, room: int) -> list[tuple[int, int, int]]:
        """Pieces for the whole room: the longest that fit; else the shortest longer one, cut to it."""
        got = []
        while room:
            fits = self.bits & ((2 << room) - 1)
            if fits:
                got.append(self._pop(fits.bit_length() - 1))
            else:
                longer = self.bits >> (room + 1)
                doc, start, length = self._pop(room + (longer & -longer).bit_length())
                self.add(doc, start + room, length - room)
                got.append((doc, start, room))
            room -= got[-1][2]
        return got


def pack_unit(lengths: list[int], tiers: Tiers, first: int, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of documents first, first + 1, ... and of what the tiers hold; less than a window stays in them."""
    out: list[list[tuple[int, int, int]]] = []
    for doc, n in enumerate(lengths, first):
        out += [[(doc, s, window)] for s in range(0, n - window + 1, window)]
        if n % window:
            tiers.add(doc, n - n % window, n % window)
    kept, tier = [], window
    while tier:
        below = tiers.below(tier)
        while (piece := tiers.open(tier)) is not None:
            gap = tier - piece[2]
            if below < gap:
                kept.append(piece)  # waits, so that no piece of its own tier is cut for it
                continue
            out.append([piece, *tiers.fill(gap)])
            below -= gap
        tier //= 2
    for piece in kept:
        tiers.add(*piece)
    while tiers.total >= window:
        out.append(tiers.fill(window))
    return out


def pack_rest(tiers: Tiers, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of a power of two for what is below one window, longest first."""
    out, size = [], window
    while left := tiers.total:
        while size > left:
            size //= 2
        out.append(tiers.fill(size))
    return out


def balance(sequences: list[list[tuple[int, int, int]]], step: int = STEP, window: int = WINDOW) -> list[int]:
    """A group number for each sequence; groups hold one length and ``step`` windows of tokens, costly and cheap ones in turn."""
    by: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        by.setdefault(sum(p[2] for p in s), []).append(i)
    out, first = [0] * len(sequences), 0
    for size, own in sorted(by.items(), reverse=True):
        n = -(-len(own) * size // (step * window))
        order = sorted(own, key=lambda i: (-sum(p[2] ** 2 for p in sequences[i]), i))
        for rank, i in enumerate(order):
            lap, at = divmod(rank, n)
            out[i] = first + (n - 1 - at if lap % 2 else at)
        first += n
    return out


def _packer(path: str, window: int, unit_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tiers = encoder(path), Tiers()
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        held: dict[int, tuple] = {}  # document -> (doc_id, ids)
        fresh: list[int] = []
        counts = {"doc": 0, "seq": 0, "group": 0}

        def emit(sequences):
            groups = balance(sequences, STEP, window)
            rows = []
            for g, seq in zip(groups, sequences):
                offset, total = 0, sum(p[2] for p in seq)
                for doc, start, length in seq:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, len(ids) // 4, base + counts["seq"], offset, total, base + counts["group"] + g))
                    offset += length
                counts["seq"] += 1
            counts["group"] += max(groups, default=-1) + 1
            still = {doc for pieces in tiers.by.values() for doc, _ in pieces}
            for doc in [d for d in held if d not in still]:
                del held[doc]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            for i in range(0, len(rows), 50_000):
                cols = zip(*rows[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        tokens = 0
        for batch in batches:
            for doc_id, code in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                code = code.tobytes() + end
                held[counts["doc"]] = (doc_id, code)
                counts["doc"] += 1
                fresh.append(len(code) // 4)
                tokens += len(code) // 4
                if tokens >= unit_tokens:
                    yield from emit(pack_unit(fresh, tiers, counts["doc"] - len(fresh), window))
                    fresh, tokens = [], 0
        done = pack_unit(fresh, tiers, counts["doc"] - len(fresh), window)
        yield from emit(done + pack_rest(tiers, window))

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    unit_tokens: int = UNIT_TOKENS,
) -> DataFrame:
    """One row per piece: where its document's ids stand, in which sequence, and their check sum."""
    pairs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return pairs.mapInArrow(sliced(_packer(tokenizer, window, unit_tokens), 2000), SCHEMA)
