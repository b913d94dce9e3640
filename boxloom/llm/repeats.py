"""Removal of repeated byte strings by prefix-free parsing.

A byte that lies in a 50-byte string which also starts in a document with a smaller id is
removed. Texts are parsed into phrases at triggers: positions whose rolling hash of 24
bytes is the smallest of 27 neighbours. A trigger depends only on the bytes around it, and
every 50-byte string holds exactly one leading trigger, so equal strings lie in equal
places of equally triggered phrases; no position is lost, whatever the hash values are.

1. Exact copies: only the smallest id of equal texts is parsed, the others go whole.
2. Triggers that occur in several documents mark the phrases that may repeat. Documents are
   read in units; a unit sends each of its triggers once to the trigger's part and gets one
   answer from every part, so a trigger shared by a third of all documents costs one record
   a unit. A unit's answers meet and are dealt to its documents.
3. The marked phrases, each with the bytes its strings need, meet by trigger. Every part
   holds the distinct phrases (the dictionary, in lexicographic order) and their places (the
   parse). The dictionary's suffix array orders all suffixes of at least 50 bytes; the
   parse's suffix array orders the places by phrase rank, then document. No string passes the
   end of its phrase, so that array needs a depth of one phrase. Combined they are the corpus
   order: a run of equal suffixes belongs to the smallest document of its phrases, and every
   other place is a repeat.
4. Every document collects the places of its repeated strings and drops their bytes.

The number of parts follows the input, without a bound; a unit sends at most one record to a
part and none without triggers, so records never outnumber triggers.

Null and empty texts have no bytes. Texts below 50 bytes lose nothing. Rows that repeat an
id are one document, whatever their texts: they never shorten each other, and each is judged
by its own bytes. Rows with a null id lose nothing and shorten no others. Very long texts
are parsed in one block of their own. Empty tables give no rows. Other columns travel in a
struct and can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Scratch, blocks, prefix_sums, range_hashes, sliced, small_enough

LENGTH, TRIGGER = 50, 24
#: Bytes of text whose phrases form one dictionary before the shuffle.
UNIT_BYTES = 8 << 20
#: Bytes of text for each part of the trigger space.
PART_BYTES = 16 << 20
#: Bytes of text for each part of the dictionaries: each holds up to a suffix a byte.
SUFFIX_BYTES = 2 << 20
#: Keys of exact copies up to this number are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_HIGH, _PLACE = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)
_REST = _U((1 << 40) - 2)


def phrases(raw: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """(text, first, last, hash): strings of ``length`` bytes starting at first..last share a trigger."""
    n, wide = len(raw), length - trigger + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = np.arange(n - trigger + 1)
    rolling = range_hashes(sums, at, at + trigger)
    least, have = (rolling & _HIGH) | at.astype(np.uint64), 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    lens = np.diff(offsets)
    text = np.repeat(np.arange(len(lens)), lens)[: n - length + 1]
    start = np.arange(n - length + 1)
    start = start[start + length <= offsets[text + 1]]
    place = (least[start] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(start) else np.zeros(0, np.int64)
    first = start[new]
    last = start[np.r_[new[1:] - 1, len(start) - 1]] if len(start) else first
    return text[first], first, last, rolling[place[new]]


def _split(order_by: np.ndarray):
    """Starts and ends of runs of equal values."""
    cut = np.flatnonzero(np.r_[True, order_by[1:] != order_by[:-1]]) if len(order_by) else np.zeros(0, np.int64)
    return cut, np.r_[cut[1:], len(order_by)] if len(cut) else cut


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) % _U(parts)).astype(np.int64)


#: What a unit sends: its rows (ROWS), places it knows itself (TOLD), or records of a part.
ROWS, TOLD = -2, -1
_UP = "unit long, part int, a binary, b binary"
_DOWN = "unit long, places binary"
_ROW = np.dtype([("doc", "<i8"), ("key", "<i8")])
#: A row of the unit and five bytes of a trigger.
_MARK = np.dtype([("row", "<u4"), ("low", "<u4"), ("high", "u1")])
#: A row of the unit, a place in it, and which strings from there on are repeats.
_CUT = np.dtype([("row", "<u4"), ("at", "<u4"), ("mask", "<u4")])
_ENTRY = np.dtype([("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("size", "u1")])


def _marks(row: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), _MARK)
    out["row"], out["low"], out["high"] = row, rest & _U(0xFFFFFFFF), rest >> _U(32)
    return out


def _rest(marks: np.ndarray) -> np.ndarray:
    return marks["low"].astype(np.uint64) | marks["high"].astype(np.uint64) << _U(32)


def _slices(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value for each range [at[i], at[i + 1]) of records."""
    data = np.ascontiguousarray(data)
    wide = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * wide).astype(np.int64)), pa.py_buffer(data.view(np.uint8))]).cast(pa.binary())


def _sent(unit: int, part, a: pa.Array, b: pa.Array | None = None) -> pa.RecordBatch:
    n = len(a)
    part = pa.array(np.broadcast_to(np.asarray(part, np.int32), n))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, unit)), part, a, b if b is not None else pa.nulls(n, pa.binary())], ["unit", "part", "a", "b"])


def _whole(unit: int, part: int, data: np.ndarray) -> pa.RecordBatch:
    return _sent(unit, part, pa.array([data.tobytes()], pa.binary()))


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + size[i] of all i, joined."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Units:
    """Numbers units: equal however often a task runs."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 32

    def number(self) -> int:
        self.next += 1
        return self.next


def _triggers(parts: int, unit_bytes: int):
    def flush(unit, hashes, rows, members):
        ids = np.array(members, _ROW)
        h, r = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((ids["doc"][r], h))
        h, r = h[order], r[order]
        lo, hi = _split(h)
        docs = ids["doc"][r]
        many = docs[lo] != docs[hi - 1]
        told = np.repeat(many, hi - lo)
        yield _whole(unit, ROWS, ids)
        if told.any():
            yield _whole(unit, TOLD, _marks(r[told], h[told] & _REST))
        h, r = h[lo], r[lo]
        part = _part_of(h, parts)
        order = np.lexsort((r, part))
        part = part[order]
        data = _marks(r[order], (h[order] & _REST) | many[order].astype(np.uint64))
        lo, hi = _split(part)
        yield _sent(unit, part[lo], _slices(data, np.r_[lo, len(part)]))

    def run(batches):
        units, hashes, rows, members, size = _Units(), [], [], [], 0
        for batch in batches:
            ids, keys = (batch.column(i).to_pylist() for i in (0, 1))
            for row, raw, offsets in blocks(batch.column(2)):
                text, _, _, h = phrases(raw, offsets, prefix_sums(raw))
                hashes.append(h)
                rows.append(text + len(members))
                n = len(offsets) - 1
                members += zip(ids[row : row + n], keys[row : row + n])
                size += len(raw)
                if size >= unit_bytes:
                    yield from flush(units.number(), hashes, rows, members)
                    hashes, rows, members, size = [], [], [], 0
        if size:
            yield from flush(units.number(), hashes, rows, members)

    return run


def _answers(units: list[int], owner: np.ndarray, data: np.ndarray) -> pa.Table:
    """One row for each unit that has records; owner: the place of a record's unit in the list."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    lo, hi = _split(owner)
    return pa.table({"unit": pa.array([units[i] for i in owner[lo].tolist()], pa.int64()), "places": _slices(data[order], np.r_[lo, len(owner)])})


def _shared(table: pa.Table) -> pa.Table:
    """Triggers of one part that several documents hold: told to the units that don't know yet.

    Two units may hold rows of one document only; such a trigger is told too, and decided later.
    """
    units, data = table.column("unit").to_pylist(), [np.frombuffer(a, _MARK) for a in table.column("a").to_pylist()]
    owner, data = np.repeat(np.arange(len(data)), [len(x) for x in data]), np.concatenate(data)
    rest = _rest(data)
    order = np.argsort(rest & _REST, kind="stable")
    data, owner, rest = data[order], owner[order], rest[order]
    many, rest = (rest & _U(1)).astype(bool), rest & _REST
    lo, hi = _split(rest)
    hit = np.repeat((hi - lo > 1) | np.logical_or.reduceat(many, lo), hi - lo) & ~many
    return _answers(units, owner[hit], _marks(data["row"][hit], rest[hit]))


def _same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes from a[i] and from b[i] are equal."""
    if not len(size):
        return np.zeros(0, bool)
    equal = text[_ragged(a, size)] == text[_ragged(b, size)]
    return np.logical_and.reduceat(equal, np.cumsum(size) - size)


def _dictionary(parts: int, unit_bytes: int):
    def flush(unit, members, found):
        h, r, at, n, mark = (np.concatenate(x) for x in list(zip(*found))[:5])
        text, ids = np.concatenate([u[5] for u in found]), np.array(members, _ROW)
        d, size = ids["doc"][r], n + LENGTH - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((d, n, mark))
        lo, hi = _split(mark[order])
        lead = np.empty(len(d), np.int64)
        lead[order] = np.repeat(order[lo], hi - lo)
        later = np.flatnonzero((d > d[lead]) & (size == size[lead]))
        later = later[_same_bytes(text, begin[later], begin[lead[later]], size[later])]
        yield _whole(unit, ROWS, ids)
        if len(later):
            cut = np.empty(len(later), _CUT)
            cut["row"], cut["at"], cut["mask"] = r[later], at[later], (1 << n[later]) - 1
            yield _whole(unit, TOLD, cut)
        keep = np.ones(len(d), bool)
        keep[later] = False
        keep = np.flatnonzero(keep)
        part = _part_of(h[keep], parts)
        order = np.lexsort((h[keep], part))
        keep, part = keep[order], part[order]
        entry = np.empty(len(keep), _ENTRY)
        entry["doc"], entry["row"], entry["at"], entry["size"] = d[keep], r[keep], at[keep], size[keep]
        lo, hi = _split(part)
        ends = np.r_[0, np.cumsum(size[keep])]
        cut = np.r_[lo, len(keep)]
        yield _sent(unit, part[lo], _slices(text[_ragged(begin[keep], size[keep])], ends[cut]), _slices(entry, cut))

    def run(batches):
        units, found, members, size = _Units(), [], [], 0
        for batch in batches:
            ids, keys = (batch.column(i).to_pylist() for i in (0, 1))
            told = [np.unique(_rest(np.frombuffer(m, _MARK))) for m in batch.column(3).to_pylist()]
            for row, raw, offsets in blocks(batch.column(2)):
                sums = prefix_sums(raw)
                text, first, last, h = phrases(raw, offsets, sums)
                count = len(offsets) - 1
                wanted = [m | (_U(i) << _U(44)) for i, m in enumerate(told[row : row + count])]
                keep = np.isin((h & _REST) | (text.astype(np.uint64) << _U(44)), np.concatenate(wanted))
                text, first, last, h = text[keep], first[keep], last[keep], h[keep]
                if len(text):
                    lens = last - first + LENGTH
                    found.append((h, text + len(members), first - offsets[text], last - first + 1, range_hashes(sums, first, last + LENGTH), raw[_ragged(first, lens)]))
                    members += zip(ids[row : row + count], keys[row : row + count])
                    size += int(lens.sum())
                if size >= unit_bytes:
                    yield from flush(units.number(), members, found)
                    found, members, size = [], [], 0
        if found:
            yield from flush(units.number(), members, found)

    return run


def _words(text: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from every place on as a number; ``count`` more words may be read behind the end."""
    padded = np.r_[text, np.zeros(8 * count, np.uint8)]
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)


def suffix_order(text: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): starts sorted by their ``length`` bytes, then by document; where other bytes begin."""
    words = -(-length // 8)
    eight = _words(text, words)
    keys = [eight[start + 8 * i] for i in range(words)]
    keys[-1] &= ~_U((1 << 8 * (8 * words - length)) - 1)
    del eight
    order = np.lexsort((doc, *reversed(keys)))
    new = np.zeros(len(start), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def phrase_order(text: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): phrases in lexicographic order, equal ones by document; where another phrase begins."""
    words = -(-int(size.max(initial=1)) // 8)
    eight, keys = _words(text, words), []
    for i in range(words):
        spare = np.clip(8 * (i + 1) - size, 0, 8)  # bytes of this word behind the phrase
        low = (_U(8) * spare.astype(np.uint64)) & _U(63)
        keys.append(np.where(spare == 8, _U(0), eight[np.minimum(begin + 8 * i, len(eight) - 1)] >> low << low))
    keys.append(size.astype(np.uint64))
    order = np.lexsort((doc, *reversed(keys)))
    new = np.zeros(len(size), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def _repeated(table: pa.Table) -> pa.Table:
    """Repeated strings of one part, by its dictionary's and its parse's suffix arrays."""
    units, entry = table.column("unit").to_pylist(), [np.frombuffer(b, _ENTRY) for b in table.column("b").to_pylist()]
    text = np.frombuffer(b"".join(table.column("a").to_pylist()), np.uint8)
    owner, entry = np.repeat(np.arange(len(entry)), [len(x) for x in entry]), np.concatenate(entry)
    size, doc = entry["size"].astype(np.int64), entry["doc"].astype(np.int64)
    begin = np.cumsum(size) - size
    # the dictionary, and the parse's order: places by phrase rank, then document
    order, new = phrase_order(text, begin, size, doc)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    head = order[new]
    least, n = doc[head], size[head] - LENGTH + 1
    # the dictionary's suffix array, equal suffixes by their phrases' first document
    phrase = np.repeat(np.arange(len(head)), n)
    shift = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    suffix, other = suffix_order(text, begin[head][phrase] + shift, least[phrase])
    holder = least[phrase][suffix][np.flatnonzero(other)][np.cumsum(other) - 1]
    lost = suffix[least[phrase][suffix] > holder]
    own = np.zeros(len(head), np.int64)
    np.bitwise_or.at(own, phrase[lost], 1 << shift[lost])
    # corpus order: what a smaller document holds, by the phrase itself or by another phrase's suffix
    mask = np.where(doc > least[rank], (1 << n[rank]) - 1, own[rank])
    hit = mask > 0
    cut = np.empty(int(hit.sum()), _CUT)
    cut["row"], cut["at"], cut["mask"] = entry["row"][hit], entry["at"][hit], mask[hit]
    return _answers(units, owner[hit], cut)


def _dealt(kind: np.dtype):
    """A unit's places to its rows."""

    def run(batches):
        for batch in batches:
            for ids, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, places = np.frombuffer(ids, _ROW), np.frombuffer(b"".join(places), kind)
                places = places[np.argsort(places["row"], kind="stable")]
                lo, hi = _split(places["row"])
                own = ids[places["row"][lo]]
                if len(own):
                    cols = [pa.array(own["doc"].copy()), pa.array(own["key"].copy()), _slices(places, np.r_[lo, len(places)])]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "places"])

    return run


def spans_of(places: bytes, length: int = LENGTH) -> np.ndarray:
    """Maximal removed runs [start, end) from places with masks."""
    pairs = np.frombuffer(places, _CUT)
    bit = (pairs["mask"][:, None] >> np.arange(LENGTH - TRIGGER + 1, dtype=np.uint32)) & 1
    row, col = np.nonzero(bit)
    start = np.unique(pairs["at"][row].astype(np.int64) + col)
    cut = np.flatnonzero(np.r_[True, np.diff(start) > length]) if len(start) else np.zeros(0, np.int64)
    return np.stack([start[cut], start[np.r_[cut[1:], len(start)] - 1] + length], axis=1) if len(start) else np.zeros((0, 2), np.int64)


def whole_characters(piece: bytes) -> bytes:
    """A piece of UTF-8 without the parts of characters at its ends."""
    start = 0
    while start < min(3, len(piece)) and 0x80 <= piece[start] < 0xC0:
        start += 1
    end = len(piece)
    for back in range(1, min(3, end - start) + 1):
        lead = piece[end - back]
        if lead >= 0xC0:
            end -= back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
            break
        if lead < 0x80:
            break
    return piece[start:end]


def _remove(characters: bool):
    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for text, copy, places in zip(*(batch.column(i) for i in (1, 2, 3))):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if copy.as_py() and len(data) >= LENGTH:
                    cut = np.array([[0, len(data)]])
                else:
                    cut = spans_of(places.as_py()) if places.is_valid else np.zeros((0, 2), np.int64)
                at, rest = 0, []
                for x, y in cut.tolist():
                    rest.append(data[at:x])
                    at = y
                rest.append(data[at:])
                spans.append([{"start": x, "end": y} for x, y in cut.tolist()])
                kept.append(b"".join(map(whole_characters, rest) if characters else rest) if len(cut) else data)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], ["_row", "spans", "kept"])

    return run


def _down(up: DataFrame, reduce, kind: np.dtype, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, key, places) for rows that have any: a unit's own places and the answers of the parts."""
    told = up.where(F.col("part") == TOLD).select("unit", F.col("a").alias("places"))
    answers = up.where("part >= 0").select("unit", "part", "a", "b").groupBy("part").applyInArrow(reduce, _DOWN)
    members = up.where(F.col("part") == ROWS).select("unit", F.col("a").alias("ids"))
    both = told.union(answers).groupBy("unit").agg(F.collect_list("places").alias("places")).join(members, "unit")
    dealt = both.select("ids", "places").mapInArrow(_dealt(kind), "doc_id long, key long, places binary")
    return scratch.keep(dealt.dropDuplicates(["doc_id", "key"]), name)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", characters: bool = False, unit_bytes: int = UNIT_BYTES, part_bytes: int = PART_BYTES, suffix_bytes: int = SUFFIX_BYTES) -> DataFrame:
    """One row per input row: _row (all its columns), spans (start, end in bytes) and kept (bytes; ``characters``: without parts of characters that a cut has split)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    # a row is its id and its text: rows that repeat an id with other texts stay apart
    total_sum = F.sha2(F.col(text_col), 256)
    own = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(total_sum).alias("key")]
    plain = docs.select(*own, F.col(text_col).alias("text"))
    long = plain.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull())
    sums = long.select("doc_id", "key", F.sha2("text", 256).alias("sum"), F.octet_length("text").alias("n"))
    sums = scratch.keep(sums, "sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    parts, finer = (max(8, total // x) for x in (part_bytes, suffix_bytes))
    same = sums.groupBy("sum").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = sums.join(same, "sum").where("doc_id > least").select("doc_id", "key").distinct()
    copies = scratch.keep(copies, "copies")
    small = small_enough(copies, BROADCAST_IDS)
    once = long.join(F.broadcast(copies) if small else copies, ["doc_id", "key"], "left_anti")

    up = scratch.keep(once.mapInArrow(sliced(_triggers(parts, unit_bytes)), _UP), "triggers")
    marks = _down(up, _shared, _MARK, scratch, "marks")
    scratch.drop("triggers", "sums")
    marked = once.join(marks, ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    up = scratch.keep(marked.mapInArrow(sliced(_dictionary(finer, unit_bytes)), _UP), "dictionary")
    cuts = _down(up, _repeated, _CUT, scratch, "cuts")
    scratch.drop("dictionary", "marks")

    whole = docs.select(F.struct("*").alias("_row"), *own, F.col(text_col).alias("text"))
    flag = copies.withColumn("copy", F.lit(True))
    whole = whole.join(F.broadcast(flag) if small else flag, ["doc_id", "key"], "left").join(cuts, ["doc_id", "key"], "left")
    row = whole.schema["_row"].dataType.simpleString()
    out = whole.select("_row", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "places")
    return out.mapInArrow(sliced(_remove(characters)), f"_row {row}, spans array<struct<start: bigint, end: bigint>>, kept binary")
