"""Plumbing shared by the corpus operators: scratch tables and byte-level word kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel works on at a time; one longer text makes one longer block.
BLOCK_BYTES = 1 << 20
_U = np.uint64


# ---------------------------------------------------------------- scratch tables


_local: dict[str, str] = {}
#: Spark's setting for deleting shuffle files when their query has ended; on only while a scratch table is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a single-machine session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="boxloom-"))


class Scratch:
    """Tables written to the shared folder, to cut lineage; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/boxloom-{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, schema, conf = f"{self.base}/{name}", df.schema, self.spark.conf
        before = conf.get(CLEAN, "false")
        conf.set(CLEAN, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEAN, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its tasks and would hold their peak beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(run, rows: int = 1000):
    """The same function of Arrow batches, fed slices of a few rows: whole texts are large.

    No session setting is touched; Spark bounds a batch in bytes itself.
    """

    def small(batches):
        try:
            yield from run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        finally:
            give_back()

    return small


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``size`` bytes; a null text is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, len(texts))
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


# ---------------------------------------------------------------- kernels

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_space = [0x20, *range(0x09, 0x0E)]
#: Bytes of words that end at ASCII white space.
BLANK_WORD = np.ones(256, bool)
BLANK_WORD[_space] = False
#: Bytes of words of digits, lower-case letters and all that isn't ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(30))
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(27)
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(31)
    return h


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n, kept between calls."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        size = max(n, BLOCK_BYTES + 4096)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            p = np.multiply.accumulate(p)
        if size > 8 * BLOCK_BYTES:  # one huge text: not worth keeping
            return p[:n]
        _powers[base] = kept = p
    return kept[:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of the bytes' values times powers, so that any range's hash is a difference."""
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[raw] * powers(_BASE, len(raw)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, the same wherever a range stands."""
    inv = powers(_INVERSE, len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * inv[start])


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in joined texts, and for each text the number of words before it."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = table[raw]
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))])
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word runs over the end of a text
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


def words_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of joined texts in lower case, and the number of words before each text."""
    raw = LOWER[raw]
    start, end, first = word_spans(raw, offsets, table)
    return range_hashes(prefix_sums(raw), start, end), first


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; those that cross texts are the caller's to skip."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1].copy()
        for i in range(1, n):
            h = mix(h * _U(3) + words[i : len(words) - n + 1 + i])
    return h


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table may be broadcast: counted, never guessed."""
    return df.limit(rows + 1).count() <= rows
