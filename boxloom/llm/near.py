"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds the hashes of its distinct word shingles. One hash of each shingle
picks one of 256 buckets by its top bits; a bucket keeps its smallest rest, stored as the
count of leading zeros and ten bits of mantissa, two bytes in all. Empty buckets borrow
from a full one in a fixed random order, so small sets have 256 comparable registers too.

Bands of 6 registers bring documents together: two sets at similarity 0.85 miss all 42
bands with a chance of about 2e-9. Inside a band:

1. Documents with equal sets are one class.
2. In each of a few rounds a band names one of its classes, by a hash, as its centre. Every
   class meets the centre it shares most bands with, later a few centres of different bands;
   the verified links are contracted to components, and bands that lie in one component are
   done with.
3. Bands that still hold several components compare their members across components in
   blocks, on finer registers without borrowing. A block passes on only a forest: the pairs of
   highest estimate that join its components. Links that hold contract the components, pairs
   that fail are remembered; a second round passes on a few more pairs for each two
   components, the last one all that are left. So a dense group of copies costs a pair a
   member, and no pair inside a component is ever formed.

Before any pair is verified, its similarity is estimated from the share of equal registers,
corrected for the chance that registers of different shingles agree, which follows from the
two sets' sizes. Pairs that pass are confirmed on the full sets by integer arithmetic;
components follow from them.

Null or empty texts have no shingles, are linked with nothing and kept. A text of fewer
words than a shingle is one shingle. Very long texts are hashed in blocks of their own. Rows
with a null id are never linked (component_id null, kept true). Rows that repeat an id are
told apart by their sets: each has its own class, and its component's smallest id. Equal
estimates are ordered by class. Empty tables give no rows. Other columns of the input aren't
read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import BLANK_WORD, Scratch, blocks, mix, shingles, sliced, small_enough, words_of
from boxloom.llm.components import components

REGISTERS, MANTISSA, ROWS = 256, 10, 6
BANDS = REGISTERS // ROWS
#: Registers of the last comparison, and how many standard errors (and how much besides) an estimate may lie below the threshold.
FINE, ERRORS, SLACK = 1024, 5.5, 0.01
#: Rounds of checks against centres, and centres that a class meets in each after the first; what they leave is compared in full.
ROUNDS, TESTS = 2, 4
#: Pairs that a block passes on for each two components, round by round: a forest, a few, all.
BUDGETS = (0, 4, None)
#: Borrowed registers repeat others, so their estimates vary more than their number tells.
BORROWED = 1.2
#: Members of a band that meet in one block.
BLOCK = 1500
#: Rows up to this number are broadcast (24 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
_U = np.uint64
_rank: list[np.ndarray] = []


def borrow_order() -> np.ndarray:
    """rank[i, j]: how soon empty bucket i asks bucket j."""
    if not _rank:
        i, j = np.meshgrid(np.arange(REGISTERS, dtype=np.uint64), np.arange(REGISTERS, dtype=np.uint64), indexing="ij")
        _rank.append(mix(mix(i + _U(1)) ^ (j * _U(0xD6E8FEB86659FD93))).argsort(axis=1).argsort(axis=1).astype(np.uint16))
    return _rank[0]


def _filled(hashes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (by the top bits) that sorted hashes fill, and their registers."""
    bucket = (hashes >> _U(64 - top)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (hashes[first] << _U(top) >> _U(16)).astype(np.int64)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    zeros = 48 - bits
    mantissa = np.where(bits > MANTISSA, rest >> np.maximum(bits - 1 - MANTISSA, 0), rest << np.maximum(MANTISSA + 1 - bits, 0))
    return bucket[first], (zeros << MANTISSA | mantissa & ((1 << MANTISSA) - 1)).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """256 two-byte registers of a sorted, non-empty set of 64-bit hashes."""
    have, full = _filled(hashes, REGISTERS.bit_length() - 1)
    out = np.empty(REGISTERS, np.uint16)
    out[have] = full
    if len(have) < REGISTERS:
        gaps = np.ones(REGISTERS, bool)
        gaps[have] = False
        gaps = np.flatnonzero(gaps)
        out[gaps] = full[borrow_order()[np.ix_(gaps, have)].argmin(axis=1)]
    return out


def fine_registers(hashes: np.ndarray) -> np.ndarray:
    """More registers of such a set; EMPTY where no hash falls."""
    have, full = _filled(hashes, FINE.bit_length() - 1)
    out = np.full(FINE, EMPTY, np.uint16)
    out[have] = full
    return out


#: No register has this value, as there are at most 48 leading zeros.
EMPTY = np.uint16(0xFFFF)


def collision(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that registers of different shingles agree, from the expected number of shingles a bucket gets.

    The smallest of a hashes has density a * exp(-a * x); a cell of the octave below 2 ** -z is
    2 ** -(z + 1 + MANTISSA) wide. Summed over octaves of both densities' product.
    """
    a, b = np.maximum(a, 1.0)[..., None], np.maximum(b, 1.0)[..., None]
    edge = 0.5 ** np.arange(48)
    both = a * b / (a + b) * (np.exp(-(a + b) * edge / 2) - np.exp(-(a + b) * edge))
    return (both * edge / 2 ** (MANTISSA + 1)).sum(axis=-1)


def estimate(agree: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    """Jaccard similarity of sets of a and b shingles from the share of equal registers, corrected for collisions."""
    chance = collision(a / buckets, b / buckets)
    return (agree - chance) / (1 - chance)


def may_link(found: np.ndarray, filled: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of a and b shingles with this estimate from so many registers may reach the threshold."""
    least = percent / 100
    union = (a + b) / (1 + least)
    error = np.sqrt(least * (1 - least) / np.maximum(filled, 1) * np.maximum(0, 1 - filled / union))
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (found >= least - ERRORS * error - SLACK)


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for _, raw, offsets in blocks(texts):
        words, first = words_of(raw, offsets, BLANK_WORD)
        runs = shingles(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                yield mix(shingles(words[a:b], b - a) ^ _U(b - a))
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> int:
    """The first half of a set's identity."""
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64).astype(np.int64))


def _signatures(n: int):
    def run(batches):
        for batch in batches:
            size, one, two, regs = [], [], [], []
            for s in sets_of(batch.column(1), n):
                size.append(len(s))
                one.append(digest(s))
                with np.errstate(over="ignore"):
                    two.append(int(mix(s ^ _U(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)))
                regs.append(registers(s).tobytes() if len(s) else None)
            cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_shingles", "h1", "h2", "regs"])

    return run


def _bands(batches):
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        regs = regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(salt, regs.shape[:2])
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                key = mix(key * _U(31) + regs[:, :, r])
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        band = np.tile(np.arange(BANDS, dtype=np.int32), len(regs))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(ids)], ["key", "band", "node"])


def _sets(n: int, kind):
    """kind of the set of each wanted text (text, node, h1); rows that share the id but not the set go."""

    def run(batches):
        for batch in batches:
            found = [kind(s).tobytes() if digest(s) == h else None for s, h in zip(sets_of(batch.column(0), n), batch.column(2).to_pylist())]
            found = pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), found], ["node", "set"]).filter(found.is_valid())

    return run


def _estimated(percent: int):
    """The pairs (a, b) whose registers (n, m and x, y) let them reach the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            found = estimate((x == y).mean(axis=1), n, m, REGISTERS)
            filled = REGISTERS * (1 - np.exp(-(n + m) / (1 + percent / 100) / REGISTERS)) / BORROWED
            yield batch.select([0, 1]).filter(pa.array(may_link(found, filled, n, m, percent)))

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def passed_on(a: np.ndarray, b: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray, score: np.ndarray, budget: int | None) -> list[int]:
    """Places of the pairs to verify, best first: all, so many for each two components, or (0) a forest over them."""
    if budget is None:
        return list(range(len(a)))
    order = np.lexsort((b, a, -score)).tolist()
    out, above, used = [], {}, {}

    def root(c):
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    for i in order:
        x, y = int(comp_a[i]), int(comp_b[i])
        if budget:
            two = (min(x, y), max(x, y))
            used[two] = used.get(two, 0) + 1
            if used[two] > budget:
                continue
        else:
            x, y = root(x), root(y)
            if x == y:
                continue
            above[x] = y
        out.append(i)
    return out


def _compare(percent: int, budget: int | None):
    def run(table: pa.Table, failed: pa.Table) -> pa.Table:
        empty = pa.schema([("key", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]).empty_table()
        if not table.num_rows:
            return empty
        nodes, comp, block, size = (table.column(c).to_numpy() for c in ("node", "comp", "block", "n_shingles"))
        key, left, right, band = (table.column(c)[0].as_py() for c in ("key", "left", "right", "band"))
        regs, fine = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint16).reshape(-1, n) for c, n in (("regs", REGISTERS), ("fine", FINE)))
        regs, full, size = regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS), fine != EMPTY, size.astype(float)
        rows, cols = np.flatnonzero(block == left), np.flatnonzero(block == right)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in rows:
            js = cols[(comp[cols] != comp[i]) & (nodes[cols] > nodes[i])] if left == right else cols[comp[cols] != comp[i]]
            js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
            if len(js):
                filled = (full[js] | full[i]).sum(axis=1)
                score = estimate(((fine[js] == fine[i]) & full[i]).sum(axis=1) / filled, size[js], size[i], FINE)
                good = may_link(score, filled, size[js], size[i], percent)
                good &= (regs[js] == regs[i]).all(axis=2).argmax(axis=1) == band
                found.append((np.full(int(good.sum()), i), js[good], score[good]))
        i, j, score = (np.concatenate(c) for c in zip(*found))
        a, b = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
        gone = set(zip(failed.column("a").to_pylist(), failed.column("b").to_pylist()))
        if gone:
            new = np.array([p not in gone for p in zip(a.tolist(), b.tolist())], bool)
            i, j, score, a, b = i[new], j[new], score[new], a[new], b[new]
        kept = passed_on(a, b, comp[i], comp[j], score, budget)
        if not kept:
            return empty
        same = [pa.array(np.full(len(kept), v), k) for v, k in ((key, pa.int64()), (left, pa.int32()), (right, pa.int32()))]
        return pa.Table.from_arrays([*same, pa.array(a[kept]), pa.array(b[kept])], schema=empty.schema)

    return run


class _Group:
    """One run's tables: classes (node, id, h1, h2, n_shingles, regs) and the links found so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, percent: int, scratch: Scratch):
        self.docs, self.classes, self.n, self.percent, self.scratch = docs, classes, n, percent, scratch
        self.names: list[str] = []

    def texts(self, nodes: DataFrame, kind) -> DataFrame:
        """(node, set) for the nodes' representative texts."""
        wanted = self.classes.join(F.broadcast(nodes) if small_enough(nodes, BROADCAST_IDS) else nodes, "node", "left_semi").select("id", "node", "h1")
        wanted = F.broadcast(wanted) if small_enough(wanted, BROADCAST_IDS) else wanted
        texts = self.docs.join(wanted, "id").select("text", "node", "h1")
        return texts.mapInArrow(sliced(_sets(self.n, kind)), "node long, set binary").dropDuplicates(["node"])

    def verified(self, pairs: DataFrame, name: str, estimated: bool) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold; those whose registers forbid it aren't compared."""
        keep = self.scratch.keep
        if not estimated:
            known = self.classes.select("node", "n_shingles", "regs")
            both = pairs.join(known.toDF("a", "n", "x"), "a").join(known.toDF("b", "m", "y"), "b")
            pairs = keep(both.select("a", "b", "n", "m", "x", "y").mapInArrow(sliced(_estimated(self.percent)), "a long, b long"), f"{name}-near")
        nodes = keep(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), f"{name}-nodes")
        sets = keep(self.texts(nodes, lambda s: s), f"{name}-sets")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        links = keep(both.mapInArrow(sliced(_confirm(self.percent), 200), "a long, b long"), f"{name}-links")
        self.scratch.drop(f"{name}-nodes", f"{name}-sets", f"{name}-near")
        self.names.append(f"{name}-links")
        return links


def _mixed(where: DataFrame, comp: DataFrame | None, drawn) -> DataFrame:
    """Members (key, band, node, comp, n, centre) of the bands that hold several components."""
    where = where.select("key", "band", "node")
    where = where.join(comp.toDF("node", "comp"), "node", "left") if comp is not None else where.withColumn("comp", F.lit(None).cast("long"))
    where = where.select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = where.groupBy("key").agg(
        F.min("comp").alias("c"), F.max("comp").alias("d"), F.count(F.lit(1)).alias("n"), F.min(F.struct(drawn, "node", "comp")).alias("centre")
    )
    return where.join(mixed.where("c < d").select("key", "n", "centre"), "key")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    percent: int = 85,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, class_id (the smallest id of equal sets)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_shingles long, h1 long, h2 long, regs binary"
    signed = scratch.keep(docs.mapInArrow(sliced(_signatures(shingle)), schema), "signed")
    full = signed.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("id"), F.min_by("regs", "id").alias("regs"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    group = _Group(docs, classes, shingle, percent, scratch)
    live = scratch.keep(classes.select("node", "regs").mapInArrow(_bands, "key long, band int, node long"), "live")

    comp, links, at = None, None, "live"
    for turn in range(ROUNDS + len(BUDGETS)):
        tests = TESTS if turn else 1
        drawn = F.xxhash64("node", F.lit(turn)) if tests == 1 else F.xxhash64("node", "key", F.lit(turn))
        live = scratch.keep(_mixed(live, comp, drawn), f"live-{turn}")
        scratch.drop(at)
        at = f"live-{turn}"
        if not live.limit(1).count():
            break
        if turn < ROUNDS:
            met = live.where(F.col("comp") != F.col("centre.comp")).groupBy("node", F.col("centre.node").alias("to"))
            met = met.agg(F.count(F.lit(1)).alias("n")).groupBy("node")
            best = met.agg(F.slice(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("to"), "to")), asc=False), 1, tests).alias("best"))
            pairs = best.select("node", F.explode("best.to").alias("to"))
            pairs = scratch.keep(pairs.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct(), f"pairs-{turn}")
        else:
            budget = BUDGETS[turn - ROUNDS]
            if turn == ROUNDS:
                nodes = scratch.keep(live.select("node").distinct(), "nodes")
                last = classes.join(F.broadcast(nodes) if small_enough(nodes, BROADCAST_IDS) else nodes, "node", "left_semi").select("node", "n_shingles", "regs")
                last = scratch.keep(last.join(group.texts(nodes, fine_registers).withColumnRenamed("set", "fine"), "node"), "last")
                failed = spark.createDataFrame([], "key long, left int, right int, a long, b long")
            where = live.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
            part = where.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            part = part.withColumn("other", other).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
            own = ["key", "left", "right"]
            if turn > ROUNDS:  # components only grow, so blocks without a pair stay without one
                busy = placed.select(*own).distinct()
                part = part.join(F.broadcast(busy) if small_enough(busy, BROADCAST_IDS) else busy, own, "left_semi")
            part = part.select("key", "band", "left", "right", "block", "node", "comp").join(last, "node")
            placed = part.groupBy(*own).cogroup(failed.groupBy(*own)).applyInArrow(_compare(percent, budget), failed.schema)
            placed = scratch.keep(placed, f"placed-{turn}")
            pairs = placed.select("a", "b")
        found = group.verified(pairs, f"round-{turn}", turn >= ROUNDS)
        if turn >= ROUNDS:
            failed = failed.union(placed.join(found, ["a", "b"], "left_anti").select(*failed.columns))
        links = found if links is None else links.union(found)
        comp = components(links, scratch, f"comp-{turn}")
        scratch.drop(*([f"comp-{turn - 1}"] if turn else []))

    classes = classes.select("h1", "h2", "n_shingles", F.col("id").alias("class_id"), "node")
    if comp is None:
        named = classes.select("h1", "h2", "n_shingles", "class_id", F.col("class_id").alias("least"))
    else:
        named = classes.join(comp.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("class_id").alias("least"))
        named = named.join(least, "comp").select("h1", "h2", "n_shingles", "class_id", "least")
    named = scratch.keep(named, "named")
    scratch.drop("classes", at, "nodes", "last", *group.names, *[f"{x}-{t}" for x in ("pairs", "placed", "comp") for t in range(ROUNDS + len(BUDGETS))])
    out = signed.drop("regs").join(named, ["h1", "h2", "n_shingles"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    own = F.when(linked, F.col("least")).otherwise(F.col("id"))
    return out.select(
        "id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"),
        F.when(linked, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
    )
