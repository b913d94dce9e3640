"""Mixing sources to target weights by fitting word budgets as subset sums.

Sizes are word counts. Every source gets a share of the mix by weight, at most twice its
own size; whole passes over the source come first, and the rest of its budget is a subset
of its documents whose sizes add up to it. Documents are counted by exact size; each size
class gives its proportional share, and what that leaves is fitted by a bounded-knapsack
dynamic program over sizes. In a class, documents are chosen in the order of a seeded hash
of their id: the plan holds the last chosen hash and id, so every document is decided by
its own row.

Sources stay a table, however many there are: one sum over it for each time that shares are
dealt anew is all the driver sees. A source's class counts meet in one task, their number
bounded by its distinct sizes, not its documents. Ranking inside a class happens only in one
of 2 ** SLICE_BITS hash slices, so a class that holds a third of all rows is still spread out.

Null and empty texts have size 0 and are never taken. A null source is a source of its own,
the last. Very long texts are sizes like any other. Repeated rows (same id, source and size)
are decided alike; ties of the hash go to the smaller id, a null id first. Empty tables give
no rows. Other columns travel in a struct and can't clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import Scratch, small_enough

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLICE_BITS = 9
#: Largest budget the dynamic program fits; larger ones are brought below it first.
FIT = 1 << 17
#: Plan rows up to this number are broadcast (about 40 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds sid, source_size and target to sources (_src, s): what one may not take is shared again by weight.

    Only one row per source is numbered in a window; a null source comes last.
    """
    order = Window.orderBy(F.col("_src").isNull(), "_src")
    rows = sources.withColumn("sid", (F.row_number().over(order) - 1).cast("long")).withColumn("source_size", F.coalesce("s", F.lit(0)).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    return rows.withColumns({"weight": weight, "limit": most * F.col("source_size")}).drop("s")


def unit_of(rows: DataFrame, share: float = SHARE) -> float:
    """What a weight of 1 gets once no source is above its limit: it only rises, so sources that reach theirs stay out."""
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    unit, capped = 0.0, -1
    while True:
        out = F.col("weight") * F.lit(unit) > F.col("limit")
        r = rows.agg(F.count_if(out), F.sum(F.when(out, F.col("limit"))), F.sum(F.when(~out, F.col("weight")))).first()
        if r[0] == capped or not r[2]:
            return unit if r[2] else float("inf")
        unit, capped = (total - float(r[1] or 0)) / r[2], r[0]


def fit(counts: dict[int, int], budget: int, limit: int = FIT) -> dict[int, int]:
    """How many documents of each size to take so that sizes add up to the budget, or just below it."""
    total = sum(s * n for s, n in counts.items())
    if budget >= total:
        return dict(counts)
    take = {s: n * budget // total for s, n in counts.items()}
    left = budget - sum(s * n for s, n in take.items())
    for s in sorted(counts, reverse=True):
        if left <= limit:
            break
        n = min(counts[s] - take[s], -(-(left - limit) // s), left // s)
        take[s] += n
        left -= n * s
    items = []
    for s in sorted(counts):
        room, k = min(counts[s] - take[s], left // s), 1
        while room > 0 and s * k <= left:
            k = min(k, room)
            items.append((s, k))
            room -= k
            k *= 2
    reach, mask, before, used = 1, (1 << (left + 1)) - 1, [], []
    for s, k in items:
        if reach >> left & 1:
            break
        before.append(reach)
        used.append((s, k))
        reach |= (reach << (s * k)) & mask
    at = reach.bit_length() - 1
    for (s, k), old in zip(reversed(used), reversed(before)):
        if not old >> at & 1:
            take[s] += k
            at -= s * k
    return take


def _classes(limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = fit(dict(zip(rows["size"].tolist(), rows["n"].tolist())), int(rows["budget"].iloc[0]), limit)
        return pd.DataFrame({"sid": rows["sid"].iloc[0], "size": list(got), "n": list(got.values())})

    return run


def plan(docs: DataFrame, scratch: Scratch, *, seed: int = SEED, limit: int = FIT) -> tuple[DataFrame, DataFrame]:
    """(sources, classes) for docs with _id, _source and _size.

    sources: _src, sid, source_size, target, passes. classes: sid, _size and the last hash
    and id that are taken once more.
    """
    totals = docs.groupBy(F.col("_source").alias("_src")).agg(F.sum("_size").alias("s"))
    rows = scratch.keep(targets(totals), "sources")
    target = F.least(F.col("weight") * F.lit(unit_of(rows)), F.col("limit").cast("double"))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size"))).cast("int")).otherwise(0)
    rest = F.when(F.col("passes") < MOST, F.bround("target").cast("long") - F.col("passes") * F.col("source_size")).otherwise(0)
    sources = rows.withColumn("target", target).withColumn("passes", passes).withColumn("budget", rest.cast("long"))
    sources = sources.select("_src", "sid", "source_size", "target", "passes", "budget")
    sources = F.broadcast(sources) if small_enough(sources, BROADCAST_ROWS) else sources
    known = docs.join(sources, F.col("_source").eqNullSafe(F.col("_src"))).drop("_source", "_src")
    known = known.where((F.col("_size") > 0) & (F.col("budget") > 0)).withColumn("hash", F.xxhash64("_id", F.lit(seed)))
    known = known.withColumn("slice", F.shiftrightunsigned("hash", 64 - SLICE_BITS).cast("int"))
    slices = known.groupBy("sid", F.col("_size").alias("size"), "budget", "slice").agg(F.count(F.lit(1)).alias("n"))
    whole = slices.groupBy("sid", "size", "budget").agg(F.sum("n").alias("n"))
    taken = whole.groupBy("sid").applyInPandas(_classes(limit), "sid long, size long, n long").where("n > 0")
    run = Window.partitionBy("sid", "size").orderBy("slice")
    cut = slices.join(taken.withColumnRenamed("n", "need"), ["sid", "size"])
    cut = cut.withColumn("upto", F.sum("n").over(run))
    cut = cut.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    cut = cut.select("sid", F.col("size").alias("_size"), "slice", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
    inside = known.select("sid", "_size", "slice", "hash", "_id").join(cut, ["sid", "_size", "slice"])
    order = Window.partitionBy("sid", "_size", "slice").orderBy("hash", "_id")
    ranked = inside.withColumn("rank", F.row_number().over(order))
    classes = ranked.where("rank = need").select("sid", "_size", "slice", F.col("hash").alias("last_hash"), F.col("_id").alias("last_id"))
    return sources, classes


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: _row (all its columns), size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size_of(F.col(text_col)).alias("_size"), F.struct("*").alias("_row")
    )
    scratch = Scratch(spark, "mix")
    digest = scratch.keep(base.select("_id", "_source", "_size"), "digest")
    sources, classes = plan(digest, scratch, seed=seed)
    classes = scratch.keep(classes, "classes")
    small = small_enough(classes, BROADCAST_ROWS)
    scratch.drop("digest")
    out = base.join(sources, F.col("_source").eqNullSafe(F.col("_src")), "left").drop("_src")
    out = out.join(F.broadcast(classes) if small else classes, ["sid", "_size"], "left")
    hashed = F.xxhash64("_id", F.lit(seed))
    part = F.shiftrightunsigned(hashed, 64 - SLICE_BITS).cast("int")
    same = (part == F.col("slice")) & (
        (hashed < F.col("last_hash")) | ((hashed == F.col("last_hash")) & (F.coalesce(F.col("_id") <= F.col("last_id"), F.col("_id").isNull())))
    )
    more = F.coalesce((part < F.col("slice")) | same, F.lit(False))
    out = out.withColumn("copies", F.coalesce(F.col("passes"), F.lit(0)) + more.cast("int"))
    return out.select(
        "_row",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("_size") * F.col("copies")).alias("taken"),
    )
