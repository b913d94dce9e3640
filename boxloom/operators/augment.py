"""Rows of augmented data sets: copies with transformed boxes, seeded samples and draws, counts for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx

XYXY = ("x1", "y1", "x2", "y2")


def seeded(*key: str, seed: int) -> Column:
    """A text that orders rows at random, the same in every engine with MD5."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def ratio_sample(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """round(n * ratio) rows (half to even, ratio held between 0 and 1), in the order of a seeded hash."""
    ratio = min(max(ratio, 0.0), 1.0)
    return rows.orderBy(seeded(key, seed=seed), key).limit(round(rows.count() * ratio))


def weighted_draw(classes: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement from classes (category_id, weight): (draw, category_id).

    Weights are summed up in id order; draw k takes the class whose range holds its seeded number.
    Classes are a dimension table; the draws are joined with their ranges.
    """
    upto = Window.orderBy("category_id").rowsBetween(Window.unboundedPreceding, 0)
    ranges = classes.withColumn("hi", F.sum("weight").over(upto)).withColumn("lo", F.col("hi") - F.col("weight"))
    total = classes.agg(F.sum("weight").alias("total"))
    number = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    draws = classes.sparkSession.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(total)).withColumn("u", number * F.col("total"))
    # a range join: floor(u) meets the whole numbers that a range covers
    cell = F.explode(F.sequence(F.floor("lo"), F.floor("hi")))
    both = draws.withColumn("cell", F.floor("u")).join(ranges.withColumn("cell", cell), "cell")
    return both.where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "category_id")


def jittered(size: Column, seed: int, *key: str, spread: float = 0.1) -> Column:
    """A size times a seeded factor within 1 - spread and 1 + spread."""
    u = F.conv(F.substring(seeded(*key, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return size * (1 - spread + 2 * spread * u)


def canvas(images: DataFrame) -> DataFrame:
    """The median image size, cut to whole pixels."""
    return images.agg(F.median("width").cast("long").alias("width"), F.median("height").cast("long").alias("height"))


def copies(objects: DataFrame, n: int, degrees: tuple[float, ...] = (-5.0, 5.0), visible: float = 0.2, side: float = 4.0) -> DataFrame:
    """n transformed copies of every image's boxes (copy 1 .. n): a flip on even copies, then a turn by one of the angles.

    A box stays where its clipped part is ``side`` pixels wide and high and holds ``visible`` of its
    area; rows keep obj_idx, so nothing that runs beside them is misaligned.
    """
    size = bx.cols("image_width", "image_height")
    each = objects.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    own = bx.cols(*XYXY)
    flipped = tuple(F.when(F.col("copy") % 2 == 0, f).otherwise(o) for f, o in zip(bx.flip(own, size[0]), own))
    turned = [bx.rotated(flipped, *size, d) for d in degrees]
    pick = [F.when(F.col("copy") % len(degrees) == 0, turned[0][i]) for i in range(4)]
    for k, t in enumerate(turned[1:], 1):
        pick = [p.when(F.col("copy") % len(degrees) == k, t[i]) for i, p in enumerate(pick)]
    each = each.withColumns(dict(zip(("t1", "t2", "t3", "t4"), pick)))
    whole = bx.cols("t1", "t2", "t3", "t4")
    cut = bx.clip(whole, *size)
    ok = (cut[2] - cut[0] >= side) & (cut[3] - cut[1] >= side) & (bx.area(cut) >= visible * bx.area(whole))
    return each.where(ok).withColumns(dict(zip(XYXY, cut))).drop("t1", "t2", "t3", "t4")


def union_kinds(**kinds: DataFrame) -> DataFrame:
    """Train rows of several kinds, tagged."""
    out = None
    for kind, rows in kinds.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def kind_counts(rows: DataFrame) -> DataFrame:
    """(kind, images, boxes): copies of an image count each."""
    own = F.count_distinct(F.struct("image_id", F.coalesce("copy", F.lit(0)))) if "copy" in rows.columns else F.count_distinct("image_id")
    return rows.groupBy("kind").agg(own.alias("images"), F.count(F.lit(1)).alias("boxes"))


def dataset_counts(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, images, labels, boxes) from images (split, stem) and label lines (split, stem, line), where a file may have no lines."""
    held = labels.groupBy("split", "stem").agg(F.count("line").alias("boxes")).withColumn("has", F.lit(1))
    both = images.join(held, ["split", "stem"], "left")
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count("has").alias("labels"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"))
