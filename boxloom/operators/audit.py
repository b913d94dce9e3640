"""Data-quality audit and descriptive statistics of annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx

XYWH = ("bbox_x", "bbox_y", "bbox_w", "bbox_h")


def with_corners(ann: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = bx.corners(*bx.cols(*XYWH))
    return ann.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "calculated": F.col("bbox_w") * F.col("bbox_h")})


def invalid_boxes(ann: DataFrame) -> DataFrame:
    """Boxes that leave the image or have no size."""
    a = with_corners(ann)
    bad = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("bbox_w") <= 0) | (F.col("bbox_h") <= 0)
    return a.where(bad | (F.col("x2") > F.col("image_width")) | (F.col("y2") > F.col("image_height")))


def area_mismatches(ann: DataFrame) -> DataFrame:
    """Areas that aren't width times height (relative to the calculated one); a null area counts."""
    c = F.col("calculated")
    return with_corners(ann).where(F.col("area").isNull() | ~(F.abs(F.col("area") - c) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(c)))


def repaired_area(area: Column, w: Column, h: Column) -> Column:
    return F.when(F.coalesce(area, w * h) <= 0, w * h).otherwise(F.coalesce(area, w * h))


def null_summary(df: DataFrame, columns: list[str], empty: bool = False) -> DataFrame:
    """Nulls (with ``empty``, also empty strings) of each column that has any, and their share in percent."""
    tests = {c: F.col(c).isNull() | (F.col(c).cast("string") == "") if empty else F.col(c).isNull() for c in columns}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(c) for c, t in tests.items()])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = one.select("n", F.expr(f"stack({len(columns)}, {pairs}) as (column_name, nulls)"))
    return long.where("nulls > 0").select("column_name", "nulls", (F.col("nulls") * 100 / F.col("n")).alias("rate"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that don't have exactly one value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n")).where("n <> 1")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, linear quartiles and maximum of each column.

    Quartiles are read off the counts of distinct values, summed up in order; no buffer holds them all.
    """
    long = df.select(F.expr(f"stack({len(columns)}, {', '.join(f"'{c}', `{c}`" for c in columns)}) as (column_name, v)")).where("v is not null")
    one = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    upto = Window.partitionBy("column_name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto))
    counts = counts.join(F.broadcast(one.select("column_name", "n")), "column_name")
    at = {q: F.lit(q) * (F.col("n") - 1) for q in (0.25, 0.5, 0.75)}
    ends = [F.min(F.when(F.col("upto") > f(p), F.col("v"))).alias(f"{side}{i}") for i, p in enumerate(at.values(), 1) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = counts.groupBy("column_name").agg(*ends).join(one, "column_name")
    quartiles = {f"q{i}": F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)) for i, p in enumerate(at.values(), 1)}
    return found.withColumns(quartiles).select("column_name", "n", "mean", "std", "min", "q1", "q2", "q3", "max")


def aspect_bin(w: Column, h: Column) -> Column:
    """Right-closed bins of w / h at 0.5, 0.8, 1.2 and 2; null at 0 or below."""
    r = F.try_divide(w, h)
    out = F.when(r <= 0, F.lit(None).cast("int"))
    for i, edge in enumerate((0.5, 0.8, 1.2, 2.0)):
        out = out.when(r <= edge, i)
    return out.when(r.isNotNull(), 4)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last one is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows whose columns occur more than once."""
    return df.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*columns))).where("copies > 1")


def label_mapping(df: DataFrame, start: int = 0) -> DataFrame:
    """Consecutive labels of the distinct category ids, in their order."""
    ids = df.select("category_id").distinct()
    return ids.withColumn("label", (F.row_number().over(Window.orderBy("category_id")) - 1 + start).cast("long"))


def first_per_key(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def numbered(rows: DataFrame, span: Column, *order) -> DataFrame:
    """Adds position, from 0, in an order along which ``span`` (a whole number) never falls.

    Rows are counted by span, the counts summed up, and rows placed inside their span: only the
    few spans meet in one task.
    """
    each = rows.withColumn("_span", span)
    counts = each.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_span").orderBy(*order)) - 1
    both = each.withColumn("_at", inside).join(offsets, "_span")
    return both.withColumn("position", (F.col("_before") + F.col("_at")).cast("long")).drop("_span", "_at", "_before")


def group_split(groups: DataFrame, key: str, seed: int, train: float = 0.8) -> DataFrame:
    """Every key in train, val or test: distinct keys in the order of a seeded hash, test parts rounded up."""
    keys = groups.select(F.col(key).cast("string").alias("key")).distinct()
    hashed = keys.withColumn("_hash", F.md5(F.concat("key", F.lit(f":{seed}"))))
    ranked = numbered(hashed, F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"), "_hash", "key")
    n = ranked.crossJoin(F.broadcast(keys.agg(F.count(F.lit(1)).alias("n"))))
    rank = F.col("position") + 1
    rest = F.ceil(F.col("n") * (10 - round(train * 10)) / 10)
    cut = F.when(rank > rest, "train").when(rank > F.ceil(rest / 2), "val").otherwise("test")
    return n.select("key", cut.alias("split"))



def orphans(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the known rows don't have."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def difference(left: DataFrame, right: DataFrame, key: str, only_left: str, only_right: str) -> DataFrame:
    """Keys that only one side has, with a name for the side that lacks them."""
    a = left.join(right, key, "left_anti").select(key, F.lit(only_left).alias("side"))
    return a.union(right.join(left, key, "left_anti").select(key, F.lit(only_right).alias("side")).distinct())


def class_sizes(objects: DataFrame, classes: DataFrame, all_objects: DataFrame) -> DataFrame:
    """(category_id, w, h): the median box size of each class, else that of all objects."""
    own = objects.groupBy("category_id").agg(F.median("bbox_w").alias("w"), F.median("bbox_h").alias("h"))
    one = all_objects.agg(F.median("bbox_w").alias("all_w"), F.median("bbox_h").alias("all_h"))
    both = classes.join(own, "category_id", "left").crossJoin(F.broadcast(one))
    return both.select("category_id", F.coalesce("w", "all_w").alias("w"), F.coalesce("h", "all_h").alias("h"))


def named(rows: DataFrame, names: DataFrame, key: str, default: str) -> DataFrame:
    """Adds the name of each row's class; a class without one has the default."""
    return rows.join(names.select(key, "name"), key, "left").withColumn("name", F.coalesce("name", F.lit(default)))
