"""Whole runs: from images and objects to an exported, checked data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx
from boxloom.operators import audit, augment, crops, splits
from boxloom.sinks import labels


def split_images(images: DataFrame, key: str, seed: int, how: str = "hash", **ratios) -> DataFrame:
    """(image_id, split): groups by a seeded hash, or by one of the two permutations of all keys."""
    if how == "hash":
        table = audit.group_split(images, key, seed, **ratios)
    else:
        parts = {"two_step": splits.two_step, "one_step": splits.one_step}[how](splits.keys_of(images, key), seed, **ratios)
        table = splits.as_table(images.sparkSession, parts)
    keyed = images.select("image_id", F.col(key).cast("string").alias("key"))
    return keyed.join(table, "key").select("image_id", "split")


def label_problems(objects: DataFrame, assigned: DataFrame) -> DataFrame:
    """(split, images, labels, unlabelled): how many images of each part have a label."""
    held = objects.select("image_id").distinct().withColumn("has", F.lit(1))
    return assigned.join(held, "image_id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count("has").alias("labels"), F.count_if(F.col("has").isNull()).alias("unlabelled"))


def build(images: DataFrame, objects: DataFrame, categories: DataFrame, root: str, *, key: str = "group_id", seed: int = 42, how: str = "two_step", single_object: bool = False, clean: bool = False, n_aug: int = 0) -> DataFrame:
    """Splits, labels, writes and checks a data set; the counts of each part.

    objects: image_id, obj_idx, category_id, bbox_x .. bbox_h, image_width, image_height.
    single_object: the train part holds one crop for each object. n_aug: copies of train boxes.
    """
    assigned = split_images(images, key, seed, how)
    splits.require_valid(images, assigned, key)
    mapping = audit.label_mapping(objects).withColumnRenamed("label", "class_id")
    corner = dict(zip(("x1", "y1", "x2", "y2"), bx.clip(bx.corners(*bx.cols("bbox_x", "bbox_y", "bbox_w", "bbox_h")), *bx.cols("image_width", "image_height"))))
    rows = objects.join(F.broadcast(mapping), "category_id").join(assigned, "image_id").withColumns(corner)
    rows = rows.withColumn("stem", F.col("image_id").cast("string"))
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    if single_object:
        cut = crops.single_object_rows(train.where("x2 > x1 and y2 > y1"))
        size = {"image_width": F.col("crop_x2") - F.col("crop_x1"), "image_height": F.col("crop_y2") - F.col("crop_y1")}
        train = cut.withColumns({"x1": F.col("x1") - F.col("crop_x1"), "y1": F.col("y1") - F.col("crop_y1"), "x2": F.col("x2") - F.col("crop_x1"), "y2": F.col("y2") - F.col("crop_y1"), **{k: v.cast("double") for k, v in size.items()}})
        bad = crops.not_one_line(cut).limit(5).collect()
        if bad:
            raise ValueError(f"crops without exactly one line: {bad}")
    if n_aug:
        copies = augment.copies(train, n_aug).withColumn("stem", F.concat("stem", F.lit("_aug"), F.col("copy").cast("string")))
        train = train.unionByName(copies.drop("copy"), allowMissingColumns=True)
    both = train.unionByName(rest, allowMissingColumns=True)
    box = {"bbox_x": F.col("x1"), "bbox_y": F.col("y1"), "bbox_w": F.col("x2") - F.col("x1"), "bbox_h": F.col("y2") - F.col("y1")}
    names = mapping.join(categories.select("category_id", "name"), "category_id", "left").select("class_id", F.coalesce("name", F.col("category_id").cast("string")).alias("name"))
    return labels.export_split(both.withColumns(box), names, root, clean)


def with_composed(objects: DataFrame, composed: DataFrame) -> DataFrame:
    """Train objects and those of composed images (see ``patches.compose``), tagged by kind; composed images keep their own stems."""
    each = composed.select("image_id", F.col("width").cast("double").alias("image_width"), F.col("height").cast("double").alias("image_height"), F.posexplode("objects").alias("obj_idx", "o"))
    rows = each.select("image_id", F.col("obj_idx").cast("long").alias("obj_idx"), "o.*", "image_width", "image_height")
    rows = rows.withColumn("stem", F.concat(F.lit("copy_paste_"), F.lpad(F.col("image_id").cast("string"), 6, "0")))
    own = objects.withColumn("stem", F.col("image_id").cast("string")) if "stem" not in objects.columns else objects
    return augment.union_kinds(orig=own, cp=rows)
