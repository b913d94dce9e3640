"""Label lines, label files, exported splits, names files, submissions and run reports."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx

#: The columns of a submission, in order.
SUBMISSION = ("annotation_id", "image_id", "category_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "score")


def label_line(class_id: Column, form: dict[str, Column]) -> Column:
    """``class cx cy w h`` with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id.cast("long"), *[form[k] for k in ("cx", "cy", "w", "h")])


def label_texts(objects: DataFrame, keys: list[str], order: str, class_id: Column, form: dict[str, Column]) -> DataFrame:
    """(keys, n_boxes, n_skipped, text): the label text of each image; boxes without a form are skipped, no box gives an empty text."""
    line = F.when(form["cx"].isNotNull(), label_line(class_id, form))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    lines = F.filter(F.transform(rows, lambda r: r["line"]), lambda x: x.isNotNull())
    return objects.groupBy(*keys).agg(F.size(lines).alias("n_boxes"), (F.count(F.lit(1)) - F.size(lines)).alias("n_skipped"), F.array_join(lines, "\n").alias("text"))


def lenient(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre form whose centre is clipped to the image and whose size is capped at 1; null where the box has no size."""
    ok = (w > 0) & (h > 0)
    one, zero = F.lit(1.0), F.lit(0.0)
    form = {
        "cx": F.greatest(zero, F.least(one, (x + w / 2) / width)),
        "cy": F.greatest(zero, F.least(one, (y + h / 2) / height)),
        "w": F.least(one, w / width),
        "h": F.least(one, h / height),
    }
    return {k: F.when(ok, v) for k, v in form.items()}


def checked_class(label: Column, offset: int, classes: int) -> Column:
    """Class index of a label; null where it isn't one of the classes."""
    index = label - offset
    return F.when((index >= 0) & (index < classes), index)


def degenerate(objects: DataFrame, form: dict[str, Column], limit: int = 5) -> None:
    """Raises where a box has no area inside its image."""
    bad = objects.where(form["cx"].isNull()).limit(limit).collect()
    if bad:
        raise ValueError(f"boxes without an area: {bad}")


# ---------------------------------------------------------------- folders


def prepare_folder(root: str, clean: bool = False) -> None:
    """An empty folder for an export; one with content is refused, or emptied."""
    if os.path.isdir(root) and os.listdir(root):
        if not clean:
            raise FileExistsError(f"{root} isn't empty")
        shutil.rmtree(root)
    os.makedirs(root, exist_ok=True)


def write_label_files(texts: DataFrame, root: str) -> None:
    """One text file for each row (split, stem, text) below ``labels/<split>``: each task writes its own, on a folder that executors share."""

    def write(rows):
        for r in rows:
            folder = os.path.join(root, "labels", r.split)
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, f"{r.stem}.txt"), "w", encoding="utf-8") as f:
                f.write(r.text)

    texts.select("split", "stem", "text").foreachPartition(write)


def write_images(images: DataFrame, root: str) -> None:
    """Copies image bytes (split, file_name, content) below ``images/<split>``."""

    def write(rows):
        for r in rows:
            folder = os.path.join(root, "images", r.split)
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, r.file_name), "wb") as f:
                f.write(r.content)

    images.select("split", "file_name", "content").foreachPartition(write)


def names_of(categories: DataFrame) -> list[str]:
    """Class names by class index, from rows (class_id, name): as many as there are classes."""
    rows = categories.orderBy("class_id").collect()
    if [r.class_id for r in rows] != list(range(len(rows))):
        raise ValueError("class indices aren't consecutive")
    return [r.name for r in rows]


def require_same_size(names: dict[int, str], categories: DataFrame) -> None:
    """A names file has as many names as there are classes."""
    n = categories.select("category_id").distinct().count()
    if n != len(names):
        raise ValueError(f"{len(names)} names for {n} classes")


def write_data_yaml(categories: DataFrame, root: str, splits=("train", "val", "test")) -> str:
    """The names file of an exported data set."""
    import yaml

    names = names_of(categories)
    body = {"path": root, **{s: f"images/{s}" for s in splits}, "nc": len(names), "names": dict(enumerate(names))}
    path = os.path.join(root, "data.yaml")
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(body, f, allow_unicode=True, sort_keys=False)
    return path


def export_split(objects: DataFrame, categories: DataFrame, root: str, clean: bool = False) -> DataFrame:
    """Writes label files and the names file for objects (split, stem, obj_idx, class_id, box, image size); counts by split.

    Objects are strict: boxes that leave the image are clipped, those without an area skipped and counted.
    """
    prepare_folder(root, clean)
    form = bx.yolo(bx.corners(*bx.cols("bbox_x", "bbox_y", "bbox_w", "bbox_h")), *bx.cols("image_width", "image_height"))
    texts = label_texts(objects, ["split", "stem"], "obj_idx", F.col("class_id"), form)
    write_label_files(texts, root)
    write_data_yaml(categories, root)
    return texts.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("n_boxes").alias("boxes"), F.sum("n_skipped").alias("skipped"))


# ---------------------------------------------------------------- submission


def submission(pred: DataFrame, categories: DataFrame, number: Column) -> DataFrame:
    """The eight columns of a submission: whole pixels rounded half to even, scores to four places, ids of the categories (class_id, category_id).

    Predictions of a class without a category are lost in the look-up; count them with ``unknown_classes``.
    """
    known = pred.withColumn("annotation_id", number).join(F.broadcast(categories), "class_id")
    size = {"bbox_x": F.col("x1"), "bbox_y": F.col("y1"), "bbox_w": F.col("x2") - F.col("x1"), "bbox_h": F.col("y2") - F.col("y1")}
    whole = {k: F.bround(v).cast("long") for k, v in size.items()}
    return known.withColumns({**whole, "score": F.bround("score", 4)}).select(*SUBMISSION)


def unknown_classes(pred: DataFrame, categories: DataFrame) -> DataFrame:
    return pred.join(F.broadcast(categories), "class_id", "left_anti").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def write_submission(rows: DataFrame, path: str) -> None:
    rows.select(*SUBMISSION).write.mode("overwrite").option("header", True).csv(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    kinds = ["bigint"] * 7 + ["double"]
    return spark.read.schema(", ".join(f"{c} {k}" for c, k in zip(SUBMISSION, kinds))).option("header", True).option("enforceSchema", False).csv(path)


def submission_checks(rows: DataFrame, categories: DataFrame, images: int | None = None) -> DataFrame:
    """One row: how often each rule of a submission is broken, and the ranges of categories and scores."""
    known = F.broadcast(categories.select("category_id").distinct().withColumn("_known", F.lit(True)))
    nulls = F.lit(False)
    for c in SUBMISSION:
        nulls = nulls | F.col(c).isNull()
    one = rows.join(known, "category_id", "left").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count("annotation_id") - F.count_distinct("annotation_id")).alias("repeated"),
        F.count_if(nulls).alias("nulls"),
        F.count_if((F.col("bbox_w") <= 0) | (F.col("bbox_h") <= 0)).alias("flat"),
        F.count_if(~F.col("score").between(0, 1)).alias("scores"),
        F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.count_distinct("image_id").alias("images"),
        F.min("category_id").alias("low"), F.max("category_id").alias("high"), F.min("score").alias("least"), F.max("score").alias("most"),
    )
    absent = F.lit(images).cast("long") - F.col("images") if images is not None else F.lit(None).cast("long")
    return one.withColumn("columns_ok", F.lit([c for c in rows.columns if c in SUBMISSION] == list(SUBMISSION))).withColumn("absent", absent)


# ---------------------------------------------------------------- reports


def run_report(counts: DataFrame, **settings) -> str:
    """A run's counts (kind, images, boxes) and settings as one JSON text."""
    kinds = {r.kind: {"images": r.images, "boxes": r.boxes} for r in counts.orderBy("kind").collect()}
    return json.dumps({"kinds": kinds, "settings": settings}, ensure_ascii=False, sort_keys=True)


def markdown_report(title: str, counts: DataFrame, settings: dict) -> str:
    """The same as a markdown page, with the time of its writing."""
    columns = counts.columns
    when = counts.sparkSession.sql("select date_format(current_timestamp(), 'yyyy-MM-dd HH:mm') as t").first().t
    lines = [f"# {title}", "", f"Written {when}.", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in sorted(counts.collect(), key=str)]
    lines += ["", "| setting | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in sorted(settings.items())]]
    return "\n".join(lines) + "\n"
