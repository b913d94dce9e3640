"""Folders of documents, images and label files; names files and settings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx
from boxloom.sources import payloads

#: Endings of image files.
IMAGES = ("png", "jpg", "jpeg", "bmp", "webp")


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file_name", name).withColumn("stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))


def list_files(spark: SparkSession, path: str, endings=("json",), recursive: bool = True) -> DataFrame:
    """(path, file_name, stem) of a folder's files with these endings, sorted by path; their content isn't read."""
    wanted = "*.{" + ",".join(f"{e},{e.upper()}" for e in endings) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", wanted).option("recursiveFileLookup", recursive).load(path)
    return _named(files.select("path")).orderBy("path")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files directly in a folder, by name, with their position."""
    own = list_files(spark, f"{path}/*", IMAGES, recursive=False)
    return own.orderBy("file_name")


def list_numbered(spark: SparkSession, path: str, ending: str = "png") -> DataFrame:
    """Images whose names are numbers, in their order; none is an error, another name too."""
    files = list_files(spark, f"{path}/*", (ending,), recursive=False)
    if not files.limit(1).count():
        raise FileNotFoundError(f"no .{ending} files in {path}")
    return files.withColumn("image_id", F.col("stem").cast("long")).orderBy("image_id")


def find_image(ids: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file_name to ids (image_id): the first of ``<id>.png``, ``<id>.jpg`` and ``<id>.jpeg`` that exists, else the first."""
    names = F.array(*[F.concat(F.col("image_id").cast("string"), F.lit(f".{e}")) for e in ("png", "jpg", "jpeg")])
    asked = ids.select("image_id", F.posexplode(names).alias("rank", "file_name")).join(files.select("file_name").distinct(), "file_name", "left_semi")
    best = asked.groupBy("image_id").agg(F.min_by("file_name", "rank").alias("found"))
    return ids.join(best, "image_id", "left").withColumn("file_name", F.coalesce("found", F.concat(F.col("image_id").cast("string"), F.lit(".png")))).drop("found")


def _be(data: Column, at: Column | int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("int")


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG file's first bytes; null for other files."""
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(ok, _be(content, 17, 4)), F.when(ok, _be(content, 21, 4))


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, stem, width, height) of a folder's images: PNG headers, other files decoded by Spark's image reader."""
    glob = "*.{" + ",".join(f"{e},{e.upper()}" for e in IMAGES) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    width, height = png_size(F.col("content"))
    head = _named(files.select("path", width.alias("width"), height.alias("height"))).select("file_name", "stem", "width", "height")
    rest = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob.replace("png,PNG,", "")).load(path)
    rest = _named(rest.select(F.col("image.origin").alias("path"), F.col("image.width").alias("w"), F.col("image.height").alias("h"))).select("file_name", "w", "h")
    both = head.join(rest, "file_name", "left")
    return both.select("file_name", "stem", F.coalesce("width", "w").alias("width"), F.coalesce("height", "h").alias("height"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, width, height, channels, data) of the images that can be decoded; rows of pixels are BGR."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.element_at(F.split("image.origin", "/"), -1).alias("file_name"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def size_check(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images (file_name, width, height) whose stored size isn't the file's, and those without a file."""
    real = files.select("file_name", F.col("width").cast("double").alias("file_width"), F.col("height").cast("double").alias("file_height"))
    both = images.join(real, "file_name", "left")
    same = (F.col("width") == F.col("file_width")) & (F.col("height") == F.col("file_height"))
    return both.where(~F.coalesce(same, F.lit(False)))


def documents_of_images(images: DataFrame, files: DataFrame) -> DataFrame:
    """Finds each image's documents: (stem, expected, found, mode) from images (stem, folder, expected) and files (folder, stem).

    Files of the image's stem in its own folder count first (direct); where there are none, those
    of the stem anywhere (fallback).
    """
    by = files.groupBy("folder", "stem").agg(F.count(F.lit(1)).alias("direct"))
    anywhere = files.groupBy("stem").agg(F.count(F.lit(1)).alias("all"))
    both = images.join(by, ["folder", "stem"], "left").join(anywhere, "stem", "left")
    mode = F.when(F.col("direct") > 0, "direct").when(F.col("all") > 0, "fallback").otherwise("none")
    return both.select("stem", "expected", F.coalesce("direct", "all", F.lit(0)).alias("found"), mode.alias("mode"))


def crop_folders(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """(path, folder, file_name, class_id) of crops kept in a folder for each class; class_id is null where no class has the folder's name."""
    from boxloom.operators import samples

    files = list_files(spark, path, IMAGES).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    known = samples.match_names(files.select("folder").distinct(), classes)
    return files.join(F.broadcast(known), "folder").select("path", "folder", "file_name", "class_id")


# ---------------------------------------------------------------- label folders


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(stem, line, text, label, cx, cy, w, h, ok) of all label files below a folder, a row for each line with its number; empty lines are skipped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("wholetext", True).text(path)
    files = _named(files.withColumn("path", F.col("_metadata.file_path")))
    lines = files.select("stem", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "text")).where(F.trim("text") != "")
    return payloads.parse_label_lines(lines, F.col("text"), strict)


def labels_of(stems: DataFrame, labels: DataFrame) -> DataFrame:
    """Label rows of images; an image without a label file, or with an empty one, has one row of nulls."""
    return stems.join(labels, "stem", "left")


def pixel_boxes(labels: DataFrame, sizes: DataFrame, least: float = 1.0) -> DataFrame:
    """Clipped corners in pixels of label rows joined with image sizes (stem, width, height); boxes below ``least`` pixels go."""
    both = labels.where("ok").join(sizes.select("stem", "width", "height"), "stem")
    box = bx.clip(bx.from_yolo(*bx.cols("cx", "cy", "w", "h"), *bx.cols("width", "height")), *bx.cols("width", "height"))
    x1, y1, x2, y2 = box
    return both.select("stem", "label", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), box)]).where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def split_records(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(file_name, stem, width, height, boxes): a split's images with their label boxes (x, y, w, h, label) in file order; none is an empty list."""
    sizes = image_sizes(spark, f"{root}/images/{split}")
    labels = read_labels(spark, f"{root}/labels/{split}", strict=False).where("ok").join(sizes.select("stem", "width", "height"), "stem")
    x1, y1, x2, y2 = bx.from_yolo(*bx.cols("cx", "cy", "w", "h"), *bx.cols("width", "height"))
    box = F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"), "label")
    held = F.sort_array(F.collect_list(F.struct("line", box.alias("box"))))
    boxes = labels.groupBy("stem").agg(F.transform(held, lambda b: b["box"]).alias("boxes"))
    return sizes.join(boxes, "stem", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))


# ---------------------------------------------------------------- settings


def read_names(path: str) -> dict[int, str]:
    """Class names of a names file, written as a list or as a mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        names = (yaml.safe_load(f) or {}).get("names") or []
    return {int(k): str(v) for k, v in (names.items() if isinstance(names, dict) else enumerate(names))}


def read_settings(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def merge_settings(defaults: dict, own: dict) -> tuple[dict, list[str]]:
    """Defaults with the own values on top; keys that the defaults don't know are left out and named."""
    return {**defaults, **{k: v for k, v in own.items() if k in defaults}}, sorted(set(own) - set(defaults))


def require_paths(**paths: str) -> None:
    """Raises for the paths that don't exist, by name."""
    gone = {k: p for k, p in paths.items() if not os.path.exists(p)}
    if gone:
        raise FileNotFoundError(f"missing: {gone}")
