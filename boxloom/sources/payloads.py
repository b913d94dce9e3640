"""Annotation documents (images, annotations, categories in one JSON object), file names and label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "images array<struct<id:bigint,file_name:string,width:double,height:double,drug_N:string,dl_name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double>>, "
    "categories array<struct<id:bigint,name:string>>"
)
UNKNOWN = "Unknown"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All JSON files below a folder, one row each, with their path; sorted by it."""
    files = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return files.withColumn("json_path", F.col("_metadata.file_path")).orderBy("json_path")


def parse_documents(df: DataFrame, text: str) -> DataFrame:
    """The same rows with a JSON text parsed into images, annotations and categories."""
    return df.withColumn("_doc", F.from_json(text, DOCUMENT)).select("*", "_doc.*").drop("_doc", text)


def flatten(docs: DataFrame) -> DataFrame:
    """One row per annotation and image of its id within a document; all lookups stay inside the row, without a shuffle."""
    each = docs.select("*", F.explode("annotations").alias("ann"))
    each = each.select("*", F.explode(F.filter("images", lambda i: i["id"] == F.col("ann.image_id"))).alias("img"))
    named = F.try_element_at(F.filter("categories", lambda c: c["id"] == F.col("ann.category_id")), F.lit(-1))
    box = {f"bbox_{n}": F.get("ann.bbox", F.lit(i)) for i, n in enumerate("xywh")}
    return each.select(
        F.col("img.id").alias("image_id"), F.col("img.file_name").alias("file_name"), F.col("img.width").alias("image_width"),
        F.col("img.height").alias("image_height"), F.col("ann.id").alias("annotation_id"), F.col("ann.category_id").alias("category_id"),
        F.coalesce(named["name"], F.lit(UNKNOWN)).alias("category_name"), *[c.alias(n) for n, c in box.items()], F.col("ann.area").alias("area"),
    )


def problems(docs: DataFrame, key: str) -> DataFrame:
    """(key, problem) for every rule that a document breaks."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    sound = lambda a: F.coalesce((F.size(a["bbox"]) == 4) & (F.get(a["bbox"], F.lit(2)) > 0) & (F.get(a["bbox"], F.lit(3)) > 0), F.lit(False))
    ids = F.transform("annotations", lambda a: a["category_id"])
    rules = {
        "no image": none("images"),
        "no annotation": none("annotations"),
        "bad box": F.exists("annotations", lambda a: ~sound(a)),
        "image id differs": F.exists("annotations", lambda a: a["image_id"] != F.get("images", F.lit(0))["id"]),
        "category repeated": F.size(F.array_distinct(ids)) < F.size(ids),
    }
    found = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda p: p.isNotNull())
    return docs.select(key, F.explode(found).alias("problem"))


def filled(digits: Column) -> Column:
    """Filled with zeros to six places; longer numbers stay whole."""
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))


def name_ids(name: Column) -> Column:
    """The category ids in a file name's first part: its runs of six digits or more."""
    codes = F.regexp_extract_all(F.split_part(name, F.lit("_"), F.lit(1)), F.lit(r"(\d{6,})"))
    return F.transform(codes, lambda c: c.cast("bigint"))


def placeholder(category_id: Column, name: Column, drug_n: Column, dl_name: Column) -> tuple[Column, Column]:
    """Id and name of a category; the stand-in (1, "drug") takes them from the image's code and name."""
    stand_in = (category_id == 1) & (F.lower(F.trim(name)) == "drug")
    real = F.regexp_replace(drug_n, "^K-", "").try_cast("bigint")
    title = F.coalesce(F.when(F.trim(dl_name) != "", F.trim(dl_name)), F.concat(F.lit("K-"), filled(real.cast("string"))))
    return F.when(stand_in, real).otherwise(category_id), F.when(stand_in, title).otherwise(name)


def parse_image_name(name: Column) -> dict[str, Column]:
    """Kind, codes (joined by "-") and camera angle that a file name tells; nulls where it fits no pattern."""
    kind = (
        F.when(name.rlike(r"^K-\d{6}(-\d{6}){2,3}_"), "combination")
        .when(name.rlike(r"^copy_paste_\d+\."), "copy_paste")
        .when(name.rlike(r"^K-\d{6}(_|\.)"), "single")
    )
    codes = F.nullif(F.regexp_extract(name, r"^K-(\d{6}(?:-\d{6})*)", 1), F.lit(""))
    angle = F.get(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_"), F.lit(5)).try_cast("int")
    return {"kind": kind, "codes": F.when(kind != "copy_paste", codes), "angle": F.when(kind != "copy_paste", angle)}


def pill_id(drug_index: Column, drug_code: Column) -> Column:
    """The index, else the code without "K-"; digits are filled to six places."""
    raw = F.coalesce(drug_index.cast("string"), F.regexp_replace(drug_code, "^K-", ""))
    return F.when(raw.rlike(r"^\d+$"), filled(raw)).otherwise(raw)


def parse_label_lines(df: DataFrame, line: str, strict: bool = True) -> DataFrame:
    """Label, centre form and "ok" of each line; strict lines have five numbers, lenient ones at least five."""
    parts = F.split(F.trim(line), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    values = {"label": number(0).cast("int")} | {n: number(i) for i, n in enumerate(("cx", "cy", "w", "h"), 1)}
    fits = F.size(parts) == 5 if strict else F.size(parts) >= 5
    return df.withColumns(values).withColumn("ok", F.coalesce(fits & (number(0) + number(1) + number(2) + number(3) + number(4)).isNotNull(), F.lit(False)))


def resolve(df: DataFrame, keys: list[str], mapping: DataFrame) -> DataFrame:
    """First key, in order, that the mapping (key, value, ts) holds: ts and the name of the key that hit.

    One join for all keys: they are exploded by rank, and the lowest rank that meets a row wins.
    """
    rows = df.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in df.columns else df
    asked = rows.select("_id", F.posexplode(F.array(*[F.struct(F.lit(k).alias("key"), F.trim(F.col(k).cast("string")).alias("value")) for k in keys])).alias("rank", "k"))
    hits = asked.select("_id", "rank", "k.*").join(mapping, ["key", "value"]).groupBy("_id").agg(F.min(F.struct("rank", "key", "ts")).alias("hit"))
    return rows.join(hits, "_id", "left").withColumn("hit_key", F.col("hit.key")).withColumn("ts", F.col("hit.ts")).drop("hit")
