"""Samples of a data set: parsed documents with their metadata, and the look-up of real categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.operators import audit
from boxloom.sources import payloads

#: Metadata attribute and the key that it is read from, by record.
IMAGE_KEYS = {
    "source_image_id": "id", "source_image_file_name": "file_name", "drug_code": "drug_N", "mapping_code": "dl_mapping_code", "drug_index": "dl_idx",
    "item_seq": "item_seq", "drug_name": "dl_name", "drug_name_en": "dl_name_en", "material": "dl_material", "material_en": "dl_material_en",
    "company": "dl_company", "company_en": "dl_company_en", "manufacturer": "di_company_mf", "manufacturer_en": "di_company_mf_en", "drug_status": "drug_S",
    "custom_shape": "dl_custom_shape", "shape": "drug_shape", "color1": "color_class1", "color2": "color_class2", "chart": "chart",
    "form_code_name": "form_code_name", "length_long": "leng_long", "length_short": "leng_short", "thickness": "thick", "front_print": "print_front",
    "back_print": "print_back", "front_line": "line_front", "back_line": "line_back", "mark_code_front": "mark_code_front", "mark_code_back": "mark_code_back",
    "mark_code_front_analysis": "mark_code_front_anal", "mark_code_back_analysis": "mark_code_back_anal", "direction": "drug_dir", "background": "back_color",
    "light": "light_color", "camera_latitude": "camera_la", "camera_longitude": "camera_lo", "source_size": "size", "permit_date": "di_item_permit_date",
    "class_number": "di_class_no", "etc_otc_code": "di_etc_otc_code", "edi_code": "di_edi_code", "registration_timestamp": "img_regist_ts",
    "change_date": "change_date", "image_url": "img_key",
}
#: Keys of the look-up of real categories, in order, and the metadata attribute each is asked with.
LOOKUP = {"drug_N": "drug_code", "dl_mapping_code": "mapping_code", "item_seq": "item_seq", "drug_name": "drug_name"}


def metadata(image: Column, annotation: Column, category: Column, path: Column) -> Column:
    """The 49 attributes of an object, from maps of its three records; an absent key is null."""
    get = lambda record, key: F.try_element_at(record, F.lit(key))
    own = {"annotation_json_path": path, "annotation_id": get(annotation, "id")}
    own |= {name: get(image, key) for name, key in IMAGE_KEYS.items()}
    own |= {"category_name": get(category, "name"), "supercategory": get(category, "supercategory")}
    return F.struct(*[c.cast("string").alias(n) for n, c in own.items()])


# ---------------------------------------------------------------- codes


def normal_text(value: Column) -> Column:
    """Trimmed; null where nothing is left."""
    text = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    return F.when(text != "", text)


def normal_pill_id(value: Column) -> Column:
    """Without a leading "K-"."""
    text = normal_text(value)
    return F.when(text.startswith("K-"), F.substr(text, F.lit(3))).otherwise(text)


def normal_code(value: Column) -> Column:
    """A pill id without leading zeros; all zeros are "0"."""
    bare = F.regexp_replace(normal_pill_id(value), "^0+", "")
    return F.when(normal_pill_id(value).isNotNull(), F.when(bare == "", "0").otherwise(bare))


def optional_int(value: Column) -> Column:
    return F.when(normal_text(value).isNotNull(), normal_text(value).try_cast("bigint"))


# ---------------------------------------------------------------- real categories


def category_map(objects: DataFrame) -> DataFrame:
    """(key, value, ts, n_ids): what each key's values say of the category, from objects with drug_N, dl_mapping_code, item_seq, dl_name, category_id and category_name.

    Stand-ins (category 1 named "Drug") are left out. A value with several categories has n_ids
    above 1: a conflict, see ``conflicts``.
    """
    real = objects.where(~F.coalesce((F.col("category_id") == 1) & (F.trim("category_name") == "Drug"), F.lit(False)))
    named = F.coalesce(F.nullif(F.col("dl_name"), F.lit("")), F.col("category_name"))
    values = {"drug_N": normal_code(F.col("drug_N")), "dl_mapping_code": normal_code(F.col("dl_mapping_code")), "item_seq": normal_text(F.col("item_seq")), "drug_name": normal_text(named)}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    each = real.select("category_id", F.explode(rows).alias("k")).select("k.*", "category_id").where("value is not null")
    return each.groupBy("key", "value").agg(F.min("category_id").alias("ts"), F.count_distinct("category_id").alias("n_ids"))


def conflicts(mapping: DataFrame) -> DataFrame:
    """Values that stand for several categories."""
    return mapping.where("n_ids > 1").select("key", "value", "n_ids")


def require_no_conflicts(mapping: DataFrame, shown: int = 5) -> DataFrame:
    bad = conflicts(mapping).orderBy("key", "value").limit(shown).collect()
    if bad:
        raise ValueError(f"values with several categories: {[tuple(r) for r in bad]}")
    return mapping


def resolve_categories(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds ts and hit_key: the category of the first key, in order, that the mapping holds."""
    norm = {"drug_N": normal_code, "dl_mapping_code": normal_code, "item_seq": normal_text, "drug_name": normal_text}
    asked = objects.withColumns({k: norm[k](F.col(a)) for k, a in LOOKUP.items()})
    return payloads.resolve(asked, list(LOOKUP), mapping.select("key", "value", "ts"))


# ---------------------------------------------------------------- names of folders


def normal_key(text: Column) -> Column:
    """Lower case without blanks, underscores, dashes, dots, brackets, slashes and commas."""
    return F.lower(F.regexp_replace(text, r"[\s_\-.()\[\]/,]", ""))


def name_candidates(name: Column) -> Column:
    """The keys a name may be known by, in order: itself, what follows its first underscore, a number before it, its longest number."""
    text = F.trim(name.cast("string"))
    head, tail = F.regexp_extract(text, r"^([^_]*)_", 1), F.regexp_extract(text, r"^[^_]*_(.*)$", 1)
    has = F.contains(text, F.lit("_"))
    digits = F.when(has & F.trim(head).rlike(r"^\d+$"), F.regexp_replace(F.trim(head), r"^0+(?=\d)", ""))
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"))
    # the first of the longest ones
    longest = F.element_at(F.array_sort(F.transform(numbers, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), 1)["x"]
    longest = F.when(F.size(numbers) > 0, F.regexp_replace(longest, r"^0+(?=\d)", ""))
    keys = F.transform(F.array(text, F.when(has, tail), digits, longest), normal_key)
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def match_names(folders: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds class_id to folders (folder): the first of its keys that a class (class_id, name) has; of several classes the first; null for none."""
    known = classes.select("class_id", F.explode(name_candidates(F.col("name"))).alias("key")).groupBy("key").agg(F.min("class_id").alias("class_id"))
    asked = folders.select("folder", F.posexplode(name_candidates(F.col("folder"))).alias("rank", "key")).distinct()
    hits = asked.join(known, "key").groupBy("folder").agg(F.min_by("class_id", "rank").alias("class_id"))
    return folders.join(hits, "folder", "left")


# ---------------------------------------------------------------- samples


def first_objects(docs: DataFrame) -> DataFrame:
    """One object per document: its first image, annotation and category only; other entries are ignored."""
    first = lambda c: F.slice(F.coalesce(F.col(c), F.array().cast(docs.schema[c].dataType)), 1, 1)
    return docs.withColumns({c: first(c) for c in ("images", "annotations", "categories")})


def strict_problems(docs: DataFrame, key: str, file_name: Column) -> DataFrame:
    """(key, problem) for documents of composed images, which hold one image and all its objects: every rule they break."""
    image = F.get("images", F.lit(0))
    ids, wanted = F.transform("categories", lambda c: c["id"]), F.transform("annotations", lambda a: a["category_id"])
    sound = lambda a: F.coalesce((F.size(a["bbox"]) == 4) & (F.get(a["bbox"], F.lit(2)) > 0) & (F.get(a["bbox"], F.lit(3)) > 0), F.lit(False))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    rules = {
        "not one image": size("images") != 1,
        "no annotation": size("annotations") <= 0,
        "file name differs": ~F.coalesce(image["file_name"] == file_name, F.lit(False)),
        "category repeated": F.size(F.array_distinct(ids)) < F.size(ids),
        "category unknown": F.size(F.array_except(wanted, ids)) > 0,
        "image id differs": F.exists("annotations", lambda a: F.coalesce(a["image_id"] != image["id"], F.lit(False))),
        "bad box": F.exists("annotations", lambda a: ~sound(a)),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]), lambda p: p.isNotNull())
    return docs.select(key, F.explode(found).alias("problem"))


def finished(objects: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """Objects (category_id, annotation_id, box, area, ...) with label, class name (else the id), repaired area and -1 for a null annotation id.

    labels: (category_id, label); an object whose category has none is an error of the caller's, found by ``unlabelled``.
    """
    both = objects.join(F.broadcast(labels), "category_id").join(F.broadcast(names.withColumnRenamed("name", "class_name")), "category_id", "left")
    w, h = F.col("bbox_w"), F.col("bbox_h")
    area = F.coalesce("area", w * h)
    return both.withColumns({
        "class_name": F.coalesce("class_name", F.col("category_id").cast("string")), "annotation_id": F.coalesce("annotation_id", F.lit(-1).cast("long")),
        "area": F.when(area <= 0, w * h).otherwise(area), "x1": F.col("bbox_x"), "y1": F.col("bbox_y"), "x2": F.col("bbox_x") + w, "y2": F.col("bbox_y") + h,
    })


def unlabelled(objects: DataFrame, labels: DataFrame) -> DataFrame:
    return objects.join(F.broadcast(labels), "category_id", "left_anti").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


def samples(images: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per image with its objects in order; an image without any has an empty list, never null."""
    each = F.struct("obj_idx", "label", "class_name", "annotation_id", "area", "x1", "y1", "x2", "y2")
    held = objects.groupBy("image_id").agg(F.sort_array(F.collect_list(each)).alias("objects"))
    both = images.join(held, "image_id", "left")
    none = F.array().cast(held.schema["objects"].dataType)
    return both.withColumn("objects", F.coalesce("objects", none)).withColumn("num_objects", F.size("objects").cast("long"))


def positions(rows: DataFrame, column: str) -> DataFrame:
    """Adds position: the place of each row by a unique whole number, from 0."""
    return audit.numbered(rows, F.floor(F.col(column) / 65536), column)


def agree(*sets: DataFrame, key: str = "position") -> DataFrame:
    """How many positions the data sets fill, and at how many their image_id isn't the same."""
    first, ids = sets[0].select(key, F.col("image_id").alias("i0")), ["i0"]
    for n, other in enumerate(sets[1:], 1):
        first = first.join(other.select(key, F.col("image_id").alias(f"i{n}")), key, "full")
        ids.append(f"i{n}")
    same = F.lit(True)
    for i in ids[1:]:
        same = same & F.coalesce(F.col("i0") == F.col(i), F.lit(False))
    return first.agg(F.count(F.lit(1)).alias("positions"), F.count_if(~same).alias("differing"))
