"""One query for each operator, over whole tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx
from boxloom.operators import audit, detect, samples, splits
from boxloom.sinks import labels
from boxloom.sources.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
XYXY = ("x1", "y1", "x2", "y2")
CORNERS = "bbox_x AS x1, bbox_y AS y1, bbox_x + bbox_w AS x2, bbox_y + bbox_h AS y2"
CLIP = (
    "(SELECT *, greatest(0.0::double, least(bbox_x, image_width)) AS x1, greatest(0.0::double, least(bbox_y, image_height)) AS y1, "
    "greatest(0.0::double, least(bbox_x + bbox_w, image_width)) AS x2, greatest(0.0::double, least(bbox_y + bbox_h, image_height)) AS y2 FROM ann)"
)


def query(name: str, views: str = "ann", sql: str | None = None):
    """Registers a function of Tables under a name, with its SQL over the views it needs."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql, *views.split()) if views else sql
        return f

    return add


def _boxes(df: DataFrame) -> tuple:
    return bx.corners(*bx.cols(*audit.XYWH))


def _size() -> tuple:
    return bx.cols("image_width", "image_height")


# ---------------------------------------------------------------- audit


@query("invalid_bbox", sql=f"SELECT annotation_id, {CORNERS} FROM ann WHERE bbox_x < 0 OR bbox_y < 0 OR bbox_w <= 0 OR bbox_h <= 0 OR bbox_x + bbox_w > image_width OR bbox_y + bbox_h > image_height")
def _(t):
    return audit.invalid_boxes(t.ann).select("annotation_id", *XYXY)


@query("bbox_corners", sql=f"SELECT annotation_id, {CORNERS}, bbox_w * bbox_h AS calculated FROM ann")
def _(t):
    return audit.with_corners(t.ann).select("annotation_id", *XYXY, "calculated")


@query("area_mismatch", sql="SELECT annotation_id, area, area - bbox_w * bbox_h AS difference FROM ann WHERE area IS NULL OR NOT (abs(area - bbox_w * bbox_h) <= 1e-8 + 1e-5 * abs(bbox_w * bbox_h))")
def _(t):
    return audit.area_mismatches(t.ann).select("annotation_id", "area", (F.col("area") - F.col("calculated")).alias("difference"))


FAULTY = "CASE WHEN line = 1 THEN NULL WHEN line = 2 THEN 0.0::double WHEN line = 3 THEN -area ELSE area END"


@query("area_repair", sql=f"SELECT annotation_id, CASE WHEN coalesce(raw, bbox_w * bbox_h) <= 0 THEN bbox_w * bbox_h ELSE coalesce(raw, bbox_w * bbox_h) END AS repaired FROM (SELECT *, {FAULTY} AS raw FROM ann)")
def _(t):
    raw = F.when(F.col("line") == 1, None).when(F.col("line") == 2, 0.0).when(F.col("line") == 3, -F.col("area")).otherwise(F.col("area"))
    return t.ann.withColumn("raw", raw).select("annotation_id", audit.repaired_area(F.col("raw"), F.col("bbox_w"), F.col("bbox_h")).alias("repaired"))


@query("bbox_ratios", sql="SELECT annotation_id, bbox_w / image_width AS w_ratio, bbox_h / image_height AS h_ratio, bbox_w * bbox_h / (image_width * image_height) AS area_ratio FROM ann")
def _(t):
    w, h = bx.cols("bbox_w", "bbox_h")
    return t.ann.select("annotation_id", (w / _size()[0]).alias("w_ratio"), (h / _size()[1]).alias("h_ratio"), (w * h / (_size()[0] * _size()[1])).alias("area_ratio"))


@query("aspect_bins", sql="SELECT b.bin, count(a.bin) AS n FROM (VALUES (0), (1), (2), (3), (4)) b(bin) LEFT JOIN (SELECT CASE WHEN r <= 0.5 THEN 0 WHEN r <= 0.8 THEN 1 WHEN r <= 1.2 THEN 2 WHEN r <= 2.0 THEN 3 ELSE 4 END AS bin FROM (SELECT bbox_w / bbox_h AS r FROM ann) WHERE r > 0) a ON a.bin = b.bin GROUP BY b.bin")
def _(t):
    bins = t.spark.range(5).select(F.col("id").cast("int").alias("bin"))
    counts = t.ann.groupBy(audit.aspect_bin(F.col("bbox_w"), F.col("bbox_h")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _nulls(empty: str) -> str:
    columns = ("print_front", "drug_shape", "camera_lo", "category_name")
    each = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL{empty.format(c=c)}) AS nulls FROM ann" for c in columns)
    return f"SELECT column_name, nulls, nulls * 100 / n AS rate FROM ({each}) WHERE nulls > 0"


@query("null_summary", sql=_nulls(""))
def _(t):
    return audit.null_summary(t.ann, ["print_front", "drug_shape", "camera_lo", "category_name"])


@query("null_and_empty_counts", sql=_nulls(" OR cast({c} AS varchar) = ''"))
def _(t):
    return audit.null_summary(t.ann, ["print_front", "drug_shape", "camera_lo", "category_name"], empty=True)


@query("rows_with_nulls", sql="SELECT annotation_id FROM ann WHERE print_front IS NULL OR drug_shape IS NULL OR color_class1 IS NULL OR drug_dir IS NULL")
def _(t):
    test = F.col("print_front").isNull()
    for c in ("drug_shape", "color_class1", "drug_dir"):
        test |= F.col(c).isNull()
    return t.ann.where(test).select("annotation_id")


_conflict = "SELECT '{k} to {v}' AS direction, cast({k} AS varchar) AS key, count(DISTINCT {v}) AS n FROM {t} WHERE {k} IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT {v}) <> 1"
DIRECTIONS = (("category_id", "category_name", "ann"), ("category_name", "category_id", "ann"))
IMAGE_DIRECTIONS = (("file_name", "image_id", "img"), ("image_id", "file_name", "img"), ("group_id", "image_id", "img"))


def _conflicts(rows, directions):
    out = None
    for k, v, _t in directions:
        one = audit.conflicts(rows, k, v).select(F.lit(f"{k} to {v}").alias("direction"), F.col(k).cast("string").alias("key"), "n")
        out = one if out is None else out.union(one)
    return out


@query("category_id_conflicts", sql=" UNION ALL ".join(_conflict.format(k=k, v=v, t=t) for k, v, t in DIRECTIONS))
def _(t):
    return _conflicts(t.ann, DIRECTIONS)


@query("image_id_conflicts", "img", " UNION ALL ".join(_conflict.format(k=k, v=v, t=t) for k, v, t in IMAGE_DIRECTIONS))
def _(t):
    return _conflicts(t.img, IMAGE_DIRECTIONS)


@query("orphan_image_ids", sql="SELECT doc, image_id, annotation_id FROM (SELECT image_id AS doc, CASE WHEN flag = 'A' AND line = 1 THEN -image_id ELSE image_id END AS image_id, annotation_id FROM ann) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT image_id AS doc, image_id FROM ann WHERE line > 0) i WHERE i.doc = a.doc AND i.image_id = a.image_id)")
def _(t):
    """Annotations whose image isn't among the images of their document (some ids are negated first)."""
    own = F.when((F.col("flag") == "A") & (F.col("line") == 1), -F.col("image_id")).otherwise(F.col("image_id"))
    marked = t.ann.select(F.col("image_id").alias("doc"), own.alias("image_id"), "annotation_id")
    return audit.orphans(marked, t.ann.select(F.col("image_id").alias("doc"), "image_id"), ["doc", "image_id"])


@query("orphan_category_ids", sql="SELECT DISTINCT category_id FROM ann WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = category_id AND p_size > 10)")
def _(t):
    known = t.read("part").where("p_size > 10").select(F.col("p_partkey").alias("category_id"))
    return t.ann.join(known, "category_id", "left_anti").select("category_id").distinct()


@query("image_annotation_diff", "ann img", "SELECT image_id, 'no annotation' AS side FROM img WHERE image_id NOT IN (SELECT image_id FROM ann WHERE flag = 'R') UNION ALL SELECT DISTINCT image_id, 'no image' AS side FROM ann WHERE flag = 'R' AND image_id NOT IN (SELECT image_id FROM img)")
def _(t):
    return audit.difference(t.img, t.ann.where("flag = 'R'"), "image_id", "no annotation", "no image")


MISSING = "SELECT DISTINCT image_id, category_id FROM ann a WHERE NOT EXISTS (SELECT 1 FROM ann b WHERE b.image_id = a.image_id AND b.category_id = a.category_id AND NOT (b.flag = 'R' AND b.line = 1))"


def _missing(t):
    have = t.ann.where("not (flag = 'R' and line = 1)").select("image_id", "category_id")
    return t.ann.select("image_id", "category_id").distinct().join(have, ["image_id", "category_id"], "left_anti")


QUERIES["missing_drugs"] = lambda spark, d: _missing(Tables(spark, d))
SQL["missing_drugs"] = with_views(MISSING, "ann")


@query("missing_images", sql=f"SELECT image_id, count(*) AS n FROM ({MISSING}) GROUP BY 1")
def _(t):
    return _missing(t).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("missing_summary", sql=f"SELECT category_id, count(*) AS n, array_to_string(list_sort(list(image_id)), ',') AS images FROM ({MISSING}) GROUP BY 1")
def _(t):
    return _missing(t).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("image_id")), ",").alias("images"))


@query("duplicate_rows", sql="SELECT image_id, category_id, camera_la, copies, copies - 1 AS extra FROM (SELECT image_id, category_id, camera_la, count(*) AS copies FROM (SELECT image_id // 4 AS image_id, category_id % 50 AS category_id, camera_la, camera_lo FROM ann) GROUP BY image_id, category_id, camera_la, camera_lo) WHERE copies > 1")
def _(t):
    """Rows that are equal in every column, nulls among them, and how many a first one leaves over."""
    rows = t.ann.select(F.floor(F.col("image_id") / 4).alias("image_id"), (F.col("category_id") % 50).alias("category_id"), "camera_la", "camera_lo")
    each = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return each.select("image_id", "category_id", "camera_la", "copies", (F.col("copies") - 1).alias("extra"))


@query("duplicate_annotation_ids", sql="SELECT annotation_id, raw_id, copies FROM (SELECT annotation_id, raw_id, count(*) OVER (PARTITION BY raw_id) AS copies FROM (SELECT annotation_id, image_id * 10 + obj_idx % 4 AS raw_id FROM ann)) WHERE copies > 1")
def _(t):
    raw = t.ann.withColumn("raw_id", F.col("image_id") * 10 + F.col("obj_idx") % 4)
    return audit.duplicates(raw, ["raw_id"]).select("annotation_id", "raw_id", "copies")


# ---------------------------------------------------------------- aggregates


@query("image_annotation_map", sql="SELECT image_id, count(*) AS n, array_to_string(list(category_id ORDER BY obj_idx), ',') AS categories, min(image_width) AS width FROM ann GROUP BY 1")
def _(t):
    rows = F.sort_array(F.collect_list(F.struct("obj_idx", "category_id")))
    return t.ann.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda x: x["category_id"]), ",").alias("categories"), F.min_by("image_width", "obj_idx").alias("width"))


@query("annotations_per_class", sql="SELECT category_id, category_name, count(*) AS n FROM ann GROUP BY 1, 2")
def _(t):
    return t.ann.groupBy("category_id", "category_name").agg(F.count(F.lit(1)).alias("n"))


@query("images_per_class", sql="SELECT category_id, count(DISTINCT image_id) AS n FROM ann GROUP BY 1")
def _(t):
    return t.ann.groupBy("category_id").agg(F.count_distinct("image_id").alias("n"))


@query("same_class_per_image", sql="SELECT image_id, category_id, count(*) AS n FROM ann GROUP BY 1, 2 ORDER BY n DESC, image_id, category_id LIMIT 10")
def _(t):
    return t.ann.groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "image_id", "category_id").limit(10)


@query("value_counts", sql="SELECT print_front, count(*) AS n FROM ann WHERE print_front IS NOT NULL GROUP BY 1")
def _(t):
    return audit.value_counts(t.ann, "print_front")


@query("objects_per_image_hist", sql="SELECT objects, count(*) AS n FROM (SELECT count(*) AS objects FROM ann GROUP BY image_id) GROUP BY 1")
def _(t):
    return t.ann.groupBy("image_id").agg(F.count(F.lit(1)).alias("objects")).groupBy("objects").agg(F.count(F.lit(1)).alias("n"))


@query("resolution_counts", "img", "SELECT width, height, count(*) AS n FROM img GROUP BY 1, 2")
def _(t):
    return t.img.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"))


@query("camera_counts", sql="SELECT camera_la, camera_lo, count(*) AS n FROM ann WHERE camera_la IS NOT NULL AND camera_lo IS NOT NULL GROUP BY 1, 2")
def _(t):
    return t.ann.where("camera_la is not null and camera_lo is not null").groupBy("camera_la", "camera_lo").agg(F.count(F.lit(1)).alias("n"))


_one = "SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3, max({c}) AS max FROM ann"


@query("describe_bbox", sql=" UNION ALL ".join(_one.format(c=c) for c in audit.XYWH))
def _(t):
    return audit.describe(t.ann, list(audit.XYWH))


@query("dataset_overview", sql="SELECT count(*) AS annotations, count(DISTINCT image_id) AS images, count(DISTINCT category_id) AS categories, count(DISTINCT print_front) AS prints FROM ann")
def _(t):
    return t.ann.agg(F.count(F.lit(1)).alias("annotations"), F.count_distinct("image_id").alias("images"), F.count_distinct("category_id").alias("categories"), F.count_distinct("print_front").alias("prints"))


@query("class_statistics", sql="SELECT p_partkey AS category_id, count(a.image_id) AS n FROM part LEFT JOIN (SELECT * FROM ann WHERE flag = 'R') a ON a.category_id = p_partkey GROUP BY 1")
def _(t):
    counts = t.ann.where("flag = 'R'").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    return t.read("part").select(F.col("p_partkey").alias("category_id")).join(counts, "category_id", "left").select("category_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("bbox_summary", sql="SELECT min(bbox_w) AS min_w, max(bbox_w) AS max_w, median(bbox_w) AS median_w, min(bbox_h) AS min_h, max(bbox_h) AS max_h, median(bbox_h) AS median_h, count(*) FILTER (WHERE bbox_w > bbox_h) AS wide FROM ann")
def _(t):
    both = [f(c).alias(f"{n}_{c[-1]}") for c in ("bbox_w", "bbox_h") for n, f in (("min", F.min), ("max", F.max), ("median", F.median))]
    return t.ann.agg(*both, F.count_if(F.col("bbox_w") > F.col("bbox_h")).alias("wide"))


@query("histogram", sql="SELECT least(floor((bbox_h - lo) / ((hi - lo) / 15)), 14)::bigint AS bin, count(*) AS n FROM ann, (SELECT min(bbox_h) AS lo, max(bbox_h) AS hi FROM ann) GROUP BY 1")
def _(t):
    return audit.histogram(t.ann, "bbox_h", 15)


@query("box_size_stats", sql="SELECT p_partkey AS category_id, coalesce(w, (SELECT median(bbox_w) FROM ann)) AS w, coalesce(h, (SELECT median(bbox_h) FROM ann)) AS h FROM part LEFT JOIN (SELECT category_id, median(bbox_w) AS w, median(bbox_h) AS h FROM ann WHERE flag = 'R' GROUP BY 1) a ON a.category_id = p_partkey")
def _(t):
    classes = t.read("part").select(F.col("p_partkey").alias("category_id"))
    return audit.class_sizes(t.ann.where("flag = 'R'"), classes, t.ann)


@query("class_weights", sql="SELECT p_partkey AS category_id, 1 / sqrt(greatest(count(a.image_id), 1)) AS weight FROM part LEFT JOIN (SELECT * FROM ann WHERE flag = 'R') a ON a.category_id = p_partkey GROUP BY 1")
def _(t):
    counts = t.ann.where("flag = 'R'").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = t.read("part").select(F.col("p_partkey").alias("category_id")).join(counts, "category_id", "left")
    return all_.select("category_id", (1 / F.sqrt(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))).alias("weight"))


# ---------------------------------------------------------------- order, labels, split


@query("smallest_boxes", sql="SELECT annotation_id, area FROM ann ORDER BY area, annotation_id LIMIT 5")
def _(t):
    return t.ann.orderBy("area", "annotation_id").limit(5).select("annotation_id", "area")


@query("largest_boxes", sql="SELECT annotation_id, area FROM ann ORDER BY area DESC, annotation_id LIMIT 5")
def _(t):
    return t.ann.orderBy(F.desc("area"), "annotation_id").limit(5).select("annotation_id", "area")


@query("first_n_per_class", sql="SELECT category_id, annotation_id, rank FROM (SELECT category_id, annotation_id, row_number() OVER (PARTITION BY category_id ORDER BY annotation_id) AS rank FROM ann) WHERE rank <= 3")
def _(t):
    return audit.first_per_key(t.ann, "category_id", ["annotation_id"], 3).select("category_id", "annotation_id", "rank")


@query("seeded_sample", "img", "SELECT image_id FROM img ORDER BY md5(concat(cast(image_id AS varchar), ':42')), image_id LIMIT 20")
def _(t):
    return t.img.orderBy(F.md5(F.concat(F.col("image_id").cast("string"), F.lit(":42"))), "image_id").limit(20).select("image_id")


@query("numeric_order", "img", "SELECT file_name, row_number() OVER (ORDER BY image_id) AS place FROM img")
def _(t):
    rows = t.img.select("file_name", F.regexp_extract("file_name", r"^(\d+)\.", 1).cast("long").alias("stem"))
    return samples.positions(rows, "stem").select("file_name", (F.col("position") + 1).alias("place"))


@query("paging", "img", "SELECT image_id, (row_number() OVER (ORDER BY image_id) - 1) // 10 AS page FROM img")
def _(t):
    return samples.positions(t.img.select("image_id"), "image_id").select("image_id", F.floor(F.col("position") / 10).alias("page"))


@query("label_mapping", sql="SELECT category_id, row_number() OVER (ORDER BY category_id) - 1 AS label FROM (SELECT DISTINCT category_id FROM ann)")
def _(t):
    return audit.label_mapping(t.ann)


@query("label_lookup", sql="SELECT annotation_id, label FROM ann JOIN (SELECT category_id, row_number() OVER (ORDER BY category_id) - 1 AS label FROM (SELECT DISTINCT category_id FROM ann)) USING (category_id)")
def _(t):
    return t.ann.join(audit.label_mapping(t.ann), "category_id").select("annotation_id", "label")


#: Characters of a code in the columns that a query's SQL fills to six places: its lpad also cuts longer codes to them.
CODE_PLACES = 6
SPLIT = "SELECT key, CASE WHEN r > ceil(n * 2 / 10.0) THEN 'train' WHEN r > ceil(ceil(n * 2 / 10.0) / 2) THEN 'val' ELSE 'test' END AS split FROM (SELECT key, row_number() OVER (ORDER BY md5(concat(key, ':7')), key) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT cast(group_id AS varchar) AS key FROM img))"


@query("group_split", "img", SPLIT)
def _(t):
    return audit.group_split(t.img, "group_id", 7)


_OWN = "SELECT image_id, group_id, CASE md5(concat(cast(image_id AS varchar), ':7'))[1:1] WHEN '0' THEN 'val' WHEN '1' THEN 'test' WHEN '2' THEN NULL ELSE 'train' END AS split FROM img"


@query("split_leak_check", "img", f"SELECT 'by image' AS rule, (SELECT count(*) FROM img) AS images, (SELECT count(*) FROM ({_OWN}) WHERE split IS NULL) AS missing, 0::bigint AS repeated, (SELECT count(*) FROM (SELECT group_id FROM ({_OWN}) GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaks UNION ALL SELECT 'by group', count(*), 0, 0, (SELECT count(*) FROM (SELECT key FROM ({SPLIT}) GROUP BY 1 HAVING count(DISTINCT split) > 1)) FROM img JOIN ({SPLIT}) s ON s.key = cast(group_id AS varchar)")
def _(t):
    """A split of single images leaks, one of groups doesn't."""
    first = F.substring(F.md5(F.concat(F.col("image_id").cast("string"), F.lit(":7"))), 1, 1)
    alone = t.img.select("image_id", F.when(first == "0", "val").when(first == "1", "test").when(first != "2", "train").alias("split"))
    groups = t.img.withColumn("key", F.col("group_id").cast("string")).join(audit.group_split(t.img, "group_id", 7), "key").select("image_id", "split")
    rows = [splits.validate(t.img, a, "group_id").withColumn("rule", F.lit(n)) for n, a in (("by image", alone), ("by group", groups))]
    return rows[0].union(rows[1]).select("rule", "images", "missing", "repeated", "leaks")


# ---------------------------------------------------------------- box algebra

YOLO = f"(x1 + x2) / 2 / image_width AS cx, (y1 + y2) / 2 / image_height AS cy, (x2 - x1) / image_width AS w, (y2 - y1) / image_height AS h FROM {CLIP}"


@query("yolo_boxes", sql=f"SELECT annotation_id, {YOLO} WHERE x2 > x1 AND y2 > y1")
def _(t):
    form = bx.yolo(_boxes(t.ann), *_size())
    return t.ann.select("annotation_id", *[v.alias(k) for k, v in form.items()]).where("cx is not null")


@query("yolo_roundtrip", sql=f"SELECT annotation_id, round((cx - w / 2) * image_width, 6) AS x1, round((cy - h / 2) * image_height, 6) AS y1, round((cx + w / 2) * image_width, 6) AS x2, round((cy + h / 2) * image_height, 6) AS y2 FROM (SELECT annotation_id, image_width, image_height, {YOLO} WHERE x2 > x1 AND y2 > y1)")
def _(t):
    a = t.ann.withColumns(bx.yolo(_boxes(t.ann), *_size())).where("cx is not null")
    box = bx.from_yolo(*bx.cols("cx", "cy", "w", "h"), *_size())
    return a.select("annotation_id", *[F.round(c, 6).alias(n) for n, c in zip(XYXY, box)])


@query("clip_boxes", sql=f"SELECT annotation_id, x1, y1, x2, y2 FROM {CLIP} WHERE x2 - x1 >= 4 AND y2 - y1 >= 4 AND (x2 - x1) * (y2 - y1) >= 0.2 * bbox_w * bbox_h")
def _(t):
    box = bx.clip(_boxes(t.ann), *_size())
    a = t.ann.withColumns(dict(zip(XYXY, box)))
    side = (F.col("x2") - F.col("x1") >= 4) & (F.col("y2") - F.col("y1") >= 4)
    return a.where(side & (bx.area(bx.cols(*XYXY)) >= F.lit(0.2) * F.col("bbox_w") * F.col("bbox_h"))).select("annotation_id", *XYXY)


@query("flip_boxes", sql="SELECT annotation_id, image_width - bbox_x - bbox_w AS x1, bbox_y AS y1, image_width - bbox_x AS x2, bbox_y + bbox_h AS y2, image_height - bbox_y - bbox_h AS v1, image_height - bbox_y AS v2 FROM ann")
def _(t):
    across, down = bx.flip(_boxes(t.ann), _size()[0]), bx.flip(_boxes(t.ann), _size()[1], vertical=True)
    return t.ann.select("annotation_id", *[c.alias(n) for n, c in zip(XYXY, across)], down[1].alias("v1"), down[3].alias("v2"))


@query("letterbox_boxes", sql="SELECT annotation_id, bbox_x * s + dx AS x1, bbox_y * s AS y1, (bbox_x + bbox_w) * s + dx AS x2, (bbox_y + bbox_h) * s AS y2 FROM (SELECT *, 640.0::double / 1280 AS s, (640.0::double - image_width * (640.0::double / 1280)) / 2 AS dx FROM ann)")
def _(t):
    return t.ann.select("annotation_id", *[c.alias(n) for n, c in zip(XYXY, bx.letterbox(_boxes(t.ann), *_size(), 640.0))])


_turn = "SELECT annotation_id, round(image_width / 2 + c * dx + s * dy - wide, 6) AS x1, round(image_height / 2 + c * dy - s * dx - high, 6) AS y1, round(image_width / 2 + c * dx + s * dy + wide, 6) AS x2, round(image_height / 2 + c * dy - s * dx + high, 6) AS y2 FROM (SELECT *, sqrt(a * a * c * c + b * b * s * s) AS wide, sqrt(a * a * s * s + b * b * c * c) AS high FROM (SELECT *, bbox_x + bbox_w / 2 - image_width / 2 AS dx, bbox_y + bbox_h / 2 - image_height / 2 AS dy, bbox_w / 2 AS a, bbox_h / 2 AS b, cos(radians(30)) AS c, sin(radians(30)) AS s FROM ann))"


@query("rotate_boxes", sql=_turn)
def _(t):
    return t.ann.select("annotation_id", *[F.round(c, 6).alias(n) for n, c in zip(XYXY, bx.rotated(_boxes(t.ann), *_size(), 30.0))])


@query("box_center_form", sql="SELECT annotation_id, bbox_x + bbox_w / 2 AS cx, bbox_y + bbox_h / 2 AS cy, bbox_w AS w, bbox_h AS h, bbox_x + bbox_w / 2 - bbox_w / 2 AS x, bbox_y + bbox_h / 2 - bbox_h / 2 AS y FROM ann")
def _(t):
    cx, cy, w, h = bx.centre(*bx.cols(*audit.XYWH))
    x, y, _w, _h = bx.from_centre(cx, cy, w, h)
    return t.ann.select("annotation_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), x.alias("x"), y.alias("y"))


@query("overlapping_pairs", "gt", "SELECT a.image_id, a.obj_idx AS a, b.obj_idx AS b FROM gt a JOIN gt b ON a.image_id = b.image_id AND a.obj_idx < b.obj_idx WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)")
def _(t):
    b = t.gt.select("image_id", F.col("obj_idx").alias("b"), *[F.col(c).alias(f"b_{c}") for c in XYXY])
    both = t.gt.withColumnRenamed("obj_idx", "a").join(b, "image_id").where("a < b")
    return both.where(bx.intersects(bx.cols(*XYXY), bx.cols(*[f"b_{c}" for c in XYXY]))).select("image_id", "a", "b")


# ---------------------------------------------------------------- detection

IOU = "SELECT p.*, g.obj_idx AS gt_idx, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS both_, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga FROM pred p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id"
BEST = f"SELECT model, image_id, det_idx, class_id, gt_idx, iou FROM (SELECT *, row_number() OVER (PARTITION BY model, image_id, det_idx, class_id ORDER BY iou DESC, gt_idx) AS r FROM (SELECT *, both_ / greatest(pa + ga - both_, 1e-9::double) AS iou FROM ({IOU}))) WHERE r = 1"
THRESHOLDS = "(SELECT unnest(range(10)) AS thr)"
FLAGS = f"SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY model, image_id, class_id, thr, gt_idx, ok ORDER BY score DESC, det_idx) = 1 THEN 1 ELSE 0 END AS tp FROM (SELECT p.model, p.image_id, p.det_idx, p.class_id, p.score, b.gt_idx, thr, coalesce(b.iou >= (50 + 5 * thr) / 100, false) AS ok FROM pred p CROSS JOIN {THRESHOLDS} LEFT JOIN ({BEST}) b ON p.model = b.model AND p.image_id = b.image_id AND p.det_idx = b.det_idx AND p.class_id = b.class_id)"


@query("iou_best_match", "pred", f"SELECT model, image_id, det_idx, gt_idx, round(iou, 6) AS iou FROM ({BEST})")
def _(t):
    out = detect.best_matches(t.pred, t.gt)
    return out.select("model", "image_id", "det_idx", "gt_idx", F.round("iou", 6).alias("iou"))


@query("tp_flags", "pred", f"SELECT model, class_id, thr, sum(tp)::bigint AS tp, count(*) AS n FROM ({FLAGS}) GROUP BY 1, 2, 3")
def _(t):
    return detect.tp_flags(t.pred, t.gt).groupBy("model", "class_id", "thr").agg(F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n"))


@query("precision_recall_50", "pred", f"SELECT f.model, sum(tp)::bigint AS tp, count(*) - sum(tp)::bigint AS fp, round(sum(tp) / greatest(count(*), 1), 6) AS precision, round(sum(tp) / greatest((SELECT count(*) FROM gt), 1), 6) AS recall FROM ({FLAGS}) f JOIN (SELECT DISTINCT class_id FROM gt) USING (class_id) WHERE thr = 0 GROUP BY 1")
def _(t):
    return detect.precision_recall(t.pred, t.gt)


CURVE = f"SELECT *, ctp / n_gt AS recall, ctp / rank AS precision FROM (SELECT *, sum(tp) OVER w AS ctp, row_number() OVER w AS rank FROM ({FLAGS}) JOIN (SELECT class_id, count(*) AS n_gt FROM gt GROUP BY 1) USING (class_id) WINDOW w AS (PARTITION BY model, class_id, thr ORDER BY score DESC, tp DESC, image_id, det_idx ROWS UNBOUNDED PRECEDING))"


@query("pr_curve", "pred", f"SELECT model, class_id, thr, max(rank) AS points, round(max(recall), 6) AS recall, round(sum(recall), 4) AS recalls, round(sum(precision), 4) AS precisions FROM ({CURVE}) GROUP BY 1, 2, 3")
def _(t):
    own = detect.pr_curve(t.pred, t.gt).groupBy("model", "class_id", "thr")
    return own.agg(F.max("rank").alias("points"), F.round(F.max("recall"), 6).alias("recall"), F.round(F.sum("recall"), 4).alias("recalls"), F.round(F.sum("precision"), 4).alias("precisions"))


SIDES = "least(greatest(p.x1, 0), 976) AS x1, least(greatest(p.y1, 0), 1280) AS y1, least(greatest(p.x2, 0), 976) AS x2, least(greatest(p.y2, 0), 1280) AS y2"
SHARES = f"SELECT model, image_id, det_idx, class_id, score, x1 / 976 AS x1, y1 / 1280 AS y1, x2 / 976 AS x2, y2 / 1280 AS y2 FROM (SELECT model, image_id, det_idx, class_id, score, {SIDES} FROM pred p) WHERE x2 > x1 AND y2 > y1"
_over = "(least(c.x2, n.x2) - greatest(c.x1, n.x1)) * (least(c.y2, n.y2) - greatest(c.y1, n.y1))"
_cluster = "struct_pack(x1 := (c.s1 + n.x1 * n.score) / (c.ss + n.score), y1 := (c.s2 + n.y1 * n.score) / (c.ss + n.score), x2 := (c.s3 + n.x2 * n.score) / (c.ss + n.score), y2 := (c.s4 + n.y2 * n.score) / (c.ss + n.score), s1 := c.s1 + n.x1 * n.score, s2 := c.s2 + n.y1 * n.score, s3 := c.s3 + n.x2 * n.score, s4 := c.s4 + n.y2 * n.score, ss := c.ss + n.score, k := c.k + 1)"
_fresh = "struct_pack(x1 := n.x1, y1 := n.y1, x2 := n.x2, y2 := n.y2, s1 := n.x1 * n.score, s2 := n.y1 * n.score, s3 := n.x2 * n.score, s4 := n.y2 * n.score, ss := n.score, k := 1)"
#: Recursive views that follow the base views: clusters grow by one box a round.
FUSED = f"""shares AS MATERIALIZED ({SHARES}),
boxes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, model, det_idx) AS rn FROM shares WHERE score >= 0.05),
grown AS (
  SELECT image_id, class_id, 1::bigint AS rn, [{_fresh}] AS cs FROM boxes n WHERE rn = 1
  UNION ALL
  SELECT image_id, class_id, rn, CASE WHEN coalesce(list_max(ious), 0) <= 0.55 THEN list_append(cs, {_fresh}) ELSE list_transform(cs, lambda c, i: CASE WHEN i = list_position(ious, list_max(ious)) THEN {_cluster} ELSE c END) END
  FROM (SELECT g.image_id, g.class_id, n.rn, g.cs, n, list_transform(g.cs, lambda c: CASE WHEN least(c.x2, n.x2) <= greatest(c.x1, n.x1) OR least(c.y2, n.y2) <= greatest(c.y1, n.y1) THEN 0 ELSE {_over} / ((c.x2 - c.x1) * (c.y2 - c.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - {_over}) END) AS ious
    FROM grown g JOIN (SELECT image_id, class_id, rn, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, score := score) AS n FROM boxes) n ON n.image_id = g.image_id AND n.class_id = g.class_id AND n.rn = g.rn + 1)
),
fused AS (SELECT image_id, class_id, c.x1 * 976 AS x1, c.y1 * 1280 AS y1, c.x2 * 976 AS x2, c.y2 * 1280 AS y2, c.ss / c.k * least(2, c.k) / 2 AS score
  FROM (SELECT image_id, class_id, unnest(arg_max(cs, rn)) AS c FROM grown GROUP BY 1, 2) WHERE c.ss / c.k * least(2, c.k) / 2 >= 0.05)"""
#: Places to keep: the mean of two scores may end in a 5, which four places would round either way.
PLACES = {"x1": 4, "y1": 4, "x2": 4, "y2": 4, "score": 6}
_rounded = ", ".join(f"round({c}, {n}) AS {c}" for c, n in PLACES.items())
_places = "row_number() OVER (PARTITION BY image_id ORDER BY score DESC, class_id, x1, y1, x2, y2)"


def _sizes(t):
    return t.img.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))


def _shares(t):
    return detect.normalized(t.pred.join(_sizes(t), "image_id")).drop("image_width", "image_height")


def _fused(t):
    return detect.restored(detect.fuse(_shares(t)), _sizes(t))


def _kept(t):
    """The four best fused boxes of an image: scores and places rounded first, so that ties are the same everywhere."""
    rows = _fused(t).select("image_id", "class_id", *[F.round(c, n).alias(c) for c, n in PLACES.items()])
    w = Window.partitionBy("image_id")
    order = w.orderBy(F.desc("score"), "class_id", *XYXY)
    return rows.withColumns({"rank": F.row_number().over(order).cast("long"), "before": F.count(F.lit(1)).over(w)}).where("rank <= 4")


def _recursive(sql: str) -> str:
    """SQL over the fused boxes."""
    return with_views("", "pred", "img").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f", {FUSED} {sql}"


def fused_query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        SQL[name] = _recursive(sql)
        return f

    return add


KEPT = f"SELECT * FROM (SELECT *, {_places} AS rank, count(*) OVER (PARTITION BY image_id) AS before FROM (SELECT image_id, class_id, {_rounded} FROM fused)) WHERE rank <= 4"


@query("pred_normalize", "pred", f"SELECT model, image_id, det_idx, class_id, {', '.join(f'round({c}, 9) AS {c}' for c in XYXY)} FROM ({SHARES})")
def _(t):
    return _shares(t).select("model", "image_id", "det_idx", "class_id", *[F.round(c, 9).alias(c) for c in XYXY])


@fused_query("wbf_fuse", f"SELECT image_id, class_id, {_rounded} FROM fused")
def _(t):
    return _fused(t).select("image_id", "class_id", *[F.round(c, n).alias(c) for c, n in PLACES.items()])


@fused_query("wbf_topk", f"SELECT image_id, class_id, rank, before, score FROM ({KEPT})")
def _(t):
    return _kept(t).select("image_id", "class_id", "rank", "before", "score")


@fused_query("detections_per_image", f"SELECT least(n, 4) AS kept, count(*) AS images, sum(greatest(n - 4, 0))::bigint AS lost, round(avg(n), 6) AS mean FROM (SELECT img.image_id, count(f.image_id) AS n FROM img LEFT JOIN fused f ON f.image_id = img.image_id GROUP BY 1) GROUP BY 1")
def _(t):
    """How many fused boxes images have, with the cut at four, and what it loses."""
    n = _fused(t).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = t.img.join(n, "image_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    lost = F.sum(F.greatest(F.col("n") - 4, F.lit(0))).alias("lost")
    return all_.groupBy(F.least("n", F.lit(4)).cast("long").alias("kept")).agg(F.count(F.lit(1)).alias("images"), lost, F.round(F.avg("n"), 6).alias("mean"))


_whole = "round_even(x1, 0)::bigint AS bbox_x, round_even(y1, 0)::bigint AS bbox_y, round_even(x2 - x1, 0)::bigint AS bbox_w, round_even(y2 - y1, 0)::bigint AS bbox_h"
CLASSES = "(SELECT category_id, row_number() OVER (ORDER BY category_id) - 1 AS class_id FROM (SELECT DISTINCT category_id % 1000 AS category_id FROM ann) LIMIT 50)"
SUBMITTED = f"SELECT row_number() OVER (ORDER BY image_id, det_idx) AS annotation_id, image_id, c.category_id, {_whole}, round_even(score, 4) AS score FROM (SELECT * FROM pred WHERE model = 's') p JOIN {CLASSES} c USING (class_id)"


def _submitted(t):
    own = t.pred.where("model = 's'")
    placed = samples.positions(own.withColumn("_key", F.col("image_id") * 100 + F.col("det_idx")), "_key")
    return labels.submission(placed, _classes(t), F.col("position") + 1)


def _classes(t):
    ids = t.ann.select((F.col("category_id") % 1000).alias("category_id"))
    return audit.label_mapping(ids).where("label < 50").select("category_id", F.col("label").alias("class_id"))


@query("submission", "pred", SUBMITTED)
def _(t):
    return _submitted(t)


@query("submission_checks", "pred", f"SELECT count(*) AS n, count(*) - count(DISTINCT annotation_id) AS repeated, 0::bigint AS nulls, count(*) FILTER (WHERE bbox_w <= 0 OR bbox_h <= 0) AS flat, count(*) FILTER (WHERE score < 0 OR score > 1) AS scores, count(*) FILTER (WHERE category_id NOT IN (SELECT category_id FROM {CLASSES} WHERE class_id < 40)) AS unknown, count(DISTINCT image_id) AS images, min(category_id) AS low, max(category_id) AS high, min(score) AS least, max(score) AS most, true AS columns_ok, (SELECT count(*) FROM orders) - count(DISTINCT image_id) AS absent FROM ({SUBMITTED})")
def _(t):
    """Every rule of a submission; ten classes are left out of the known ones."""
    return labels.submission_checks(_submitted(t), _classes(t).where("class_id < 40"), t.img.count())


#: The interpolated precision at recalls 0, 0.01 ... 1: between points in a line, trapezoids below it.
AP = f"""WITH curve AS ({CURVE}), env AS (SELECT *, max(precision) OVER (PARTITION BY model, class_id, thr ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM curve),
point AS (SELECT model, class_id, thr, recall, max(rank) AS last, arg_max(env, rank) AS low, arg_min(env, rank) AS high FROM env GROUP BY 1, 2, 3, 4),
ends AS (SELECT model, class_id, thr, 0.0::double AS recall, 0 AS last, 1.0::double AS low, 1.0::double AS high FROM (SELECT DISTINCT model, class_id, thr FROM point) UNION ALL SELECT * FROM point UNION ALL SELECT model, class_id, thr, 1.0, 1099511627776, 0.0, 0.0 FROM (SELECT DISTINCT model, class_id, thr FROM point)),
merged AS (SELECT model, class_id, thr, recall, arg_max(low, last) AS low, arg_min(high, last) AS high FROM ends GROUP BY 1, 2, 3, 4),
steps AS (SELECT *, lead(recall) OVER w AS next, lead(high) OVER w AS upto FROM merged WINDOW w AS (PARTITION BY model, class_id, thr ORDER BY recall)),
y AS (SELECT model, class_id, thr, g, CASE WHEN next IS NULL THEN low ELSE low + (upto - low) * (g / 100 - recall) / (next - recall) END AS y FROM steps JOIN (SELECT unnest(range(101)) AS g) ON g >= ceil(recall * 100 - 1e-9) AND (next IS NULL OR g < ceil(next * 100 - 1e-9))),
ap AS (SELECT model, class_id, thr, sum(y * CASE WHEN g IN (0, 100) THEN 0.005 ELSE 0.01 END) AS ap FROM y GROUP BY 1, 2, 3),
every AS (SELECT model, class_id, thr FROM (SELECT DISTINCT model FROM pred), (SELECT DISTINCT class_id FROM gt), {THRESHOLDS})
SELECT model, class_id, thr, coalesce(ap, 0.0) AS ap FROM every LEFT JOIN ap USING (model, class_id, thr)"""


@query("average_precision", "pred", f"SELECT model, class_id, thr, round(ap, 6) AS ap FROM ({AP})")
def _(t):
    return detect.average_precision(t.pred, t.gt).withColumn("ap", F.round("ap", 6))


@query("map_summary", "pred", f"SELECT model, round(avg(ap) FILTER (WHERE thr = 0), 6) AS map50, round(avg(ap), 6) AS map50_95, round(avg(ap) FILTER (WHERE thr >= 5), 6) AS map75_95 FROM ({AP}) GROUP BY 1")
def _(t):
    ap = detect.average_precision(t.pred, t.gt)
    return detect.map_summary(ap)


@query("class_ap_table", "pred", f"SELECT model, class_id, CASE WHEN class_id % 2 = 0 THEN concat('class ', class_id) ELSE cast(class_id AS varchar) END AS name, round(avg(ap) FILTER (WHERE thr = 0), 6) AS ap50, round(avg(ap), 6) AS ap50_95 FROM ({AP}) GROUP BY 1, 2")
def _(t):
    names = t.spark.range(0, 50, 2).select(F.col("id").alias("class_id"), F.concat(F.lit("class "), F.col("id").cast("string")).alias("name"))
    return detect.class_table(detect.average_precision(t.pred, t.gt), names)


_GREEDY = f"""ious AS MATERIALIZED (SELECT model, image_id, det_idx, class_id, gt_idx, both_ / (pa + ga - both_) AS iou FROM ({IOU}) WHERE both_ > 0),
cands AS (SELECT model, image_id, det_idx, class_id, list(struct_pack(iou := iou, gt := gt_idx) ORDER BY iou DESC, gt_idx) AS c FROM ious GROUP BY 1, 2, 3, 4),
asked AS MATERIALIZED (SELECT p.model, p.image_id, p.det_idx, p.class_id, coalesce(c, []) AS c, row_number() OVER (PARTITION BY p.model, p.image_id, p.class_id ORDER BY score DESC, p.det_idx) AS rn FROM pred p LEFT JOIN cands USING (model, image_id, det_idx, class_id)),
taken AS (
  SELECT DISTINCT model, image_id, class_id, 0::bigint AS rn, []::bigint[] AS used, NULL::bigint AS det_idx, NULL::bigint AS gt_idx, 0::double AS iou FROM asked
  UNION ALL
  SELECT model, image_id, class_id, rn, CASE WHEN b.iou >= 0.75 THEN list_append(used, b.gt) ELSE used END, det_idx, CASE WHEN b.iou >= 0.75 THEN b.gt END, coalesce(b.iou, 0)
  FROM (SELECT t.model, t.image_id, t.class_id, a.rn, t.used, a.det_idx, list_filter(a.c, lambda x: NOT list_contains(t.used, x.gt))[1] AS b FROM taken t JOIN asked a ON a.model = t.model AND a.image_id = t.image_id AND a.class_id = t.class_id AND a.rn = t.rn + 1)
)"""


def _exclusive(t):
    return detect.exclusive_matches(t.pred, t.gt).withColumn("iou", F.round("iou", 6))


QUERIES["exclusive_match"] = lambda spark, sf_dir: _exclusive(Tables(spark, sf_dir))
SQL["exclusive_match"] = (
    with_views("", "pred").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    + f", {_GREEDY} SELECT model, image_id, class_id, det_idx, gt_idx, round(iou, 6) AS iou, gt_idx IS NOT NULL AS correct FROM taken WHERE rn > 0"
)


@query("wbf_grid")
def _(t):
    """Mean average precision of fusion settings, best first: parameters of whole runs."""
    return detect.evaluate_fusion(t.pred, t.gt, [{"iou": i, "skip": s} for i in (0.5, 0.6) for s in (0.05, 0.3)])
