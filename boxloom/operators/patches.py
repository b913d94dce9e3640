"""A library of object patches cut from images, and images composed from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import pixels
from boxloom.operators import audit

PATCH = "class_id long, image_id long, obj_idx long, width int, height int, data binary"


def cut(images: DataFrame, objects: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` patches of each class, in the order of a seeded hash, cut from decoded images (image_id, width, height, data).

    The cap is the library's size, a parameter. Objects without a whole pixel inside the image have no patch.
    """
    order = F.xxhash64("image_id", "obj_idx", F.lit(seed))
    chosen = audit.first_per_key(objects, "class_id", [order, "image_id", "obj_idx"], most)
    boxes = chosen.groupBy("image_id").agg(F.collect_list(F.struct("class_id", "obj_idx", "x1", "y1", "x2", "y2")).alias("boxes"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.itertuples():
                img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[..., :3]
                for b in r.boxes:
                    x1, y1, x2, y2 = (max(0, round(b[c])) for c in ("x1", "y1", "x2", "y2"))
                    part = img[y1:y2, x1:x2]
                    if part.size:
                        rows.append((b["class_id"], r.image_id, b["obj_idx"], part.shape[1], part.shape[0], part.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PATCH.split(", ")])

    return images.join(boxes, "image_id").select("image_id", "width", "height", "data", "boxes").mapInPandas(run, PATCH)


def keep(patches: DataFrame, path: str) -> DataFrame:
    """Writes the library, so that it is cut once."""
    patches.write.mode("overwrite").parquet(path)
    return patches.sparkSession.read.parquet(path)


def compose(patches: DataFrame, drawn: DataFrame, each: int, width: int, height: int, seed: int, background: int = 200) -> DataFrame:
    """Composed images of ``each`` drawn classes (draw, category_id): (image_id, width, height, data, objects).

    Every draw takes a seeded one of its class's patches; draws of a class without a patch are lost.
    """
    own = patches.withColumn("pick", F.row_number().over(_by_class()) - 1)
    n = patches.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    asked = drawn.withColumnRenamed("category_id", "class_id").join(F.broadcast(n), "class_id")
    asked = asked.withColumn("pick", F.pmod(F.xxhash64("draw", F.lit(seed)), F.col("n")))
    found = asked.join(own.select("class_id", "pick", "width", "height", "data"), ["class_id", "pick"])
    groups = found.groupBy(F.floor(F.col("draw") / each).alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("draw", "class_id", "width", "height", "data"))).alias("parts"))
    schema = "image_id long, width int, height int, data binary, objects array<struct<class_id: bigint, x1: double, y1: double, x2: double, y2: double>>"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.itertuples():
                parts = [np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"], 3) for p in r.parts]
                canvas = np.full((height, width, 3), background, np.uint8)
                img, placed = pixels.pasted(canvas, parts, np.random.default_rng([seed, r.image_id]))
                boxes = [{"class_id": r.parts[k]["class_id"], "x1": float(a), "y1": float(b), "x2": float(c), "y2": float(d)} for k, a, b, c, d in placed]
                rows.append((r.image_id, width, height, img.tobytes(), boxes))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "data", "objects"])

    return groups.mapInPandas(run, schema)


def _by_class():
    from pyspark.sql import Window

    return Window.partitionBy("class_id").orderBy("image_id", "obj_idx")
