"""Detection matching, precision-recall curves, average precision and box fusion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx

XYXY = ("x1", "y1", "x2", "y2")


def _best(pred: DataFrame, gt: DataFrame, how: str) -> DataFrame:
    """Predictions with the overlap and number of their best ground truth.

    Boxes of one image and class meet in one shuffle, on which the aggregate and later windows
    over finer keys build; their number is what one photograph holds.
    """
    g = gt.select("image_id", "class_id", F.col("obj_idx").alias("gt_idx"), *[F.col(c).alias(f"g_{c}") for c in XYXY])
    both = pred.select("model", "image_id", "det_idx", "class_id", "score", *XYXY).join(g, ["image_id", "class_id"], how)
    both = both.withColumn("iou", bx.iou(bx.cols(*XYXY), bx.cols(*[f"g_{c}" for c in XYXY]), floor=1e-9))
    best = F.max(F.when(F.col("gt_idx").isNotNull(), F.struct("iou", (-F.col("gt_idx")).alias("order")))).alias("b")
    found = both.groupBy("model", "image_id", "det_idx", "class_id").agg(best, F.max("score").alias("score"))
    return found.select("model", "image_id", "det_idx", "class_id", "score", (-F.col("b.order")).alias("gt_idx"), F.col("b.iou").alias("iou"))


def best_matches(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """For every prediction the ground truth of its image and class with the highest overlap, the first at ties."""
    return _best(pred, gt, "inner").drop("score")


def tp_flags(pred: DataFrame, gt: DataFrame, thresholds=range(10)) -> DataFrame:
    """A row for each prediction and threshold (50 + 5 i) / 100: true where it is the best-scored of its ground truth.

    One window for all thresholds: a prediction counts from above the best overlap that a
    better-scored one has with the same ground truth up to its own.
    """
    order = Window.partitionBy("image_id", "class_id", "model", "gt_idx").orderBy(F.desc("score"), "det_idx")
    taken = F.coalesce(F.max("iou").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    best = _best(pred, gt, "left").withColumn("_taken", taken)
    each = best.withColumn("thr", F.explode(F.array(*[F.lit(i).cast("long") for i in thresholds])))
    least = (50 + 5 * F.col("thr")) / 100
    return each.withColumn("tp", F.coalesce((F.col("iou") >= least) & (F.col("_taken") < least), F.lit(False)).cast("long")).drop("_taken")


def pr_curve(pred: DataFrame, gt: DataFrame, thresholds=range(10)) -> DataFrame:
    """Cumulative recall and precision by descending score, true positives first at ties; classes with ground truth only."""
    n_gt = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt"))
    flags = tp_flags(pred, gt, thresholds).join(F.broadcast(n_gt), "class_id")
    order = Window.partitionBy("model", "class_id", "thr").orderBy(F.desc("score"), F.desc("tp"), "image_id", "det_idx")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = flags.withColumns({"ctp": F.sum("tp").over(run), "rank": F.row_number().over(order).cast("long")})
    return out.withColumns({"recall": F.col("ctp") / F.col("n_gt"), "precision": F.col("ctp") / F.col("rank")})


def precision_recall(pred: DataFrame, gt: DataFrame, thr: int = 0) -> DataFrame:
    """(model, tp, fp, precision, recall) at one threshold; predictions of classes without ground truth don't count."""
    classes = gt.select("class_id").distinct()
    flags = tp_flags(pred, gt, [thr]).join(classes, "class_id")
    n, tp = F.count(F.lit(1)), F.sum("tp")
    own = flags.groupBy("model").agg(tp.alias("tp"), (n - tp).alias("fp"), F.round(tp / F.greatest(n, F.lit(1)), 6).alias("precision"))
    return own.crossJoin(F.broadcast(gt.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_n")))).withColumn("recall", F.round(F.col("tp") / F.col("_n"), 6)).drop("_n")


def average_precision(pred: DataFrame, gt: DataFrame, thresholds=range(10)) -> DataFrame:
    """(model, class_id, thr, ap): 101-point interpolation of the precision envelope, trapezoids between points.

    A class with ground truth but without predictions has 0; one without ground truth has no row.
    """
    keys = ["model", "class_id", "thr"]
    curve = pr_curve(pred, gt, thresholds)
    after = Window.partitionBy(*keys).orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    env = curve.withColumn("env", F.max("precision").over(after))
    # several points of one recall: interpolation uses the last one before and the first one at a grid place
    point = env.groupBy(*keys, "recall").agg(F.max("rank").alias("last"), F.max_by("env", "rank").alias("low"), F.min_by("env", "rank").alias("high"))
    zero = point.select(*keys).distinct().select(*keys, F.lit(0.0).alias("recall"), F.lit(0).cast("long").alias("last"), F.lit(1.0).alias("low"), F.lit(1.0).alias("high"))
    end = zero.select(*keys, F.lit(1.0).alias("recall"), F.lit(1 << 40).alias("last"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    all_ = zero.union(point.select(*keys, "recall", "last", "low", "high")).union(end)
    all_ = all_.groupBy(*keys, "recall").agg(F.max_by("low", "last").alias("low"), F.min_by("high", "last").alias("high"))
    order = Window.partitionBy(*keys).orderBy("recall")
    step = all_.withColumns({"next": F.lead("recall").over(order), "to": F.lead("high").over(order)})
    grid = F.explode(F.sequence(F.ceil(F.col("recall") * 100 - 1e-9).cast("int"), F.when(F.col("next").isNull(), 100).otherwise(F.ceil(F.col("next") * 100 - 1e-9).cast("int") - 1)))
    some = step.where((F.col("next").isNull()) | (F.ceil(F.col("next") * 100 - 1e-9) > F.ceil(F.col("recall") * 100 - 1e-9)))
    at = some.withColumn("g", grid)
    y = F.when(F.col("next").isNull(), F.col("low")).otherwise(
        F.col("low") + (F.col("to") - F.col("low")) * (F.col("g") / 100 - F.col("recall")) / (F.col("next") - F.col("recall"))
    )
    weight = F.when(F.col("g").isin(0, 100), 0.005).otherwise(0.01)
    ap = at.groupBy(*keys).agg(F.sum(y * weight).alias("ap"))
    every = gt.select("class_id").distinct().crossJoin(F.broadcast(pred.select("model").distinct())).withColumn("thr", F.explode(F.array(*[F.lit(i).cast("long") for i in thresholds])))
    return every.join(ap, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def require_thresholds(ap: DataFrame, n: int = 10) -> None:
    """The AP table of a model has exactly n thresholds."""
    bad = ap.groupBy("model").agg(F.count_distinct("thr").alias("n")).where(F.col("n") != n).collect()
    if bad:
        raise ValueError(f"thresholds: {bad}")


def class_table(ap: DataFrame, names: DataFrame) -> DataFrame:
    """(model, class_id, name, ap50, ap50_95): the AP of each class with its name, else its id as text."""
    own = ap.groupBy("model", "class_id").agg(F.round(F.avg(F.when(F.col("thr") == 0, F.col("ap"))), 6).alias("ap50"), F.round(F.avg("ap"), 6).alias("ap50_95"))
    both = own.join(F.broadcast(names.select("class_id", "name")), "class_id", "left")
    return both.select("model", "class_id", F.coalesce("name", F.col("class_id").cast("string")).alias("name"), "ap50", "ap50_95")


def compare_models(*tables: DataFrame) -> DataFrame:
    """Metric tables of several runs below each other."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def evaluate_fusion(pred: DataFrame, gt: DataFrame, settings: list[dict]) -> DataFrame:
    """One row of mean average precision for each fusion setting (iou, skip, least), best first.

    Settings are few parameters of whole runs, so their plans are united.
    """
    rows = []
    for k, how in enumerate(settings):
        fused = fuse(pred, **how).withColumn("model", F.lit(f"fused{k}"))
        row = map_summary(average_precision(fused, gt))
        rows.append(row.withColumns({n: F.lit(float(how.get(n, d))) for n, d in (("iou", 0.55), ("skip", 0.05), ("least", 0.05))}))
    return compare_models(*rows).orderBy(F.desc("map50_95"), "model")


def map_summary(ap: DataFrame) -> DataFrame:
    """Mean average precision at 0.5, over 0.5-0.95 and over 0.75-0.95 of each model."""
    at = lambda test: F.round(F.avg(F.when(test, F.col("ap"))), 6)
    return ap.groupBy("model").agg(at(F.col("thr") == 0).alias("map50"), at(F.col("thr") >= 0).alias("map50_95"), at(F.col("thr") >= 5).alias("map75_95"))


def top_k(pred: DataFrame, k: int = 4) -> DataFrame:
    """The k best-scored boxes of each image, with the count before the cut."""
    w = Window.partitionBy("model", "image_id")
    out = pred.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "det_idx")).cast("long"), "before": F.count(F.lit(1)).over(w)})
    return out.where(F.col("rank") <= k)


def normalized(pred: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """Boxes as shares of the image, clipped to it; those without an area there go."""
    side = {"x1": width, "y1": height, "x2": width, "y2": height}
    share = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(w))) for c, w in side.items()}
    return pred.withColumns(share).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def restored(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shares back to pixels, with image sizes (image_id, image_width, image_height)."""
    both = boxes.join(sizes, "image_id")
    return both.withColumns({c: F.col(c) * F.col("image_width" if c[0] == "x" else "image_height") for c in XYXY}).drop("image_width", "image_height")


def _iou(a, b) -> float:
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    both = wide * high
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def _each_group(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f(key, rows) for every group, streamed over sorted partitions: no frame is built for a group."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held, key, out = [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if held and own != key:
                    out += f(key, held)
                    held = []
                key = own
                held.append(row)
            if out:
                yield _batch(out, names, schema)
                out = []
        if held and (out := f(key, held)):
            yield _batch(out, names, schema)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [_KINDS[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def fuse(pred: DataFrame, *, iou: float = 0.55, skip: float = 0.05, weights: dict[str, float] | None = None, least: float = 0.05) -> DataFrame:
    """Weighted box fusion of an image's boxes of one class over several models (arXiv 1910.13302)."""
    weights = weights or {"s": 1.0, "m": 1.0}

    def fused(key, rows):
        clusters: list[dict] = []
        for r in sorted(rows, key=lambda r: (-r["score"] * weights[r["model"]], r["model"], r["det_idx"])):
            box, score = tuple(r[c] for c in XYXY), r["score"] * weights[r["model"]]
            best, at = max(((_iou(c["box"], box), -i) for i, c in enumerate(clusters)), default=(0.0, 0))
            if best <= iou:
                clusters.append({"box": box, "sum": [v * score for v in box], "scores": [score]})
                continue
            c = clusters[-at]
            c["sum"] = [t + v * score for t, v in zip(c["sum"], box)]
            c["scores"].append(score)
            c["box"] = tuple(t / sum(c["scores"]) for t in c["sum"])
        out = []
        for c in clusters:
            n = len(c["scores"])
            score = sum(c["scores"]) / n * min(len(weights), n) / sum(weights.values())
            if score >= least:
                out.append((*c["box"], score))
        out.sort(key=lambda b: (-b[4], b))
        return [(*key, i, *b) for i, b in enumerate(out)]

    schema = "image_id long, class_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, score double"
    used = pred.where(F.col("score") >= skip).select("image_id", "class_id", "model", "det_idx", "score", *XYXY)
    return _each_group(used, ["image_id", "class_id"], fused, schema)


def exclusive_matches(pred: DataFrame, gt: DataFrame, least: float = 0.75) -> DataFrame:
    """Greedy one-to-one matching by score: each ground truth is used once; wrong ones report their best overlap."""

    def matched(key, rows):
        used, out = {}, []
        truth = sorted((r["idx"], tuple(r[c] for c in XYXY)) for r in rows if r["model"] is None)
        for p in sorted((r for r in rows if r["model"] is not None), key=lambda r: (r["model"], -r["score"], r["idx"])):
            mine = used.setdefault(p["model"], set())
            found = [(v, -i) for i, b in truth if i not in mine and (v := _iou(b, tuple(p[c] for c in XYXY))) > 0]
            best, at = max(found, default=(0.0, None))
            if best >= least:
                mine.add(-at)
            out.append((p["model"], *key, p["idx"], -at if best >= least else None, best, best >= least))
        return out

    columns = ["image_id", "class_id", "model", "idx", "score", *XYXY]
    left = pred.withColumnRenamed("det_idx", "idx").select(*columns)
    right = gt.withColumnsRenamed({"obj_idx": "idx"}).withColumns({"model": F.lit(None).cast("string"), "score": F.lit(0.0)})
    schema = "model string, image_id long, class_id long, det_idx long, gt_idx long, iou double, correct boolean"
    return _each_group(left.union(right.select(*columns)), ["image_id", "class_id"], matched, schema)
