import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.functions import pixels
from boxloom.operators import augment, crops, samples, splits
from boxloom.sinks import labels
from boxloom.sources import folders

OBJECTS = "split string, stem string, image_id long, obj_idx long, class_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, image_width double, image_height double"


def images(root, n=6):
    """A data set of plain PNG images and label files."""
    rng = np.random.default_rng(3)
    for i in range(n):
        folder = f"{root}/images/train"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{i}.png", "wb") as f:
            f.write(pixels.png(rng.integers(0, 255, (40 + i, 60, 3), dtype=np.uint8)))


def test_export_round_trip(spark, tmp_path):
    root = f"{tmp_path}/set"
    rows = [("train", "0", 0, 1, 2, 10.0, 10.0, 20.0, 8.0, 60.0, 40.0), ("train", "0", 0, 0, 1, -5.0, 0.0, 10.0, 10.0, 60.0, 40.0), ("val", "9", 9, 0, 0, 70.0, 0.0, 5.0, 5.0, 60.0, 40.0)]
    objects = spark.createDataFrame(rows, OBJECTS)
    names = spark.createDataFrame([(1, "b"), (0, "a"), (2, "c")], "class_id long, name string")
    counts = {r.split: (r.images, r.boxes, r.skipped) for r in labels.export_split(objects, names, root).collect()}
    assert counts == {"train": (1, 2, 0), "val": (1, 0, 1)}
    assert open(f"{root}/labels/train/0.txt").read() == "1 0.041667 0.125000 0.083333 0.250000\n2 0.333333 0.350000 0.333333 0.200000"
    assert open(f"{root}/labels/val/9.txt").read() == ""
    assert folders.read_names(f"{root}/data.yaml") == {0: "a", 1: "b", 2: "c"}
    with pytest.raises(FileExistsError):
        labels.export_split(objects, names, root)
    images(root, 2)
    got = {r.stem: r for r in folders.split_records(spark, root, "train").collect()}
    assert [(b.label, round(b.x, 1), round(b.w, 1)) for b in got["0"].boxes] == [(1, 0.0, 5.0), (2, 10.0, 20.0)] and got["1"].boxes == []
    assert (got["1"].width, got["1"].height) == (60, 41)
    with pytest.raises(ValueError):
        labels.degenerate(objects, __import__("boxloom.functions.boxes", fromlist=["x"]).yolo(*_box()))


def _box():
    from boxloom.functions import boxes as bx

    return bx.corners(*bx.cols("bbox_x", "bbox_y", "bbox_w", "bbox_h")), *bx.cols("image_width", "image_height")


def test_image_folders(spark, tmp_path):
    images(tmp_path, 11)
    folder = f"{tmp_path}/images/train"
    assert [r.file_name for r in folders.list_images(spark, folder).collect()][:3] == ["0.png", "1.png", "10.png"]
    assert [r.image_id for r in folders.list_numbered(spark, folder).collect()] == list(range(11))
    sizes = {r.file_name: (r.width, r.height) for r in folders.image_sizes(spark, folder).collect()}
    assert sizes["10.png"] == (60, 50)
    stored = spark.createDataFrame([("0.png", 60.0, 40.0), ("1.png", 60.0, 40.0), ("x.png", 1.0, 1.0)], "file_name string, width double, height double")
    assert {r.file_name for r in folders.size_check(stored, folders.image_sizes(spark, folder)).collect()} == {"1.png", "x.png"}
    shown = folders.decoded(spark, folder)
    done = {r.file_name: r for r in pixels.applied(shown, pixels.training_recipe(), 5).collect()}
    again = {r.file_name: r for r in pixels.applied(shown.repartition(3), pixels.training_recipe(), 5).collect()}
    assert {k: (bytes(r.data), r.change) for k, r in done.items()} == {k: (bytes(r.data), r.change) for k, r in again.items()}
    with pytest.raises(FileNotFoundError):
        folders.require_paths(here=str(tmp_path), gone=f"{tmp_path}/none")
    assert folders.merge_settings({"a": 1, "b": 2}, {"b": 3, "c": 4}) == ({"a": 1, "b": 3}, ["c"])


def test_submission_file(spark, tmp_path):
    pred = spark.createDataFrame([(5, 0, 1.5, 2.5, 10.4, 20.6, 0.12344), (2, 1, 0.0, 0.0, 3.0, 3.0, 0.5), (2, 7, 0.0, 0.0, 3.0, 3.0, 0.5)], "image_id long, class_id long, x1 double, y1 double, x2 double, y2 double, score double")
    classes = spark.createDataFrame([(0, 100), (1, 200)], "class_id long, category_id long")
    rows = labels.submission(pred, classes, F.col("image_id"))
    labels.write_submission(rows, f"{tmp_path}/s")
    back = labels.read_submission(spark, f"{tmp_path}/s")
    got = {tuple(r) for r in back.collect()}
    assert got == {(5, 5, 100, 2, 2, 9, 18, 0.1234), (2, 2, 200, 0, 0, 3, 3, 0.5)}
    check = labels.submission_checks(back, classes, 3).first()
    assert (check.n, check.repeated, check.nulls, check.flat, check.scores, check.unknown, check.absent, check.columns_ok) == (2, 0, 0, 0, 0, 0, 1, True)
    bad = spark.createDataFrame([(1, 1, 9, 0, 0, 0, 1, 1.5), (1, 1, 100, 0, 0, 1, 1, None)], back.schema)
    check = labels.submission_checks(bad, classes).first()
    assert (check.repeated, check.nulls, check.flat, check.scores, check.unknown) == (1, 1, 1, 1, 1)
    assert [r.class_id for r in labels.unknown_classes(pred, classes).collect()] == [7]


def test_splits(spark):
    keys = [f"k{i:02}" for i in range(13)]
    for how in (splits.one_step, splits.two_step):
        got = how(keys, 42)
        assert set(got) == set(keys) and set(got.values()) == set(splits.PARTS) and got == how(keys, 42) != how(keys, 43)
    sizes = lambda parts: [list(parts.values()).count(p) for p in splits.PARTS]
    assert sizes(splits.two_step(keys, 1)) == [10, 1, 2] and sizes(splits.one_step(keys, 1)) == [10, 1, 2]
    assert sizes(splits.one_step(keys[:3], 1, 0.9, 0.1, 0.0)) == [3, 0, 0]  # rounded bounds come first
    assert sizes(splits.one_step(keys[:5], 1, 0.6, 0.4, 0.0)) == [3, 2, 0] and sizes(splits.one_step(keys[:4], 1, 0.5, 0.45, 0.05)) == [2, 1, 1]
    for bad in ((keys, 1, 0.5, 0.4, 0.3), (keys[:2], 1, 0.8, 0.1, 0.1)):
        with pytest.raises(ValueError):
            splits.one_step(*bad)
    rows = spark.createDataFrame([(i, keys[i % 13]) for i in range(40)], "image_id long, key string")
    table = rows.join(splits.as_table(spark, splits.one_step(splits.keys_of(rows, "key"), 3)), "key").select("image_id", "split")
    splits.require_valid(rows, table, "key")
    with pytest.raises(ValueError):
        splits.require_valid(rows, table.where("image_id > 3"), "key")


def test_names_and_codes(spark):
    names = ["3351_Ilyang Hightrin 2mg", "Plain (Tab.)", "77_x", "077_y"]
    classes = spark.createDataFrame(list(enumerate(names)), "class_id long, name string")
    asked = spark.createDataFrame([("3351",), ("ilyang_hightrin-2MG",), ("plain tab",), ("77",), ("0077_zzz",), ("none",), ("",)], "folder string")
    got = {r.folder: r.class_id for r in samples.match_names(asked, classes).collect()}
    assert got == {"3351": 0, "ilyang_hightrin-2MG": 0, "plain tab": 1, "77": 2, "0077_zzz": 2, "none": None, "": None}
    one = spark.range(1).select(samples.name_candidates(F.lit("3351_Ilyang 2mg")).alias("k")).first().k
    assert one == ["3351ilyang2mg", "ilyang2mg", "3351"]
    codes = spark.createDataFrame([("K-000",), (" K-0012 ",), ("",), (None,), ("12",)], "c string").select(samples.normal_code(F.col("c")).alias("n")).collect()
    assert [r.n for r in codes] == ["0", "12", None, None, "12"]
    with pytest.raises(ValueError):
        rows = spark.createDataFrame([("K-1", None, "7", "n", i, "n") for i in (5, 6)], "drug_N string, dl_mapping_code string, item_seq string, dl_name string, category_id long, category_name string")
        samples.require_no_conflicts(samples.category_map(rows))


def test_crops(spark):
    # three boxes of 0.16 x 0.12 of a 480 x 640 image, two of them close together
    boxes = [(1, k, x, y, x + 76.8, y + 76.8, 480.0, 640.0) for k, (x, y) in enumerate([(50.0, 50.0), (130.0, 50.0), (380.0, 550.0)])]
    boxes += [(2, 0, 0.0, 0.0, 480.0, 640.0, 480.0, 640.0), (3, 0, 10.0, 10.0, 60.0, 60.0, 480.0, 640.0), (3, 1, 40.0, 40.0, 90.0, 90.0, 480.0, 640.0)]
    objects = spark.createDataFrame(boxes, "image_id long, obj_idx long, x1 double, y1 double, x2 double, y2 double, image_width double, image_height double")
    got = {(r.image_id, r.obj_idx): r for r in crops.single_object_rows(objects).collect()}
    assert {k: r.kind for k, r in got.items()} == {(1, 0): "padded", (1, 1): "padded", (1, 2): "wide", (2, 0): "wide", (3, 0): "tight", (3, 1): "tight"}
    assert (got[1, 2].crop_x1, got[1, 2].crop_y2, got[1, 2].stem) == (361, 640, "1_obj002") and got[2, 0].cx == 0.5
    assert crops.not_one_line(crops.single_object_rows(objects)).count() == 0
    seeded = [sorted(crops.single_crops(objects, scale=(1.0, 1.4), offset=True, seed=s).collect()) for s in (1, 1, 2)]
    assert seeded[0] == seeded[1] != seeded[2]
    for r in seeded[0]:
        assert r.crop_x1 <= r.x1 + 0.5 and r.crop_x2 >= r.x2 - 0.5 and 0 <= r.crop_x1 and r.crop_y2 <= 640
    with pytest.raises(ValueError):
        crops.single_crops(objects, scale=(0.5, 2.0))


def test_augmented_counts(spark):
    """Six images of three boxes, two transformed copies each and five composed images: 6 * 3 + 5 rows of train images."""
    rows = [(i, k, 60.0 + 120 * k, 200.0, 136.0 + 120 * k, 277.0, 480.0, 640.0) for i in range(6) for k in range(3)]
    objects = spark.createDataFrame(rows, "image_id long, obj_idx long, x1 double, y1 double, x2 double, y2 double, image_width double, image_height double")
    composed = spark.createDataFrame([(100 + i, 0) for i in range(5)], "image_id long, obj_idx long")
    kinds = augment.kind_counts(augment.union_kinds(orig=objects, aug=augment.copies(objects, 2), cp=composed))
    got = {r.kind: r.images for r in kinds.collect()}
    assert got == {"orig": 6, "aug": 12, "cp": 5} and sum(got.values()) == 6 * 3 + 5
    assert json.loads(labels.run_report(kinds, seed=3))["kinds"]["cp"] == {"images": 5, "boxes": 5}
    assert "| orig | 6 | 18 |" in labels.markdown_report("Run", kinds, {"seed": 3})
    drawn = augment.weighted_draw(spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "category_id long, weight double"), 4000, 7).groupBy("category_id").count().collect()
    share = {r.category_id: r["count"] / 4000 for r in drawn}
    assert abs(share[2] - 0.75) < 0.04 and 3 not in share and abs(sum(share.values()) - 1) < 1e-9
    sizes = objects.select("image_id", "obj_idx", augment.jittered(F.lit(100.0), 3, "image_id", "obj_idx").alias("s")).collect()
    assert all(90 <= r.s <= 110 for r in sizes) and len({r.s for r in sizes}) == 18


def test_pixels():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (33, 47, 3), dtype=np.uint8)
    assert pixels.change(pixels.from_hsv(pixels.to_hsv(img)), img) < 0.02 and pixels.change(pixels.from_lab(pixels.to_lab(img)), img) < 0.1
    cast = (img * np.array([0.5, 1.0, 0.8])).astype(np.uint8)
    means = pixels.white_balance(cast).reshape(-1, 3).mean(0)
    assert means.max() - means.min() < 8 < cast.reshape(-1, 3).mean(0).max() - cast.reshape(-1, 3).mean(0).min()
    flat = np.full((64, 64, 3), 100, np.uint8)
    flat[20:40, 20:40] = 110
    assert np.ptp(pixels.equalized(flat)) > np.ptp(flat) and pixels.prepare(img, False, False) is img
    for step in (pixels.brightness_contrast(), pixels.gamma(), pixels.hsv_jitter(), pixels.tone_curve(), pixels.sensor_noise(), pixels.motion_blur(), pixels.shadows(), pixels.training_recipe()):
        out = step(img, np.random.default_rng(3))
        assert out.shape == img.shape and out.dtype == np.uint8 and (out == step(img, np.random.default_rng(3))).all()
    assert pixels.chance(0.0, pixels.gamma())(img, rng) is img
    back = pixels.denormalized((img.transpose(2, 0, 1) / 255 - 0.4) / 0.2, [0.4] * 3, [0.2] * 3)
    assert (back == img).all()


def test_build(spark, tmp_path):
    from boxloom.plans import builds

    images = spark.createDataFrame([(i, i // 2) for i in range(20)], "image_id long, group_id long")
    rows = [(i, k, 10 * (k + 1), 30.0 + 130 * k, 40.0, 60.0, 50.0, 480.0, 640.0) for i in range(20) for k in range(3)]
    objects = spark.createDataFrame(rows, "image_id long, obj_idx long, category_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, image_width double, image_height double")
    names = spark.createDataFrame([(10, "A"), (20, "B")], "category_id long, name string")
    got = {r.split: (r.images, r.boxes, r.skipped) for r in builds.build(images, objects, names, f"{tmp_path}/a").collect()}
    assert got == {"train": (16, 48, 0), "val": (2, 6, 0), "test": (2, 6, 0)}
    assert folders.read_names(f"{tmp_path}/a/data.yaml") == {0: "A", 1: "B", 2: "30"}
    got = {r.split: (r.images, r.boxes) for r in builds.build(images, objects, names, f"{tmp_path}/b", single_object=True, how="one_step").collect()}
    assert got["train"] == (48, 48) and got["val"] == (2, 6)
    got = {r.split: r.images for r in builds.build(images, objects, names, f"{tmp_path}/c", how="hash", n_aug=2).collect()}
    assert got["train"] == 48
    assigned = builds.split_images(images, "group_id", 1, "hash")
    assert all(r.unlabelled == 0 for r in builds.label_problems(objects, assigned).collect())


def test_patches(spark, tmp_path):
    from boxloom.operators import patches

    rng = np.random.default_rng(0)
    images = spark.createDataFrame([(i, 90, 80, rng.integers(0, 255, (80, 90, 3), dtype=np.uint8).tobytes()) for i in range(4)], "image_id long, width int, height int, data binary")
    objects = spark.createDataFrame([(i, k, k, 10.0 * k, 5.0, 10.0 * k + 12, 25.0) for i in range(4) for k in range(3)], "image_id long, obj_idx long, class_id long, x1 double, y1 double, x2 double, y2 double")
    library = patches.keep(patches.cut(images, objects, 2, 7), f"{tmp_path}/library")
    assert {r.class_id: r["count"] for r in library.groupBy("class_id").count().collect()} == {0: 2, 1: 2, 2: 2}
    drawn = augment.weighted_draw(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "category_id long, weight double"), 9, 5)
    out = patches.compose(library, drawn, 3, 200, 160, 5).collect()
    assert len(out) == 3 and sorted(r.image_id for r in out) == [0, 1, 2]
    for r in out:
        assert len(r.objects) == 3 and len(r.data) == 200 * 160 * 3
        for i, a in enumerate(r.objects):
            assert all(a.x1 >= b.x2 or b.x1 >= a.x2 or a.y1 >= b.y2 or b.y1 >= a.y2 for b in r.objects[:i])
    from boxloom.plans import builds

    both = builds.with_composed(objects.withColumns({"image_width": F.lit(90.0), "image_height": F.lit(80.0)}), patches.compose(library, drawn, 3, 200, 160, 5))
    assert {r.kind: (r.images, r.boxes) for r in augment.kind_counts(both).collect()} == {"orig": (4, 12), "cp": (3, 9)}
    again = patches.compose(library.repartition(3), drawn, 3, 200, 160, 5).collect()
    assert sorted(bytes(r.data) for r in out) == sorted(bytes(r.data) for r in again)


def test_shapes():
    img = np.zeros((40, 60, 3), np.uint8)
    img[10:20, 30:50] = 255
    assert (pixels.turned(img, 0.0) == img).all() and pixels.letterboxed(img, 30).shape == (30, 30, 3)
    y, x = np.nonzero(pixels.turned(img, 90.0, fill=0)[..., 0])
    assert (x.min(), x.max() + 1, y.min(), y.max() + 1) == (20, 30, 0, 20)  # where boxes.rotated puts the box
    assert (pixels.flipped(pixels.flipped(img)) == img).all() and pixels.flipped(img, True)[25, 40, 0] == 255


def test_crop_folders(spark, tmp_path):
    for folder in ("3351_Alpha", "nobody"):
        os.makedirs(f"{tmp_path}/{folder}")
        with open(f"{tmp_path}/{folder}/x.png", "wb") as f:
            f.write(pixels.png(np.zeros((4, 4, 3), np.uint8)))
    classes = spark.createDataFrame([(4, "alpha")], "class_id long, name string")
    got = {r.folder: r.class_id for r in folders.crop_folders(spark, str(tmp_path), classes).collect()}
    assert got == {"3351_Alpha": 4, "nobody": None}
