import pytest

from boxloom.plans import registry

from .compare import differs, tables

FOLDER = "/root/testdata/sf0.001"
SOME = ["invalid_bbox", "aspect_bins", "missing_drugs", "describe_bbox", "group_split", "yolo_boxes", "iou_best_match", "tp_flags", "submission", "coco_flatten", "expected_ids", "ts_resolve", "placeholder_category_fix", "average_precision", "exclusive_match", "wbf_fuse", "detections_per_image", "submission_checks", "name_match", "single_crop_box", "augment_report", "yolo_label_lines", "synthetic_payload_check", "ts_mapping", "orphan_image_ids"]


@pytest.fixture(scope="module")
def db():
    return tables(FOLDER)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, db, name):
    assert not differs(spark, db, name, registry.queries()[name], registry.oracle_sql()[name], FOLDER)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_difference_and_orphans(spark):
    from boxloom.operators import audit

    left = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    right = spark.createDataFrame([(2,), (3,), (3,), (None,)], "k long")
    got = sorted(((r.k or 0, r.side) for r in audit.difference(left, right, "k", "left", "right").collect()))
    assert got == [(0, "right"), (1, "left"), (3, "right")]
    assert [r.k for r in audit.orphans(left, right, ["k"]).collect()] == [1]


def test_numbered_over_spans(spark):
    from boxloom.operators import samples

    rows = spark.createDataFrame([(v,) for v in (5, 70_000, -3, 65_536, 10**12)], "v long")
    assert {r.v: r.position for r in samples.positions(rows, "v").collect()} == {-3: 0, 5: 1, 65_536: 2, 70_000: 3, 10**12: 4}


@pytest.fixture(scope="module")
def long_ids(tmp_path_factory):
    """Tables with part keys of six and seven digits, which differ in the seventh alone too."""
    import duckdb

    folder = tmp_path_factory.mktemp("long")
    for name, key in (("lineitem", "l_partkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
        more = "" if name == "orders" else f"replace ({key} + 999900 AS {key})"
        duckdb.sql(f"COPY (SELECT * {more} FROM '{FOLDER}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["expected_ids", "filename_json_mismatch", "normalize_codes", "pill_id", "placeholder_category_fix", "parse_image_name"])
def test_long_category_ids(spark, long_ids, name):
    assert not differs(spark, tables(long_ids), name, registry.queries()[name], registry.oracle_sql()[name], long_ids)
