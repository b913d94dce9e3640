import json

from boxloom.sources import payloads


def write(folder, name, doc):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(doc))


def test_documents_from_files(spark, tmp_path):
    image = {"id": 7, "file_name": "a.png", "width": 976, "height": 1280}
    ann = {"id": 1, "image_id": 7, "category_id": 5, "bbox": [1, 2, 3, 4], "area": 12}
    write(tmp_path / "x", "a.json", {"images": [image], "annotations": [ann, ann | {"id": 2, "image_id": 8}], "categories": [{"id": 5, "name": "old"}, {"id": 5, "name": "new"}]})
    write(tmp_path / "y", "b.json", {"images": [], "annotations": [], "categories": []})
    write(tmp_path / "y", "c.json", {"images": [image], "annotations": [ann | {"bbox": [1, 2, 3]}, ann | {"id": 3, "category_id": 6}]})
    docs = payloads.read_documents(spark, str(tmp_path))
    flat = sorted((r.annotation_id, r.category_name, r.bbox_w, r.bbox_h) for r in payloads.flatten(docs).collect())
    assert flat == [(1, "Unknown", 3.0, None), (1, "new", 3.0, 4.0), (3, "Unknown", 3.0, 4.0)]
    found = sorted((r.json_path[-6:], r.problem) for r in payloads.problems(docs, "json_path").collect())
    assert found == [("a.json", "category repeated"), ("a.json", "image id differs"), ("b.json", "no annotation"), ("b.json", "no image"), ("c.json", "bad box")]


def test_names_and_ids(spark):
    from pyspark.sql import functions as F

    names = ["K-001900-016548-019607_0_2_0_2_70_000_200.png", "K-001900_0_2_0_2_x_0_0.png", "copy_paste_12.png", "K-1_0.png", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in df.select(*payloads.parse_image_name(F.col("name")).values()).collect()]
    assert got == [("combination", "001900-016548-019607", 70), ("single", "001900", None), ("copy_paste", None, None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame([("12", None), (None, "K-3"), (None, "K-ab"), (None, None)], "i string, c string")
    assert [r[0] for r in df.select(payloads.pill_id(F.col("i"), F.col("c"))).collect()] == ["000012", "000003", "ab", None]


def test_long_codes_stay_whole(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1234567", "K-1234567-000012_0_2.png")], "code string, name string")
    fixed = payloads.placeholder(F.lit(1), F.lit("Drug"), F.concat(F.lit("K-"), "code"), F.lit(" "))
    row = df.select(payloads.pill_id(F.col("code"), F.lit(None)).alias("pill"), payloads.name_ids(F.col("name")).alias("ids"), fixed[0].alias("id"), fixed[1].alias("title")).first()
    assert tuple(row) == ("1234567", [1234567, 12], 1234567, "K-1234567")
