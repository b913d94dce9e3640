from boxloom.operators import detect

BOX = "model string, image_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, score double, class_id long"


def test_fusion(spark):
    rows = [("s", 1, 0, 0.0, 0.0, 10.0, 10.0, 0.8, 3), ("m", 1, 0, 1.0, 0.0, 11.0, 10.0, 0.4, 3), ("s", 1, 1, 50.0, 50.0, 60.0, 60.0, 0.6, 3), ("s", 2, 0, 0.0, 0.0, 5.0, 5.0, 0.01, 3)]
    got = sorted(tuple(r) for r in detect.fuse(spark.createDataFrame(rows, BOX)).collect())
    x = (0.0 * 0.8 + 1.0 * 0.4) / 1.2
    assert [(g[0], g[2]) for g in got] == [(1, 0), (1, 1)]
    assert abs(got[0][3] - x) < 1e-9 and abs(got[0][7] - 0.6) < 1e-9 and abs(got[1][7] - 0.3) < 1e-9


def test_exclusive(spark):
    pred = [("s", 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 3), ("s", 1, 1, 0.0, 0.0, 10.0, 10.0, 0.8, 3), ("s", 1, 2, 90.0, 0.0, 99.0, 10.0, 0.7, 3)]
    gt = spark.createDataFrame([(1, 5, 3, 0.0, 0.0, 10.0, 10.0)], "image_id long, obj_idx long, class_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_idx: (r.gt_idx, r.correct) for r in detect.exclusive_matches(spark.createDataFrame(pred, BOX), gt).collect()}
    assert got == {0: (5, True), 1: (None, False), 2: (None, False)}


def test_average_precision(spark):
    gt = spark.createDataFrame([(1, 1, 3, 0.0, 0.0, 10.0, 10.0), (1, 2, 3, 50.0, 0.0, 60.0, 10.0), (1, 3, 8, 0.0, 0.0, 5.0, 5.0)], "image_id long, obj_idx long, class_id long, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame([("s", 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 3)], BOX)
    got = {r.class_id: r.ap for r in detect.average_precision(pred, gt, [0]).collect()}
    want = sum((0.005 if g in (0, 100) else 0.01) * (1.0 if g <= 50 else 2 - g / 50) for g in range(101))
    assert abs(got[3] - want) < 1e-9 and got[8] == 0.0
