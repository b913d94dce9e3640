"""Annotation, image, ground-truth and prediction views of the test tables.

One SQL text per view, valid in Spark and in DuckDB: integer arithmetic only, so that both
engines see the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

ANN = """
SELECT l.l_orderkey AS image_id, l.obj_idx, l.l_orderkey * 100 + l.obj_idx AS annotation_id,
  l.l_partkey AS category_id, p.p_name AS category_name,
  cast(976 AS double) AS image_width, cast(1280 AS double) AS image_height,
  cast((l.l_suppkey * 37 + l.l_linenumber * 211) % 1000 AS double) AS bbox_x,
  cast((l.l_partkey * 53) % 1200 AS double) AS bbox_y,
  l.l_quantity * 6 AS bbox_w,
  cast(40 + (l.l_partkey * 17 + l.l_suppkey) % 260 AS double) AS bbox_h,
  l.l_quantity * 6 * (40 + (l.l_partkey * 17 + l.l_suppkey) % 260)
    + CASE WHEN l.disc = 0 THEN 7 ELSE 0 END AS area,
  cast(CASE l.l_linenumber % 3 WHEN 0 THEN 70 WHEN 1 THEN 75 ELSE 90 END AS bigint) AS camera_la,
  CASE WHEN l.l_suppkey % 7 = 0 THEN NULL ELSE cast(l.l_suppkey % 3 AS bigint) END AS camera_lo,
  p.p_type AS drug_shape, p.p_brand AS color_class1,
  CASE l.l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN '' ELSE p.p_name END AS print_front,
  l.l_linestatus AS drug_dir, l.l_returnflag AS flag, cast(l.l_linenumber AS bigint) AS line,
  l.l_suppkey AS supp, l.disc, l.tax
FROM (
  SELECT *, cast(round(l_discount * 100) AS bigint) AS disc, cast(round(l_tax * 100) AS bigint) AS tax,
    cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_discount, l_tax, l_returnflag, l_linestatus) AS bigint) AS obj_idx
  FROM lineitem) l
LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""
IMG = """
SELECT o_orderkey AS image_id, cast(976 AS double) AS width, cast(1280 AS double) AS height,
  o_custkey AS group_id, concat(cast(o_orderkey AS varchar(20)), '.png') AS file_name FROM orders
"""
GT = """
SELECT image_id, obj_idx, category_id % 50 AS class_id, x1, y1, x2, y2, supp, category_id, disc, tax FROM (
  SELECT *, bbox_x AS x1, bbox_y AS y1, least(bbox_x + bbox_w, image_width) AS x2,
    least(bbox_y + bbox_h, image_height) AS y2 FROM ann) c
WHERE x2 > x1 AND y2 > y1
"""
PRED = """
SELECT m.model, image_id, obj_idx AS det_idx,
  x1 + m.d AS x1, y1 + m.d AS y1, x2 + m.d AS x2, y2 + m.d AS y2,
  ((image_id * 7919 + category_id * 104729) % 9973) / 10000 AS score,
  CASE WHEN disc = 10 THEN (class_id + 1) % 50 ELSE class_id END AS class_id
FROM (
  SELECT 's' AS model, *, cast(supp % 11 - 5 AS double) AS d FROM gt
  UNION ALL SELECT 'm' AS model, *, cast(category_id % 13 - 6 AS double) AS d FROM gt) m
WHERE tax <> 8
"""
#: Views in the order in which they build on each other.
VIEWS = {"ann": ANN, "img": IMG, "gt": GT, "pred": PRED}


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that defines the views a query needs."""
    need = {"ann": ["ann"], "img": ["img"], "gt": ["ann", "gt"], "pred": ["ann", "gt", "pred"]}
    used = [n for n in VIEWS if any(n in need[x] for x in names)]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + " " + sql


class Tables:
    """The tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _view(self, sql: str, **tables: DataFrame) -> DataFrame:
        for name in tables:
            sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
        return self.spark.sql(sql, **tables)

    @cached_property
    def ann(self) -> DataFrame:
        return self._view(ANN, lineitem=self.read("lineitem"), part=self.read("part"))

    @cached_property
    def img(self) -> DataFrame:
        return self._view(IMG, orders=self.read("orders"))

    @cached_property
    def gt(self) -> DataFrame:
        return self._view(GT, ann=self.ann)

    @cached_property
    def pred(self) -> DataFrame:
        return self._view(PRED, gt=self.gt)
