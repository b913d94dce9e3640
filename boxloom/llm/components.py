"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp) for every id in links (a, b); comp is the smallest id reachable.

    Each round takes the smallest label of the neighbours, then the label of that label, so
    chains halve. Hot ids are no trouble: minima are combined before the shuffle, and labels
    never leave the executors.
    """
    both = scratch.keep(links.union(links.select("b", "a")).toDF("id", "to").distinct(), f"{name}-links")
    labels = scratch.keep(both.groupBy("id").agg(F.least("id", F.min("to")).alias("comp")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("comp").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        step = step.join(jump, "comp", "left").select("id", "old", F.least("comp", "far").alias("comp"))
        new = scratch.keep(step, f"{name}-{turn + 1}")
        changed = new.where("comp <> old").limit(1).count()
        scratch.drop(f"{name}-{turn}")
        labels, turn = new.select("id", "comp"), turn + 1
        if not changed:
            labels = scratch.keep(labels, name)
            scratch.drop(f"{name}-links", f"{name}-{turn}")
            return labels
