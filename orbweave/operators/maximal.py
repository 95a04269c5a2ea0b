"""Removal of sets that another set contains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maximal_sets(sets: DataFrame) -> DataFrame:
    """(size, vset) of the sets in column vset that no other contains; equal sets become one.

    A set meets its supersets at its rarest element only. All joins are by merging: where files of many repeats look small,
    Spark would broadcast tables of all sets through the driver."""
    s = sets.select(F.array_sort(F.array_distinct("vset")).alias("vset")).filter("size(vset) > 0").distinct()
    items = s.select("vset", F.explode("vset").alias("v"))
    rare = items.join(items.groupBy("v").count().hint("merge"), "v").groupBy("vset").agg(F.min_by("v", F.struct("count", "v")).alias("v"))
    larger = items.select("v", F.col("vset").alias("other"))
    inside = rare.join(larger.hint("merge"), "v").filter("size(other) > size(vset) AND size(array_except(vset, other)) = 0").select("vset").distinct()
    return s.join(inside.hint("merge"), "vset", "left_anti").select(F.size("vset").alias("size"), "vset")
