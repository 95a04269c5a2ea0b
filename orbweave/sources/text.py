"""Adjacency text, mined sets and edge tables: readers and writers. Several paths may be given to each reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).filter("line <> ''")


def _tokens(spark: SparkSession, paths) -> DataFrame:
    return _lines(spark, paths).select(F.split("line", " ").alias("t"))


def read_adjacency(spark: SparkSession, paths, has_degree: bool = True, sort: bool = False) -> DataFrame:
    """(id, nbrs) from lines 'id degree n1 n2 ...'; without has_degree, 'id n1 n2 ...'."""
    nbrs = F.expr(f"slice(t, {3 if has_degree else 2}, greatest(0, size(t) - {2 if has_degree else 1}))").cast("array<bigint>")
    return _tokens(spark, paths).select(F.col("t")[0].cast("long").alias("id"), (F.sort_array(nbrs) if sort else nbrs).alias("nbrs"))


def read_labelled(spark: SparkSession, paths, has_degree: bool = False) -> DataFrame:
    """(id, label, nbrs: array of (id, label)) from lines 'id label [degree] n1 l1 n2 l2 ...'."""
    # no lambda over the tokens: where lists are exploded Spark adds a filter by their size, which would split the line again for each entry
    tail = F.regexp_replace("line", r"^\S+( \S+){0,%d} ?" % (2 if has_degree else 1), "")
    pairs = [F.regexp_extract_all(tail, F.lit(r"(\S+) (\S+)"), F.lit(k)) for k in (1, 2)]
    nbrs = F.transform(F.arrays_zip(pairs[0].alias("id"), pairs[1].alias("label")), lambda n: F.struct(n["id"].cast("long").alias("id"), n["label"].alias("label")))
    head = F.split("line", " ", 3)
    return _lines(spark, paths).select(head[0].cast("long").alias("id"), head[1].alias("label"), nbrs.alias("nbrs"))


def read_sets(spark: SparkSession, paths, has_size: bool = True) -> DataFrame:
    """(size, vset) from lines 'size v1 v2 ...', or 'v1 v2 ...'."""
    vset = F.sort_array(F.expr(f"slice(t, {2 if has_size else 1}, greatest(0, size(t) - {int(has_size)}))").cast("array<bigint>"))
    return _tokens(spark, paths).select(vset.alias("vset")).select(F.size("vset").alias("size"), "vset")


def edges_of(adjacency: DataFrame) -> DataFrame:
    """(src, dst) for each entry of the lists; entries may be ids or (id, label)."""
    ids = "nbrs.id" if "struct" in adjacency.schema["nbrs"].dataType.simpleString() else "nbrs"
    return adjacency.select(F.col("id").alias("src"), F.explode(ids).alias("dst"))


def write_adjacency(adjacency: DataFrame, path: str) -> None:
    """Lines 'id degree<tab>n1 n2 ...'."""
    adjacency.select(F.concat(F.col("id"), F.lit(" "), F.size("nbrs"), F.lit("\t"), F.array_join(F.col("nbrs").cast("array<string>"), " "))).write.mode("overwrite").text(path)


def write_labelled(adjacency: DataFrame, path: str, has_degree: bool = False) -> None:
    """Lines 'id label<tab>[degree ]n1 l1 n2 l2 ...' from (id, label, nbrs: array of (id, label))."""
    parts = F.transform("nbrs", lambda n: F.concat(n["id"].cast("string"), F.lit(" "), n["label"]))
    degree = F.concat(F.size("nbrs"), F.lit(" ")) if has_degree else F.lit("")
    adjacency.select(F.concat(F.col("id"), F.lit(" "), "label", F.lit("\t"), degree, F.array_join(parts, " "))).write.mode("overwrite").text(path)


def write_sets(sets: DataFrame, path: str, with_size: bool = True) -> None:
    """Lines 'size v1 v2 ...', or without the size."""
    text = F.array_join(F.col("vset").cast("array<string>"), " ")
    sets.select(F.concat(F.size("vset"), F.lit(" "), text) if with_size else text).write.mode("overwrite").text(path)
