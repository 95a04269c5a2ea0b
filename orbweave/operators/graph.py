"""Graphs as DataFrames: simple undirected edges (u < v), mirrored edges (src, dst), adjacency (id, nbrs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.state import pieces


def normalised(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(u, v), u < v: each edge once; self-loops, nulls and repeats go."""
    return edges.select(F.least(src, dst).cast("long").alias("u"), F.greatest(src, dst).cast("long").alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree). Ends are dealt out before they are counted: a task then counts its own vertices, not nearly all of them."""
    return mirrored(edges).select("src").repartition(pieces(edges), "src").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    return mirrored(edges).repartition(pieces(edges), "src").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def labelled_adjacency(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, nbrs: array of (id, label))."""
    l = labels.select("id", "label")
    e = mirrored(edges).join(l.toDF("dst", "ld"), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("id"), F.col("ld").alias("label")))).alias("nbrs"))
    return e.join(l, "id").select("id", "label", "nbrs")


def trimmed(adj: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Neighbours for which keep(id, neighbour) holds; a column expression, so it runs before any shuffle."""
    return adj.withColumn("nbrs", F.filter("nbrs", lambda n: keep(F.col("id"), n)))


def by_degree(edges: DataFrame) -> DataFrame:
    """(a, b): each edge from its end of lesser (degree, id), so that out-degrees stay under the root of twice the edges."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    return e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    ids = vertices.select("id").distinct()
    return edges.join(ids, edges["u"] == ids["id"], "left_semi").join(ids, edges["v"] == ids["id"], "left_semi")


def two_hop(edges: DataFrame) -> DataFrame:
    """(id, other): all pairs within two steps, without the vertex itself."""
    s = mirrored(edges)
    far = s.alias("x").join(s.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("id"), F.col("y.dst").alias("other"))
    return s.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(far.filter("id <> other")).distinct()


def ego_edges(edges: DataFrame) -> DataFrame:
    """(root, u, v): edges among the neighbours of greater id of each root."""
    from orbweave.operators.triangles import triangles

    return triangles(edges).toDF("root", "u", "v")


def relabelled(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """(u, v) with the new ids of codes (id, newid)."""
    c = codes.select("id", "newid")
    e = edges.join(c.toDF("u", "nu"), "u").join(c.toDF("v", "nv"), "v")
    return e.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))


def recoded(edges: DataFrame) -> DataFrame:
    """(id, newid): the vertex of greatest degree is 0, its neighbours come last, all by (degree, id).

    Ranks are cut into degree groups first, so only counts of distinct degrees meet in one place."""
    from pyspark.sql import Window

    d = degrees(edges)
    hub = d.agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    near = mirrored(edges).join(F.broadcast(hub), F.col("src") == F.col("hub")).select(F.col("dst").alias("n"))
    rows = d.join(near, d["id"] == near["n"], "left").join(F.broadcast(hub)).select("id", "degree", F.when(F.col("id") == F.col("hub"), 0).when(F.col("n").isNull(), 1).otherwise(2).alias("part"))
    counts = rows.groupBy("part", "degree").count()
    first = counts.select("part", "degree", (F.coalesce(F.sum("count").over(Window.orderBy("part", "degree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first"))
    place = F.row_number().over(Window.partitionBy("part", "degree").orderBy("id")) - 1
    return rows.withColumn("place", place).join(first, ["part", "degree"]).select("id", (F.col("first") + F.col("place")).cast("long").alias("newid"))
