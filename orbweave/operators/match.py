"""Labelled subgraph matching: a pattern compiles to equi-joins on vertex ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.graph import mirrored

#: The pattern of five vertices that the engine's fixed query asks for.
FIXED = ({"a": "a", "c": "c", "b1": "b", "b2": "b", "d": "d"}, [("a", "c"), ("a", "b1"), ("c", "b1"), ("c", "b2"), ("b2", "d")])


def labelled_edges(edges: DataFrame, labels: DataFrame, wanted: set[str]) -> DataFrame:
    """(src, dst, ls, ld): the mirrored edges with both labels; vertices of other labels than wanted are dropped before any join."""
    l = labels.filter(F.col("label").isin(*wanted)).select("id", "label")
    e = mirrored(edges)
    return e.join(l.withColumnsRenamed({"id": "src", "label": "ls"}), "src").join(l.withColumnsRenamed({"id": "dst", "label": "ld"}), "dst")


def match(edges: DataFrame, labels: DataFrame, pattern: tuple[dict[str, str], list[tuple[str, str]]] = FIXED) -> DataFrame:
    """One row for each match, a column for each pattern vertex. labels: (id, label). Vertices of equal label differ."""
    wanted, lines = pattern
    s = labelled_edges(edges, labels, set(wanted.values()))
    first = lines[0][0]  # the vertex that a match grows from needs a neighbour for each of its lines
    for label in {wanted[y if x == first else x] for x, y in lines if first in (x, y)}:
        roots = s.filter((F.col("ls") == wanted[first]) & (F.col("ld") == label)).select("src").distinct()
        s = s.join(roots.withColumn("ok", F.lit(True)), "src", "left").filter((F.col("ls") != wanted[first]) | F.col("ok")).drop("ok")
    out, bound = None, []
    for x, y in lines:
        step = s.filter((F.col("ls") == wanted[x]) & (F.col("ld") == wanted[y])).select(F.col("src").alias(x), F.col("dst").alias(y))
        if out is not None and not {x, y} & set(bound):
            raise ValueError("each edge of a pattern must touch one before it")
        out = step if out is None else out.join(step, [v for v in (x, y) if v in bound])
        for v in (x, y):
            if v not in bound:
                for w in bound:
                    if wanted[v] == wanted[w]:
                        out = out.filter(F.col(v) != F.col(w))
                bound.append(v)
    return out.select(*wanted)


def match_count(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """How many matches FIXED has, without making them: the d's of each b2 are counted first, and b1 <> b2 is a subtraction."""
    s = labelled_edges(edges, labels, {"a", "b", "c", "d"})
    of = lambda x, y, a, b: s.filter((F.col("ls") == x) & (F.col("ld") == y)).select(F.col("src").alias(a), F.col("dst").alias(b))
    per_b = of("b", "d", "b", "d").groupBy("b").agg(F.count("*").alias("ds"))
    cb = of("c", "b", "c", "b").join(per_b, "b", "left").withColumn("ds", F.coalesce("ds", F.lit(0)))
    per_c = cb.groupBy("c").agg(F.sum("ds").alias("all"))
    found = of("a", "c", "a", "c").join(of("a", "b", "a", "b"), "a").join(cb, ["c", "b"]).join(per_c, "c")
    return found.agg(F.coalesce(F.sum(F.col("all") - F.col("ds")), F.lit(0)).cast("long").alias("matches"))
