"""What grows with the tables: shares of tasks, broadcasts and costs that small results don't show."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import queries
from orbweave.functions.state import pieces, stored
from orbweave.operators import blocks, cores, graph, triangles
from orbweave.sources import text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The lines of 300 orders, four parts each of 40."""
    path = str(tmp_path_factory.mktemp("tables"))
    lines = spark.range(1200).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.xxhash64("id") % 20 + 20).alias("l_partkey"))
    lines.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


def test_stored_tables_keep_their_tasks(spark):
    """A table of many tasks was merged into a number that the cores fix, so each held more as tables grew."""
    table = stored(spark.range(10_000).repartition(80), "many")
    files = [f for f in os.listdir(re.sub("^file:/*", "/", table.stored_at)) if f.startswith("part-")]
    assert len(files) == 80 and table.count() == 10_000


def test_pieces_follow_the_table(spark):
    table = stored(spark.range(200_000).select(F.xxhash64("id").alias("x")), "sized")
    assert pieces(table) == 8 and pieces(table, 0.1) > 12
    assert pieces(table.join(table.toDF("y")).join(table.toDF("z"))) == 8  # of a product Spark has only a guess


def test_edges_are_dealt_by_rows(spark, tables, monkeypatch):
    """Pairs were counted in as many tasks as Spark's own number, and the lines of orders were broadcast where their files looked small."""
    monkeypatch.setattr(queries, "TASK_ROWS", 50)
    made = queries._co_order_edges(spark, tables, 1)
    plan = plan_of(made)
    assert "Broadcast" not in plan and len(re.findall(r"hashpartitioning\([^)]*, 24\), REPARTITION_BY_NUM", plan)) >= 2
    rows = {tuple(r) for r in spark.read.parquet(f"{tables}/lineitem.parquet").collect()}
    of = {}
    for o, k in rows:
        of.setdefault(o, set()).add(k)
    assert {tuple(r) for r in made.collect()} == {(u, v) for s in of.values() for u in s for v in s if u < v}


def test_ends_are_dealt_out_before_they_are_counted(spark):
    """Each task kept nearly all vertices in a partial count."""
    edges = stored(spark.range(1000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "path")
    for made in (graph.degrees(edges), graph.adjacency(edges)):
        plan = plan_of(made)
        assert plan.rindex("Aggregate") < plan.index("REPARTITION_BY_NUM")  # top first: both steps of the count come after the shuffle


def test_labelled_lines_are_split_once(spark, tables, tmp_path):
    """Where the lists are exploded, Spark's own filter by their size split the line again for each entry of it."""
    (tmp_path / "l").write_text("1 a\t2 c 3 b 4\n5\tb\n")
    (tmp_path / "d").write_text("1 a\t2 2 c 3 b 4\n5\tb\n6 c 0\n")
    for name, rest in (("l", []), ("d", [(6, "c", [])])):
        read = text.read_labelled(spark, str(tmp_path / name), has_degree=name == "d")
        assert [(r["id"], r["label"], [tuple(n) for n in r["nbrs"]]) for r in read.orderBy("id").collect()] == [(1, "a", [(2, "c"), (3, "b")]), (5, "b", []), *rest]
        plan = plan_of(read.select("id", F.explode("nbrs").alias("n")))
        assert not re.search(r"lambdafunction\([^\n]*split\(", plan)


def test_maximal_sets_broadcasts_nothing(spark, tables):
    """Tables of all sets went through the driver where the files of the lines looked small."""
    made = queries.queries()["maximal_sets"](spark, tables)
    assert "Broadcast" not in plan_of(made)
    of = {}
    for o, k in spark.read.parquet(f"{tables}/lineitem.parquet").collect():
        of.setdefault(o, set()).add(k)
    sets = {frozenset(s) for s in of.values()}
    assert {r["vset"] for r in made.collect()} == {" ".join(map(str, sorted(s))) for s in sets if not any(s < t for t in sets)}


def test_quasi_clique_check_without_any(spark, tmp_path):
    """No quasi-clique at all: SQL counts 0, the query gave no row."""
    spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries.queries()["quasi_clique_check"](spark, str(tmp_path)).collect()] == [(True, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_core_numbers_over_blocks(spark, monkeypatch, seed):
    """Values cross the bounds of blocks, and few rounds settle a long path, which took a round a step before."""
    r = random.Random(seed)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "LEAST", 40)
    edges = {tuple(sorted(r.sample(range(40), 2))) for _ in range(30 + 150 * seed)} | {(k, k + 1) for k in range(100, 140)} | {(5, 2**40)}
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    expected, left, k = {}, dict(near), 0
    while left:
        k += 1
        while gone := {v for v, n in left.items() if len(n & set(left)) < k}:
            expected |= dict.fromkeys(gone, k - 1)
            left = {v: n for v, n in left.items() if v not in gone}
    e = spark.createDataFrame([(r.sample(e, 2)) for e in edges], "src long, dst long")
    assert dict(map(tuple, cores.core_numbers(graph.normalised(e)).collect())) == expected


def test_a_block_settles_without_others():
    """A path of 2,000 in one block needs no round of the cluster."""
    n = 2000
    near = np.array([x for v in range(n) for x in (v - 1, v + 1) if 0 <= x < n], np.int32)
    core = np.r_[1, np.full(n - 2, 2), 1].astype(np.int32)
    cores.settle(0, np.r_[0, np.cumsum(core, dtype=np.int64)], near, core)
    assert (core == 1).all()


def test_triangles_over_blocks(spark, monkeypatch):
    """Lists are closed in other blocks than their own, once for each block instead of once for each member; some blocks have no lists."""
    r = random.Random(4)
    monkeypatch.setattr(blocks, "BLOCK", 30)
    monkeypatch.setattr(blocks, "LEAST", 30)
    edges = {tuple(sorted(r.sample(range(40), 2))) for _ in range(260)} | {(k, 100 + k % 3) for k in range(40)} | {(39, 2**40)}
    near = {v: {x for e in edges if v in e for x in e if x != v} for e in edges for v in e}
    expected = sorted((a, b, c) for a, b in edges for c in near[a] & near[b] if c > b)
    e = stored(spark.createDataFrame(sorted(edges), "u long, v long"), "edges")
    assert sorted(map(tuple, triangles.triangles(e).collect())) == expected
    plan = plan_of(triangles.triangle_count(e))
    assert "Join" not in plan and "array_intersect" not in plan
    assert sorted(map(tuple, graph.ego_edges(e).collect())) == expected


def test_nothing_to_peel_writes_nothing(spark, monkeypatch):
    """A graph that is its own core was written twice, and all its edges were moved to look for vertices with few within two steps."""
    e = stored(spark.createDataFrame([(u, v) for u in range(9) for v in range(u + 1, 9)], "u long, v long"), "edges")
    names, write = [], cores.stored
    monkeypatch.setattr(cores, "stored", lambda df, name: names.append(name) or write(df, name))
    assert cores.k_core_two_hop(e, 3, 5).count() == 36 and names == ["low", "gone"]
    tail = stored(e.union(spark.createDataFrame([(8, 20), (20, 21)], e.schema)), "edges")
    assert cores.k_core_two_hop(tail, 3, 5).count() == 36 and tail.count() == 38
