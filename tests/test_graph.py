"""Graph operators against exhaustive search on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orbweave.functions.degrees import required
from orbweave.operators import clique, cores, graph, match, maximal, quasi, triangles
from orbweave.plans import tasks
from orbweave.sources import text


def random_graph(n, p, seed):
    r = random.Random(seed)
    return [(u, v) for u in range(n) for v in range(u + 1, n) if r.random() < p]


GRAPHS = {
    "random": random_graph(11, 0.5, 1),
    "k5s": [e for s in (range(5), range(4, 9)) for e in itertools.combinations(s, 2)],
    "star": [(-3, k) for k in range(6)],
    "large ids": [(2**40, 2**40 + 1), (2**40 + 1, 2**40 + 2), (2**40, 2**40 + 2)],
}


def frame(spark, edges):
    return graph.normalised(spark.createDataFrame([*edges, *[(v, u) for u, v in edges[:2]], *[(u, u) for u, _ in edges[:1]]], "src long, dst long"))


@pytest.mark.parametrize("name", GRAPHS)
def test_counts(spark, name):
    edges = GRAPHS[name]
    e = frame(spark, edges).cache()
    assert e.count() == len(edges)
    have = set(edges)
    vs = sorted({v for x in edges for v in x})
    full = lambda s: all(p in have for p in itertools.combinations(s, 2))
    by_size = {k: [s for s in itertools.combinations(vs, k) if full(s)] for k in range(2, 7)}
    assert triangles.triangle_count(e).first()[0] == len(by_size[3])
    assert {tuple(r) for r in clique.clique_counts(e).collect()} == {(k, len(s)) for k, s in by_size.items() if s}
    best = max((s for c in by_size.values() for s in c), key=lambda s: (len(s), [-x for x in s]))
    for budget in (50_000, 1):
        assert clique.max_clique(e, budget).first()["vset"] == list(best)


@pytest.mark.parametrize("name,gamma,least", [("random", 0.6, 4), ("random", 0.8, 4), ("k5s", 0.5, 4), ("k5s", 1.0, 3)])
def test_quasi_cliques(spark, name, gamma, least):
    edges = GRAPHS[name]
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    good = [set(s) for k in range(least, len(near) + 1) for s in itertools.combinations(near, k) if all(len(near[v] & set(s)) >= required(gamma, k) for v in s)]
    expected = sorted(sorted(s) for s in good if not any(s < t for t in good))
    e = frame(spark, edges)
    for budget in (20_000, 1):
        found = quasi.quasi_cliques(e, gamma, least, budget)
        assert sorted(r["vset"] for r in found.collect()) == expected
    assert all(r["holds"] for r in quasi.is_quasi_clique(found, e, gamma).collect())
    with pytest.raises(ValueError):
        quasi.quasi_cliques(e, 0.4, 3)


def random_with_hub(n, p, seed):
    r = random.Random(seed)
    return [(0, v) for v in range(1, n)] + [(u, v) for u in range(1, n) for v in range(u + 1, n) if r.random() < p]


def exhaustive(edges, gamma, least):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    good = [set(s) for k in range(least, len(near) + 1) for s in itertools.combinations(sorted(near), k) if all(len(near[v] & set(s)) >= required(gamma, k) for v in s)]
    return sorted(sorted(s) for s in good if not any(s < t for t in good))


def searched(edges, gamma, least, budget, rules):
    """The search on tasks made in plain Python, split rows and all."""
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    todo, found = [], []
    for v in near:
        members = sorted(w for w in near if w > v)
        own = {v, *members}
        todo.append(([v], members, [x for a, b in edges if a in own and b in own for x in (a, b)]))
    run = quasi.quasi_search(gamma, least, budget, frozenset(rules))
    while todo:
        for kind, *row in run(*todo.pop()):
            (found.append(set(row[0])) if kind == 0 else todo.append(row))
    assert all(len(near[v] & s) >= required(gamma, len(s)) for s in found for v in s)
    return sorted(map(list, {tuple(sorted(s)) for s in found if not any(s < t for t in found)}))


@pytest.mark.parametrize("seed", range(12))
def test_quasi_rules_change_no_result(seed):
    r = random.Random(seed)
    n = r.randint(6, 10)
    edges = (random_with_hub if seed % 3 == 0 else random_graph)(n, r.choice([0.3, 0.5, 0.7, 0.9]), seed)
    for gamma, least in ((0.5, 3), (0.6, 4), (0.75, 4), (0.9, 3), (1.0, 3)):
        expected = exhaustive(edges, gamma, least)
        for rules in (quasi.RULES, set(), *[quasi.RULES - {x} for x in quasi.RULES], *[{x} for x in quasi.RULES]):
            for budget in (20_000, 1):
                assert searched(edges, gamma, least, budget, rules) == expected, (gamma, least, rules, budget)


def test_quasi_recoded(spark):
    for edges in (random_with_hub(9, 0.5, 1), random_graph(10, 0.6, 2)):
        found = quasi.quasi_cliques(frame(spark, edges), 0.6, 4, recode=True)
        assert sorted(r["vset"] for r in found.collect()) == exhaustive(edges, 0.6, 4)


def test_clique_splits(spark):
    edges = random_graph(16, 0.6, 8)
    e = frame(spark, edges).cache()
    best = clique.max_clique(e).first()
    for options in ({"first_split": 0}, {"first_split": 4, "branches": True}, {"budget": 1, "branches": True}, {"budget": 2}):
        assert clique.max_clique(e, **options).first() == best, options


def test_pull_and_aggregate(spark):
    """A miner of one's own: paths of three vertices that end in the vertex of most neighbours, by a pull and a user aggregate."""
    edges = random_graph(9, 0.5, 3)
    e = frame(spark, edges)
    adj = graph.adjacency(e)
    asked = adj.select(F.array("id").alias("chosen"), "nbrs", F.col("nbrs").alias("members"), F.array().cast("array<long>").alias("pairs"))
    pulled = tasks.pull(asked, adj, "nbrs").collect()
    near = {r["id"]: r["nbrs"] for r in adj.collect()}
    assert all([(f["id"], f["nbrs"]) for f in r["frontier"]] == [(v, near[v]) for v in r["nbrs"]] for r in pulled) and len(pulled) == len(near)

    def search_of(value):
        def search(chosen, members, pairs):
            if len(chosen) == 1:  # goes on as one task a neighbour
                for m in members:
                    yield 1, [*chosen, m], [], []
            else:
                yield 0, chosen, [], []

        return search

    total = tasks.Aggregator(F.sum(F.expr("chosen[0] + chosen[1]")), lambda a, b: a + b, 0)
    for big in (None, F.size("members") > 3):
        found, value = tasks.run(asked, search_of, total, big=big, seeds=0)
        assert sorted(tuple(r["chosen"]) for r in found.collect()) == sorted(x for u, v in edges for x in ((u, v), (v, u))) and value == 2 * sum(map(sum, edges))


def test_spawn_filter(spark):
    e = frame(spark, random_graph(14, 0.5, 9))
    every = {tuple(r["chosen"]): (sorted(r["members"]), len(r["pairs"])) for r in tasks.spawn(e).collect()}
    assert {tuple(r["chosen"]): (sorted(r["members"]), len(r["pairs"])) for r in tasks.spawn(e, 3).collect()} == {k: v for k, v in every.items() if len(v[0]) >= 3}


def test_recoded_core(spark, tmp_path):
    edges = [*GRAPHS["k5s"], (8, 20), (20, 21)]
    core, codes = cores.recoded_core(frame(spark, edges), 3, 5)
    assert codes.filter("newid = 0").first()["id"] == 4 and core.count() == 20
    text.write_adjacency(graph.adjacency(core), str(tmp_path / "r"))
    lines = sorted(line for f in (tmp_path / "r").glob("part*") for line in f.read_text().splitlines())
    assert lines[0] == "0 8\t1 2 3 4 5 6 7 8" and len(lines) == 9


def test_few_within_two(spark):
    edges = [*random_graph(12, 0.15, 5), *[(50, k) for k in range(51, 58)], (60, 61)]
    e = frame(spark, edges)
    sizes = {r["id"]: r["n"] for r in graph.two_hop(e).groupBy("id").agg(F.count("*").alias("n")).collect()}
    for least in (1, 3, 6, 9):
        assert sorted(r["id"] for r in cores.few_within_two(e, least).collect()) == sorted(v for v, n in sizes.items() if n < least)


def test_stream(spark, tmp_path):
    from orbweave.streaming.triangles import running_triangles

    batches, reports = ([(1, 2), (2, 3)], [(3, 1), (3, 1), (4, 4)], [(4, 1), (2, 4), (3, 4)]), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
        running_triangles(stream, str(tmp_path / "store"), lambda *r: reports.append(r), str(tmp_path / "offsets"), {"availableNow": True}).awaitTermination()
    assert reports == [(0, 0), (1, 1), (2, 4)]


def test_labelled_writer_and_bare_sets(spark, tmp_path):
    labels = spark.createDataFrame([(v, "abcd"[v % 4]) for v in range(9)], "id long, label string")
    adj = graph.labelled_adjacency(frame(spark, GRAPHS["k5s"]), labels)
    for has_degree in (False, True):
        text.write_labelled(adj, str(tmp_path / f"l{has_degree}"), has_degree)
        assert sorted(text.read_labelled(spark, [str(tmp_path / f"l{has_degree}")], has_degree).collect()) == sorted(adj.collect())
    sets = spark.createDataFrame([([1, 2, 3],), ([7],)], "vset array<long>")
    text.write_sets(sets, str(tmp_path / "s"), with_size=False)
    assert sorted(r["vset"] for r in text.read_sets(spark, [str(tmp_path / "s"), str(tmp_path / "s")], has_size=False).collect()) == [[1, 2, 3], [1, 2, 3], [7], [7]]


def test_cores(spark):
    edges = [*GRAPHS["k5s"], (8, 20), (20, 21)]
    e = frame(spark, edges)
    assert dict(map(tuple, cores.core_numbers(e).collect())) == {**dict.fromkeys(range(9), 4), 20: 1, 21: 1}
    assert {tuple(r) for r in cores.core_profile(e).collect()} == {(1, 11), (2, 9), (3, 9), (4, 9)}
    assert {tuple(r) for r in cores.cores_with(e, 20).collect()} == {(1, 11)}
    assert cores.k_core(e, 5).count() == 0
    assert cores.k_core_two_hop(e, 2, 9).select("u").distinct().count() > 0


def test_match(spark):
    edges = random_graph(12, 0.5, 4)
    label = {v: "abcd"[v % 4] for v in range(12)}
    near = set(edges) | {(v, u) for u, v in edges}
    of = lambda x: [v for v in label if label[v] == x]
    expected = sorted((a, c, b1, b2, d) for a in of("a") for c in of("c") for b1 in of("b") for b2 in of("b") for d in of("d") if b1 != b2 and {(a, c), (a, b1), (c, b1), (c, b2), (b2, d)} <= near)
    e, labels = frame(spark, edges), spark.createDataFrame(list(label.items()), "id long, label string")
    assert sorted(map(tuple, match.match(e, labels).select("a", "c", "b1", "b2", "d").collect())) == expected
    assert match.match_count(e, labels).first()[0] == len(expected)


def test_maximal_and_empty(spark):
    sets = spark.createDataFrame([([1, 2],), ([1, 2, 3],), ([3, 1, 2],), ([4],), ([],)], "vset array<long>")
    assert sorted(r["vset"] for r in maximal.maximal_sets(sets).collect()) == [[1, 2, 3], [4]]
    none = spark.createDataFrame([], "u long, v long")
    assert clique.max_clique(none).count() == 0 and cores.core_numbers(none).count() == 0 and triangles.triangle_count(none).first()[0] == 0


def test_text(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1\t2 2 3\r2 1 1\r\r3\t1 1")
    (tmp_path / "l").write_text("1 a\t2 c 3 b\n\n2 c\t1 a\n")
    (tmp_path / "d").write_text("1 a\t2 2 c 3 b\n")
    assert sorted(map(tuple, text.edges_of(text.read_adjacency(spark, str(tmp_path / "a"))).collect())) == [(1, 2), (1, 3), (2, 1), (3, 1)]
    row = text.read_labelled(spark, str(tmp_path / "l")).filter("id = 1").first()
    assert row == text.read_labelled(spark, str(tmp_path / "d"), has_degree=True).first() and [tuple(x) for x in row["nbrs"]] == [(2, "c"), (3, "b")]
    sets = spark.createDataFrame([([1, 2, 3],), ([7],)], "vset array<long>")
    text.write_sets(sets, str(tmp_path / "s"))
    assert sorted(r["vset"] for r in text.read_sets(spark, str(tmp_path / "s")).collect()) == [[1, 2, 3], [7]]


def test_queries_over_all_shared_orders(spark, tmp_path):
    """The queries of G(1), on a table whose G(2) is nearly empty."""
    from orbweave import queries

    r = random.Random(3)
    rows = [(o, k) for o in range(30) for k in r.sample(range(24), 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(24)], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    near = {k: {j for o, j in rows for p, i in rows if o == p and i == k and j != k} for k in {k for _, k in rows}}
    edges = {(u, v) for u in near for v in near[u] if u < v}
    core = {}
    left, k = dict(near), 0
    while left:
        k += 1
        while gone := {v for v, n in left.items() if len(n & set(left)) < k}:
            core |= dict.fromkeys(gone, k - 1)
            left = {v: n for v, n in left.items() if v not in gone}
    two = {v: (n | set().union(*(near[x] for x in n))) - {v} for v, n in near.items()}
    of = lambda x: [v for v in near if "abcd"[v % 4] == x]
    expected = {
        "ego_network_edges_w1": {(a, b, c) for a, b in edges for c in near if b < c and c in near[a] and c in near[b]},
        "two_hop_size_w1": {(v, len(n)) for v, n in two.items()},
        "pattern_list_w1": {(a, c, x, y, d) for a in of("a") for c in of("c") for x in of("b") for y in of("b") for d in of("d") if x != y and c in near[a] and x in near[a] & near[c] and y in near[c] & near[d]},
        "kcore_vertices_w1": {(v,) for v, c in core.items() if c >= 3},
        "kcore_profile_w1": {(i, sum(c >= i for c in core.values())) for i in range(1, max(core.values()) + 1)},
        "core_number_w1": set(core.items()),
        "kcore_2hop_w1": {(v,) for v, c in core.items() if c >= 3},  # all of that core have 11 others within two steps
        "adjacency_round_trip_w1": edges,
    }
    assert expected["pattern_list_w1"] and max(core.values()) > 4
    matches = expected["pattern_list_w1"]  # the query sums them up by a
    expected["pattern_list_w1"] = {(v, sum(m[0] == v for m in matches), sum(m[1] + 7 * m[2] + 31 * m[3] + 101 * m[4] for m in matches if m[0] == v)) for v in {m[0] for m in matches}}
    for name, rows in expected.items():
        assert sorted(map(tuple, queries.queries()[name](spark, str(tmp_path)).collect())) == sorted(rows), name
