"""Queries of the graph operators over G(w): parts are vertices, and two are joined if they share w orders or more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.state import loaded_once, new_path
from orbweave.operators import clique, cores, graph, match, maximal, quasi, triangles
from orbweave.sources import text

LABELS = ["a", "b", "c", "d"]
TASK_ROWS = 500_000  # of lineitem, to a task


def co_order_edges(spark: SparkSession, sf_dir: str, w: int = 1) -> DataFrame:
    """The edges of G(w), made at the first question and kept for later ones."""
    return loaded_once(spark, ("co-order", sf_dir, w), lambda: _co_order_edges(spark, sf_dir, w))


def _co_order_edges(spark: SparkSession, sf_dir: str, w: int) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    p = rows.repartition(n, "o").distinct()  # dealt out first, so that no task holds more than its share, before or after a shuffle
    # no broadcast: files of many repeats look small to Spark
    pairs = p.alias("a").hint("merge").join(p.alias("b"), F.col("a.o") == F.col("b.o")).filter("a.k < b.k").select(F.col("a.k").alias("u"), F.col("b.k").alias("v"))
    return pairs.repartition(n, "u", "v").groupBy("u", "v").count().filter(F.col("count") >= w).select("u", "v")


def co_order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.array(*map(F.lit, LABELS))[(F.col("p_partkey") % 4).cast("int")].alias("label"))


def _on(f: Callable[[DataFrame], DataFrame], w: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(co_order_edges(spark, sf_dir, w))


def _round_trip(spark: SparkSession, sf_dir: str, w: int = 2) -> DataFrame:
    """Adjacency written as text and read again, as edges."""
    path = new_path(spark, "adjacency")
    text.write_adjacency(graph.adjacency(co_order_edges(spark, sf_dir, w)), path)
    return graph.normalised(text.edges_of(text.read_adjacency(spark, path, sort=True)))


def _labelled_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled adjacency, written with degrees to one folder and without to another, and read from both: (src, dst, label of dst, label of src, how often)."""
    adj = graph.labelled_adjacency(co_order_edges(spark, sf_dir), co_order_labels(spark, sf_dir))
    rows = []
    for has_degree in (False, True):
        path = new_path(spark, "labelled")
        text.write_labelled(adj, path, has_degree)
        rows.append(text.read_labelled(spark, path, has_degree))
    both = rows[0].union(rows[1]).select("id", "label", F.explode("nbrs").alias("n"))
    return both.groupBy(F.col("id").alias("src"), F.col("n.id").alias("dst"), F.col("label").alias("src_label"), F.col("n.label").alias("dst_label")).agg(F.count("*").alias("times"))


def _sets_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part sets of orders, written to two folders, with sizes and without, and read from both."""
    sets = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("vset"))
    paths = [new_path(spark, "sets"), new_path(spark, "sets")]
    text.write_sets(sets, paths[0])
    text.write_sets(sets, paths[1], with_size=False)
    found = text.read_sets(spark, paths[0]).union(text.read_sets(spark, [paths[1]], has_size=False))
    return _listed(found).groupBy("size", "vset").agg(F.count("*").alias("times"))


def _recoded_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3-core with new ids, written as adjacency and read again: (u, v) in new ids."""
    path = new_path(spark, "recoded")
    text.write_adjacency(graph.adjacency(cores.recoded_core(co_order_edges(spark, sf_dir), 3, 12)[0]), path)
    return graph.normalised(text.edges_of(text.read_adjacency(spark, path)))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last count of the running triangle count, over the edges in four files of a stream."""
    from orbweave.streaming.triangles import running_triangles

    source = new_path(spark, "stream")
    graph.mirrored(co_order_edges(spark, sf_dir)).repartition(4).write.parquet(source)
    reports: list[tuple[int, int]] = []
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(source)
    query = running_triangles(stream, new_path(spark, "edges"), lambda *r: reports.append(r), new_path(spark, "offsets"), trigger={"availableNow": True})
    query.awaitTermination()
    return spark.createDataFrame([(max(reports)[1],)], "triangles long")


def _pattern_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches over G(1), listed and then summed up by a."""
    found = match.match(co_order_edges(spark, sf_dir), co_order_labels(spark, sf_dir))
    return found.groupBy("a").agg(F.count("*").alias("matches"), F.sum(F.expr("c + 7 * b1 + 31 * b2 + 101 * d")).alias("checksum"))


def _quasi_check(edges: DataFrame) -> DataFrame:
    """(holds, n): how many of the quasi-cliques found hold by the rule, which is 0 where none are found, and how many do not, if any."""
    counts = quasi.is_quasi_clique(quasi.quasi_cliques(edges, 0.6, 4), edges, 0.6).groupBy("holds").agg(F.count("*").alias("n"))
    return edges.sparkSession.range(1).select(F.lit(True).alias("holds")).join(counts, "holds", "full").select("holds", F.coalesce("n", F.lit(0)).alias("n"))


def _maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the part sets of all orders, those that no other order's holds."""
    sets = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("vset"))
    return maximal.maximal_sets(sets).select("size", F.array_join(F.col("vset").cast("array<string>"), " ").alias("vset"))


def _listed(df: DataFrame) -> DataFrame:
    return df.select("size", F.array_join(F.col("vset").cast("array<string>"), " ").alias("vset"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "normalised_edges": _on(lambda e: graph.normalised(graph.mirrored(e))),
        "oriented_edges": _on(graph.by_degree),
        "degree": _on(graph.degrees),
        "degree_histogram": _on(lambda e: graph.degrees(e).groupBy("degree").agg(F.count("*").alias("vertices"))),
        "max_degree_vertex": _on(lambda e: graph.degrees(e).agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("id"), F.max("degree").alias("degree"))),
        "trimmed_adjacency": _on(lambda e: graph.trimmed(graph.adjacency(e), lambda i, n: n > i).select("id", F.size("nbrs").cast("long").alias("n"))),
        "ego_network_edges": _on(graph.ego_edges, 2),
        "induced_edges": _on(lambda e: graph.induced(e, graph.degrees(e).filter("degree >= 120"))),
        "two_hop_size": _on(lambda e: graph.two_hop(e).groupBy("id").agg(F.count("*").alias("n")), 2),
        "recode_ids": _on(graph.recoded),
        "wedge_count": _on(triangles.wedge_count),
        "triangle_count": _on(triangles.triangle_count),
        "triangle_list": _on(triangles.triangles),
        "triangles_per_vertex": _on(triangles.triangles_per_vertex),
        "pattern_count": lambda s, d: match.match_count(co_order_edges(s, d), co_order_labels(s, d)),
        "pattern_list": lambda s, d: match.match(co_order_edges(s, d, 2), co_order_labels(s, d)),
        "kcore_vertices": _on(lambda e: graph.degrees(cores.k_core(e, 3)).select("id"), 2),
        "kcore_profile": _on(cores.core_profile, 2),
        "core_number": _on(cores.core_numbers, 2),
        "kcore_2hop": _on(lambda e: graph.degrees(cores.k_core_two_hop(e, 3, 12)).select("id"), 2),
        "clique_count_by_size": _on(clique.clique_counts),
        "max_clique": _on(lambda e: _listed(clique.max_clique(e))),
        "max_clique_size": _on(lambda e: clique.max_clique(e).select("size")),
        "quasi_cliques": _on(lambda e: _listed(quasi.quasi_cliques(e, 0.6, 4)), 2),
        "quasi_clique_check": _on(_quasi_check, 2),
        "maximal_sets": _maximal,
        "adjacency_round_trip": _round_trip,
        # G(2) thins out as data grow; the same operators over G(1)
        "ego_network_edges_w1": _on(graph.ego_edges),
        "two_hop_size_w1": _on(lambda e: graph.two_hop(e).groupBy("id").agg(F.count("*").alias("n"))),
        "pattern_list_w1": _pattern_digest,
        "kcore_vertices_w1": _on(lambda e: graph.degrees(cores.k_core(e, 3)).select("id")),
        "kcore_profile_w1": _on(cores.core_profile),
        "core_number_w1": _on(cores.core_numbers),
        "kcore_2hop_w1": _on(lambda e: graph.degrees(cores.k_core_two_hop(e, 3, 12)).select("id")),
        "adjacency_round_trip_w1": lambda s, d: _round_trip(s, d, 1),
        "labelled_round_trip": _labelled_round_trip,
        "sets_round_trip": _sets_round_trip,
        "recoded_core_round_trip": _recoded_round_trip,
        "cores_with_vertex": _on(lambda e: cores.cores_with(e, 1)),
        "quasi_cliques_recoded": _on(lambda e: _listed(quasi.quasi_cliques(e, 0.6, 4, recode=True)), 2),
        "streamed_triangle_count": _streamed,
    }


def _graph(w: int = 1) -> str:
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT l_orderkey o, l_partkey k FROM lineitem),
 E AS MATERIALIZED (SELECT a.k u, b.k v FROM p a JOIN p b ON a.o = b.o AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= {w}),
 S AS MATERIALIZED (SELECT u, v FROM E UNION ALL SELECT v, u FROM E), D AS MATERIALIZED (SELECT u AS id, count(*) AS degree FROM S GROUP BY u)"""


def _lab(x: str) -> str:
    return f"(['a', 'b', 'c', 'd'])[{x} % 4 + 1]"


#: triangles over edges from the end of lesser (degree, id), so that no vertex has many; t: the sorted ids
_ORIENTED = """, O AS MATERIALIZED (SELECT CASE WHEN (x.degree, u) < (y.degree, v) THEN u ELSE v END AS a, CASE WHEN (x.degree, u) < (y.degree, v) THEN v ELSE u END AS b
  FROM E JOIN D x ON x.id = u JOIN D y ON y.id = v),
 T AS MATERIALIZED (SELECT list_sort([x.a, x.b, y.b]) AS t FROM O x JOIN O y ON x.b = y.a JOIN O z ON z.a = x.a AND z.b = y.b)"""
_TRIANGLES = "FROM E a JOIN E b ON a.v = b.u JOIN E c ON c.u = a.u AND c.v = b.v"
_PATTERN = f"""FROM S ac JOIN S ab ON ab.u = ac.u JOIN S cb ON cb.u = ac.v AND cb.v = ab.v
 JOIN S c2 ON c2.u = ac.v AND c2.v <> ab.v JOIN S bd ON bd.u = c2.v
 WHERE {_lab("ac.u")} = 'a' AND {_lab("ac.v")} = 'c' AND {_lab("ab.v")} = 'b' AND {_lab("c2.v")} = 'b' AND {_lab("bd.v")} = 'd'"""
_CLIQUES = """, A AS (SELECT u, list(v ORDER BY v) nb FROM E GROUP BY u),
 q(n, vset, cand) AS (SELECT 1, [u], nb FROM A UNION ALL
  SELECT n + 1, list_append(vset, x.v), list_intersect(q.cand, coalesce(A.nb, [])) FROM q, unnest(q.cand) x(v) LEFT JOIN A ON A.u = x.v)"""


def _peeled(k: int) -> str:
    """R: the mirrored edges after i rounds of peeling degrees under k."""
    ok = f"(SELECT u AS ok FROM R GROUP BY u HAVING count(*) >= {k})"
    return f""", R(i, u, v) AS (SELECT 0, u, v FROM S UNION ALL SELECT R.i + 1, R.u, R.v FROM R JOIN {ok} x ON R.u = x.ok JOIN {ok} y ON R.v = y.ok
  WHERE EXISTS (SELECT 1 FROM R GROUP BY u HAVING count(*) < {k})),
 K AS (SELECT u, v FROM R WHERE i = (SELECT max(i) FROM R) AND NOT EXISTS (SELECT 1 FROM R WHERE i = (SELECT max(i) FROM R) GROUP BY u HAVING count(*) < {k}))"""


def _peeled_two_hop(k: int, least: int) -> str:
    """K: the mirrored edges left after peeling vertices of degree under k or with fewer than least others within two steps."""
    return f""", R(i, u, v) AS (SELECT 0, u, v FROM S UNION ALL
  (WITH ok AS MATERIALIZED (SELECT u FROM R GROUP BY u HAVING count(*) >= {k}
     INTERSECT SELECT u FROM (SELECT u, v FROM R UNION SELECT x.u, y.v FROM R x JOIN R y ON x.v = y.u WHERE x.u <> y.v) GROUP BY u HAVING count(*) >= {least}),
    n AS (SELECT count(*) AS good FROM ok), m AS (SELECT count(DISTINCT u) AS everyone FROM R)
   SELECT R.i + 1, R.u, R.v FROM R JOIN ok x ON R.u = x.u JOIN ok y ON R.v = y.u, n, m WHERE good < everyone)),
 top AS MATERIALIZED (SELECT max(i) AS i FROM R),
 K AS MATERIALIZED (SELECT u, v FROM R JOIN top USING (i) WHERE NOT EXISTS (SELECT 1 FROM R JOIN top USING (i) GROUP BY u HAVING count(*) < {k}))"""


#: core: a round peels what is under k, or raises k over the least degree; a vertex's core number is the greatest least degree of a state that has it
_CORES = """, R(i, k, u, v) AS (SELECT 0, 1, u, v FROM S UNION ALL
  SELECT R.i + 1, CASE WHEN m.least < R.k THEN R.k ELSE CAST(m.least + 1 AS INTEGER) END, R.u, R.v
  FROM R CROSS JOIN (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM R GROUP BY u)) m
  JOIN (SELECT u AS ok, count(*) AS n FROM R GROUP BY u) x ON R.u = x.ok JOIN (SELECT u AS ok, count(*) AS n FROM R GROUP BY u) y ON R.v = y.ok
  WHERE m.least >= R.k OR (x.n >= R.k AND y.n >= R.k)),
 state AS (SELECT i, u, count(*) AS n FROM R GROUP BY i, u), lowest AS (SELECT i, min(n) AS least FROM state GROUP BY i),
 core AS MATERIALIZED (SELECT u AS id, CAST(max(least) AS INTEGER) AS core FROM state JOIN lowest USING (i) GROUP BY u)"""
_PROFILE = "SELECT CAST(k AS INTEGER) AS k, count(*) AS n FROM core, unnest(generate_series(1, core)) AS t(k)"
_RECODED = """, hub AS (SELECT max_by(id, degree * 1000000000 - id) AS h FROM D),
 r AS (SELECT D.id, D.degree, CASE WHEN D.id = h THEN 0 WHEN n.v IS NULL THEN 1 ELSE 2 END AS part FROM D CROSS JOIN hub LEFT JOIN S n ON n.u = h AND n.v = D.id)"""
#: the sets of G(2)'s 2-core whose members lie within two steps of each other, grown in ascending order of id
_QUASI = _peeled_two_hop(2, 3) + """, near AS MATERIALIZED (SELECT u, v FROM K WHERE u < v UNION SELECT x.u, y.v FROM K x JOIN K y ON x.v = y.u WHERE x.u < y.v),
 N AS MATERIALIZED (SELECT u, list(v ORDER BY v) AS nb FROM near GROUP BY u), A AS MATERIALIZED (SELECT u, list(v) AS nb FROM K GROUP BY u),
 q(vset, cand) AS (SELECT [u], nb FROM N UNION ALL
  SELECT list_append(vset, x.v), list_intersect(q.cand, coalesce(N.nb, [])) FROM q, unnest(q.cand) x(v) LEFT JOIN N ON N.u = x.v),
 deg AS (SELECT vset, len(vset) AS n, min(len(list_intersect(A.nb, vset))) AS least FROM (SELECT vset, unnest(vset) AS w FROM q WHERE len(vset) >= 4) JOIN A ON A.u = w GROUP BY vset),
 good AS MATERIALIZED (SELECT list_sort(vset) AS vset FROM deg WHERE least >= ceil(0.6 * (n - 1) - 1e-9)),
 found AS (SELECT len(vset) AS size, array_to_string(vset, ' ') AS vset FROM good g WHERE NOT EXISTS (SELECT 1 FROM good h WHERE len(h.vset) > len(g.vset) AND list_has_all(h.vset, g.vset)))"""


def oracle_sql() -> dict[str, str]:
    one, two = _graph(1), _graph(2)
    return {
        "normalised_edges": f"{one} SELECT u, v FROM E",
        "oriented_edges": f"{one} SELECT CASE WHEN (x.degree, u) < (y.degree, v) THEN u ELSE v END AS a, CASE WHEN (x.degree, u) < (y.degree, v) THEN v ELSE u END AS b FROM E JOIN D x ON x.id = u JOIN D y ON y.id = v",
        "degree": f"{one} SELECT id, degree FROM D",
        "degree_histogram": f"{one} SELECT degree, count(*) AS vertices FROM D GROUP BY degree",
        "max_degree_vertex": f"{one} SELECT id, degree FROM D ORDER BY degree DESC, id LIMIT 1",
        "trimmed_adjacency": f"{one} SELECT id, (SELECT count(*) FROM E WHERE E.u = D.id) AS n FROM D",
        "ego_network_edges": f"{two} SELECT a.u AS root, b.u, b.v {_TRIANGLES}",
        "induced_edges": f"{one} SELECT u, v FROM E JOIN D x ON x.id = u JOIN D y ON y.id = v WHERE x.degree >= 120 AND y.degree >= 120",
        "two_hop_size": f"{two} SELECT id, count(*) AS n FROM (SELECT u AS id, v FROM S UNION SELECT x.u, y.v FROM S x JOIN S y ON x.v = y.u WHERE x.u <> y.v) GROUP BY id",
        "recode_ids": f"{one}{_RECODED} SELECT id, row_number() OVER (ORDER BY part, degree, id) - 1 AS newid FROM r",
        "wedge_count": f"{one} SELECT CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS wedges FROM D",
        "triangle_count": f"{one} SELECT count(*) AS triangles {_TRIANGLES}",
        "triangle_list": f"{one}{_ORIENTED} SELECT t[1] AS a, t[2] AS b, t[3] AS c FROM T",
        "triangles_per_vertex": f"{one}, T AS (SELECT a.u AS x, a.v AS y, b.v AS z {_TRIANGLES}) SELECT id, count(*) AS triangles FROM (SELECT x AS id FROM T UNION ALL SELECT y FROM T UNION ALL SELECT z FROM T) GROUP BY id",
        "pattern_count": f"{one} SELECT count(*) AS matches {_PATTERN}",
        "pattern_list": f"{two} SELECT ac.u AS a, ac.v AS c, ab.v AS b1, c2.v AS b2, bd.v AS d {_PATTERN}",
        "clique_count_by_size": f"{one}{_CLIQUES} SELECT n, count(*) AS cliques FROM q WHERE n > 1 GROUP BY n",
        "max_clique": f"{one}{_CLIQUES} SELECT n AS size, array_to_string(vset, ' ') AS vset FROM q ORDER BY n DESC, q.vset LIMIT 1",
        "max_clique_size": f"{one}{_CLIQUES} SELECT max(n) AS size FROM q",
        "maximal_sets": """WITH s AS (SELECT DISTINCT vset FROM (SELECT list(DISTINCT l_partkey ORDER BY l_partkey) AS vset FROM lineitem GROUP BY l_orderkey)),
 i AS (SELECT vset, unnest(vset) AS v FROM s)
SELECT len(vset) AS size, array_to_string(vset, ' ') AS vset FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.v = s.vset[1] AND len(i.vset) > len(s.vset) AND list_has_all(i.vset, s.vset))""",
        "adjacency_round_trip": f"{two} SELECT u, v FROM E",
        "two_hop_size_w1": f"{one} SELECT id, count(*) AS n FROM (SELECT u AS id, v FROM S UNION SELECT x.u, y.v FROM S x JOIN S y ON x.v = y.u WHERE x.u <> y.v) GROUP BY id",
        "adjacency_round_trip_w1": f"{one} SELECT u, v FROM E",
        "ego_network_edges_w1": f"{one}{_ORIENTED} SELECT t[1] AS root, t[2] AS u, t[3] AS v FROM T",
        "pattern_list_w1": f"{one} SELECT ac.u AS a, count(*) AS matches, CAST(sum(ac.v + 7 * ab.v + 31 * c2.v + 101 * bd.v) AS BIGINT) AS checksum {_PATTERN} GROUP BY ac.u",
        "labelled_round_trip": f"{one} SELECT u AS src, v AS dst, {_lab('u')} AS src_label, {_lab('v')} AS dst_label, CAST(2 AS BIGINT) AS times FROM S",
        "sets_round_trip": """SELECT len(vset) AS size, array_to_string(vset, ' ') AS vset, 2 * count(*) AS times
FROM (SELECT list(DISTINCT l_partkey ORDER BY l_partkey) AS vset FROM lineitem GROUP BY l_orderkey) GROUP BY vset""",
        "recoded_core_round_trip": f"""{one}{_peeled_two_hop(3, 11)}, D2 AS MATERIALIZED (SELECT u AS id, count(*) AS degree FROM K GROUP BY u),
 c AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY part, degree, id) - 1 AS newid FROM (SELECT D2.id, D2.degree, CASE WHEN D2.id = h THEN 0 WHEN n.v IS NULL THEN 1 ELSE 2 END AS part
   FROM D2 CROSS JOIN (SELECT max_by(id, degree * 1000000000 - id) AS h FROM D2) LEFT JOIN K n ON n.u = h AND n.v = D2.id))
SELECT x.newid AS u, y.newid AS v FROM K JOIN c x ON x.id = K.u JOIN c y ON y.id = K.v WHERE x.newid < y.newid""",
        "cores_with_vertex": f"{one}{_CORES} {_PROFILE} WHERE k <= (SELECT core FROM core WHERE id = 1) GROUP BY k",
        "kcore_vertices": f"{two}{_peeled(3)} SELECT DISTINCT u AS id FROM K",
        "kcore_vertices_w1": f"{one}{_peeled(3)} SELECT DISTINCT u AS id FROM K",
        "kcore_2hop": f"{two}{_peeled_two_hop(3, 11)} SELECT DISTINCT u AS id FROM K",
        "kcore_2hop_w1": f"{one}{_peeled_two_hop(3, 11)} SELECT DISTINCT u AS id FROM K",
        "core_number": f"{two}{_CORES} SELECT id, core FROM core",
        "core_number_w1": f"{one}{_CORES} SELECT id, core FROM core",
        "kcore_profile": f"{two}{_CORES} {_PROFILE} GROUP BY k",
        "kcore_profile_w1": f"{one}{_CORES} {_PROFILE} GROUP BY k",
        "quasi_cliques": f"{two}{_QUASI} SELECT size, vset FROM found",
        "quasi_cliques_recoded": f"{two}{_QUASI} SELECT size, vset FROM found",
        "quasi_clique_check": f"{two}{_QUASI} SELECT true AS holds, count(*) AS n FROM found",
        "streamed_triangle_count": f"{one} SELECT count(*) AS triangles {_TRIANGLES}",
    }
