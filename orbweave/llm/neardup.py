"""Near-duplicates of embeddings: all links of cosine >= LINK, by dual traversal of cover trees.

Cosine c is the distance sqrt(2 - 2c) of unit vectors. Equal vectors become one with a weight (a partial
aggregate, so copies never meet in one task). Vectors go to the nearest of a few pivots, a separated net of a
bounded sample, and cells are cut into blocks of about BLOCK_BYTES, whatever the number of vectors. Each block gets
one cover tree, built once: nested nets of halving radii, each node knowing its exact covering radius. Pairs of
blocks, and within them pairs of nodes, that the radii prove apart are dropped; pairs that they prove linked in all
their vectors are counted by weight without being listed; the rest is opened further, down to cosines in double
precision (single precision only rules out, with a margin above its error). Close pairs of blocks are taken
TILE x TILE at a time, so a block is sent once a tile. A tile returns counts and a spanning forest, never the links
themselves.

The sample only shapes the blocks; links are exact. The driver holds at most PIVOTS pivots and which of their cells
are close; pairs of blocks come from a join on these. In many dimensions with no structure no bound prunes above
single vectors; the work is then a product of matrices for each pair of blocks, so quadratic.

Defined results: null, empty or zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths don't link; rows of one id (or without an id) are vectors of their own, and
equal vectors are linked; component_id is the least id reached, null where only rows without one are; other columns
are left out; an empty table gives an empty table; ids are integers, else a TypeError is raised.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import col, components, condensed, forest, small, stored, tidy, trim

LINK = 0.95
BLOCK_BYTES, TILE, PIVOTS, SAMPLE = 2 << 20, 4, 512, 2048
SLACK = 1e-6


def reach(link: float) -> float:
    return math.sqrt(2 - 2 * link)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def net(x: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """rows cut into groups that lie within radius of their first member; first members are more than radius apart."""
    least = 1 - radius * radius / 2
    centres = np.zeros(0, np.int64)
    of = np.full(len(rows), -1)
    for a in range(0, len(rows), 512):
        own = rows[a : a + 512]
        got = np.full(len(own), -1)
        if len(centres):
            dots = x[own] @ x[centres].T
            best = dots.argmax(axis=1)
            near = dots[np.arange(len(own)), best] >= least
            got[near] = best[near]
        free = np.flatnonzero(got < 0)
        if len(free):
            dots = x[own[free]] @ x[own[free]].T >= least
            new = []
            for i in range(len(free)):
                if got[free[i]] < 0:
                    later = free[i:][dots[i, i:]]
                    got[later[got[later] < 0]] = len(centres) + len(new)
                    got[free[i]] = len(centres) + len(new)
                    new.append(own[free[i]])
            centres = np.concatenate([centres, new])
        of[a : a + 512] = got
    order = np.argsort(of, kind="stable")
    return np.split(rows[order], np.flatnonzero(np.diff(of[order])) + 1) if len(rows) else []


def _margin(x: np.ndarray) -> float:
    """More than the error of a product of two unit vectors in single precision."""
    return 1e-6 + 4e-7 * x.shape[1]


class CoverTree:
    """x: unit vectors, put in the order of the tree; node k: lo, hi, radius, and children from kids[k] to kids[k] + fan[k]. The first vector of a node is its centre; nodes 0..tops-1 are the coarsest."""

    def __init__(self, x: np.ndarray):
        lo, hi, kids, fan = [], [], [], []
        queue: list[tuple[int, np.ndarray, float]] = []
        at = 0
        for rows in net(x, np.arange(len(x)), 1.0):
            queue.append((len(lo), rows, 0.5))
            lo.append(at)
            at += len(rows)
            hi.append(at)
            kids.append(0)
            fan.append(0)
        self.tops = len(lo)
        place = np.concatenate([q[1] for q in queue]) if queue else np.zeros(0, np.int64)
        while queue:
            k, rows, radius = queue.pop()
            if len(rows) == 1:
                continue
            groups = net(x, rows, radius) if radius > 1e-3 else [rows[i : i + 1] for i in range(len(rows))]
            kids[k], fan[k], at = len(lo), len(groups), lo[k]
            for g in groups:
                queue.append((len(lo), g, radius / 2))
                place[at : at + len(g)] = g
                lo.append(at)
                at += len(g)
                hi.append(at)
                kids.append(0)
                fan.append(0)
        self.place, self.x = place, x[place]
        self.x32 = self.x.astype(np.float32)
        self.lo, self.hi, self.kids, self.fan = (np.array(v, np.int64) for v in (lo, hi, kids, fan))
        self.radius = np.zeros(len(lo))
        for k in np.flatnonzero(self.hi - self.lo > 1):
            dots = self.x[self.lo[k] : self.hi[k]] @ self.x[self.lo[k]]
            self.radius[k] = math.sqrt(max(0.0, 2 - 2 * dots.min())) + SLACK

    def opened(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.fan[pick]
        row = np.repeat(np.arange(len(pick)), n)
        return row, self.kids[pick][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def dual(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, link: float = LINK) -> tuple:
    """Weights of b linked with each vector of a; of a with each of b; connected places (in a, in b); ranges of places that are connected in a, and in b."""
    t = reach(link)
    sum_a, sum_b = (np.concatenate([[0], np.cumsum(w)]) for w in (weight_a, weight_b))
    add_a, add_b = np.zeros(len(a.x) + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)
    joined: list[tuple[np.ndarray, np.ndarray]] = []
    whole_a, whole_b = np.zeros(len(a.lo), bool), np.zeros(len(b.lo), bool)
    single = np.flatnonzero(b.radius[: b.tops] == 0)
    multi = np.flatnonzero(b.radius[: b.tops] > 0)
    for s in range(0, a.tops, 1024):
        own = np.arange(s, min(s + 1024, a.tops))
        pairs = []
        for other in (single, multi):
            if len(other):
                for k in range(0, len(other), 8192):
                    part = other[k : k + 8192]
                    dots = a.x32[a.lo[own]] @ b.x32[b.lo[part]].T
                    far = t + a.radius[own][:, None] + (b.radius[part][None, :] if other is multi else 0) + SLACK
                    i, j = np.nonzero(dots >= (1 - far * far / 2 - _margin(a.x)).astype(np.float32))
                    pairs.append((own[i], part[j]))
        p, q = (np.concatenate(x) for x in zip(*pairs))
        pending = [(p[k : k + 400_000], q[k : k + 400_000]) for k in range(0, len(p), 400_000)]
        while pending:
            p, q = pending.pop()
            dots = np.einsum("ij,ij->i", a.x[a.lo[p]], b.x[b.lo[q]])
            d, r = np.sqrt(np.maximum(0, 2 - 2 * dots)), a.radius[p] + b.radius[q]
            leaf = r == 0
            yes = np.where(leaf, dots >= link, d + r <= t - SLACK)
            maybe = ~leaf & ~yes & (d <= t + r + SLACK)
            i, j = p[yes], q[yes]
            np.add.at(add_a, a.lo[i], w := sum_b[b.hi[j]] - sum_b[b.lo[j]])
            np.add.at(add_a, a.hi[i], -w)
            np.add.at(add_b, b.lo[j], w := sum_a[a.hi[i]] - sum_a[a.lo[i]])
            np.add.at(add_b, b.hi[j], -w)
            whole_a[i], whole_b[j] = True, True
            joined.append((a.lo[i], b.lo[j]))
            p, q = p[maybe], q[maybe]
            left = a.radius[p] >= b.radius[q]
            for tree, mine, rest, turned in ((a, p[left], q[left], False), (b, q[~left], p[~left], True)):
                for k in range(0, len(mine), 20_000):
                    row, kid = tree.opened(mine[k : k + 20_000])
                    if len(row):
                        pending.append((rest[k : k + 20_000][row], kid) if turned else (kid, rest[k : k + 20_000][row]))
    i, j = (np.concatenate(x) for x in zip(*joined)) if joined else (np.zeros(0, np.int64),) * 2
    ranges = [[(tree.lo[k], tree.hi[k]) for k in np.flatnonzero(w & (tree.hi - tree.lo > 1))] for tree, w in ((a, whole_a), (b, whole_b))]
    return np.cumsum(add_a)[:-1], np.cumsum(add_b)[:-1], (i, j), *ranges


def _packed(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        f = v.astype(np.float32)
    return f if (f == v).all() else v


def _matrix(column) -> np.ndarray:
    """A list column of one length as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _shipped(ids: np.ndarray, weight: np.ndarray, v: np.ndarray) -> bytes:
    """A block with its tree."""
    tree = CoverTree(unit(v))
    return pickle.dumps((ids[tree.place], weight[tree.place], _packed(v[tree.place]), tree.tops, tree.lo, tree.hi, tree.kids, tree.fan, tree.radius), 5)


def _received(blob: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    tree = CoverTree.__new__(CoverTree)
    ids, weight, v, tree.tops, tree.lo, tree.hi, tree.kids, tree.fan, tree.radius = pickle.loads(blob)
    tree.x = unit(v)
    tree.x32 = tree.x.astype(np.float32)
    return tree, ids, weight


def _tile(table: pa.Table) -> pa.Table:
    """The pairs of blocks of one tile: kind 0 (id, linked weight), kind 1 (id, id) connected."""
    blobs = dict(zip(table.column("block").to_pylist(), table.column("blob")))
    others = dict(zip(table.column("block").to_pylist(), table.column("others").to_pylist()))
    held: dict = {}

    def block(k):
        if k not in held:
            held[k] = _received(blobs[k].as_buffer())
        return held[k]

    counts, edges = [], [(np.zeros(0, np.int64),) * 2]
    for i in sorted(others):
        for j in sorted(others[i]):
            (a, ids_a, weight_a), (b, ids_b, weight_b) = block(i), block(j)
            n_a, n_b, joined, in_a, in_b = dual(a, b, weight_a, weight_b)
            own = [(ids_a[joined[0]], ids_b[joined[1]])]
            for ids, ranges in ((ids_a, in_a), (ids_b, in_b)):
                own += [(np.full(hi - lo, ids[lo]), ids[lo:hi]) for lo, hi in ranges]
            edges.append(forest(*(np.concatenate(e) for e in zip(*own))))
            counts += [(ids_a[n_a > 0], n_a[n_a > 0])] + ([] if i == j else [(ids_b[n_b > 0], n_b[n_b > 0])])
    x, y = forest(*(np.concatenate(e) for e in zip(*edges)))
    trim()
    kind = np.concatenate([np.zeros(sum(len(c[0]) for c in counts), np.int8), np.ones(len(x), np.int8)])
    return pa.table({"kind": kind, "a": np.concatenate([*[c[0] for c in counts], x]).astype(np.int64), "b": np.concatenate([*[c[1] for c in counts], y]).astype(np.int64)})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links (vectors linked directly), component_id (least id reachable by links): a row for each row of vectors."""
    if vectors.schema[vec_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("ids of vectors are integers: component_id is the least of them")
    with tidy(vectors.sparkSession) as keep:
        return _near_duplicates(vectors, vec_id, column, keep)


def _near_duplicates(vectors: DataFrame, vec_id: str, column: str, keep) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(col(vec_id).cast("long").alias("id"), col(column).cast("array<double>").alias("v"))
    usable = F.expr("coalesce(size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0), false)")
    keys = [F.xxhash64("v").alias("k"), F.xxhash64(F.lit(1), "v").alias("l")]
    # rep names the vector in the trees: its keys' hash, as ids may be null or repeated
    distinct = rows.filter(usable).select("id", "v", *keys).groupBy("k", "l").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = stored(distinct.withColumn("rep", F.xxhash64("k", "l")), "vectors")
    lengths = dict(map(tuple, distinct.groupBy(F.size("v")).count().orderBy(F.desc("count")).limit(SAMPLE).collect()))  # those beyond share cell 0, which changes no result
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"] if lengths else []
    rows_of = lambda length: max(64, BLOCK_BYTES // (4 * length))
    pivots: dict[int, np.ndarray] = {}
    for length in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == length]))
        chosen, far = [0], 2 - 2 * x @ x[0]
        while len(chosen) < min(len(x), PIVOTS, lengths.get(length, 0) // rows_of(length)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 2 - 2 * x @ x[chosen[-1]])
        pivots[length] = x[chosen]

    def assign(batches):
        for batch in batches:
            size = np.asarray(batch.column("length"))
            cell, far = np.zeros(len(size), np.int32), np.full(len(size), 2.0)
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                p = pivots.get(length)
                if p is not None:
                    dots = unit(_matrix(batch.column("v").take(pa.array(own)))) @ p.T
                    cell[own] = dots.argmax(axis=1)
                    far[own] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    celled = distinct.select("rep", "n", "v", F.size("v").alias("length")).mapInArrow(assign, "rep long, n long, v array<double>, length int, cell int, far double")
    celled = stored(celled, "cells")
    shape = sorted(map(tuple, celled.groupBy("length", "cell").agg(F.count("*"), F.max("far")).collect()))  # PIVOTS a length at most
    cuts = {(length, cell): math.ceil(n / rows_of(length)) for length, cell, n, _ in shape}
    base = dict(zip(cuts, np.cumsum([0, *cuts.values()]).tolist()))  # numbers of blocks: near cells have near numbers only by chance
    close = []
    for length in sorted({x[0] for x in shape}):
        own = [x for x in shape if x[0] == length]
        cell, radius = np.array([x[1] for x in own]), np.array([x[3] for x in own])
        p = pivots.get(length)
        apart = np.sqrt(np.maximum(0, 2 - 2 * p[cell] @ p[cell].T)) if p is not None else np.zeros((len(own), len(own)))
        i, j = np.nonzero(np.triu(apart <= radius[:, None] + radius[None, :] + reach(LINK) + SLACK))
        close += [(length, int(cell[x]), int(cell[y])) for x, y in zip(i, j)]
    places = spark.createDataFrame([(*key, base[key], n) for key, n in cuts.items()], "length int, cell int, base int, cuts int")

    def build(group: pa.Table) -> pa.Table:
        v = _matrix(group.column("v"))
        x = unit(v)
        middle = x.mean(axis=0)
        radius = float(np.sqrt(((x - middle) ** 2).sum(axis=1)).max())
        blob = _shipped(np.asarray(group.column("rep")), np.asarray(group.column("n")), v)
        return pa.table({"block": group.column("block")[:1], "length": group.column("length")[:1], "cell": group.column("cell")[:1], "radius": [radius], "middle": [middle.tolist()], "blob": [blob]}).cast(
            pa.schema([("block", pa.int32()), ("length", pa.int32()), ("cell", pa.int32()), ("radius", pa.float64()), ("middle", pa.list_(pa.float64())), ("blob", pa.binary())])
        )

    blocks = celled.join(F.broadcast(places), ["length", "cell"]).select("rep", "n", "v", "length", "cell", (F.col("base") + F.pmod(F.xxhash64("rep"), "cuts")).cast("int").alias("block"))
    blocks = stored(blocks.groupBy("block").applyInArrow(build, "block int, length int, cell int, radius double, middle array<double>, blob binary"), "blocks")
    near = spark.createDataFrame(close, "length int, cell int, cell2 int")
    meta = blocks.select("length", "cell", "block", "radius", "middle")
    pairs = meta.join(F.broadcast(near), ["length", "cell"]).join(meta.toDF("length", "cell2", "block2", "radius2", "middle2"), ["length", "cell2"])
    gap = F.expr("sqrt(aggregate(zip_with(middle, middle2, (x, y) -> (x - y) * (x - y)), 0D, (a, x) -> a + x))")
    pairs = pairs.filter((F.col("cell") != F.col("cell2")) | (F.col("block") <= F.col("block2"))).filter(gap <= F.col("radius") + F.col("radius2") + F.lit(reach(LINK) + SLACK))
    tile = F.struct(F.floor(F.col("block") / TILE).cast("int").alias("x"), F.floor(F.col("block2") / TILE).cast("int").alias("y")).alias("tile")
    pairs = condensed(pairs.select("block", "block2", tile), "pairs")
    sent = pairs.select("tile", "block", F.col("block2").alias("other")).union(pairs.select("tile", F.col("block2").alias("block"), F.lit(None).cast("int")))
    sent = condensed(sent.groupBy("tile", "block").agg(F.collect_list("other").alias("others")), "sent")
    met = blocks.select("block", "blob").join(small(sent), "block").groupBy("tile").applyInArrow(_tile, "kind tinyint, a long, b long")
    met = stored(met, "met")
    linked = met.filter("kind = 0").groupBy(F.col("a").alias("r")).agg(F.sum("b").alias("s"))
    found = components(met.filter("kind = 1").select("a", "b"), "near")
    named = distinct.select("k", "l", "rep", "least").join(linked, F.col("rep") == F.col("r"), "left").join(found, F.col("rep") == F.col("node"), "left")
    named = condensed(named.select("k", "l", "least", (F.coalesce("s", F.lit(1)) - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = keep(condensed(named.join(least, "root").select(F.col("k").alias("k2"), F.col("l").alias("l2"), "n_links", "component_id"), "components"))
    keyed = rows.select("id", F.when(usable, F.xxhash64("v")).alias("k"), F.when(usable, F.xxhash64(F.lit(1), "v")).alias("l"))
    out = keyed.join(small(named), (F.col("k") == F.col("k2")) & (F.col("l") == F.col("l2")), "left")
    alone = F.when(F.col("k2").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").cast(vectors.schema[vec_id].dataType).alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"))
