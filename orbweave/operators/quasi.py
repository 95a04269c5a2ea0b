"""Maximal gamma-quasi-cliques: a pruned set enumeration over two-hop neighbourhoods, one task for each least vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.degrees import EPSILON, check_gamma, required, required_column
from orbweave.functions.state import stored
from orbweave.operators.cores import k_core_two_hop
from orbweave.operators.graph import mirrored, recoded, relabelled, two_hop
from orbweave.operators.maximal import maximal_sets
from orbweave.plans.tasks import rounds

#: Rules of the search; any of them may be left out, the maximal sets stay the same.
RULES = frozenset({"bounds", "degrees", "critical", "cover", "order", "look-ahead", "adjacent"})


def growth(gamma: float, min_size: int, inner: list[int], outer: list[int], reach: int) -> tuple[int, int] | None:
    """How many vertices, at least and at most, a valid set may have beyond X; None if no number will do.

    inner: the degrees in X of its members; outer: those (in X) of the candidates, descending; reach: the least degree of
    a member in X and the candidates together. A number t is possible if X's members, who miss a sum of edges for a set of
    |X| + t, can get them from the t candidates with the most edges to X."""
    n, total, possible = len(inner), sum(inner), []
    most = min(len(outer), int(reach / gamma + EPSILON) + 1 - n)
    gained = 0
    for t in range(most + 1):
        gained += outer[t - 1] if t else 0
        need = required(gamma, n + t)
        if n + t >= min_size and total + gained >= n * need and min(inner) + t >= need:
            possible.append(t)
    return (possible[0], possible[-1]) if possible else None


def quasi_search(gamma: float, min_size: int, budget: int, rules: frozenset[str] = RULES):
    """Finds every maximal set that holds chosen, and others that are valid but not maximal."""

    def search(chosen: list[int], members: list[int], pairs: list[int]):
        order = [*chosen, *members]
        place = {v: i for i, v in enumerate(order)}
        adj = [0] * len(order)
        for u, v in zip(pairs[::2], pairs[1::2]):
            adj[place[u]] |= 1 << place[v]
            adj[place[v]] |= 1 << place[u]

        def ids(bits: int) -> list[int]:
            out = []
            while bits:
                out.append((bits & -bits).bit_length() - 1)
                bits &= bits - 1
            return out

        near = []  # within two steps
        for i, a in enumerate(adj):
            reach = a | 1 << i
            for j in ids(a):
                reach |= adj[j]
            near.append(reach)

        def valid(x: int) -> bool:
            n = x.bit_count()
            return n >= min_size and all((adj[i] & x).bit_count() >= required(gamma, n) for i in ids(x))

        def hopeful(inside: int, outside: int, n: int, low: int, high: int, own: int) -> bool:
            """Whether a vertex with so many neighbours in X (of n) and among the candidates can have enough of them in some set of n + t, low <= t <= high; own: 1 for a candidate, which is one of the t. Its surplus grows until its neighbours are used up."""
            t = max(low, min(outside + own, high))
            return inside + min(outside, t - own) >= required(gamma, n + t)

        def shrunk(x: int, cand: int) -> tuple[int, int, int, int] | None:
            """X and the candidates after all rules, and the bounds of the growth; None if no valid set is left."""
            while True:
                inside = ids(x)
                for i in inside:
                    cand &= near[i]
                n, m = len(inside), cand.bit_count()
                if n + m < min_size:
                    return None
                inner = [(adj[i] & x).bit_count() for i in inside]
                outer = [(adj[i] & cand).bit_count() for i in inside]
                low, high = max(0, min_size - n), m
                if "bounds" in rules:
                    degrees = sorted(((adj[i] & x).bit_count() for i in ids(cand)), reverse=True)
                    span = growth(gamma, min_size, inner, degrees, min(a + b for a, b in zip(inner, outer)))
                    if span is None:
                        return None
                    low, high = span
                    if not high:
                        return x, 0, 0, 0
                if any(not hopeful(a, b, n, low, high, 0) for a, b in zip(inner, outer)):
                    return None
                weak = 0
                if "degrees" in rules:
                    for i in ids(cand):
                        if not hopeful((adj[i] & x).bit_count(), (adj[i] & cand).bit_count(), n, max(low, 1), high, 1):
                            weak |= 1 << i
                if "adjacent" in rules and required(gamma, n + high) == n + high - 1:  # all members are neighbours
                    for i in inside:
                        weak |= cand & ~adj[i]
                if weak:
                    cand &= ~weak
                    continue
                forced = 0
                if "critical" in rules and low + n:
                    need = required(gamma, n + low)
                    for i, a, b in zip(inside, inner, outer):
                        if b and a + b == need:  # every valid set needs all of this member's neighbours
                            forced |= adj[i] & cand
                if not forced:
                    return x, cand, low, high
                x, cand = x | forced, cand & ~forced

        def covered(x: int, cand: int) -> int:
            """Candidates that form no maximal set with X alone: those next to a candidate u and to all of X that u isn't next to, where u and these have enough neighbours in X already."""
            best, need, inside = 0, required(gamma, x.bit_count() + 1), ids(x)
            for u in ids(cand):
                if (adj[u] & x).bit_count() < need or (adj[u] & cand).bit_count() <= best.bit_count():
                    continue
                c = cand & adj[u]
                for v in inside:
                    if not adj[u] >> v & 1:
                        if (adj[v] & x).bit_count() < need:
                            c = 0
                            break
                        c &= adj[v]
                if c.bit_count() > best.bit_count():
                    best = c
            return best

        start = (1 << len(chosen)) - 1
        stack, nodes = [(start, ((1 << len(order)) - 1) ^ start)], 0
        while stack:
            left = shrunk(*stack.pop())
            nodes += 1
            if left is None:
                continue
            x, cand, low, _ = left
            if "look-ahead" in rules and valid(x | cand):
                yield 0, sorted(order[i] for i in ids(x | cand)), [], []
                continue
            if not low and valid(x):
                yield 0, sorted(order[i] for i in ids(x)), [], []
            last = covered(x, cand) if "cover" in rules else 0
            branches = ids(cand & ~last)
            if "order" in rules:  # those with few edges first: their branches end soon, and later ones have fewer candidates
                branches.sort(key=lambda i: ((adj[i] & x).bit_count(), (adj[i] & cand).bit_count(), (near[i] & cand).bit_count(), i))
            rest = cand
            following = []
            for k in branches:
                rest &= ~(1 << k)
                following.append((x | 1 << k, rest))
            if nodes > budget:
                for y, rest in following:  # a task for each branch
                    own = ids(y | rest)
                    inner = [v for a, i in enumerate(own) for j in own[a + 1 :] if adj[i] >> j & 1 for v in (order[i], order[j])]
                    yield 1, [order[i] for i in ids(y)], [order[i] for i in ids(rest)], inner
            else:
                stack += following

    return search


def quasi_cliques(edges: DataFrame, gamma: float, min_size: int, budget: int = 20_000, rules: frozenset[str] = RULES, recode: bool = False) -> DataFrame:
    """(size, vset): sets of min_size or more in which each vertex is next to ceil(gamma * (size - 1)) others, without those inside another.

    recode: numbers vertices so that the one of greatest degree is 0 and its neighbours come last; these then spawn no
    task, since their sets lie among the neighbours of 0 and are part of a set with it."""
    check_gamma(gamma)
    core = stored(k_core_two_hop(edges, required(gamma, min_size), min_size), "quasi")
    codes = None
    if recode:
        codes = stored(recoded(core), "codes")
        core = stored(relabelled(core, codes), "recoded")
    reach = stored(two_hop(core).filter("other > id"), "reach")
    if recode:
        hub = core.filter("u = 0").select(F.col("v").alias("id"))
        reach = reach.join(hub, "id", "left_anti")
    members = reach.groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("members"))
    own = reach.union(mirrored(core).select(F.col("src").alias("id"), F.col("src").alias("other")).distinct())
    x, y = own.alias("x"), own.alias("y")
    pairs = x.join(core, F.col("x.other") == F.col("u")).select(F.col("x.id").alias("r"), "u", "v").join(y, (F.col("r") == F.col("y.id")) & (F.col("v") == F.col("y.other"))).groupBy("r").agg(F.flatten(F.collect_list(F.array("u", "v"))).alias("pairs"))
    tasks = members.join(pairs, members["id"] == pairs["r"]).select(F.array("id").alias("chosen"), "members", "pairs")
    tasks = tasks.filter(F.size("members") >= min_size - 1)
    found = rounds(tasks, lambda _: quasi_search(gamma, min_size, budget, rules), cost=F.size("members"))
    if recode:
        item = found.distinct().select("chosen", F.explode("chosen").alias("newid")).join(codes, "newid")
        found = item.groupBy("chosen").agg(F.sort_array(F.collect_list("id")).alias("vset")).select(F.col("vset").alias("chosen"))
    return maximal_sets(found.select(F.col("chosen").alias("vset")))


def is_quasi_clique(sets: DataFrame, edges: DataFrame, gamma: float) -> DataFrame:
    """(vset, holds) for each distinct set."""
    s = sets.select("vset").distinct()
    item = s.select("vset", F.explode("vset").alias("a"))
    e = mirrored(edges)
    deg = item.join(e, item["a"] == e["src"], "left").groupBy("vset", "a").agg(F.count(F.when(F.array_contains("vset", F.col("dst")), 1)).alias("d"))
    return deg.groupBy("vset").agg((F.min("d") >= required_column(gamma, F.size("vset"))).alias("holds"))
