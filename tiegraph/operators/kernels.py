"""Algorithms that are sequential by nature, as kernels in one task: over one weak component at a time, or, where parts of
the network depend on each other through totals (communities), over all of it.

Components run in parallel. A component is refused above ``MAX_TIES`` ties, so a group in memory is bounded. Betweenness
and bridges have a form on joins for networks beyond ``local.SOURCE_ROWS`` and ``local.LOCAL_ROWS``. Results don't depend on the order of rows.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError, symmetrized
from tiegraph.operators import local
from tiegraph.operators.components import connected_components
from tiegraph.operators.local import LOCAL_ROWS, SOURCE_ROWS, Arrays, arcs_in, best_trial, one_task, per_source, pooled
from tiegraph.plans.lineage import materialize

MAX_TIES = 5_000_000
Kernel = Callable[["Graph"], list[tuple]]


class Graph:
    """One component: node keys in order, adjacency by index."""

    def __init__(self, pdf: pd.DataFrame, directed: bool):
        self.keys = sorted(set(pdf["ego"]) | set(pdf["alter"]))
        self.n = len(self.keys)
        at = {k: i for i, k in enumerate(self.keys)}
        rows = sorted(zip((at[x] for x in pdf["ego"]), (at[x] for x in pdf["alter"]), pdf["value"].astype(float), strict=True))
        self.directed = directed
        self.out: list[dict[int, float]] = [{} for _ in range(self.n)]
        self.into: list[dict[int, float]] = [{} for _ in range(self.n)]
        for i, j, v in rows:
            if i != j:
                self.out[i][j] = self.into[j][i] = v
                if not directed:
                    self.out[j][i] = self.into[i][j] = v

    def both(self) -> list[dict[int, float]]:
        """Undirected neighbours, with the larger value of the two directions."""
        return [{j: max(self.out[i].get(j, -np.inf), self.into[i].get(j, -np.inf)) for j in {*self.out[i], *self.into[i]}} for i in range(self.n)]

    def matrix(self) -> np.ndarray:
        m = np.zeros((self.n, self.n))
        for i, row in enumerate(self.out):
            for j, v in row.items():
                m[i, j] = v
        return m


def run(net: Network, kernel: Kernel, schema: str, isolates: tuple | None = None) -> DataFrame:
    """Rows of ``kernel`` for each component; ``isolates`` gives the columns after the node for nodes without ties."""
    ties = net.ties.where("ego <> alter").select("ego", "alter", "value")
    schema = schema.replace("KEY", dict(net.nodes.dtypes)["node"])
    rows, size = pooled(net, ties)
    ties = arcs_in(rows)
    if size <= LOCAL_ROWS:
        labels = one_task(net, rows, lambda a: [a.keys, local.component_labels(a.n, a.source, a.to)], "node KEY, component long")
    else:
        labels = connected_components(ties)
    parts = materialize(ties.join(labels.withColumnRenamed("node", "ego"), "ego"), "parts")
    biggest = parts.groupBy("component").agg(F.count("*").alias("k")).agg(F.max("k")).head()[0] or 0
    if biggest > MAX_TIES:
        raise NetworkError(f"a component has {biggest} ties; this kernel takes {MAX_TIES}")
    directed = net.directed
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernel(Graph(pdf, directed)), columns=names)

    out = parts.groupBy("component").applyInPandas(apply, schema)
    if isolates is not None:
        alone = net.nodes.select("node").join(ties.select(F.col("ego").alias("node")).union(ties.select("alter")).distinct(), "node", "left_anti")
        kinds = [c.strip().split(" ")[1] for c in schema.split(",")][1:]
        out = out.unionByName(alone.select("node", *[F.lit(v).cast(k).alias(c) for v, k, c in zip(isolates, kinds, names[1:], strict=True)]))
    return out


def _positive(net: Network, one_way: bool) -> DataFrame:
    """Arcs of positive value; unless ``one_way``, both directions with the larger value."""
    e = net.ties.where("ego <> alter and value > 0").select("ego", "alter", "value")
    if one_way and net.directed:
        return e
    e = symmetrized(e)
    return e.unionByName(e.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), "value"))


def betweenness(net: Network, symmetric: bool = True, alpha: float | None = None, standardize: bool = False, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """node, betweenness over ties with positive values; undirected pairs count once. ``alpha``: costs value^-alpha."""
    one_way = net.directed and not symmetric
    rows, size = pooled(net, _positive(net, one_way))
    n = net.n_nodes() if standardize else 0
    scale = (1.0 if one_way else 0.5) / (((n - 1) * (n - 2) / (1 if one_way else 2)) if n > 2 else 1)

    def kernel(a: Arrays, mine: np.ndarray) -> Iterator[list]:
        score = local.brandes(a, mine, a.weight**-alpha if alpha else None)
        at = np.flatnonzero(score)
        yield [a.keys.take(at), score[at]]

    if size <= local_rows:
        parts = per_source(net, rows, kernel, "node KEY, score double")
    elif alpha:
        raise NetworkError("weighted betweenness takes networks of at most SOURCE_ROWS rows")
    else:
        parts = _betweenness_on_joins(net, rows)
    score = parts.groupBy("node").agg((F.sum("score") * scale).alias("betweenness"))
    return net.nodes.select("node").join(score, "node", "left").fillna(0.0, ["betweenness"])


def _betweenness_on_joins(net: Network, rows: DataFrame) -> DataFrame:
    """(node, score): layers of each block of sources forward with the numbers of paths, then backward with the shares."""
    from tiegraph.operators.iterate import _blocks

    arcs, out = arcs_in(rows).select("ego", "alter"), None
    for block in _blocks(net, rows):
        layers = [materialize(block.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma")), "layers")]
        known = layers[0].select("source", "node")
        while True:
            step = layers[-1].join(arcs, F.col("node") == F.col("ego")).groupBy("source", F.col("alter").alias("node")).agg(F.sum("sigma").alias("sigma"))
            new = materialize(step.join(known, ["source", "node"], "left_anti"), "layers")
            if new.isEmpty():
                break
            layers.append(new)
            known = known.unionByName(new.select("source", "node"))
        below = None
        for k in range(len(layers) - 1, 0, -1):
            here = layers[k] if below is None else layers[k].join(below, ["source", "node"], "left")
            here = materialize(here.select("source", "node", "sigma", (F.lit(0.0) if below is None else F.coalesce("delta", F.lit(0.0))).alias("delta")), "shares")
            back = here.join(arcs.select(F.col("alter").alias("node"), F.col("ego").alias("before")), "node")
            up = back.join(layers[k - 1].select("source", F.col("node").alias("before"), F.col("sigma").alias("s")), ["source", "before"])
            below = up.groupBy("source", F.col("before").alias("node")).agg(F.sum(F.col("s") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
            part = here.groupBy("node").agg(F.sum("delta").alias("score"))
            out = part if out is None else out.unionByName(part)
    return out


def _moves(links: tuple[list, list, list], k: list[float], com: list[int], m2: float, gamma: float, rng: np.random.Generator, allowed: list[int] | None = None) -> bool:
    """Move nodes to the neighbouring community of largest gain until none gains; a moved node wakes its neighbours."""
    start, to, w = links
    n, moved = len(k), False
    total = [0.0] * n
    for i, c in enumerate(com):
        total[c] += k[i]
    todo, waits = deque(rng.permutation(n).tolist()), [True] * n
    while todo:
        i = todo.popleft()
        waits[i] = False
        near: dict[int, float] = {}
        for e in range(start[i], start[i + 1]):
            j = to[e]
            if allowed is None or allowed[i] == allowed[j]:
                near[com[j]] = near.get(com[j], 0.0) + w[e]
        old, f = com[i], gamma * k[i] / m2
        total[old] -= k[i]
        best, gain = old, near.get(old, 0.0) - f * total[old]
        for c, x in near.items():
            g = x - f * total[c]
            if g > gain + 1e-12:
                best, gain = c, g
        total[best] += k[i]
        if best != old:
            com[i], moved = best, True
            for e in range(start[i], start[i + 1]):
                j = to[e]
                if not waits[j] and com[j] != best:
                    waits[j] = True
                    todo.append(j)
    return moved


def _contract(start: np.ndarray, to: np.ndarray, w: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs between the parts, added up; those inside a part are left out."""
    n = int(part.max()) + 1
    source = part[np.repeat(np.arange(len(start) - 1), np.diff(start))]
    target = part[to]
    out = source != target
    pair, at = np.unique(source[out] * n + target[out], return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.bincount(pair // n, minlength=n))]), pair % n, np.bincount(at, w[out], len(pair))


def _dense(labels: list[int] | np.ndarray) -> np.ndarray:
    return np.unique(np.asarray(labels), return_inverse=True)[1]


def partition(a: Arrays, gamma: float, rng: np.random.Generator, refine: bool) -> np.ndarray:
    """Louvain; with ``refine`` (Leiden) communities are split into well-joined parts, which are contracted, and the next
    level starts from the communities. Gains use the weight of the whole network."""
    m2 = a.weight.sum() or 1.0
    start, to, w = a.start, a.to, a.weight
    k = np.bincount(a.source, a.weight, a.n)
    member, com = np.arange(a.n), np.arange(a.n)
    while True:
        links, mine, n = (start.tolist(), to.tolist(), w.tolist()), com.tolist(), len(k)
        _moves(links, k.tolist(), mine, m2, gamma, rng)
        com = _dense(mine)
        if int(com.max(initial=-1)) + 1 == n:
            return com[member]
        parts = com
        if refine:
            split = list(range(n))
            _moves(links, k.tolist(), split, m2, gamma, rng, com.tolist())
            fine = _dense(split)
            parts = fine if int(fine.max()) + 1 < n else com
        start, to, w = _contract(start, to, w, parts)
        k, member = np.bincount(parts, k), parts[member]
        up = np.zeros(len(k), np.int64)
        up[parts] = com
        com = up


def quality(a: Arrays, com: np.ndarray, gamma: float = 1.0) -> float:
    """Modularity over the whole network."""
    source, m2 = a.source, a.weight.sum() or 1.0
    k = np.bincount(com[source], a.weight, int(com.max(initial=0)) + 1)
    return float((a.weight[com[source] == com[a.to]].sum() - gamma * (k * k).sum() / m2) / m2)


def _plogp(x: np.ndarray | float) -> np.ndarray | float:
    return x * np.log2(np.maximum(x, 1e-300))


def code_length(a: Arrays, com: np.ndarray) -> float:
    """The two-level map equation of undirected flow."""
    source, m2 = a.source, a.weight.sum() or 1.0
    n = int(com.max(initial=0)) + 1
    flow = np.bincount(source, a.weight, a.n) / m2
    size, out = np.bincount(com, flow, n), np.bincount(com[source], a.weight * (com[source] != com[a.to]), n) / m2
    return float(_plogp(out.sum()) - 2 * _plogp(out).sum() - _plogp(flow).sum() + _plogp(out + size).sum())


def map_equation(a: Arrays, rng: np.random.Generator) -> np.ndarray:
    """Infomap's search: moves of nodes that shorten the code, then of whole modules, until nothing is shortened."""
    from math import log2

    plogp = lambda x: x * log2(x) if x > 1e-300 else 0.0
    m2 = a.weight.sum() or 1.0
    start, to, w = a.start, a.to, a.weight / m2
    flow = np.bincount(a.source, a.weight, a.n) / m2
    member = np.arange(a.n)
    while True:
        n = len(flow)
        s, t, v, f = start.tolist(), to.tolist(), w.tolist(), flow.tolist()
        outside = np.bincount(np.repeat(np.arange(n), np.diff(start)), w, n).tolist()
        com, size, leave, moved_any = list(range(n)), list(f), list(outside), False
        total, todo, waits = sum(leave), deque(rng.permutation(n).tolist()), [True] * n
        while todo:
            i = todo.popleft()
            waits[i] = False
            near: dict[int, float] = {}
            for e in range(s[i], s[i + 1]):
                near[com[t[e]]] = near.get(com[t[e]], 0.0) + v[e]
            old = com[i]
            rest, rest_size = leave[old] - outside[i] + 2 * near.get(old, 0.0), size[old] - f[i]
            away = -2 * plogp(rest) + plogp(rest + rest_size) + 2 * plogp(leave[old]) - plogp(leave[old] + size[old])
            best, gain, at = old, -1e-12, (0.0, 0.0)
            for c, x in near.items():
                if c != old:
                    new = leave[c] + outside[i] - 2 * x
                    sum_ = total - leave[old] - leave[c] + rest + new
                    diff = plogp(sum_) - plogp(total) + away - 2 * plogp(new) + plogp(new + size[c] + f[i]) + 2 * plogp(leave[c]) - plogp(leave[c] + size[c])
                    if diff < gain:
                        best, gain, at = c, diff, (new, sum_)
            if best != old:
                leave[old], size[old], leave[best], size[best], total = rest, rest_size, at[0], size[best] + f[i], at[1]
                com[i], moved_any = best, True
                for e in range(s[i], s[i + 1]):
                    if not waits[t[e]]:
                        waits[t[e]] = True
                        todo.append(t[e])
        part = _dense(com)
        member = part[member]
        if not moved_any:
            return member
        start, to, w = _contract(start, to, w, part)
        flow = np.bincount(part, flow)


def _labelled(a: Arrays, com: np.ndarray) -> list:
    """Nodes and the first node of their community."""
    first = np.full(int(com.max(initial=0)) + 1, a.n, np.int64)
    np.minimum.at(first, com, np.arange(a.n))
    return [a.keys, a.keys.take(first[com])]


def community(net: Network, method: str = "louvain", gamma: float = 1.0, trials: int = 5, seed: int = 1) -> DataFrame:
    """node, community (label: its first node): louvain, leiden or infomap of an undirected network, the best of some
    trials by its objective (modularity; code length). Both refer to the whole network, however many components it has.
    Sequential: the task of each trial holds the network, about 100 bytes an arc."""
    if net.directed:
        raise NetworkError("symmetrize the network first")
    if method not in ("louvain", "leiden", "infomap"):
        raise NetworkError(f"unknown method {method}")
    rows, _ = pooled(net, _positive(net, False))

    def kernel(a: Arrays, trial: int) -> tuple[float, list]:
        rng = np.random.default_rng((seed, trial))
        com = map_equation(a, rng) if method == "infomap" else partition(a, gamma, rng, method == "leiden")
        return round(-code_length(a, com) if method == "infomap" else quality(a, com, gamma), 12), _labelled(a, com)

    return best_trial(net, rows, kernel, "node KEY, community KEY", trials)


def _grow(adj: list[set[int]] | dict[int, set[int]], r: list[int], p: set[int], x: set[int], least: int, most: int, found: list[list[int]]) -> None:
    """Bron-Kerbosch with pivots: the maximal cliques of ``r`` and some of ``p``, none of ``x``."""
    if not p and not x:
        if len(r) >= least:
            found.append(sorted(r))
            if len(found) > most:
                raise NetworkError(f"more than {most} cliques")
        return
    if len(r) + len(p) < least:
        return
    pivot = max(p | x, key=lambda u: len(adj[u] & p))
    for v in sorted(p - adj[pivot]):
        _grow(adj, [*r, v], p & adj[v], x & adj[v], least, most, found)
        p = p - {v}
        x = x | {v}


def maximal_cliques(adj: list[set[int]], least: int, most: int) -> list[list[int]]:
    """Bron-Kerbosch with pivots over a degeneracy order."""
    found: list[list[int]] = []
    degree = [len(a) for a in adj]
    left, order = set(range(len(adj))), []
    heap = [(d, i) for i, d in enumerate(degree)]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v in left and d == degree[v]:
            left.discard(v)
            order.append(v)
            for w in adj[v] & left:
                degree[w] -= 1
                heapq.heappush(heap, (degree[w], w))
    at = {v: i for i, v in enumerate(order)}
    for v in order:
        later = {w for w in adj[v] if at[w] > at[v]}
        _grow(adj, [v], later, adj[v] - later, least, most, found)
    return sorted(found)


def cliques(net: Network, least: int = 3, most: int = 1_000_000) -> DataFrame:
    """clique (its nodes joined by commas), node: members of maximal cliques of at least ``least`` nodes. From three nodes on
    they lie in the triangles of their member of lowest degree, so that node's triangles are a task's group, whatever the
    size of the component (at most ``most`` cliques from one node); smaller ones need the component."""
    if least < 3:

        def kernel(g: Graph) -> list[tuple]:
            return [(",".join(str(g.keys[i]) for i in c), g.keys[v]) for c in maximal_cliques([set(a) for a in g.both()], least, most) for v in c]

        return run(net, kernel, "clique string, node KEY")
    from tiegraph.operators.structure import triangles

    kind = dict(net.nodes.dtypes)["node"]
    tri = materialize(triangles(net).select("a", "b", "c"), "triangles")
    corner = tri.select(F.explode(F.array("a", "b", "c")).alias("v"))
    d = corner.groupBy("v").agg(F.count("*").alias("d"))
    for x in "abc":
        tri = tri.join(d.select(F.col("v").alias(x), F.struct("d", F.col("v").alias("k")).alias(f"r{x}")), x)
    sides = tri.select(F.explode(F.array(*[F.struct(F.col(f"r{v}").alias("v"), F.col(f"r{y}").alias("y"), F.col(f"r{z}").alias("z")) for v, y, z in ("abc", "bac", "cab")])).alias("t")).select("t.*")
    # ties between two nodes that come before the group's node rule out nothing
    sides = sides.where("y > v or z > v").select(F.col("v.k").alias("v"), F.col("y.k").alias("y"), F.col("z.k").alias("z"), (F.col("y") > F.col("v")).alias("after_y"), (F.col("z") > F.col("v")).alias("after_z"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(set(pdf["y"]) | set(pdf["z"]) | {pdf["v"].iloc[0]})
        at = {k: i for i, k in enumerate(keys)}
        adj: dict[int, set[int]] = {i: set() for i in range(len(keys))}
        later: set[int] = set()
        for y, z, one, two in zip(pdf["y"].map(at), pdf["z"].map(at), pdf["after_y"], pdf["after_z"], strict=True):
            adj[y].add(z)
            adj[z].add(y)
            later |= {v for v, is_later in ((y, one), (z, two)) if is_later}
        mine, found = at[pdf["v"].iloc[0]], []
        _grow(adj, [mine], later, set(range(len(keys))) - later - {mine}, least, most, found)
        return pd.DataFrame([(",".join(str(keys[i]) for i in c), keys[v]) for c in found for v in c], columns=["clique", "node"])

    return sides.groupBy("v").applyInPandas(group, f"clique string, node {kind}")


def _near(adj: list[set[int]], k: int) -> list[set[int]]:
    out = []
    for s in range(len(adj)):
        seen = layer = {s}
        for _ in range(k):
            layer = set().union(*(adj[v] for v in layer)) - seen
            seen = seen | layer
        out.append(seen - {s})
    return out


def n_cliques(net: Network, k: int = 2, least: int = 3, clans: bool = False, most: int = 100_000) -> DataFrame:
    """clique, node: maximal sets within distance ``k`` of each other; ``clans``: within it inside the set as well."""

    def kernel(g: Graph) -> list[tuple]:
        adj = [set(a) for a in g.both()]
        found = maximal_cliques(_near(adj, k), least, most)
        if clans:
            def inside(c: list[int]) -> bool:
                keep = set(c)
                sub = [adj[v] & keep for v in range(g.n)]
                near = _near(sub, k)
                return all(near[v] >= keep - {v} for v in c)

            found = [c for c in found if inside(c)]
        return [(",".join(str(g.keys[i]) for i in c), g.keys[v]) for c in found for v in c]

    return run(net, kernel, "clique string, node KEY")


def k_plexes(net: Network, k: int = 2, least: int = 4, most: int = 100_000) -> DataFrame:
    """plex, node: maximal sets in which everyone is tied to all but at most ``k`` (counting itself).

    Sets of 2k - 1 or more are connected and no wider than two steps, which bounds the search around each node; smaller
    ones may be spread over components, and are searched among all nodes of a network of at most 300.
    """
    spread = least < 2 * k - 1

    def search(adj: list[set[int]]) -> list[list[int]]:
        n, found = len(adj), []

        def fits(s: list[int], u: int) -> bool:
            size, inside = len(s) + 1, 0
            for x in s:
                if x in adj[u]:
                    inside += 1
                elif size - sum(y in adj[x] for y in s) > k:
                    return False
            return inside >= size - k

        def grow(s: list[int], p: list[int], x: list[int]) -> None:
            p, x = [v for v in p if fits(s, v)], [v for v in x if fits(s, v)]
            if not p:
                if not x and len(s) >= least:
                    found.append(sorted(s))
                    if len(found) > most:
                        raise NetworkError(f"more than {most} plexes")
                return
            if len(s) + len(p) < least:
                return
            for i, v in enumerate(p):
                grow([*s, v], p[i + 1 :], x + p[:i])

        for v in range(n):
            near = set(range(n)) if spread else adj[v].union(*(adj[w] for w in adj[v]))
            near.discard(v)
            if not spread:  # a member that isn't tied to v shares enough neighbours with it
                near = {u for u in near if u in adj[v] or len(adj[u] & adj[v]) >= least - 2 * k + 2}
            grow([v], sorted(u for u in near if u > v), sorted(u for u in near if u < v))
        return sorted(found)

    if not spread:
        def kernel(g: Graph) -> list[tuple]:
            return [(",".join(str(g.keys[i]) for i in c), g.keys[v]) for c in search([set(a) for a in g.both()]) for v in c]

        return run(net, kernel, "plex string, node KEY")

    def dense(keys: list, m: np.ndarray) -> list[tuple]:
        tied = (m != 0) | (m.T != 0)
        np.fill_diagonal(tied, False)
        return [(",".join(str(keys[i]) for i in c), keys[v]) for c in search([set(np.flatnonzero(r).tolist()) for r in tied]) for v in c]

    return whole(net, dense, "plex string, node KEY", 300)


def bridges(net: Network, kind: str = "global", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """ego, alter of ties whose removal disconnects their ends (global), or leaves them more than two apart (local); with
    ``distance`` every tie and how far apart its ends are without it (-1: not connected)."""
    from tiegraph.operators import iterate

    if kind == "local":
        return iterate.bridges_local(net)
    if kind == "distance":
        return iterate.bridges_distance(net, local_rows=local_rows)
    if kind != "global":
        raise NetworkError(f"unknown kind {kind}")
    rows, size = pooled(net, net.links.withColumn("value", F.lit(1.0)))
    if size > local_rows:
        return _bridges_on_joins(rows)

    def kernel(a: Arrays) -> list:
        start, to = a.start.tolist(), a.to.tolist()
        low, when, found, clock = [0] * a.n, [0] * a.n, [], 0
        for root in range(a.n):
            if when[root]:
                continue
            clock += 1
            when[root] = low[root] = clock
            stack, at = [(root, -1)], list(start[root : root + 1])
            while stack:
                v, parent = stack[-1]
                if at[-1] < start[v + 1]:
                    w = to[at[-1]]
                    at[-1] += 1
                    if not when[w]:
                        clock += 1
                        when[w] = low[w] = clock
                        stack.append((w, v))
                        at.append(start[w])
                    elif w != parent:
                        low[v] = min(low[v], when[w])
                else:
                    stack.pop()
                    at.pop()
                    if parent >= 0:
                        low[parent] = min(low[parent], low[v])
                        if low[v] > when[parent]:
                            found.append((min(v, parent), max(v, parent)))
        ends = np.array(sorted(found), np.int64).reshape(-1, 2)
        return [a.keys.take(ends[:, 0]), a.keys.take(ends[:, 1])]

    return one_task(net, rows, kernel, "ego KEY, alter KEY")


def _bridges_on_joins(rows: DataFrame) -> DataFrame:
    """Bridges by labels: every tie off a spanning forest gets a random 128-bit label, a tie of the forest the exclusive or
    of the labels of the ties around it. It is a bridge if that is nothing (wrong once in 2^128)."""
    links = arcs_in(rows).select("ego", "alter")
    comp = connected_components(links)
    layer = known = materialize(comp.where("node = component").select("node", F.col("node").alias("parent")), "forest")
    layers = [layer]
    while True:
        step = layer.join(links, F.col("node") == F.col("ego")).groupBy(F.col("alter").alias("node")).agg(F.min("ego").alias("parent"))
        layer = materialize(step.join(known.select("node"), "node", "left_anti"), "forest")
        if layer.isEmpty():
            break
        layers.append(layer)
        known = known.unionByName(layer)
    tree = known.where("node <> parent")
    both = tree.select(F.col("node").alias("ego"), F.col("parent").alias("alter")).union(tree.select("parent", "node"))
    label = [F.xxhash64(F.lit(seed), F.least("ego", "alter"), F.greatest("ego", "alter")) for seed in (1, 2)]
    marks = links.join(both, ["ego", "alter"], "left_anti").groupBy(F.col("ego").alias("node")).agg(*[F.bit_xor(x).alias(f"x{k}") for k, x in enumerate(label)])
    below, found = None, None
    for layer in reversed(layers[1:]):
        here = layer.join(marks, "node", "left").fillna(0, ["x0", "x1"])
        if below is not None:
            here = here.join(below, "node", "left").fillna(0, ["y0", "y1"]).select("node", "parent", *[F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}")).alias(f"x{k}") for k in (0, 1)])
        here = materialize(here.select("node", "parent", "x0", "x1"), "forest-labels")
        below = here.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("x0").alias("y0"), F.bit_xor("x1").alias("y1"))
        part = here.where("x0 = 0 and x1 = 0").select(F.least("node", "parent").alias("ego"), F.greatest("node", "parent").alias("alter"))
        found = part if found is None else found.unionByName(part)
    return links.where("false") if found is None else found


def _flow(cap: list[dict[int, float]], s: int, t: int) -> tuple[float, set[int]]:
    """Largest flow by shortest augmenting paths, and the nodes on the source's side of a smallest cut."""
    rest = [dict(r) for r in cap]
    for i, r in enumerate(cap):
        for j in r:
            rest[j].setdefault(i, 0.0)
    total = 0.0
    while True:
        parent, layer = {s: s}, [s]
        while layer and t not in parent:
            new = []
            for v in layer:
                for w, c in rest[v].items():
                    if c > 1e-12 and w not in parent:
                        parent[w] = v
                        new.append(w)
            layer = new
        if t not in parent:
            return total, set(parent)
        path, v = [], t
        while v != s:
            path.append((parent[v], v))
            v = parent[v]
        push = min(rest[a][b] for a, b in path)
        for a, b in path:
            rest[a][b] -= push
            rest[b][a] += push
        total += push


def max_flow(net: Network, source: object, target: object, weighted: bool = False) -> DataFrame:
    """flow, and the ties (ego, alter) of a smallest cut; no rows if the two are in different components."""

    def kernel(g: Graph) -> list[tuple]:
        if source not in g.keys or target not in g.keys:
            return []
        cap = [{j: (v if weighted else 1.0) for j, v in r.items()} for r in g.out]
        flow, side = _flow(cap, g.keys.index(source), g.keys.index(target))
        return [(flow, g.keys[i], g.keys[j]) for i in sorted(side) for j in sorted(cap[i]) if j not in side]

    return run(net, kernel, "flow double, ego KEY, alter KEY")


def lambda_sets(net: Network) -> DataFrame:
    """ego, alter, connectivity: an equivalent-flow tree (Gusfield): the edge connectivity of any two nodes is the
    smallest value on the path between them."""

    def kernel(g: Graph) -> list[tuple]:
        cap = [dict.fromkeys(r, 1.0) for r in g.both()]
        parent, value = [0] * g.n, [0.0] * g.n
        for i in range(1, g.n):
            value[i], side = _flow(cap, i, parent[i])
            for j in range(i + 1, g.n):
                if j in side and parent[j] == parent[i]:
                    parent[j] = i
        return [(g.keys[i], g.keys[parent[i]], int(value[i])) for i in range(1, g.n)]

    return run(net, kernel, "ego KEY, alter KEY, connectivity long")


def _vertex_cut(adj: list[set[int]], nodes: set[int]) -> tuple[int, set[int]]:
    """Vertex connectivity of the induced subgraph and a smallest cut (empty for a complete graph)."""
    order = sorted(nodes, key=lambda v: (len(adj[v] & nodes), v))
    best, cut = len(nodes) - 1, set()
    big = float(len(nodes))
    at = {v: i for i, v in enumerate(order)}

    def local(s: int, t: int) -> tuple[float, set[int]]:
        cap: list[dict[int, float]] = [{} for _ in range(2 * len(order))]
        for v in order:
            cap[2 * at[v]][2 * at[v] + 1] = big if v in (s, t) else 1.0
            for w in adj[v] & nodes:
                cap[2 * at[v] + 1][2 * at[w]] = big
        flow, side = _flow(cap, 2 * at[s] + 1, 2 * at[t])
        return flow, {order[x // 2] for x in side if x % 2 == 0 and x + 1 not in side and order[x // 2] not in (s, t)}

    s = order[0]
    pairs = [(s, t) for t in order if t != s and t not in adj[s]]
    near = sorted(adj[s] & nodes)
    pairs += [(a, b) for i, a in enumerate(near) for b in near[i + 1 :] if b not in adj[a]]
    for a, b in pairs:
        flow, where = local(a, b)
        if flow < best:
            best, cut = int(flow), where
    return best, cut


def _parts(adj: list[set[int]], nodes: set[int]) -> list[set[int]]:
    out, left = [], set(nodes)
    while left:
        seen = layer = {min(left)}
        while layer:
            layer = set().union(*(adj[v] & nodes for v in layer)) - seen
            seen = seen | layer
        out.append(seen)
        left -= seen
    return out


def cohesive_blocks(net: Network) -> DataFrame:
    """block, node, connectivity: Moody and White's hierarchy: each set of higher connectivity than its parent."""

    def kernel(g: Graph) -> list[tuple]:
        adj = [set(a) for a in g.both()]
        out: dict[frozenset[int], int] = {}

        def visit(nodes: set[int], least: int) -> None:
            if len(nodes) <= least:
                return
            k, cut = _vertex_cut(adj, nodes)
            if k >= least and frozenset(nodes) not in out:
                out[frozenset(nodes)] = k
            for part in _parts(adj, nodes - cut) if cut else []:
                visit(part | cut if k >= least else part | cut, max(least, k + 1) if k >= least else least)

        visit(set(range(g.n)), 1)
        return [(",".join(str(g.keys[v]) for v in sorted(b)), g.keys[v], k) for b, k in sorted(out.items(), key=lambda x: sorted(x[0])) for v in sorted(b)]

    return run(net, kernel, "block string, node KEY, connectivity long")


def k_components(net: Network, k: int = 2) -> DataFrame:
    """block, node: maximal sets of vertex connectivity ``k`` or more."""

    def kernel(g: Graph) -> list[tuple]:
        adj = [set(a) for a in g.both()]
        out: set[frozenset[int]] = set()

        def visit(nodes: set[int]) -> None:
            if len(nodes) < k + 1:
                return
            c, cut = _vertex_cut(adj, nodes)
            if c >= k:
                out.add(frozenset(nodes))
                return
            for part in _parts(adj, nodes - cut):
                visit(part | cut)

        visit(set(range(g.n)))
        out = {b for b in out if not any(b < c for c in out)}
        return [(",".join(str(g.keys[v]) for v in sorted(b)), g.keys[v]) for b in sorted(out, key=sorted) for v in sorted(b)]

    return run(net, kernel, "block string, node KEY")


def _largest_matching(start: np.ndarray, to: np.ndarray, columns: int) -> np.ndarray:
    """The column of each row, or -1: Hopcroft and Karp's phases from a greedy start."""
    rows = len(start) - 1
    mate, row_of = np.full(rows, -1), np.full(columns, -1)
    for i in range(rows):
        near = to[start[i] : start[i + 1]]
        free = near[row_of[near] < 0]
        if len(free):
            mate[i], row_of[free[0]] = free[0], i
    a, ends, flat = Arrays(None, start, to, to, to), start.tolist(), to.tolist()
    while True:
        level, front, depth, found = np.full(rows, -1), np.flatnonzero(mate < 0), 0, False
        level[front] = 0
        while len(front):
            owner = row_of[a.arcs_of(front)[1]]
            if (owner < 0).any():
                found = True
                break
            front = np.unique(owner)
            front = front[level[front] < 0]
            depth += 1
            level[front] = depth
        if not found:
            return mate
        at, of, mine, lev = ends[:-1], row_of.tolist(), mate.tolist(), level.tolist()
        for root in np.flatnonzero(mate < 0).tolist():
            path = [root]
            while path:
                i = path[-1]
                if at[i] == ends[i + 1]:
                    path.pop()
                    continue
                j = flat[at[i]]
                at[i] += 1
                if of[j] < 0:
                    for i in reversed(path):
                        mine[i], of[j], j = j, i, mine[i]
                    break
                if lev[of[j]] == lev[i] + 1:
                    path.append(of[j])
        mate, row_of = np.array(mine), np.array(of)


def _heaviest_matching(start: np.ndarray, to: np.ndarray, value: np.ndarray, columns: int) -> np.ndarray:
    """The column of each row, or -1: shortest augmenting paths by reduced costs over ties only; a row may stay alone."""
    rows = len(start) - 1
    u, v, mate, row_of = np.zeros(rows), np.zeros(columns), np.full(rows, -1), np.full(columns, -1)
    least, before, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
    for root in range(rows):
        i, low, seen, tree, closed, alone = root, 0.0, [], [root], [], (np.inf, -1)
        while True:
            near = to[start[i] : start[i + 1]]
            cost = low - value[start[i] : start[i + 1]] - u[i] - v[near]
            better = (cost < least[near]) & ~done[near]
            near, cost = near[better], cost[better]
            seen.append(near[np.isinf(least[near])])
            least[near], before[near] = cost, i
            alone = min(alone, (low - u[i], i))
            open_ = np.concatenate(seen)
            open_ = open_[~done[open_]]
            j = int(open_[np.argmin(least[open_])]) if len(open_) else -1
            if j < 0 or alone[0] <= least[j]:
                low, i, j = *alone, -1
                break
            low = least[j]
            done[j] = True
            closed.append(j)
            if row_of[j] < 0:
                i = int(before[j])
                break
            i = int(row_of[j])
            tree.append(i)
        for r in tree[1:]:
            u[r] += low - least[mate[r]]
        u[root] += low
        shut = np.array(closed, np.int64)
        v[shut] -= low - least[shut]
        while True:
            mate[i], j = j, mate[i]
            if mate[i] >= 0:
                row_of[mate[i]] = i
            if i == root:
                break
            i = int(before[j])
        touched = np.concatenate(seen)
        least[touched], done[touched] = np.inf, False
    return mate


def matching(net: Network, weighted: bool = False) -> DataFrame:
    """ego, alter of a largest matching of a two-mode network (Hopcroft and Karp), or the one of largest value (Hungarian,
    over ties only), from the mode with fewer nodes. Sequential: one task holds the ties, 40 bytes each."""
    net.need(two_mode=True)
    arcs = net.ties.where("value > 0") if weighted else net.ties
    rows, _ = pooled(net, arcs, net.nodes.where("mode = 1"))

    def kernel(a: Arrays) -> list:
        if 2 * a.marked.sum() > a.n:
            a = a.reversed()
        mine = np.flatnonzero(np.diff(a.start))
        start = np.concatenate([[0], a.start[mine + 1]])
        mate = _heaviest_matching(start, a.to, a.weight, a.n) if weighted else _largest_matching(start, a.to, a.n)
        on = mate >= 0
        ends = np.sort(np.stack([mine[on], mate[on]], 1), axis=1)
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
        return [a.keys.take(ends[:, 0]), a.keys.take(ends[:, 1])]

    return one_task(net, rows, kernel, "ego KEY, alter KEY")


def whole(net: Network, kernel: Callable[[list, np.ndarray], list[tuple]], schema: str, most: int = 6_000) -> DataFrame:
    """A kernel on the dense matrix of the whole network, refused above ``most`` nodes."""
    from tiegraph.operators.transform import dyads

    n = net.n_nodes()
    if n > most:
        raise NetworkError(f"{n} nodes; this method takes {most}")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    schema = schema.replace("KEY", dict(net.nodes.dtypes)["node"])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(pdf["ego"].unique())
        at = {k: i for i, k in enumerate(keys)}
        m = np.zeros((len(keys), len(keys)))
        m[pdf["ego"].map(at), pdf["alter"].map(at)] = pdf["value"].fillna(0)
        return pd.DataFrame(kernel(keys, m), columns=names)

    return dyads(net, selfloop=True).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(apply, schema)


def _ideal_fit(m: np.ndarray, ideal: np.ndarray) -> float:
    off = ~np.eye(len(m), dtype=bool)
    a, b = m[off], ideal[off]
    return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else -1.0


def core_periphery(net: Network, restarts: int = 5, seed: int = 1) -> DataFrame:
    """node, core (1 or 0), fit: the split whose ideal pattern (core tied with core, periphery with none) correlates most."""

    def kernel(keys: list, m: np.ndarray) -> list[tuple]:
        rng, n = np.random.default_rng(seed), len(keys)
        best, fit = np.zeros(n, bool), -2.0
        for k in range(restarts):
            core = (m.sum(0) + m.sum(1)) > np.median(m.sum(0) + m.sum(1)) if k == 0 else rng.random(n) < 0.5
            now = _ideal_fit(m, np.outer(core, core).astype(float))
            while True:
                tries = []
                for i in range(n):
                    core[i] ^= True
                    tries.append(_ideal_fit(m, np.outer(core, core).astype(float)))
                    core[i] ^= True
                i = int(np.argmax(tries))
                if tries[i] <= now + 1e-12:
                    break
                core[i] ^= True
                now = tries[i]
            if now > fit + 1e-12:
                best, fit = core.copy(), now
        return [(k, int(c), fit) for k, c in zip(keys, best, strict=True)]

    return whole(net, kernel, "node KEY, core int, fit double", 2_000)


def factions(net: Network, groups: int = 2, restarts: int = 5, seed: int = 1) -> DataFrame:
    """node, faction, fit: groups whose ideal pattern (tied inside, not between) correlates most with the network."""

    def kernel(keys: list, m: np.ndarray) -> list[tuple]:
        rng, n = np.random.default_rng(seed), len(keys)
        best, fit = np.zeros(n, int), -2.0
        for _ in range(restarts):
            g = rng.integers(0, groups, n)
            now = _ideal_fit(m, (g[:, None] == g).astype(float))
            moved = True
            while moved:
                moved = False
                for i in rng.permutation(n):
                    old = g[i]
                    for c in range(groups):
                        g[i] = c
                        f = _ideal_fit(m, (g[:, None] == g).astype(float))
                        if f > now + 1e-12:
                            now, old, moved = f, c, True
                    g[i] = old
            if now > fit + 1e-12:
                best, fit = g.copy(), now
        names = {c: i + 1 for i, c in enumerate(dict.fromkeys(best.tolist()))}
        return [(k, names[c], fit) for k, c in zip(keys, best.tolist(), strict=True)]

    return whole(net, kernel, "node KEY, faction int, fit double", 2_000)


def concor(net: Network, splits: int = 1, rounds: int = 50) -> DataFrame:
    """node, block: repeated correlation of the columns of the network over its transpose, bisected by sign."""

    def kernel(keys: list, m: np.ndarray) -> list[tuple]:
        block = np.zeros(len(keys), int)
        for _ in range(splits):
            new = block * 2
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                if len(at) < 2:
                    continue
                x = np.vstack([m[:, at], m[at].T])
                with np.errstate(all="ignore"):
                    c = np.nan_to_num(np.corrcoef(x.T), nan=0.0)
                    for _ in range(rounds):
                        d = np.nan_to_num(np.corrcoef(c), nan=0.0)
                        if np.abs(d - c).max() < 1e-9:
                            break
                        c = d
                new[at] += (c[0] <= 0).astype(int)
            block = new
        names = {c: i + 1 for i, c in enumerate(dict.fromkeys(block.tolist()))}
        return [(k, names[c]) for k, c in zip(keys, block.tolist(), strict=True)]

    return whole(net, kernel, "node KEY, block int", 2_000)


def hierarchy(net: Network, groups: int = 2, linkage: str = "single") -> DataFrame:
    """node, group: agglomerative clustering of Euclidean out-profile distances: single, complete or average linkage."""

    def kernel(keys: list, m: np.ndarray) -> list[tuple]:
        n = len(keys)
        d = np.sqrt(np.maximum((m**2).sum(1)[:, None] + (m**2).sum(1) - 2 * m @ m.T, 0))
        np.fill_diagonal(d, np.inf)
        sets = {i: [i] for i in range(n)}
        while len(sets) > groups:
            i, j = divmod(int(np.argmin(d)), n)
            i, j = min(i, j), max(i, j)
            a, b = len(sets[i]), len(sets[j])
            row = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (a * d[i] + b * d[j]) / (a + b)}[linkage]
            d[i], d[:, i] = row, row
            d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
            sets[i] += sets.pop(j)
        return sorted((keys[v], g) for g, s in enumerate(sets.values(), 1) for v in s)

    return whole(net, kernel, "node KEY, group int", 3_000)


def spectral(net: Network) -> DataFrame:
    """node, fiedler, side, eigenvalue (the node's place in the ascending Laplacian spectrum), algebraic_connectivity. All
    eigenvalues are exact, so one task holds the dense matrix (8 bytes a pair of nodes, thrice in the solver)."""
    rows, _ = pooled(net, net.ties.where("ego <> alter"))

    def kernel(a: Arrays) -> list:
        w = np.zeros((a.n, a.n))
        np.maximum.at(w, (a.source, a.to), a.weight)
        np.maximum(w, w.T, out=w)
        degree = w.sum(1)
        np.negative(w, out=w)
        w[np.arange(a.n), np.arange(a.n)] = degree
        values, vectors = np.linalg.eigh(w)
        f = vectors[:, min(1, a.n - 1)]
        f = f * (1 if f[np.argmax(np.abs(f))] > 0 else -1)
        return [a.keys, f, (f >= 0).astype(np.int32), values, np.full(a.n, values[min(1, a.n - 1)])]

    return one_task(net, rows, kernel, "node KEY, fiedler double, side int, eigenvalue double, algebraic_connectivity double")


def layout(net: Network, kind: str = "fr", rounds: int = 100, seed: int = 1) -> DataFrame:
    """node, x, y: circle, grid, fr (spring forces), mds (classical scaling of hop distances) or kk (Kamada and Kawai's
    springs as long as the hop distances, by majorization from the mds places)."""

    def kernel(keys: list, m: np.ndarray) -> list[tuple]:
        n = len(keys)
        if kind == "circle":
            a = 2 * np.pi * np.arange(n) / max(n, 1)
            xy = np.stack([np.cos(a), np.sin(a)], 1)
        elif kind == "grid":
            side = int(np.ceil(np.sqrt(n)))
            xy = np.stack(divmod(np.arange(n), side), 1).astype(float)
        elif kind in ("mds", "kk"):
            tied = (np.maximum(m, m.T) > 0) & ~np.eye(n, dtype=bool)
            d = np.full((n, n), float(n))
            reach = np.eye(n, dtype=bool)
            d[reach] = 0
            for k in range(1, n):
                new = (reach @ tied) & ~(d < n)
                if not new.any():
                    break
                d[new] = k
                reach = new
            j = np.eye(n) - 1 / n
            values, vectors = np.linalg.eigh(-0.5 * j @ d**2 @ j)
            xy = vectors[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 0))
            if kind == "kk" and n > 1:
                xy = xy + np.random.default_rng(seed).normal(0, 1e-3, xy.shape)
                w = 1 / np.maximum(d, 1) ** 2
                np.fill_diagonal(w, 0)
                inverse = np.linalg.pinv(np.diag(w.sum(1)) - w)
                for _ in range(10 * rounds):
                    far = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
                    pull = np.where(far > 1e-9, w * d / np.maximum(far, 1e-9), 0)
                    new_xy = inverse @ ((np.diag(pull.sum(1)) - pull) @ xy)
                    done = np.abs(new_xy - xy).max() < 1e-9
                    xy = new_xy
                    if done:
                        break
        else:
            rng = np.random.default_rng(seed)
            xy, w, k = rng.random((n, 2)), (np.maximum(m, m.T) > 0).astype(float), np.sqrt(1 / max(n, 1))
            for t in np.linspace(0.1, 0.001, rounds):
                diff = xy[:, None] - xy[None]
                dist = np.maximum(np.sqrt((diff**2).sum(-1)), 1e-6)
                force = (diff * (k * k / dist**2 - w * dist / k)[..., None]).sum(1)
                size = np.maximum(np.sqrt((force**2).sum(1, keepdims=True)), 1e-9)
                xy = xy + force / size * np.minimum(size, t)
        return [(key, float(a), float(b)) for key, (a, b) in zip(keys, xy, strict=True)]

    return whole(net, kernel, "node KEY, x double, y double")


def _in_rows(nodes: DataFrame, level: str) -> DataFrame:
    """(node, level, place): nodes spread evenly from 0 to 1 along their level, in order of their keys."""
    from tiegraph.network import dense_ids

    ids = dense_ids(nodes.select(F.struct(level, "node").alias("node"))).select("node.*", "id")
    ends = ids.groupBy(level).agg(F.min("id").alias("_from"), F.count("*").alias("_n"))
    return ids.join(F.broadcast(ends), level).select("node", level, ((F.col("id") - F.col("_from") + 0.5) / F.col("_n")).alias("place"))


def layout_bipartite(net: Network) -> DataFrame:
    """node, x, y of a two-mode network: one mode at x 0, the other at x 1."""
    net.need(two_mode=True)
    return _in_rows(net.nodes.select("mode", "node"), "mode").select("node", (F.col("mode") - 1).cast("double").alias("x"), F.col("place").alias("y"))


def layout_hierarchy(net: Network) -> DataFrame:
    """node, x, y: a row for each number of steps from the nodes that nobody names (directed), or from the first node of
    each component; what they don't reach is in the top row."""
    from tiegraph.operators import iterate

    if net.directed:
        tops = net.nodes.select("node").join(net.arcs.where("ego <> alter").select(F.col("alter").alias("node")), "node", "left_anti")
    else:
        tops = iterate.components(net).groupBy("component").agg(F.min("node").alias("node")).select("node")
    arcs = net.arcs.where("ego <> alter").select("ego", "alter")
    layer = known = materialize(tops.select("node", F.lit(0).alias("level")), "levels")
    while True:
        step = layer.join(arcs, F.col("node") == F.col("ego")).select(F.col("alter").alias("node"), (F.col("level") + 1).alias("level")).distinct()
        layer = materialize(step.join(known.select("node"), "node", "left_anti"), "levels")
        if layer.isEmpty():
            break
        known = known.unionByName(layer)
    levels = net.nodes.select("node").join(known, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
    return _in_rows(levels, "level").select("node", F.col("place").alias("x"), (-F.col("level")).cast("double").alias("y"))


def two_mode_communities(net: Network, trials: int = 5, seed: int = 1) -> DataFrame:
    """node, community of a two-mode network: alternating label updates by Barber's gain over the whole network, then merges
    that raise it; the best of some trials. The task of each trial holds the network, about 100 bytes an arc."""
    net.need(two_mode=True)
    arcs = net.arcs.where("value > 0")
    rows, _ = pooled(net, arcs, net.nodes.where("mode = 1"))

    def kernel(a: Arrays, trial: int) -> tuple[float, list]:
        rng = np.random.default_rng((seed, trial))
        source, first = a.source, a.marked
        k = np.bincount(source, a.weight, a.n)
        m = a.weight.sum() / 2 or 1.0

        def sides(lab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Weight between the first mode of each community and the second of each other, and both modes' totals."""
            c = int(lab.max()) + 1
            one = first[source]
            between = np.bincount(lab[source[one]] * c + lab[a.to[one]], a.weight[one], c * c).reshape(c, c)
            return between, np.bincount(lab[first], k[first], c), np.bincount(lab[~first], k[~first], c)

        def q(lab: np.ndarray) -> float:
            c = int(lab.max()) + 1
            same = first[source] & (lab[source] == lab[a.to])
            return float((a.weight[same].sum() - (np.bincount(lab[first], k[first], c) * np.bincount(lab[~first], k[~first], c)).sum() / m) / m)

        def update(lab: np.ndarray, mine: np.ndarray) -> None:
            """Every node of one mode to the neighbouring label of largest gain, the lowest of equal ones."""
            c = int(lab.max()) + 1
            total = np.bincount(lab[~mine], k[~mine], c)
            on = mine[source]
            pair, at = np.unique(source[on] * c + lab[a.to[on]], return_inverse=True)
            i, l = pair // c, pair % c
            gain = np.bincount(at, a.weight[on], len(pair)) - k[i] * total[l] / m
            order = np.lexsort((-l, np.round(gain, 12), i))
            last = np.flatnonzero(np.concatenate([i[order][1:] != i[order][:-1], [True]])) if len(order) else order
            lab[i[order[last]]] = l[order[last]]

        lab = rng.permutation(a.n)
        now = -2.0
        for _ in range(200):
            old = lab.copy()
            for mine in (~first, first):
                update(lab, mine)
            new = q(lab)
            if new <= now + 1e-12:
                lab = old if new < now else lab
                break
            now = new
        lab = _dense(lab)
        between, t1, t2 = sides(lab)
        gain = between + between.T - (np.outer(t1, t2) + np.outer(t2, t1)) / m
        np.fill_diagonal(gain, -1.0)
        while gain.size and gain.max() > 1e-12 * m:
            x, y = sorted(divmod(int(np.argmax(gain)), len(gain)))
            lab[lab == y] = x
            gain[x] += gain[y]
            gain[:, x] = gain[x]
            gain[y], gain[:, y], gain[x, x] = -1.0, -1.0, -1.0
        return round(q(lab), 12), _labelled(a, _dense(lab))

    return best_trial(net, rows, kernel, "node KEY, community KEY", trials)


def induced_centrality(net: Network, measure: str = "degree") -> DataFrame:
    """node, endogenous, induced, exogenous: a node's own score, the drop of the network's total when it goes, and the
    rest. For degree the drop is twice the degree; betweenness removes each node in turn, the nodes shared out to tasks
    (networks of at most LOCAL_ROWS rows)."""
    if measure == "degree":
        d = net.links.groupBy(F.col("ego").alias("node")).agg(F.count("*").cast("double").alias("d"))
        out = net.nodes.select("node").join(d, "node", "left").fillna({"d": 0.0})
        return out.select("node", F.col("d").alias("endogenous"), (2 * F.col("d")).alias("induced"), F.col("d").alias("exogenous"))
    rows, size = pooled(net, _positive(net, False))
    if size > LOCAL_ROWS:
        raise NetworkError("induced betweenness takes networks of at most LOCAL_ROWS rows")

    def kernel(a: Arrays, mine: np.ndarray) -> Iterator[list]:
        every, source = np.arange(a.n), a.source
        own = local.brandes(a, every)
        out = []
        for v in mine:
            on = (source != v) & (a.to != v)
            start = np.concatenate([[0], np.cumsum(np.bincount(source[on], minlength=a.n))])
            drop = (own.sum() - local.brandes(Arrays(a.keys, start, a.to[on], a.weight[on], a.marked), every).sum()) / 2
            out.append((own[v] / 2, drop, drop - own[v] / 2))
        if out:
            yield [a.keys.take(mine), *np.array(out).T]

    return per_source(net, rows, kernel, "node KEY, endogenous double, induced double, exogenous double")
