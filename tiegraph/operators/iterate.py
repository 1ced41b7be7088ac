"""Fix points. Networks within ``local.LOCAL_ROWS`` are iterated on arrays in one task or in blocks of sources; larger
ones by loops of joins, whose state is written to the shared folder. Both give the same results; a loop that doesn't
settle in its rounds raises. ``local_rows=0`` forces the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError, dense_ids, symmetrized
from tiegraph.operators import local
from tiegraph.operators.components import connected_components
from tiegraph.operators.local import LOCAL_ROWS, SOURCE_ROWS, Arrays, arcs_in, one_task, per_source, pooled
from tiegraph.operators.measures import _per_node
from tiegraph.plans.lineage import Rounds, materialize

#: Pairs of sources and nodes whose distances a block of joins keeps at once.
BLOCK_PAIRS = 200_000_000
#: Nodes whose bits of a block of sources are unpacked into rows at once.
_WAVE_NODES = 512


def _ties(net: Network) -> DataFrame:
    return net.ties.where("ego <> alter").select("ego", "alter", "value")


def components(net: Network, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, component: weak components numbered from 1 by their smallest node; isolates are components."""
    rows, size = pooled(net, _ties(net))

    def kernel(a: Arrays) -> list:
        return [a.keys, np.unique(local.component_labels(a.n, a.source, a.to), return_inverse=True)[1] + 1]

    if size <= local_rows:
        return one_task(net, rows, kernel, "node KEY, component long")
    every = _per_node(net, connected_components(arcs_in(rows))).select("node", F.coalesce("component", "node").alias("root"))
    order = dense_ids(every.select(F.col("root").alias("node")).distinct()).select(F.col("node").alias("root"), F.col("id").alias("component"))
    return every.join(order, "root").select("node", "component")


def component_sizes(net: Network, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """component, size, share of all nodes."""
    c = components(net, local_rows).groupBy("component").agg(F.count("*").alias("size"))
    return c.crossJoin(F.broadcast(net.nodes.agg(F.count("*").alias("_n")))).select("component", "size", (F.col("size") / F.col("_n")).alias("share"))


def largest_component(net: Network, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, lgc: 1 in the largest component (the lowest number of equal ones)."""
    c = components(net, local_rows)
    top = c.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1).select("component", F.lit(1).alias("lgc"))
    return c.join(F.broadcast(top), "component", "left").select("node", F.coalesce("lgc", F.lit(0)).alias("lgc"))


def _cost_arcs(net: Network, alpha: float | None, symmetric: bool) -> tuple[DataFrame, bool]:
    """Arcs with their costs as values, and whether all cost 1."""
    alpha = (1.0 if net.valued else 0.0) if alpha is None else alpha
    if symmetric or alpha == 0:
        return (net.links if symmetric else net.arcs.where("ego <> alter")).select("ego", "alter", F.lit(1.0).alias("value")), True
    return net.arcs.where("ego <> alter and value > 0").select("ego", "alter", F.pow("value", F.lit(-alpha)).alias("value")), False


def _rounds_of_joins(rows: DataFrame, start: DataFrame, unit: bool, max_rounds: int) -> DataFrame:
    """(source, node, distance) from ``start`` (source), itself included. Each round extends the pairs that got nearer."""
    arcs = arcs_in(rows)
    known = frontier = materialize(start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance")), "distances")
    for _ in range(max_rounds):
        step = frontier.join(arcs, F.col("node") == F.col("ego")).groupBy("source", F.col("alter").alias("node")).agg(F.min(F.col("distance") + F.col("value")).alias("distance"))
        if unit:
            frontier = materialize(step.join(known, ["source", "node"], "left_anti").select("source", "node", "distance"), "distances")
            if frontier.isEmpty():
                return known
            known = known.unionByName(frontier)
        else:
            old = known.withColumnRenamed("distance", "old")
            nearer = materialize(step.join(old, ["source", "node"], "left").where("old is null or distance < old - 1e-12").select("source", "node", "distance"), "distances")
            if nearer.isEmpty():
                return known
            known = materialize(known.join(nearer, ["source", "node"], "left_anti").unionByName(nearer), "distances")
            frontier = nearer
    raise NetworkError("distances did not settle")


def _blocks(net: Network, rows: DataFrame) -> Iterator[DataFrame]:
    """The marked sources in blocks that keep at most BLOCK_PAIRS distances."""
    start = rows.where("alter is null and value > 0").select(F.col("ego").alias("source"))
    n = -(-start.count() * net.n_nodes() // BLOCK_PAIRS) or 1
    for k in range(n):
        yield start.where(F.pmod(F.xxhash64("source"), F.lit(n)) == k)


def geodesics(net: Network, sources: DataFrame | None = None, alpha: float | None = None, symmetric: bool = False, max_rounds: int = 10_000, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """source, node, distance of reachable pairs (source itself left out). Hops, or with ``alpha`` (default 1 on a valued
    network) least sums of value^-alpha over ties of positive value. Pairs are streamed, block of sources by block."""
    arcs, unit = _cost_arcs(net, alpha, symmetric)
    rows, size = pooled(net, arcs, sources)

    def kernel(a: Arrays, mine: np.ndarray) -> Iterator[list]:
        if unit:
            back = a.reversed()
            for block in local.wave_blocks(a, mine):
                for d, (nodes, bits) in enumerate(local.waves(a, back, block), 1):
                    for k in range(0, len(nodes), _WAVE_NODES):
                        at, of = np.nonzero(np.unpackbits(bits[k : k + _WAVE_NODES].view(np.uint8), axis=1, bitorder="little"))
                        yield [a.keys.take(block[of]), a.keys.take(nodes[k + at]), np.full(len(at), float(d))]
            return
        for s in mine:
            d = local.costs(a, s, a.weight)
            d[s] = np.inf
            at = np.flatnonzero(np.isfinite(d))
            if len(at):
                yield [a.keys.take(np.full(len(at), s)), a.keys.take(at), d[at]]

    if size <= local_rows:
        return per_source(net, rows, kernel, "source KEY, node KEY, distance double")
    out = None
    for block in _blocks(net, rows):
        known = _rounds_of_joins(rows, block, unit, max_rounds).where("source <> node")
        out = known if out is None else out.unionByName(known)
    return out


def _per_source_sums(net: Network, alpha: float | None, symmetric: bool, decay: float | None, sources: DataFrame | None = None, max_rounds: int = 10_000, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """node, reached, farness, eccentricity, decayed (sum of decay^distance): no table of pairs is made."""
    arcs, unit = _cost_arcs(net, alpha, symmetric)
    rows, size = pooled(net, arcs, sources)

    def sums(d: np.ndarray, count: np.ndarray | int) -> tuple:
        return (count * np.ones(len(d))).sum(), (count * d).sum(), d.max(initial=0.0), (count * (decay or 0.0) ** d).sum() if decay is not None else 0.0

    def kernel(a: Arrays, mine: np.ndarray) -> Iterator[list]:
        back = a.reversed() if unit else None
        for block in local.wave_blocks(a, mine):
            out = np.zeros((4, len(block)))
            if unit:
                counts = [local.bit_counts(bits)[: len(block)] for _, bits in local.waves(a, back, block)]
                for k, count in enumerate(np.array(counts).reshape(len(counts), len(block)).T):
                    far = np.flatnonzero(count)
                    out[:, k] = sums(far + 1.0, count[far])
            else:
                for k, s in enumerate(block):
                    d = local.costs(a, s, a.weight)
                    out[:, k] = sums(d[np.isfinite(d) & (np.arange(a.n) != s)], 1)
            yield [a.keys.take(block), out[0].astype(np.int64), *out[1:]]

    if size <= local_rows:
        g = per_source(net, rows, kernel, "node KEY, reached long, farness double, eccentricity double, decayed double")
        return g.where("reached > 0")
    out = None
    for block in _blocks(net, rows):
        known = _rounds_of_joins(rows, block, unit, max_rounds).where("source <> node")
        decayed = F.sum(F.pow(F.lit(decay), F.col("distance"))) if decay is not None else F.lit(0.0)
        sums = materialize(known.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reached"), F.sum("distance").alias("farness"), F.max("distance").alias("eccentricity"), decayed.alias("decayed")), "distance-sums")
        out = sums if out is None else out.unionByName(sums)
    return out


def geodesic_summary(net: Network, alpha: float | None = None, symmetric: bool = False, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """node, reached, farness (sum), eccentricity from each source."""
    return _per_node(net, _per_source_sums(net, alpha, symmetric, None, local_rows=local_rows).drop("decayed"), {"reached": 0})


def reach(net: Network, sources: DataFrame | None = None) -> DataFrame:
    """source, node: who reaches whom."""
    return geodesics(net, sources, alpha=0.0).select("source", "node")


def closeness(net: Network, legacy: bool = False, alpha: float | None = None, symmetric: bool = False, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """node, farness, nearness, closeness: reached/farness, or (n-1)/farness with ``legacy``; two-mode networks take
    (other mode + 2 (own mode - 1))/farness when all are reached."""
    g = geodesic_summary(net, alpha, symmetric, local_rows)
    n = net.n_nodes()
    g = g.select("node", "farness", (1 / F.col("farness")).alias("nearness"), "reached")
    if net.two_mode:
        m = net.nodes.groupBy("mode").agg(F.count("*").alias("own"))
        g = g.join(net.nodes.select("node", "mode"), "node").join(F.broadcast(m), "mode")
        full = (n - F.col("own") + 2 * (F.col("own") - 1)) / F.col("farness")
        return g.select("node", "farness", "nearness", F.when(F.col("reached") == n - 1, full).otherwise(F.col("reached") / F.col("farness")).alias("closeness"))
    top = F.lit(n - 1) if legacy else F.col("reached")
    return g.select("node", "farness", "nearness", (top / F.col("farness")).alias("closeness"))


def katz_decay(net: Network, alpha: float = 1.0, symmetric: bool = False, cost: float | None = None, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """node, katz: sum of alpha^distance over the nodes it reaches."""
    g = _per_source_sums(net, cost, symmetric, alpha, local_rows=local_rows).select("node", F.col("decayed").alias("katz"))
    return _per_node(net, g, {"katz": 0.0})


def utility(net: Network, benefit: float = 0.5, cost: float = 0.1, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """node, utility: sum of benefit^distance minus cost times degree."""
    d = net.arcs.where("ego <> alter").groupBy(F.col("ego").alias("node")).agg(F.count("*").alias("d"))
    g = _per_source_sums(net, 0.0, False, benefit, local_rows=local_rows).select("node", F.col("decayed").alias("b"))
    return _per_node(net, g, {"b": 0.0}).join(d, "node", "left").select("node", (F.col("b") - cost * F.coalesce("d", F.lit(0))).alias("utility"))


def _times(arcs: DataFrame, x: DataFrame, value: Column) -> DataFrame:
    """(node, s): sums over a node's arcs of the value times the x of their other end."""
    return arcs.join(x.select(F.col("node").alias("alter"), "x"), "alter").groupBy(F.col("ego").alias("node")).agg(F.sum(value * F.col("x")).alias("s"))


def katz_walks(net: Network, alpha: float, tol: float = 1e-10, max_rounds: int = 500, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, katz: solution of (I - alpha M) x = 1 by iteration; fails if alpha times the spectral radius is 1 or more."""
    rows, size = pooled(net, net.arcs.where("ego <> alter"))
    slow = "alpha is too large: the walks do not converge"

    def kernel(a: Arrays) -> list:
        source, x = a.source, np.ones(a.n)
        for _ in range(max_rounds):
            new = 1 + alpha * np.bincount(source, a.weight * x[a.to], a.n)
            diff, x = np.abs(new - x).max(initial=0.0), new
            if diff <= tol:
                return [a.keys, x]
            if not np.abs(x).max() < 1e12:
                break
        raise NetworkError(slow)

    if size <= local_rows:
        return one_task(net, rows, kernel, "node KEY, katz double")
    arcs, state = arcs_in(rows), Rounds("katz")
    x = state.keep(net.nodes.select("node", F.lit(1.0).alias("x")))
    for _ in range(max_rounds):
        new = state.keep(x.join(_times(arcs, x, F.col("value")), "node", "left").select("node", F.col("x").alias("old"), (1 + alpha * F.coalesce("s", F.lit(0.0))).alias("x")))
        diff, top = new.agg(F.max(F.abs(F.col("x") - F.col("old"))), F.max(F.abs("x"))).head()
        x = new.select("node", "x")
        if diff is None or diff <= tol:
            return x.withColumnRenamed("x", "katz")
        if top > 1e12:
            break
    raise NetworkError(slow)


def pagerank(net: Network, damping: float = 0.85, tol: float = 1e-10, max_rounds: int = 1000, weighted: bool = True, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, pagerank. Out-weights are shared by value; the mass of nodes without out-ties is spread evenly.

    That is the solution of x = 1 + damping P'x divided by its sum, P having empty rows for nodes without out-ties: no
    mass has to be gathered in a round. Three rounds are one job in the joined form.
    """
    arcs = net.arcs.where("ego <> alter").select("ego", "alter", F.col("value") if weighted else F.lit(1.0).alias("value"))
    rows, size = pooled(net, arcs)
    if not arcs_in(rows).where("value <= 0").isEmpty():
        raise NetworkError("weights must be positive")

    def kernel(a: Arrays) -> list:
        source = a.source
        p = damping * a.weight / np.bincount(source, a.weight, a.n)[source]
        x = np.ones(a.n)
        for _ in range(max_rounds):
            new = 1 + np.bincount(a.to, p * x[source], a.n)
            diff, x = np.abs(new - x).max(initial=0.0) / max(new.sum(), 1), new
            if diff < tol:
                return [a.keys, x / x.sum()]
        raise NetworkError("ranks did not settle")

    if size <= local_rows:
        return one_task(net, rows, kernel, "node KEY, pagerank double")
    total = arcs_in(rows).groupBy("ego").agg(F.sum("value").alias("all"))
    share = materialize(arcs_in(rows).join(total, "ego").select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), (damping * F.col("value") / F.col("all")).alias("p")), "shares")
    state = Rounds("rank")
    x = state.keep(net.nodes.select("node", F.lit(1.0).alias("x")))
    for _ in range(max(1, max_rounds // 3)):
        y = x
        for _ in range(3):
            y = y.select("node", F.col("x").alias("old")).join(_times(share, y, F.col("p")), "node", "left").select("node", "old", (1 + F.coalesce("s", F.lit(0.0))).alias("x"))
        y = state.keep(y)
        diff, total = y.agg(F.max(F.abs(F.col("x") - F.col("old"))), F.sum("x")).head()
        x = y.select("node", "x")
        if diff is None or diff / total < tol:
            return x.select("node", (F.col("x") / F.lit(total)).alias("pagerank"))
    raise NetworkError("ranks did not settle")


def _at_rest(steps: list[float], tol: float) -> bool:
    """Whether the steps are below ``tol`` and down to rounding: at most 1e-15, or none of the last five a new least one. A
    step of ``tol`` alone leaves an error of several times that, which shows in rounded results."""
    return steps[-1] < tol and (steps[-1] <= 1e-15 or len(steps) > 5 and min(steps[-5:]) >= min(steps[:-5]))


def eigenvector(net: Network, valued: bool = False, symmetric: bool = True, tol: float = 1e-10, max_rounds: int = 1000, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, evcent: power iteration on A + shift I, shift half the largest row sum, until steps below ``tol`` are down to
    rounding (or for ``max_rounds``); unit length, first node not negative. Symmetrised by the larger value; ties not
    positive are dropped; null everywhere without ties."""
    e = net.ties.where("ego <> alter and value > 0").select("ego", "alter", F.col("value") if valued else F.lit(1.0).alias("value"))
    if symmetric or not net.directed:
        e = symmetrized(e)
        e = e.unionByName(e.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), "value"))
    rows, size = pooled(net, e)

    def kernel(a: Arrays) -> list:
        source = a.source
        if not len(source):
            return [a.keys, np.full(a.n, np.nan)]
        shift, x, steps = np.bincount(source, a.weight, a.n).max() / 2, np.full(a.n, a.n**-0.5), [np.inf]
        while len(steps) <= max_rounds and not _at_rest(steps, tol):
            y = np.bincount(source, a.weight * x[a.to], a.n) + shift * x
            y /= np.sqrt((y * y).sum())
            steps.append(np.abs(y - x).max())
            x = y
        if steps[-1] < tol:
            return [a.keys, x]
        raise NetworkError("the vector did not settle")

    if size <= local_rows:
        return one_task(net, rows, kernel, "node KEY, evcent double").select("node", F.nanvl("evcent", F.lit(None).cast("double")).alias("evcent"))
    e = arcs_in(rows)
    top = e.groupBy("ego").agg(F.sum("value").alias("s")).agg(F.max("s")).head()[0]
    if top is None:
        return net.nodes.select("node", F.lit(None).cast("double").alias("evcent"))
    shift, n, state, steps = top / 2, net.n_nodes(), Rounds("evcent"), [np.inf]
    x = state.keep(net.nodes.select("node", F.lit(n**-0.5).alias("x")))
    while len(steps) <= max_rounds and not _at_rest(steps, tol):
        y = state.keep(x.join(_times(e, x, F.col("value")), "node", "left").select("node", "x", (F.coalesce("s", F.lit(0.0)) + shift * F.col("x")).alias("y")))
        # x has unit length: |y/norm - x| from moments would lose digits, so the length comes first
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).head()[0]
        steps.append(y.agg(F.max(F.abs(F.col("y") / norm - F.col("x")))).head()[0])
        x = y.select("node", (F.col("y") / norm).alias("x"))
    if steps[-1] < tol:
        return x.withColumnRenamed("x", "evcent")
    raise NetworkError("the vector did not settle")


def kcore(net: Network, max_rounds: int = 10_000, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, coreness, by peeling; on joins by repeated h-indices of the neighbours' values, which fall to it from the degree."""
    rows, size = pooled(net, net.links.withColumn("value", F.lit(1.0)))
    if size <= local_rows:
        return one_task(net, rows, lambda a: [a.keys, local.coreness(a.n, a.source, a.to)], "node KEY, coreness long")
    links, state = arcs_in(rows), Rounds("core")
    h = state.keep(links.groupBy(F.col("ego").alias("node")).agg(F.count("*").alias("h")))
    for _ in range(max_rounds):
        # the h-index from the counts of each value: the largest v with at least v neighbours of v or more
        near = links.join(h.select(F.col("node").alias("alter"), F.col("h").alias("v")), "alter").join(h.select(F.col("node").alias("ego"), "h"), "ego")
        c = near.groupBy("ego", F.least("v", "h").alias("v")).agg(F.count("*").alias("k"))
        at_least = c.select("ego", "v", F.sum("k").over(Window.partitionBy("ego").orderBy(F.desc("v"))).alias("s"))
        new = at_least.groupBy(F.col("ego").alias("node")).agg(F.max(F.least("v", "s")).alias("n"))
        both = state.keep(h.join(new, "node").select("node", F.col("n").alias("h"), (F.col("n") < F.col("h")).alias("fell")))
        h = both.select("node", "h")
        if both.where("fell").isEmpty():
            return _per_node(net, h.select("node", F.col("h").alias("coreness")), {"coreness": 0})
    raise NetworkError("coreness did not settle")


def label_propagation(net: Network, max_rounds: int = 500) -> DataFrame:
    """node, community: each round every node takes the label with the largest tie value among its neighbours and itself
    (ties by hash). In a round one half of the nodes moves, another in every round, so that labels don't swap for ever."""
    arcs = net.arcs.where("ego <> alter and value > 0")
    if net.directed:
        raise NetworkError("symmetrize the network first")
    arcs, state = materialize(arcs, "lp-ties"), Rounds("lp")
    lab = state.keep(net.nodes.select("node", F.col("node").alias("label")))
    for k in range(max_rounds):
        votes = arcs.join(lab.select(F.col("node").alias("alter"), "label"), "alter").groupBy("ego", "label").agg(F.sum("value").alias("w"))
        best = votes.groupBy(F.col("ego").alias("node")).agg(F.max(F.struct("w", F.xxhash64("label").alias("h"), F.col("label").alias("l"))).alias("b"))
        own = votes.select(F.col("ego").alias("node"), "label", F.col("w").alias("own"))
        both = lab.join(best.select("node", "b"), "node", "left").join(own, ["node", "label"], "left")
        turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        open_ = F.col("b").isNotNull() & (F.col("b.w") > F.coalesce("own", F.lit(0.0)))
        both = state.keep(both.select("node", F.when(turn & open_, F.col("b.l")).otherwise(F.col("label")).alias("label"), open_.alias("open")))
        lab = both.select("node", "label")
        if both.where("open").isEmpty():
            return lab.withColumnRenamed("label", "community")
    raise NetworkError("labels did not settle")


def hitting_time(net: Network, target: object, weighted: bool | None = None, tol: float = 1e-13, max_rounds: int = 5_000, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, hitting: expected steps of a random walk to the target; null where it can't get there.

    The walk is on the symmetrised network (the larger value, positive only) and moves by tie value, or evenly unless
    ``weighted`` (default: if the network is valued). (D - W) h = d with the target grounded is solved by conjugate
    gradients, preconditioned by D, to the relative residual ``tol``.
    """
    weighted = net.valued if weighted is None else weighted
    e = symmetrized(net.ties.where("ego <> alter and value > 0").select("ego", "alter", F.col("value") if weighted else F.lit(1.0).alias("value")))
    e = e.unionByName(e.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), "value"))
    rows, size = pooled(net, e, net.nodes.where(F.col("node") == F.lit(target)))

    def kernel(a: Arrays) -> list:
        at = np.flatnonzero(a.marked)
        if not len(at):
            return [a.keys, np.full(a.n, np.nan)]
        return [a.keys, local.solve_grounded(a.n, a.source, a.to, a.weight, int(at[0]), tol, max_rounds)]

    if size <= local_rows:
        return one_task(net, rows, kernel, "node KEY, hitting double").select("node", F.nanvl("hitting", F.lit(None).cast("double")).alias("hitting"))
    e, state = arcs_in(rows), Rounds("hitting")
    comp = connected_components(e)
    mine = comp.join(F.broadcast(comp.where(F.col("node") == F.lit(target)).select("component")), "component").select("node")
    here = F.col("node") != F.lit(target)
    deg = e.groupBy(F.col("ego").alias("node")).agg(F.sum("value").alias("d"))
    s = state.keep(mine.join(deg, "node").select("node", "d", F.lit(0.0).alias("h"), F.when(here, F.col("d")).otherwise(0.0).alias("res"), F.when(here, 1.0).otherwise(0.0).alias("x")))
    rz, bound = s.agg(F.sum(F.col("res") * F.col("x")), tol * F.sqrt(F.sum(F.col("res") * F.col("res")))).head()
    done = rz is None or rz == 0
    for _ in range(0 if done else max_rounds):
        q = s.join(_times(e, s, F.col("value")), "node", "left").select("*", F.when(here, F.col("d") * F.col("x") - F.coalesce("s", F.lit(0.0))).otherwise(0.0).alias("q")).drop("s")
        q = state.keep(q)
        step = rz / q.agg(F.sum(F.col("x") * F.col("q"))).head()[0]
        h, res = F.col("h") + step * F.col("x"), F.col("res") - step * F.col("q")
        rz2, left = q.agg(F.sum(res * res / F.col("d")), F.sqrt(F.sum(res * res))).head()
        s = q.select("node", "d", h.alias("h"), res.alias("res"), (res / F.col("d") + (rz2 / rz) * F.col("x")).alias("x"))
        rz = rz2
        if left <= bound:
            done = True
            break
    if not done:
        raise NetworkError("the walk's equations did not settle")
    return _per_node(net, state.keep(s).select("node", F.col("h").alias("hitting")))


def transposed(net: Network) -> Network:
    from tiegraph.operators.transform import transpose

    return transpose(net)


def shortest_paths(net: Network, ego: object, alter: object, alpha: float = 0.0, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """path: all shortest paths as arrays of nodes; fewest ties, or with ``alpha`` least sums of value^-alpha (equal within
    1e-10). From the distances to both ends. A node and itself: the path of that node. No rows if there is no way."""
    cost = F.pow("value", F.lit(-alpha)) if alpha else F.lit(1.0)
    arcs = net.arcs.where("ego <> alter and value > 0" if alpha else "ego <> alter").select("ego", "alter", cost.alias("cost"))
    one = lambda x: net.nodes.where(F.col("node") == F.lit(x))
    down = geodesics(net, one(ego), alpha, local_rows=local_rows).select("node", F.col("distance").alias("d")).union(one(ego).select("node", F.lit(0.0)))
    up = geodesics(transposed(net), one(alter), alpha, local_rows=local_rows).select("node", F.col("distance").alias("u")).union(one(alter).select("node", F.lit(0.0)))
    both = materialize(down.join(up, "node"), "on-paths")
    row = both.where(F.col("node") == F.lit(alter)).select("d").head()
    if row is None:
        return net.nodes.select(F.array("node").alias("path")).where("false")
    far = row["d"]
    near = lambda x: F.abs(x - F.lit(far)) <= 1e-10 * max(1.0, far)
    on = both.where(near(F.col("d") + F.col("u")))
    steps = arcs.join(on.select(F.col("node").alias("ego"), "d"), "ego").join(on.select(F.col("node").alias("alter"), "u"), "alter")
    steps = materialize(steps.where(near(F.col("d") + F.col("cost") + F.col("u"))).select("ego", "alter"), "path-steps")
    paths = one(ego).select(F.array("node").alias("path"), F.col("node").alias("end"))
    whole = None
    for _ in range(net.n_nodes()):
        done = paths.where(F.col("end") == F.lit(alter)).select("path")
        whole = done if whole is None else whole.unionByName(done)
        paths = paths.where(F.col("end") != F.lit(alter)).join(steps, F.col("end") == F.col("ego")).select(F.concat("path", F.array("alter")).alias("path"), F.col("alter").alias("end"))
        if paths.isEmpty():
            break
    return whole


def regular_classes(net: Network, max_rounds: int = 1000, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node, class: exact regular equivalence by refinement with the sets of classes of out- and in-neighbours; classes are
    numbered by their first node."""
    rows, size = pooled(net, net.arcs.where("ego <> alter").select("ego", "alter", F.lit(1.0).alias("value")))

    def kernel(a: Arrays) -> list:
        source, c, count = a.source, np.zeros(a.n, np.int64), 1

        def sets(x: np.ndarray, y: np.ndarray) -> list[bytes]:
            pairs = np.unique(np.stack([x, c[y]], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            ends = np.searchsorted(pairs[:, 0], np.arange(a.n + 1))
            return [pairs[i:j, 1].tobytes() for i, j in zip(ends, ends[1:], strict=False)]

        for _ in range(max_rounds):
            key = list(zip(c.tolist(), sets(source, a.to), sets(a.to, source), strict=True))
            names = {k: i for i, k in enumerate(dict.fromkeys(key))}
            c = np.array([names[k] for k in key], np.int64)
            if len(names) == count or not a.n:
                return [a.keys, c + 1]
            count = len(names)
        raise NetworkError("classes did not settle")

    if size <= local_rows:
        return one_task(net, rows, kernel, "node KEY, class long")
    e, state = arcs_in(rows), Rounds("classes")
    c = state.keep(net.nodes.select("node", F.lit(0).cast("long").alias("class")))
    count = 1
    for _ in range(max_rounds):
        out = e.join(c.select(F.col("node").alias("alter"), "class"), "alter").groupBy(F.col("ego").alias("node")).agg(F.sort_array(F.collect_set("class")).alias("o"))
        in_ = e.join(c.select(F.col("node").alias("ego"), "class"), "ego").groupBy(F.col("alter").alias("node")).agg(F.sort_array(F.collect_set("class")).alias("i"))
        out_set, in_set = (F.coalesce(x, F.array().cast("array<bigint>")) for x in ("o", "i"))
        key = F.xxhash64("class", F.size(out_set), out_set, in_set)  # sizes, since a hash of arrays runs over their elements
        c = state.keep(c.join(out, "node", "left").join(in_, "node", "left").select("node", key.alias("class")))
        now = c.select("class").distinct().count()
        if now == count:
            break
        count = now
    else:
        raise NetworkError("classes did not settle")
    first = c.groupBy("class").agg(F.min("node").alias("node"))
    label = dense_ids(first).join(first, "node").select("class", F.col("id").alias("k"))
    return c.join(label, "class").select("node", F.col("k").alias("class"))


def bridges_local(net: Network) -> DataFrame:
    """ego, alter of undirected ties whose ends have no common neighbour: without the tie they are more than 2 apart."""
    from tiegraph.operators.structure import triangles

    t = triangles(net)
    closed = t.select(F.explode(F.array(*[F.struct(F.col(x).alias("ego"), F.col(y).alias("alter")) for x, y in ("ab", "ac", "bc")])).alias("p")).select("p.ego", "p.alter")
    return net.links.where("ego < alter").join(closed, ["ego", "alter"], "left_anti")


def bridges_distance(net: Network, max_rounds: int = 10_000, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """ego, alter, distance of undirected ties: how far apart the ends are without the tie; -1 if they are not connected.

    Ties in a triangle are at 2; only the others are searched.
    """
    from tiegraph.operators.structure import triangles

    t = triangles(net)
    closed = t.select(F.explode(F.array(*[F.struct(F.col(x).alias("ego"), F.col(y).alias("alter")) for x, y in ("ab", "ac", "bc")])).alias("p")).select("p.ego", "p.alter").distinct()
    links = net.links.join(closed.withColumn("short", F.lit(1)), ["ego", "alter"], "left")
    rows, size = pooled(net, links.select("ego", "alter", F.coalesce("short", F.lit(0)).alias("value")))

    def kernel(a: Arrays, mine: np.ndarray) -> Iterator[list]:
        dist = np.empty(a.n, np.int64)
        for s in mine:
            source, to, at = a.arcs_of(np.array([s]))
            far = np.where(a.weight[at] > 0, 2, -1)
            for k in np.flatnonzero((to > s) & (a.weight[at] == 0)):
                t = to[k]
                dist[:] = -1
                dist[s] = 0
                front, d = to[np.arange(len(to)) != k], 1
                while len(front) and dist[t] < 0:
                    dist[front] = d
                    p, q, _ = a.arcs_of(front)
                    q = q[(dist[q] < 0) & ~((p == t) & (q == s))]
                    front, d = np.unique(q), d + 1
                far[k] = dist[t]
            up = to > s
            if up.any():
                yield [a.keys.take(np.full(up.sum(), s)), a.keys.take(to[up]), far[up]]

    if size <= local_rows:
        return per_source(net, rows, kernel, "ego KEY, alter KEY, distance long")
    # every open tie is a source of its own: its ends are named by the tie
    arcs = arcs_in(rows).select("ego", "alter")
    ties = arcs_in(rows).where("ego < alter")
    known = frontier = materialize(ties.where("value = 0").select(F.col("ego").alias("a"), F.col("alter").alias("b"), F.col("ego").alias("node"), F.lit(0).cast("long").alias("distance")), "bridge-steps")
    for d in range(1, max_rounds):
        step = frontier.join(arcs, F.col("node") == F.col("ego")).where("not (node = a and alter = b)").select("a", "b", F.col("alter").alias("node")).distinct()
        frontier = materialize(step.join(known, ["a", "b", "node"], "left_anti").withColumn("distance", F.lit(d).cast("long")), "bridge-steps")
        found = known.where("node = b").select("a", "b")
        frontier = frontier.join(found, ["a", "b"], "left_anti")
        if frontier.isEmpty():
            end = known.where("node = b").select(F.col("a").alias("ego"), F.col("b").alias("alter"), "distance")
            return ties.select("ego", "alter", "value").join(end, ["ego", "alter"], "left").select("ego", "alter", F.coalesce("distance", F.when(F.col("value") > 0, 2).otherwise(-1)).cast("long").alias("distance"))
        known = known.unionByName(frontier)
    raise NetworkError("distances did not settle")
