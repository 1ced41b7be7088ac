"""Operators from networks to networks, and dyad tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError, is_symmetric, symmetrized

#: Dyad tables have n^2 rows: refused beyond this many nodes unless forced.
DENSE_NODES = 20_000
#: Swaps drawn at once.
_SWAPS = 1_000_000


#: Neighbours of a node in one square of its pairs.
HUB = 1_000


def wedges(left: DataFrame, right: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """``left`` joined with ``right`` on ``key``. The rows of a key are dealt into groups of about HUB by ``one`` and by
    ``two``, and every pair of groups is joined apart, so the pairs of a hub are spread over tasks."""
    parts = right.groupBy(key).agg(F.ceil(F.count("*") / HUB).cast("int").alias("_n"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = left.join(parts, key).select(*left.columns, F.pmod(F.xxhash64(one), F.col("_n")).cast("int").alias("_a"), every.alias("_b"))
    b = right.join(parts, key).select(*right.columns, every.alias("_a"), F.pmod(F.xxhash64(two), F.col("_n")).cast("int").alias("_b"))
    return a.join(b, [key, "_a", "_b"]).drop("_a", "_b")


def dyads(net: Network, force: bool = False, selfloop: bool = False) -> DataFrame:
    """Every ordered pair of different nodes with its value, 0 without a tie: the only operator that needs all pairs."""
    n = net.n_nodes()
    if n > DENSE_NODES and not force:
        raise NetworkError(f"{n} nodes have too many dyads; force=True overrides")
    nodes = net.nodes.select("node")
    pairs = nodes.select(F.col("node").alias("ego")).crossJoin(nodes.select(F.col("node").alias("alter")))
    arcs = net.arcs.unionByName(net.edges.where("value is null").select("ego", "alter", "value"))
    out = pairs.join(arcs.withColumn("_tie", F.lit(True)), ["ego", "alter"], "left")
    out = out.select("ego", "alter", F.when(F.col("_tie"), F.col("value")).otherwise(0.0).alias("value"))
    return out if selfloop else out.where("ego <> alter")


def symmetrize(net: Network, how: str = "max") -> Network:
    return net.with_(edges=symmetrized(net.ties, how), directed=False)


def transpose(net: Network) -> Network:
    rest = [c for c in net.edges.columns if c not in ("ego", "alter")]
    return net.with_(edges=net.edges.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), *rest)) if net.directed else net


def keep_nodes(net: Network, condition: Column | str) -> Network:
    """Induced subgraph of the nodes that meet a condition; ties stay if both ends do."""
    nodes = net.nodes.where(condition)
    ends = nodes.select("node")
    edges = net.edges.join(ends.withColumnRenamed("node", "ego"), "ego", "left_semi").join(ends.withColumnRenamed("node", "alter"), "alter", "left_semi")
    return net.with_(nodes=nodes, edges=edges.select(*net.edges.columns))


def drop_nodes(net: Network, condition: Column | str) -> Network:
    wanted = F.expr(condition) if isinstance(condition, str) else condition
    return keep_nodes(net, ~F.coalesce(wanted, F.lit(False)))


def add_nodes(net: Network, nodes: DataFrame) -> Network:
    """Isolates; a two-mode network needs their mode."""
    if net.two_mode and "mode" not in nodes.columns:
        raise NetworkError("new nodes of a two-mode network need a mode")
    new = nodes.join(net.nodes.select("node"), "node", "left_anti")
    return net.with_(nodes=net.nodes.unionByName(new, allowMissingColumns=True))


def rename_nodes(net: Network, names: Mapping[str, str]) -> Network:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    new = lambda c: F.coalesce(table[F.col(c).cast("string")], F.col(c).cast("string")).alias(c)
    swap = lambda df, cols: df.select(*[new(c) if c in cols else F.col(c) for c in df.columns])
    return net.with_(nodes=swap(net.nodes, ["node"]), edges=swap(net.edges, ["ego", "alter"]))


def dichotomize(net: Network, threshold: float) -> Network:
    """Ties of at least the threshold become 1, others go; a threshold of 0 or less makes every dyad a tie."""
    table = net.ties if threshold > 0 else _oriented(net, dyads(net))
    return net.with_(edges=table.where(F.col("value") >= threshold).select("ego", "alter", F.lit(1.0).alias("value")), valued=False)


def _oriented(net: Network, table: DataFrame) -> DataFrame:
    return table if net.directed else table.where("ego <= alter")


def recode(net: Network, rules: Sequence[tuple[float | None, float | None, float | None]]) -> Network:
    """First rule (low, high, new) that holds a value wins; (None, None, new) is for missing dyads. Rules that turn 0
    into a tie work on all dyads."""
    zero = any(lo is not None and lo <= 0 <= hi and new for lo, hi, new in rules)
    table = _oriented(net, dyads(net)) if zero else net.edges.select("ego", "alter", "value")
    out: Column | None = None
    for lo, hi, new in rules:
        hit = F.col("value").isNull() if lo is None else F.col("value").between(lo, hi)
        out = F.when(hit, F.lit(new).cast("double")) if out is None else out.when(hit, F.lit(new).cast("double"))
    value = F.col("value") if out is None else out.otherwise(F.col("value"))
    return net.with_(edges=table.select("ego", "alter", value.alias("value")).where("value is null or value <> 0"))


def replace_values(net: Network, expression: Column | str, where: Column | str | None = None, all_dyads: bool = False) -> Network:
    """New values by an expression over ego, alter and value; ``all_dyads`` lets it make ties of non-ties."""
    table = _oriented(net, dyads(net)) if all_dyads else net.edges.select("ego", "alter", "value")
    new = F.expr(expression) if isinstance(expression, str) else expression
    if where is not None:
        new = F.when(F.expr(where) if isinstance(where, str) else where, new).otherwise(F.col("value"))
    return net.with_(edges=table.select("ego", "alter", new.cast("double").alias("value")).where("value is null or value <> 0"), valued=True)


def replace_matrix(net: Network, edges: DataFrame) -> Network:
    return net.with_(edges=edges.select("ego", "alter", F.col("value").cast("double").alias("value")).where("value is null or value <> 0"))


def tie_value(net: Network, ego: object, alter: object) -> float | None:
    row = net.arcs.where((F.col("ego") == F.lit(ego)) & (F.col("alter") == F.lit(alter))).select("value").head()
    return row["value"] if row else 0.0


def collapse(net: Network, attribute: str, how: str = "max") -> Network:
    """Contract nodes of equal attribute; ties of group pairs are joined by max, min, sum, mean or count."""
    a = net.nodes.select(F.col("node").alias("ego"), F.col(attribute).alias("g_ego"))
    b = net.nodes.select(F.col("node").alias("alter"), F.col(attribute).alias("g_alter"))
    agg = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "count": lambda c: F.count(c).cast("double")}[how]
    pairs = net.arcs.join(a, "ego").join(b, "alter").where("g_ego is not null and g_alter is not null")
    edges = pairs.groupBy(F.col("g_ego").alias("ego"), F.col("g_alter").alias("alter")).agg(agg("value").alias("value"))
    nodes = net.nodes.where(F.col(attribute).isNotNull()).select(F.col(attribute).alias("node")).distinct()
    return Network(nodes, _oriented(net, edges), directed=net.directed, valued=True, selfloop=True, name=f"{net.name}_{attribute}")


def stack(nets: Sequence[Network]) -> Network:
    """Block-diagonal union: node keys get the number of their network, which is also the attribute ``group``."""
    if len(nets) < 2 or len({n.directed for n in nets}) > 1:
        raise NetworkError("needs two networks or more, all directed or all undirected")
    key = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string")).alias(c)
    nodes = edges = None
    for k, n in enumerate(nets, 1):
        x = n.nodes.select(key(k, "node"), F.lit(k).alias("group"))
        y = n.edges.select(key(k, "ego"), key(k, "alter"), "value")
        nodes, edges = (x, y) if nodes is None else (nodes.unionByName(x), edges.unionByName(y))
    return nets[0].with_(nodes=nodes, edges=edges, name="stack")


def expand(net: Network, attribute: str, mode: str = "same") -> DataFrame:
    """Dyad table of an attribute: same, dist, distinv, absdist, absdistinv, sender or receiver."""
    a = net.nodes.select(F.col("node").alias("ego"), F.col(attribute).alias("x"))
    b = net.nodes.select(F.col("node").alias("alter"), F.col(attribute).alias("y"))
    pairs = a.crossJoin(b).where("ego <> alter")
    x, y = F.col("x"), F.col("y")
    if mode == "absdistinv":
        widest = pairs.agg(F.max(F.abs(x - y)).alias("_m"))
        pairs = pairs.crossJoin(F.broadcast(widest))
    value = {"same": (x == y).cast("double"), "dist": x - y, "distinv": y - x, "absdist": F.abs(x - y), "absdistinv": (F.col("_m") if mode == "absdistinv" else F.lit(0)) - F.abs(x - y), "sender": x, "receiver": y}[mode]
    return pairs.select("ego", "alter", value.cast("double").alias("value"))


def neighbors(net: Network, node: object, mode: str = "either") -> DataFrame:
    """Neighbours of one node: outgoing, incoming or either."""
    out = net.arcs.where(F.col("ego") == F.lit(node)).select(F.col("alter").alias("node"))
    back = net.arcs.where(F.col("alter") == F.lit(node)).select(F.col("ego").alias("node"))
    return {"outgoing": out, "incoming": back, "either": out.union(back)}[mode].distinct()


def ego_network(net: Network, node: object, mode: str = "either") -> Network:
    around = neighbors(net, node, mode).union(net.nodes.where(F.col("node") == F.lit(node)).select("node")).distinct()
    return keep_nodes(net.with_(nodes=net.nodes.join(around, "node", "left_semi")), F.lit(True))


def edge_table(net: Network, attributes: Sequence[str] = (), others: Mapping[str, Network] | None = None, full: bool = False, upper: bool = False) -> DataFrame:
    """Ties as a table, networks side by side, attributes of both ends; ``full``: all dyads, ``upper``: ego < alter."""
    out = dyads(net) if full else net.arcs
    out = out.withColumnRenamed("value", net.name)
    for name, other in (others or {}).items():
        out = out.join(other.arcs.select("ego", "alter", F.col("value").alias(name)), ["ego", "alter"], "left" if full else "full").fillna(0.0, [name, net.name])
    for end in ("ego", "alter"):
        if attributes:
            out = out.join(net.nodes.select(F.col("node").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in attributes]), end, "left")
    return out.where("ego < alter") if upper else out


def matrix(net: Network) -> DataFrame:
    """Adjacency table: one row per ego, one column per alter (a pivot, for small networks)."""
    return dyads(net, selfloop=True).groupBy("ego").pivot("alter").agg(F.first("value"))


def spatial_weights(net: Network, direction: str = "out", binary: bool = True, normalize: str = "row") -> DataFrame:
    """Weights (ego, alter, weight): direction out, in, symmetric (larger) or mutual (smaller); rows sum to 1, or none,
    minmax (by the smaller of the largest row and column sum)."""
    arcs = net.arcs.where("ego <> alter")
    if binary:
        arcs = arcs.withColumn("value", F.lit(1.0))
    back = arcs.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), F.col("value").alias("back"))
    if direction == "in":
        w = back.withColumnRenamed("back", "value")
    elif direction in ("symmetric", "mutual"):
        both = arcs.join(back, ["ego", "alter"], "full").fillna(0.0, ["value", "back"])
        w = both.select("ego", "alter", (F.greatest if direction == "symmetric" else F.least)("value", "back").alias("value")).where("value <> 0")
    else:
        w = arcs
    sums = w.groupBy("ego").agg(F.sum("value").alias("s"))
    if normalize == "row":
        return w.join(sums, "ego").select("ego", "alter", (F.col("value") / F.col("s")).alias("weight"))
    if normalize == "minmax":
        rows = sums.agg(F.max("s").alias("r"))
        cols = w.groupBy("alter").agg(F.sum("value").alias("s")).agg(F.max("s").alias("c"))
        return w.crossJoin(F.broadcast(rows.crossJoin(cols))).select("ego", "alter", (F.col("value") / F.least("r", "c")).alias("weight"))
    return w.select("ego", "alter", F.col("value").alias("weight"))


def permute(net: Network, seed: int = 0) -> Network:
    """Relabel the nodes by a random permutation: ranks by key and by a seeded hash are joined."""
    from tiegraph.network import dense_ids

    shuffled = dense_ids(net.nodes.select(F.struct(F.xxhash64(F.col("node").cast("string"), F.lit(seed)).alias("h"), F.col("node").alias("k")).alias("node")))
    table = dense_ids(net.nodes).join(shuffled.select("id", F.col("node.k").alias("new")), "id").select("node", "new")
    edges = net.edges.join(table.select(F.col("node").alias("ego"), F.col("new").alias("e2")), "ego").join(table.select(F.col("node").alias("alter"), F.col("new").alias("a2")), "alter")
    e, a = (F.col("e2"), F.col("a2")) if net.directed else (F.least("e2", "a2"), F.greatest("e2", "a2"))
    return net.with_(edges=edges.select(e.alias("ego"), a.alias("alter"), "value"))


def permute_ties(net: Network, seed: int = 0, swaps: int | None = None) -> Network:
    """Exchange the partners of random pairs of ties (a-b, c-d to a-d, c-b), ten for each tie unless told, without loops or
    repeated ties: every node keeps its degrees. Sequential: one task holds the ties, about 200 bytes each."""
    import numpy as np

    from tiegraph.operators.local import Arrays, one_task, pooled

    rows, _ = pooled(net, net.ties.where("ego <> alter"))
    directed, one_way = net.directed, net.directed or net.two_mode

    def kernel(a: Arrays) -> list:
        rng, i, j, n = np.random.default_rng(seed), a.source.tolist(), a.to.tolist(), a.n
        have = set((a.source * n + a.to).tolist())
        m = len(i)
        left = (10 * m if directed else 5 * m) if swaps is None else swaps
        while left > 0 and m:
            some = min(left, _SWAPS)
            left -= some
            for p, q, flip in zip(*(rng.integers(0, m, some).tolist() for _ in range(2)), (rng.random(some) < 0.5).tolist(), strict=True):
                x, y, u, v = i[p], j[p], i[q], j[q]
                if one_way:
                    one, two = (x, v), (u, y)
                else:
                    if flip:
                        u, v = v, u
                    one, two = (x, v) if x < v else (v, x), (u, y) if u < y else (y, u)
                new, other = one[0] * n + one[1], two[0] * n + two[1]
                if p == q or x == v or u == y or new == other or new in have or other in have:
                    continue
                have.remove(x * n + y)
                have.remove(i[q] * n + j[q])
                have.add(new)
                have.add(other)
                (i[p], j[p]), (i[q], j[q]) = one, two
        return [a.keys.take(np.array(i, np.int64)), a.keys.take(np.array(j, np.int64)), a.weight]

    return net.with_(edges=one_task(net, rows, kernel, "ego KEY, alter KEY, value double"))


def combine(a: Network, b: Network, op: str) -> DataFrame:
    """Element-wise algebra of two networks on the same nodes (0 where there is no tie): + - * / == != > < >= <= & |,
    or ** for the matrix product."""
    if op == "**":
        left, right = a.arcs.select("ego", F.col("alter").alias("_m"), F.col("value").alias("x")), b.arcs.select(F.col("ego").alias("_m"), "alter", F.col("value").alias("y"))
        return wedges(left, right, "_m", "ego", "alter").groupBy("ego", "alter").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    dense = op in ("==", ">=", "<=", "/")
    left = (dyads(a) if dense else a.arcs).select("ego", "alter", F.col("value").alias("x"))
    both = left.join((dyads(b) if dense else b.arcs).select("ego", "alter", F.col("value").alias("y")), ["ego", "alter"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    value = {
        "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, x / y), "==": lambda: x == y, "!=": lambda: x != y, ">": lambda: x > y,
        "<": lambda: x < y, ">=": lambda: x >= y, "<=": lambda: x <= y, "&": lambda: (x != 0) & (y != 0), "|": lambda: (x != 0) | (y != 0),
    }[op]()
    return both.select("ego", "alter", value.cast("double").alias("value")).where("value is null or value <> 0")


def same_nodes(a: Network, b: Network) -> bool:
    return a.nodes.select("node").exceptAll(b.nodes.select("node")).isEmpty() and b.nodes.select("node").exceptAll(a.nodes.select("node")).isEmpty()


def project(net: Network, mode: int = 1, stat: str = "count") -> Network:
    """One-mode projection of a two-mode network: nodes of ``mode`` tied by shared nodes of the other mode.

    Only pairs that share a node are made; a node of degree d gives d(d-1)/2 of them, combined before the shuffle.
    """
    net.need(two_mode=True)
    own, other = ("ego", "alter") if mode == 1 else ("alter", "ego")
    t = net.ties.select(F.col(own).alias("i"), F.col(other).alias("q"), (F.col("value") if net.valued else F.lit(1.0)).alias("w"))
    if stat == "newman":
        t = t.join(t.groupBy("q").agg(F.count("*").alias("d")), "q")
    left, right = t.withColumnsRenamed({"w": "wi"}), t.drop("d").withColumnsRenamed({"i": "j", "w": "wj"})
    pairs = wedges(left, right, "q", "i", "j").where("i < j")
    wi, wj = F.col("wi"), F.col("wj")
    s = F.count("*").cast("double")
    aggs = {
        "count": s, "binary": F.lit(1.0), "sum": F.sum(wi + wj), "mean": F.sum(wi + wj) / (2 * s), "min": F.min(F.least(wi, wj)), "max": F.max(F.greatest(wi, wj)), "minmax": F.max(F.least(wi, wj)),
        "newman": F.sum((wi + wj) / (2 * (F.col("d") - 1))) if stat == "newman" else None, "jaccard": s, "cosine": s,
    }
    if stat not in aggs:
        raise NetworkError(f"unknown statistic {stat}")
    out = pairs.groupBy("i", "j").agg(*([s.alias("value")] if stat == "binary" else [aggs[stat].alias("value")]))
    if stat == "binary":
        out = out.withColumn("value", F.lit(1.0))
    if stat in ("jaccard", "cosine"):
        k = t.groupBy("i").agg(F.count("*").alias("k"))
        out = out.join(k.withColumnRenamed("k", "ki"), "i").join(k.withColumnsRenamed({"i": "j", "k": "kj"}), "j")
        v = F.col("value")
        out = out.withColumn("value", v / (F.col("ki") + F.col("kj") - v) if stat == "jaccard" else v / F.sqrt(F.col("ki") * F.col("kj")))
    nodes = net.nodes.where(F.col("mode") == mode).drop("mode")
    return Network(nodes, out.select(F.col("i").alias("ego"), F.col("j").alias("alter"), "value"), directed=False, valued=stat != "binary", name=f"{net.name}_{mode}")


def auto_undirected(net: Network) -> Network:
    """Undirected if every tie has an equal reverse."""
    return net.with_(edges=net.edges.where("ego <= alter"), directed=False) if net.directed and is_symmetric(net.ties) else net
