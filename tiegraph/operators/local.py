"""Kernels on the whole network in arrays: one task, or one task for each block of sources.

A network whose nodes and ties are at most LOCAL_ROWS rows is packed into sorted arrays in one task (about 16 bytes a tie),
and iterations run there without a job each. Measures of every source (distances, betweenness) send the packed network,
whose size SOURCE_ROWS bounds, to tasks that share the sources out. Larger networks take the loops of joins in ``iterate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.network import Network
from tiegraph.plans.lineage import materialize

#: Nodes and ties (both directions) of a network that one task takes: 16 bytes each in arrays, 80 MB.
LOCAL_ROWS = 5_000_000
#: The same for measures of every source, whose form on joins writes all pairs: 12 bytes each in the broadcast, 240 MB.
SOURCE_ROWS = 20_000_000


@dataclass
class Arrays:
    """Nodes in the order of their keys; arcs sorted by source and target; ``marked`` nodes are the chosen sources."""

    keys: object  # a pyarrow array
    start: np.ndarray
    to: np.ndarray
    weight: np.ndarray
    marked: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start) - 1

    @property
    def source(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.start))

    def reversed(self) -> Arrays:
        order = np.argsort(self.to, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.to, minlength=self.n))])
        return Arrays(self.keys, start, self.source[order], self.weight[order], self.marked)

    def arcs_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sources, targets and places of all arcs that leave ``nodes``."""
        first, count = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(nodes, count), self.to[at], at


def pooled(net: Network, arcs: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Arcs (ego, alter, value) and a row (node, null, mark) for each node, stored once; and how many rows these are."""
    kind = dict(net.nodes.dtypes)["node"]
    nodes = net.nodes.select("node").withColumn("mark", F.lit(1.0))
    if sources is not None:
        nodes = net.nodes.select("node").join(sources.select("node", F.lit(1.0).alias("mark")).distinct(), "node", "left").fillna(0.0, ["mark"])
    rows = arcs.select("ego", "alter", F.col("value").cast("double").alias("value"))
    rows = materialize(rows.unionByName(nodes.select(F.col("node").alias("ego"), F.lit(None).cast(kind).alias("alter"), F.col("mark").alias("value"))), "network")
    return rows, rows.count()


def arcs_in(rows: DataFrame) -> DataFrame:
    return rows.where("alter is not null")


def to_arrays(table) -> Arrays:  # noqa: ANN001
    """Arrays of a pooled table."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ego, alter, value = (table.column(c).combine_chunks() for c in ("ego", "alter", "value"))
    ego, alter = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ego, alter))
    keys = pc.unique(pa.concat_arrays([ego, alter.drop_null()]))
    keys = keys.take(pc.array_sort_indices(keys))
    arc = pc.is_valid(alter)
    v = value.to_numpy(zero_copy_only=False)
    is_arc = arc.to_numpy(zero_copy_only=False)
    i = pc.index_in(ego, value_set=keys).to_numpy(zero_copy_only=False).astype(np.int64)
    j = pc.index_in(alter.filter(arc), value_set=keys).to_numpy(zero_copy_only=False).astype(np.int64)
    marked = np.zeros(len(keys), bool)
    marked[i[~is_arc & (v > 0)]] = True
    i, v = i[is_arc], v[is_arc]
    order = np.lexsort((j, i))
    start = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(keys)))])
    return Arrays(keys, start, j[order], v[order], marked)


def _schema(net: Network, schema: str) -> tuple[str, list[str]]:
    schema = schema.replace("KEY", dict(net.nodes.dtypes)["node"])
    return schema, [c.strip().split(" ")[0] for c in schema.split(",")]


def one_task(net: Network, rows: DataFrame, kernel: Callable[[Arrays], list], schema: str) -> DataFrame:
    """Columns that ``kernel`` makes of the arrays, in one task. ``rows`` must be within LOCAL_ROWS."""
    schema, names = _schema(net, schema)

    def apply(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        return pa.Table.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in kernel(to_arrays(table))], names)

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(apply, schema)


def _dealt(net: Network, rows: DataFrame, kernel: Callable[[Arrays, int], Iterator[list]], schema: str, n: int) -> DataFrame:
    """Columns that ``kernel`` yields for each of the numbers below ``n``, one task each; every task gets the packed network."""
    schema, names = _schema(net, schema)
    spark = net.spark
    kind = dict(net.nodes.dtypes)["node"]

    def pack(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        a = to_arrays(table)
        keys = pa.ListArray.from_arrays(pa.array([0, len(a.keys)], pa.int32()), a.keys)
        blobs = [a.start.astype("<i8"), a.to.astype("<i4"), a.weight.astype("<f8"), a.marked.astype("u1")]
        return pa.Table.from_arrays([keys, *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["keys", "start", "target", "weight", "marked"])

    packed = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(pack, f"keys array<{kind}>, start binary, target binary, weight binary, marked binary")

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                get = lambda c, k: np.frombuffer(one.column(c)[0].as_buffer(), k)  # noqa: B023, E731
                a = Arrays(one.column("keys").flatten(), get("start", "<i8"), get("target", "<i4").astype(np.int64), get("weight", "<f8"), get("marked", "u1").astype(bool))
                for columns in kernel(a, one.column("id")[0].as_py()):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    # one row with the packed network, 12 bytes a row (SOURCE_ROWS bounds it for measures over sources) and the keys
    return spark.range(0, n, 1, n).crossJoin(F.broadcast(packed)).mapInArrow(apply, schema)


def per_source(net: Network, rows: DataFrame, kernel: Callable[[Arrays, np.ndarray], Iterator[list]], schema: str, blocks: int | None = None) -> DataFrame:
    """Columns that ``kernel`` yields for blocks of the marked sources; the packed network goes to each block's task."""
    n = blocks or 4 * net.spark.sparkContext.defaultParallelism
    return _dealt(net, rows, lambda a, k: kernel(a, np.flatnonzero(a.marked)[k::n]), schema, n)


def best_trial(net: Network, rows: DataFrame, kernel: Callable[[Arrays, int], tuple[float, list]], schema: str, trials: int) -> DataFrame:
    """Columns that ``kernel`` makes in the trial of the highest score, the first of equal ones; a task for each trial."""

    def one(a: Arrays, k: int) -> Iterator[list]:
        score, columns = kernel(a, k)
        yield [*columns, np.full(a.n, score), np.full(a.n, k)]

    every = materialize(_dealt(net, rows, one, f"{schema}, _score double, _trial long", trials), "trials")
    best = every.agg(F.max(F.struct("_score", (-F.col("_trial")).alias("_t"))).alias("b")).select((-F.col("b._t")).alias("_trial"))
    return every.join(F.broadcast(best), "_trial").drop("_trial", "_score")


def hops(a: Arrays, s: int, dist: np.ndarray) -> list[np.ndarray]:
    """Distances in ties from ``s`` into ``dist`` (-1 where it can't go), and the nodes of each layer."""
    dist[:] = -1
    dist[s] = 0
    layers = [np.array([s])]
    while len(layers[-1]):
        _, to, _ = a.arcs_of(layers[-1])
        to = to[dist[to] < 0]
        dist[to] = len(layers)
        layers.append(np.unique(to) if len(to) < len(dist) // 8 else np.flatnonzero(dist == len(layers)))
    return layers[:-1]


def bit_counts(bits: np.ndarray) -> np.ndarray:
    """How often each bit of a column of 64-bit words is set: three rows become a sum and a carry until few are left."""
    total, place = np.zeros(64 * bits.shape[1], np.int64), 0
    while len(bits):
        carries = []
        while len(bits) > 24:
            k = len(bits) // 3
            x, y, z = bits[:k], bits[k : 2 * k], bits[2 * k : 3 * k]
            odd = x ^ y
            carries.append((x & y) | (odd & z))
            bits = np.concatenate([odd ^ z, bits[3 * k :]])
        total += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) << place
        bits, place = np.concatenate(carries) if carries else bits[:0], place + 1
    return total


#: Bytes of one of the three tables of bits (node by source) that a block of sources keeps.
WAVE_BYTES = 1 << 27
_WAVE_WORDS = 1 << 18


def wave_blocks(a: Arrays, sources: np.ndarray) -> list[np.ndarray]:
    """``sources`` in blocks of a multiple of 64 that ``waves`` takes at once."""
    size = 64 * int(np.clip(WAVE_BYTES // (8 * max(a.n, 1)), 1, 32))
    return [sources[k : k + size] for k in range(0, len(sources), size)]


def waves(a: Arrays, back: Arrays, sources: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Searches from a block of sources at once. For each distance from 1 on: the nodes that some source reaches at it, and
    their rows of bits, one for each source. ``back`` has the arcs reversed. A round follows the arcs out of the last
    nodes, or those into nodes that some source hasn't reached, whichever are fewer."""
    words = -(-len(sources) // 64)
    at = np.arange(len(sources))
    every = np.zeros(words * 64, np.uint8)
    every[: len(sources)] = 1
    every = np.packbits(every, bitorder="little").view(np.uint64)
    seen, front = np.zeros((a.n, words), np.uint64), np.zeros((a.n, words), np.uint64)
    np.bitwise_or.at(front, (sources, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    seen |= front
    rows, waits = np.unique(sources), np.ones(a.n, bool)
    out, into = np.diff(a.start), np.diff(back.start)
    while len(rows):
        if out[rows].sum() < into[waits].sum():
            source, to, _ = a.arcs_of(rows)
            order = np.argsort(to, kind="stable")
            near, to = source[order], to[order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            nodes, many = to[first], np.diff(np.append(first, len(to)))
        else:
            nodes = np.flatnonzero(waits & (into > 0))
            near, first, many = back.to, back.start[nodes], into[nodes]
        # nodes with as many arcs are joined together: a table of arc by node by word, or-ed along the arcs
        order = np.argsort(many, kind="stable")
        nodes, first, many = nodes[order], first[order], many[order]
        found, k = [], 0
        while k < len(nodes):
            j = min(int(np.searchsorted(many, many[k], "right")), k + max(1, _WAVE_WORDS // int(many[k] * words)))
            bits = np.bitwise_or.reduce(front[near[first[k:j] + np.arange(many[k])[:, None]]], axis=0) & ~seen[nodes[k:j]]
            new = bits.any(1)
            if new.any():
                found.append((nodes[k:j][new], bits[new]))
            k = j
        front[rows] = 0
        if not found:
            return
        rows, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        seen[rows] |= bits
        front[rows] = bits
        waits[rows] = (seen[rows] != every).any(1)
        yield rows, bits


def costs(a: Arrays, s: int, cost: np.ndarray) -> np.ndarray:
    """Least sums of ``cost`` from ``s`` (infinite where it can't go): rounds over the nodes that got nearer."""
    dist = np.full(a.n, np.inf)
    dist[s] = 0.0
    front = np.array([s])
    while len(front):
        source, to, at = a.arcs_of(front)
        new = dist[source] + cost[at]
        better = new < dist[to] - 1e-12
        to, new = to[better], new[better]
        np.minimum.at(dist, to, new)
        front = np.unique(to)
    return dist


def brandes(a: Arrays, sources: np.ndarray, cost: np.ndarray | None = None) -> np.ndarray:
    """Sums over ``sources`` of the shares of shortest paths through each node (ordered pairs)."""
    score, dist = np.zeros(a.n), np.empty(a.n, np.int64)
    back = a.source
    for s in sources:
        sigma, delta = np.zeros(a.n), np.zeros(a.n)
        sigma[s] = 1.0
        if cost is None:
            steps = []
            for k, layer in enumerate(hops(a, s, dist)):
                source, to, _ = a.arcs_of(layer)
                on = dist[to] == k + 1
                steps.append((source[on], to[on]))
                sigma += np.bincount(to[on], sigma[source[on]], a.n)
        else:
            far = costs(a, s, cost)
            on = np.isfinite(far[back]) & (np.abs(far[back] + cost - far[a.to]) <= 1e-12 * (1 + np.abs(np.where(np.isfinite(far[a.to]), far[a.to], 0))))
            source, to = back[on], a.to[on]
            order = np.argsort(far[source], kind="stable")
            source, to = source[order], to[order]
            edges = np.flatnonzero(np.diff(far[source])) + 1
            steps = list(zip(np.split(source, edges), np.split(to, edges), strict=True))
            for p, q in steps:
                np.add.at(sigma, q, sigma[p])
        for p, q in reversed(steps):
            if len(p):
                delta += np.bincount(p, sigma[p] / sigma[q] * (1 + delta[q]), a.n)
        delta[s] = 0
        score += delta
    return score


def component_labels(n: int, source: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least node of each node's weak component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[source], label[to])
        new = label.copy()
        np.minimum.at(new, source, low)
        np.minimum.at(new, to, low)
        np.minimum.at(new, label[source], low)
        np.minimum.at(new, label[to], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            return label
        label = new


def coreness(n: int, source: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Coreness of each node; links are given in both directions."""
    start = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))])
    a = Arrays(None, start, to, np.ones(len(to)), np.ones(n, bool))
    degree, core, left = np.diff(start).astype(np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    k = 0
    while left.any():
        k = max(k, int(degree[left].min()))
        gone = np.flatnonzero(left & (degree <= k))
        while len(gone):
            core[gone] = k
            left[gone] = False
            _, t, _ = a.arcs_of(gone)
            t = t[left[t]]
            degree -= np.bincount(t, minlength=n)
            gone = np.unique(t[degree[t] <= k])
    return core


def solve_grounded(n: int, source: np.ndarray, to: np.ndarray, weight: np.ndarray, target: int, tol: float, rounds: int) -> np.ndarray:
    """Steps of a walk to ``target``: (D - W) h = d elsewhere, by conjugate gradients with D as preconditioner.

    Nodes that can't reach the target get NaN.
    """
    label = component_labels(n, source, to)
    here = label == label[target]
    here[target] = False
    deg = np.bincount(source, weight, n)
    x, res = np.zeros(n), np.where(here, deg, 0.0)
    bound = tol * np.sqrt((res**2).sum())
    safe = np.where(deg > 0, deg, 1.0)
    z = np.where(here, res / safe, 0.0)
    p, rz = z.copy(), float((res * z).sum())
    for _ in range(rounds):
        if np.sqrt((res**2).sum()) <= bound:
            break
        q = np.where(here, deg * p - np.bincount(source, weight * p[to], n), 0.0)
        step = rz / float((p * q).sum())
        x += step * p
        res -= step * q
        z = np.where(here, res / safe, 0.0)
        rz, last = float((res * z).sum()), rz
        p = z + rz / last * p
    else:
        raise ArithmeticError("the walk's equations did not settle")
    out = np.full(n, np.nan)
    out[here] = x[here]
    out[target] = 0.0
    return out
