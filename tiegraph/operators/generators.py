"""Random and regular networks. Draws are functions of a seed and the dyad, so a repeated task gives the same ties."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegraph.network import Network


def _nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "node")


def _uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def _pairs(spark: SparkSession, n: int, directed: bool) -> DataFrame:
    cells = spark.range(n * n).select((F.floor(F.col("id") / n) + 1).cast("long").alias("ego"), (F.col("id") % n + 1).cast("long").alias("alter"))
    return cells.where("ego <> alter" if directed else "ego < alter")


def _net(spark: SparkSession, n: int, edges: DataFrame, directed: bool, name: str) -> Network:
    return Network(_nodes(spark, n), edges.select("ego", "alter", F.lit(1.0).alias("value")), directed=directed, valued=False, name=name)


def random_prob(spark: SparkSession, n: int, prob: float, directed: bool = True, seed: int = 1) -> Network:
    """Each dyad a tie with probability ``prob``: each row of ties is drawn by geometric jumps, so work follows the ties."""
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["node"]:
                rng = np.random.default_rng((seed, int(i)))
                m = n - 1 if directed else n - int(i)
                at, step = [], -1
                while m and prob > 0:
                    step += 1 if prob >= 1 else int(rng.geometric(prob))
                    if step >= m:
                        break
                    at.append(step)
                cols = np.array(at, np.int64) + 1
                cols = np.where(cols >= i, cols + 1, cols) if directed else cols + int(i)
                out.append(pd.DataFrame({"ego": np.full(len(cols), i, np.int64), "alter": cols}))
            yield pd.concat(out) if out else pd.DataFrame({"ego": [], "alter": []}).astype("int64")

    return _net(spark, n, _nodes(spark, n).mapInPandas(draw, "ego long, alter long"), directed, "random")


def random_count(spark: SparkSession, n: int, ties: int, directed: bool = True, seed: int = 1) -> Network:
    """Exactly ``ties`` ties, uniformly: those of the smallest draws."""
    chosen = _pairs(spark, n, directed).withColumn("u", F.xxhash64(F.lit(seed), "ego", "alter")).orderBy("u", "ego", "alter").limit(ties)
    return _net(spark, n, chosen, directed, "random")


def random_census(spark: SparkSession, n: int, mutual: int, asymmetric: int, seed: int = 1) -> Network:
    """Exactly so many mutual and asymmetric dyads."""
    drawn = random_count(spark, n, mutual + asymmetric, False, seed).edges
    from tiegraph.network import dense_ids

    numbered = dense_ids(drawn.select(F.struct(F.xxhash64(F.lit(seed + 1), "ego", "alter").alias("u"), "ego", "alter").alias("node")))
    d = numbered.select("node.ego", "node.alter", (F.col("id") <= mutual).alias("both"), (_uniform(seed + 2, "node.ego", "node.alter") < 0.5).alias("flip"))
    forward = d.where("both or not flip").select("ego", "alter")
    return _net(spark, n, forward.union(d.where("both or flip").select("alter", "ego")), True, "census")


def degree_sequence(spark: SparkSession, degrees: list[int], indegrees: list[int] | None = None, seed: int = 1, swaps: int | None = None) -> Network:
    """A network with exactly these degrees (with ``indegrees``: out- and in-degrees): built by serving the largest need
    first (Havel-Hakimi, Kleitman-Wang), then mixed by swaps of ends. A sequential kernel."""
    from tiegraph.operators.transform import permute_ties

    n, directed = len(degrees), indegrees is not None

    def draw(_: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        if directed:
            need = list(indegrees)
            for i, d in sorted(enumerate(degrees), key=lambda x: -x[1]):
                others = sorted((j for j in range(n) if j != i and need[j] > 0), key=lambda j: (-need[j], -degrees[j], j))
                if len(others) < d:
                    raise ValueError("no network has these degrees")
                for j in others[:d]:
                    need[j] -= 1
                    edges.append((i + 1, j + 1))
            if any(need):
                raise ValueError("no network has these degrees")
        else:
            left = sorted(((d, i + 1) for i, d in enumerate(degrees)), reverse=True)
            while left and left[0][0] > 0:
                d, i = left.pop(0)
                if d > len(left) or left[d - 1][0] == 0:
                    raise ValueError("no network has these degrees")
                for k in range(d):
                    edges.append((min(i, left[k][1]), max(i, left[k][1])))
                    left[k] = (left[k][0] - 1, left[k][1])
                left.sort(reverse=True)
        return pd.DataFrame(edges, columns=["ego", "alter"]).astype("int64")

    net = _net(spark, n, spark.range(1).groupBy("id").applyInPandas(draw, "ego long, alter long"), directed, "degrees")
    return permute_ties(net, seed, swaps)


def ring(spark: SparkSession, n: int, k: int = 1, directed: bool = False) -> Network:
    """Ties to the ``k`` next nodes on both sides (directed: after the node only)."""
    t = spark.range(n).select((F.col("id") + 1).alias("ego"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("s"))
    t = t.select("ego", (F.pmod(F.col("ego") - 1 + F.col("s"), F.lit(n)) + 1).cast("long").alias("alter")).where("ego <> alter")
    if not directed:
        t = t.select(F.least("ego", "alter").alias("ego"), F.greatest("ego", "alter").alias("alter"))
    return _net(spark, n, t.distinct(), directed, "ring")


def lattice(spark: SparkSession, rows: int, columns: int, wrap_x: bool = False, wrap_y: bool = False) -> Network:
    """Grid with four neighbours, wrapped if asked."""
    cells = spark.range(rows * columns).select((F.col("id") + 1).alias("ego"), F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    right = cells.where("true" if wrap_x else f"c < {columns - 1}").select("ego", (F.col("r") * columns + (F.col("c") + 1) % columns + 1).cast("long").alias("alter"))
    down = cells.where("true" if wrap_y else f"r < {rows - 1}").select("ego", ((F.col("r") + 1) % rows * columns + F.col("c") + 1).cast("long").alias("alter"))
    t = right.union(down).where("ego <> alter").select(F.least("ego", "alter").alias("ego"), F.greatest("ego", "alter").alias("alter")).distinct()
    return _net(spark, rows * columns, t, False, "lattice")


def small_world(spark: SparkSession, n: int, k: int = 2, prob: float = 0.1, seed: int = 1, shortcuts: bool = False) -> Network:
    """Ring whose ties move an end with probability ``prob`` (or, with ``shortcuts``, gain a further tie): sequential."""
    def draw(_: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        edges = {(min(i, (i + s) % n), max(i, (i + s) % n)) for i in range(n) for s in range(1, k + 1) if (i + s) % n != i}
        for e in sorted(edges):
            if rng.random() < prob:
                for _ in range(50):
                    x = int(rng.integers(0, n))
                    new = (min(e[0], x), max(e[0], x))
                    if x != e[0] and new not in edges:
                        if not shortcuts:
                            edges.discard(e)
                        edges.add(new)
                        break
        return pd.DataFrame(sorted((a + 1, b + 1) for a, b in edges), columns=["ego", "alter"]).astype("int64")

    return _net(spark, n, spark.range(1).groupBy("id").applyInPandas(draw, "ego long, alter long"), False, "small_world")


def preferential(spark: SparkSession, n: int, m: int = 2, m0: int | None = None, uniform: float = 0.0, seed: int = 1) -> Network:
    """Growth: each node ties to ``m`` others chosen by degree (with chance ``uniform`` evenly): sequential."""
    def draw(_: pd.DataFrame) -> pd.DataFrame:
        rng, first = np.random.default_rng(seed), m0 or m + 1
        edges = [(i, j) for i in range(first) for j in range(i)]
        stubs = [v for e in edges for v in e]
        for v in range(first, n):
            chosen: set[int] = set()
            while len(chosen) < min(m, v):
                chosen.add(int(rng.integers(0, v)) if rng.random() < uniform or not stubs else stubs[int(rng.integers(0, len(stubs)))])
            for w in sorted(chosen):
                edges.append((v, w))
                stubs += [v, w]
        return pd.DataFrame([(min(a, b) + 1, max(a, b) + 1) for a, b in edges], columns=["ego", "alter"]).astype("int64")

    return _net(spark, n, spark.range(1).groupBy("id").applyInPandas(draw, "ego long, alter long"), False, "preferential")


def dyad_probability(probabilities: DataFrame, nodes: DataFrame, density: float | None = None, directed: bool = True, seed: int = 1) -> Network:
    """Ties drawn from (ego, alter, p); with ``density`` the weights p are scaled so that it is expected."""
    p = probabilities
    if density is not None:
        p = p.crossJoin(F.broadcast(p.agg((F.sum("p") / F.count("*")).alias("_mean")))).withColumn("p", F.col("p") * density / F.col("_mean"))
    drawn = p.where(_uniform(seed, "ego", "alter") < F.col("p")).select("ego", "alter", F.lit(1.0).alias("value"))
    return Network(nodes, drawn, directed=directed, valued=False, name="dyadprob")


def homophily(net: Network, weights: dict[str, float], density: float, seed: int = 1) -> Network:
    """Random network whose dyad weights are exp(sum of h x same attribute), scaled to a density."""
    from tiegraph.operators.transform import expand

    total = None
    for attribute, h in weights.items():
        t = expand(net, attribute, "same").withColumn("value", F.col("value") * h)
        total = t if total is None else total.unionByName(t)
    p = total.groupBy("ego", "alter").agg(F.exp(F.sum("value")).alias("p"))
    return dyad_probability(p, net.nodes, density, seed=seed)


def replicate(build, times: int) -> DataFrame:  # noqa: ANN001
    """(rep, ego, alter, value) of ``times`` networks that ``build`` makes from a seed."""
    out = None
    for k in range(1, times + 1):
        e = build(k).edges.select(F.lit(k).alias("rep"), "ego", "alter", "value")
        out = e if out is None else out.unionByName(e)
    return out


def expected_ties(n: int, prob: float, directed: bool = True) -> tuple[float, float]:
    """Mean and standard deviation of the number of ties of ``random_prob``."""
    m = n * (n - 1) / (1 if directed else 2)
    return m * prob, math.sqrt(m * prob * (1 - prob))
