"""Permutation and simulation tests: replicates are rows of one table, and run in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError
from tiegraph.operators.transform import DENSE_NODES, dyads

Statistic = Callable[[np.ndarray], float]


def _matrices(nets: list[Network]) -> tuple[list, list[np.ndarray]]:
    """Dense matrices of networks on the same nodes, on the driver: refused above DENSE_NODES / 10 nodes."""
    import pyarrow as pa

    keys = nets[0].nodes.select("node").orderBy("node").limit(DENSE_NODES // 10 + 1).toArrow().column("node").combine_chunks()
    if len(keys) > DENSE_NODES // 10:
        raise NetworkError("too many nodes for permutation tests on matrices")
    keys = pa.chunked_array(keys.chunks if isinstance(keys, pa.ChunkedArray) else [keys]).combine_chunks()
    out = []
    for net in nets:
        out.append(_cells(net.arcs, keys))
    return keys.to_pylist(), out


def _cells(table: DataFrame, keys) -> np.ndarray:  # noqa: ANN001
    """The matrix of (ego, alter, value)."""
    import pyarrow.compute as pc

    t, m = table.select("ego", "alter", F.col("value").cast("double").alias("value")).toArrow(), np.zeros((len(keys), len(keys)))
    i, j = (pc.index_in(t.column(c), value_set=keys).to_numpy() for c in ("ego", "alter"))
    m[i.astype(int), j.astype(int)] = t.column("value").to_numpy()
    return m


def _replicates(net: Network, reps: int, draw: Callable[[np.random.Generator], float], seed: int) -> np.ndarray:
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rep": pdf["id"], "stat": [float(draw(np.random.default_rng((seed, int(i))))) for i in pdf["id"]]})

    spark = net.spark
    parts = max(1, min(reps, spark.sparkContext.defaultParallelism))
    out = spark.range(reps).repartition(parts).mapInPandas(lambda it: (apply(b) for b in it), "rep long, stat double")
    return out.orderBy("rep").toPandas()["stat"].to_numpy()


def p_values(null: np.ndarray, observed: float) -> tuple[float, float, float]:
    """P(>=), P(<=), two-sided min(1, 2 min), each (1 + count)/(reps + 1)."""
    up = (1 + int((null >= observed - 1e-12).sum())) / (len(null) + 1)
    down = (1 + int((null <= observed + 1e-12).sum())) / (len(null) + 1)
    return up, down, min(1.0, 2 * min(up, down))


def _result(net: Network, observed: float, null: np.ndarray) -> DataFrame:
    up, down, two = p_values(null, observed)
    lo, hi = np.percentile(null, [2.5, 97.5])
    return net.spark.createDataFrame([(float(observed), float(null.mean()), float(lo), float(hi), up, down, two)], "observed double, mean double, low double, high double, p_upper double, p_lower double, p_two_sided double")


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    off = ~np.eye(len(a), dtype=bool)
    x, y = a[off], b[off]
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0


def correlation_test(a: Network, b: Network, reps: int = 100, seed: int = 1) -> DataFrame:
    """Correlation of two networks against random relabellings of the first's nodes."""
    _, (x, y) = _matrices([a, b])

    def draw(rng: np.random.Generator) -> float:
        p = rng.permutation(len(x))
        return _correlation(x[np.ix_(p, p)], y)

    return _result(a, _correlation(x, y), _replicates(a, reps, draw, seed))


def attribute_test(net: Network, attribute: str, statistic: str = "ei", reps: int = 100, seed: int = 1) -> DataFrame:
    """E-I index (ei) or share of balanced triangles (balance, of the ties' signs) against permuted nodes."""
    keys, (m,) = _matrices([net])
    if statistic == "ei":
        values = {r["node"]: r["a"] for r in net.nodes.select("node", F.col(attribute).alias("a")).collect()}
        g = pd.factorize(np.array([str(values[k]) for k in keys]))[0]
        i, j = np.nonzero(m)

        def stat(order: np.ndarray) -> float:
            same = g[order][i] == g[order][j]
            return float((~same).mean() - same.mean())
    else:
        s = np.sign(np.maximum(m, m.T) + np.minimum(m, m.T))
        i, j = np.nonzero(np.triu(s != 0, 1))

        def stat(order: np.ndarray) -> float:
            t = np.zeros_like(s)
            t[i, j] = t[j, i] = s[i, j][order[: len(i)] if len(order) == len(i) else np.arange(len(i))]
            c = np.trace(np.abs(t) @ np.abs(t) @ np.abs(t))
            return float((np.trace(t @ t @ t) / c + 1) / 2) if c else 0.0

    size = len(keys) if statistic == "ei" else len(i)
    return _result(net, stat(np.arange(size)), _replicates(net, reps, lambda rng: stat(rng.permutation(size)), seed))


def cug_test(net: Network, statistic: Statistic, condition: str = "density", reps: int = 100, seed: int = 1) -> DataFrame:
    """A statistic of the 0/1 matrix against random networks with the same number of ties (density), dyad census
    (census) or degrees (degrees, by swaps of arc ends)."""
    _, (m,) = _matrices([net])
    a = (m != 0).astype(float)
    np.fill_diagonal(a, 0)
    n, directed = len(a), net.directed
    upper = np.triu_indices(n, 1)

    def draw(rng: np.random.Generator) -> float:
        b = np.zeros_like(a)
        if condition == "density":
            if directed:
                off = np.flatnonzero(~np.eye(n, dtype=bool))
                b.flat[rng.choice(off, int(a.sum()), replace=False)] = 1
            else:
                pick = rng.choice(len(upper[0]), int(a.sum() / 2), replace=False)
                b[upper[0][pick], upper[1][pick]] = b[upper[1][pick], upper[0][pick]] = 1
        elif condition == "census":
            x, y = a[upper], a.T[upper]
            order = rng.permutation(len(x))
            flip = rng.random(len(x)) < 0.5
            b[upper] = np.where(flip, x, y)[order]
            b.T[upper] = np.where(flip, y, x)[order]
        elif condition == "degrees":
            b = a.copy()
            arcs = np.argwhere(b > 0)
            for _ in range(10 * len(arcs)):
                p, q = rng.integers(0, len(arcs), 2)
                (i, j), (k, w) = arcs[p], arcs[q]
                if i != w and k != j and not b[i, w] and not b[k, j] and p != q:
                    b[i, j] = b[k, w] = 0
                    b[i, w] = b[k, j] = 1
                    arcs[p], arcs[q] = (i, w), (k, j)
        else:
            raise NetworkError(f"unknown condition {condition}")
        return float(statistic(b))

    return _result(net, float(statistic(a)), _replicates(net, reps, draw, seed))


def _fit(x: np.ndarray, y: np.ndarray, family: str) -> np.ndarray:
    if family == "ols":
        return np.linalg.lstsq(x, y, rcond=None)[0]
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-10 * np.eye(x.shape[1]), x.T @ (y - p))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b


def qap(dependent: Network, predictors: dict[str, Network | DataFrame], reps: int = 100, family: str = "logit", method: str = "y", seed: int = 1) -> DataFrame:
    """term, estimate, p_two_sided of a regression of dyads (logit of tied, or ols of values). Predictors are networks or
    dyad tables (ego, alter, value). method y permutes the dependent network's nodes; dsp permutes, predictor by
    predictor, its residual on the others (ols)."""
    keys, (y,) = _matrices([dependent])
    n = len(keys)
    mats = []
    for p in predictors.values():
        if isinstance(p, Network):
            mats.append(_matrices([p])[1][0])
        else:
            import pyarrow as pa

            mats.append(_cells(p, pa.array(keys)))
    off = ~np.eye(n, dtype=bool)
    y = (y != 0).astype(float) if family == "logit" else y
    x = np.column_stack([np.ones(off.sum()), *[m[off] for m in mats]])
    observed = _fit(x, y[off], family)
    terms = ["_cons", *predictors]

    def draws(it):  # noqa: ANN001, ANN202
        for b in it:
            rows = []
            for i in b["id"]:
                rng = np.random.default_rng((seed, int(i)))
                order = rng.permutation(n)
                if method == "y":
                    est = _fit(x, y[np.ix_(order, order)][off], family)
                else:
                    est = np.zeros(len(terms))
                    for k in range(1, len(terms)):
                        rest = np.delete(x, k, 1)
                        e = np.zeros((n, n))
                        e[off] = x[:, k] - rest @ _fit(rest, x[:, k], "ols")
                        z = x.copy()
                        z[:, k] = e[np.ix_(order, order)][off]
                        est[k] = _fit(z, y[off], family)[k]
                rows += [(int(i), t, float(v)) for t, v in zip(terms, est, strict=True)]
            yield pd.DataFrame(rows, columns=["rep", "term", "estimate"])

    spark = dependent.spark
    null = spark.range(reps).repartition(max(1, min(reps, spark.sparkContext.defaultParallelism))).mapInPandas(draws, "rep long, term string, estimate double").toPandas()
    out = [(t, float(b), p_values(null.loc[null["term"] == t, "estimate"].to_numpy(), b)[2]) for t, b in zip(terms, observed, strict=True)]
    return spark.createDataFrame(out, "term string, estimate double, p_two_sided double")


def simulate_diffusion(net: Network, seeds: DataFrame, rule: str = "cascade", prob: float = 0.1, threshold: float = 1.0, periods: int = 10, spontaneous: float = 0.0, seed: int = 1) -> DataFrame:
    """node, t of adoption (seeds at 0). cascade: 1-(1-prob)^new adopters among the sources of in-ties; threshold: at
    least so many adopters; fraction: at least that share of neighbours. All nodes act at once in each period."""
    from tiegraph.operators.generators import _uniform
    from tiegraph.plans.lineage import materialize

    arcs = materialize(net.arcs.where("ego <> alter").select("ego", "alter"), "arcs")
    total = arcs.groupBy("ego").agg(F.count("*").alias("all"))
    state = materialize(net.nodes.select("node").join(seeds.select("node", F.lit(0).alias("t")), "node", "left"), "diffusion")
    for k in range(1, periods + 1):
        sources = state.where(F.col("t") == k - 1 if rule == "cascade" else F.col("t").isNotNull()).select(F.col("node").alias("alter"))
        c = arcs.join(sources, "alter").groupBy("ego").agg(F.count("*").alias("c")).join(total, "ego")
        u = _uniform(seed + k, "node")
        hit = {"cascade": u < 1 - F.pow(F.lit(1 - prob), F.col("c")), "threshold": F.col("c") >= threshold, "fraction": F.col("c") / F.col("all") >= threshold}[rule]
        new = F.col("t").isNull() & (F.coalesce(hit, F.lit(False)) | (_uniform(seed + 7919 * k, "node") < spontaneous))
        state = materialize(state.join(c, F.col("node") == F.col("ego"), "left").select("node", F.when(new, F.lit(k)).otherwise(F.col("t")).alias("t")), "diffusion")
    return state


def sample_dyads(net: Network, rows: int, seed: int = 1) -> DataFrame:
    """So many dyads without replacement (a sampling operator)."""
    return dyads(net).orderBy(F.xxhash64(F.lit(seed), "ego", "alter")).limit(rows)


def weighted_sample(table: DataFrame, weight: str, rows: int, seed: int = 1, key: str = "node") -> DataFrame:
    """So many rows without replacement, with chances of inclusion rows x weight / total (a sampling operator): systematic
    sampling along the weights in a random order, which a running sum in parts gives. Weights that would be sure are kept."""
    from tiegraph.network import dense_ids
    from tiegraph.operators.generators import _uniform

    total = table.agg(F.sum(weight)).head()[0] or 0.0
    if total <= 0:
        raise NetworkError("weights all zero")
    drawn = table.where(F.col(weight) > 0).withColumn("_u", F.xxhash64(F.lit(seed), F.col(key)))
    order = dense_ids(drawn.select(F.struct("_u", F.col(key).alias("k")).alias("node"))).select(F.col("node.k").alias(key), F.col("id").alias("_at"))
    from pyspark.sql import Window

    from tiegraph.plans.lineage import materialize

    parts = materialize(drawn.join(order, key).repartitionByRange("_at").withColumn("_p", F.spark_partition_id()), "weights")
    sums = parts.groupBy("_p").agg(F.sum(weight).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_b"))
    upto = F.sum(weight).over(Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_b")
    start = np.random.default_rng(seed).random()
    step = total / rows
    marks = lambda c: F.floor(c / step - start)
    out = parts.join(F.broadcast(before), "_p").withColumn("_to", upto)
    return out.where(marks(F.col("_to")) > marks(F.col("_to") - F.col(weight))).select(*table.columns)


def compare_fits(fits: DataFrame, sort: str | None = None) -> DataFrame:
    """(model, n, ll, k) to the same with aic and bic, best first by ``sort`` (aic, bic or ll)."""
    out = fits.select("model", "n", "ll", "k", (2 * F.col("k") - 2 * F.col("ll")).alias("aic"), (F.log("n") * F.col("k") - 2 * F.col("ll")).alias("bic"))
    if sort is None:
        return out
    if sort not in ("aic", "bic", "ll"):
        raise NetworkError(f"unknown criterion {sort}")
    return out.orderBy(F.desc("ll") if sort == "ll" else sort)
