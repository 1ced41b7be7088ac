"""Backbones: p-values of ties under null models, corrected for multiple testing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError

#: Pairs of degrees whose tails a task keeps.
_KNOWN_TAILS = 20_000
METHODS = ("none", "bonferroni", "holm", "hochberg", "hommel", "BH", "fdr", "BY")


def threshold(net: Network, upper: float, lower: float | None = None) -> Network:
    """Global threshold: 1 above ``upper``; with ``lower``, -1 below it."""
    v = F.when(F.col("value") > upper, 1.0)
    if lower is not None:
        v = v.when(F.col("value") < lower, -1.0)
    return net.with_(edges=net.ties.select("ego", "alter", v.alias("value")).where("value is not null"), valued=lower is not None)


def disparity(net: Network) -> DataFrame:
    """ego, alter, value, p: (1 - w/s)^(k - 1), the smaller of the two ends (directed: sender's out, receiver's in)."""
    arcs = net.arcs.where("ego <> alter")
    end = lambda key: arcs.groupBy(key).agg(F.sum("value").alias(f"s_{key}"), F.count("*").alias(f"k_{key}"))
    t = arcs.join(end("ego"), "ego").join(end("alter"), "alter")
    p = lambda e: F.pow(1 - F.col("value") / F.col(f"s_{e}"), F.col(f"k_{e}") - 1)
    out = t.select("ego", "alter", "value", F.least(p("ego"), p("alter")).alias("p"))
    return out if net.directed else out.where("ego < alter")


def lans(net: Network) -> DataFrame:
    """ego, alter, value, p: 1 minus the share of the sender's ties that are no larger; undirected: the smaller of both ends."""
    w = Window.partitionBy("ego")
    ranked = net.arcs.where("ego <> alter").withColumn("p", 1 - F.cume_dist().over(w.orderBy("value")))
    if net.directed:
        return ranked.select("ego", "alter", "value", "p")
    pairs = ranked.groupBy(F.least("ego", "alter").alias("a"), F.greatest("ego", "alter").alias("b")).agg(F.first("value").alias("value"), F.min("p").alias("p"))
    return pairs.select(F.col("a").alias("ego"), F.col("b").alias("alter"), "value", "p")


def _log_binomial(k: int, n: int, p: float) -> float:
    """log P(X = k), 0 < k < n: Stirling's remainders and deviances (Loader), as differences of log-gammas lose digits."""

    def rest(x: int) -> float:
        return math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) if x < 16 else (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x

    def deviance(x: int, mean: float) -> float:
        d = (x - mean) / (x + mean)
        if abs(d) > 0.1:
            return x * math.log(x / mean) + mean - x
        total, term, i = (x - mean) * d, 2 * x * d, 3
        while True:
            term *= d * d
            new = total + term / i
            if new == total:
                return total
            total, i = new, i + 2

    return rest(n) - rest(k) - rest(n - k) - deviance(k, n * p) - deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def _binomial_tail(k: float, n: float, p: float) -> float:
    """P(X >= k), from the side of k away from the mean: terms fall there, each from the one before."""
    k, n = int(k), int(n)
    if k <= 0 or p >= 1 and k <= n:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    odds, above = p / (1 - p), k > n * p
    if not above:
        k -= 1
    if 0 < k < n:
        term = math.exp(max(_log_binomial(k, n, p), -745.0))
    else:
        term = math.exp(max(n * (math.log1p(-p) if k == 0 else math.log(p)), -745.0))
    total = 0.0
    while term > total * 1e-17:
        total += term
        if k == (n if above else 0):
            break
        term *= (n - k) / (k + 1) * odds if above else k / ((n - k + 1) * odds)
        k += 1 if above else -1
    return min(1.0, total if above else 1 - total)


def _hyper_tails(a: int, b: int, n: int) -> np.ndarray:
    """P(S >= s), s from 0 on, of the shared columns S of two rows with a and b of n."""
    least, most = max(0, a + b - n), min(a, b)
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    i = np.arange(least, most)
    steps = np.log((a - i) * (b - i) / ((i + 1.0) * (n - a - b + i + 1.0)))
    chance = np.exp(choose(a, least) + choose(n - a, b - least) - choose(n, b) + np.concatenate([[0.0], np.cumsum(steps)]))
    return np.minimum(1.0, np.concatenate([np.ones(least), np.cumsum(chance[::-1])[::-1]]))


def _mapped(df: DataFrame, columns: list[str], function) -> DataFrame:  # noqa: ANN001
    schema = ", ".join(f"{c} {k}" for c, k in df.dtypes) + ", p double"

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[function(*row) for row in zip(*(b[c] for c in columns), strict=True)])

    return df.mapInPandas(apply, schema)


def mlf(net: Network, more: int = 0) -> DataFrame:
    """ego, alter, value, p: binomial tail from the value plus ``more`` on of whole tie values; Pr = s_i s_j / (2 T^2), directed out_i in_j / T^2."""
    arcs = net.arcs.where("ego <> alter")
    total = net.ties.where("ego <> alter").agg(F.sum("value").alias("total"))
    t = arcs.join(arcs.groupBy("ego").agg(F.sum("value").alias("si")), "ego").join(arcs.groupBy("alter").agg(F.sum("value").alias("sj")), "alter").crossJoin(F.broadcast(total))
    pr = F.col("si") * F.col("sj") / (F.col("total") * F.col("total") * (1 if net.directed else 2))
    t = t.select("ego", "alter", "value", "total", pr.alias("pr"))
    t = t if net.directed else t.where("ego < alter")
    return _mapped(t, ["value", "total", "pr"], lambda k, n, q: _binomial_tail(k + more, n, q)).select("ego", "alter", "value", "p")


def _projected(net: Network, mode: int) -> DataFrame:
    from tiegraph.operators.transform import project

    own, other = ("ego", "alter") if mode == 1 else ("alter", "ego")
    k = net.ties.groupBy(F.col(own).alias("node")).agg(F.count("*").alias("k"))
    n = net.nodes.where(F.col("mode") != mode).agg(F.count("*").alias("n"))
    del other
    e = project(net, mode).edges
    return e.join(k.withColumnsRenamed({"node": "ego", "k": "ki"}), "ego").join(k.withColumnsRenamed({"node": "alter", "k": "kj"}), "alter").crossJoin(F.broadcast(n))


def fixed_row(net: Network, mode: int = 1, more: int = 0) -> DataFrame:
    """ego, alter, value, p: hypergeometric tail from the value plus ``more`` on of the shared partners of a two-mode network's
    rows. Each task works out the tails of a pair of degrees once for all its pairs of rows."""
    t = _projected(net, mode).select("ego", "alter", "value", "ki", "kj", "n")
    kind = dict(t.dtypes)["ego"]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            s, k, n = batch["value"].to_numpy().astype(np.int64) + more, np.sort(batch[["ki", "kj"]].to_numpy(), axis=1), batch["n"].to_numpy()
            p = np.zeros(len(batch))
            order = np.lexsort((k[:, 1], k[:, 0]))
            at = np.flatnonzero(np.concatenate([[True], (np.diff(k[order], axis=0) != 0).any(1)])) if len(order) else []
            for mine in np.split(order, at[1:]):
                if len(mine):
                    a, b = k[mine[0]].tolist()
                    if (a, b) not in known:
                        if len(known) >= _KNOWN_TAILS:
                            known.clear()
                        known[a, b] = _hyper_tails(a, b, int(n[mine[0]]))
                    tails = known[a, b]
                    p[mine] = np.where(s[mine] < len(tails), tails[np.clip(s[mine], 0, len(tails) - 1)], 0.0)
            yield batch[["ego", "alter", "value"]].assign(p=p)

    return t.mapInPandas(apply, f"ego {kind}, alter {kind}, value double, p double")


def _normal(z: Column) -> tuple[Column, Column]:
    """Distribution function and density of the normal distribution; erfc by a series good to 1e-7."""
    a = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * a)
    # Coefficients of the series.
    series = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(series[-1])
    for c in reversed(series[:-1]):
        poly = poly * t + c
    erfc = t * F.exp(-a * a + poly)
    return F.when(z >= 0, 1 - erfc / 2).otherwise(erfc / 2), F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _refined(x: Column, mu: Column, var: Column, third: Column) -> tuple[Column, Column]:
    """P(X >= x) and P(X <= x) of a sum of independent draws: normal with continuity and skewness corrections."""
    sd = F.sqrt(F.greatest(var, F.lit(1e-300)))
    skew = third / (6 * sd * sd * sd)

    def below(z: Column) -> Column:
        cdf, density = _normal(z)
        return cdf + skew * (1 - z * z) * density

    clip = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return clip(1 - below((x - 0.5 - mu) / sd)), clip(below((x + 0.5 - mu) / sd))


def fixed_column(net: Network, mode: int = 1) -> DataFrame:
    """ego, alter, value, p, lower: refined normal tails; each partner q of c rows joins a pair with chance c(c-1)/(m(m-1))."""
    own, other = ("ego", "alter") if mode == 1 else ("alter", "ego")
    m = net.nodes.where(F.col("mode") == mode).agg(F.count("*").alias("m"))
    p = F.col("c") * (F.col("c") - 1) / (F.col("m") * (F.col("m") - 1))
    moments = net.ties.groupBy(other).agg(F.count(own).alias("c")).crossJoin(F.broadcast(m)).agg(F.sum(p).alias("mu"), F.sum(p * (1 - p)).alias("var"), F.sum(p * (1 - p) * (1 - 2 * p)).alias("third"))
    t = _projected(net, mode).crossJoin(F.broadcast(moments))
    up, low = _refined(F.col("value"), F.col("mu"), F.col("var"), F.col("third"))
    return t.select("ego", "alter", "value", up.alias("p"), low.alias("lower"))


def sdsm(net: Network, mode: int = 1, rounds: int = 10_000, tol: float = 1e-10) -> DataFrame:
    """ego, alter, value, p, lower: refined normal tails with tie chances x_i y_q / (1 + x_i y_q) whose sums are the degrees.

    Rows of equal degree have equal chances, so the fixed point runs over degree classes (m ties have at most sqrt(2m) of
    each mode), and moments are computed once for each pair of degrees that occurs.
    """
    own, other = ("ego", "alter") if mode == 1 else ("alter", "ego")
    t = net.ties.select(F.col(own).alias("i"), F.col(other).alias("q"))
    classes = lambda c: t.groupBy(c).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n")).toArrow().sort_by("k")
    (k, nk), (c, nc) = ([x.column(name).to_numpy().astype(float) for name in ("k", "n")] for x in (classes("i"), classes("q")))
    # nodes tied to all or none of those left are sure, and leave the fixed point
    p, need, have = np.zeros((len(k), len(c))), k.copy(), c.copy()
    rows, cols = np.ones(len(k), bool), np.ones(len(c), bool)
    while True:
        full, none = rows & (need >= nc[cols].sum()), rows & (need <= 0)
        p[np.ix_(full, cols)] = 1.0
        have[cols] -= nk[full].sum()
        rows &= ~(full | none)
        full2, none2 = cols & (have >= nk[rows].sum()), cols & (have <= 0)
        p[np.ix_(rows, full2 & ~none2)] = 1.0
        need[rows] -= nc[full2 & ~none2].sum()
        cols &= ~(full2 | none2)
        if not (full | none).any() and not (full2 | none2).any():
            break
    if rows.any() and cols.any():
        k1, n1, c1, n2 = need[rows], nk[rows], have[cols], nc[cols]
        s = np.sqrt((k1 * n1).sum())
        x, y = k1 / s, c1 / s
        for _ in range(rounds):
            nx = k1 / (n2 * y / (1 + np.outer(x, y))).sum(1)
            ny = c1 / ((n1 * nx)[:, None] / (1 + np.outer(nx, y))).sum(0)
            done = max(np.abs(nx / x - 1).max(), np.abs(ny / y - 1).max()) < tol
            x, y = nx, ny
            if done:
                break
        else:
            raise NetworkError("the chances did not settle")
        p[np.ix_(rows, cols)] = np.outer(x, y) / (1 + np.outer(x, y))
    chance = {int(d): row for d, row in zip(k, p, strict=True)}

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [chance[i] * chance[j] for i, j in zip(b["ki"], b["kj"], strict=True)]
            rows = [((p * nc).sum(), (p * (1 - p) * nc).sum(), (p * (1 - p) * (1 - 2 * p) * nc).sum()) for p in both]
            yield b.assign(**dict(zip(("mu", "var", "third"), zip(*rows, strict=True), strict=True)) if rows else {"mu": 0.0, "var": 0.0, "third": 0.0})

    pairs = _projected(net, mode)
    table = pairs.select("ki", "kj").distinct().mapInPandas(moments, "ki long, kj long, mu double, var double, third double")
    up, low = _refined(F.col("value"), F.col("mu"), F.col("var"), F.col("third"))
    return pairs.join(table, ["ki", "kj"]).select("ego", "alter", "value", up.alias("p"), low.alias("lower"))


def fixed_fill(net: Network, mode: int = 1) -> DataFrame:
    """ego, alter, value, p: exact tail of the shared partners of two rows when all ones fall anywhere in the matrix.

    k shared columns and t ones in the two rows: C(c,k) C(c-k,t-2k) 2^(t-2k) C((r-2)c, f-t) / C(rc, f), summed over t.
    """
    sizes = net.nodes.groupBy("mode").agg(F.count("*").alias("n")).collect()
    r, c = (next(x["n"] for x in sizes if x["mode"] == m) for m in (mode, 3 - mode))
    f = net.ties.count()
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, r * c + 1)))]) if r * c <= 10_000_000 else None
    fact = (lambda n: logs[n]) if logs is not None else np.vectorize(lambda n: math.lgamma(n + 1.0), otypes=[float])
    choose = lambda x, y: np.where((y >= 0) & (y <= x), fact(np.maximum(x, 0)) - fact(np.clip(y, 0, np.maximum(x, 0))) - fact(np.maximum(x - np.clip(y, 0, np.maximum(x, 0)), 0)), -np.inf)
    # ones in the two rows: nearly all of the chance lies within 40 standard deviations
    mean, sd = 2 * f / r, math.sqrt(2 * f / r) + 1
    t = np.arange(max(0, int(mean - 40 * sd)), min(2 * c, f, int(mean + 40 * sd)) + 1)
    rest = choose((r - 2) * c, f - t) - float(choose(np.int64(r * c), np.int64(f)))
    chance = np.zeros(c + 1)
    for k in range(c + 1):
        on = (t >= 2 * k) & (t <= c + k)
        if on.any():
            u = t[on]
            chance[k] = np.exp(choose(c, k) + choose(c - k, u - 2 * k) + (u - 2 * k) * math.log(2) + rest[on]).sum()
    tails = np.minimum(1.0, np.cumsum(chance[::-1])[::-1])
    t = _projected(net, mode).select("ego", "alter", "value")
    return _mapped(t, ["value"], lambda s: float(tails[int(s)]))


def fdsm(net: Network, mode: int = 1, trials: int = 1000, seed: int = 1) -> DataFrame:
    """ego, alter, value, p: share of random two-mode networks with the same degrees on both sides (curveball trades, five
    for each row and draw) in which the pair shares as many partners. Draws run in parallel; at most 3,000 rows."""
    own, other = ("ego", "alter") if mode == 1 else ("alter", "ego")
    lists = net.ties.groupBy(F.col(own).alias("i")).agg(F.sort_array(F.collect_set(other)).alias("q")).orderBy("i")
    if lists.count() > 3_000:
        raise NetworkError("too many rows for draws of whole matrices")
    rows = lists.collect()
    keys, columns = [x["i"] for x in rows], {q: k for k, q in enumerate(sorted({q for x in rows for q in x["q"]}))}
    start = [sorted(columns[q] for q in x["q"]) for x in rows]
    n, m = len(keys), len(columns)

    def shares(sets: list[list[int]]) -> np.ndarray:
        b = np.zeros((n, m), np.float32)
        for i, s in enumerate(sets):
            b[i, s] = 1
        return b @ b.T

    seen = shares(start)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, draws = np.zeros((n, n), np.int64), 0
        for batch in batches:
            for rep in batch["id"]:
                rng, sets = np.random.default_rng((seed, int(rep))), [list(s) for s in start]
                for _ in range(5 * n):
                    a, b = rng.choice(n, 2, replace=False)
                    x, y = set(sets[a]), set(sets[b])
                    loose = np.array(sorted(x ^ y))
                    rng.shuffle(loose)
                    k = len(x - y)
                    sets[a], sets[b] = sorted((x & y) | set(loose[:k].tolist())), sorted((x & y) | set(loose[k:].tolist()))
                count += shares(sets) >= seen
                draws += 1
        i, j = np.nonzero(np.triu(seen, 1))
        yield pd.DataFrame({"i": i, "j": j, "hits": count[i, j], "draws": draws})

    spark = net.spark
    parts = max(1, min(trials, spark.sparkContext.defaultParallelism))
    hits = spark.range(trials).repartition(parts).mapInPandas(draw, "i long, j long, hits long, draws long").groupBy("i", "j").agg((F.sum("hits") / F.sum("draws")).alias("p"))
    kind = dict(net.nodes.dtypes)["node"]
    label = spark.createDataFrame(list(enumerate(keys)), f"k long, node {kind}")
    named = hits.join(label.select(F.col("k").alias("i"), F.col("node").alias("ego")), "i").join(label.select(F.col("k").alias("j"), F.col("node").alias("alter")), "j")
    return _projected(net, mode).select("ego", "alter", "value").join(named.select("ego", "alter", "p"), ["ego", "alter"])


def _scan(table: DataFrame, order: str, value: Column, best: str, backward: bool = False) -> DataFrame:
    """Add ``adjusted``: the running max or min of ``value`` along ``order`` (from the end if ``backward``): inside parts of
    the range of ``order``, and over the parts before, of which there are few."""
    from tiegraph.plans.lineage import materialize

    pick = {"max": F.max, "min": F.min}[best]
    parts = materialize(table.withColumn("_v", value).repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "scan")
    key = (lambda c: F.desc(c)) if backward else F.col
    ends = parts.groupBy("_part").agg(pick("_v").alias("_b"))
    before = ends.select("_part", pick("_b").over(Window.orderBy(key("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    here = pick("_v").over(Window.partitionBy("_part").orderBy(key(order)).rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.withColumn("_here", here).join(F.broadcast(before), "_part")  # a row for each part
    both = F.greatest("_here", "_before") if best == "max" else F.least("_here", "_before")
    return joined.withColumn("adjusted", F.least(F.lit(1.0), both)).drop("_part", "_here", "_before", "_v")


def adjust(p: DataFrame, method: str = "holm") -> DataFrame:
    """Add ``adjusted``. Ranks come from a range partitioning, running extremes from its parts: no task sees all tests.
    hommel compares all sizes of sets and takes at most HOMMEL_TESTS tests."""
    if method not in METHODS:
        raise NetworkError(f"unknown correction {method}")
    if method == "none":
        return p.withColumn("adjusted", F.col("p"))
    from tiegraph.network import dense_ids
    from tiegraph.plans.lineage import materialize

    if method == "hommel":
        return _hommel(p)
    m = p.agg(F.count("*").alias("m"))
    if method == "bonferroni":
        return p.crossJoin(F.broadcast(m)).withColumn("adjusted", F.least(F.lit(1.0), F.col("m") * F.col("p"))).drop("m")
    p = materialize(p, "tests")
    ranked = dense_ids(p.select(F.struct("p", *[c for c in p.columns if c != "p"]).alias("node"))).select("node.*", F.col("id").alias("_r"))
    t = ranked.select(*p.columns, "_r").crossJoin(F.broadcast(p.agg(F.count("*").alias("_m"))))
    m, r, x = F.col("_m"), F.col("_r"), F.col("p")
    if method == "holm":
        out = _scan(t, "_r", (m - r + 1) * x, "max")
    elif method == "hochberg":
        out = _scan(t, "_r", (m - r + 1) * x, "min", True)
    else:
        n = p.count()
        harmonic = sum(1 / i for i in range(1, n + 1)) if n < 10_000_000 else math.log(n) + 0.5772156649015329 + 1 / (2 * n)
        out = _scan(t, "_r", (harmonic if method == "BY" else 1.0) * m / r * x, "min", True)
    return out.select(*p.columns, "adjusted")


HOMMEL_TESTS = 20_000


def _hommel(p: DataFrame) -> DataFrame:
    """For each size k of sets, the Simes value of the k largest p; a test's value is the least max(k p, T_k), T_k being the
    largest Simes value of sets of more than k."""
    if p.count() > HOMMEL_TESTS:
        raise NetworkError(f"hommel takes at most {HOMMEL_TESTS} tests")
    schema = ", ".join(f"{c} {k}" for c, k in p.dtypes) + ", adjusted double"

    def apply(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("p").reset_index(drop=True)
        x, n = b["p"].to_numpy(), len(b)
        simes = np.array([(k * x[n - k :] / np.arange(1, k + 1)).min() for k in range(1, n + 1)])
        over = np.concatenate([np.maximum.accumulate(simes[::-1])[::-1], [0.0]])  # over[k]: sets of more than k
        k = np.arange(n + 1)
        out = np.array([np.maximum(k * v, over).min() for v in x])
        return b.drop(columns="_all").assign(adjusted=np.minimum(np.maximum(out, x), 1.0))

    return p.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(apply, schema)


def _lower(net: Network, tested: DataFrame, method: str, mode: int) -> DataFrame:
    """``tested`` with the lower tail of each tie as ``lower``."""
    if "lower" in tested.columns:
        return tested
    if method == "disparity":
        return tested.withColumn("lower", 1 - F.col("p"))
    if method == "lans":
        ranked = net.arcs.where("ego <> alter").withColumn("lower", 1 - F.cume_dist().over(Window.partitionBy("ego").orderBy(F.desc("value"))))
        if not net.directed:
            ranked = ranked.groupBy(F.least("ego", "alter").alias("ego"), F.greatest("ego", "alter").alias("alter")).agg(F.min("lower").alias("lower"))
        return tested.join(ranked.select("ego", "alter", "lower"), ["ego", "alter"])
    if method == "mlf":  # P(X <= k) = 1 - P(X >= k + 1)
        above = mlf(net, 1).select("ego", "alter", F.col("p").alias("_above"))
    elif method == "fixedrow":
        above = fixed_row(net, mode, 1).select("ego", "alter", F.col("p").alias("_above"))
    else:
        raise NetworkError(f"no signed backbone by {method}")
    return tested.join(above, ["ego", "alter"]).withColumn("lower", 1 - F.col("_above")).drop("_above")


def backbone(net: Network, method: str = "disparity", alpha: float = 0.05, correction: str = "none", mode: int = 1, signed: bool = False) -> Network:
    """Ties whose corrected p is below ``alpha``. ``signed``: also ties (-1) that are as surprisingly weak; the smaller tail
    of each tie is corrected and compared with half of ``alpha``."""
    tests = {"disparity": disparity, "lans": lans, "mlf": mlf, "fixedrow": lambda n: fixed_row(n, mode), "fixedcol": lambda n: fixed_column(n, mode), "sdsm": lambda n: sdsm(n, mode), "fixedfill": lambda n: fixed_fill(n, mode), "fdsm": lambda n: fdsm(n, mode)}
    if method not in tests:
        raise NetworkError(f"unknown method {method}")
    table, sign = tests[method](net), F.lit(1.0)
    if signed:
        table = _lower(net, table, method, mode).select("ego", "alter", F.least("p", "lower").alias("p"), (F.col("p") >= F.col("lower")).alias("weak"))
        sign = F.when(F.col("weak"), -1.0).otherwise(1.0)
    kept = adjust(table.select("ego", "alter", "p", *(["weak"] if signed else [])), correction).where(F.col("adjusted") < (alpha / 2 if signed else alpha))
    nodes = net.nodes.where(F.col("mode") == mode).drop("mode") if net.two_mode else net.nodes
    return Network(nodes, kept.select("ego", "alter", sign.alias("value")), directed=net.directed and not net.two_mode, valued=signed, name=f"{net.name}_backbone")
