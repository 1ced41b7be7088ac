"""Measures by one pass or a few joins: every node has a row, isolates with the value the measure defines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError

_z = lambda c: F.coalesce(F.col(c), F.lit(0.0))


def _per_node(net: Network, table: DataFrame, fill: dict[str, float] | None = None) -> DataFrame:
    out = net.nodes.select("node").join(table, "node", "left")
    return out.fillna(fill) if fill else out


def degree(net: Network, alpha: float | None = None, binary: bool = False, standardize: bool = False) -> DataFrame:
    """node, out, in, total (undirected: degree in all three): k (s/k)^alpha of k ties and strength s; valued networks
    take strengths (alpha 1) unless ``binary``. ``standardize`` divides by n - 1."""
    alpha = 0.0 if binary or not net.valued else 1.0 if alpha is None else alpha
    arcs = net.arcs.where("ego <> alter") if not net.selfloop else net.arcs
    score = lambda: F.count("*") * F.pow(F.sum("value") / F.count("*"), F.lit(alpha))
    out = arcs.groupBy(F.col("ego").alias("node")).agg(score().alias("out"))
    if net.directed:
        back = arcs.groupBy(F.col("alter").alias("node")).agg(score().alias("in"))
        both = out.join(back, "node", "full")
    else:
        both = out.withColumn("in", F.col("out"))
    res = _per_node(net, both, {"out": 0.0, "in": 0.0}).withColumn("total", F.col("out") + F.col("in") if net.directed else F.col("out"))
    if standardize:
        n = max(2, net.n_nodes())
        res = res.select("node", *[(F.col(c) / (n - 1)).alias(c) for c in ("out", "in", "total")])
    return res.withColumn("isolate", (F.col("total") == 0).cast("int"))


def two_mode_degree(net: Network, raw: bool = False) -> DataFrame:
    """node, mode, degree: ties of a node over the size of the other mode (``raw``: their number)."""
    net.need(two_mode=True)
    t = net.ties
    k = t.groupBy(F.col("ego").alias("node")).agg(F.count("*").alias("k")).union(t.groupBy(F.col("alter").alias("node")).agg(F.count("*").alias("k")))
    sizes = net.nodes.groupBy((3 - F.col("mode")).alias("mode")).agg(F.count("*").alias("others"))
    both = net.nodes.select("node", "mode").join(k, "node", "left").join(F.broadcast(sizes), "mode", "left")
    d = F.coalesce("k", F.lit(0)).cast("double")
    return both.select("node", "mode", (d if raw else d / F.col("others")).alias("degree"))


def degree_distribution(net: Network) -> DataFrame:
    """degree, nodes, ccdf (share of nodes with at least that degree). The window is over the different degrees only, of
    which m ties allow at most sqrt(2m)."""
    d = degree(net, binary=True).groupBy(F.col("out").cast("long").alias("degree")).agg(F.count("*").alias("nodes"))
    above = F.sum("nodes").over(Window.orderBy(F.desc("degree")))
    return d.select("degree", "nodes", (above / F.sum("nodes").over(Window.partitionBy())).alias("ccdf"))


def centralization(net: Network) -> DataFrame:
    """Degree centralization: sum(max - d)/((n-2)(n-1)) undirected; directed out and in over (n-1)^2."""
    d = degree(net, binary=True)
    x = d.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in ("out", "in") for p, f in (("max", F.max), ("sum", F.sum))])
    n = F.col("n")
    div = F.nullif((n - 1) * (n - 1) if net.directed else (n - 2) * (n - 1), F.lit(0))
    return x.select(*[((n * F.col(f"max_{c}") - F.col(f"sum_{c}")) / div).alias(f"centralization_{c}") for c in ("out", "in")])


def summary(net: Network, detail: bool = False) -> DataFrame:
    """One row: nodes, ties, density, sum, min, max (with the zeros of empty dyads), mean degree; with ``detail`` of a
    one-mode network also reciprocity, transitivity and degree centralization (out and in)."""
    if detail:
        from tiegraph.operators.structure import clustering_summary

        net.need(two_mode=False)
        parts = [dyad_census(net).select("reciprocity"), clustering_summary(net).select(F.col("global").alias("transitivity")), centralization(net)]
        out = summary(net)
        for part in parts:  # tables of one row
            out = out.crossJoin(part)
        return out
    n = net.nodes.agg(F.count("*").alias("nodes"))
    t = net.ties.where("ego <> alter").agg(F.count("*").alias("ties"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    gaps = net.edges.where("value is null and ego <> alter").agg(F.count("*").alias("missing"))
    x = n.crossJoin(t).crossJoin(gaps)
    if net.two_mode:
        m = net.nodes.agg(F.sum(F.when(F.col("mode") == 1, 1).otherwise(0)).alias("n1"))
        x = x.crossJoin(m).withColumn("dyads", F.col("n1") * (F.col("nodes") - F.col("n1")))
    else:
        x = x.withColumn("dyads", F.col("nodes") * (F.col("nodes") - 1) / (1 if net.directed else 2))
    open_ = F.col("ties") + F.col("missing") < F.col("dyads")
    return x.select(
        "nodes", "ties", (F.col("ties") / F.nullif((F.col("dyads") - F.col("missing")).cast("double"), F.lit(0.0))).alias("density"), "sum", F.when(open_, F.least(_z("lo"), F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
        F.when(open_, F.greatest(_z("hi"), F.lit(0.0))).otherwise(F.col("hi")).alias("max"), (F.col("ties") * (1 if net.directed else 2) / F.nullif(F.col("nodes"), F.lit(0))).alias("mean_degree"),
    )


def _with_attribute(net: Network, table: DataFrame, attribute: str) -> DataFrame:
    a = net.nodes.select(F.col("node").alias("ego"), F.col(attribute).alias("x"))
    b = net.nodes.select(F.col("node").alias("alter"), F.col(attribute).alias("y"))
    return table.join(a, "ego", "left").join(b, "alter", "left")


def tabulate(net: Network, attribute: str | None = None) -> DataFrame:
    """Frequencies of tie values, or of the attribute pairs of ties; undirected ties once (ego <= alter)."""
    if attribute is None:
        return net.ties.groupBy("value").agg(F.count("*").alias("ties"))
    return _with_attribute(net, net.ties, attribute).groupBy(F.col("x").alias("ego_group"), F.col("y").alias("alter_group")).agg(F.count("*").alias("ties"))


def mixing(net: Network, attribute: str) -> DataFrame:
    """Tie counts between groups, undirected ties in both directions."""
    return _with_attribute(net, net.arcs, attribute).where("x is not null and y is not null").groupBy(F.col("x").alias("ego_group"), F.col("y").alias("alter_group")).agg(F.count("*").alias("ties"))


def ei_index(net: Network, attribute: str) -> DataFrame:
    """external, internal, ei = (E - I)/(E + I)."""
    m = _with_attribute(net, net.ties, attribute).where("x is not null and y is not null")
    c = m.agg(F.sum((F.col("x") != F.col("y")).cast("long")).alias("external"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("internal"))
    return c.withColumn("ei", (F.col("external") - F.col("internal")) / F.nullif(F.col("external") + F.col("internal"), F.lit(0)))


def at_hops(net: Network, hop: int) -> DataFrame:
    """(ego, alter): nodes exactly ``hop`` steps along the ties away."""
    from tiegraph.plans.lineage import materialize

    arcs = materialize(net.arcs.where("ego <> alter").select(F.col("ego").alias("from"), F.col("alter").alias("to")), "hops")
    layer = arcs.select(F.col("from").alias("ego"), F.col("to").alias("alter")).distinct()
    known = net.nodes.select(F.col("node").alias("ego"), F.col("node").alias("alter"))
    for _ in range(hop - 1):
        known = known.unionByName(layer)
        step = layer.join(arcs, F.col("alter") == F.col("from")).select("ego", F.col("to").alias("alter")).distinct()
        layer = materialize(step.join(known, ["ego", "alter"], "left_anti"), "hops")
    return layer


def alter_stats(net: Network, attribute: str, value: object = None, hop: int = 1) -> DataFrame:
    """Statistics of an attribute over out-neighbours with a value: mean, wmean (by tie value), sum, min, max, sd, count,
    diversity (1 - sum p^2), proportion equal to ``value``. No such alter: null, but 0 for sum and count. ``hop``: over the
    nodes exactly so many steps away, which have no tie value (wmean null)."""
    if not net.ties.where("value < 0").isEmpty():
        raise NetworkError("negative tie values")
    x = F.col("x").cast("double")
    arcs = net.arcs if hop == 1 else at_hops(net, hop).withColumn("value", F.lit(None).cast("double"))
    t = arcs.join(net.nodes.select(F.col("node").alias("alter"), F.col(attribute).alias("x")), "alter").where("x is not null")
    base = t.groupBy(F.col("ego").alias("node")).agg(
        F.avg(x).alias("mean"), (F.sum(x * F.col("value")) / F.sum("value")).alias("wmean"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_samp(x).alias("sd"), F.count("*").alias("count"),
        (F.avg((F.col("x") == F.lit(value)).cast("double")) if value is not None else F.lit(None).cast("double")).alias("proportion"),
    )
    p = t.groupBy(F.col("ego").alias("node"), "x").agg(F.count("*").alias("c")).groupBy("node").agg((1 - F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), F.lit(2))).alias("diversity"))
    return _per_node(net, base.join(p, "node"), {"sum": 0.0, "count": 0})


def row_median(table: DataFrame, columns: list[str], name: str = "median") -> DataFrame:
    """``table`` with the median of some columns of each row; missing values are left out."""
    have = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull()))
    n = F.size(have)
    return table.withColumn(name, F.when(n > 0, (F.get(have, F.floor((n - 1) / 2).cast("int")) + F.get(have, F.floor(n / 2).cast("int"))) / 2))


def group_median(table: DataFrame, value: str, by: str) -> DataFrame:
    """by, median: the exact median of each group."""
    return table.groupBy(by).agg(F.percentile(F.col(value), 0.5).alias("median"))


def joined_labels(table: DataFrame, columns: list[str], sep: str = " ", name: str = "label") -> DataFrame:
    """``table`` with a label of several columns, missing ones left out."""
    return table.withColumn(name, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))


def context(net: Network, attribute: str, mode: str = "outgoing", with_ego: bool = False) -> DataFrame:
    """Weighted statistics of tied alters: mean, sum, min, max, sd (population). mode outgoing, incoming, either (larger
    of the two directions) or both (smaller); ``with_ego`` adds the node itself with weight 1."""
    arcs = net.arcs.where("ego <> alter")
    back = arcs.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), F.col("value").alias("back"))
    if mode == "incoming":
        w = back.withColumnRenamed("back", "value")
    elif mode in ("either", "both"):
        full = arcs.join(back, ["ego", "alter"], "full").fillna(0.0, ["value", "back"])
        w = full.select("ego", "alter", (F.greatest if mode == "either" else F.least)("value", "back").alias("value")).where("value <> 0")
    else:
        w = arcs
    if with_ego:
        w = w.unionByName(net.nodes.select(F.col("node").alias("ego"), F.col("node").alias("alter"), F.lit(1.0).alias("value")))
    t = w.join(net.nodes.select(F.col("node").alias("alter"), F.col(attribute).cast("double").alias("x")), "alter").where("x is not null")
    v, x = F.col("value"), F.col("x")
    s = t.groupBy(F.col("ego").alias("node")).agg((F.sum(v * x) / F.sum(v)).alias("mean"), F.sum(v * x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(v * x * x).alias("_q"), F.sum(v).alias("_w"))
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_w") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return _per_node(net, s.withColumn("sd", sd).drop("_q", "_w"))


def dyad_census(net: Network) -> DataFrame:
    """mutual, asymmetric, null_dyads, reciprocity."""
    arcs = net.arcs.where("ego <> alter").select(F.least("ego", "alter").alias("a"), F.greatest("ego", "alter").alias("b"))
    c = arcs.groupBy("a", "b").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum((F.col("k") == 2).cast("long")), F.lit(0)).alias("mutual"), F.coalesce(F.sum((F.col("k") == 1).cast("long")), F.lit(0)).alias("asymmetric"))
    n = net.nodes.agg(F.count("*").alias("n"))
    x = c.crossJoin(n)
    return x.select("mutual", "asymmetric", (F.col("n") * (F.col("n") - 1) / 2 - F.col("mutual") - F.col("asymmetric")).cast("long").alias("null_dyads"), (F.col("mutual") / F.nullif(F.col("mutual") + F.col("asymmetric"), F.lit(0))).alias("reciprocity"))


def assortativity(net: Network, attribute: str | None = None, weighted: bool = False) -> DataFrame:
    """Pearson correlation over tied pairs listed both ways, of degrees or an attribute."""
    links = net.links
    if weighted:
        w = net.arcs.select(F.least("ego", "alter").alias("a"), F.greatest("ego", "alter").alias("b"), "value").groupBy("a", "b").agg(F.max("value").alias("w"))
        links = links.join(w, (F.least("ego", "alter") == F.col("a")) & (F.greatest("ego", "alter") == F.col("b"))).select("ego", "alter", "w")
    else:
        links = links.withColumn("w", F.lit(1.0))
    v = net.nodes.select("node", F.col(attribute).cast("double").alias("v")) if attribute else net.links.groupBy(F.col("ego").alias("node")).agg(F.count("*").cast("double").alias("v"))
    t = links.join(v.select(F.col("node").alias("ego"), F.col("v").alias("x")), "ego").join(v.select(F.col("node").alias("alter"), F.col("v").alias("y")), "alter").where("x is not null and y is not null")
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    m = t.agg(F.sum(w).alias("s"), *[F.sum(w * e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
    s = F.nullif(F.col("s"), F.lit(0.0))
    cov = F.col("sxy") / s - F.col("sx") / s * F.col("sy") / s
    spread = (F.col("sxx") / s - F.pow(F.col("sx") / s, F.lit(2))) * (F.col("syy") / s - F.pow(F.col("sy") / s, F.lit(2)))
    return m.select((cov / F.nullif(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0))).alias("assortativity"))


def correlate(a: Network, b: Network) -> DataFrame:
    """Pearson correlation of two networks over all off-diagonal dyads, from the ties alone and the number of dyads."""
    t = a.arcs.select("ego", "alter", F.col("value").alias("x")).join(b.arcs.select("ego", "alter", F.col("value").alias("y")), ["ego", "alter"], "full").where("ego <> alter")
    x, y = _z("x"), _z("y")
    m = t.agg(*[F.sum(e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))]).crossJoin(a.nodes.agg((F.count("*") * (F.count("*") - 1)).cast("double").alias("s")))
    s = F.col("s")
    spread = (s * F.col("sxx") - F.col("sx") * F.col("sx")) * (s * F.col("syy") - F.col("sy") * F.col("sy"))
    return m.select(((s * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0))).alias("correlation"))


def turnover(before: Network, after: Network) -> DataFrame:
    """node, stable, formed, dissolved out-ties, jaccard and persistence."""
    a = before.arcs.where("value > 0 and ego <> alter").select("ego", "alter", F.lit(1).alias("x"))
    b = after.arcs.where("value > 0 and ego <> alter").select("ego", "alter", F.lit(1).alias("y"))
    t = a.join(b, ["ego", "alter"], "full")
    c = lambda e: F.sum(F.when(F.expr(e), 1).otherwise(0))
    per = t.groupBy(F.col("ego").alias("node")).agg(c("x = 1 and y = 1").alias("stable"), c("x is null").alias("formed"), c("y is null").alias("dissolved"))
    out = before.nodes.select("node").union(after.nodes.select("node")).distinct().join(per, "node", "left").fillna(0, ["stable", "formed", "dissolved"])
    s, f, d = F.col("stable"), F.col("formed"), F.col("dissolved")
    return out.select("node", "stable", "formed", "dissolved", F.when(s + f + d > 0, s / (s + f + d)).alias("jaccard"), F.when(s + d > 0, s / (s + d)).alias("persistence"))


def formation(before: Network, after: Network) -> DataFrame:
    """Shares of formed ties, and of all absent dyads, that had a reverse tie or a two-path before."""
    a = before.arcs.where("value > 0 and ego <> alter").select("ego", "alter")
    formed = after.arcs.where("value > 0 and ego <> alter").select("ego", "alter").join(a, ["ego", "alter"], "left_anti").withColumn("formed", F.lit(1))
    back = a.select(F.col("alter").alias("ego"), F.col("ego").alias("alter")).withColumn("back", F.lit(1))
    two = a.select("ego", F.col("alter").alias("m")).join(a.select(F.col("ego").alias("m"), "alter"), "m").where("ego <> alter").select("ego", "alter").distinct().withColumn("closed", F.lit(1))
    t = back.join(two, ["ego", "alter"], "full").join(a, ["ego", "alter"], "left_anti").join(formed, ["ego", "alter"], "full")
    x = t.agg(*[F.sum(F.coalesce(e, F.lit(0))).alias(k) for k, e in (("f", F.col("formed")), ("fb", F.col("formed") * F.col("back")), ("fc", F.col("formed") * F.col("closed")), ("b", F.col("back")), ("c", F.col("closed")))])
    x = x.crossJoin(before.nodes.agg((F.count("*") * (F.count("*") - 1)).alias("d"))).crossJoin(a.agg(F.count("*").alias("m")))
    absent = F.nullif(F.col("d") - F.col("m"), F.lit(0))
    return x.select((F.col("fb") / F.nullif(F.col("f"), F.lit(0))).alias("formed_reciprocal"), (F.col("fc") / F.nullif(F.col("f"), F.lit(0))).alias("formed_closing"), (F.col("b") / absent).alias("absent_reciprocal"), (F.col("c") / absent).alias("absent_closing"))


def modularity(net: Network, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Newman's Q of (node, community), values as weights; a two-mode network gets Barber's."""
    t = net.ties.where("ego <> alter").join(membership.withColumnsRenamed({"node": "ego", "community": "c"}), "ego").join(membership.withColumnsRenamed({"node": "alter", "community": "d"}), "alter")
    inside = t.where("c = d").groupBy("c").agg(F.sum("value").alias("w"))
    k1, k2 = t.groupBy("c").agg(F.sum("value").alias("k1")), t.groupBy(F.col("d").alias("c")).agg(F.sum("value").alias("k2"))
    x = k1.join(k2, "c", "full").join(inside, "c", "left").select(_z("w").alias("w"), _z("k1").alias("k1"), _z("k2").alias("k2"))
    m = F.nullif(F.col("m"), F.lit(0.0))
    if net.two_mode:
        y = x.agg(F.sum("w").alias("w"), F.sum("k1").alias("m"), F.sum(F.col("k1") * F.col("k2")).alias("kk"))
        return y.select(((F.col("w") - gamma * F.col("kk") / m) / m).alias("modularity"))
    y = x.agg(F.sum(2 * F.col("w")).alias("w"), F.sum(F.col("k1") + F.col("k2")).alias("m"), F.sum(F.pow(F.col("k1") + F.col("k2"), F.lit(2))).alias("kk"))
    return y.select(((F.col("w") - gamma * F.col("kk") / m) / m).alias("modularity"))


def _cum(c: Column) -> Column:
    return F.sum(c).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))


def adoption_curve(adopters: DataFrame, n: int) -> DataFrame:
    """(node, t) to t, new, adopters, proportion of ``n``, growth: one row per period that had adoptions (the window is over
    periods only)."""
    per = adopters.where("t is not null").groupBy("t").agg(F.count("*").alias("new"))
    c = per.select("t", "new", _cum(F.col("new")).alias("adopters"))
    return c.select("t", "new", "adopters", (F.col("adopters") / n).alias("proportion"), F.when(F.col("adopters") > F.col("new"), F.col("new") / (F.col("adopters") - F.col("new"))).alias("growth"))


def exposure(net: Network, adopters: DataFrame, times: DataFrame, lag: int = 1) -> DataFrame:
    """node, t, exposure: share of tie value that goes to alters who adopted by t - lag; 0 without ties."""
    total = net.arcs.groupBy("ego").agg(F.sum("value").alias("all"))
    tied = net.arcs.join(adopters.select(F.col("node").alias("alter"), F.col("t").alias("adopted")).where("adopted is not null"), "alter")
    steps = tied.groupBy("ego", "adopted").agg(F.sum("value").alias("w"))
    grid = net.nodes.select("node").crossJoin(F.broadcast(times.select("t")))
    hit = grid.join(steps, (F.col("node") == F.col("ego")) & (F.col("adopted") <= F.col("t") - lag), "left").groupBy("node", "t").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    return hit.join(total, F.col("node") == F.col("ego"), "left").select("node", "t", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0).alias("exposure"))


def thresholds(net: Network, adopters: DataFrame, lag: int = 1) -> DataFrame:
    """node, t, threshold: the exposure at the time of adoption."""
    times = adopters.where("t is not null").select("t").distinct()
    return exposure(net, adopters, times, lag).join(adopters.where("t is not null"), ["node", "t"]).select("node", "t", F.col("exposure").alias("threshold"))


def person_periods(net: Network, adopters: DataFrame, times: DataFrame, lag: int = 1) -> DataFrame:
    """node, t, exposure, adopts: a row per node and period until it adopts."""
    e = exposure(net, adopters, times, lag).join(adopters.select("node", F.col("t").alias("adopted")), "node", "left")
    return e.where("adopted is null or t <= adopted").select("node", "t", "exposure", F.coalesce((F.col("t") == F.col("adopted")).cast("int"), F.lit(0)).alias("adopts"))
