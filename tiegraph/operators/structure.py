"""Measures by joins of ties with ties: wedges, triangles, shared neighbours.

Triangles are found from wedges at the end with fewer ties (ties run from the node of lower degree to that of higher
degree, ids breaking equality), so a hub gives no wedges of its own: their number is O(m^1.5) whatever the skew. Whatever
needs closed two-paths only comes from triangles that carry the values of their ties. Pairs with a common neighbour
(similarity, projection) need all two-paths: there the neighbours of a hub are dealt out in squares of HUB rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError
from tiegraph.operators.local import SOURCE_ROWS, Arrays, arcs_in, per_source, pooled
from tiegraph.operators.measures import _per_node, _z
from tiegraph.operators.transform import DENSE_NODES, wedges
from tiegraph.plans.lineage import materialize


def _arrows(net: Network) -> DataFrame:
    """(x, y, s) for each tied pair x < y: s is 1 if x names y, 2 if y names x, 3 for both (undirected ties: 3)."""
    t = net.ties.where("ego <> alter").select("ego", "alter")
    if not net.directed:
        return t.select(F.least("ego", "alter").alias("x"), F.greatest("ego", "alter").alias("y"), F.lit(3).alias("s"))
    up = F.col("ego") < F.col("alter")
    return t.groupBy(F.least("ego", "alter").alias("x"), F.greatest("ego", "alter").alias("y")).agg((F.max(up.cast("int")) + 2 * F.max((~up).cast("int"))).alias("s"))


def closed_triples(pairs: DataFrame) -> DataFrame:
    """a < b < c and structs ab, ac, bc of what ``pairs`` (x < y and further columns) says of the triangle's ties."""
    says = [c for c in pairs.columns if c not in ("x", "y")]
    pairs = pairs.select("x", "y", F.struct(*says).alias("v"))
    ends = pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    both = pairs.join(ends.withColumnsRenamed({"node": "x", "d": "dx"}), "x").join(ends.withColumnsRenamed({"node": "y", "d": "dy"}), "y")
    low = F.col("dx") <= F.col("dy")  # x < y breaks equality
    up = both.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("w"), "v")
    wedge = up.select("u", F.col("w").alias("y"), F.col("v").alias("uy")).join(up.select("u", F.col("w").alias("z"), F.col("v").alias("uz")), "u").where("y < z")
    t = wedge.join(pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("v").alias("yz")), ["y", "z"])
    first, last = F.col("u") < F.col("y"), F.col("u") > F.col("z")
    pick = lambda p, q, r: F.when(first, F.col(p)).when(last, F.col(r)).otherwise(F.col(q))
    return t.select(pick("u", "y", "y").alias("a"), pick("y", "u", "z").alias("b"), pick("z", "z", "u").alias("c"), pick("uy", "uy", "yz").alias("ab"), pick("uz", "yz", "uy").alias("ac"), pick("yz", "uz", "uz").alias("bc"))


def _tie(x: str, y: str) -> tuple[str, bool]:
    """Name of the struct of a triangle's tie, and whether it runs from x to y as stored."""
    return "".join(sorted(x + y)), x < y


def _runs(x: str, y: str) -> Column:
    """Whether x names y, by the state s of their tie."""
    name, forward = _tie(x, y)
    return F.col(f"{name}.s").bitwiseAND(1 if forward else 2) != 0


def _transitive(net: Network) -> DataFrame:
    """(i, q, j): i names q, q names j and i names j; every such ordered triple once."""
    t = closed_triples(_arrows(net))
    rows = [F.when(_runs(i, q) & _runs(q, j) & _runs(i, j), F.struct(F.col(i).alias("i"), F.col(q).alias("q"), F.col(j).alias("j"))) for i, q, j in itertools.permutations("abc")]
    return t.select(F.explode(F.array(*rows)).alias("t")).where("t is not null").select("t.i", "t.q", "t.j")


def triangles(net: Network) -> DataFrame:
    """(a, b, c), a < b < c, each triple of nodes tied in any direction once."""
    return closed_triples(_arrows(net)).select("a", "b", "c")


def clustering(net: Network) -> DataFrame:
    """node, closed, pairs, local. Directed: pairs of an in-neighbour u and another out-neighbour v, closed by u to v;
    undirected: pairs of neighbours. local is null without pairs."""
    if net.directed:
        e = net.arcs.where("ego <> alter").select("ego", "alter")
        ends = e.select(F.col("alter").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("ego", F.lit(0), F.lit(1)))
        mutual = _arrows(net).where("s = 3").select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("m"))
        pairs = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).join(mutual, "node", "left").select("node", (F.col("i") * F.col("o") - F.coalesce("m", F.lit(0))).alias("pairs"))
        closed = _transitive(net).groupBy(F.col("q").alias("node")).agg(F.count("*").alias("closed"))
    else:
        t = triangles(net).select(F.explode(F.array("a", "b", "c")).alias("node"))
        closed = t.groupBy("node").agg(F.count("*").alias("closed"))
        d = net.links.groupBy(F.col("ego").alias("node")).agg(F.count("*").alias("d"))
        pairs = d.select("node", (F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("pairs"))
    both = pairs.where("pairs > 0").join(closed, "node", "left")
    out = _per_node(net, both).select("node", F.coalesce("closed", F.lit(0)).alias("closed"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
    return out.withColumn("local", F.when(F.col("pairs") > 0, F.col("closed") / F.col("pairs")))


def clustering_valued(net: Network, mean: str = "arithmetic") -> DataFrame:
    """node, local: pairs of neighbours weigh the arithmetic, geometric, maximum or minimum of their two tie values.

    Sums over all pairs of a node's ties follow from its values (and how often each occurs), those over closed pairs
    from triangles.
    """
    from pyspark.sql import Window

    net.need(directed=False)
    e = net.arcs.where("ego <> alter")
    x, y, k, c = F.col("x"), F.col("y"), F.col("k"), F.col("c")
    w = {"arithmetic": (x + y) / 2, "geometric": F.sqrt(x * y), "maximum": F.greatest(x, y), "minimum": F.least(x, y)}[mean]
    if mean in ("arithmetic", "geometric"):
        one = F.col("value") if mean == "arithmetic" else F.sqrt("value")
        s = e.groupBy(F.col("ego").alias("node")).agg(F.sum(one).alias("s"), F.sum("value").alias("v"), F.count("*").alias("k"))
        whole = s.select("node", ((k - 1) * F.col("s") / 2 if mean == "arithmetic" else (F.col("s") * F.col("s") - F.col("v")) / 2).alias("all"))
    else:  # a value wins over those below (above) it, and equal ones among themselves
        counts = e.groupBy(F.col("ego").alias("node"), F.col("value").alias("x")).agg(F.count("*").alias("c"))
        beaten = F.coalesce(F.sum("c").over(Window.partitionBy("node").orderBy("x" if mean == "maximum" else F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        whole = counts.select("node", (x * (c * beaten + c * (c - 1) / 2)).alias("part")).groupBy("node").agg(F.sum("part").alias("all"))
    value = e.groupBy(F.least("ego", "alter").alias("x"), F.greatest("ego", "alter").alias("y")).agg(F.max("value").alias("v"))
    ends = [F.struct(F.col(n).alias("node"), F.col(f"{_tie(n, u)[0]}.v").alias("x"), F.col(f"{_tie(n, v)[0]}.v").alias("y")) for n, u, v in ("abc", "bac", "cab")]
    closed = closed_triples(value).select(F.explode(F.array(*ends)).alias("t")).select("t.node", "t.x", "t.y").groupBy("node").agg(F.sum(w).alias("closed"))
    twice = net.links.groupBy(F.col("ego").alias("node")).agg(F.count("*").alias("d")).where("d > 1").select("node")
    return _per_node(net, whole.join(twice, "node", "left_semi").join(closed, "node", "left").select("node", (_z("closed") / F.nullif(F.col("all"), F.lit(0.0))).alias("local")))


def clustering_summary(net: Network) -> DataFrame:
    """global (closed over pairs) and average local clustering."""
    return clustering(net).agg((F.sum("closed") / F.nullif(F.sum("pairs"), F.lit(0))).alias("global"), F.avg("local").alias("average"))


def ego_density(net: Network) -> DataFrame:
    """node, alters, density among out-alters; null below two alters."""
    d = net.arcs.where("ego <> alter").groupBy(F.col("ego").alias("node")).agg(F.count("*").alias("alters"))
    if net.directed:
        t = _transitive(net).select(F.col("i").alias("node"))
    else:
        t = triangles(net).select(F.explode(F.array("a", "b", "c")).alias("node"))
    out = _per_node(net, d.join(t.groupBy("node").agg(F.count("*").alias("k")), "node", "left"), {"alters": 0, "k": 0})
    n = F.col("alters")
    return out.select("node", "alters", F.when(n > 1, F.col("k") / (n * (n - 1) / (1 if net.directed else 2))).alias("density"))


ROLES = ("coordinator", "gatekeeper", "representative", "consultant", "liaison")


def _role(a: Column, b: Column, c: Column) -> Column:
    return F.when((a == b) & (b == c), "coordinator").when(b == c, "gatekeeper").when(a == b, "representative").when(a == c, "consultant").otherwise("liaison")


def brokerage(net: Network, attribute: str) -> DataFrame:
    """node and its counts as coordinator, gatekeeper, representative, consultant, liaison: a to b to c without a to c.

    All two-paths through a node are counted from its numbers of in- and out-neighbours of each group; those that return
    to a, and the closed ones (from triangles), are taken off. Nodes without a group broker nothing and are not counted.
    """
    g = net.nodes.select("node", F.col(attribute).alias("g")).where("g is not null")
    e = net.arcs.where("ego <> alter").select("ego", "alter")
    ends = e.select(F.col("alter").alias("b"), F.col("ego").alias("x"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("ego", "alter", F.lit(0), F.lit(1)))
    per = ends.join(g.withColumnsRenamed({"node": "x", "g": "gx"}), "x").groupBy("b", "gx").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).join(g.withColumnsRenamed({"node": "b", "g": "gb"}), "b")
    own = F.col("gx") == F.col("gb")
    n = per.groupBy(F.col("b").alias("node")).agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum(F.when(own, F.col("i")).otherwise(0)).alias("ib"), F.sum(F.when(own, F.col("o")).otherwise(0)).alias("ob"), F.sum(F.when(own, 0).otherwise(F.col("i") * F.col("o"))).alias("same"))
    i, o, ib, ob = (F.col(c) for c in ("i", "o", "ib", "ob"))
    every = {"coordinator": ib * ob, "gatekeeper": (i - ib) * ob, "representative": ib * (o - ob), "consultant": F.col("same"), "liaison": (i - ib) * (o - ob) - F.col("same")}
    found = n.select("node", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), v.cast("long").alias("k")) for k, v in every.items()])).alias("r")).select("node", "r.role", "r.k")
    there = _arrows(net).where("s = 3")
    back = there.select(F.col("x").alias("i"), F.col("y").alias("q"), F.col("x").alias("j")).union(there.select("y", "x", "y"))
    off = back.unionByName(_transitive(net))
    for c in "iqj":
        off = off.join(g.withColumnsRenamed({"node": c, "g": f"g{c}"}), c)
    off = off.groupBy(F.col("q").alias("node"), _role(F.col("gi"), F.col("gq"), F.col("gj")).alias("role")).agg((-F.count("*")).alias("k"))
    out = found.unionByName(off).groupBy("node").agg(*[F.sum(F.when(F.col("role") == k, F.col("k")).otherwise(0)).alias(k) for k in ROLES])
    return _per_node(net, out, dict.fromkeys(ROLES, 0))


def shared_neighbors(net: Network) -> DataFrame:
    """ego, alter, shared: for each tie the number of nodes on a two-path along it; ties without one are left out."""
    t = _transitive(net).groupBy(F.col("i").alias("ego"), F.col("j").alias("alter")).agg(F.count("*").alias("shared"))
    return t


def simmelian(net: Network) -> DataFrame:
    """ego, alter, shared: mutual ties whose ends have a mutual tie to the same third node."""
    e = net.arcs.where("ego <> alter").select("ego", "alter")
    mutual = e.join(e.select(F.col("alter").alias("ego"), F.col("ego").alias("alter")), ["ego", "alter"], "left_semi") if net.directed else e
    sub = net.with_(edges=mutual.where("ego < alter").withColumn("value", F.lit(1.0)), directed=False)
    t = triangles(sub)
    pairs = F.explode(F.array(*[F.struct(F.col(x).alias("ego"), F.col(y).alias("alter")) for x, y in itertools.permutations("abc", 2)]))
    return t.select(pairs.alias("p")).groupBy("p.ego", "p.alter").agg(F.count("*").alias("shared"))


def balance(net: Network) -> DataFrame:
    """node, triangles, balanced: triangles of ties in either direction whose three values have a positive product."""
    value = net.arcs.where("ego <> alter").groupBy(F.least("ego", "alter").alias("x"), F.greatest("ego", "alter").alias("y")).agg(F.max("value").alias("v"))
    t = closed_triples(value)
    t = t.select(F.explode(F.array("a", "b", "c")).alias("node"), (F.signum("ab.v") * F.signum("ac.v") * F.signum("bc.v") > 0).cast("long").alias("ok"))
    return _per_node(net, t.groupBy("node").agg(F.count("*").alias("triangles"), F.sum("ok").alias("balanced")), {"triangles": 0, "balanced": 0})


TRIAD_NAMES = "003 012 021D 021U 021C 030T 030C 102 111D 111U 120D 120U 120C 201 210 300".split()


def _triad_name(uv: int, vw: int, uw: int) -> str:
    """Class of three nodes u, v, w; a dyad's state is 1 forward, 2 backward, 3 mutual, 0 empty."""
    arcs = {p for (x, y), s in zip((("u", "v"), ("v", "w"), ("u", "w")), (uv, vw, uw), strict=True) for p in ([(x, y)] if s & 1 else []) + ([(y, x)] if s & 2 else [])}
    mutual = sum(s == 3 for s in (uv, vw, uw))
    single = [(x, y) for x, y in arcs if (y, x) not in arcs]
    code = f"{mutual}{len(single)}{3 - mutual - len(single)}"
    out, into = [x for x, _ in single], [y for _, y in single]
    if code in ("021", "120"):
        return code + ("D" if len(set(out)) == 1 else "U" if len(set(into)) == 1 else "C")
    if code == "030":
        return code + ("C" if len(set(out)) == 3 else "T")
    if code == "111":
        return code + ("D" if (into[0], out[0]) not in arcs and any(into[0] in p for p in arcs if p != single[0]) else "U")
    return code


_BACK = {0: 0, 1: 2, 2: 1, 3: 3}
#: Labelled forms of each triad class.
TRIAD_FORMS = {"003": 1, "012": 6, "102": 3, "021D": 3, "021U": 3, "021C": 6, "111D": 6, "111U": 6, "030T": 6, "030C": 2, "201": 3, "120D": 3, "120U": 3, "120C": 6, "210": 6, "300": 1}


def triad_census(net: Network, expected: bool = False) -> DataFrame:
    """triad, count: all 16 classes; with ``expected`` also the mean count among networks of the same dyad census.

    Closed triples come from triangles. Open ones are the pairs of a node's ties of each kind, less the closed ones;
    triples with one tie and with none follow by subtraction. No table of two-paths is made.
    """
    pairs = materialize(_arrows(net), "dyads")
    three = F.create_map(*[F.lit(x) for a, b, c in itertools.product(range(1, 4), repeat=3) for x in (f"{a}{b}{c}", _triad_name(a, b, c))])
    t = closed_triples(pairs).groupBy(F.col("ab.s").alias("ab"), F.col("bc.s").alias("bc"), F.col("ac.s").alias("ac")).agg(F.count("*").alias("k"))
    t = materialize(t, "closed")  # at most 27 rows, used for each kind of triple
    found = t.select(three[F.concat("ab", "bc", "ac")].alias("triad"), "k")
    # ties of each kind at each node, as seen from it
    seen = pairs.select(F.col("x").alias("node"), "s").union(pairs.select("y", F.element_at(F.create_map(*[F.lit(v) for kv in _BACK.items() for v in kv]), F.col("s"))))
    kinds = seen.groupBy("node").agg(*[F.sum((F.col("s") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3)])
    n = {k: F.col(f"n{k}") for k in (1, 2, 3)}
    all_, closed = [], []
    for p, q in itertools.combinations_with_replacement((1, 2, 3), 2):
        name = F.lit(_triad_name(_BACK[p], q, 0)).alias("triad")
        all_.append(F.struct(name, (n[p] * (n[p] - 1) / 2 if p == q else n[p] * n[q]).cast("long").alias("k")))
    open_ = kinds.select(F.explode(F.array(*all_)).alias("w")).select("w.triad", "w.k")
    forms = F.create_map(*[F.lit(x) for p, q in itertools.product((1, 2, 3), repeat=2) for x in (f"{p}{q}", _triad_name(_BACK[p], q, 0))])
    back = F.create_map(*[F.lit(str(v)) for kv in _BACK.items() for v in kv])
    s = {k: F.col(k).cast("string") for k in ("ab", "ac", "bc")}
    for x, y in ((s["ab"], s["ac"]), (back[s["ab"]], s["bc"]), (back[s["ac"]], back[s["bc"]])):
        closed.append(F.struct(forms[F.concat(x, y)].alias("triad"), (-F.col("k")).alias("k")))
    found = found.unionByName(open_).unionByName(t.select(F.explode(F.array(*closed)).alias("w")).select("w.triad", "w.k"))
    # one tied dyad: the nodes tied to neither end, over all ties of a kind: n - d - d' + common neighbours
    nodes = net.nodes.agg(F.count("*").alias("n"))
    kind = lambda c: F.when(c == 3, "102").otherwise("012").alias("triad")
    ties = pairs.groupBy(kind(F.col("s"))).agg(F.count("*").alias("m")).crossJoin(F.broadcast(nodes)).select("triad", (F.col("m") * F.col("n")).alias("k"))
    d = F.col("n1") + F.col("n2") + F.col("n3")
    ends = kinds.agg(F.sum(d * n[3]).alias("102"), F.sum(d * (n[1] + n[2])).alias("012")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("triad"), (-F.coalesce(k, F.lit(0))).alias("k")) for k in ("102", "012")])).alias("w")).select("w.triad", "w.k")
    common = t.select(F.explode(F.array(*[F.struct(kind(F.col(c)), F.col("k").alias("k")) for c in ("ab", "ac", "bc")])).alias("w")).select("w.triad", "w.k")
    found = found.unionByName(ties).unionByName(ends).unionByName(common).groupBy("triad").agg(F.sum("k").cast("long").alias("count"))
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("s")).crossJoin(nodes).select(F.lit("003").alias("triad"), (F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6 - F.col("s")).cast("long").alias("count"))
    listed = net.spark.createDataFrame([(x,) for x in TRIAD_NAMES], "triad string")
    census = listed.join(found.unionByName(total), "triad", "left").fillna(0, ["count"])
    if not expected:
        return census
    many = pairs.agg(F.sum((F.col("s") == 3).cast("double")).alias("m"), F.sum((F.col("s") < 3).cast("double")).alias("a")).crossJoin(nodes).fillna(0.0, ["m", "a"])
    x = census.crossJoin(F.broadcast(many)).withColumn("d", F.col("n") * (F.col("n") - 1) / 2)
    digit = lambda k: F.substring("triad", k, 1).cast("int")
    falling = lambda v, j: F.when(j == 0, 1.0).when(j == 1, v).when(j == 2, v * (v - 1)).otherwise(v * (v - 1) * (v - 2))
    w = F.create_map(*[F.lit(v) for kv in TRIAD_FORMS.items() for v in kv])[F.col("triad")]
    mean = F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6 * w * falling(F.col("m"), digit(1)) * falling(F.col("a"), digit(2)) * falling(F.col("d") - F.col("m") - F.col("a"), digit(3))
    return x.select("triad", "count", (mean / F.pow(F.lit(2.0), digit(2)) / falling(F.col("d"), F.lit(3))).alias("expected"))


def _proportions(net: Network, direction: str, binary: bool) -> DataFrame:
    """(ego, alter, p, m): a tie's share of its ego's ties, and of its ego's largest, by the chosen directions."""
    e = net.arcs.where("ego <> alter").select("ego", "alter", F.lit(1.0).alias("value") if binary else F.col("value"))
    back = e.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), "value")
    a = {"both": e.unionByName(back), "out": e, "in": back}[direction].groupBy("ego", "alter").agg(F.sum("value").alias("z"))
    s = a.groupBy("ego").agg(F.sum("z").alias("all"), F.max("z").alias("top"))
    return a.join(s, "ego").select("ego", "alter", (F.col("z") / F.col("all")).alias("p"), (F.col("z") / F.col("top")).alias("m"))


def _indirect(pm: DataFrame) -> DataFrame:
    """(i, j, p, via, red) of each tie i to j: sums over third nodes q of p_iq p_qj and of p_iq m_jq, from triangles."""
    forward = F.col("ego") < F.col("alter")
    side = [F.max(F.when(c, F.col(k))).alias(n + k) for n, c in (("f", forward), ("b", ~forward)) for k in ("p", "m")]
    pairs = pm.groupBy(F.least("ego", "alter").alias("x"), F.greatest("ego", "alter").alias("y")).agg(*side)

    def of(x: str, y: str, k: str) -> Column:
        name, ahead = _tie(x, y)
        return F.coalesce(F.col(f"{name}.{'f' if ahead else 'b'}{k}"), F.lit(0.0))

    rows = [F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (of(i, q, "p") * of(q, j, "p")).alias("via"), (of(i, q, "p") * of(j, q, "m")).alias("red")) for i, q, j in itertools.permutations("abc")]
    sums = closed_triples(pairs).select(F.explode(F.array(*rows)).alias("t")).groupBy("t.i", "t.j").agg(F.sum("t.via").alias("via"), F.sum("t.red").alias("red"))
    return pm.select(F.col("ego").alias("i"), F.col("alter").alias("j"), "p").join(sums, ["i", "j"], "left").fillna(0.0, ["via", "red"])


def burt(net: Network, direction: str = "both", binary: bool = False) -> DataFrame:
    """node, degree, effective_size, efficiency, constraint, hierarchy of Burt's structural holes."""
    t = _indirect(_proportions(net, direction, binary))
    c = F.pow(F.col("p") + F.col("via"), F.lit(2))
    per = t.groupBy(F.col("i").alias("node")).agg(F.sum(1 - F.col("red")).alias("effective_size"), F.sum(c).alias("constraint"), F.sum(c * F.log(c)).alias("_clogc"), F.count("*").alias("degree"))
    n, big = F.col("degree"), F.col("constraint")
    h = F.when(n == 1, 1.0).when((n > 1) & (big > 0), (F.col("_clogc") / (big / n) - n * F.log(big / n)) / (n * F.log(n)))
    return _per_node(net, per.select("node", "degree", "effective_size", (F.col("effective_size") / n).alias("efficiency"), "constraint", h.alias("hierarchy")), {"degree": 0})


def dyadic_constraint(net: Network) -> DataFrame:
    """ego, alter, constraint and the alter's redundancy, from both directions of the ties."""
    t = _indirect(_proportions(net, "both", False))
    return t.select(F.col("i").alias("ego"), F.col("j").alias("alter"), F.pow(F.col("p") + F.col("via"), F.lit(2)).alias("constraint"), F.col("red").alias("redundancy"))


def similarity_index(net: Network, index: str = "jaccard") -> DataFrame:
    """i < j with a common neighbour: common, jaccard, dice, cosine or adamic (sum of 1/ln degree) of undirected neighbours."""
    links = net.links
    d = links.groupBy(F.col("ego").alias("node")).agg(F.count("*").alias("d"))
    pairs = wedges(links.select(F.col("alter").alias("i"), F.col("ego").alias("k")), links.select(F.col("alter").alias("j"), F.col("ego").alias("k")), "k", "i", "j").where("i < j")
    pairs = pairs.join(d.withColumnsRenamed({"node": "k", "d": "dk"}), "k")
    s = pairs.groupBy("i", "j").agg(F.count("*").alias("c"), F.sum(1 / F.log("dk")).alias("aa"))
    s = s.join(d.withColumnsRenamed({"node": "i", "d": "di"}), "i").join(d.withColumnsRenamed({"node": "j", "d": "dj"}), "j")
    c, x, y = F.col("c"), F.col("di"), F.col("dj")
    value = {"common": c.cast("double"), "jaccard": c / (x + y - c), "dice": 2 * c / (x + y), "cosine": c / F.sqrt(x * y), "adamic": F.col("aa")}[index]
    return s.select("i", "j", value.alias("value"))


def profile_similarity(net: Network, index: str = "matches", two_mode_side: int = 1, direction: str = "out", force: bool = False) -> DataFrame:
    """Similarity (pearson, matches, jaccard, hamming, crossproduct) or dissimilarity (euclidean, manhattan, nonmatches,
    djaccard, dhamming) of the profiles of all pairs i < j: out-ties, in-ties or ``both`` one after the other. One-mode
    profiles leave out the pair's own two cells. More than DENSE_NODES nodes are refused unless forced."""
    if net.n_nodes() > DENSE_NODES and not force:
        raise NetworkError("too many pairs of nodes; force=True overrides")
    kind = dict(net.nodes.dtypes)["node"]
    if net.two_mode:
        own, other = ("ego", "alter") if two_mode_side == 1 else ("alter", "ego")
        t = net.ties.select(F.col(own).alias("i"), F.struct(F.lit(0).alias("d"), F.col(other).alias("q")).alias("q"), "value")
        nodes = net.nodes.where(F.col("mode") == two_mode_side).select("node")
        width = net.nodes.where(F.col("mode") != two_mode_side).agg(F.count("*").cast("double").alias("c"))
    else:
        arcs = net.arcs.where("ego <> alter")
        out = arcs.select(F.col("ego").alias("i"), F.struct(F.lit(0).alias("d"), F.col("alter").alias("q")).alias("q"), "value")
        into = arcs.select(F.col("alter").alias("i"), F.struct(F.lit(1).alias("d"), F.col("ego").alias("q")).alias("q"), "value")
        t = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
        nodes = net.nodes.select("node")
        width = net.nodes.agg(((F.count("*") - 2) * (2 if direction == "both" else 1)).cast("double").alias("c"))
    x, y = F.col("value"), F.col("w")
    k = t.groupBy("i").agg(F.count("*").alias("k"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    co = wedges(t, t.withColumnsRenamed({"i": "j", "value": "w"}), "q", "i", "j").where("i < j").groupBy("i", "j").agg(F.count("*").alias("co"), F.sum(x * y).alias("xy"), F.sum(F.abs(x - y) - F.abs(x) - F.abs(y)).alias("man"))
    pairs = nodes.select(F.col("node").alias("i")).crossJoin(nodes.select(F.col("node").alias("j"))).where("i < j").join(co, ["i", "j"], "left")
    a = t.groupBy("i").agg(F.sum(F.abs(x)).alias("abs")).join(k, "i")
    for side in "ij":
        pairs = pairs.join(a.select(F.col("i").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("k", "s", "ss", "abs")]), side, "left")
    cells: dict[str, list[Column]] = {"i": [], "j": []}
    if not net.two_mode:  # the cells (i,j) and (j,i) are not compared
        for way in {"out": (0,), "in": (1,), "both": (0, 1)}[direction]:
            for p, q in (("i", "j"), ("j", "i")):
                own = t.where(F.col("q.d") == way).select(F.col("i").alias(p), F.col("q.q").cast(kind).alias(q), F.col("value").alias(f"v{p}{way}"))
                pairs = pairs.join(own, [p, q], "left")
                cells[p].append(F.coalesce(f"v{p}{way}", F.lit(0.0)))
    less = lambda s, f: sum((f(v) for v in cells[s]), F.lit(0.0))
    pairs = pairs.crossJoin(F.broadcast(width))
    n, c = F.nullif(F.col("c"), F.lit(0.0)), F.coalesce("co", F.lit(0))
    ki, kj = (F.coalesce(f"k_{s}", F.lit(0)) - less(s, lambda v: F.when(v != 0, 1.0).otherwise(0.0)) for s in "ij")
    si, sj = (_z(f"s_{s}") - less(s, lambda v: v) for s in "ij")
    qi, qj = (_z(f"ss_{s}") - less(s, lambda v: v * v) for s in "ij")
    ai, aj = (_z(f"abs_{s}") - less(s, F.abs) for s in "ij")
    xy = _z("xy")
    agree, union = n - ki - kj + 2 * c, ki + kj - c
    values: dict[str, Column] = {
        "pearson": (n * xy - si * sj) / F.nullif(F.sqrt(F.greatest((n * qi - si * si) * (n * qj - sj * sj), F.lit(0.0))), F.lit(0.0)), "matches": agree / n, "jaccard": F.when(union > 0, c / union), "hamming": agree, "crossproduct": xy,
        "euclidean": F.sqrt(F.greatest(qi + qj - 2 * xy, F.lit(0.0))), "manhattan": ai + aj + _z("man"), "nonmatches": 1 - agree / n, "dhamming": n - agree, "djaccard": F.when(union > 0, 1 - c / union),
    }
    if index not in values:
        raise NetworkError(f"unknown index {index}")
    return pairs.select("i", "j", values[index].cast("double").alias("value"))


def _mode_degrees(net: Network, mode: int) -> DataFrame:
    """(i, k): a mode's nodes and their degrees."""
    own = "ego" if mode == 1 else "alter"
    k = net.ties.groupBy(F.col(own).alias("i")).agg(F.count("*").alias("k"))
    return net.nodes.where(F.col("mode") == mode).select(F.col("node").alias("i")).join(k, "i", "left").fillna(0, ["k"])


def four_cycles(net: Network, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """One row, c4: four-cycles of a two-mode network, from the shared partners of the pairs of one mode. Both modes give the
    same number; the one whose pairs share fewer partners in all is taken."""
    shared = lambda c: net.ties.groupBy(c).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("w"))
    own, other = ("alter", "ego") if shared("ego").head()[0] <= shared("alter").head()[0] else ("ego", "alter")
    arcs = net.ties.select(F.col(own).alias("ego"), F.col(other).alias("alter"), "value")
    rows, size = pooled(net, arcs, net.nodes.where(F.col("mode") == (1 if own == "ego" else 2)))

    def kernel(a: Arrays, mine: np.ndarray) -> Iterator[list]:
        back, total = a.reversed(), 0
        for i in mine:
            partners = a.to[a.start[i] : a.start[i + 1]]
            j = back.arcs_of(partners)[1]
            s = np.bincount(j[j > i])
            total += int((s * (s - 1) // 2).sum())
        yield [np.array([float(total)])]

    if size <= local_rows:
        return per_source(net, rows, kernel, "c4 double").agg(F.sum("c4").alias("c4"))
    t = arcs_in(rows).select(F.col("ego").alias("i"), F.col("alter").alias("q"))
    s = wedges(t, t.withColumnRenamed("i", "j"), "q", "i", "j").where("i < j").groupBy("i", "j").agg(F.count("*").alias("s"))
    return s.agg(F.coalesce(F.sum(F.col("s") * (F.col("s") - 1) / 2), F.lit(0.0)).alias("c4"))


def robins_alexander(net: Network, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """Two-mode clustering 4 C4 / L3 with the numbers of four-cycles and three-paths."""
    net.need(two_mode=True)
    k1, k2 = _mode_degrees(net, 1), _mode_degrees(net, 2)
    l3 = net.ties.join(k1.withColumnsRenamed({"i": "ego", "k": "k1"}), "ego").join(k2.withColumnsRenamed({"i": "alter", "k": "k2"}), "alter").agg(F.sum((F.col("k1") - 1) * (F.col("k2") - 1)).alias("l3"))
    return four_cycles(net, local_rows).crossJoin(l3).select("c4", "l3", F.when(F.col("l3") > 0, 4 * F.col("c4") / F.col("l3")).alias("clustering"))


def nestedness(net: Network, local_rows: int = SOURCE_ROWS) -> DataFrame:
    """NODF (pooled, and of each mode) and the C-score of mode 2, without a table of pairs. A shared partner adds 1 / the
    smaller degree for each pair of different degrees among its own, so counts of its partners by degree do for NODF."""
    net.need(two_mode=True)
    parts, degrees = [], {m: _mode_degrees(net, m) for m in (1, 2)}
    for mode in (1, 2):
        own, other = ("ego", "alter") if mode == 1 else ("alter", "ego")
        by = net.ties.join(degrees[mode].withColumnRenamed("i", own), own).groupBy(F.col(other).alias("q"), "k").agg(F.count("*").alias("c"))
        more = F.sum("c").over(Window.partitionBy("q").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1))
        part = by.select("c", "k", F.coalesce(more, F.lit(0)).alias("more")).agg(F.coalesce(F.sum(100 * F.col("c") * F.col("more") / F.col("k")), F.lit(0.0)).alias(f"t{mode}"))
        parts.append(part.crossJoin(degrees[mode].agg((F.count("*") * (F.count("*") - 1) / 2).alias(f"p{mode}"))))
    # sum over pairs of (ki - s)(kj - s) = sum ki kj - s (ki + kj) + s^2; sum s^2 = 2 c4 + sum s
    at = net.ties.join(degrees[2].withColumnRenamed("i", "alter"), "alter").groupBy("ego").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    c = at.agg(F.coalesce(F.sum((F.col("n") - 1) * (F.col("n") / 2 - F.col("k"))), F.lit(0.0)).alias("a")).crossJoin(four_cycles(net, local_rows))
    c = c.select((F.col("a") + 2 * F.col("c4")).alias("a")).crossJoin(degrees[2].agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("b")))
    x = parts[0].crossJoin(parts[1]).crossJoin(c)
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    t1, t2, p1, p2 = (F.col(k) for k in ("t1", "t2", "p1", "p2"))
    return x.select(over(t1 + t2, p1 + p2).alias("nodf"), over(t1, p1).alias("nodf_1"), over(t2, p2).alias("nodf_2"), over(F.col("a") + F.col("b"), p2).alias("c_score"))


def motifs4(net: Network) -> DataFrame:
    """motif, count of the connected induced subgraphs of four nodes, from degrees, triangles and shared neighbours:
    path, star, cycle, paw, diamond, clique; and ``other``."""
    links = materialize(net.links, "links")
    d = links.groupBy("ego").agg(F.count("*").alias("d"))
    tri = materialize(triangles(net), "triangles")
    on_edge = tri.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ac", "bc")])).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("t"))
    edge = links.where("ego < alter").select(F.col("ego").alias("a"), F.col("alter").alias("b")).join(on_edge, ["a", "b"], "left").fillna(0, ["t"])
    edge = edge.join(d.select(F.col("ego").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("ego").alias("b"), F.col("d").alias("db")), "b")
    per = tri.select(F.explode(F.array("a", "b", "c")).alias("ego")).groupBy("ego").agg(F.count("*").alias("t"))
    co = wedges(links.select(F.col("ego").alias("k"), F.col("alter").alias("i")), links.select(F.col("ego").alias("k"), F.col("alter").alias("j")), "k", "i", "j").where("i < j").groupBy("i", "j").agg(F.count("*").alias("s"))
    # cliques of four: triangles whose three nodes have a common neighbour above the largest
    k4 = tri
    for x in "abc":
        near = links.select(F.col("ego").alias(x), F.col("alter").alias("z")).where(f"{x} < z")
        k4 = k4.join(near, x) if x == "a" else k4.join(near, [x, "z"], "left_semi")
    k4 = k4.where("z > c").agg(F.count("*").alias("k4"))
    t, da, db = F.col("t"), F.col("da"), F.col("db")
    sums = edge.agg(F.coalesce(F.sum((da - 1) * (db - 1) - t), F.lit(0)).alias("p4"), F.coalesce(F.sum(t * (t - 1) / 2), F.lit(0.0)).alias("dia"))
    sums = sums.crossJoin(d.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) * (F.col("d") - 2) / 6), F.lit(0.0)).alias("st"))).crossJoin(per.join(d, "ego").agg(F.coalesce(F.sum(F.col("t") * (F.col("d") - 2)), F.lit(0)).alias("paw")))
    sums = sums.crossJoin(co.agg((F.coalesce(F.sum(F.col("s") * (F.col("s") - 1) / 2), F.lit(0.0)) / 2).alias("c4"))).crossJoin(k4).crossJoin(net.nodes.agg(F.count("*").cast("double").alias("n")))
    x = sums.select("n", F.col("k4").alias("clique"), (F.col("dia") - 6 * F.col("k4")).alias("diamond"), "c4", "paw", "st", "p4")
    x = x.withColumn("cycle", F.col("c4") - F.col("diamond") - 3 * F.col("clique")).withColumn("paw", F.col("paw") - 4 * F.col("diamond") - 12 * F.col("clique"))
    x = x.withColumn("star", F.col("st") - F.col("paw") - 2 * F.col("diamond") - 4 * F.col("clique"))
    x = x.withColumn("path", F.col("p4") - 4 * F.col("cycle") - 2 * F.col("paw") - 6 * F.col("diamond") - 12 * F.col("clique"))
    kinds = ["path", "star", "cycle", "paw", "diamond", "clique"]
    n = F.col("n")
    other = n * (n - 1) * (n - 2) * (n - 3) / 24 - sum((F.col(k) for k in kinds[1:]), F.col("path"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("motif"), F.round(F.col(k)).cast("long").alias("count")) for k in kinds], F.struct(F.lit("other").alias("motif"), F.round(other).cast("long").alias("count"))))
    return x.select(rows.alias("r")).select("r.motif", "r.count")
