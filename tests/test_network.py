"""Hand-worked networks."""

import pytest
from pyspark.sql import functions as F

from tiegraph import network as N
from tiegraph.functions.algebra import evaluate
from tiegraph.operators import backbone as B
from tiegraph.operators import generators as G
from tiegraph.operators import iterate as I
from tiegraph.operators import kernels as K
from tiegraph.operators import measures as M
from tiegraph.operators import structure as S
from tiegraph.operators import transform as T


def net(spark, ties, n, directed=True):
    e = spark.createDataFrame([(a, b, float(v)) for a, b, v in ties], "ego long, alter long, value double")
    return N.Network(spark.range(1, n + 1).withColumnRenamed("id", "node"), e, directed=directed)


def table(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_last_row_wins_and_isolates_stay(spark):
    rows = spark.createDataFrame([("a", "b", 1.0, 1), ("a", "b", 5.0, 2), ("b", None, 1.0, 3), (" c", "a", 2.0, 4)], "ego string, alter string, value double, seq int")
    n = N.from_edges(rows, value="value", seq="seq", nodes=spark.createDataFrame([("z",)], "node string"))
    assert {r["node"] for r in n.nodes.collect()} == {"a", "b", "c", "z"}
    assert table(n.edges, "ego", "alter")["a", "b"]["value"] == 5.0
    assert n.directed


def test_symmetric_values_make_an_undirected_network(spark):
    rows = spark.createDataFrame([(1, 2, 3.0), (2, 1, 3.0), (2, 3, 1.0), (3, 2, 1.0)], "ego long, alter long, value double")
    n = N.from_edges(rows, value="value")
    assert not n.directed and n.edges.count() == 2 and n.arcs.count() == 4


def test_degree_and_summary(spark):
    n = net(spark, [(1, 2, 2), (1, 3, 1), (2, 3, 4)], 4)
    d = table(M.degree(n), "node")
    assert (d[1]["out"], d[3]["in"], d[4]["isolate"]) == (3.0, 5.0, 1)
    b = table(M.degree(n, binary=True), "node")
    assert (b[1]["out"], b[2]["total"]) == (2.0, 2.0)
    s = M.summary(n).head()
    assert (s["nodes"], s["ties"], s["min"], s["max"]) == (4, 3, 0.0, 4.0) and s["density"] == pytest.approx(3 / 12)


def test_symmetrize_rules(spark):
    n = net(spark, [(1, 2, 2), (2, 1, 4), (2, 3, 1)], 3)
    for how, want in (("max", {(1, 2): 4, (2, 3): 1}), ("min", {(1, 2): 2}), ("sum", {(1, 2): 6, (2, 3): 1}), ("mean", {(1, 2): 3, (2, 3): 0.5})):
        assert {(r["ego"], r["alter"]): r["value"] for r in T.symmetrize(n, how).edges.collect()} == want


def test_missing_is_not_zero(spark):
    e = spark.createDataFrame([(1, 2, None), (2, 3, 1.0)], "ego long, alter long, value double")
    n = N.Network(spark.range(1, 4).withColumnRenamed("id", "node"), e)
    assert n.ties.count() == 1
    assert {(r["ego"], r["alter"]): r["value"] for r in T.dyads(n).collect()}[1, 2] is None
    r = T.recode(n, [(None, None, 7.0)])
    assert table(r.edges, "ego", "alter")[1, 2]["value"] == 7.0


def test_clustering_triads_and_burt(spark):
    n = net(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1)], 4)
    c = table(S.clustering(n), "node")
    assert (c[2]["closed"], c[2]["pairs"]) == (1, 1) and c[1]["local"] is None
    t = {r["triad"]: r["count"] for r in S.triad_census(n).collect()}
    assert t["030T"] == 1 and sum(t.values()) == 4 and t["021C"] == 2
    b = table(S.burt(T.symmetrize(n)), "node")
    assert b[4]["constraint"] == pytest.approx(1.0) and b[4]["hierarchy"] == 1.0


def test_components_distances_and_paths(spark):
    n = net(spark, [(1, 2, 1), (2, 3, 1), (1, 4, 1), (4, 3, 1), (5, 6, 1)], 7).with_(valued=False)
    assert {r["node"]: r["component"] for r in I.components(n).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3}
    g = table(I.geodesics(n), "source", "node")
    assert g[1, 3]["distance"] == 2.0 and (3, 1) not in g
    assert sorted(tuple(r["path"]) for r in I.shortest_paths(n, 1, 3).collect()) == [(1, 2, 3), (1, 4, 3)]
    assert table(I.closeness(n), "node")[1]["closeness"] == pytest.approx(3 / 4)


def test_weighted_distances_use_inverse_values(spark):
    n = net(spark, [(1, 2, 4), (2, 3, 4), (1, 3, 1)], 3)
    assert table(I.geodesics(n), "source", "node")[1, 3]["distance"] == pytest.approx(0.5)


def test_kernels_on_a_small_graph(spark):
    n = net(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1), (4, 6, 1), (5, 6, 1)], 7, directed=False)
    b = table(K.betweenness(n), "node")
    assert b[3]["betweenness"] == 6.0 and b[7]["betweenness"] == 0.0
    assert {r["clique"] for r in K.cliques(n).collect()} == {"1,2,3", "4,5,6"}
    assert [(r["ego"], r["alter"]) for r in K.bridges(n).collect()] == [(3, 4)]
    for method in ("louvain", "leiden", "infomap"):
        c = {r["node"]: r["community"] for r in K.community(n, method).collect()}
        assert c[1] == c[2] == c[3] != c[4] == c[5] == c[6]
    assert K.max_flow(n, 1, 6).head()["flow"] == 1.0
    assert {r["block"] for r in K.k_components(n, 2).collect()} == {"1,2,3", "4,5,6"}
    assert table(I.kcore(n), "node")[4]["coreness"] == 2


def test_matching(spark):
    e = spark.createDataFrame([("a1", "b1", 1.0), ("a1", "b2", 5.0), ("a2", "b1", 3.0), ("a3", "b1", 1.0)], "ego string, alter string, value double")
    nodes = spark.createDataFrame([(x, 1 if x[0] == "a" else 2) for x in ("a1", "a2", "a3", "b1", "b2")], "node string, mode int")
    n = N.Network(nodes, e, directed=False, two_mode=True)
    assert K.matching(n).count() == 2
    assert {(r["ego"], r["alter"]) for r in K.matching(n, weighted=True).collect()} == {("a1", "b2"), ("a2", "b1")}


def test_expressions(spark):
    n = net(spark, [(1, 2, 2), (2, 1, 1), (2, 3, 3)], 3)
    e = evaluate("n * (n > t(n)) + 1", {"n": n})
    assert table(e.edges, "ego", "alter")[1, 2]["value"] == 3.0 and e.edges.count() == 6
    assert table(evaluate("n @ n", {"n": n}).edges, "ego", "alter")[1, 3]["value"] == 6.0


def test_generators_keep_their_invariants(spark):
    assert G.random_count(spark, 30, 50).edges.count() == 50
    d = M.degree(G.degree_sequence(spark, [3, 3, 2, 2, 2, 2])).collect()
    assert sorted(r["out"] for r in d) == [2.0, 2.0, 2.0, 2.0, 3.0, 3.0]
    assert G.ring(spark, 10, 2).edges.count() == 20
    assert G.lattice(spark, 3, 4).edges.count() == 17
    c = M.dyad_census(G.random_census(spark, 20, 15, 40)).head()
    assert (c["mutual"], c["asymmetric"]) == (15, 40)
    mean, sd = G.expected_ties(200, 0.05)
    assert abs(G.random_prob(spark, 200, 0.05).edges.count() - mean) < 6 * sd


def test_backbone_and_correction(spark):
    n = net(spark, [(1, 2, 9), (1, 3, 1), (1, 4, 1), (2, 3, 1)], 4, directed=False)
    p = table(B.disparity(n), "ego", "alter")
    assert p[1, 2]["p"] == pytest.approx(min((1 - 9 / 11) ** 2, (1 - 9 / 10) ** 1))
    a = table(B.adjust(B.disparity(n), "holm"), "ego", "alter")
    assert all(a[k]["adjusted"] >= a[k]["p"] for k in a)


def test_temporal_slices(spark):
    rows = spark.createDataFrame([(1, 2, 0, 5), (2, 3, 5, 9)], "a long, b long, s int, e int")
    n = N.intervals(rows, "a", "b", "s", "e")
    assert [(r["ego"], r["alter"]) for r in N.at_time(n, 5).edges.collect()] == [(2, 3)]


def test_joins_give_what_arrays_give(spark):
    """Fix points in both forms; the slower ones are registered queries (pagerank_joined, hitting_time_joined, eigenvector_distributed)."""
    n = net(spark, [(1, 2, 2), (2, 3, 1), (3, 1, 1), (3, 4, 5), (4, 5, 1), (5, 6, 1), (6, 4, 2), (7, 8, 1)], 9)
    u = T.symmetrize(n)
    forms = [
        (I.components, n), (I.kcore, n), (I.regular_classes, n), (lambda x, **k: I.closeness(x, **k), n),
        (K.bridges, u), (lambda x, **k: K.bridges(x, "distance", **k), u), (K.betweenness, u),
    ]
    for k, (f, x) in enumerate(forms):
        a, b = (sorted(map(tuple, f(x, **how).collect()), key=str) for how in ({}, {"local_rows": 0}))
        assert len(a) == len(b)
        for p, q in zip(a, b, strict=True):
            assert all(v == w or v is not None and w is not None and abs(v - w) < 1e-4 for v, w in zip(p, q, strict=True)), f"form {k}: {p} {q}"


@pytest.mark.parametrize("how", [{}, {"local_rows": 0}])
def test_eigenvector_is_down_to_rounding(spark, how):
    """A loop that stops at steps of tol is off by more than that, which a rounding to six places can show."""
    import numpy as np

    ties = [(a, b, 1) for a in range(1, 9) for b in range(a + 1, 9) if (a * b) % 3 or a == 1]
    a = np.zeros((8, 8))
    for x, y, _ in ties:
        a[x - 1, y - 1] = a[y - 1, x - 1] = 1
    want = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = table(I.eigenvector(net(spark, ties, 8), tol=1e-8, **how), "node")
    assert max(abs(got[k + 1]["evcent"] - want[k]) for k in range(8)) < 1e-13


def _partitions(items):
    if not items:
        yield []
        return
    for rest in _partitions(items[1:]):
        yield [[items[0]], *rest]
        for k, part in enumerate(rest):
            yield [*rest[:k], [items[0], *part], *rest[k + 1 :]]


def test_communities_of_three_components_are_the_best(spark):
    """Modularity over the whole network, against all partitions."""
    ties = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (5, 6, 3), (6, 7, 1), (8, 9, 2)]
    n = net(spark, ties, 9, directed=False)
    m = sum(v for *_, v in ties)
    k = {i: sum(v for a, b, v in ties if i in (a, b)) for i in range(1, 10)}

    def q(parts):
        at = {i: j for j, p in enumerate(parts) for i in p}
        return sum(v for a, b, v in ties if at[a] == at[b]) / m - sum(sum(k[i] for i in p) ** 2 for p in parts) / (2 * m) ** 2

    best = max(map(q, _partitions(list(range(1, 10)))))
    for method in ("louvain", "leiden"):
        assert M.modularity(n, K.community(n, method)).head()[0] == pytest.approx(best)
    found = {r["node"]: r["community"] for r in K.community(n, "infomap").collect()}
    assert found[1] == found[2] == found[3] and found[5] == found[6] == found[7] and found[8] == found[9] and len(set(found.values())) == 3


def test_plexes_of_unconnected_parts(spark):
    n = net(spark, [(1, 2, 1), (3, 4, 1)], 4, directed=False)
    assert {r["plex"] for r in K.k_plexes(n, 3, least=4).collect()} == {"1,2,3,4"}


def test_samples_and_fits(spark):
    from tiegraph.operators import inference as P

    t = spark.range(1, 101).select(F.col("id").alias("node"), F.when(F.col("id") <= 10, 5.0).otherwise(0.5).alias("w"))
    s = P.weighted_sample(t, "w", 19)
    assert s.count() in (18, 19, 20) and s.where("w > 1").count() == 10
    fits = spark.createDataFrame([("a", 100, -50.0, 3), ("b", 100, -49.0, 5)], "model string, n long, ll double, k int")
    assert [r["model"] for r in P.compare_fits(fits, "aic").collect()] == ["a", "b"]
    r = M.row_median(spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert (r[0]["median"], r[1]["median"]) == (2.0, None)


def test_catalog():
    c = N.Catalog()
    with pytest.raises(N.NetworkError):
        c.get()
    assert not N.Catalog.valid("1x") and N.Catalog.valid("ok_1")
    assert c.free_name("1 bad name") == "_1_bad_name"
    for name in ("a1", "a2", "b1"):
        c._nets[name] = None
    c.keep("a*")
    assert c.names() == ["a1", "a2"]
    c.drop("a1")
    assert c.names() == ["a2"]


def test_empty_network(spark):
    n = net(spark, [], 3)
    assert M.degree(n).where("total <> 0").count() == 0
    assert I.components(n).select("component").distinct().count() == 3
    assert {r["triad"]: r["count"] for r in S.triad_census(n).collect()}["003"] == 1
    assert S.triangles(n).count() == 0
    assert I.geodesics(n).where(F.lit(True)).count() == 0


def test_binomial_tail_keeps_its_digits_for_large_totals():
    """Differences of log-gammas of 17 million are off by 2e-8; the tail is compared with one normalised over all terms."""
    import math

    import numpy as np

    n, p = 17_684_000, 0.00336
    k = np.arange(int(n * p) - 8000, int(n * p) + 8000)
    log = np.concatenate([[0.0], np.cumsum(np.log((n - k[:-1]) / (k[:-1] + 1)) + math.log(p) - math.log1p(-p))])
    chance = np.exp(log - log.max())
    chance /= chance.sum()
    for least in range(int(n * p) - 1200, int(n * p) + 1200, 50):
        assert abs(B._binomial_tail(least, n, p) - chance[k >= least].sum()) < 1e-12


def test_searches_from_many_sources_equal_single_ones():
    import numpy as np

    from tiegraph.operators import local

    rng = np.random.default_rng(3)
    n = 700
    i, j = np.concatenate([rng.integers(0, n - 9, 1500), np.zeros(300, int)]), np.concatenate([rng.integers(0, n - 9, 1500), rng.integers(1, n - 9, 300)])
    pair = np.unique(i * n + j)
    i, j = pair // n, pair % n
    a = local.Arrays(None, np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))]), j, np.ones(len(j)), np.ones(n, bool))
    dist, back, sources = np.empty(n, np.int64), a.reversed(), rng.permutation(n)[:333]
    got = np.full((len(sources), n), -1)
    got[np.arange(len(sources)), sources] = 0
    for d, (nodes, bits) in enumerate(local.waves(a, back, sources), 1):
        at, of = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"))
        assert (got[of, nodes[at]] == -1).all()
        got[of, nodes[at]] = d
        assert (local.bit_counts(bits)[: len(sources)] == (got == d).sum(1)).all()
    for k, s in enumerate(sources):
        local.hops(a, s, dist)
        assert (got[k] == dist).all()


def test_all_geodesics_of_many_nodes_are_not_refused(spark):
    g = net(spark, [(1, 2, 1), (2, 3, 1)], 20_001)
    assert {tuple(r) for r in I.geodesics(g, alpha=0.0).collect()} == {(1, 2, 1.0), (1, 3, 2.0), (2, 3, 1.0)}
    assert {tuple(r) for r in I.reach(g).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_measures_of_every_source_write_no_pairs_up_to_source_rows(spark, monkeypatch):
    """12 million arcs of 90,000 nodes went to the joins, whose pairs fill the disk."""

    def joins(*_):
        raise AssertionError("joins")

    monkeypatch.setattr(K, "_betweenness_on_joins", joins)
    monkeypatch.setattr(I, "_rounds_of_joins", joins)
    for m in (K, I):
        monkeypatch.setattr(m, "pooled", lambda *x, f=m.pooled: (f(*x)[0], 12_100_000))
    g = net(spark, [(1, 2, 1), (2, 3, 1)], 4)
    assert table(K.betweenness(g), "node")[2]["betweenness"] == 1
    assert table(I.katz_decay(g, 0.5, cost=0.0), "node")[1]["katz"] == 0.75
    assert table(I.utility(g), "node")[1]["utility"] == 0.75 - 0.1
    assert table(I.closeness(g, legacy=True, alpha=0.0), "node")[1]["closeness"] == 1
    assert table(I.geodesic_summary(g, alpha=0.0), "node")[1]["eccentricity"] == 2


def two_mode(spark, ties):
    return N.from_two_mode(spark.createDataFrame(ties, "a long, b long"), "a", "b")


def test_two_mode_indices_make_no_pairs_of_the_larger_mode(spark, monkeypatch):
    """Both modes' pairs were made; 3 million ties have 800 million shared partners of one mode. Brute force on small ties."""
    import itertools
    import random

    rng = random.Random(5)
    ties = sorted({(rng.randrange(9), rng.randrange(6)) for _ in range(28)})
    rows = {m: {} for m in (0, 1)}
    for t in ties:
        for m in (0, 1):
            rows[m].setdefault(t[m], set()).add(t[1 - m])
    pairs = {m: [(len(x), len(y), len(x & y)) for x, y in itertools.combinations(rows[m].values(), 2)] for m in (0, 1)}
    c4 = sum(s * (s - 1) / 2 for _, _, s in pairs[0])
    nodf = {m: sum(100 * s / min(a, b) for a, b, s in pairs[m] if a != b) for m in (0, 1)}
    g = two_mode(spark, ties)
    monkeypatch.setattr(S, "wedges", lambda *_: pytest.fail("pairs"))
    got = S.nestedness(g).head()
    assert got["nodf_1"] == pytest.approx(nodf[0] / len(pairs[0])) and got["nodf_2"] == pytest.approx(nodf[1] / len(pairs[1]))
    assert got["nodf"] == pytest.approx(sum(nodf.values()) / (len(pairs[0]) + len(pairs[1])))
    assert got["c_score"] == pytest.approx(sum((a - s) * (b - s) for a, b, s in pairs[1]) / len(pairs[1]))
    assert S.robins_alexander(g).head()["c4"] == c4
    monkeypatch.undo()
    assert S.four_cycles(g, local_rows=0).head()["c4"] == c4


def test_fixed_row_tails_are_worked_out_once_for_each_pair_of_degrees(spark, monkeypatch):
    from math import comb

    ties = [(q, i) for i in range(60) for q in range(40) if (i * 7 + q * 3) % (4 + i % 2) == 0 or q == 0]
    rows = {i: {q for q, r in ties if r == i} for i in range(60)}
    calls = []
    monkeypatch.setattr(B, "_hyper_tails", lambda a, b, n, f=B._hyper_tails: calls.append((a, b)) or f(a, b, n))
    monkeypatch.setattr(B, "_projected", lambda net, mode, f=B._projected: f(net, mode).coalesce(1))
    made = []

    def local(df, apply, schema):
        made.append(schema)
        return df.sparkSession.createDataFrame(__import__("pandas").concat(apply(iter([df.toPandas()]))), schema)

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInPandas", local)
    got = B.fixed_row(two_mode(spark, ties), 2).collect()
    assert len(got) == 60 * 59 / 2 and len(calls) == len(set(calls)) <= 10
    for r in got:
        a, b = rows[int(r["ego"][1:])], rows[int(r["alter"][1:])]
        k, m, n = len(a), len(b), 40
        want = sum(comb(k, i) * comb(n - k, m - i) for i in range(len(a & b), min(k, m) + 1)) / comb(n, m)
        assert r["value"] == len(a & b) and r["p"] == pytest.approx(want, abs=1e-12)


def test_cliques_need_no_component(spark, monkeypatch):
    """A component of more than MAX_TIES ties was refused. Against brute force over all sets of nodes."""
    import itertools
    import random

    rng = random.Random(8)
    ties = {(a, b) for a, b in itertools.combinations(range(1, 12), 2) if rng.random() < 0.55}
    monkeypatch.setattr(K, "MAX_TIES", 5)
    near = {v: {b if a == v else a for a, b in ties if v in (a, b)} for v in range(1, 12)}
    whole = [set(c) for k in range(3, 12) for c in itertools.combinations(range(1, 12), k) if all(y in near[x] for x, y in itertools.combinations(c, 2))]
    want = {",".join(map(str, sorted(c))) for c in whole if not any(c < d for d in whole)}
    got = [tuple(r) for r in K.cliques(net(spark, [(a, b, 1) for a, b in ties], 11, directed=False)).collect()]
    assert len(want) > 5 and set(got) == {(c, int(v)) for c in want for v in c.split(",")} and len(got) == len(set(got))


def test_matchings_equal_brute_force():
    """Dense costs and a search from every node of the larger mode took 3 million ties past any time."""
    import random
    from functools import cache

    import numpy as np

    rng = random.Random(2)
    for trial in range(60):
        rows, columns = rng.randint(1, 6), rng.randint(1, 7)
        ties = {(i, j): float(rng.randint(1, 4)) for i in range(rows) for j in range(columns) if rng.random() < 0.45}
        start = np.concatenate([[0], np.cumsum([sum(1 for i, _ in ties if i == r) for r in range(rows)])])
        to, value = np.array([j for _, j in sorted(ties)], np.int64), np.array([ties[t] for t in sorted(ties)])

        @cache
        def best(i, used, weighted, ties=ties, rows=rows):
            if i == rows:
                return 0
            return max([best(i + 1, used, weighted), *(best(i + 1, used | 1 << j, weighted) + (v if weighted else 1) for (r, j), v in ties.items() if r == i and not used >> j & 1)])

        for weighted, mate in ((False, K._largest_matching(start, to, columns)), (True, K._heaviest_matching(start, to, value, columns))):
            pairs = [(i, int(j)) for i, j in enumerate(mate) if j >= 0]
            assert len({j for _, j in pairs}) == len(pairs) and all(p in ties for p in pairs)
            assert sum(ties[p] if weighted else 1 for p in pairs) == best(0, 0, weighted), trial


def test_communities_refuse_no_size(spark, monkeypatch):
    monkeypatch.setattr(K, "LOCAL_ROWS", 5)
    n = net(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)], 6, directed=False)
    for method in ("louvain", "leiden"):
        assert {r["node"]: r["community"] for r in K.community(n, method).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    g = two_mode(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4)])
    found = {r["node"]: r["community"] for r in K.two_mode_communities(g).collect()}
    assert len(set(found.values())) == 2 and found["a1"] == found["a2"] == found["b1"] == found["b2"] != found["a3"]


def test_swaps_and_spectra_refuse_no_size(spark, monkeypatch):
    from tiegraph.operators import local

    monkeypatch.setattr(local, "LOCAL_ROWS", 5)
    monkeypatch.setattr(K, "dyads", None, raising=False)
    ties = [(a, b) for a in range(1, 9) for b in range(1, 9) if a != b and (a * 3 + b) % 4 < 2]
    for directed in (True, False):
        mine = ties if directed else [t for t in ties if t[0] < t[1]]
        n = net(spark, [(*t, 1) for t in mine], 8, directed=directed)
        new = [(r["ego"], r["alter"]) for r in T.permute_ties(n, 3).edges.collect()]
        ends = lambda x, d=directed: (sorted(a for a, _ in x), sorted(b for _, b in x)) if d else sorted(v for t in x for v in t)
        assert ends(new) == ends(mine) and len(set(new)) == len(mine) and all(a != b for a, b in new) and set(new) != set(mine)
    monkeypatch.setattr(N.Network, "n_nodes", lambda self: 9_000)  # a matrix of more than 6,000 nodes was refused
    path = net(spark, [(1, 2, 1), (2, 3, 1)], 3, directed=False)
    got = sorted(r["eigenvalue"] for r in K.spectral(path).collect())
    assert got == pytest.approx([0, 1, 3], abs=1e-12)
