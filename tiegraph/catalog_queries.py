"""Registered queries of the network operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegraph import network as N
from tiegraph.operators import iterate as I
from tiegraph.functions.algebra import evaluate, shortcut
from tiegraph.operators import backbone as B
from tiegraph.operators import generators as G
from tiegraph.operators import inference as P
from tiegraph.operators import kernels as K
from tiegraph.operators import measures as M
from tiegraph.operators import structure as S
from tiegraph.operators import transform as T
from tiegraph.plans.lineage import fresh_path
from tiegraph.sources import formats as X
from tiegraph.streaming import windows as W
from tiegraph.plans.networks import BOTH, FOLLOW, HOMES, PAIRS, PARTNERS, RANKS, ROADS, TRADE, TWO_MODE, VISITS, follow, homes, orders_two_mode, pairs, partners, ranks, roads, trade, visits

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, net: Callable, operator: Callable, sql: str | None = None) -> None:
    """Register ``operator`` on a network; doubles are rounded to 6 places in query and SQL alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(net(spark, sf_dir))
        out = out.edges.select("ego", "alter", "value") if isinstance(out, N.Network) else out
        return out.select(*[F.round(F.col(c), 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])

    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


FOLLOW1 = FOLLOW.format(least=1)
_V = 'round("value", 6) "value"'

# construction and transforms
_add("from_edges_last_wins", lambda s, d: N.from_edges(s.read.parquet(f"{d}/events.parquet").where("user_id is not null").select("user_id", F.pmod("event_id", F.lit(97)).alias("item"), "value", "event_id"), "user_id", "item", "value", seq="event_id", directed=True), lambda n: n,
     'SELECT user_id ego, event_id % 97 alter, round(arg_max("value", event_id), 6) "value" FROM events WHERE user_id <> event_id % 97 GROUP BY 1, 2 HAVING arg_max("value", event_id) IS NOT NULL')
_add("two_mode_edges", orders_two_mode, lambda n: n, f"WITH {TWO_MODE} SELECT ego, alter, {_V} FROM e")
for _how, _x in (("max", "greatest(f, b)"), ("min", "least(f, b)"), ("sum", "f + b"), ("mean", "(f + b) / 2")):
    _add(f"symmetrize_{_how}", follow, lambda n, how=_how: T.symmetrize(n, how),
         f'WITH {FOLLOW1}, p AS (SELECT least(ego, alter) ego, greatest(ego, alter) alter, coalesce(max(CASE WHEN ego < alter THEN "value" END), 0) f, coalesce(max(CASE WHEN ego > alter THEN "value" END), 0) b FROM e GROUP BY 1, 2) SELECT ego, alter, round({_x}, 6) "value" FROM p WHERE {_x} <> 0')
_add("transpose", follow, T.transpose, f"WITH {FOLLOW1} SELECT alter ego, ego alter, {_V} FROM e")
_add("dichotomize", follow, lambda n: T.dichotomize(n, 2), f'WITH {FOLLOW1} SELECT ego, alter, 1.0::DOUBLE "value" FROM e WHERE "value" >= 2')
_add("recode", follow, lambda n: T.recode(n, [(2, 2, 5), (3, 99, 0)]), f'WITH {FOLLOW1}, r AS (SELECT ego, alter, CASE WHEN "value" = 2 THEN 5 WHEN "value" BETWEEN 3 AND 99 THEN 0 ELSE "value" END::DOUBLE "value" FROM e) SELECT ego, alter, {_V} FROM r WHERE "value" <> 0')
_add("recode_zero", trade, lambda n: T.recode(n, [(0, 0, 1), (1, 1e9, 0)]), f'WITH {TRADE} SELECT x.node ego, y.node alter, 1.0::DOUBLE "value" FROM n x, n y WHERE x.node <> y.node AND NOT EXISTS (SELECT 1 FROM e WHERE ego = x.node AND alter = y.node)')
_add("replace_values", follow, lambda n: T.replace_values(n, "value * 10 + ego", "ego < alter"), f'WITH {FOLLOW1} SELECT ego, alter, round(CASE WHEN ego < alter THEN "value" * 10 + ego ELSE "value" END, 6)::DOUBLE "value" FROM e')
_add("keep_nodes", follow, lambda n: T.keep_nodes(n, "events > 60"), f"WITH {FOLLOW1} SELECT ego, alter, {_V} FROM e WHERE ego IN (SELECT node FROM n WHERE events > 60) AND alter IN (SELECT node FROM n WHERE events > 60)")
_add("drop_nodes", follow, lambda n: T.drop_nodes(n, "events > 60"), f"WITH {FOLLOW1} SELECT ego, alter, {_V} FROM e WHERE ego IN (SELECT node FROM n WHERE events <= 60) AND alter IN (SELECT node FROM n WHERE events <= 60)")
_add("neighbors_out", follow, lambda n: T.neighbors(n, 8, "outgoing"), f"WITH {FOLLOW1} SELECT DISTINCT alter node FROM e WHERE ego = 8")
_add("neighbors_either", follow, lambda n: T.neighbors(n, 8), f"WITH {FOLLOW1} SELECT alter node FROM e WHERE ego = 8 UNION SELECT ego FROM e WHERE alter = 8")
_add("ego_network", visits, lambda n: T.ego_network(n, 8), f"WITH {VISITS}, k AS (SELECT alter node FROM e WHERE ego = 8 UNION SELECT ego FROM e WHERE alter = 8 UNION SELECT 8) SELECT ego, alter, {_V} FROM e WHERE ego IN (SELECT node FROM k) AND alter IN (SELECT node FROM k)")
_add("collapse_sum", trade, lambda n: T.collapse(n, "region", "sum"), f'WITH {TRADE} SELECT x.region ego, y.region alter, round(sum("value"), 6) "value" FROM e JOIN n x ON ego = x.node JOIN n y ON alter = y.node GROUP BY 1, 2')
_add("collapse_max", trade, lambda n: T.collapse(n, "region"), f'WITH {TRADE} SELECT x.region ego, y.region alter, round(max("value"), 6) "value" FROM e JOIN n x ON ego = x.node JOIN n y ON alter = y.node GROUP BY 1, 2')
_add("stack", trade, lambda n: T.stack([n, T.transpose(n)]), f"WITH {TRADE} SELECT '1:' || ego ego, '1:' || alter alter, {_V} FROM e UNION ALL SELECT '2:' || alter, '2:' || ego, round(\"value\", 6) FROM e")
for _mode, _x in (("same", "CASE WHEN x.region = y.region THEN 1 ELSE 0 END"), ("dist", "x.region - y.region"), ("distinv", "y.region - x.region"), ("absdist", "abs(x.region - y.region)"), ("absdistinv", "(SELECT max(abs(p.region - q.region)) FROM n p, n q WHERE p.node <> q.node) - abs(x.region - y.region)"), ("sender", "x.region"), ("receiver", "y.region")):
    _add(f"expand_{_mode}", trade, lambda n, m=_mode: T.expand(n, "region", m), f'WITH {TRADE} SELECT x.node ego, y.node alter, ({_x})::DOUBLE "value" FROM n x, n y WHERE x.node <> y.node')
_add("dyads_full", trade, lambda n: T.dyads(n), f'WITH {TRADE} SELECT x.node ego, y.node alter, coalesce("value", 0)::DOUBLE "value" FROM n x JOIN n y ON x.node <> y.node LEFT JOIN e ON ego = x.node AND alter = y.node')
_add("edge_table", trade, lambda n: T.edge_table(n, ["region"]), f'WITH {TRADE} SELECT ego, alter, "value" trade, x.region ego_region, y.region alter_region FROM e JOIN n x ON ego = x.node JOIN n y ON alter = y.node')
for _d, _x in (("out", "SELECT ego, alter, 1.0 w FROM e"), ("in", "SELECT alter ego, ego alter, 1.0 w FROM e"), ("symmetric", "SELECT ego, alter, 1.0 w FROM e UNION SELECT alter, ego, 1.0 FROM e"), ("mutual", "SELECT ego, alter, 1.0 w FROM e WHERE EXISTS (SELECT 1 FROM e r WHERE r.ego = e.alter AND r.alter = e.ego)")):
    _add(f"spatial_weights_{_d}", trade, lambda n, d=_d: T.spatial_weights(n, d), f"WITH {TRADE}, w AS ({_x}) SELECT ego, alter, round((w / sum(w) OVER (PARTITION BY ego))::DOUBLE, 6) weight FROM w")
for _op, _x in (("+", "x + y"), ("-", "x - y"), ("*", "x * y"), (">", "CASE WHEN x > y THEN 1 ELSE 0 END"), ("!=", "CASE WHEN x <> y THEN 1 ELSE 0 END"), ("&", "CASE WHEN x <> 0 AND y <> 0 THEN 1 ELSE 0 END"), ("|", "CASE WHEN x <> 0 OR y <> 0 THEN 1 ELSE 0 END")):
    _nm = {"+": "add", "-": "subtract", "*": "multiply", ">": "greater", "!=": "differ", "&": "and", "|": "or"}[_op]
    _add(f"algebra_{_nm}", trade, lambda n, o=_op: T.combine(n, T.transpose(n), o), f'WITH {TRADE}, p AS (SELECT coalesce(a.ego, b.alter) ego, coalesce(a.alter, b.ego) alter, coalesce(a."value", 0) x, coalesce(b."value", 0) y FROM e a FULL JOIN e b ON a.ego = b.alter AND a.alter = b.ego) SELECT ego, alter, round(({_x})::DOUBLE, 6) "value" FROM p WHERE ({_x}) <> 0')
_add("algebra_matrix_product", trade, lambda n: T.combine(n, n, "**"), f'WITH {TRADE} SELECT a.ego, b.alter, round(sum(a."value" * b."value"), 6) "value" FROM e a JOIN e b ON a.alter = b.ego GROUP BY 1, 2')
_JP = "p AS (SELECT x.alter i, y.alter j, {a} FROM e x JOIN e y ON x.ego = y.ego AND x.alter < y.alter{j} GROUP BY 1, 2)"
_DEG = "d AS (SELECT alter node, count(*) k FROM e GROUP BY 1), q AS (SELECT ego, count(*) dq FROM e GROUP BY 1)"
for _stat, _a, _j, _x in (
    ("count", "count(*) v", "", "v"), ("binary", "1 v", "", "v"), ("sum", 'sum(x."value" + y."value") v', "", "v"), ("mean", 'sum(x."value" + y."value") / (2 * count(*)) v', "", "v"), ("min", 'min(least(x."value", y."value")) v', "", "v"), ("max", 'max(greatest(x."value", y."value")) v', "", "v"),
    ("minmax", 'max(least(x."value", y."value")) v', "", "v"), ("newman", 'sum((x."value" + y."value") / (2 * (dq - 1))) v', " JOIN q ON q.ego = x.ego", "v"), ("jaccard", "count(*) v", "", "v / (a.k + b.k - v)"), ("cosine", "count(*) v", "", "v / sqrt(a.k * b.k)"),
):
    _add(f"project_{_stat}", orders_two_mode, lambda n, s=_stat: T.project(n, 2, s), f'WITH {TWO_MODE}, {_DEG}, {_JP.format(a=_a, j=_j)} SELECT i ego, j alter, round(({_x})::DOUBLE, 6) "value" FROM p JOIN d a ON a.node = i JOIN d b ON b.node = j')

# one-pass measures
_DEGREE = 'o AS (SELECT ego node, count(*) k, sum("value") s FROM e GROUP BY 1), i AS (SELECT alter node, count(*) k, sum("value") s FROM e GROUP BY 1)'
for _nm, _kw, _x in (("strength", {}, "s"), ("binary", {"binary": True}, "k"), ("opsahl", {"alpha": 0.5}, "k * pow(s / k, 0.5)"), ("standardized", {"binary": True, "standardize": True}, "k / ((SELECT count(*) FROM n) - 1)")):
    _o, _i = (f"coalesce(({_x.replace('k', 'o.k').replace('s /', 'o.s /').replace('s', 's') if _nm == 'opsahl' else _x.replace('k ', 'o.k ') if _nm == 'standardized' else 'o.' + _x})::DOUBLE, 0)".replace("o.", p + ".") for p in "oi")
    _add(f"degree_{_nm}", follow, lambda n, kw=_kw: M.degree(n, **kw), f'WITH {FOLLOW1}, {_DEGREE} SELECT n.node, round({_o}, 6) "out", round({_i}, 6) "in", round({_o} + {_i}, 6) total, CASE WHEN {_o} + {_i} = 0 THEN 1 ELSE 0 END isolate FROM n LEFT JOIN o ON o.node = n.node LEFT JOIN i ON i.node = n.node')
_add("degree_two_mode", orders_two_mode, M.two_mode_degree, f"WITH {TWO_MODE}, k AS (SELECT ego node, count(*) k FROM e GROUP BY 1 UNION ALL SELECT alter, count(*) FROM e GROUP BY 1) SELECT n.node, n.mode, round(k / (SELECT count(*) FROM n m WHERE m.mode <> n.mode)::DOUBLE, 6) degree FROM n JOIN k ON k.node = n.node")
_add("degree_two_mode_raw", orders_two_mode, lambda n: M.two_mode_degree(n, raw=True), f"WITH {TWO_MODE}, k AS (SELECT ego node, count(*) k FROM e GROUP BY 1 UNION ALL SELECT alter, count(*) FROM e GROUP BY 1) SELECT n.node, n.mode, k::DOUBLE degree FROM n JOIN k ON k.node = n.node")
_add("degree_distribution", follow, M.degree_distribution, f"WITH {FOLLOW1}, d AS (SELECT n.node, count(ego) degree FROM n LEFT JOIN e ON ego = n.node GROUP BY 1), c AS (SELECT degree, count(*) nodes FROM d GROUP BY 1) SELECT degree, nodes, round((sum(nodes) OVER (ORDER BY degree DESC) / sum(nodes) OVER ())::DOUBLE, 6) ccdf FROM c")
_add("centralization", follow, M.centralization, f"WITH {FOLLOW1}, {_DEGREE}, d AS (SELECT coalesce(o.k, 0) o, coalesce(i.k, 0) i FROM n LEFT JOIN o ON o.node = n.node LEFT JOIN i ON i.node = n.node) SELECT round((count(*) * max(o) - sum(o))::DOUBLE / pow(count(*) - 1, 2), 6) centralization_out, round((count(*) * max(i) - sum(i))::DOUBLE / pow(count(*) - 1, 2), 6) centralization_in FROM d")
_add("summary", follow, M.summary, f'WITH {FOLLOW1}, c AS (SELECT count(*) m, sum("value") s, max("value") hi FROM e), k AS (SELECT count(*) n FROM n) SELECT n nodes, m ties, round((m / (n * (n - 1)))::DOUBLE, 6) density, s "sum", 0.0::DOUBLE "min", hi "max", round((m / n)::DOUBLE, 6) mean_degree FROM c, k')
_add("summary_two_mode", orders_two_mode, M.summary, f'WITH {TWO_MODE}, c AS (SELECT count(*) m, sum("value") s, max("value") hi FROM e), k AS (SELECT count(*) n, sum(CASE WHEN mode = 1 THEN 1 ELSE 0 END) n1 FROM n) SELECT n nodes, m ties, round((m / (n1 * (n - n1)))::DOUBLE, 6) density, s "sum", 0.0::DOUBLE "min", hi "max", round((2 * m / n)::DOUBLE, 6) mean_degree FROM c, k')
_add("tabulate_values", follow, M.tabulate, f'WITH {FOLLOW1} SELECT "value", count(*) ties FROM e GROUP BY 1')
_add("tabulate_groups", trade, lambda n: M.tabulate(n, "region"), f"WITH {TRADE} SELECT x.region ego_group, y.region alter_group, count(*) ties FROM e JOIN n x ON ego = x.node JOIN n y ON alter = y.node GROUP BY 1, 2")
_add("mixing", pairs, lambda n: M.mixing(n, "segment"), f"WITH {PAIRS}{BOTH} SELECT x.segment ego_group, y.segment alter_group, count(*) ties FROM l JOIN n x ON ego = x.node JOIN n y ON alter = y.node GROUP BY 1, 2")
_add("ei_index", trade, lambda n: M.ei_index(n, "region"), f"WITH {TRADE}, c AS (SELECT sum(CASE WHEN x.region <> y.region THEN 1 ELSE 0 END)::BIGINT external, sum(CASE WHEN x.region = y.region THEN 1 ELSE 0 END)::BIGINT internal FROM e JOIN n x ON ego = x.node JOIN n y ON alter = y.node) SELECT external, internal, round(((external - internal) / (external + internal))::DOUBLE, 6) ei FROM c")
_add("alter_stats", follow, lambda n: M.alter_stats(n, "events", 60),
     f'WITH {FOLLOW1}, t AS (SELECT ego node, "value" w, y.events::DOUBLE x FROM e JOIN n y ON alter = y.node), p AS (SELECT node, 1 - sum(c * c) / pow(sum(c), 2) diversity FROM (SELECT node, x, count(*) c FROM t GROUP BY 1, 2) GROUP BY 1), s AS (SELECT node, avg(x) mean, sum(x * w) / sum(w) wmean, sum(x) "sum", min(x) "min", max(x) "max", stddev_samp(x) sd, count(*) "count", avg(CASE WHEN x = 60 THEN 1.0 ELSE 0.0 END) proportion FROM t GROUP BY 1) '
     'SELECT n.node, round(mean, 6) mean, round(wmean, 6) wmean, round(coalesce("sum", 0), 6) "sum", "min", "max", round(sd, 6) sd, coalesce("count", 0)::BIGINT "count", round(proportion::DOUBLE, 6) proportion, round(diversity, 6) diversity FROM n LEFT JOIN s ON s.node = n.node LEFT JOIN p ON p.node = n.node')  # fmt: skip
_add("context", follow, lambda n: M.context(n, "events", "incoming"), f'WITH {FOLLOW1}, s AS (SELECT alter node, sum("value" * events) / sum("value") mean, sum("value" * events) "sum", min(events)::DOUBLE "min", max(events)::DOUBLE "max", sqrt(greatest(sum("value" * events * events) / sum("value") - pow(sum("value" * events) / sum("value"), 2), 0)) sd FROM e JOIN n y ON ego = y.node GROUP BY 1) SELECT n.node, round(mean, 6) mean, round("sum", 6) "sum", "min", "max", round(sd, 6) sd FROM n LEFT JOIN s ON s.node = n.node')
_add("dyad_census", follow, M.dyad_census, f"WITH {FOLLOW1}, p AS (SELECT least(ego, alter) a, greatest(ego, alter) b, count(*) k FROM e GROUP BY 1, 2), c AS (SELECT sum(CASE WHEN k = 2 THEN 1 ELSE 0 END)::BIGINT m, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END)::BIGINT a FROM p), k AS (SELECT count(*) n FROM n) SELECT m mutual, a \"asymmetric\", (n * (n - 1) / 2 - m - a)::BIGINT null_dyads, round((m / (m + a))::DOUBLE, 6) reciprocity FROM c, k")
_add("assortativity_degree", visits, M.assortativity, f"WITH {VISITS}, l AS (SELECT ego, alter FROM e UNION SELECT alter, ego FROM e), d AS (SELECT ego node, count(*) d FROM l GROUP BY 1) SELECT round(corr(x.d, y.d), 6) assortativity FROM l JOIN d x ON ego = x.node JOIN d y ON alter = y.node")
_add("assortativity_attribute", follow, lambda n: M.assortativity(n, "events"), f"WITH {FOLLOW1}, l AS (SELECT ego, alter FROM e UNION SELECT alter, ego FROM e) SELECT round(corr(x.events, y.events), 6) assortativity FROM l JOIN n x ON ego = x.node JOIN n y ON alter = y.node")
_add("correlate", trade, lambda n: M.correlate(n, T.transpose(n)), f'WITH {TRADE} SELECT round(corr(coalesce(a."value", 0), coalesce(b."value", 0)), 6) correlation FROM n x JOIN n y ON x.node <> y.node LEFT JOIN e a ON a.ego = x.node AND a.alter = y.node LEFT JOIN e b ON b.ego = y.node AND b.alter = x.node')


def _waves(s: SparkSession, d: str) -> tuple[N.Network, N.Network]:
    ev = s.read.parquet(f"{d}/events.parquet").withColumn("item", F.pmod("event_id", F.lit(50)))
    net = N.snapshots(ev.withColumn("month_half", (F.dayofmonth("ts") > 15).cast("int")), "user_id", "item", "month_half")
    net = net.with_(edges=net.edges.where("ego <> alter"))
    return N.at_time(net, 0), N.at_time(net, 1)


_WAVES = "w AS (SELECT DISTINCT user_id ego, event_id % 50 alter, CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END h FROM events WHERE user_id <> event_id % 50), a AS (SELECT ego, alter FROM w WHERE h = 0), b AS (SELECT ego, alter FROM w WHERE h = 1), n AS (SELECT DISTINCT user_id node FROM events UNION SELECT DISTINCT event_id % 50 FROM events)"
_add("turnover", _waves, lambda w: M.turnover(*w), f"WITH {_WAVES}, t AS (SELECT coalesce(a.ego, b.ego) node, a.ego IS NOT NULL x, b.ego IS NOT NULL y FROM a FULL JOIN b ON a.ego = b.ego AND a.alter = b.alter), c AS (SELECT node, sum(CASE WHEN x AND y THEN 1 ELSE 0 END)::BIGINT s, sum(CASE WHEN NOT x THEN 1 ELSE 0 END)::BIGINT f, sum(CASE WHEN NOT y THEN 1 ELSE 0 END)::BIGINT d FROM t GROUP BY 1) SELECT n.node, coalesce(s, 0) stable, coalesce(f, 0) formed, coalesce(d, 0) dissolved, round((s / (s + f + d))::DOUBLE, 6) jaccard, round((CASE WHEN s + d > 0 THEN s / (s + d) END)::DOUBLE, 6) persistence FROM n LEFT JOIN c ON c.node = n.node")
_add("formation", _waves, lambda w: M.formation(*w), f"WITH {_WAVES}, f AS (SELECT * FROM b EXCEPT SELECT * FROM a), r AS (SELECT alter ego, ego alter FROM a EXCEPT SELECT * FROM a), c AS (SELECT DISTINCT x.ego, y.alter FROM a x JOIN a y ON x.alter = y.ego WHERE x.ego <> y.alter EXCEPT SELECT * FROM a), k AS (SELECT (SELECT count(*) FROM n) n, (SELECT count(*) FROM a) m, (SELECT count(*) FROM f) f) SELECT round(((SELECT count(*) FROM f JOIN r USING (ego, alter)) / f)::DOUBLE, 6) formed_reciprocal, round(((SELECT count(*) FROM f JOIN c USING (ego, alter)) / f)::DOUBLE, 6) formed_closing, round(((SELECT count(*) FROM r) / (n * (n - 1) - m))::DOUBLE, 6) absent_reciprocal, round(((SELECT count(*) FROM c) / (n * (n - 1) - m))::DOUBLE, 6) absent_closing FROM k")
_add("modularity", pairs, lambda n: M.modularity(n, n.nodes.select("node", F.col("segment").alias("community"))), f'WITH {PAIRS}{BOTH}, k AS (SELECT segment c, sum("value") k FROM l JOIN n ON ego = node GROUP BY 1), w AS (SELECT sum("value") w FROM l JOIN n x ON ego = x.node JOIN n y ON alter = y.node WHERE x.segment = y.segment), m AS (SELECT sum("value") m FROM l) SELECT round((w - (SELECT sum(k * k) FROM k) / m) / m, 6) modularity FROM w, m')
_ADOPT = "a AS (SELECT user_id node, min(day(ts))::INT t FROM events WHERE event_type = 'purchase' OR event_type = 'error' GROUP BY 1)"


def _adoption(s: SparkSession, d: str) -> tuple[N.Network, DataFrame]:
    ev = s.read.parquet(f"{d}/events.parquet")
    return follow(s, d), ev.where("event_type in ('purchase', 'error')").groupBy(F.col("user_id").alias("node")).agg(F.min(F.dayofmonth("ts")).alias("t"))


_add("adoption_curve", _adoption, lambda x: M.adoption_curve(x[1], x[0].n_nodes()), f"WITH {_ADOPT}, c AS (SELECT t, count(*) new FROM a GROUP BY 1), s AS (SELECT t, new, sum(new) OVER (ORDER BY t)::BIGINT adopters FROM c) SELECT t, new, adopters, round((adopters / (SELECT count(DISTINCT user_id) FROM events))::DOUBLE, 6) proportion, round((CASE WHEN adopters > new THEN new / (adopters - new) END)::DOUBLE, 6) growth FROM s")
_EXPO = f'{FOLLOW1}, {_ADOPT}, x AS (SELECT n.node, g.t, coalesce(sum(CASE WHEN a.t <= g.t - 1 THEN "value" END) / sum("value"), 0) exposure FROM n CROSS JOIN (SELECT DISTINCT t FROM a) g LEFT JOIN e ON ego = n.node LEFT JOIN a ON a.node = alter GROUP BY 1, 2)'
_add("diffusion_exposure", _adoption, lambda x: M.exposure(x[0], x[1], x[1].select("t").distinct()), f"WITH {_EXPO} SELECT node, t, round(exposure, 6) exposure FROM x")
_add("diffusion_threshold", _adoption, lambda x: M.thresholds(*x), f"WITH {_EXPO} SELECT x.node, x.t, round(exposure, 6) threshold FROM x JOIN a ON a.node = x.node AND a.t = x.t")
_add("diffusion_person_periods", _adoption, lambda x: M.person_periods(x[0], x[1], x[1].select("t").distinct()), f"WITH {_EXPO} SELECT x.node, x.t, round(exposure, 6) exposure, CASE WHEN a.t = x.t THEN 1 ELSE 0 END adopts FROM x LEFT JOIN a ON a.node = x.node WHERE a.t IS NULL OR x.t <= a.t")

# joins of ties with ties
_add("clustering_directed", visits, S.clustering, f"WITH {VISITS}, w AS (SELECT x.alter node, x.ego u, y.alter v FROM e x JOIN e y ON x.alter = y.ego WHERE x.ego <> y.alter), c AS (SELECT w.node, count(*) pairs, count(e.ego) closed FROM w LEFT JOIN e ON e.ego = u AND e.alter = v GROUP BY 1) SELECT n.node, coalesce(closed, 0) closed, coalesce(pairs, 0)::BIGINT pairs, round((closed / pairs)::DOUBLE, 6) \"local\" FROM n LEFT JOIN c ON c.node = n.node")
_UW = "w AS (SELECT x.ego node, x.alter u, y.alter v, x.\"value\" a, y.\"value\" b FROM l x JOIN l y ON x.ego = y.ego AND x.alter < y.alter)"
_add("clustering_undirected", pairs, S.clustering, f"WITH {PAIRS}{BOTH}, {_UW}, c AS (SELECT w.node, count(*) pairs, count(e.ego) closed FROM w LEFT JOIN e ON e.ego = u AND e.alter = v GROUP BY 1) SELECT n.node, coalesce(closed, 0) closed, coalesce(pairs, 0)::BIGINT pairs, round((closed / pairs)::DOUBLE, 6) \"local\" FROM n LEFT JOIN c ON c.node = n.node")
for _m, _x in (("arithmetic", "(a + b) / 2"), ("geometric", "sqrt(a * b)"), ("maximum", "greatest(a, b)"), ("minimum", "least(a, b)")):
    _add(f"clustering_valued_{_m}", pairs, lambda n, m=_m: S.clustering_valued(n, m), f'WITH {PAIRS}{BOTH}, {_UW}, c AS (SELECT w.node, sum(CASE WHEN e.ego IS NOT NULL THEN {_x} ELSE 0 END) / sum({_x}) "local" FROM w LEFT JOIN e ON e.ego = u AND e.alter = v GROUP BY 1) SELECT n.node, round("local", 6) "local" FROM n LEFT JOIN c ON c.node = n.node')
_add("clustering_global", pairs, S.clustering_summary, f'WITH {PAIRS}{BOTH}, {_UW}, c AS (SELECT w.node, count(*) pairs, count(e.ego) closed FROM w LEFT JOIN e ON e.ego = u AND e.alter = v GROUP BY 1) SELECT round((sum(closed) / sum(pairs))::DOUBLE, 6) "global", round(avg(closed / pairs), 6) average FROM c')
_add("ego_density", visits, S.ego_density, f"WITH {VISITS}, d AS (SELECT ego node, count(*) k FROM e GROUP BY 1), t AS (SELECT x.ego node, count(*) t FROM e x JOIN e y ON x.ego = y.ego JOIN e z ON z.ego = x.alter AND z.alter = y.alter WHERE x.alter <> y.alter GROUP BY 1) SELECT n.node, coalesce(k, 0) alters, round((CASE WHEN k > 1 THEN coalesce(t, 0) / (k * (k - 1)) END)::DOUBLE, 6) density FROM n LEFT JOIN d ON d.node = n.node LEFT JOIN t ON t.node = n.node")
_ROLES = (("coordinator", "a = b AND b = c"), ("gatekeeper", "a <> b AND b = c"), ("representative", "a = b AND b <> c"), ("consultant", "a = c AND a <> b"), ("liaison", "a <> b AND b <> c AND a <> c"))
_add("brokerage", visits, lambda n: S.brokerage(n, "segment"), f"WITH {VISITS}, t AS (SELECT y.ego node, p.segment a, q.segment b, r.segment c FROM e x JOIN e y ON x.alter = y.ego AND x.ego <> y.alter JOIN n p ON p.node = x.ego JOIN n q ON q.node = y.ego JOIN n r ON r.node = y.alter WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.ego = x.ego AND z.alter = y.alter)) SELECT n.node, " + ", ".join(f"coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0)::BIGINT {k}" for k, c in _ROLES) + " FROM n LEFT JOIN t ON t.node = n.node GROUP BY 1")
_add("shared_neighbors", visits, S.shared_neighbors, f"WITH {VISITS} SELECT e.ego, e.alter, count(*) shared FROM e JOIN e x ON x.ego = e.ego JOIN e y ON y.ego = x.alter AND y.alter = e.alter GROUP BY 1, 2")
_add("simmelian", follow, S.simmelian, f"WITH {FOLLOW1}, m AS (SELECT ego, alter FROM e WHERE EXISTS (SELECT 1 FROM e r WHERE r.ego = e.alter AND r.alter = e.ego)) SELECT m.ego, m.alter, count(*) shared FROM m JOIN m x ON x.ego = m.ego JOIN m y ON y.ego = x.alter AND y.alter = m.alter GROUP BY 1, 2")
_add("triangles", pairs, S.triangles, f"WITH {PAIRS} SELECT x.ego a, x.alter b, y.alter c FROM e x JOIN e y ON x.ego = y.ego AND x.alter < y.alter JOIN e z ON z.ego = x.alter AND z.alter = y.alter")
_add("balance", lambda s, d: (lambda n: n.with_(edges=n.edges.withColumn("value", F.when((F.col("ego") + F.col("alter")) % 3 == 0, -F.col("value")).otherwise(F.col("value")))))(pairs(s, d)), S.balance, f"WITH {PAIRS}, g AS (SELECT ego, alter, CASE WHEN (ego + alter) % 3 = 0 THEN -1 ELSE 1 END s FROM e), t AS (SELECT x.ego a, x.alter b, y.alter c, x.s * y.s * z.s > 0 ok FROM g x JOIN g y ON x.ego = y.ego AND x.alter < y.alter JOIN g z ON z.ego = x.alter AND z.alter = y.alter), u AS (SELECT a node, ok FROM t UNION ALL SELECT b, ok FROM t UNION ALL SELECT c, ok FROM t) SELECT n.node, count(ok) triangles, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END), 0)::BIGINT balanced FROM n LEFT JOIN u ON u.node = n.node GROUP BY 1")
_add("triad_census", trade, S.triad_census, f"""WITH {TRADE}, s AS (SELECT x.node i, y.node j, (CASE WHEN a.ego IS NULL THEN 0 ELSE 1 END) + (CASE WHEN b.ego IS NULL THEN 0 ELSE 2 END) s FROM n x JOIN n y ON x.node < y.node LEFT JOIN e a ON a.ego = x.node AND a.alter = y.node LEFT JOIN e b ON b.ego = y.node AND b.alter = x.node),
q AS (SELECT p.s ij, r.s ik, t.s jk FROM s p JOIN s r ON p.i = r.i AND p.j < r.j JOIN s t ON t.i = p.j AND t.j = r.j),
m AS (SELECT *, (ij = 3)::INT + (ik = 3)::INT + (jk = 3)::INT mu, (ij IN (1, 2))::INT + (ik IN (1, 2))::INT + (jk IN (1, 2))::INT asy,
(ij = 1)::INT + (ik = 1)::INT oi, (ij = 2)::INT + (jk = 1)::INT oj, (ik = 2)::INT + (jk = 2)::INT ok,
(ij = 2)::INT + (ik = 2)::INT ii, (ij = 1)::INT + (jk = 2)::INT inj, (ik = 1)::INT + (jk = 1)::INT ink FROM q),
c AS (SELECT mu::VARCHAR || asy || (3 - mu - asy) || CASE WHEN asy = 2 AND mu IN (0, 1) THEN CASE WHEN greatest(oi, oj, ok) = 2 THEN 'D' WHEN greatest(ii, inj, ink) = 2 THEN 'U' ELSE 'C' END
WHEN asy = 3 THEN CASE WHEN greatest(oi, oj, ok) = 1 THEN 'C' ELSE 'T' END
WHEN mu = 1 AND asy = 1 THEN CASE WHEN (ij = 3 AND (ik = 2 OR jk = 2)) OR (ik = 3 AND (ij = 2 OR jk = 1)) OR (jk = 3 AND (ij = 1 OR ik = 1)) THEN 'D' ELSE 'U' END ELSE '' END triad FROM m)
SELECT k.triad, count(c.triad) "count" FROM (SELECT unnest(['003', '012', '021D', '021U', '021C', '030T', '030C', '102', '111D', '111U', '120D', '120U', '120C', '201', '210', '300']) triad) k LEFT JOIN c ON c.triad = k.triad GROUP BY 1""")
_BURT = 'z AS (SELECT ego i, alter j, sum("value") z FROM (SELECT ego, alter, "value" FROM e UNION ALL SELECT alter, ego, "value" FROM e) GROUP BY 1, 2), p AS (SELECT i, j, z / sum(z) OVER (PARTITION BY i) p, z / max(z) OVER (PARTITION BY i) m FROM z), '
_add("burt", visits, S.burt, f"WITH {VISITS}, {_BURT} v AS (SELECT a.i, b.j, sum(a.p * b.p) via FROM p a JOIN p b ON a.j = b.i WHERE a.i <> b.j GROUP BY 1, 2), r AS (SELECT a.i, b.i j, sum(a.p * b.m) red FROM p a JOIN p b ON a.j = b.j WHERE a.i <> b.i GROUP BY 1, 2), t AS (SELECT p.i, pow(p.p + coalesce(via, 0), 2) c, 1 - coalesce(red, 0) es FROM p LEFT JOIN v ON v.i = p.i AND v.j = p.j LEFT JOIN r ON r.i = p.i AND r.j = p.j), s AS (SELECT i, count(*) n, sum(es) es, sum(c) c, sum(c * ln(c)) cl FROM t GROUP BY 1) SELECT node, coalesce(n, 0) degree, round(es, 6) effective_size, round(es / n, 6) efficiency, round(c, 6) \"constraint\", round(CASE WHEN n = 1 THEN 1 ELSE (cl / (c / n) - n * ln(c / n)) / (n * ln(n)) END, 6) hierarchy FROM n LEFT JOIN s ON s.i = node")
_add("dyadic_constraint", visits, S.dyadic_constraint, f"WITH {VISITS}, {_BURT} v AS (SELECT a.i, b.j, sum(a.p * b.p) via FROM p a JOIN p b ON a.j = b.i WHERE a.i <> b.j GROUP BY 1, 2), r AS (SELECT a.i, b.i j, sum(a.p * b.m) red FROM p a JOIN p b ON a.j = b.j WHERE a.i <> b.i GROUP BY 1, 2) SELECT p.i ego, p.j alter, round(pow(p.p + coalesce(via, 0), 2), 6) \"constraint\", round(coalesce(red, 0), 6) redundancy FROM p LEFT JOIN v ON v.i = p.i AND v.j = p.j LEFT JOIN r ON r.i = p.i AND r.j = p.j")
for _ix, _x in (("common", "c"), ("jaccard", "c / (x.d + y.d - c)"), ("dice", "2 * c / (x.d + y.d)"), ("cosine", "c / sqrt(x.d * y.d)"), ("adamic", "aa")):
    _add(f"similarity_{_ix}", visits, lambda n, i=_ix: S.similarity_index(n, i), f'WITH {VISITS}, l AS (SELECT ego, alter FROM e UNION SELECT alter, ego FROM e), d AS (SELECT ego node, count(*) d FROM l GROUP BY 1), p AS (SELECT a.ego i, b.ego j, count(*) c, sum(1 / ln(d)) aa FROM l a JOIN l b ON a.alter = b.alter AND a.ego < b.ego JOIN d ON d.node = a.alter GROUP BY 1, 2) SELECT i, j, round(({_x})::DOUBLE, 6) "value" FROM p JOIN d x ON x.node = i JOIN d y ON y.node = j')
_PROF = 'p AS (SELECT x.node i, y.node j, q.node q, coalesce(a."value", 0) a, coalesce(b."value", 0) b FROM n x JOIN n y ON x.node < y.node JOIN n q ON q.node <> x.node AND q.node <> y.node LEFT JOIN e a ON a.ego = x.node AND a.alter = q.node LEFT JOIN e b ON b.ego = y.node AND b.alter = q.node)'
for _ix, _x in (
    ("matches", "sum(CASE WHEN (a <> 0) = (b <> 0) THEN 1 ELSE 0 END) / count(*)"), ("hamming", "sum(CASE WHEN (a <> 0) = (b <> 0) THEN 1 ELSE 0 END)"), ("jaccard", "sum(CASE WHEN a <> 0 AND b <> 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a <> 0 OR b <> 0 THEN 1 ELSE 0 END), 0)"),
    ("crossproduct", "sum(a * b)"), ("pearson", "CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END"), ("euclidean", "sqrt(sum((a - b) * (a - b)))"), ("manhattan", "sum(abs(a - b))"), ("nonmatches", "sum(CASE WHEN (a <> 0) <> (b <> 0) THEN 1 ELSE 0 END) / count(*)"),
    ("dhamming", "sum(CASE WHEN (a <> 0) <> (b <> 0) THEN 1 ELSE 0 END)"), ("djaccard", "1 - sum(CASE WHEN a <> 0 AND b <> 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a <> 0 OR b <> 0 THEN 1 ELSE 0 END), 0)"),
):
    _add(f"profile_{_ix}", trade, lambda n, i=_ix: S.profile_similarity(n, i), f'WITH {TRADE}, {_PROF} SELECT i, j, round(({_x})::DOUBLE, 6) "value" FROM p GROUP BY 1, 2')
_add("robins_alexander", orders_two_mode, S.robins_alexander, f"WITH {TWO_MODE}, p AS (SELECT x.alter i, y.alter j, count(*) s FROM e x JOIN e y ON x.ego = y.ego AND x.alter < y.alter GROUP BY 1, 2), c AS (SELECT sum(s * (s - 1) / 2)::DOUBLE c4 FROM p), a AS (SELECT ego, count(*) k FROM e GROUP BY 1), b AS (SELECT alter, count(*) k FROM e GROUP BY 1), l AS (SELECT sum((a.k - 1) * (b.k - 1))::BIGINT l3 FROM e JOIN a USING (ego) JOIN b USING (alter)) SELECT c4, l3, round(4 * c4 / l3, 6) clustering FROM c, l")
_NODF = "k{m} AS (SELECT {o} i, count(*) k FROM e GROUP BY 1), s{m} AS (SELECT x.{o} i, y.{o} j, count(*) s FROM e x JOIN e y ON x.{q} = y.{q} AND x.{o} < y.{o} GROUP BY 1, 2), t{m} AS (SELECT sum(CASE WHEN a.k <> b.k THEN 100.0 * s / least(a.k, b.k) ELSE 0 END)::DOUBLE t FROM s{m} JOIN k{m} a ON a.i = s{m}.i JOIN k{m} b ON b.i = s{m}.j), p{m} AS (SELECT count(*) * (count(*) - 1) / 2 p FROM k{m})"
_add("nestedness", orders_two_mode, S.nestedness, f"WITH {TWO_MODE}, {_NODF.format(m=1, o='ego', q='alter')}, {_NODF.format(m=2, o='alter', q='ego')}, c AS (SELECT sum((a.k - coalesce(s, 0)) * (b.k - coalesce(s, 0))) c FROM k2 a JOIN k2 b ON a.i < b.i LEFT JOIN s2 ON s2.i = a.i AND s2.j = b.i) SELECT round((t1.t + t2.t) / (p1.p + p2.p), 6) nodf, round(t1.t / p1.p, 6) nodf_1, round(t2.t / p2.p, 6) nodf_2, round((c / p2.p)::DOUBLE, 6) c_score FROM t1, t2, p1, p2, c")
_add("motifs4", trade, S.motifs4, f"""WITH {TRADE}, l AS (SELECT ego, alter FROM e UNION SELECT alter, ego FROM e), s AS (SELECT x.node i, y.node j, (l.ego IS NOT NULL)::INT s FROM n x JOIN n y ON x.node < y.node LEFT JOIN l ON l.ego = x.node AND l.alter = y.node),
q AS (SELECT a.s + b.s + c.s + d.s + f.s + g.s m, a.s + b.s + c.s da, a.s + d.s + f.s db, b.s + d.s + g.s dc, c.s + f.s + g.s dd FROM s a JOIN s b ON b.i = a.i AND b.j > a.j JOIN s c ON c.i = a.i AND c.j > b.j JOIN s d ON d.i = a.j AND d.j = b.j JOIN s f ON f.i = a.j AND f.j = c.j JOIN s g ON g.i = b.j AND g.j = c.j),
k AS (SELECT CASE WHEN least(da, db, dc, dd) = 0 THEN 'other' WHEN m = 3 AND greatest(da, db, dc, dd) = 3 THEN 'star' WHEN m = 3 AND greatest(da, db, dc, dd) = 2 THEN 'path' WHEN m = 4 AND greatest(da, db, dc, dd) = 2 THEN 'cycle' WHEN m = 4 THEN 'paw' WHEN m = 5 THEN 'diamond' WHEN m = 6 THEN 'clique' ELSE 'other' END motif FROM q)
SELECT u.motif, count(k.motif) "count" FROM (SELECT unnest(['path', 'star', 'cycle', 'paw', 'diamond', 'clique', 'other']) motif) u LEFT JOIN k ON k.motif = u.motif GROUP BY 1""")

# fix points
_ADJ = "l AS (SELECT ego, alter FROM e UNION SELECT alter, ego FROM e)"
#: Nodes numbered from 1 as ix, and adj: one row with the list of each node's neighbours (from l) by number.
_IX = """ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) i FROM n),
adj AS MATERIALIZED (SELECT list(nb ORDER BY i) nb FROM (SELECT ix.i, coalesce(list(j.i ORDER BY j.i) FILTER (j.i IS NOT NULL), []) nb FROM ix LEFT JOIN l ON l.ego = ix.node LEFT JOIN ix j ON j.node = l.alter GROUP BY ix.i))"""


def _settle(start: str, step: str, rounds: int | None = None) -> str:
    """r: rows (k, x) with a list of states x, by number, until they stay the same or for so many rounds."""
    until = "y <> x" if rounds is None else f"k < {rounds}"
    return f"r AS (SELECT 0 k, {start} x FROM adj UNION ALL SELECT k + 1, y FROM (SELECT k, x, {step} y FROM r, adj) WHERE {until}), z AS MATERIALIZED (SELECT x FROM r ORDER BY k DESC LIMIT 1)"


_LEAST = _settle("generate_series(1, len(nb))", "list_transform(nb, lambda b, i: least(x[i], coalesce(list_min(list_transform(b, lambda j: x[j])), x[i])))")
_CC = f"WITH RECURSIVE {VISITS}, {_ADJ}, {_IX}, {_LEAST}, k AS (SELECT node, dense_rank() OVER (ORDER BY x[i])::BIGINT component FROM ix, z)"
_add("components", visits, I.components, f"{_CC} SELECT node, component FROM k")
_add("component_sizes", visits, I.component_sizes, f"{_CC} SELECT component, count(*) size, round((count(*) / (SELECT count(*) FROM n))::DOUBLE, 6) share FROM k GROUP BY 1")
_add("largest_component", visits, I.largest_component, f"{_CC} SELECT node, CASE WHEN component = (SELECT component FROM k GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) THEN 1 ELSE 0 END lgc FROM k")
_ROADS_CC = f"WITH RECURSIVE {ROADS}, {_ADJ}, {_IX}, {_LEAST}, k AS (SELECT node, dense_rank() OVER (ORDER BY x[i])::BIGINT component FROM ix, z)"
_add("components_roads", roads, I.components, f"{_ROADS_CC} SELECT node, component FROM k")
_add("components_joined", roads, lambda n: I.components(n, local_rows=0), f"{_ROADS_CC} SELECT node, component FROM k")


def _bfs(net: str) -> str:
    return f"WITH RECURSIVE {net}, r(source, node, d) USING KEY (source, node) AS (SELECT node, node, 0 FROM n UNION SELECT r.source, e.alter, min(r.d) + 1 FROM r JOIN e ON e.ego = r.node LEFT JOIN recurring.r k ON k.source = r.source AND k.node = e.alter WHERE k.node IS NULL GROUP BY 1, 2), g AS (SELECT source, node, d::DOUBLE distance FROM r WHERE source <> node)"


_BFS, _BFSF = _bfs(VISITS), _bfs(FOLLOW1)
_hops = {"alpha": 0.0}
_add("geodesics", follow, lambda n: I.geodesics(n, **_hops), f"{_BFSF} SELECT source, node, distance FROM g")
_add("geodesics_joined", trade, lambda n: I.geodesics(n, local_rows=0, **_hops), f"{_bfs(TRADE)} SELECT source, node, distance FROM g")
_COST = f"WITH RECURSIVE {TRADE}, w(source, node, d) AS (SELECT node, node, 0.0::DOUBLE FROM n), " + ", ".join(f"w{k} AS MATERIALIZED (SELECT source, node, min(d) d FROM (SELECT source, node, d FROM {'w' if k == 1 else f'w{k - 1}'} UNION ALL SELECT source, alter, d + 1 / \"value\" FROM {'w' if k == 1 else f'w{k - 1}'} JOIN e ON ego = node) GROUP BY 1, 2)" for k in range(1, 13))
_add("geodesics_valued", trade, I.geodesics, f"{_COST} SELECT source, node, round(d, 6) distance FROM w12 WHERE source <> node")
_add("reach", follow, I.reach, f"{_BFSF} SELECT source, node FROM g")
_add("geodesic_summary", visits, lambda n: I.geodesic_summary(n, **_hops), f"{_BFS} SELECT n.node, count(g.node) reached, sum(distance) farness, max(distance) eccentricity FROM n LEFT JOIN g ON g.source = n.node GROUP BY 1")
_add("closeness", visits, lambda n: I.closeness(n, **_hops), f"{_BFS}, s AS (SELECT n.node, count(g.node) reached, sum(distance) farness FROM n LEFT JOIN g ON g.source = n.node GROUP BY 1) SELECT node, farness, round(1 / farness, 6) nearness, round(reached / farness, 6) closeness FROM s")
_add("closeness_legacy", follow, lambda n: I.closeness(n, legacy=True, **_hops), f"{_BFSF}, s AS (SELECT n.node, sum(distance) farness FROM n LEFT JOIN g ON g.source = n.node GROUP BY 1) SELECT node, farness, round(1 / farness, 6) nearness, round(((SELECT count(*) FROM n) - 1) / farness, 6) closeness FROM s")
_add("katz_decay", follow, lambda n: I.katz_decay(n, 0.5, cost=0.0), f"{_BFSF} SELECT n.node, round(coalesce(sum(pow(0.5, distance)), 0), 6) katz FROM n LEFT JOIN g ON g.source = n.node GROUP BY 1")
_add("utility", follow, lambda n: I.utility(n, 0.5, 0.1), f"{_BFSF}, d AS (SELECT ego, count(*) d FROM e GROUP BY 1), s AS (SELECT n.node, coalesce(sum(pow(0.5, distance)), 0) b FROM n LEFT JOIN g ON g.source = n.node GROUP BY 1) SELECT node, round(b - 0.1 * coalesce(d, 0), 6) utility FROM s LEFT JOIN d ON ego = node")
#: In-ties of each node by number with the share p of their sender's value.
_SHARES = """ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) i FROM n), s AS (SELECT ego, alter, "value" / sum("value") OVER (PARTITION BY ego) p FROM e),
adj AS MATERIALIZED (SELECT list(nb ORDER BY i) nb FROM (SELECT ix.i, coalesce(list({'j': j.i, 'p': p} ORDER BY j.i) FILTER (j.i IS NOT NULL), []) nb FROM ix LEFT JOIN s ON s.alter = ix.node LEFT JOIN ix j ON j.node = s.ego GROUP BY ix.i))"""
_RANKED = _settle("list_transform(nb, lambda b: 1.0::DOUBLE)", "list_transform(nb, lambda b: 1 + 0.85 * coalesce(list_sum(list_transform(b, lambda t: x[t.j] * t.p)), 0))", 150)
_add("pagerank", visits, I.pagerank, f"WITH RECURSIVE {VISITS}, {_SHARES}, {_RANKED} SELECT node, round(x[i] / list_sum(x), 6) pagerank FROM ix, z")
_add("pagerank_joined", trade, lambda n: I.pagerank(n, local_rows=0, tol=1e-8), f"WITH RECURSIVE {TRADE}, {_SHARES}, {_RANKED} SELECT node, round(x[i] / list_sum(x), 6) pagerank FROM ix, z")
_CORE = _settle("list_transform(nb, lambda b: len(b))", "list_transform(nb, lambda b: coalesce(list_max(list_transform(list_reverse_sort(list_transform(b, lambda j: x[j])), lambda v, p: least(v, p))), 0))")
_add("kcore", visits, I.kcore, f"WITH RECURSIVE {VISITS}, {_ADJ}, {_IX}, {_CORE} SELECT node, x[i]::BIGINT coreness FROM ix, z")
_add("kcore_3", visits, lambda n: I.kcore(n).where("coreness >= 3").select("node"), f"WITH RECURSIVE {VISITS}, {_ADJ}, {_IX}, {_CORE} SELECT node FROM ix, z WHERE x[i] >= 3")
_add("kcore_joined", follow, lambda n: I.kcore(n, local_rows=0), f"WITH RECURSIVE {FOLLOW1}, {_ADJ}, {_IX}, {_CORE} SELECT node, x[i]::BIGINT coreness FROM ix, z")
_add("bridges_local", visits, I.bridges_local, f"WITH {VISITS}, {_ADJ}, t AS (SELECT DISTINCT x.ego, y.alter FROM l x JOIN l y ON x.alter = y.ego) SELECT ego, alter FROM l WHERE ego < alter AND NOT EXISTS (SELECT 1 FROM t WHERE t.ego = l.ego AND t.alter = l.alter)")
_POWER = _settle("list_transform(nb, lambda b: 1.0::DOUBLE)", "list_transform(list_transform(nb, lambda b: coalesce(list_sum(list_transform(b, lambda j: x[j])), 0)), lambda v: v / greatest(list_sum(x), 1))", 120)
_EVC = "SELECT node, round(x[i] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) evcent FROM ix, z"
_add("eigenvector", follow, I.eigenvector, f"WITH RECURSIVE {FOLLOW1}, {_ADJ}, {_IX}, {_POWER} {_EVC}")
_add("eigenvector_distributed", trade, lambda n: I.eigenvector(n, tol=1e-8, local_rows=0), f"WITH RECURSIVE {TRADE}, {_ADJ}, {_IX}, {_POWER} {_EVC}")


def _stable_labels(net: N.Network) -> DataFrame:
    """How many nodes have a label that another label outweighs among their neighbours: none when labels have settled."""
    lab = I.label_propagation(net)
    votes = net.arcs.join(lab.select(F.col("node").alias("alter"), "community"), "alter").groupBy(F.col("ego").alias("node"), "community").agg(F.sum("value").alias("w"))
    best = votes.groupBy("node").agg(F.max("w").alias("top"))
    own = lab.join(votes, ["node", "community"], "left").join(best, "node", "left")
    strays = lab.select(F.col("community").alias("node")).distinct().join(lab, "node", "left_anti")
    return own.agg(F.count("*").alias("nodes"), F.sum((F.coalesce("top", F.lit(0.0)) > F.coalesce("w", F.lit(0.0))).cast("long")).alias("unstable")).crossJoin(strays.agg(F.count("*").alias("strays")))


_add("label_propagation", pairs, _stable_labels, "SELECT count(*) nodes, 0::BIGINT unstable, 0::BIGINT strays FROM customer")
_add("label_propagation_homes", homes, lambda n: I.label_propagation(n).groupBy("community").agg(F.count("*").alias("size")).select("size"), f"WITH {HOMES} SELECT count(ego) + 1 size FROM n LEFT JOIN e ON alter = node WHERE node LIKE 'n%' GROUP BY node")
_add("katz_walks", trade, lambda n: I.katz_walks(n.with_(edges=n.edges.withColumn("value", F.lit(1.0))), 0.02, tol=1e-9),
     f"WITH RECURSIVE {TRADE}, l AS (SELECT ego, alter FROM e), {_IX}, {_settle('list_transform(nb, lambda b: 1.0::DOUBLE)', 'list_transform(nb, lambda b: 1 + 0.02 * coalesce(list_sum(list_transform(b, lambda j: x[j])), 0))', 80)} SELECT node, round(x[i], 6) katz FROM ix, z")
_WALK = f"""WITH RECURSIVE {TRADE}, u AS (SELECT least(ego, alter) a, greatest(ego, alter) b, max("value") w FROM e GROUP BY 1, 2), l AS (SELECT a ego, b alter, w FROM u UNION ALL SELECT b, a, w FROM u),
ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) i FROM n), s AS (SELECT ego, alter, w / sum(w) OVER (PARTITION BY ego) p FROM l),
adj AS MATERIALIZED (SELECT list(nb ORDER BY i) nb, max(t) t FROM (SELECT ix.i, max(CASE WHEN node = 3 THEN ix.i END) t, coalesce(list({{'j': j.i, 'p': p}} ORDER BY j.i) FILTER (j.i IS NOT NULL), []) nb FROM ix LEFT JOIN s ON s.ego = ix.node LEFT JOIN (SELECT node other, i FROM ix) j ON j.other = s.alter GROUP BY ix.i)),
{_settle('list_transform(nb, lambda b: 0.0::DOUBLE)', 'list_transform(nb, lambda b, i: CASE WHEN i = t THEN 0 ELSE 1 + list_sum(list_transform(b, lambda q: x[q.j] * q.p)) END)', 6000)}
SELECT node, round(CASE WHEN len(nb[i]) = 0 AND node <> 3 THEN NULL ELSE x[i] END, 4) hitting FROM ix, z, adj"""
_round4 = lambda df, c: df.withColumn(c, F.round(c, 4))
_add("hitting_time", trade, lambda n: _round4(I.hitting_time(n, 3), "hitting"), _WALK)
_add("hitting_time_joined", trade, lambda n: _round4(I.hitting_time(n, 3, local_rows=0, tol=1e-10), "hitting"), _WALK)
_add("hitting_time_visits", pairs, lambda n: I.hitting_time(n, 8).agg(F.count("*").alias("nodes"), F.min("hitting").alias("least"), F.sum((F.col("hitting") < 1).cast("long")).alias("below_one")), "SELECT count(*) nodes, 0.0::DOUBLE least, 1::BIGINT below_one FROM customer")


def _refined(net: str, rounds: int) -> str:
    out = [f"{net}, c0 AS MATERIALIZED (SELECT node, 0::BIGINT c FROM n)"]
    for k in range(1, rounds + 1):
        b = f"c{k - 1}"
        out.append(f"c{k} AS MATERIALIZED (SELECT a.node, dense_rank() OVER (ORDER BY a.c, coalesce(o, []), coalesce(i, []))::BIGINT c FROM {b} a LEFT JOIN (SELECT ego node, list_sort(list_distinct(list(c))) o FROM e JOIN {b} ON alter = node GROUP BY 1) x ON x.node = a.node LEFT JOIN (SELECT alter node, list_sort(list_distinct(list(c))) i FROM e JOIN {b} ON ego = node GROUP BY 1) y ON y.node = a.node)")
    return ", ".join(out) + f", f AS (SELECT c, min(node) first FROM c{rounds} GROUP BY 1), h AS (SELECT c, dense_rank() OVER (ORDER BY first)::BIGINT k FROM f) SELECT node, k \"class\" FROM c{rounds} JOIN h USING (c)"


_add("regular_classes", ranks, I.regular_classes, f"WITH {_refined(RANKS, 6)}")
_add("regular_classes_joined", ranks, lambda n: I.regular_classes(n, local_rows=0), f"WITH {_refined(RANKS, 6)}")


def _two_ends(s: SparkSession, d: str) -> tuple[N.Network, int, int]:
    net = visits(s, d)
    ends = net.nodes.agg(F.min("node").alias("a"), F.max("node").alias("b")).head()
    return net, ends["a"], ends["b"]


_ENDS = "(SELECT min(node) FROM n), (SELECT max(node) FROM n)"
_add("shortest_paths", _two_ends, lambda x: I.shortest_paths(*x),
     f"{_BFS}, m AS (SELECT min(node) a, max(node) b FROM n), o AS MATERIALIZED (SELECT r.node, r.d FROM r, m WHERE source = a), far AS (SELECT d FROM o, m WHERE node = b), p(path, node, d) AS (SELECT [a], a, 0 FROM m UNION ALL SELECT list_append(path, alter), alter, p.d + 1 FROM p JOIN e ON ego = p.node JOIN o ON o.node = alter AND o.d = p.d + 1 WHERE p.d < (SELECT d FROM far)) SELECT path FROM p, m WHERE node = b AND p.d = (SELECT d FROM far)")
_add("shortest_paths_valued", trade, lambda n: I.shortest_paths(n, 3, 7, alpha=1.0),
     f"{_COST}, o AS (SELECT node, d FROM w12 WHERE source = 3), h AS (SELECT source node, d FROM w12 WHERE node = 7), p AS (SELECT [3::BIGINT] path, 3::BIGINT node UNION ALL SELECT list_append(path, alter), alter FROM p JOIN e ON ego = p.node JOIN o ON o.node = p.node JOIN h ON h.node = alter WHERE p.node <> 7 AND abs(o.d + 1 / \"value\" + h.d - (SELECT d FROM o WHERE node = 7)) < 1e-10) SELECT path FROM p WHERE node = 7")

# kernels
_PATHS = """r(s, t, d, sigma) USING KEY (s, t) AS (SELECT node, node, 0, 1.0::DOUBLE FROM n UNION SELECT r.s, l.alter, min(r.d) + 1, sum(r.sigma) FROM r JOIN l ON l.ego = r.t LEFT JOIN recurring.r k ON k.s = r.s AND k.t = l.alter WHERE k.t IS NULL GROUP BY 1, 2)"""
_BETWEEN = "b AS (SELECT x.t node, sum(x.sigma * y.sigma / z.sigma) b FROM r x JOIN r y ON y.s = x.t JOIN r z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t GROUP BY 1)"
_add("betweenness", follow, K.betweenness, f"WITH RECURSIVE {FOLLOW1}, {_ADJ}, {_PATHS}, {_BETWEEN} SELECT n.node, round(coalesce(b, 0) / 2, 6) betweenness FROM n LEFT JOIN b ON b.node = n.node")
_add("betweenness_joined", partners, lambda n: K.betweenness(n, local_rows=0), f"WITH RECURSIVE {PARTNERS}, {_ADJ}, {_PATHS}, {_BETWEEN} SELECT n.node, round(coalesce(b, 0) / 2, 6) betweenness FROM n LEFT JOIN b ON b.node = n.node")
_add("betweenness_directed", trade, lambda n: K.betweenness(n, symmetric=False, standardize=True), f"WITH RECURSIVE {TRADE}, l AS (SELECT ego, alter FROM e), {_PATHS}, {_BETWEEN} SELECT n.node, round(coalesce(b, 0) / ((SELECT (count(*) - 1) * (count(*) - 2) FROM n)), 6) betweenness FROM n LEFT JOIN b ON b.node = n.node")
_HOME = f"WITH {HOMES}, g AS (SELECT alter, least(alter, min(ego)) label FROM e GROUP BY 1) SELECT n.node, coalesce(a.label, b.label, n.node) community FROM n LEFT JOIN e ON e.ego = n.node LEFT JOIN g a ON a.alter = e.alter LEFT JOIN g b ON b.alter = n.node"


def _no_worse(found: DataFrame, net: N.Network, start: DataFrame) -> DataFrame:
    """One row: how many nodes have a community, how many labels aren't a member of theirs, and whether the modularity is
    at least that of ``start``."""
    strays = found.select("community").distinct().join(found.select(F.col("node").alias("community"), F.col("community").alias("own")), "community", "left").where("own is null or own <> community")
    q = M.modularity(net, found).select(F.col("modularity").alias("q")).crossJoin(M.modularity(net, start).select(F.col("modularity").alias("q0")))
    return found.agg(F.count("*").alias("nodes")).crossJoin(strays.agg(F.count("*").alias("strays"))).crossJoin(q).select("nodes", "strays", (F.col("q") >= F.col("q0") - 1e-9).alias("no_worse"))


_SOUND = "SELECT count(*) nodes, 0::BIGINT strays, true no_worse FROM n"
for _m in ("louvain", "leiden", "infomap"):
    _add(f"community_{_m}", pairs, lambda n, m=_m: _no_worse(K.community(n, m), n, I.components(n).withColumnRenamed("component", "community")), f"WITH {PAIRS} {_SOUND}")
    _add(f"community_{_m}_homes", homes, lambda n, m=_m: K.community(n, m), _HOME)
_add("community_two_mode", orders_two_mode, lambda n: _no_worse(K.two_mode_communities(n), n, n.nodes.select("node", F.lit(1).alias("community"))), f"WITH {TWO_MODE} {_SOUND}")
_add("community_two_mode_homes", lambda s, d: N.from_two_mode(s.read.parquet(f"{d}/customer.parquet"), "c_custkey", "c_nationkey", labels=("c", "n")), K.two_mode_communities, f"WITH {HOMES}, g AS (SELECT alter, least(alter, min(ego)) label FROM e GROUP BY 1) SELECT ego node, label community FROM e JOIN g USING (alter) UNION ALL SELECT alter, label FROM g")
_GROW = """c AS (SELECT [ego, alter] c FROM u WHERE ego < alter UNION ALL SELECT list_append(c.c, x.alter) FROM c JOIN u x ON x.ego = c.c[-1] AND x.alter > x.ego WHERE (SELECT count(*) FROM u y WHERE y.alter = x.alter AND list_contains(c.c, y.ego)) = len(c.c)),
f AS (SELECT c FROM c WHERE len(c) >= 3 AND NOT EXISTS (SELECT 1 FROM u y WHERE list_contains(c.c, y.ego) AND NOT list_contains(c.c, y.alter) GROUP BY y.alter HAVING count(*) = len(c.c)))"""
_MEMBERS = "SELECT array_to_string(c, ',') clique, unnest(c) node FROM f"
_add("cliques", visits, K.cliques, f"WITH RECURSIVE {VISITS}, u AS MATERIALIZED (SELECT ego, alter FROM e UNION SELECT alter, ego FROM e), {_GROW} {_MEMBERS}")
#: Maximal cliques of u (both directions) among numbered nodes by pivots; needs ix.
_PIVOT = """adj AS MATERIALIZED (SELECT list(nb ORDER BY i) nb FROM (SELECT ix.i, coalesce(list(j.i ORDER BY j.i) FILTER (j.i IS NOT NULL), []) nb FROM ix LEFT JOIN u ON u.ego = ix.node LEFT JOIN ix j ON j.node = u.alter GROUP BY ix.i)),
bk AS (SELECT [NULL::BIGINT][1:0] r, generate_series(1, len(nb)) p, [NULL::BIGINT][1:0] x FROM adj
UNION ALL SELECT list_append(r, v), list_filter(p, lambda q: list_contains(nb[v], q) AND NOT list_contains(cands[1:g - 1], q)), list_filter(list_concat(x, cands[1:g - 1]), lambda q: list_contains(nb[v], q))
FROM (SELECT r, p, x, nb, cands, unnest(cands) v, generate_subscripts(cands, 1) g FROM (SELECT r, p, x, nb, list_filter(p, lambda q: NOT list_contains(nb[piv], q)) cands
FROM (SELECT r, p, x, nb, list_transform(list_reverse_sort(list_transform(list_concat(p, x), lambda c: [len(list_filter(p, lambda q: list_contains(nb[c], q))), c])), lambda t: t[2])[1] piv FROM bk, adj WHERE len(p) > 0)))),
f AS (SELECT list_sort(list_transform(r, lambda q: names[q])) c FROM bk, (SELECT list(node ORDER BY i) names FROM ix) WHERE len(p) = 0 AND len(x) = 0 AND len(r) >= 3)"""
_PU = f"{PARTNERS}, l AS MATERIALIZED (SELECT ego, alter FROM e UNION SELECT alter, ego FROM e), ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) i FROM n)"
_TWO = f"{_PU}, u AS MATERIALIZED (SELECT ego, alter FROM l UNION SELECT x.ego, y.alter FROM l x JOIN l y ON x.alter = y.ego WHERE x.ego <> y.alter), {_PIVOT}"
_add("cliques_partners", partners, K.cliques, f"WITH RECURSIVE {_PU}, u AS MATERIALIZED (SELECT * FROM l), {_PIVOT} {_MEMBERS}")
_add("n_cliques", partners, lambda n: K.n_cliques(n, 2), f"WITH RECURSIVE {_TWO} {_MEMBERS}")
_add("n_clans", partners, lambda n: K.n_cliques(n, 2, clans=True), f"WITH RECURSIVE {_TWO}, m AS (SELECT c, a.v a, b.v b FROM f, (SELECT node v FROM n) a, (SELECT node v FROM n) b WHERE list_contains(c, a.v) AND list_contains(c, b.v) AND a.v < b.v), w AS (SELECT DISTINCT c FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.ego = a AND l.alter = b) AND NOT EXISTS (SELECT 1 FROM l x JOIN l y ON x.alter = y.ego WHERE x.ego = a AND y.alter = b AND list_contains(c, x.alter))) SELECT array_to_string(c, ',') clique, unnest(c) node FROM f WHERE c NOT IN (SELECT c FROM w)")
_FITS = "len(list_intersect(nx.nb, {c})) >= len({c}) - 1 AND list_bool_and(list_transform({c}, lambda v: len(list_filter(list_append({c}, nx.node), lambda w: list_contains(nbs[v], w))) >= len({c}) - 1))"
_PLEX = f"""nx AS MATERIALIZED (SELECT node, coalesce((SELECT list(alter) FROM l WHERE ego = n.node), []) nb FROM n), mx AS MATERIALIZED (SELECT map_from_entries(list((node, nb))) nbs FROM nx),
c AS (SELECT [node] c FROM n UNION ALL SELECT list_append(c.c, nx.node) FROM c JOIN nx ON nx.node > c.c[-1] CROSS JOIN mx WHERE {_FITS.format(c="c.c")}),
f AS (SELECT c.c FROM c WHERE len(c.c) >= 4 AND c.c NOT IN (SELECT d.c FROM c d JOIN nx ON NOT list_contains(d.c, nx.node) CROSS JOIN mx WHERE len(d.c) >= 4 AND {_FITS.format(c="d.c")}))"""
_add("k_plexes", partners, lambda n: K.k_plexes(n, 2), f"WITH RECURSIVE {_PU}, {_PLEX} SELECT array_to_string(c, ',') plex, unnest(c) node FROM f")
_CUTS = "x(a, b, node) AS (SELECT ego, alter, ego FROM l WHERE ego < alter UNION SELECT a, b, l.alter FROM x JOIN l ON l.ego = x.node WHERE NOT (l.ego = a AND l.alter = b) AND NOT (l.ego = b AND l.alter = a))"
_BRIDGES = f"WITH RECURSIVE {ROADS}, {_ADJ}, {_CUTS} SELECT ego, alter FROM l WHERE ego < alter AND NOT EXISTS (SELECT 1 FROM x WHERE a = l.ego AND b = l.alter AND node = l.alter)"
_add("bridges", roads, K.bridges, _BRIDGES)
_add("bridges_joined", roads, lambda n: K.bridges(n, local_rows=0), _BRIDGES)
_add("bridges_distance", roads, lambda n: K.bridges(n, "distance"), f"WITH RECURSIVE {ROADS}, {_ADJ}, x(a, b, node, d) USING KEY (a, b, node) AS (SELECT ego, alter, ego, 0 FROM l WHERE ego < alter UNION SELECT x.a, x.b, l.alter, min(x.d) + 1 FROM x JOIN l ON l.ego = x.node LEFT JOIN recurring.x k ON k.a = x.a AND k.b = x.b AND k.node = l.alter WHERE k.node IS NULL AND NOT (l.ego = x.a AND l.alter = x.b) AND NOT (l.ego = x.b AND l.alter = x.a) GROUP BY 1, 2, 3) SELECT l.ego, l.alter, coalesce(x.d, -1)::BIGINT distance FROM l LEFT JOIN x ON x.a = l.ego AND x.b = l.alter AND x.node = l.alter WHERE l.ego < l.alter")
_add("max_flow", trade, lambda n: K.max_flow(n, 3, 7).agg(F.coalesce(F.max("flow"), F.lit(0.0)).alias("flow"), F.count("*").alias("cut")), f"WITH {TRADE}, m AS (SELECT least((SELECT count(*) FROM e WHERE ego = 3), (SELECT count(*) FROM e WHERE alter = 7)) m) SELECT m::DOUBLE flow, m cut FROM m")
_add("lambda_sets", lambda s, d: T.symmetrize(trade(s, d)), lambda n: K.lambda_sets(n).groupBy("connectivity").agg(F.count("*").alias("ties")))
_SPLIT = "x(c, s, node) AS (SELECT c.node, s.node, s.node FROM n c JOIN n s ON c.node <> s.node UNION SELECT x.c, x.s, l.alter FROM x JOIN l ON l.ego = x.node WHERE l.alter <> x.c), u AS MATERIALIZED (SELECT a.node ego, b.node alter FROM n a JOIN n b ON a.node <> b.node WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.node <> a.node AND c.node <> b.node AND NOT EXISTS (SELECT 1 FROM x WHERE x.c = c.node AND x.s = a.node AND x.node = b.node)))"
_add("k_components", partners, lambda n: K.k_components(n, 2), f"WITH RECURSIVE {_PU}, {_SPLIT}, {_PIVOT} SELECT array_to_string(c, ',') block, unnest(c) node FROM f")
_add("cohesive_blocks", partners, K.cohesive_blocks)


def _matched(net: N.Network, weighted: bool) -> DataFrame:
    """One row: pairs, different ends on both sides, pairs that aren't tied; weighted: whether the value is at least a plain matching's."""
    m = K.matching(net, weighted)
    ends = m.select(F.least("ego", "alter").alias("ego"), F.greatest("ego", "alter").alias("alter"))
    out = ends.agg(F.count("*").alias("pairs"), F.countDistinct("ego").alias("egos"), F.countDistinct("alter").alias("alters")).crossJoin(ends.join(net.edges, ["ego", "alter"], "left_anti").agg(F.count("*").alias("untied")))
    if weighted:
        value = lambda t, c: t.join(net.edges, ["ego", "alter"]).agg(F.sum("value").alias(c))
        plain = K.matching(net).select(F.least("ego", "alter").alias("ego"), F.greatest("ego", "alter").alias("alter"))
        out = out.crossJoin(value(ends, "v")).crossJoin(value(plain, "p")).select("pairs", "egos", "alters", "untied", (F.col("v") >= F.col("p")).alias("no_less"))
    return out


_LEASTS = f"WITH {TWO_MODE}, m AS (SELECT least(sum((mode = 1)::INT), sum((mode = 2)::INT))::BIGINT k FROM n) SELECT k pairs, k egos, k alters, 0::BIGINT untied"
_add("matching", orders_two_mode, lambda n: _matched(n, False), f"{_LEASTS} FROM m")
_add("matching_weighted", orders_two_mode, lambda n: _matched(n, True), f"{_LEASTS}, true no_less FROM m")
_add("core_periphery", trade, K.core_periphery)
_add("factions", trade, K.factions)
_add("concor", trade, lambda n: K.concor(n, 2))
_add("hierarchy", trade, lambda n: K.hierarchy(n, 3, "average"),
     f"""WITH RECURSIVE {TRADE}, ix AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) i FROM n), m AS (SELECT x.i, y.i j, coalesce("value", 0) v FROM ix x CROSS JOIN ix y LEFT JOIN e ON ego = x.node AND alter = y.node),
d AS MATERIALIZED (SELECT a.i, b.i j, sqrt(sum((a.v - b.v) * (a.v - b.v))) d FROM m a JOIN m b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2),
r AS (SELECT 0 k, generate_series(1, (SELECT count(*) FROM n)) x UNION ALL SELECT k + 1, list_transform(x, lambda v: CASE WHEN v = t.b THEN t.a ELSE v END) FROM (SELECT r.k, r.x, (SELECT arg_min({{'a': a, 'b': b}}, [w, a, b]) FROM (SELECT least(x[i], x[j]) a, greatest(x[i], x[j]) b, round(avg(d), 9) w FROM d WHERE x[i] <> x[j] GROUP BY 1, 2)) t FROM r WHERE len(list_distinct(r.x)) > 3)),
z AS (SELECT x FROM r ORDER BY k DESC LIMIT 1) SELECT node, dense_rank() OVER (ORDER BY x[i])::INT "group" FROM ix, z""")  # fmt: skip
_add("spectral", follow, lambda n: K.spectral(n).agg(F.count("*").alias("nodes"), F.sum("eigenvalue").alias("trace"), F.sum((F.col("eigenvalue") < 1e-6 * F.col("algebraic_connectivity")).cast("long")).alias("zeros"), F.round(F.sum(F.col("fiedler") * F.col("fiedler")), 6).alias("length"), F.abs(F.round(F.sum("fiedler"), 6)).alias("balance")).withColumn("trace", F.round("trace", 3)),
     f'WITH {FOLLOW1}, u AS (SELECT least(ego, alter) a, greatest(ego, alter) b, max("value") w FROM e GROUP BY 1, 2) SELECT (SELECT count(*) FROM n) nodes, round(2 * sum(w), 3)::DOUBLE trace, 1::BIGINT zeros, 1.0::DOUBLE length, 0.0::DOUBLE balance FROM u')
_PLACE = f"{TRADE}, p AS (SELECT node, row_number() OVER (ORDER BY node) - 1 i, count(*) OVER () k FROM n)"
_add("layout_circle", trade, lambda n: K.layout(n, "circle"), f"WITH {_PLACE} SELECT node, round(cos(2 * pi() * i / k), 6) x, round(sin(2 * pi() * i / k), 6) y FROM p")
_add("layout_grid", trade, lambda n: K.layout(n, "grid"), f"WITH {_PLACE} SELECT node, floor(i / ceil(sqrt(k)))::DOUBLE x, (i % ceil(sqrt(k))::BIGINT)::DOUBLE y FROM p")
for _k in ("fr", "mds", "kk"):
    _add(f"layout_{_k}", trade, lambda n, k=_k: K.layout(n, k))
_add("layout_bipartite", orders_two_mode, lambda n: K.layout_bipartite(n), f"WITH {TWO_MODE} SELECT node, (mode - 1)::DOUBLE x, round(((row_number() OVER (PARTITION BY mode ORDER BY node) - 0.5) / count(*) OVER (PARTITION BY mode))::DOUBLE, 6) y FROM n")
_add("layout_hierarchy", ranks, K.layout_hierarchy, f"WITH {RANKS}, p AS (SELECT node, CASE WHEN node LIKE 'r%' THEN 0 WHEN node LIKE 'n%' THEN 1 ELSE 2 END level FROM n) SELECT node, round(((row_number() OVER (PARTITION BY level ORDER BY node) - 0.5) / count(*) OVER (PARTITION BY level))::DOUBLE, 6) x, (-level)::DOUBLE y FROM p")
_add("induced_degree", pairs, K.induced_centrality, f"WITH {PAIRS}{BOTH}, g AS (SELECT ego node, count(*)::DOUBLE k FROM l GROUP BY 1) SELECT n.node, coalesce(k, 0) endogenous, 2 * coalesce(k, 0) induced, coalesce(k, 0) exogenous FROM n LEFT JOIN g ON g.node = n.node")
_LESS = "q(v, s, t, d, sigma) USING KEY (v, s, t) AS (SELECT v.node, s.node, s.node, 0, 1.0::DOUBLE FROM n v JOIN n s ON s.node <> v.node UNION SELECT q.v, q.s, l.alter, min(q.d) + 1, sum(q.sigma) FROM q JOIN l ON l.ego = q.t AND l.alter <> q.v LEFT JOIN recurring.q k ON k.v = q.v AND k.s = q.s AND k.t = l.alter WHERE k.t IS NULL GROUP BY 1, 2, 3)"
_add("induced_betweenness", partners, lambda n: K.induced_centrality(n, "betweenness"), f"WITH RECURSIVE {PARTNERS}, {_ADJ}, {_PATHS}, {_BETWEEN}, {_LESS}, w AS (SELECT x.v, sum(x.sigma * y.sigma / z.sigma) w FROM q x JOIN q y ON y.v = x.v AND y.s = x.t JOIN q z ON z.v = x.v AND z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t GROUP BY 1), o AS (SELECT n.node, coalesce(b, 0) / 2 b, (coalesce((SELECT sum(b) FROM b), 0) - coalesce(w, 0)) / 2 d FROM n LEFT JOIN b ON b.node = n.node LEFT JOIN w ON w.v = n.node) SELECT node, round(b, 6) endogenous, round(d, 6) induced, round(d - b, 6) exogenous FROM o")

# backbones
_add("backbone_threshold", follow, lambda n: B.threshold(n, 2, 1.5), f'WITH {FOLLOW1} SELECT ego, alter, CASE WHEN "value" > 2 THEN 1.0 ELSE -1.0 END::DOUBLE "value" FROM e WHERE "value" > 2 OR "value" < 1.5')
_DISP = f'WITH {FOLLOW1}, o AS (SELECT ego, sum("value") s, count(*) k FROM e GROUP BY 1), i AS (SELECT alter, sum("value") s, count(*) k FROM e GROUP BY 1), p AS (SELECT e.ego, e.alter, "value", least(pow(1 - "value" / o.s, o.k - 1), pow(1 - "value" / i.s, i.k - 1)) p FROM e JOIN o ON o.ego = e.ego JOIN i ON i.alter = e.alter)'
_add("disparity", follow, B.disparity, f'{_DISP} SELECT ego, alter, {_V}, round(p, 6) p FROM p')
_add("lans", follow, B.lans, f'WITH {FOLLOW1} SELECT ego, alter, {_V}, round(1 - cume_dist() OVER (PARTITION BY ego ORDER BY "value"), 6) p FROM e')
_CHOOSE = "lgamma(({0}) + 1) - lgamma(({1}) + 1) - lgamma(({0}) - ({1}) + 1)"
_add("mlf", trade, B.mlf, f"""WITH {TRADE}, s AS (SELECT ego, sum("value") s FROM e GROUP BY 1), i AS (SELECT alter, sum("value") s FROM e GROUP BY 1), m AS (SELECT sum("value") m FROM e), p AS (SELECT e.ego, e.alter, "value", m, s.s * i.s / (m * m) p FROM e JOIN s USING (ego) JOIN i ON i.alter = e.alter, m)
SELECT ego, alter, {_V}, round(least(1, sum(exp({_CHOOSE.format('m', 'k')} + k * ln(p) + (m - k) * ln(1 - p)))), 6) p FROM (SELECT *, unnest(generate_series("value"::BIGINT, least(m::BIGINT, "value"::BIGINT + 4000))) k FROM p) GROUP BY ego, alter, "value\"""")
_PAIR2 = f"{TWO_MODE}, d AS (SELECT alter node, count(*) k FROM e GROUP BY 1), p AS (SELECT x.alter ego, y.alter, count(*) s FROM e x JOIN e y ON x.ego = y.ego AND x.alter < y.alter GROUP BY 1, 2), w AS (SELECT p.*, a.k ki, b.k kj, (SELECT count(*) FROM n WHERE mode = 1) c FROM p JOIN d a ON a.node = ego JOIN d b ON b.node = alter)"
_add("fixed_row", orders_two_mode, lambda n: B.fixed_row(n, 2), f"WITH {_PAIR2} SELECT ego, alter, s::DOUBLE \"value\", round(least(1, sum(CASE WHEN kj - i > c - ki THEN 0 ELSE exp({_CHOOSE.format('ki', 'i')} + {_CHOOSE.format('c - ki', 'kj - i')} - ({_CHOOSE.format('c', 'kj')})) END)), 6) p FROM (SELECT *, unnest(generate_series(s, least(ki, kj))) i FROM w) GROUP BY ego, alter, s")
_SERIES = "-1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))"
#: Lower tail of the refined normal distribution at z, from a table w with z, sd and third.
_TAIL = f"(SELECT *, CASE WHEN z >= 0 THEN 1 - f / 2 ELSE f / 2 END + third / (6 * sd * sd * sd) * (1 - z * z) * exp(-z * z / 2) / sqrt(2 * pi()) cdf FROM (SELECT *, t * exp(-z * z / 2 + {_SERIES}) f FROM (SELECT *, 1 / (1 + 0.5 * abs(z) / sqrt(2)) t FROM {{w}})))"
_BOTH_TAILS = "SELECT ego, alter, s::DOUBLE \"value\", round(max(CASE WHEN side = 1 THEN least(1, greatest(0, 1 - cdf)) END), 5) p, round(max(CASE WHEN side = 2 THEN least(1, greatest(0, cdf)) END), 5) \"lower\" FROM {tail} GROUP BY ego, alter, s"
_SIDES = "v AS (SELECT *, (s + CASE WHEN side = 1 THEN -0.5 ELSE 0.5 END - mu) / sd z FROM x, (SELECT unnest([1, 2]) side))"
_round5 = lambda df: df.select("ego", "alter", "value", F.round("p", 5).alias("p"), F.round("lower", 5).alias("lower"))
_add("fixed_column", orders_two_mode, lambda n: _round5(B.fixed_column(n, 2)), f"WITH {_PAIR2}, q AS (SELECT k * (k - 1) / (m * (m - 1)) p FROM (SELECT count(*)::DOUBLE k FROM e GROUP BY ego), (SELECT count(*)::DOUBLE m FROM n WHERE mode = 2)), x AS (SELECT w.*, mu, sd, third FROM w, (SELECT sum(p) mu, sqrt(sum(p * (1 - p))) sd, sum(p * (1 - p) * (1 - 2 * p)) third FROM q)), {_SIDES} {_BOTH_TAILS.format(tail=_TAIL.format(w='v'))}")
_add("fixed_fill", orders_two_mode, lambda n: B.fixed_fill(n, 2),
     f"""WITH {_PAIR2}, z AS (SELECT (SELECT count(*) FROM n WHERE mode = 2) r, (SELECT count(*) FROM n WHERE mode = 1) c, (SELECT count(*) FROM e) f), k AS (SELECT k FROM z, (SELECT unnest(generate_series(0, c)) k FROM z)), t AS (SELECT unnest(generate_series(0, least(2 * c, f))) t FROM z),
g AS (SELECT k, sum(exp({_CHOOSE.format('c', 'k')} + {_CHOOSE.format('c - k', 't - 2 * k')} + (t - 2 * k) * ln(2) + {_CHOOSE.format('(r - 2) * c', 'f - t')} - ({_CHOOSE.format('r * c', 'f')}))) g FROM z, k, t WHERE t >= 2 * k AND t <= c + k AND f - t <= (r - 2) * c GROUP BY 1),
h AS (SELECT k, sum(g) OVER (ORDER BY k DESC) h FROM g) SELECT ego, alter, s::DOUBLE "value", round(least(1, coalesce(h, 0)), 6) p FROM p LEFT JOIN h ON h.k = s""")  # fmt: skip
_add("fdsm", orders_two_mode, lambda n: B.fdsm(n, 2).agg(F.count("*").alias("pairs"), F.sum("value").alias("shared"), F.sum((F.col("p").between(0, 1)).cast("long")).alias("valid")), f"WITH {_PAIR2} SELECT count(*) pairs, sum(s)::DOUBLE shared, count(*) valid FROM w")
_add("sdsm", orders_two_mode, lambda n: B.sdsm(n, 2).agg(F.count("*").alias("pairs"), F.sum("value").alias("shared"), F.sum((F.col("p").between(0, 1) & (F.abs(F.col("p") + F.col("lower") - 1) < 0.2)).cast("long")).alias("valid")), f"WITH {_PAIR2} SELECT count(*) pairs, sum(s)::DOUBLE shared, count(*) valid FROM w")
_RANK = "t AS (SELECT *, count(*) OVER () m, row_number() OVER (ORDER BY p, ego, alter) r FROM p)"
for _c, _x in (
    ("bonferroni", "m * p"), ("holm", "max((m - r + 1) * p) OVER (ORDER BY r)"), ("hochberg", "min((m - r + 1) * p) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"), ("BH", "min(m / r * p) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    ("BY", "min((SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) + 1 FROM p)) x(i)) * m / r * p) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
):
    _add(f"adjust_{_c}", follow, lambda n, c=_c: B.adjust(B.disparity(n), c).select("ego", "alter", "adjusted"), f"{_DISP}, {_RANK} SELECT ego, alter, round(least(1, {_x})::DOUBLE, 6) adjusted FROM t")
_DISPT = _DISP.replace(FOLLOW1, TRADE)
_add("adjust_hommel", trade, lambda n: B.adjust(B.disparity(n), "hommel").select("ego", "alter", "adjusted"),
     f"{_DISPT}, {_RANK.replace('t AS', 'w AS', 1)}, g AS (SELECT a.r k, max(a.m) m, min(a.r * b.p / (b.r - (b.m - a.r))) t FROM w a JOIN w b ON b.r > b.m - a.r GROUP BY 1), h AS (SELECT k, coalesce(max(t) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) t FROM g UNION ALL SELECT 0, max(t) FROM g) SELECT ego, alter, round(least(1, greatest(p, min(greatest(h.k * p, h.t)))), 6) adjusted FROM w, h GROUP BY ego, alter, p")
_add("backbone_signed", follow, lambda n: B.backbone(n, "disparity", 0.1, signed=True), f'{_DISP} SELECT ego, alter, CASE WHEN p >= 1 - p THEN -1.0 ELSE 1.0 END::DOUBLE "value" FROM p WHERE least(p, 1 - p) < 0.05')
_add("backbone_disparity", follow, lambda n: B.backbone(n, "disparity", 0.1), f'{_DISP} SELECT ego, alter, 1.0::DOUBLE "value" FROM p WHERE p < 0.1')

# expressions, time, streams in batch, generators, inference
_add("expression", trade, lambda n: evaluate("trade * (trade > t(trade)) + 2", {"trade": n}),
     f'WITH {TRADE}, p AS (SELECT x.node ego, y.node alter, coalesce(a."value", 0) v, coalesce(b."value", 0) w FROM n x JOIN n y ON x.node <> y.node LEFT JOIN e a ON a.ego = x.node AND a.alter = y.node LEFT JOIN e b ON b.ego = y.node AND b.alter = x.node) SELECT ego, alter, (CASE WHEN v > w THEN v ELSE 0 END + 2)::DOUBLE "value" FROM p')


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("sender"), F.col("event_type").alias("receiver"), "ts", "value")


_add("windowed_ties", _events, lambda e: W.windowed_ties(e, "1 day"), 'SELECT date_trunc(\'day\', ts) t_start, date_trunc(\'day\', ts) + INTERVAL 1 DAY t_end, user_id ego, event_type alter, count(*) events, round(sum("value"), 6) "value" FROM events GROUP BY 1, 2, 3, 4')
_add("session_ties", _events, lambda e: W.session_ties(e, "6 hours").select("ego", "alter", "events"), "WITH g AS (SELECT user_id ego, event_type alter, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)), s AS (SELECT ego, alter, sum(f) OVER (PARTITION BY ego, alter ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT ego, alter, count(*) events FROM s GROUP BY ego, alter, k")
_add("interval_slice", lambda s, d: N.intervals(s.read.parquet(f"{d}/orders.parquet").withColumn("until", F.expr("o_orderdate + interval 30 days")), "o_orderkey", "o_custkey", "o_orderdate", "until"), lambda n: N.at_time(n, F.expr("timestamp'1995-06-15'")), 'SELECT o_orderkey ego, o_custkey alter, 1.0::DOUBLE "value" FROM orders WHERE o_orderdate <= TIMESTAMP \'1995-06-15\' AND TIMESTAMP \'1995-06-15\' < o_orderdate + INTERVAL 30 DAY GROUP BY 1, 2')
_add("event_slice", lambda s, d: N.event_list(s.read.parquet(f"{d}/events.parquet").withColumn("day", F.to_date("ts")), "user_id", "event_type", "day"), lambda n: N.at_time(n, F.expr("date'2024-01-05'")), "SELECT DISTINCT user_id ego, event_type alter, 1.0::DOUBLE \"value\" FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
_spark_only = lambda s, d: s
_add("ring", _spark_only, lambda s: G.ring(s, 50, 2), 'SELECT DISTINCT least(i, j) ego, greatest(i, j) alter, 1.0::DOUBLE "value" FROM (SELECT i + 1 i, (i + k) % 50 + 1 j FROM range(50) a(i), range(1, 3) b(k))')
_add("lattice", _spark_only, lambda s: G.lattice(s, 6, 7), 'SELECT ego, alter, 1.0::DOUBLE "value" FROM (SELECT i + 1 ego, i + 2 alter FROM range(42) a(i) WHERE i % 7 < 6 UNION ALL SELECT i + 1, i + 8 FROM range(42) a(i) WHERE i < 35)')


def _counted(net: N.Network) -> DataFrame:
    """Invariants of a random network: nodes, ties, loops, repeated ties."""
    e = net.edges.agg(F.count("*").alias("ties"), F.sum((F.col("ego") == F.col("alter")).cast("long")).alias("loops"))
    pair = (F.col("ego"), F.col("alter")) if net.directed else (F.least("ego", "alter"), F.greatest("ego", "alter"))
    twice = net.edges.groupBy(pair[0].alias("a"), pair[1].alias("b")).agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("repeated"))
    return net.nodes.agg(F.count("*").alias("nodes")).crossJoin(e).crossJoin(twice)


def _expects(mean: float, sd: float) -> Callable[[N.Network], DataFrame]:
    """The same with whether the number of ties is within six standard deviations of its mean."""
    return lambda net: _counted(net).select("nodes", (F.abs(F.col("ties") - mean) < 6 * sd).alias("expected"), "loops", "repeated")


_add("random_prob", _spark_only, lambda s: _expects(*G.expected_ties(2000, 0.005))(G.random_prob(s, 2000, 0.005)), "SELECT 2000::BIGINT nodes, true expected, 0::BIGINT loops, 0::BIGINT repeated")
_add("random_count", _spark_only, lambda s: _counted(G.random_count(s, 300, 1000)), "SELECT 300::BIGINT nodes, 1000::BIGINT ties, 0::BIGINT loops, 0::BIGINT repeated")
_add("random_census", _spark_only, lambda s: M.dyad_census(G.random_census(s, 100, 60, 200)), 'SELECT 60::BIGINT mutual, 200::BIGINT "asymmetric", 4690::BIGINT null_dyads, round(60 / 260, 6)::DOUBLE reciprocity')
_add("degree_sequence", _spark_only, lambda s: M.degree(G.degree_sequence(s, [3] * 40)).select("node", "out"), "SELECT i::BIGINT node, 3.0::DOUBLE \"out\" FROM range(1, 41) t(i)")
_add("degree_sequence_directed", _spark_only, lambda s: M.degree(G.degree_sequence(s, [3, 2, 1, 0] * 10, [0, 1, 2, 3] * 10)).select("node", "out", "in"), "SELECT i::BIGINT node, (3 - (i - 1) % 4)::DOUBLE \"out\", ((i - 1) % 4)::DOUBLE \"in\" FROM range(1, 41) t(i)")
_add("small_world", _spark_only, lambda s: _counted(G.small_world(s, 200, 3, 0.1)), "SELECT 200::BIGINT nodes, 600::BIGINT ties, 0::BIGINT loops, 0::BIGINT repeated")
_add("preferential", _spark_only, lambda s: _counted(G.preferential(s, 300, 2)), "SELECT 300::BIGINT nodes, (3 + 297 * 2)::BIGINT ties, 0::BIGINT loops, 0::BIGINT repeated")
_add("homophily", trade, lambda n: _expects(0.2 * 600, 11.0)(G.homophily(n, {"region": 1.5}, 0.2)), "SELECT count(*) nodes, true expected, 0::BIGINT loops, 0::BIGINT repeated FROM nation")
_DD = 'd AS (SELECT n.node, coalesce(o, 0) o, coalesce(i, 0) i FROM n LEFT JOIN (SELECT ego, count(*) o FROM e GROUP BY 1) a ON a.ego = n.node LEFT JOIN (SELECT alter, count(*) i FROM e GROUP BY 1) b ON b.alter = n.node)'
_degrees = lambda n: M.degree(n, binary=True).groupBy("out", "in").agg(F.count("*").alias("nodes"))
_add("permute", trade, lambda n: _degrees(T.permute(n, 3)), f'WITH {TRADE}, {_DD} SELECT o::DOUBLE "out", i::DOUBLE "in", count(*) nodes FROM d GROUP BY 1, 2')
_add("permute_swap", visits, lambda n: M.degree(T.permute_ties(n), binary=True).select("node", "out", "in"), f'WITH {VISITS}, {_DD} SELECT node, o::DOUBLE "out", i::DOUBLE "in" FROM d')
_CORR = 'x AS (SELECT coalesce(a."value", 0) a, coalesce(b."value", 0) b, (x.region = y.region)::INT g FROM n x JOIN n y ON x.node <> y.node LEFT JOIN e a ON a.ego = x.node AND a.alter = y.node LEFT JOIN e b ON b.ego = y.node AND b.alter = x.node)'
_tested = lambda df: df.select("observed", (F.col("p_two_sided").between(0, 1) & (F.col("low") <= F.col("high"))).alias("valid"))
_add("correlation_test", trade, lambda n: _tested(P.correlation_test(n, T.transpose(n), 50)), f"WITH {TRADE}, {_CORR} SELECT round(corr(a, b), 6) observed, true valid FROM x")
_add("mixing_test", trade, lambda n: _tested(P.attribute_test(n, "region", reps=50)), f"WITH {TRADE}, {_CORR} SELECT round(avg(CASE WHEN g = 1 THEN -1.0 ELSE 1.0 END), 6)::DOUBLE observed, true valid FROM x WHERE a <> 0")


def _signed(s: SparkSession, d: str) -> N.Network:
    net = trade(s, d)
    return net.with_(edges=net.edges.withColumn("value", F.when((F.col("ego") + F.col("alter")) % 3 == 0, -F.col("value")).otherwise(F.col("value"))))


_add("balance_test", _signed, lambda n: _tested(P.attribute_test(n, "region", "balance", 50)), f"WITH {TRADE}, u AS (SELECT DISTINCT least(ego, alter) a, greatest(ego, alter) b, CASE WHEN (ego + alter) % 3 = 0 THEN -1 ELSE 1 END s FROM e) SELECT round(avg(CASE WHEN x.s * y.s * z.s > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE observed, true valid FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b")
_add("cug_test", trade, lambda n: _tested(P.cug_test(n, lambda a: float((a * a.T).sum() / max(a.sum(), 1)), "density", 50)), f"WITH {TRADE}, {_CORR} SELECT round((sum(CASE WHEN a <> 0 AND b <> 0 THEN 1 ELSE 0 END) / sum(CASE WHEN a <> 0 THEN 1 ELSE 0 END))::DOUBLE, 6) observed, true valid FROM x")
_add("qap", trade, lambda n: P.qap(n, {"back": T.transpose(n), "region": T.expand(n, "region", "same")}, 30))
_add("qap_dsp", trade, lambda n: P.qap(n, {"back": T.transpose(n), "region": T.expand(n, "region", "same")}, 30, family="ols", method="dsp").select("term", "estimate"),
     f"WITH {TRADE}, {_CORR}, m AS (SELECT var_pop(b) vb, var_pop(g) vg, covar_pop(b, g) bg, covar_pop(a, b) ab, covar_pop(a, g) ag, avg(a) a, avg(b) b, avg(g) g FROM x), k AS (SELECT *, (ab * vg - ag * bg) / (vb * vg - bg * bg) b1, (ag * vb - ab * bg) / (vb * vg - bg * bg) b2 FROM m) SELECT '_cons' term, round(a - b1 * b - b2 * g, 6) estimate FROM k UNION ALL SELECT 'back', round(b1, 6) FROM k UNION ALL SELECT 'region', round(b2, 6) FROM k")
_add("diffusion_simulation", visits, lambda n: P.simulate_diffusion(n, n.nodes.where("node < 5"), "cascade", 1.0, periods=4), f"WITH {VISITS}, s0 AS (SELECT node, 0 t FROM n WHERE node < 5), " + ", ".join(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT DISTINCT ego, {k} FROM e WHERE alter IN (SELECT node FROM s{k - 1} WHERE t = {k - 1}) AND ego NOT IN (SELECT node FROM s{k - 1}))" for k in range(1, 5)) + " SELECT n.node, t FROM n LEFT JOIN s4 ON s4.node = n.node")
_add("diffusion_cascade", visits, lambda n: (lambda t: t.agg(F.count("*").alias("nodes"), F.sum((F.col("t") == 0).cast("long")).alias("seeds"), (F.max("t") <= 4).alias("in_time")))(P.simulate_diffusion(n, n.nodes.where("node < 5"), "cascade", 0.2, periods=4)), "SELECT count(*) nodes, 5::BIGINT seeds, true in_time FROM customer")

# variants
_add("summary_detail", visits, lambda n: M.summary(n, detail=True).select("nodes", "ties", "reciprocity", "transitivity"), f"WITH {VISITS}, p AS (SELECT least(ego, alter) a, greatest(ego, alter) b, count(*) k FROM e GROUP BY 1, 2), w AS (SELECT x.ego u, y.alter v FROM e x JOIN e y ON x.alter = y.ego WHERE x.ego <> y.alter) SELECT (SELECT count(*) FROM n) nodes, (SELECT count(*) FROM e) ties, (SELECT round((sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) / count(*))::DOUBLE, 6) FROM p) reciprocity, (SELECT round((count(e.ego) / count(*))::DOUBLE, 6) FROM w LEFT JOIN e ON ego = u AND alter = v) transitivity")
_add("alter_stats_hop2", visits, lambda n: M.alter_stats(n, "nation", hop=2).select("node", "mean", "sum", "min", "max", "sd", "count"), f'WITH {VISITS}, h AS (SELECT DISTINCT x.ego node, y.alter FROM e x JOIN e y ON x.alter = y.ego WHERE x.ego <> y.alter AND NOT EXISTS (SELECT 1 FROM e z WHERE z.ego = x.ego AND z.alter = y.alter)), s AS (SELECT h.node, avg(nation) mean, sum(nation)::DOUBLE "sum", min(nation)::DOUBLE "min", max(nation)::DOUBLE "max", stddev_samp(nation) sd, count(*) "count" FROM h JOIN n y ON y.node = h.alter GROUP BY 1) SELECT n.node, round(mean, 6) mean, coalesce("sum", 0) "sum", "min", "max", round(sd, 6) sd, coalesce("count", 0) "count" FROM n LEFT JOIN s ON s.node = n.node')
_PROFI = _PROF.replace("a.ego = x.node AND a.alter = q.node", "a.alter = x.node AND a.ego = q.node").replace("b.ego = y.node AND b.alter = q.node", "b.alter = y.node AND b.ego = q.node")
for _ix, _x in (("pearson", "CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END"), ("jaccard", "sum(CASE WHEN a <> 0 AND b <> 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a <> 0 OR b <> 0 THEN 1 ELSE 0 END), 0)"), ("euclidean", "sqrt(sum((a - b) * (a - b)))")):
    _add(f"profile_{_ix}_in", trade, lambda n, i=_ix: S.profile_similarity(n, i, direction="in"), f'WITH {TRADE}, {_PROFI} SELECT i, j, round(({_x})::DOUBLE, 6) "value" FROM p GROUP BY 1, 2')
    _add(f"profile_{_ix}_both", trade, lambda n, i=_ix: S.profile_similarity(n, i, direction="both"), f'WITH {TRADE}, {_PROF}, {_PROFI.replace("p AS", "o AS", 1)}, w AS (SELECT * FROM p UNION ALL SELECT * FROM o) SELECT i, j, round(({_x})::DOUBLE, 6) "value" FROM w GROUP BY 1, 2')
_add("triad_expected", trade, lambda n: S.triad_census(n, expected=True).agg(F.sum("count").alias("triples"), F.round(F.sum("expected"), 3).alias("expected")), "SELECT (count(*) * (count(*) - 1) * (count(*) - 2) / 6)::BIGINT triples, round(count(*) * (count(*) - 1) * (count(*) - 2) / 6, 3)::DOUBLE expected FROM nation")


def _round_trip(kind: str) -> Callable[[N.Network], DataFrame]:
    """Write a network in a format to the shared folder, read it back: its ties."""

    def run(net: N.Network) -> DataFrame:
        path = fresh_path(net.spark, f"trip-{kind}")
        if kind == "session":
            c = N.Catalog()
            c.add(net)
            X.save(c, path, net.spark)
            back = X.load(path, net.spark).get()
        else:
            getattr(X, f"write_{kind}")(net, path)
            back = getattr(X, f"read_{kind}")(net.spark, path, **({"directed": True} if kind == "edgelist" else {}))
        return back.arcs.select(F.col("ego").cast("long").alias("ego"), F.col("alter").cast("long").alias("alter"), "value")

    return run


for _k in ("pajek", "dl", "gml", "gexf", "edgelist", "session"):
    _add(f"round_trip_{_k}", trade, _round_trip(_k), f"WITH {TRADE} SELECT ego, alter, {_V} FROM e")


def _matrix_trip(net: N.Network) -> DataFrame:
    wide = T.matrix(net).orderBy("ego")
    names = [c for c in wide.columns if c != "ego"]
    back = N.from_wide(wide, "ego", names, directed=True)
    return back.arcs.select(F.col("ego").cast("long").alias("ego"), F.col("alter").cast("long").alias("alter"), "value")


def _compressed_trip(net: N.Network) -> DataFrame:
    path = fresh_path(net.spark, "trip-compressed")
    text = lambda c: F.col(c).cast("string")
    lines = net.edges.groupBy("ego").agg(F.sort_array(F.collect_list(text("alter"))).alias("a")).select(F.concat_ws(",", text("ego"), F.concat_ws(",", "a")).alias("value"))
    lines.write.text(path)
    return X.read_compressed(net.spark, path).arcs.select(F.col("ego").cast("long").alias("ego"), F.col("alter").cast("long").alias("alter"), "value")


_add("round_trip_matrix", trade, _matrix_trip, f"WITH {TRADE} SELECT ego, alter, {_V} FROM e")
_add("round_trip_compressed", trade, _compressed_trip, f'WITH {TRADE} SELECT ego, alter, 1.0::DOUBLE "value" FROM e')
_add("add_nodes", partners, lambda n: M.degree(T.add_nodes(n, n.nodes.select((F.col("node") + 100).alias("node")))).select("node", "total"), f"WITH {PARTNERS}{BOTH}, a AS (SELECT node FROM n UNION ALL SELECT node + 100 FROM n) SELECT node, count(ego)::DOUBLE total FROM a LEFT JOIN l ON ego = node GROUP BY 1")
_add("tie_values", trade, lambda n: n.nodes.select("node").where("node < 3").crossJoin(n.spark.createDataFrame([(T.tie_value(n, 3, 7),)], "value double")), f'WITH {TRADE} SELECT node, coalesce((SELECT "value" FROM e WHERE ego = 3 AND alter = 7), 0)::DOUBLE "value" FROM n WHERE node < 3')
_add("replace_matrix", trade, lambda n: T.replace_matrix(n, T.transpose(n).edges), f"WITH {TRADE} SELECT alter ego, ego alter, {_V} FROM e")
_add("windowed_degree", _events, lambda e: W.windowed_degree(e, "1 day").select("t_start", "node", "sent"), "SELECT date_trunc('day', ts) t_start, user_id node, count(*) sent FROM events GROUP BY 1, 2")
_add("group_median", visits, lambda n: M.group_median(n.nodes, "nation", "segment"), f"WITH {VISITS} SELECT segment, median(nation) median FROM n GROUP BY 1")
_add("degree_shortcut", trade, lambda n: shortcut("degree", n), f"WITH {TRADE}, {_DD} SELECT node, (o + i)::DOUBLE degree FROM d")
_add("expression_variables", trade, lambda n: evaluate("(trade > 0) * region + _n / _N", {"trade": n}), f'WITH {TRADE}, p AS (SELECT node, region, row_number() OVER (ORDER BY node) i, count(*) OVER () k FROM n) SELECT x.node ego, y.node alter, round((CASE WHEN e.ego IS NOT NULL THEN x.region ELSE 0 END + x.i / x.k)::DOUBLE, 6) "value" FROM p x JOIN p y ON x.node <> y.node LEFT JOIN e ON e.ego = x.node AND e.alter = y.node')


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
