"""Networks defined on the driver's tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiegraph.network import Network, from_two_mode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Network:
    """Nation of the customer to nation of the supplier: number of line items, if at least the mean of all pairs."""
    t = lambda n: table(spark, sf_dir, n)
    buyer = t("orders").join(t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "a")
    seller = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("a", "b").agg(F.count("*").cast("double").alias("v"))
    mean = pairs.agg(F.avg("v").alias("mean"))
    edges = pairs.crossJoin(F.broadcast(mean)).where("a <> b and v >= mean").select(F.col("a").alias("ego"), F.col("b").alias("alter"), F.col("v").alias("value"))
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("region"))
    return Network(nodes, edges, directed=True, name="trade")


TRADE = """t AS (SELECT c_nationkey::BIGINT a, s_nationkey::BIGINT b, count(*)::DOUBLE v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e AS (SELECT a ego, b alter, v "value" FROM t WHERE a <> b AND v >= (SELECT avg(v) FROM t)),
n AS (SELECT n_nationkey::BIGINT node, n_regionkey::BIGINT region FROM nation)"""


def follow(spark: SparkSession, sf_dir: str, least: int = 1) -> Network:
    """User to the user of the next event of the same day: how often, at least ``least`` times; attribute: mean value."""
    ev = table(spark, sf_dir, "events")
    nxt = F.lead("user_id").over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    edges = ev.select(F.col("user_id").alias("ego"), nxt.alias("alter")).where("ego <> alter").groupBy("ego", "alter").agg(F.count("*").cast("double").alias("value")).where(F.col("value") >= least)
    nodes = ev.groupBy(F.col("user_id").alias("node")).agg(F.count("*").cast("long").alias("events"), F.min("event_type").alias("first_type"))
    return Network(nodes, edges, directed=True, name="follow")


FOLLOW = """e AS (SELECT a ego, b alter, count(*)::DOUBLE "value" FROM (SELECT user_id a, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) b
FROM events) WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= {least}),
n AS (SELECT user_id node, count(*)::BIGINT events, min(event_type) first_type FROM events GROUP BY 1)"""


def visits(spark: SparkSession, sf_dir: str) -> Network:
    """Customer to the customer of the next order of the same day: how often. About ten ties a customer at every scale."""
    o = table(spark, sf_dir, "orders")
    nxt = F.lead("o_custkey").over(Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey"))
    edges = o.select(F.col("o_custkey").alias("ego"), nxt.alias("alter")).where("ego <> alter").groupBy("ego", "alter").agg(F.count("*").cast("double").alias("value"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    return Network(nodes, edges, directed=True, name="visits")


VISITS = """e AS (SELECT a ego, b alter, count(*)::DOUBLE "value" FROM (SELECT o_custkey a, lead(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) b
FROM orders) WHERE a <> b GROUP BY 1, 2),
n AS (SELECT c_custkey node, c_mktsegment segment, c_nationkey::BIGINT nation FROM customer)"""


def pairs(spark: SparkSession, sf_dir: str) -> Network:
    """The undirected network of ``visits``, the larger value of both directions."""
    from tiegraph.operators.transform import symmetrize

    return symmetrize(visits(spark, sf_dir))


PAIRS = VISITS.replace("e AS", "d AS", 1).replace("n AS", 'e AS (SELECT least(ego, alter) ego, greatest(ego, alter) alter, max("value") "value" FROM d GROUP BY 1, 2),\nn AS', 1)


def partners(spark: SparkSession, sf_dir: str) -> Network:
    """Nation to the three nations that it buys most from for their size (line items over all that nation sells); undirected."""
    t = lambda n: table(spark, sf_dir, n)
    buyer = t("orders").join(t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "a")
    seller = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    both = t("lineitem").select("l_orderkey", "l_suppkey").join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("a", "b").agg(F.count("*").alias("v"))
    sold = both.groupBy("b").agg(F.sum("v").alias("s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.col("v") / F.col("s")), "b"))
    top = both.join(sold, "b").where("a <> b").withColumn("r", rank).where("r <= 3")
    edges = top.groupBy(F.least("a", "b").alias("ego"), F.greatest("a", "b").alias("alter")).agg(F.lit(1.0).alias("value"))
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("region"))
    return Network(nodes, edges, directed=False, valued=False, name="partners")


PARTNERS = """t AS (SELECT c_nationkey::BIGINT a, s_nationkey::BIGINT b, count(*) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY v / s DESC, b) r FROM t JOIN (SELECT b, sum(v) s FROM t GROUP BY 1) USING (b) WHERE a <> b),
e AS (SELECT least(a, b) ego, greatest(a, b) alter, 1.0::DOUBLE "value" FROM k WHERE r <= 3 GROUP BY 1, 2),
n AS (SELECT n_nationkey::BIGINT node, n_regionkey::BIGINT region FROM nation)"""


def homes(spark: SparkSession, sf_dir: str) -> Network:
    """Customers tied to their nation: a star for each nation."""
    c = table(spark, sf_dir, "customer")
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = c.select(key("c", "c_custkey").alias("ego"), key("n", "c_nationkey").alias("alter"), F.lit(1.0).alias("value"))
    nodes = c.select(key("c", "c_custkey").alias("node")).union(table(spark, sf_dir, "nation").select(key("n", "n_nationkey")))
    return Network(nodes, edges, directed=False, valued=False, name="homes")


HOMES = """e AS (SELECT 'c' || c_custkey ego, 'n' || c_nationkey alter, 1.0::DOUBLE "value" FROM customer),
n AS (SELECT 'c' || c_custkey node FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation)"""


def roads(spark: SparkSession, sf_dir: str) -> Network:
    """``homes`` with each nation tied to the next of its region, the last to the first: a ring for each region."""
    home = homes(spark, sf_dir)
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    ring = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.coalesce(F.lead("n_nationkey").over(w), F.first("n_nationkey").over(w)).alias("b")).where("a <> b")
    key = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edges = ring.select(F.least(key(F.col("a")), key(F.col("b"))).alias("ego"), F.greatest(key(F.col("a")), key(F.col("b"))).alias("alter"), F.lit(1.0).alias("value")).distinct()
    return home.with_(edges=home.edges.unionByName(edges), name="roads")


ROADS = HOMES.replace("FROM customer),", """FROM customer
UNION ALL SELECT DISTINCT least('n' || a, 'n' || b), greatest('n' || a, 'n' || b), 1.0::DOUBLE FROM (SELECT n_nationkey a, coalesce(lead(n_nationkey) OVER w, first(n_nationkey) OVER w) b FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHERE a <> b),""", 1)


def ranks(spark: SparkSession, sf_dir: str) -> Network:
    """Region to nation to supplier: a directed hierarchy."""
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    edges = nation.select(key("r", "n_regionkey").alias("ego"), key("n", "n_nationkey").alias("alter")).union(supplier.select(key("n", "s_nationkey"), key("s", "s_suppkey"))).withColumn("value", F.lit(1.0))
    nodes = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node")).union(nation.select(key("n", "n_nationkey"))).union(supplier.select(key("s", "s_suppkey")))
    return Network(nodes, edges, directed=True, valued=False, name="ranks")


RANKS = """e AS (SELECT 'r' || n_regionkey ego, 'n' || n_nationkey alter, 1.0::DOUBLE "value" FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 1.0::DOUBLE FROM supplier),
n AS (SELECT 'r' || r_regionkey node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier)"""
#: Both directions of undirected ties.
BOTH = ', l AS (SELECT ego, alter, "value" FROM e UNION ALL SELECT alter, ego, "value" FROM e)'


def orders_two_mode(spark: SparkSession, sf_dir: str) -> Network:
    """Customers and the suppliers they bought from: number of line items."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    return from_two_mode(rows, "o_custkey", "l_suppkey", labels=("c", "s"), name="orders")


TWO_MODE = """e AS (SELECT 'c' || o_custkey ego, 's' || l_suppkey alter, count(*)::DOUBLE "value" FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT DISTINCT ego node, 1 mode FROM e UNION ALL SELECT DISTINCT alter, 2 FROM e)"""
