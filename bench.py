"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

#: On the driver's tables: 150,000 orders give visits of 15,000 customers with 147,548 ties, events follows of 1,500 users with 97,716.
QUERIES = ["degree_two_mode", "degree_strength", "summary", "dyad_census", "clustering_undirected", "triangles", "components", "shared_neighbors", "burt", "triad_census", "kcore", "similarity_jaccard", "turnover", "pagerank", "eigenvector", "bridges", "cliques", "disparity"]
#: Networks of the published measurements: nodes, with ten ties a node on average.
SIZES = (10_000, 100_000)


def published(spark, nodes):
    """Operators on a random directed network of ten ties a node, as in the published measurements."""
    from tiegraph.operators import generators, iterate, measures, structure
    from tiegraph.operators.transform import symmetrize
    from tiegraph.plans.lineage import materialize

    made = generators.random_prob(spark, nodes, 10 / (nodes - 1))
    net = made.with_(edges=materialize(made.edges, "bench-ties"), nodes=materialize(made.nodes, "bench-nodes"))
    k = f"{nodes // 1000}k"
    return {
        f"degree_{k}": lambda: measures.degree(net), f"components_{k}": lambda: iterate.components(net), f"clustering_{k}": lambda: structure.clustering(net), f"triads_{k}": lambda: structure.triad_census(net), f"burt_{k}": lambda: structure.burt(net),
        f"pagerank_{k}": lambda: iterate.pagerank(net), f"kcore_{k}": lambda: iterate.kcore(net), f"eigenvector_{k}": lambda: iterate.eigenvector(symmetrize(net)),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tiegraph import catalog_queries

    queries, took = catalog_queries.queries(), {}
    queries["degree_two_mode"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session
    for name in QUERIES:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    for nodes in SIZES:
        for name, build in published(spark, nodes).items():
            began = time.time()
            build().write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "network queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
