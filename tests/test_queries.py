"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tiegraph import catalog_queries

CHECKED = [
    "from_edges_last_wins", "symmetrize_mean", "recode_zero", "collapse_sum", "expand_absdistinv", "algebra_subtract", "project_newman", "project_cosine", "degree_opsahl", "degree_two_mode", "summary", "mixing", "alter_stats", "context",
    "dyad_census", "assortativity_attribute", "turnover", "formation", "modularity", "diffusion_exposure", "clustering_directed", "brokerage", "burt", "triad_census", "similarity_adamic", "profile_pearson", "nestedness", "motifs4", "components", "geodesics", "pagerank", "lans", "adjust_BY", "session_ties", "kcore", "hitting_time", "cliques", "k_plexes", "betweenness", "bridges", "adjust_hommel", "sdsm", "round_trip_pajek", "round_trip_compressed", "profile_pearson_both", "permute_swap", "backbone_signed", "expression_variables",
]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.astype(object).where(df.notna(), None).itertuples(index=False):
        out.append(tuple(round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None else None for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf, db, name):
    got, want = rows(catalog_queries.queries()[name](spark, sf).toPandas()), rows(db.execute(catalog_queries.oracle_sql()[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 3e-5) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
