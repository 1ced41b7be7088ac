from pyspark.sql import functions as F

from tiegraph import network as N
from tiegraph.sources import formats as X


def small(spark):
    e = spark.createDataFrame([("ann", "bob", 2.0), ("bob", "cy", 1.0)], "ego string, alter string, value double")
    return N.Network(spark.createDataFrame([("ann",), ("bob",), ("cy",), ("dee",)], "node string"), e)


def ties(net):
    return {(r["ego"], r["alter"]): r["value"] for r in net.arcs.collect()}


def nodes(net):
    return {r["node"] for r in net.nodes.collect()}


def test_round_trips(spark, tmp_path):
    net = small(spark)
    for kind in ("pajek", "gml", "gexf", "dl"):
        path = f"file://{tmp_path}/{kind}"
        getattr(X, f"write_{kind}")(net, path)
        back = getattr(X, f"read_{kind}")(spark, _one_file(spark, path))
        assert ties(back) == ties(net), kind
        assert nodes(back) == nodes(net), kind


def _one_file(spark, path):
    """The parts of a written text, in order, as one file."""
    whole = "\n".join(r["value"] for r in spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect())
    name = path.removeprefix("file://") + ".one"
    with open(name, "w") as f:
        f.write(whole)
    return "file://" + name


def test_pajek_sections(spark, tmp_path):
    (tmp_path / "p.net").write_text('*Vertices 4\n1 "x y" 0.1 0.2\n2 b\n*Arcs\n1 2 3\n*Edges\n2 3\n*Arcslist\n4 1 2\n')
    net = X.read_pajek(spark, f"file://{tmp_path}/p.net")
    assert ties(net) == {("x y", "b"): 3.0, ("b", "3"): 1.0, ("3", "b"): 1.0, ("4", "x y"): 1.0, ("4", "b"): 1.0}


def test_matrix_and_compressed(spark, tmp_path):
    (tmp_path / "m.txt").write_text("0 1 0\n1 0 1\n0 1 0\n")
    net = X.read_matrix(spark, f"file://{tmp_path}/m.txt")
    assert not net.directed and net.edges.count() == 2
    (tmp_path / "c.txt").write_text("a, b, c\nd\n")
    net = X.read_compressed(spark, f"file://{tmp_path}/c.txt")
    assert ties(net) == {("a", "b"): 1.0, ("a", "c"): 1.0} and "d" in nodes(net)


def test_dl_forms(spark, tmp_path):
    (tmp_path / "f.dat").write_text("DL N=3 FORMAT=FULLMATRIX\nLABELS:\na,b,c\nDATA:\n0 1 0\n0 0 2\n0 0 0\n")
    assert ties(X.read_dl(spark, f"file://{tmp_path}/f.dat")) == {("a", "b"): 1.0, ("b", "c"): 2.0}
    (tmp_path / "n.dat").write_text("dl n=3 format=nodelist1\nlabels:\na b c\ndata:\n1 2 3\n2 3\n")
    assert ties(X.read_dl(spark, f"file://{tmp_path}/n.dat")) == {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0}
    (tmp_path / "l.dat").write_text("dl n=3 format=lowerhalf\nlabels:\na,b,c\ndata:\n1\n0 1\n")
    assert not X.read_dl(spark, f"file://{tmp_path}/l.dat").directed


def test_save_and_load(spark, tmp_path):
    c = N.Catalog()
    c.add(small(spark), "one")
    X.save(c, f"file://{tmp_path}/s", spark)
    d = X.load(f"file://{tmp_path}/s", spark)
    assert d.names() == ["one"] and ties(d.get()) == ties(c.get("one"))
    assert X.load(f"file://{tmp_path}/s", spark, into=d).names() == ["one", "one_1"]
