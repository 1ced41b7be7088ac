"""Network files: edge lists, matrices, compressed lists, Pajek, UCINET DL, GML, GEXF; and the session's own folder.

Line formats are read as text with line numbers and parsed by columns; documents (DL, GML, GEXF) are parsed whole, one
file in one row. Writers produce ordered text. The own format is Parquet plus a small JSON of facts.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiegraph.network import Catalog, Network, NetworkError, from_compressed, from_edges, from_wide


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): the text files of a path, each one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.rtrim(F.col("value")), r"\r?\n|\r").alias("lines"))


def _lines(spark: SparkSession, path: str, keep: str = "") -> DataFrame:
    """(n, line): the lines that match ``keep``, numbered from 0 over the files of a path in order of their names."""
    files = _files(spark, path)
    if keep:
        files = files.withColumn("lines", F.filter("lines", lambda line: line.rlike(keep)))
    sizes = files.select("file", F.size("lines").alias("k"))
    before = sizes.select("file", F.coalesce(F.sum("k").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row for each file
    return files.select("file", F.posexplode("lines").alias("i", "line")).join(F.broadcast(before), "file").select((F.col("b") + F.col("i")).cast("long").alias("n"), "line")


def _whole(spark: SparkSession, path: str) -> str:
    """The text of a document, its parts in order of their names; documents are parsed on the driver."""
    return "\n".join("\n".join(r["lines"]) for r in sorted(_files(spark, path).collect(), key=lambda r: r["file"]))


def read_edgelist(spark: SparkSession, path: str, sep: str = ",", header: bool = True, **options: object) -> Network:
    """Delimited file of ego, alter[, value]: the first columns, whatever their names."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = df.columns
    return from_edges(df, names[0], names[1], names[2] if len(names) > 2 else None, **options)


def read_matrix(spark: SparkSession, path: str, sep: str = r"[\s,;]+", labels: bool = False, directed: bool | None = None, two_mode: bool = False) -> Network:
    """Square (or, two-mode, rectangular) matrix of numbers; with ``labels`` the first line and column name the nodes."""
    rows = _lines(spark, path, r"\S").select("n", F.split(F.trim("line"), sep).alias("p"))
    head = rows.orderBy("n").first()["p"]
    if labels:
        names = [x for x in head if x]
        body = rows.where(F.col("n") > rows.agg(F.min("n")).head()[0]).select(F.col("p")[0].alias("row"), F.slice("p", 2, len(names)).alias("p"))
    else:
        names = [str(k + 1) for k in range(len(head))]
        body = rows.select((F.col("n") + 1).cast("string").alias("row"), "p")
    wide = body.select("row", *[F.col("p")[k].cast("double").alias(f"c{k}") for k in range(len(names))]).toDF("row", *names)
    return from_wide(wide, "row", names, directed=directed, two_mode=two_mode)


def read_compressed(spark: SparkSession, path: str, sep: str = ",") -> Network:
    return from_compressed(_lines(spark, path).select("line"), "line", sep)


def read_pajek(spark: SparkSession, path: str) -> Network:
    """*Vertices n [n1], *Arcs, *Edges, *Arcslist, *Edgeslist, *Matrix; unlabelled vertices have their number as label."""
    lines = _lines(spark, path, r"^\s*[^%\s]")
    mark = F.when(F.col("line").rlike(r"^\s*\*"), F.lower(F.regexp_extract("line", r"^\s*\*(\w+)", 1)))
    lines = lines.withColumn("mark", mark)
    # a row for each section
    sections = lines.where("mark is not null").select(F.col("n").alias("start"), F.col("mark").alias("section"), F.coalesce(F.lead("n").over(Window.orderBy("n")), F.lit(2**62)).alias("end"))
    tagged = lines.join(F.broadcast(sections), (F.col("n") >= F.col("start")) & (F.col("n") < F.col("end")))
    size = tagged.where("mark = 'vertices'").select(F.regexp_extract("line", r"\*\w+\s+(\d+)", 1).cast("long").alias("n"), F.regexp_extract("line", r"\*\w+\s+\d+\s+(\d+)", 1).alias("n1")).head()
    body = tagged.where("mark is null")
    named = body.where("section = 'vertices'").select(F.regexp_extract("line", r"^\s*(\d+)", 1).cast("long").alias("id"), F.regexp_extract("line", r'^\s*\d+\s+(?:"([^"]*)"|(\S+))', 1).alias("q"), F.regexp_extract("line", r'^\s*\d+\s+([^"\s]\S*)', 1).alias("w"))
    label = F.when(F.col("q") != "", F.col("q")).when(F.col("w") != "", F.col("w")).otherwise(F.col("id").cast("string"))
    ids = spark.range(1, size["n"] + 1)
    names = ids.join(named, "id", "left").select("id", F.coalesce(label, F.col("id").cast("string")).alias("node"))
    p = F.split(F.trim("line"), r"\s+")
    pair = body.where("section in ('arcs', 'edges')").select("section", p[0].try_cast("long").alias("a"), F.get(p, F.lit(1)).try_cast("long").alias("b"), F.coalesce(F.get(p, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("value"))
    lists = body.where("section in ('arcslist', 'edgeslist')").select("section", p.alias("p")).select("section", F.col("p")[0].try_cast("long").alias("a"), F.explode(F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.try_cast("long"))).alias("b"), F.lit(1.0).alias("value"))
    rows = body.where("section = 'matrix'").select(F.lit("matrix").alias("section"), (F.col("n") - F.col("start")).cast("long").alias("a"), F.posexplode(p).alias("b", "v"))
    cells = rows.select("section", "a", (F.col("b") + 1).cast("long").alias("b"), F.col("v").try_cast("double").alias("value")).where("value <> 0")
    ties = pair.unionByName(lists).unionByName(cells)
    directed = not ties.where("section in ('arcs', 'arcslist', 'matrix')").isEmpty()
    if directed:
        back = ties.where("section like 'edges%'").select("section", F.col("b").alias("a"), F.col("a").alias("b"), "value")
        ties = ties.unionByName(back)
    edges = ties.join(names.withColumnsRenamed({"id": "a", "node": "ego"}), "a").join(names.withColumnsRenamed({"id": "b", "node": "alter"}), "b").select("ego", "alter", "value").dropDuplicates(["ego", "alter"])
    if size["n1"]:
        nodes = names.select("node", F.when(F.col("id") <= int(size["n1"]), 1).otherwise(2).alias("mode"))
        return Network(nodes, edges, directed=False, two_mode=True)
    return Network(names.select("node"), edges, directed=directed, selfloop=True)


def read_dl(spark: SparkSession, path: str) -> Network:
    """UCINET DL: fullmatrix (one or several relations: the first), lowerhalf, nodelist1, edgelist1, and rectangular data."""
    text = _whole(spark, path)
    head, _, data = re.split(r"(?i)\bdata\s*:", text, maxsplit=1)[0], ":", re.split(r"(?i)\bdata\s*:", text, maxsplit=1)[-1]
    number = lambda k: int(m[1]) if (m := re.search(rf"(?i)\b{k}\s*=\s*(\d+)", head)) else None
    n, nr, nc = number("n"), number("nr"), number("nc")
    form = (re.search(r"(?i)format\s*=\s*(\w+)", head) or [None, "fullmatrix"])[1].lower()
    names = lambda key: [x.strip("\"'") for x in re.split(r"[\s,]+", m[1].strip()) if x] if (m := re.search(rf"(?is)\b{key}\s*:\s*(.*?)(?=\b(?:row|col(?:umn)?)?\s*labels\b|\bdata\b|\bformat\b|\blevel\b|\Z)", head)) and "embedded" not in m[1].lower() else None
    rows, cols = names("row labels") or names(r"(?<!row )(?<!col )(?<!column )labels"), names(r"col(?:umn)? labels")
    if nr and nc:
        r, c = rows or [f"r{k + 1}" for k in range(nr)], cols or [f"c{k + 1}" for k in range(nc)]
        v = [float(x) for x in data.split()]
        cells = [(r[k // nc], c[k % nc], v[k]) for k in range(nr * nc) if v[k]]
        nodes = [(x, 1) for x in r] + [(x, 2) for x in c]
        return Network(spark.createDataFrame(nodes, "node string, mode int"), spark.createDataFrame(cells, "ego string, alter string, value double"), directed=False, two_mode=True)
    if n is None:
        raise NetworkError("no N in the file")
    if form in ("nodelist1", "edgelist1"):
        seen: dict[str, None] = dict.fromkeys(rows or [])
        ties = []
        for line in data.strip().splitlines():
            p = line.replace(",", " ").split()
            if len(p) > 1:
                ties += [(p[0], x, 1.0) for x in p[1:]] if form == "nodelist1" else [(p[0], p[1], float(p[2]) if len(p) > 2 else 1.0)]
            seen.update(dict.fromkeys(p if form == "nodelist1" else p[:2]))
        if rows:
            name = lambda x: rows[int(x) - 1] if x.isdigit() and x not in rows else x
            ties, seen = [(name(a), name(b), v) for a, b, v in ties], dict.fromkeys(rows)
        labels = list(seen) + [str(k) for k in range(1, n + 1) if len(seen) < n and str(k) not in seen][: max(0, n - len(seen))]
    else:
        if re.search(r"(?i)labels\s+embedded", head):
            table = [x.split() for x in data.strip().splitlines()]
            labels, values = table[0], [float(x) for row in table[1:] for x in row[1:]]
        else:
            labels, values = rows or [str(k + 1) for k in range(n)], [float(x) for x in data.split()]
        if form == "lowerhalf":
            diagonal = len(values) == n * (n + 1) // 2
            ties, k = [], 0
            for i in range(n):
                for j in range(i + 1 if diagonal else i):
                    if values[k]:
                        ties += [(labels[i], labels[j], values[k]), (labels[j], labels[i], values[k])][: 1 if i == j else 2]
                    k += 1
        else:
            ties = [(labels[k // n], labels[k % n], values[k]) for k in range(n * n) if values[k]]
    e = spark.createDataFrame(ties, "ego string, alter string, value double")
    return from_edges(e, value="value", nodes=spark.createDataFrame([(x,) for x in labels], "node string"), selfloop=True)


def read_gml(spark: SparkSession, path: str) -> Network:
    """Node and edge blocks; ids or labels, value or weight, directed."""
    text = _whole(spark, path)
    field = lambda block, key: (m[1] or m[2] if (m := re.search(rf'\b{key}\s+(?:"([^"]*)"|(\S+))', block)) else None)
    nodes = {field(b, "id"): field(b, "label") or field(b, "id") for b in re.findall(r"\bnode\s*\[(.*?)\]", text, re.S)}
    ties = [(nodes[field(b, "source")], nodes[field(b, "target")], float(field(b, "value") or field(b, "weight") or 1)) for b in re.findall(r"\bedge\s*\[(.*?)\]", text, re.S)]
    directed = bool(re.search(r"\bdirected\s+1\b", text))
    e = spark.createDataFrame(ties, "ego string, alter string, value double")
    return from_edges(e, value="value", nodes=spark.createDataFrame([(x,) for x in nodes.values()], "node string"), directed=directed, selfloop=True)


def read_gexf(spark: SparkSession, path: str) -> Network:
    root = ET.fromstring(_whole(spark, path))
    for x in root.iter():
        x.tag = x.tag.rsplit("}", 1)[-1]
    graph = root.find("graph")
    label = {x.get("id"): x.get("label") or x.get("id") for x in graph.iter("node")}
    ties = [(label[x.get("source")], label[x.get("target")], float(x.get("weight") or 1)) for x in graph.iter("edge")]
    e = spark.createDataFrame(ties, "ego string, alter string, value double")
    return from_edges(e, value="value", nodes=spark.createDataFrame([(x,) for x in label.values()], "node string"), directed=graph.get("defaultedgetype") == "directed", selfloop=True)


def _write_text(lines: DataFrame, path: str) -> None:
    """(part, n, line) in order: a range partitioning keeps the parts of the file in order, so it need not be one task."""
    lines.repartitionByRange("part", "n").sortWithinPartitions("part", "n").select("line").write.mode("overwrite").text(path)


def _numbered(net: Network) -> tuple[DataFrame, DataFrame]:
    from tiegraph.network import dense_ids

    ids = dense_ids(net.nodes)
    e = net.ties.join(ids.withColumnsRenamed({"node": "ego", "id": "a"}), "ego").join(ids.withColumnsRenamed({"node": "alter", "id": "b"}), "alter")
    return ids, e


def _head(net: Network, *lines: object) -> DataFrame:
    return net.spark.createDataFrame([(0, k, str(x)) for k, x in enumerate(lines)], "part int, n long, line string")


def _static(net: Network) -> None:
    if net.temporal:
        raise NetworkError("this format has no time")


def write_pajek(net: Network, path: str) -> None:
    _static(net)
    ids, e = _numbered(net)
    v = ids.select(F.lit(1).alias("part"), F.col("id").alias("n"), F.format_string('%d "%s"', "id", F.col("node").cast("string")).alias("line"))
    mark = net.spark.createDataFrame([(2, 0, "*Arcs" if net.directed else "*Edges")], "part int, n long, line string")
    t = e.select(F.lit(3).alias("part"), (F.col("a") * 2**31 + F.col("b")).alias("n"), F.format_string("%d %d %s", "a", "b", F.col("value").cast("string")).alias("line"))
    _write_text(_head(net, f"*Vertices {net.n_nodes()}").unionByName(v).unionByName(mark).unionByName(t), path)


def write_dl(net: Network, path: str) -> None:
    """Edge list form, which needs no dense matrix."""
    _static(net)
    v = net.nodes.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.col("node").cast("string").alias("line")).orderBy("line")
    t = net.arcs.select(F.lit(3).alias("part"), F.xxhash64("ego", "alter").alias("n"), F.format_string("%s %s %s", F.col("ego").cast("string"), F.col("alter").cast("string"), F.col("value").cast("string")).alias("line"))
    mark = net.spark.createDataFrame([(2, 0, "data:")], "part int, n long, line string")
    _write_text(_head(net, f"dl n={net.n_nodes()} format=edgelist1", "labels:").unionByName(v).unionByName(mark).unionByName(t), path)


def write_gml(net: Network, path: str) -> None:
    _static(net)
    ids, e = _numbered(net)
    v = ids.select(F.lit(1).alias("part"), F.col("id").alias("n"), F.format_string('  node [ id %d label "%s" ]', "id", F.col("node").cast("string")).alias("line"))
    t = e.select(F.lit(2).alias("part"), (F.col("a") * 2**31 + F.col("b")).alias("n"), F.format_string("  edge [ source %d target %d value %s ]", "a", "b", F.col("value").cast("string")).alias("line"))
    end = net.spark.createDataFrame([(3, 0, "]")], "part int, n long, line string")
    _write_text(_head(net, "graph [", f"  directed {int(net.directed)}").unionByName(v).unionByName(t).unionByName(end), path)


def write_gexf(net: Network, path: str) -> None:
    _static(net)
    ids, e = _numbered(net)
    kind = "directed" if net.directed else "undirected"
    v = ids.select(F.lit(1).alias("part"), F.col("id").alias("n"), F.format_string('<node id="%d" label="%s"/>', "id", F.col("node").cast("string")).alias("line"))
    mark = net.spark.createDataFrame([(2, 0, "</nodes><edges>")], "part int, n long, line string")
    t = e.select(F.lit(3).alias("part"), (F.col("a") * 2**31 + F.col("b")).alias("n"), F.format_string('<edge source="%d" target="%d" weight="%s"/>', "a", "b", F.col("value").cast("string")).alias("line"))
    end = net.spark.createDataFrame([(4, 0, "</edges></graph></gexf>")], "part int, n long, line string")
    _write_text(_head(net, '<gexf version="1.3"><graph defaultedgetype="' + kind + '"><nodes>').unionByName(v).unionByName(mark).unionByName(t).unionByName(end), path)


def write_edgelist(net: Network, path: str) -> None:
    """CSV of ego, alter, value and, of a temporal network, its times."""
    table = net.events if net.temporal == "event" else net.edges
    table.write.mode("overwrite").csv(path, header=True)


def save(catalog: Catalog, path: str, spark: SparkSession) -> None:
    """Every network of a session: nodes, ties and events as Parquet, and facts as JSON."""
    facts = []
    for name in catalog.names():
        net = catalog.get(name)
        net.nodes.write.mode("overwrite").parquet(f"{path}/{name}/nodes")
        net.edges.write.mode("overwrite").parquet(f"{path}/{name}/edges")
        if net.events is not None:
            net.events.write.mode("overwrite").parquet(f"{path}/{name}/events")
        facts.append({k: getattr(net, k) for k in ("name", "directed", "valued", "selfloop", "two_mode", "temporal", "provenance")} | {"events": net.events is not None})
    meta = json.dumps({"current": catalog.current, "networks": facts})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str, spark: SparkSession, into: Catalog | None = None) -> Catalog:
    """Read a saved session; ``into``: append to a catalog, renaming networks whose names are taken."""
    catalog = into or Catalog()
    meta = json.loads(spark.read.text(f"{path}/meta").head()["value"])
    for f in meta["networks"]:
        folder = f"{path}/{f['name']}"
        events = spark.read.parquet(f"{folder}/events") if f.pop("events") else None
        net = Network(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), events=events, **f)
        catalog.add(net, catalog.free_name(net.name))
    if into is None:
        catalog.current = meta["current"]
    return catalog
