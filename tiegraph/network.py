"""A network: a node table, a tie table, and what is known about them. Every operator takes and gives these.

nodes: node [, mode] [, attributes]; edges: ego, alter, value [, t | t_start, t_end]; events: sender, receiver, ts, value.
A stored tie has a value other than 0; a null value is a missing dyad. Undirected ties are stored once, ego <= alter;
``arcs`` gives both directions. Two-mode ties run from mode 1 to mode 2; node keys of the modes must not clash.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class NetworkError(ValueError):
    """An operator doesn't apply to this network."""


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    valued: bool = True
    selfloop: bool = False
    two_mode: bool = False
    name: str = "network"
    temporal: str | None = None  # snapshot, interval or event
    events: DataFrame | None = None
    provenance: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def ties(self) -> DataFrame:
        """Stored ties: value present and not 0; self-ties only if the network has them."""
        kept = self.edges.where("value is not null and value <> 0")
        return kept if self.selfloop else kept.where("ego <> alter")

    @property
    def arcs(self) -> DataFrame:
        """(ego, alter, value) in every direction a tie runs."""
        ties = self.ties.select("ego", "alter", "value")
        if self.directed:
            return ties
        return ties.unionByName(ties.where("ego <> alter").select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), "value"))

    @property
    def links(self) -> DataFrame:
        """(ego, alter) both ways for every pair tied in either direction, no self-ties."""
        ties = self.ties.where("ego <> alter").select("ego", "alter")
        return ties.unionByName(ties.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"))).distinct()

    def with_(self, **changes: object) -> Network:
        return replace(self, **changes)

    def n_nodes(self) -> int:
        return self.nodes.count()

    def need(self, directed: bool | None = None, two_mode: bool | None = None) -> None:
        if directed is not None and self.directed != directed:
            raise NetworkError(f"needs a network that is {'directed' if directed else 'undirected'}")
        if two_mode is not None and self.two_mode != two_mode:
            raise NetworkError(f"needs a {'two' if two_mode else 'one'}-mode network")


def last_wins(edges: DataFrame, seq: str | None) -> DataFrame:
    """One row per (ego, alter): that with the largest ``seq`` (a column that orders the input); any of equals without it."""
    if seq is None:
        return edges.dropDuplicates(["ego", "alter"])
    rest = [c for c in edges.columns if c not in ("ego", "alter")]
    best = edges.groupBy("ego", "alter").agg(F.max(F.struct(F.col(seq).alias("_seq"), *rest)).alias("b"))
    return best.select("ego", "alter", *[F.col(f"b.{c}").alias(c) for c in rest if c != seq])


def is_symmetric(edges: DataFrame) -> bool:
    """Whether every tie has its reverse with the same value."""
    e = edges.where("ego <> alter").select("ego", "alter", "value")
    back = e.select(F.col("alter").alias("ego"), F.col("ego").alias("alter"), F.col("value").alias("back"))
    return e.join(back, ["ego", "alter"], "left").where("not (value <=> back)").isEmpty()


def symmetrized(edges: DataFrame, how: str = "max") -> DataFrame:
    """One row per pair, ego <= alter: max, min, sum or mean of the two directions; an absent direction counts 0."""
    if how not in ("max", "min", "sum", "mean"):
        raise NetworkError(f"unknown rule {how}")
    forward = F.when(F.col("ego") <= F.col("alter"), F.col("value"))
    backward = F.when(F.col("ego") > F.col("alter"), F.col("value"))
    pair = edges.groupBy(F.least("ego", "alter").alias("ego"), F.greatest("ego", "alter").alias("alter")).agg(F.coalesce(F.max(forward), F.lit(0.0)).alias("f"), F.coalesce(F.max(backward), F.lit(0.0)).alias("b"))
    f, b = F.col("f"), F.when(F.col("ego") == F.col("alter"), F.col("f")).otherwise(F.col("b"))
    value = {"max": F.greatest(f, b), "min": F.least(f, b), "sum": F.when(F.col("ego") == F.col("alter"), f).otherwise(f + b), "mean": (f + b) / 2}[how]
    return pair.select("ego", "alter", value.alias("value")).where("value <> 0")


def from_edges(
    df: DataFrame,
    ego: str = "ego",
    alter: str = "alter",
    value: str | None = None,
    *,
    seq: str | None = None,
    nodes: DataFrame | None = None,
    directed: bool | None = None,
    selfloop: bool = False,
    prefix: str = "",
    name: str = "network",
) -> Network:
    """Build a network from an edge list.

    The last row of a repeated (ego, alter) wins; rows without an end make no node; isolates come from ``nodes``.
    ``directed`` None: undirected if the values are symmetric; False: symmetrised by the larger value. ``prefix`` goes
    before the node labels (numeric ids of label "n"). Strings are trimmed; mixed types become strings.
    """
    kinds = {dict(df.dtypes)[c] for c in (ego, alter)}
    cast = (lambda c: F.trim(F.col(c).cast("string"))) if "string" in kinds else (lambda c: F.col(c).cast("long"))
    label = (lambda c: F.concat(F.lit(prefix), cast(c).cast("string"))) if prefix else cast
    columns = [label(ego).alias("ego"), label(alter).alias("alter"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("value")]
    rows = df.select(*columns, *([F.col(seq).alias("_seq_")] if seq else [])).where("ego is not null and alter is not null")
    listed = rows.select(F.col("ego").alias("node")).union(rows.select("alter")).distinct()
    edges = last_wins(rows, "_seq_" if seq else None)
    if not selfloop:
        edges = edges.where("ego <> alter")
    if nodes is not None:
        listed = listed.join(nodes, "node", "full")
    if directed is None:
        directed = not is_symmetric(edges)
        if not directed:
            edges = edges.where("ego <= alter")
    elif not directed:
        edges = symmetrized(edges)
    return Network(listed, edges, directed=directed, valued=value is not None, selfloop=selfloop, name=name)


def from_two_mode(df: DataFrame, one: str, two: str, value: str | None = None, *, labels: tuple[str, str] = ("a", "b"), name: str = "network") -> Network:
    """Two-mode network of pairs: node keys are the label of the mode and the id; values of repeated pairs add up."""
    pairs = df.where(F.col(one).isNotNull() & F.col(two).isNotNull())
    pairs = pairs.groupBy(F.concat(F.lit(labels[0]), F.col(one).cast("string")).alias("ego"), F.concat(F.lit(labels[1]), F.col(two).cast("string")).alias("alter"))
    edges = pairs.agg((F.sum(F.col(value).cast("double")) if value else F.count("*").cast("double")).alias("value"))
    nodes = edges.select(F.col("ego").alias("node"), F.lit(1).alias("mode")).distinct().union(edges.select("alter", F.lit(2)).distinct())
    return Network(nodes, edges, directed=False, valued=True, two_mode=True, name=name)


def from_wide(df: DataFrame, label: str, columns: Sequence[str] | None = None, *, two_mode: bool = False, directed: bool | None = None, name: str = "network") -> Network:
    """Adjacency (square, labels = column names) or bipartite (rows = mode 1, columns = mode 2) table to a network."""
    columns = [c for c in df.columns if c != label] if columns is None else list(columns)
    long = df.select(F.col(label).cast("string").alias("ego"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`").cast("double") for c in columns])))).toDF("ego", "alter", "value")
    cells = long.where("value is not null and value <> 0")
    if two_mode:
        nodes = df.select(F.col(label).cast("string").alias("node"), F.lit(1).alias("mode")).union(df.sparkSession.createDataFrame([(c, 2) for c in columns], "node string, mode int"))
        return Network(nodes, cells, directed=False, two_mode=True, name=name)
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "node string")
    return from_edges(cells, value="value", nodes=listed, directed=directed, selfloop=True, name=name)


def from_compressed(lines: DataFrame, column: str = "value", sep: str = ",", name: str = "network") -> Network:
    """Lines "ego, alter, alter, ..."; a line with an ego alone is an isolate."""
    parts = lines.select(F.transform(F.split(column, sep), lambda x: F.trim(x)).alias("p")).where("p[0] <> ''")
    pairs = parts.select(F.col("p")[0].alias("ego"), F.explode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("alter")).where("alter <> ''")
    return from_edges(pairs, nodes=parts.select(F.col("p")[0].alias("node")).distinct(), name=name)


def snapshots(df: DataFrame, ego: str, alter: str, t: str, value: str | None = None, nodes: DataFrame | None = None) -> Network:
    """Ties each observed at an instant."""
    edges = df.select(F.col(ego).alias("ego"), F.col(alter).alias("alter"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("value"), F.col(t).alias("t"))
    return Network(_nodes(edges, nodes), edges, temporal="snapshot", valued=value is not None)


def intervals(df: DataFrame, ego: str, alter: str, start: str, end: str, value: str | None = None, nodes: DataFrame | None = None) -> Network:
    """Ties that hold from t_start up to, without, t_end."""
    edges = df.select(F.col(ego).alias("ego"), F.col(alter).alias("alter"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("value"), F.col(start).alias("t_start"), F.col(end).alias("t_end"))
    return Network(_nodes(edges, nodes), edges, temporal="interval", valued=value is not None)


def event_list(df: DataFrame, sender: str, receiver: str, ts: str, value: str | None = None) -> Network:
    """Events apart from ties: static operators see nodes only."""
    events = df.select(F.col(sender).alias("sender"), F.col(receiver).alias("receiver"), F.col(ts).alias("ts"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("value"))
    nodes = events.select(F.col("sender").alias("node")).union(events.select("receiver")).distinct()
    edges = events.select(F.col("sender").alias("ego"), F.col("receiver").alias("alter"), "value").where("false")
    return Network(nodes, edges, temporal="event", events=events)


def _nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    listed = edges.select(F.col("ego").alias("node")).union(edges.select("alter")).where("node is not null").distinct()
    return listed if nodes is None else listed.join(nodes, "node", "full")


def at_time(net: Network, t: object) -> Network:
    """The static network at ``t``: ties observed then, or in whose interval it lies; events then give ties of value 1."""
    moment = t if hasattr(t, "_jc") else F.lit(t)
    if net.temporal == "event":
        edges = net.events.where(F.col("ts") == moment).select(F.col("sender").alias("ego"), F.col("receiver").alias("alter")).distinct().withColumn("value", F.lit(1.0))
    elif net.temporal == "interval":
        edges = net.edges.where((F.col("t_start") <= moment) & (moment < F.col("t_end"))).select("ego", "alter", "value")
    elif net.temporal == "snapshot":
        edges = net.edges.where(F.col("t") == moment).select("ego", "alter", "value")
    else:
        raise NetworkError("needs a temporal network")
    return net.with_(edges=edges.groupBy("ego", "alter").agg(F.max("value").alias("value")), temporal=None, events=None, provenance=f"{net.name} at {t}")


def between_times(net: Network, start: object, end: object) -> Network:
    """Ties observed in [start, end): how often, as value."""
    table, t = (net.events.withColumnsRenamed({"sender": "ego", "receiver": "alter"}), "ts") if net.temporal == "event" else (net.edges, "t")
    if net.temporal == "interval":
        inside = net.edges.where((F.col("t_start") < F.lit(end)) & (F.col("t_end") > F.lit(start)))
    else:
        inside = table.where((F.col(t) >= F.lit(start)) & (F.col(t) < F.lit(end)))
    return net.with_(edges=inside.groupBy("ego", "alter").agg(F.sum("value").alias("value")), temporal=None, events=None)


class Catalog:
    """Named networks with a current one; names may have wildcards. Names have at most 32 letters, digits or underscores."""

    def __init__(self) -> None:
        self._nets: dict[str, Network] = {}
        self._stack: list[tuple[dict[str, Network], str | None]] = []
        self.current: str | None = None

    @staticmethod
    def valid(name: str) -> bool:
        return name.isidentifier() and len(name) <= 32

    def free_name(self, name: str) -> str:
        base, k, out = "".join(c if c.isalnum() or c == "_" else "_" for c in name)[:32] or "network", 0, ""
        base = base if not base[0].isdigit() else f"_{base}"[:32]
        out = base
        while out in self._nets:
            k += 1
            out = f"{base[: 31 - len(str(k))]}_{k}"
        return out

    def add(self, net: Network, name: str | None = None) -> str:
        name = name or self.free_name(net.name)
        if not self.valid(name):
            raise NetworkError(f"{name} is no valid name")
        self._nets[name] = net.with_(name=name)
        self.current = name
        return name

    def get(self, name: str | None = None) -> Network:
        name = name or self.current
        if name is None or name not in self._nets:
            raise NetworkError(f"no network {name}")
        return self._nets[name]

    def names(self, *patterns: str, alpha: bool = False) -> list[str]:
        found = [n for n in self._nets if not patterns or any(fnmatch.fnmatchcase(n, p) for p in patterns)]
        return sorted(found) if alpha else found

    def drop(self, *patterns: str) -> None:
        for n in self.names(*patterns):
            del self._nets[n]
        if self.current not in self._nets:
            self.current = next(reversed(self._nets), None)

    def keep(self, *patterns: str) -> None:
        kept = set(self.names(*patterns))
        self.drop(*[n for n in self._nets if n not in kept]) if kept != set(self._nets) else None

    def rename(self, old: str, new: str) -> None:
        if not self.valid(new) or new in self._nets:
            raise NetworkError(f"{new} can't be used")
        self._nets = {new if k == old else k: (v.with_(name=new) if k == old else v) for k, v in self._nets.items()}
        self.current = new if self.current == old else self.current

    def duplicate(self, name: str, new: str | None = None) -> str:
        return self.add(self.get(name), new or self.free_name(name))

    def order(self, names: Sequence[str]) -> None:
        self._nets = {n: self._nets[n] for n in [*names, *[x for x in self._nets if x not in names]]}

    def preserve(self) -> None:
        self._stack.append((dict(self._nets), self.current))

    def restore(self) -> None:
        self._nets, self.current = self._stack.pop()

    def clear(self) -> None:
        self._nets, self.current = {}, None

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(n, x.directed, x.valued, x.two_mode, x.temporal or "", n == self.current) for n, x in self._nets.items()]
        return spark.createDataFrame(rows, "name string, directed boolean, valued boolean, two_mode boolean, temporal string, current boolean")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """Number the nodes from 1 in their order, in parts: ranges are counted, then numbered inside."""
    from tiegraph.plans.lineage import materialize

    parts = materialize(nodes.select("node").repartitionByRange("node").withColumn("_p", F.spark_partition_id()), "node-parts")
    sums = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("node"))
    return parts.join(F.broadcast(before), "_p").select("node", (F.col("_b") + inside).cast("long").alias("id"))
