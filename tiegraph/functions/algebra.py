"""Expressions over networks: names are networks, operators work element by element, 0 where there is no tie.

``evaluate("trade * (other > 2) + trade @ trade", nets)``: + - * / ** (power of values) == != > < >= <= & |, @ (matrix
product), numbers, round, exp, abs, sqrt, log, ln, t (transpose), sym of one network; a name that is no network is an
attribute of the sender, _n its place and _N the number of nodes. ``shortcut`` has the functions that stand alone.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.network import Network, NetworkError, dense_ids, is_symmetric
from tiegraph.operators import transform as T

_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.BitAnd: "&", ast.BitOr: "|", ast.MatMult: "**", ast.Eq: "==", ast.NotEq: "!=", ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<="}
_UNARY = {"round": F.round, "exp": F.exp, "abs": F.abs, "sqrt": F.sqrt, "log": F.log, "ln": F.log}


def _python(op: str, x: float, y: float) -> float:
    return float({"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else float("nan"), "==": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "&": bool(x) and bool(y), "|": bool(x) or bool(y)}[op])


def _scalar(net: Network, number: float, op: str, left: bool) -> Network:
    """A network and a number: all dyads take part only if the result of an empty one isn't 0."""
    if op == "**":
        raise NetworkError("a matrix product needs two networks")
    at_zero = _python(op, number, 0.0) if left else _python(op, 0.0, number)
    v, c = F.col("value"), F.lit(number)
    x, y = (c, v) if left else (v, c)
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / y), "==": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "&": (x != 0) & (y != 0), "|": (x != 0) | (y != 0)}[op]
    table = net.arcs if at_zero == 0 else T.dyads(net)
    return net.with_(edges=table.select("ego", "alter", value.cast("double").alias("value")).where("value is null or value <> 0"), directed=True)


def evaluate(expression: str, nets: Mapping[str, Network], condition: str | None = None) -> Network:
    """The resulting network, undirected if it is symmetric; ``condition`` keeps nodes afterwards."""

    def walk(x: ast.AST) -> Network | float:
        if isinstance(x, ast.Expression):
            return walk(x.body)
        if isinstance(x, ast.Constant) and isinstance(x.value, (int, float)):
            return float(x.value)
        if isinstance(x, ast.Name):
            if x.id in nets:
                net = nets[x.id]
                return net.with_(edges=net.arcs, directed=True)
            net = next(iter(nets.values()))
            if x.id == "_N":
                return float(net.n_nodes())
            if x.id == "_n":
                at = dense_ids(net.nodes).select("node", F.col("id").cast("double").alias("_n"))
                return net.with_(edges=T.expand(net.with_(nodes=at), "_n", "sender"), directed=True)
            for net in nets.values():
                if x.id in net.nodes.columns:
                    return net.with_(edges=T.expand(net, x.id, "sender"), directed=True)
            raise NetworkError(f"no network or attribute {x.id}")
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub):
            inner = walk(x.operand)
            return -inner if isinstance(inner, float) else _scalar(inner, -1.0, "*", True)
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and len(x.args) == 1:
            inner = walk(x.args[0])
            if isinstance(inner, float):
                raise NetworkError("functions take networks")
            if x.func.id == "t":
                return T.transpose(inner)
            if x.func.id == "sym":
                s = T.symmetrize(inner)
                return s.with_(edges=s.arcs, directed=True)
            if x.func.id not in _UNARY:
                raise NetworkError(f"unknown function {x.func.id}")
            table = T.dyads(inner) if x.func.id == "exp" else inner.arcs
            return inner.with_(edges=table.select("ego", "alter", _UNARY[x.func.id]("value").cast("double").alias("value")).where("value is null or value <> 0"))
        if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Pow):
            base, power = walk(x.left), walk(x.right)
            if isinstance(power, Network):
                raise NetworkError("the power must be a number")
            if isinstance(base, float):
                return base**power
            return base.with_(edges=base.arcs.select("ego", "alter", F.pow("value", F.lit(power)).alias("value")))
        if isinstance(x, ast.BinOp) and type(x.op) in _BINARY:
            op, a, b = _BINARY[type(x.op)], walk(x.left), walk(x.right)
        elif isinstance(x, ast.Compare) and len(x.ops) == 1 and type(x.ops[0]) in _BINARY:
            op, a, b = _BINARY[type(x.ops[0])], walk(x.left), walk(x.comparators[0])
        else:
            raise NetworkError(f"can't read {ast.dump(x)[:60]}")
        if isinstance(a, float) and isinstance(b, float):
            return _python(op, a, b)
        if isinstance(a, float) or isinstance(b, float):
            return _scalar(b, a, op, True) if isinstance(a, float) else _scalar(a, b, op, False)
        if not T.same_nodes(a, b):
            raise NetworkError("networks of different nodes")
        return a.with_(edges=T.combine(a, b, op), directed=True)

    out = walk(ast.parse(expression, mode="eval"))
    if isinstance(out, float):
        raise NetworkError("the expression has no network")
    if is_symmetric(out.edges):
        out = out.with_(edges=out.edges.where("ego <= alter"), directed=False)
    return T.keep_nodes(out, condition) if condition else out


def shortcut(name: str, net: Network, **options: object) -> Network | DataFrame:
    """A function of one network by its name: networks (duplicate, transpose, sym, permute, reach, geodesic, large, homophily)
    or node tables (degree, outdegree, indegree, isolates, components, lgc, clustering, between, closeness, farness, nearness,
    evcent, context). The degree of a directed network is out plus in."""
    from tiegraph.operators import generators, iterate, kernels, measures, structure

    one = lambda table, column, new=None: table.select("node", F.col(column).alias(new or name))
    made = lambda table: net.with_(edges=table.select("ego", "alter", F.col("value").cast("double").alias("value")), directed=True)
    functions = {
        "duplicate": lambda: net,
        "transpose": lambda: T.transpose(net),
        "sym": lambda: T.symmetrize(net, **options),
        "permute": lambda: T.permute(net, **options),
        "reach": lambda: made(iterate.reach(net).select(F.col("source").alias("ego"), F.col("node").alias("alter"), F.lit(1.0).alias("value"))),
        "geodesic": lambda: made(iterate.geodesics(net, **options).select(F.col("source").alias("ego"), F.col("node").alias("alter"), F.col("distance").alias("value"))),
        "large": lambda: T.keep_nodes(net.with_(nodes=net.nodes.join(iterate.largest_component(net).where("lgc = 1").select("node"), "node", "left_semi")), F.lit(True)),
        "homophily": lambda: generators.homophily(net, **options),
        "degree": lambda: one(measures.degree(net, binary=True, **options), "total"),
        "outdegree": lambda: one(measures.degree(net, binary=True, **options), "out"),
        "indegree": lambda: one(measures.degree(net, binary=True, **options), "in"),
        "isolates": lambda: one(measures.degree(net, binary=True), "isolate"),
        "components": lambda: one(iterate.components(net), "component"),
        "lgc": lambda: iterate.largest_component(net),
        "clustering": lambda: one(structure.clustering(net), "local"),
        "between": lambda: one(kernels.betweenness(net, **options), "betweenness"),
        "closeness": lambda: one(iterate.closeness(net, **options), "closeness"),
        "farness": lambda: one(iterate.closeness(net, **options), "farness"),
        "nearness": lambda: one(iterate.closeness(net, **options), "nearness"),
        "evcent": lambda: iterate.eigenvector(net, **options),
        "context": lambda: measures.context(net, **options),
    }
    if name not in functions:
        raise NetworkError(f"unknown function {name}")
    return functions[name]()
