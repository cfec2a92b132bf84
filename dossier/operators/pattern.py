"""Fixed-chain pattern matching over the graph: one equi-join a hop, scope applied to every node.

    match(nodes, edges, scope, [Node("a", "Person"), Edge("e", "CALLED"), Node("b"), Edge("f"), Node("c")])

gives a DataFrame with columns a_key, a_value, ..., e_edge_type, ...; where, select, groupBy, orderBy are Spark's own.
A later chain may name a node of an earlier one again, which joins the chains on it. There is no variable length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = ("key", "case_id", "node_type", "value", "normalized", "confidence")
EDGE_COLUMNS = ("edge_id", "edge_type", "confidence", "valid_from", "evidence_id")
MOST_ROWS = 100


@dataclass(frozen=True)
class Node:
    name: str
    node_type: str | None = None
    equals: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    name: str
    edge_type: str | None = None
    directed: bool = True
    reverse: bool = False
    equals: dict = field(default_factory=dict)


def _nodes(nodes: DataFrame, scope: DataFrame | None, n: Node) -> DataFrame:
    from dossier.sources.domain import NODE_TYPES

    if n.node_type is not None:
        if n.node_type not in NODE_TYPES:
            raise ValueError(f"unknown node type: {n.node_type}")
        nodes = nodes.filter(F.col("node_type") == n.node_type)
    for k, v in n.equals.items():
        nodes = nodes.filter(F.col(k) == v)
    if scope is not None:
        nodes = nodes.join(scope, "case_id", "left_semi")
    return nodes.select(*[F.col(c).alias(f"{n.name}_{c}") for c in NODE_COLUMNS])


def _edges(edges: DataFrame, e: Edge) -> DataFrame:
    from dossier.sources.domain import EDGE_TYPES

    if e.edge_type is not None:
        if e.edge_type not in EDGE_TYPES:
            raise ValueError(f"unknown edge type: {e.edge_type}")
        edges = edges.filter(F.col("edge_type") == e.edge_type)
    for k, v in e.equals.items():
        edges = edges.filter(F.col(k) == v)
    edges = edges.withColumn("edge_id", F.concat_ws("->", "src", "edge_type", "dst"))
    cols = [F.col(c).alias(f"{e.name}_{c}") for c in EDGE_COLUMNS]
    ahead = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), *cols)
    back = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *cols)
    if not e.directed:
        return ahead.unionByName(back.filter("_from <> _to"))
    return back if e.reverse else ahead


def _unconnected(node: Node) -> DataFrame:
    raise ValueError(f"a chain must start at a node matched before, or at the first: {node.name}")


def match(nodes: DataFrame, edges: DataFrame, scope: DataFrame | None, *chains: list) -> DataFrame:
    """Rows for all ways the chains occur; an edge is used at most once in a row."""
    out: DataFrame | None = None
    seen: list[str] = []
    used: list[str] = []
    for chain in chains:
        if len(chain) % 2 == 0 or not all(isinstance(x, (Node, Edge)[i % 2]) for i, x in enumerate(chain)):
            raise ValueError("a chain is node, edge, node, ...")
        for i in range(0, len(chain), 2):
            node = chain[i]
            if i == 0:
                if node.name in seen:
                    continue
                first = _nodes(nodes, scope, node)
                out = first if out is None else _unconnected(node)
                seen.append(node.name)
                continue
            edge, before = chain[i - 1], chain[i - 2]
            out = out.join(_edges(edges, edge), F.col(f"{before.name}_key") == F.col("_from")).drop("_from")
            for other in used:
                out = out.filter(F.col(f"{edge.name}_edge_id") != F.col(f"{other}_edge_id"))
            used.append(edge.name)
            if node.name in seen:
                out = out.filter(F.col(f"{node.name}_key") == F.col("_to")).drop("_to")
            else:
                out = out.join(_nodes(nodes, scope, node), F.col("_to") == F.col(f"{node.name}_key")).drop("_to")
                seen.append(node.name)
    if out is None:
        raise ValueError("no chain")
    return out


def shaped(rows: DataFrame) -> DataFrame:
    """(kind, id): the distinct nodes and edges that occur in matched rows."""
    nodes = [c for c in rows.columns if c.endswith("_key")]
    edges = [c for c in rows.columns if c.endswith("_edge_id")]
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, cols in (("node", nodes), ("edge", edges)) for c in cols])
    return rows.select(F.inline(each)).filter("id is not null").distinct()
