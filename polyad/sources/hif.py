"""Hypergraph interchange JSON: reading and writing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.errors import BadInput
from polyad.operators.hypergraph import Hypergraph

_ITEM = "attrs map<string,string>, weight double"
_SCHEMA = f"`network-type` string, metadata map<string,string>, incidences array<struct<edge:string, node:string, weight:double, attrs:map<string,string>>>, nodes array<struct<node:string, {_ITEM.replace(' map', ':map').replace(' double', ':double')}>>, edges array<struct<edge:string, {_ITEM.replace(' map', ':map').replace(' double', ':double')}>>"


def read_hif(spark: SparkSession, path: str) -> Hypergraph:
    """A hypergraph from HIF files. A missing weight is 1; directed networks, zero weights and repeated
    incidences are refused."""
    doc = spark.read.schema(_SCHEMA).json(path, multiLine=True)
    if doc.where("`network-type` is not null and `network-type` <> 'undirected'").limit(1).count():
        raise BadInput("only undirected networks are read")
    m = doc.select(F.explode("incidences").alias("x")).select("x.node", "x.edge", F.coalesce("x.weight", F.lit(1.0)).alias("weight"))
    bad = m.groupBy("node", "edge").agg(F.count(F.lit(1)).alias("n"), F.min(F.abs("weight")).alias("w")).where("n > 1 or w = 0 or node is null or edge is null")
    if bad.limit(1).count():
        raise BadInput("an incidence is repeated, has weight zero or lacks an id")
    nodes = doc.select(F.explode("nodes").alias("x")).select("x.node", "x.attrs")
    edges = doc.select(F.explode("edges").alias("x")).select("x.edge", F.col("x.weight").alias("edge_weight"), "x.attrs")
    return Hypergraph(m, edges, nodes)


def write_hif(h: Hypergraph, path: str) -> None:
    """One HIF document, written as rows arrive, a partition at a time on the driver. Weights of 1
    throughout are left out."""
    plain = not h.memberships.where("weight <> 1").limit(1).count()

    def rows(key: str, table: DataFrame):
        if key == "incidences":
            for r in table.orderBy("edge", "node").toLocalIterator():
                yield {"edge": r["edge"], "node": r["node"]} | ({} if plain else {"weight": r["weight"]})
            return
        name, cols = key[:-1], table.columns
        for r in table.orderBy(name).toLocalIterator():
            yield {name: r[name]} | ({"weight": r["edge_weight"]} if "edge_weight" in cols and r["edge_weight"] is not None else {}) | ({"attrs": r["attrs"]} if "attrs" in cols and r["attrs"] else {})

    with open(path, "w") as f:
        f.write('{"network-type": "undirected", "metadata": {}')
        for key, table in (("incidences", h.memberships), ("nodes", h.nodes), ("edges", h.edges)):
            if table is not None:
                f.write(f', "{key}": [')
                for i, r in enumerate(rows(key, table)):
                    f.write((", " if i else "") + json.dumps(r))
                f.write("]")
        f.write("}")


def write_hif_rows(m: DataFrame, path: str) -> None:
    """Incidences as JSON lines, for any size."""
    m.select("edge", "node", "weight").write.json(path)
