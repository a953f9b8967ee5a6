"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.session import materialize

#: Edges up to which one task finds the components; some 30 MB there.
FEW_EDGES = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node of the component; a node without an edge has no row.

    Edges with a null end are dropped, self-loops give components of one node, repeated edges
    change nothing. Every round takes the least label among the neighbours and then the label's
    own label, so chains shrink by half and more; the state is written to the shared folder each
    round, which cuts the lineage. Rows, never whole components, are grouped.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialize(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels, both.x == labels.node).groupBy("y").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.y, "left").select(
            "node", "label", F.least("label", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = materialize(
            low.join(jump, "low", "left").select("node", F.col("label").alias("old"), F.least("low", "far").alias("label")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("old != label").isEmpty():
            return labels


def _least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """connected_components() of all edges (a, b) of a task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for pdf in batches:
        for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "label": pd.Series([root(x) for x in nodes], dtype="int64")})


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links (a, b) between labels, which must be those of all nodes; the same
    DataFrame if no link joins two of them.

    Only the links go through components again, not all edges that the labels came from. Up to
    FEW_EDGES of them are one query instead of several a round: what the driver holds for
    queries, their threads and their compiled code, follows their number and not the rows.
    """
    links = materialize(links.where("a != b").distinct(), "links")
    n = links.count()
    if n == 0:
        return labels
    few = n <= FEW_EDGES
    comps = links.coalesce(1).mapInPandas(_least, "node long, label long") if few else connected_components(links)
    to = comps.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialize(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
