"""Communities of a weighted graph by modularity: nodes move, communities become nodes, until nothing is gained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.session import materialize

#: Least rise of the modularity by two rounds, in which every node has one turn, for which moves go on.
LEAST_RISE = 1e-6


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) by the Louvain method as joins and aggregates; a community is named by its least node.

    edges: (a, b, weight), undirected, each pair once. In every round each node of one half, chosen
    by a hash that changes with the round, moves to the neighbouring community of highest gain;
    ties go to the lower label, so the result is the same on every run. Rounds go on until no node
    moves or the modularity stops rising. Then the communities are the nodes of a smaller graph, and
    so on until none of them merge. Self-loops and edges with a null end don't count. The state is
    written to the shared folder each round.
    """
    plain = edges.where("a is not null and b is not null").select("a", "b", F.col("weight").cast("double").alias("w"))
    arcs = plain.where("a != b").select(F.col("a").alias("node"), F.col("b").alias("near"), "w")
    arcs = materialize(arcs.unionByName(arcs.select(F.col("near").alias("node"), F.col("node").alias("near"), "w")), "arcs")
    nodes = plain.select(F.col("a").alias("node")).union(plain.select("b")).distinct()
    level = nodes.join(arcs.groupBy("node").agg(F.sum("w").alias("k")), "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"))
    level = materialize(level, "level")
    total = arcs.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    members = level.select("node", F.col("node").alias("community"))
    while total:
        settled = _settle(arcs, level.withColumn("community", F.col("node")), total)
        into = settled.select(F.col("node").alias("community"), F.col("community").alias("into"))
        members = materialize(members.join(into, "community").select("node", F.col("into").alias("community")), "members")
        merged = materialize(settled.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k")), "level")
        if merged.count() == level.count():
            break
        ends = settled.select("node", "community")
        joined = arcs.join(ends, "node").select(F.col("community").alias("c"), "near", "w")
        joined = joined.join(ends.withColumnRenamed("node", "near"), "near").where("c != community")
        arcs = materialize(joined.groupBy(F.col("c").alias("node"), F.col("community").alias("near")).agg(F.sum("w").alias("w")), "arcs")
        level = merged
    least = members.groupBy("community").agg(F.min("node").alias("least"))
    return members.join(least, "community").select("node", F.col("least").alias("community"))


def modularity(arcs: DataFrame, state: DataFrame, total: float) -> float:
    """Of arcs (node, near, w), each edge in both directions, and state (node, k, community)."""
    ends = state.select("node", "community")
    inside = arcs.join(ends, "node").join(ends.select(F.col("node").alias("near"), F.col("community").alias("other")), "near").where("community = other")
    within = inside.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = state.groupBy("community").agg(F.sum("k").alias("s")).agg(F.coalesce(F.sum(F.pow("s", 2)), F.lit(0.0))).first()[0]
    return within / total - squares / total**2


def _settle(arcs: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """state (node, k, community) after moves until nothing is gained; arcs without self-loops."""
    kept, most, still, r = state, modularity(arcs, state, total), 0, 0
    while True:
        sums = state.groupBy("community").agg(F.sum("k").alias("s"))
        to = arcs.join(state.select(F.col("node").alias("near"), "community"), "near").groupBy("node", "community").agg(F.sum("w").alias("w"))
        mine = state.select("node", "k", F.col("community").alias("own"))
        inside = F.col("community") == F.col("own")
        # staying counts as well where no neighbour is in the own community
        own = mine.join(sums.withColumnRenamed("community", "own"), "own").select("node", "k", "own", F.col("own").alias("community"), "s", F.lit(0.0).alias("w"))
        gain = to.join(sums, "community").join(mine, "node").select("node", "k", "own", "community", "s", "w").unionByName(own)
        rest = F.when(inside, F.col("s") - F.col("k")).otherwise(F.col("s"))
        value = F.round(F.col("w") - F.col("k") * rest / total, 9)
        best = gain.withColumn("value", value).groupBy("node").agg(
            F.max(F.struct("value", inside.cast("int").alias("stay"), (-F.col("community")).alias("c"))).alias("best")
        )
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        chosen = F.when(turn, -F.col("best.c")).otherwise(F.col("community"))
        moved = state.join(best, "node").select("node", "k", chosen.alias("community"), (chosen != F.col("community")).alias("moved"))
        moved = materialize(moved, "state")
        state, r = moved.drop("moved"), r + 1
        still = still + 1 if moved.where("moved").limit(1).count() == 0 else 0
        if still >= 2:
            return state
        if r % 2 == 0:
            now = modularity(arcs, state, total)
            if now <= most + LEAST_RISE:
                return state if now > most else kept
            kept, most = state, now
