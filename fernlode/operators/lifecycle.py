"""State of documents: skipping, upserts, cascades and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "processing", "done", "failed")


def status_counts(docs: DataFrame, col: str = "status") -> DataFrame:
    """(status, n) with all four states, missing ones as 0."""
    states = docs.sparkSession.createDataFrame([(s,) for s in STATES], f"{col} string")
    counts = docs.groupBy(col).agg(F.count("*").alias("n"))
    return states.join(counts, col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def recover(docs: DataFrame) -> DataFrame:
    """What was being worked on when a run ended is pending again."""
    out = docs
    for col in ("status", "graph_status"):
        out = out.withColumn(col, F.when(F.col(col) == "processing", "pending").otherwise(F.col(col)))
    return out


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the first in the order: the state after upserts."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_nth", rank).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new put in place of those with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def skip_unchanged(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (path, content_hash) with `skipped`: done already with the same content."""
    known = stored.where("status = 'done'").select("path", "content_hash", F.lit(True).alias("skipped")).distinct()
    return incoming.join(known, ["path", "content_hash"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def endpoints(relations: DataFrame) -> DataFrame:
    """(entity_id): both ends of all relations; the two-sided condition of a join becomes one."""
    both = relations.select(F.col("source_entity_id").alias("entity_id")).unionByName(
        relations.select(F.col("target_entity_id").alias("entity_id"))
    )
    return both.where("entity_id is not null").distinct()


def orphans(entities: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities in no chunk and in no relation."""
    held = members.select(F.col("entity_id").alias("id")).distinct()
    tied = endpoints(relations).withColumnRenamed("entity_id", "id")
    return entities.join(held, "id", "left_anti").join(tied, "id", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents of gone (doc_id) and all that hangs on them.

    Chunks, vectors, memberships, extraction records and relations of a deleted chunk go, then the
    entities that were in such a chunk or relation and are orphans now.
    """
    gone = gone.select("doc_id").distinct()
    chunks = tables["chunks"].join(gone.withColumnRenamed("doc_id", "document_id"), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    out = {"documents": tables["documents"].join(gone, "doc_id", "left_anti")}
    out["chunks"] = tables["chunks"].join(chunks.withColumnRenamed("chunk_id", "id"), "id", "left_anti")
    for name in ("vec_index", "chunk_entities", "graph_extract"):
        out[name] = tables[name].join(chunks, "chunk_id", "left_anti")
    out["relations"] = tables["relations"].join(chunks.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id", "left_anti")
    lost = orphans(tables["entities"], out["chunk_entities"], out["relations"]).select("id")
    out["entities"] = tables["entities"].join(lost, "id", "left_anti")
    return out
