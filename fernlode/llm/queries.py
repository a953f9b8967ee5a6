"""Queries of the training-data operators, with production parameters over the whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.llm import furniture, lookalike, neighbours, packing, residue, splitting, tokens, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _config(spark: SparkSession, sf_dir: str, key: str) -> dict:
    """One value of the config table, which has a fixed handful of rows."""
    row = _table(spark, sf_dir, "config").where(f"key = '{key}'").select("value").first()
    return json.loads(row[0]) if row and row[0] else {}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(_table(spark, sf_dir, "documents"))


def _both_tables(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    """Neighbours within vec_index (kind chunk) and within entities (kind entity)."""
    chunks = neighbours.nearest(_table(spark, sf_dir, "vec_index"), id_col="chunk_id", **settings)
    entities = neighbours.nearest(_table(spark, sf_dir, "entities"), id_col="id", **settings)
    return chunks.withColumn("kind", F.lit("chunk")).unionByName(entities.withColumn("kind", F.lit("entity")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _both_tables(spark, sf_dir, k=10, min_similarity=0.90)
    pair = (F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return near.select("kind", *pair).distinct()


def p2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every hundredth id, against all rows. 85 % of the cells and of
    their leaves are visited, as the neighbours of most vectors are hardly nearer than the rest."""
    k = _config(spark, sf_dir, "search").get("topK", 10)
    near = _both_tables(spark, sf_dir, k=k, queries="id % 100 = 0", trees=1, leaf_rows=2048, visit_share=0.85)
    return near.select("kind", "id", "neighbour", F.round("similarity", 6).alias("similarity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.pairs(variants.resolve(_table(spark, sf_dir, "entities")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = lookalike.readings(_table(spark, sf_dir, "entities"), "id", "name")
    documents = lookalike.readings(_table(spark, sf_dir, "documents"), "doc_id", "normalized_text")
    rows = entities.withColumn("kind", F.lit("entity")).unionByName(documents.withColumn("kind", F.lit("document")))
    return lookalike.same_reading_pairs(rows, ["kind"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.furniture_lines(_table(spark, sf_dir, "documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(_table(spark, sf_dir, "documents"))


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"tokenizer": "byte_bpe_50k", "capacityTokens": 2048} | _config(spark, sf_dir, "packing")
    documents = _table(spark, sf_dir, "documents")
    sizes = tokens.count_tokens(documents, tokenizer=settings["tokenizer"])
    return packing.pack_items(sizes, settings["capacityTokens"], n_items=documents.count())


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"tokenizer": "byte_bpe_50k", "limitTokens": 512, "overlapTokens": 64} | _config(
        spark, sf_dir, "splitting"
    )
    return splitting.split_texts(
        _table(spark, sf_dir, "documents"),
        settings["limitTokens"],
        settings["overlapTokens"],
        tokenizer=settings["tokenizer"],
    )


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_topk, p3_found, p4_found, p5_found, p6_ids, p7_bins, p8_pieces)}

SQL: dict[str, str] = {}
