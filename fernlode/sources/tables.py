"""Scans of a library's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Defaults of a library's search settings.
TOP_K, DISTANCE = 15, 0.7


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the library; columns and rows are pruned by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def setting(spark: SparkSession, folder: str, key: str) -> dict:
    """One value of config, which holds a fixed handful of rows; {} if it is missing or broken."""
    row = table(spark, folder, "config").where(f"key = '{key}'").select("value").first()
    try:
        value = json.loads(row[0]) if row and row[0] else {}
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}


def distance_threshold(config: dict, distance: float | None = None, similarity: float | None = None) -> float:
    """Largest cosine distance of a hit: as asked for, as distance or similarity, else as the
    settings say, distance before similarity, else DISTANCE."""
    given = (distance, similarity, config.get("distanceThreshold"), config.get("similarityThreshold"))
    for n, value in enumerate(given):
        if value is not None:
            return 1 - float(value) if n % 2 else float(value)
    return DISTANCE


def top_k(config: dict, asked: int | None = None) -> int:
    """Number of hits, asked for or set; one that is no whole number between 1 and 1000 is refused."""
    k = config.get("topK", TOP_K) if asked is None else asked
    if isinstance(k, bool) or not isinstance(k, (int, float)) or k != int(k) or not 1 <= k <= 1000:
        raise ValueError("topK must be an integer between 1 and 1000")
    return int(k)


def search_settings(spark: SparkSession, folder: str) -> dict:
    """topK and similarityThreshold of a library."""
    found = setting(spark, folder, "search")
    return {"topK": top_k(found), "similarityThreshold": round(1 - distance_threshold(found), 9)}


def features(found: dict) -> dict[str, bool]:
    """Which of graph, bm25 and mmr are on, under either of their names."""
    return {f: bool(found.get(f, found.get(f"{f}Enabled", False))) for f in ("graph", "bm25", "mmr")}
