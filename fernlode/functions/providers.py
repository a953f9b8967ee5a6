"""Providers that a library calls on its texts: embedding and extraction.

The defaults are deterministic and need no network; a remote service is passed as a function of the
same kind.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of texts to a matrix of vectors; a text to a record of entities and relations as JSON.
Embedder = Callable[[list[str]], np.ndarray]
Extractor = Callable[[str], str]


def hash_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed character trigrams."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in enumerate(texts):
        low = text.lower()
        for k in range(max(1, len(low) - 2)):
            h = int.from_bytes(hashlib.blake2b(low[k : k + 3].encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
            out[row, h % dim] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def rule_extractor(text: str) -> str:
    """Capitalised names and codes of a text as entities, neighbours as related."""
    names = list(dict.fromkeys(re.findall(r"\b[A-Z][\w-]+(?: [A-Z][\w-]+)+|\b[A-Z]{2,}-?\d{2,}", text)))[:8]
    entities = [{"name": n, "type": "concept", "aliases": []} for n in names]
    relations = [{"subject": a, "predicate": "near", "object": b} for a, b in zip(names, names[1:])]
    return json.dumps({"entities": entities, "relations": relations}, ensure_ascii=False)


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder = hash_embedder, batch: int = 16) -> DataFrame:
    """(id_col, embedding) in batches of texts; null texts get none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[np.ndarray] = []
            for a in range(0, len(pdf), batch):
                texts = pdf["text"].iloc[a : a + batch].tolist()
                got = np.asarray(embedder(texts), np.float32)
                if len(got) != len(texts):
                    raise ValueError(f"the embedder gave {len(got)} vectors for {len(texts)} texts")
                vectors += list(got)
            yield pd.DataFrame({"id": pdf["id"], "embedding": vectors})

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, embedding array<float>").withColumnRenamed("id", id_col)


def extract(df: DataFrame, id_col: str, text_col: str, extractor: Extractor = rule_extractor, attempts: int = 3) -> DataFrame:
    """(chunk_id, status, result, attempts, error_message): each text with up to `attempts` tries."""

    def one(text: str) -> tuple[str, str | None, int, str | None]:
        message = None
        for n in range(1, attempts + 1):
            try:
                return "ok", extractor(text), n, None
            except Exception as e:  # recorded; the text may be tried again later
                message = str(e)[:200]
        return "failed", None, attempts, message

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *one(t)) for i, t in zip(pdf["id"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["chunk_id", "status", "result", "attempts", "error_message"])

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "chunk_id long, status string, result string, attempts int, error_message string")
