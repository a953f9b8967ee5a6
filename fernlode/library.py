"""Libraries: versioned Parquet tables with incremental ingest, deletion and graph building.

A library is a folder <root>/<library_id>/<table>/v=<n>; the text file _CURRENT of a library names the
version of every table and is replaced in one step, so readers see old or new state, never a mix.
Work on rows is done by Spark; the driver handles paths and version numbers alone.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.functions import providers
from fernlode.operators import chunking, graph, lifecycle, ranking, vectors
from fernlode.session import materialize
from fernlode.sources import files, tables

SCHEMAS = {
    "documents": "doc_id long, path string, name string, fmt string, content_hash string, size long, text string, status string, "
    "error_message string, chunk_count int, graph_status string, created_at timestamp, updated_at timestamp",
    "chunks": "id long, document_id long, ordinal int, text string, title_path string, start_offset int, end_offset int",
    "vec_index": "chunk_id long, embedding array<float>",
    "entities": "id long, name string, type string, aliases_json string, embedding array<float>, graph_role string",
    "relations": "id long, source_entity_id long, relation string, target_entity_id long, source_chunk_id long",
    "chunk_entities": "chunk_id long, entity_id long",
    "graph_extract": "chunk_id long, status string, result string, attempts int, error_message string",
}
#: Settings with their defaults and, for numbers, ranges.
SETTINGS = {
    "topK": (15, 1, 1000), "similarityThreshold": (0.3, -1, 1), "chunkTargetLength": (400, 50, 10000), "chunkOverlap": (50, 0, 9999),
    "graph": (False,), "bm25": (False,), "mmr": (False,), "genericEntities": ([],),
}


class Library:
    """One library under a root folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, library_id: str, embedder: providers.Embedder = providers.hash_embedder):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", library_id):
            raise ValueError(f"not a library id: {library_id}")
        self.spark, self.folder, self.embedder = spark, f"{root.rstrip('/')}/{library_id}", embedder

    # paths on the driver, through Hadoop's file systems

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _state(self) -> dict:
        fs, p = self._fs(f"{self.folder}/_CURRENT")
        if not fs.exists(p):
            return {"tables": {}, "settings": {}, "requiresRebuild": False}
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _swap(self, state: dict) -> None:
        fs, p = self._fs(f"{self.folder}/_CURRENT")
        new = self._fs(f"{self.folder}/_NEXT-{uuid.uuid4().hex}")[1]
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.delete(p, False)
        if not fs.rename(new, p):
            raise OSError("the new state couldn't be put in place")

    def exists(self) -> bool:
        fs, p = self._fs(f"{self.folder}/_CURRENT")
        return fs.exists(p)

    def create(self) -> Library:
        if not self.exists():
            self._swap(self._state())
        return self

    def delete(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        """A table's current version, or that of a state; empty before the first write. Unknown columns are null."""
        version = (state or self._state())["tables"].get(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v={version}")

    def write(self, **tables: DataFrame) -> None:
        """New versions of some tables, visible at once when all are written."""
        self._publish(self._stage(self._state(), **tables))

    def _stage(self, state: dict, **tables: DataFrame) -> dict:
        """Writes new versions that nobody sees yet, and gives the state that names them."""
        state = {**state, "tables": dict(state["tables"])}
        for name, df in tables.items():
            version = uuid.uuid4().hex
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.table(name, state).schema]
            df.select(*columns).write.mode("error").parquet(f"{self.folder}/{name}/v={version}")
            state["tables"][name] = version
        return state

    def _publish(self, state: dict) -> None:
        """Puts a state in place and removes versions that neither it nor the one before names: who
        reads the one before can finish."""
        before = self._state()["tables"]
        self._swap(state)
        for name in state["tables"]:
            fs, folder = self._fs(f"{self.folder}/{name}")
            kept = {f"v={x[name]}" for x in (before, state["tables"]) if name in x}
            for entry in fs.listStatus(folder):
                if entry.getPath().getName() not in kept:
                    fs.delete(entry.getPath(), True)

    # settings

    def settings(self) -> dict:
        return {k: v[0] for k, v in SETTINGS.items()} | self._state()["settings"]

    def update_settings(self, **patch: float | bool | list) -> dict:
        """Takes known settings within their ranges and refuses all others, as a whole; a changed chunk
        size asks for a rebuild."""
        state = self._state()
        before = self.settings()
        for key, value in patch.items():
            if key not in SETTINGS:
                raise ValueError(f"unknown setting: {key}")
            default, *limits = SETTINGS[key]
            if limits:
                good = isinstance(value, (int, float)) and not isinstance(value, bool) and limits[0] <= value <= limits[1]
            else:
                good = isinstance(value, type(default))
            if not good:
                raise ValueError(f"out of range: {key}")
            state["settings"][key] = value
        after = before | state["settings"]
        if any(before[k] != after[k] for k in ("chunkTargetLength", "chunkOverlap")):
            state["requiresRebuild"] = True
        self._swap(state)
        return self.settings()

    # documents

    def ingest(self, *folders: str) -> dict[str, int]:
        """Files under the folders: new and changed ones are parsed, cut and embedded; those done
        with the same content are skipped; unreadable ones are recorded as failed."""
        return self.ingest_rows(files.scan_files(self.spark, *folders))

    def ingest_rows(self, scanned: DataFrame) -> dict[str, int]:
        old = {t: self.table(t) for t in SCHEMAS}
        offered = lifecycle.skip_unchanged(
            scanned.withColumn("content_hash", F.sha2("content", 256)), old["documents"]
        )
        fresh = offered.where("not skipped").drop("skipped", "content_hash").persist()
        total, taken = offered.count(), fresh.count()
        if not taken:
            fresh.unpersist()
            return {"offered": total, "skipped": total, "done": 0, "failed": 0}
        parsed = files.parse_files(fresh)
        known = old["documents"].select("path", F.col("doc_id").alias("old_id"), F.col("created_at").alias("old_at"))
        ok = F.col("error_message").isNull()
        docs = parsed.join(known, "path", "left").select(
            F.coalesce("old_id", self._fresh_id(old["documents"], "doc_id")).alias("doc_id"), "path", "name", "fmt", "content_hash", "size", "text",
            F.when(ok, "done").otherwise("failed").alias("status"), "error_message", F.lit("pending").alias("graph_status"),
            F.coalesce("old_at", F.current_timestamp()).alias("created_at"), F.current_timestamp().alias("updated_at"),
        )
        docs = materialize(docs, "documents")  # ids are settled before anything hangs on them
        fresh.unpersist()
        state = self._rechunk(self._state(), old, lifecycle.upsert(old["documents"], docs.withColumn("chunk_count", F.lit(0)), "path"), docs)
        self._publish(state)
        by = {r.status: r["count"] for r in docs.groupBy("status").count().collect()}
        return {"offered": total, "skipped": total - taken, "done": by.get("done", 0), "failed": by.get("failed", 0)}

    @staticmethod
    def _fresh_id(df: DataFrame, col: str) -> Column:
        """Numbers above all that df has, different for each row, without bringing the rows together."""
        return F.monotonically_increasing_id() + F.lit((df.agg(F.max(col)).first()[0] or 0) + 1)

    def _rechunk(self, state: dict, old: dict[str, DataFrame], stored: DataFrame, changed: DataFrame) -> dict:
        """The state with stored documents, of which the changed ones are cut and embedded anew."""
        limits = self.settings()
        step = max(1, int(limits["chunkTargetLength"] - limits["chunkOverlap"]))
        done = changed.where("status = 'done'")
        cut = chunking.chunk_documents(done, text_col="text", target=int(limits["chunkTargetLength"]), hard_step=step)
        cut = materialize(cut.withColumn("id", self._fresh_id(old["chunks"], "id")), "chunks")
        kept = lifecycle.cascade_delete(old, changed.select("doc_id"))
        counts = cut.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
        counted = stored.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("n", "chunk_count")).drop("n")
        embedded = providers.embed(cut, "id", "text", self.embedder).withColumnRenamed("id", "chunk_id")
        return self._stage(
            state, documents=counted, chunks=kept["chunks"].unionByName(cut), vec_index=kept["vec_index"].unionByName(embedded),
            **{t: kept[t] for t in ("chunk_entities", "graph_extract", "relations", "entities")},
        )

    def rebuild(self) -> int:
        """Cuts and embeds all done documents anew by the current settings; what was extracted from the
        old chunks goes. The number of chunks."""
        old = {t: self.table(t) for t in SCHEMAS}
        changed = old["documents"].where("status = 'done'")
        stored = old["documents"].withColumn("chunk_count", F.when(F.col("status") == "done", 0).otherwise(F.col("chunk_count")))
        stored = stored.withColumn("graph_status", F.when(F.col("status") == "done", "pending").otherwise(F.col("graph_status")))
        self._publish({**self._rechunk(self._state(), old, stored, changed), "requiresRebuild": False})
        return self.table("chunks").count()

    def resume(self) -> int:
        """After a run that was broken off: what was being worked on is pending again. The number of documents."""
        docs = self.table("documents")
        broken = docs.where("status = 'processing' or graph_status = 'processing'").count()
        if broken:
            self.write(documents=lifecycle.recover(docs))
        return broken

    def delete_document(self, path: str) -> bool:
        """Deletes a document and all that hangs on it; False if there is none."""
        tables = {t: self.table(t) for t in SCHEMAS}
        gone = tables["documents"].where(F.col("path") == path)
        if not gone.limit(1).count():
            return False
        self.write(**lifecycle.cascade_delete(tables, gone))
        return True

    def list_documents(self, page: int = 1, page_size: int = 25) -> DataFrame:
        if not (1 <= page <= 100_000 and 1 <= page_size <= 100):
            raise ValueError("page or page size out of range")
        docs = self.table("documents").drop("text").orderBy(F.desc("updated_at"), F.desc("doc_id"))
        return docs.offset((page - 1) * page_size).limit(page_size)

    # search

    def search(self, text: str, top_k: int | None = None, distance: float | None = None, similarity: float | None = None) -> DataFrame:
        """(chunk_id, score, sources, rank, text, title_path, name, similarity) of the best chunks.

        The settings mmr, bm25 and graph switch the diversity rerank, the keyword route and the
        chunks that hit entities append."""
        if not text.strip():
            raise ValueError("the query is empty")
        limits = self.settings()
        k = tables.top_k(limits, top_k)
        vector = [float(x) for x in self.embedder([text])[0]]
        asked = self.spark.createDataFrame([(0, text, vector)], "query_id long, query string, embedding array<float>")
        done = self.table("documents").where("status = 'done'").select(F.col("doc_id").alias("document_id"), "name")
        chunks = self.table("chunks").join(done, "document_id").withColumnRenamed("id", "chunk_id")
        rows = self.table("vec_index").join(chunks.select("chunk_id"), "chunk_id")
        least = 1 - tables.distance_threshold(limits, distance, similarity)
        near = vectors.cosine_top_k(rows, asked, 3 * k, "chunk_id", dim=len(vector), min_similarity=least)
        if limits["mmr"]:
            near = ranking.diversify(near.join(chunks.select("chunk_id", "document_id"), "chunk_id"), k, "query_id", "document_id")
        routes = {"vector": materialize(near, "vector")}
        if limits["bm25"]:
            words = ranking.bm25(chunks, asked, "chunk_id", "text", "query_id", "query")
            routes["bm25"] = ranking.ranked(words, "query_id", "score", "chunk_id", limit=3 * k)
        fused = ranking.fuse(routes, "query_id", "chunk_id", limit=k).select("chunk_id", "rank", "score", "sources")
        if limits["graph"]:
            fused = materialize(fused, "main")
            kept = self.table("entities").where("graph_role = 'keep'").select(F.col("id").alias("entity_id"), "embedding")
            hits = vectors.cosine_top_k(kept, asked, ranking.ENTITY_HITS, "entity_id", dim=len(vector), min_similarity=ranking.ENTITY_SIMILARITY)
            counts = ranking.graph_route(hits.select("query_id", "entity_id"), self.table("relations"), self.table("chunk_entities"), "query_id")
            fresh = counts.join(chunks.select("chunk_id"), "chunk_id", "left_semi").join(fused.select("chunk_id"), "chunk_id", "left_anti")
            tail = ranking.ranked(fresh, "query_id", F.desc("n"), "chunk_id", limit=ranking.APPENDED)
            tail = tail.select("chunk_id", (F.col("rank") + k).alias("rank"), F.lit(None).cast("double").alias("score"), F.lit("graph").alias("sources"))
            fused = fused.unionByName(tail)
        similar = routes["vector"].select("chunk_id", "similarity")
        return fused.join(chunks.select("chunk_id", "text", "title_path", "name"), "chunk_id").join(similar, "chunk_id", "left").orderBy("rank")

    # graph

    def build_graph(self, extractor: providers.Extractor = providers.rule_extractor, retry_failed: bool = True) -> None:
        """Extracts what is pending, merges names with their aliases, and replaces the graph."""
        tables = {t: self.table(t) for t in SCHEMAS}
        todo = graph.pending_chunks(tables["chunks"], tables["documents"], tables["graph_extract"], retry_failed)
        texts = tables["chunks"].join(todo.select("id"), "id", "left_semi")
        done = providers.extract(texts, "id", "text", extractor)
        self.write(graph_extract=lifecycle.upsert(tables["graph_extract"], done, "chunk_id"))
        generic = tuple(self.settings()["genericEntities"])
        found = materialize(graph.mentions(self.table("graph_extract")), "mentions")
        parts = materialize(graph.components_of(found), "parts")
        merged = graph.canonical(found, parts, tables["chunks"], generic).where("role != 'drop'")
        entities = merged.select(
            (F.monotonically_increasing_id() + 1).alias("id"), "entity", "name", "type", F.to_json("aliases").alias("aliases_json"),
            F.col("role").alias("graph_role"), F.concat_ws(" ", "name", F.array_join("aliases", " ")).alias("said"),
        )
        entities = materialize(entities, "entities")  # settles the ids
        named = parts.join(entities.select("entity", "id", "graph_role"), "entity")
        members = found.join(named, "norm").select("chunk_id", F.col("id").alias("entity_id")).distinct()
        kept = named.where("graph_role = 'keep'")
        relations = (
            graph.relations_of(self.table("graph_extract"))
            .join(kept.select(F.col("norm").alias("s"), F.col("id").alias("source_entity_id")), "s")
            .join(kept.select(F.col("norm").alias("o"), F.col("id").alias("target_entity_id")), "o")
            .where("source_entity_id != target_entity_id")
            .select((F.monotonically_increasing_id() + 1).alias("id"), "source_entity_id", F.col("predicate").alias("relation"), "target_entity_id", F.col("chunk_id").alias("source_chunk_id"))
        )
        vectors_ = providers.embed(entities, "id", "said", self.embedder)
        self.write(entities=entities.drop("entity", "said").join(vectors_, "id", "left"), relations=relations, chunk_entities=members)

    def clean_entities(self) -> dict[str, int]:
        """Applies the rules of names to the stored entities: dropped ones go with their memberships
        and relations, weak ones lose their relations."""
        t = {n: self.table(n) for n in ("entities", "chunk_entities", "relations", "chunks")}
        titles = t["chunks"].select(F.col("id").alias("chunk_id"), F.coalesce("title_path", F.lit("")).alias("title"))
        meta = t["chunk_entities"].join(titles, "chunk_id").groupBy(F.col("entity_id").alias("id")).agg(graph.only_metadata(F.col("title")).alias("meta"))
        role = graph.classify(F.col("name"), F.coalesce("meta", F.lit(False)), tuple(self.settings()["genericEntities"]))
        roles = materialize(t["entities"].join(meta, "id", "left").select("id", role.alias("role")), "roles")
        gone, bad = roles.where("role = 'drop'").select("id"), roles.where("role != 'keep'").select("id")
        relations = t["relations"]
        for end in ("source_entity_id", "target_entity_id"):
            relations = relations.join(bad.withColumnRenamed("id", end), end, "left_anti")
        weak = roles.where("role = 'weak'").select("id", F.lit("weak").alias("now"))
        entities = t["entities"].join(gone, "id", "left_anti").join(weak, "id", "left").withColumn("graph_role", F.coalesce("now", "graph_role")).drop("now")
        members = t["chunk_entities"].join(gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
        self.write(entities=entities, relations=relations, chunk_entities=members)
        by = {r.role: r["count"] for r in roles.groupBy("role").count().collect()}
        return {"dropped": by.get("drop", 0), "weakened": by.get("weak", 0), "total": sum(by.values())}

    def local_view(self, entity_id: int) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) around an entity, within the limits of a view."""
        center = self.spark.createDataFrame([(entity_id,)], "id long")
        edges = graph.local_edges(self.table("relations"), center)
        names = self.table("entities").select(F.col("id").alias("entity_id"), "name", "type")
        return graph.local_nodes(edges).drop("center").join(names, "entity_id").orderBy("rank"), edges.drop("center", "nth")

    def graph_stats(self) -> dict[str, int]:
        entities, relations = self.table("entities"), self.table("relations")
        return {
            "entities": entities.count(),
            "relations": relations.count(),
            "unique_edges": graph.edge_weights(relations).count(),
            "isolated": graph.isolated(entities, relations).count(),
        }
