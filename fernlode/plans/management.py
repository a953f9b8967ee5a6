"""Queries of library management: states, pages, upserts, cascades, settings and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.functions import text as tx
from fernlode.operators import lifecycle
from fernlode.plans.registry import query
from fernlode.sources.tables import setting, table

_COUNT = "count(*) FILTER (WHERE status = '{s}') AS {s}"


@query(
    "SELECT count(*) AS total, " + ", ".join(_COUNT.format(s=s) for s in lifecycle.STATES) + ", "
    "coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM documents"
)
def library_status_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.agg(
        F.count("*").alias("total"),
        *(F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(s) for s in lifecycle.STATES),
        F.coalesce(F.sum(F.col("chunk_count").cast("long")), F.lit(0)).alias("chunks"),
    )


@query(
    "SELECT s AS status, count(d.doc_id) AS n FROM (SELECT unnest(['pending', 'processing', 'done', 'failed']) AS s) "
    "LEFT JOIN documents d ON d.status = s GROUP BY s"
)
def status_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.status_counts(table(spark, d, "documents"))


@query(
    "SELECT s AS graph_status, count(d.doc_id) AS n FROM (SELECT unnest(['pending', 'processing', 'done', 'failed']) AS s) "
    "LEFT JOIN documents d ON d.graph_status = s AND d.status = 'done' GROUP BY s"
)
def graph_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.status_counts(table(spark, d, "documents").where("status = 'done'"), "graph_status")


@query(
    """SELECT doc_id, path, name, status, chunk_count, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated,
  row_number() OVER (ORDER BY updated_at DESC NULLS LAST, doc_id DESC) AS nth, (SELECT count(*) FROM documents) AS total,
  (SELECT ceil(count(*) / 25)::BIGINT FROM documents) AS pages FROM documents ORDER BY updated_at DESC NULLS LAST, doc_id DESC LIMIT 25 OFFSET 25"""
)
def document_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 25 rows."""
    docs = table(spark, d, "documents")
    order = (F.desc_nulls_last("updated_at"), F.desc("doc_id"))
    page = docs.select("doc_id", "path", "name", "status", "chunk_count", "updated_at").orderBy(*order).offset(25).limit(25)
    total = docs.agg(F.count("*").alias("total"))
    # numbered within the page; a page has 25 rows at most
    numbered = page.agg(F.sort_array(F.collect_list(F.struct(F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(1 << 62)), -F.col("doc_id"), "doc_id", "path", "name", "status", "chunk_count", "updated_at"))).alias("rows"))
    out = numbered.select(F.posexplode("rows").alias("p", "r")).crossJoin(total)
    return out.select(
        *(F.col(f"r.{c}").alias(c) for c in ("doc_id", "path", "name", "status", "chunk_count")),
        F.date_format("r.updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"),
        (F.col("p") + 26).cast("long").alias("nth"),
        "total",
        F.ceil(F.col("total") / 25).alias("pages"),
    )


@query(
    """SELECT d.doc_id, count(c.id) AS chunks, count(c.id) FILTER (WHERE ok) AS covered,
  CASE WHEN count(c.id) FILTER (WHERE ok) = count(c.id) THEN 'done' ELSE 'failed' END AS graph_state,
  CASE WHEN count(c.id) FILTER (WHERE ok) = count(c.id) THEN NULL ELSE 'graph has uncovered chunks' END AS note
FROM documents d LEFT JOIN chunks c ON c.document_id = d.doc_id
LEFT JOIN (SELECT DISTINCT chunk_id, true AS ok FROM graph_extract WHERE status = 'ok') g ON g.chunk_id = c.id
WHERE d.status = 'done' GROUP BY d.doc_id"""
)
def graph_status_by_doc(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("status = 'done'").select("doc_id")
    ok = table(spark, d, "graph_extract").where("status = 'ok'").select(F.col("chunk_id").alias("id")).distinct()
    chunks = table(spark, d, "chunks").select("id", F.col("document_id").alias("doc_id"))
    per = chunks.join(ok.withColumn("ok", F.lit(True)), "id", "left").groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("ok")).alias("covered")
    )
    out = docs.join(per, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "covered")))
    whole = F.col("chunks") == F.col("covered")
    return out.withColumn("graph_state", F.when(whole, "done").otherwise("failed")).withColumn(
        "note", F.when(~whole, "graph has uncovered chunks")
    )


@query("SELECT document_id, count(*) AS chunks, count(*) >= 8 AS dominant FROM chunks GROUP BY document_id")
def dominant_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("document_id").agg(F.count("*").alias("chunks")).withColumn("dominant", F.col("chunks") >= 8)


@query("SELECT content_hash, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT path) AS paths FROM documents GROUP BY content_hash HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "documents").groupBy("content_hash").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.countDistinct("path").alias("paths")
    )
    return grouped.where("copies > 1")


@query(
    """SELECT i.doc_id, i.path, i.content_hash, (SELECT count(*) FROM documents s WHERE s.status = 'done' AND s.path = i.path
  AND s.content_hash = i.content_hash) > 0 AS skipped FROM (SELECT doc_id, path, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL) i"""
)
def content_hash_skip(spark: SparkSession, d: str) -> DataFrame:
    """Every document is offered again: what is done with the same content is skipped."""
    docs = table(spark, d, "documents")
    incoming = docs.where("text is not null").select("doc_id", "path", F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash"))
    return lifecycle.skip_unchanged(incoming, docs).select("doc_id", "path", "content_hash", "skipped")


@query(
    """SELECT chunk_id, status, attempts, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated, result IS NULL AS empty FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, attempts DESC NULLS LAST, status, result NULLS LAST) AS nth
  FROM graph_extract) WHERE nth = 1"""
)
def latest_extract(spark: SparkSession, d: str) -> DataFrame:
    order = (F.desc_nulls_last("updated_at"), F.desc_nulls_last("attempts"), F.asc("status"), F.asc_nulls_last("result"))
    out = lifecycle.latest(table(spark, d, "graph_extract"), "chunk_id", *order)
    return out.select(
        "chunk_id", "status", "attempts", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.col("result").isNull().alias("empty")
    )


_TABLES = ("documents", "chunks", "vec_index", "chunk_entities", "graph_extract", "relations", "entities")


@query(
    """WITH gone AS (SELECT doc_id FROM documents WHERE status = 'failed' OR doc_id % 3 = 0),
gc AS (SELECT id FROM chunks WHERE document_id IN (SELECT doc_id FROM gone)),
ce AS (SELECT * FROM chunk_entities WHERE chunk_id NOT IN (SELECT id FROM gc)),
re AS (SELECT * FROM relations WHERE source_chunk_id IS NULL OR source_chunk_id NOT IN (SELECT id FROM gc)),
lost AS (SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM ce WHERE entity_id IS NOT NULL)
  AND id NOT IN (SELECT source_entity_id FROM re WHERE source_entity_id IS NOT NULL) AND id NOT IN (SELECT target_entity_id FROM re WHERE target_entity_id IS NOT NULL))
SELECT 'documents' AS tab, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)) AS n
UNION ALL SELECT 'chunks', (SELECT count(*) FROM chunks WHERE id NOT IN (SELECT id FROM gc))
UNION ALL SELECT 'vec_index', (SELECT count(*) FROM vec_index WHERE chunk_id NOT IN (SELECT id FROM gc))
UNION ALL SELECT 'chunk_entities', (SELECT count(*) FROM ce)
UNION ALL SELECT 'graph_extract', (SELECT count(*) FROM graph_extract WHERE chunk_id NOT IN (SELECT id FROM gc))
UNION ALL SELECT 'relations', (SELECT count(*) FROM re)
UNION ALL SELECT 'entities', (SELECT count(*) FROM entities WHERE id NOT IN (SELECT id FROM lost))"""
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table when failed documents, and every third one, are deleted."""
    tables = {t: table(spark, d, t) for t in _TABLES}
    left = lifecycle.cascade_delete(tables, tables["documents"].where("status = 'failed' or doc_id % 3 = 0"))
    counts = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n") for t in _TABLES]
    return reduce(DataFrame.unionByName, counts)


@query(
    """SELECT id, name FROM entities WHERE id NOT IN (SELECT entity_id FROM chunk_entities WHERE entity_id IS NOT NULL)
  AND id NOT IN (SELECT source_entity_id FROM relations WHERE source_entity_id IS NOT NULL)
  AND id NOT IN (SELECT target_entity_id FROM relations WHERE target_entity_id IS NOT NULL)"""
)
def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    out = lifecycle.orphans(table(spark, d, "entities"), table(spark, d, "chunk_entities"), table(spark, d, "relations"))
    return out.select("id", "name")


@query(
    """SELECT CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status,
  CASE WHEN graph_status = 'processing' THEN 'pending' ELSE graph_status END AS graph_status, count(*) AS n FROM documents GROUP BY 1, 2"""
)
def crash_recovery(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.recover(table(spark, d, "documents")).groupBy("status", "graph_status").agg(F.count("*").alias("n"))


@query(
    """SELECT c.key, j.key AS setting, j.value::VARCHAR AS value FROM config c, json_each(c.value::JSON) j"""
)
def config_settings(spark: SparkSession, d: str) -> DataFrame:
    flat = F.from_json("value", "map<string,string>")
    return table(spark, d, "config").select("key", F.explode(flat).alias("setting", "plain")).select(
        "key",
        "setting",
        F.when(F.col("plain").rlike(r"^(-?[0-9.]+|true|false)$"), F.col("plain"))
        .otherwise(F.concat(F.lit('"'), F.col("plain"), F.lit('"')))
        .alias("value"),
    )


@query(
    """WITH i AS (SELECT coalesce(max(value->>'provider'), '') AS provider, coalesce(max(value->>'model'), '') AS model, coalesce(max((value->>'dimensions')::INT), 0) AS dims FROM config WHERE key = 'index'),
asked(provider, model, dims) AS (VALUES ('local', 'kb-embed-64', 64), ('local', 'kb-embed-128', 64), ('remote', 'kb-embed-64', 64), ('local', 'kb-embed-64', 128), ('local', 'kb-embed-64', 0)),
sizes AS (SELECT coalesce(len(embedding), 0) AS found, count(*) AS n FROM vec_index GROUP BY 1)
SELECT a.provider, a.model, a.dims, CASE WHEN i.model = '' THEN 'empty' WHEN i.model != a.model OR i.provider != a.provider THEN 'model differs'
  WHEN a.dims != 0 AND i.dims != 0 AND a.dims != i.dims THEN 'dimensions differ' ELSE 'ok' END AS verdict,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM sizes WHERE found = i.dims) AS fitting FROM asked a, i"""
)
def fingerprint_check(spark: SparkSession, d: str) -> DataFrame:
    """What a search with a given embedding service is told about the index, and how many vectors have the index's length."""
    index = setting(spark, d, "index")
    services = [("local", "kb-embed-64", 64), ("local", "kb-embed-128", 64), ("remote", "kb-embed-64", 64), ("local", "kb-embed-64", 128), ("local", "kb-embed-64", 0)]
    rows = [(*s, tx.fingerprint(index, *s) or "ok") for s in services]
    fitting = table(spark, d, "vec_index").agg(F.count_if(F.size("embedding") == F.lit(int(index.get("dimensions") or 0))).alias("fitting"))
    told = spark.createDataFrame(rows, "provider string, model string, dims int, verdict string")
    return told.crossJoin(F.broadcast(fitting))  # one row


_SQL_MAPPED = """CASE WHEN error_message IS NULL THEN NULL WHEN contains(error_message, 'not declared in manifest') THEN 'service not allowed'
  WHEN contains(error_message, 'fetch failed') OR contains(error_message, 'ENOTFOUND') THEN 'service unreachable'
  WHEN regexp_matches(error_message, 'embedding|api key|config', 'i') THEN 'embedding not configured' ELSE error_message END"""


@query(f"SELECT {_SQL_MAPPED} AS reason, count(*) AS n FROM documents GROUP BY 1")
def error_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(tx.error_reason(F.col("error_message")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, fmt, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))
  WHEN 'md' THEN 'Markdown' WHEN 'txt' THEN 'Text' WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'Word' ELSE 'File' END AS label, count(*) AS n
  FROM documents GROUP BY 1, 2, 3"""
)
def file_type_labels(spark: SparkSession, d: str) -> DataFrame:
    ext = tx.extension(F.col("path"))
    return table(spark, d, "documents").groupBy(ext.alias("ext"), "fmt", tx.file_label(ext).alias("label")).agg(F.count("*").alias("n"))


@query(
    """SELECT DISTINCT source, CASE WHEN trim(source) = '' THEN NULL WHEN regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$') THEN source
  ELSE 'kb-' || substr(sha256(source), 1, 16) END AS library_id FROM documents WHERE source IS NOT NULL"""
)
def safe_library_id(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").where("source is not null").select("source").distinct()
    return names.withColumn("library_id", tx.library_id(F.col("source")))


@query(
    """SELECT (SELECT strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') FROM (SELECT updated_at FROM documents ORDER BY updated_at DESC NULLS LAST, doc_id DESC LIMIT 25)) AS last_change,
  (SELECT bool_or(status IN ('pending', 'processing')) FROM documents) AS busy"""
)
def library_label(spark: SparkSession, d: str) -> DataFrame:
    """Last change among the documents of the first page as it is listed, and whether any document is at work."""
    docs = table(spark, d, "documents")
    page = docs.select("updated_at", "doc_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("doc_id")).limit(25)
    last = page.agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("last_change"))
    return last.crossJoin(docs.agg(F.bool_or(F.col("status").isin("pending", "processing")).alias("busy")))  # one row each


@query("SELECT doc_id, strftime(updated_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM documents")
def local_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.date_format(F.from_utc_timestamp("updated_at", "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss").alias("local_time")
    )


@query(
    """SELECT source, count(*) AS documents, count(*) FILTER (WHERE status = 'done') AS done, coalesce(sum(chunk_count), 0)::BIGINT AS chunks,
  count(*) FILTER (WHERE fmt = 'web') AS pages FROM documents GROUP BY source"""
)
def source_catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.coalesce(F.sum(F.col("chunk_count").cast("long")), F.lit(0)).alias("chunks"),
        F.count_if(F.col("fmt") == "web").alias("pages"),
    )


@query(
    """SELECT path, regexp_extract(path, '[^/]+$') AS base,
  regexp_matches(regexp_extract(path, '[^/]*$'), '\\.env|id_rsa|id_ed25519|credential|password|passwd|secret|private[_-]?key|access[_-]?token|keychain|wallet|钥匙串|密码|口令|密钥|凭据', 'i')
  OR regexp_matches(path, '(^|[/\\\\])(\\.ssh|\\.gnupg|\\.aws|\\.kube|credentials)([/\\\\]|$)', 'i') AS sensitive, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('md', 'txt', 'docx', 'pdf', 'pptx', 'xlsx', 'html') AS wanted
  FROM documents"""
)
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return table(spark, d, "documents").select(
        path,
        F.regexp_extract(path, "[^/]+$", 0).alias("base"),
        tx.sensitive_path(path).alias("sensitive"),
        tx.extension(path).isin(*tx.EXTENSIONS).alias("wanted"),
    )


@query(
    """SELECT t.doc_id, (t.updated_at IS NULL OR t.updated_at < TIMESTAMP '2025-06-01') AS kept_old, t.status FROM (
  SELECT doc_id, updated_at, CASE WHEN updated_at >= TIMESTAMP '2025-06-01' THEN 'pending' ELSE status END AS status FROM documents) t"""
)
def upsert_states(spark: SparkSession, d: str) -> DataFrame:
    """Documents changed since June 2025 come as new rows and take the place of the stored ones."""
    docs = table(spark, d, "documents").select("doc_id", "updated_at", "status")
    new = docs.where("updated_at >= timestamp'2025-06-01'").withColumn("status", F.lit("pending"))
    old_or_new = lifecycle.upsert(docs, new, "doc_id")
    return old_or_new.select("doc_id", F.coalesce(F.col("updated_at") < F.expr("timestamp'2025-06-01'"), F.lit(True)).alias("kept_old"), "status")


@query("SELECT doc_id, length(substr(normalized_text, 1, 20000)) AS shown, length(normalized_text) > 20000 AS cut FROM documents")
def document_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.length(F.substring("normalized_text", 1, 20000)).alias("shown"), (F.length("normalized_text") > 20000).alias("cut")
    )


_SQL_URL = r"regexp_extract(normalized_text, '^---\nsource: (\S+)', 1)"
_SQL_HOST = f"lower(regexp_extract({_SQL_URL}, '^[a-z]+://([^/:?#]+)', 1))"
_SQL_PART = r"\.[0-9]{1,3}"
_SQL_PRIVATE = (
    f"({_SQL_HOST} IN ('', 'localhost', '::1', '[::1]') OR {_SQL_HOST} LIKE '%.localhost' OR regexp_full_match({_SQL_HOST}, "
    rf"'(0|10|127)({_SQL_PART}){{{{3}}}}|(192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))({_SQL_PART}){{{{2}}}}'))".replace("{{", "{").replace("}}", "}")
)


@query(
    rf"""SELECT doc_id, {_SQL_URL} AS url, {_SQL_HOST} AS host, {_SQL_PRIVATE} AS private,
  regexp_matches({_SQL_URL}, '^https?://') AND NOT {_SQL_PRIVATE} AS fetchable
  FROM documents WHERE fmt = 'web' AND {_SQL_URL} != ''"""
)
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    url = F.regexp_extract("normalized_text", r"^---\nsource: (\S+)", 1)
    rows = table(spark, d, "documents").where("fmt = 'web'").select("doc_id", url.alias("url")).where("url != ''")
    host = tx.url_host(F.col("url"))
    return rows.select("doc_id", "url", host.alias("host"), tx.private_host(host).alias("private"), (F.col("url").rlike("^https?://") & ~tx.private_host(host)).alias("fetchable"))


@query(
    rf"""SELECT doc_id, substr(CASE WHEN t = '' THEN 'page' ELSE t END, 1, 40) || '-' || substr(sha256(url), 1, 8) || '.md' AS file_name FROM (
  SELECT doc_id, {_SQL_URL} AS url, trim(regexp_replace(regexp_replace(regexp_extract(normalized_text, '(?m)^# (.*)$', 1), '[\\/:*?"<>|]', '', 'g'), '\s+', ' ', 'g')) AS t
  FROM documents WHERE fmt = 'web' AND {_SQL_URL} != '')"""
)
def page_file_name(spark: SparkSession, d: str) -> DataFrame:
    url = F.regexp_extract("normalized_text", r"^---\nsource: (\S+)", 1)
    title = F.regexp_extract("normalized_text", "(?m)^# (.*)$", 1)
    rows = table(spark, d, "documents").where("fmt = 'web'").select("doc_id", url.alias("url"), title.alias("title")).where("url != ''")
    return rows.select("doc_id", tx.page_file_name(F.col("title"), F.col("url")).alias("file_name"))
