"""Queries of the retrieval operators.

The query set is every entity, or vector, whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.operators import ranking, vectors
from fernlode.plans.registry import query
from fernlode.session import materialize
from fernlode.sources.tables import features, search_settings, setting, table

# Pieces of the SQL twins. A usable vector has 64 entries, not all zero.
_K = "(SELECT CAST(value->>'topK' AS INT) FROM config WHERE key = 'search')"
_OK = "len({v}) = 64 AND list_sum(list_transform({v}, lambda x: abs(x))) > 0"
_SQL_DONE = (
    "done AS (SELECT c.id AS chunk_id, c.document_id, c.text FROM chunks c JOIN documents d ON d.doc_id = c.document_id "
    "WHERE d.status = 'done')"
)
_SQL_ASKED = f"asked AS (SELECT id AS query_id, name, embedding AS qv FROM entities WHERE id % 100 = 0 AND {_OK.format(v='embedding')})"
_SQL_VECTOR = f"""
vs AS (SELECT v.chunk_id, done.document_id, v.embedding FROM vec_index v JOIN done USING (chunk_id) WHERE {_OK.format(v='v.embedding')}),
sims AS (SELECT query_id, chunk_id, document_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS similarity
  FROM vs, asked),
vector_route AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM sims WHERE similarity >= 0.3 QUALIFY rank <= 3 * {_K})"""
_SQL_WORDS = r"""
words AS (SELECT DISTINCT query_id, word FROM (
  SELECT query_id, unnest(string_split_regex(trim(regexp_replace(lower(name), '[^\p{L}]+', ' ', 'g')), '\s+')) AS word FROM asked)
  WHERE length(word) >= 3),
lowered AS (SELECT id AS chunk_id, lower(text) AS t, greatest(length(text) - 2, 0) AS d FROM chunks WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n_rows, avg(d) AS avg_tokens FROM lowered),
tf AS (SELECT chunk_id, word, d, (length(t) - length(replace(t, word, ''))) / length(word) AS tf
  FROM lowered, (SELECT DISTINCT word FROM words) WHERE contains(t, word)),
df AS (SELECT word, count(*) AS n FROM tf GROUP BY word)"""
_SQL_BM25 = """
scored AS (SELECT query_id, chunk_id, count(*) AS got, round(-sum(
    (CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END)
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg_tokens))), 6) AS score
  FROM words JOIN tf USING (word) JOIN df USING (word), stats GROUP BY query_id, chunk_id),
bm25_all AS (SELECT query_id, chunk_id, score FROM scored
  JOIN (SELECT query_id, count(*) AS need FROM words GROUP BY query_id) USING (query_id) WHERE got = need),
keyword_route AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank
  FROM bm25_all JOIN done USING (chunk_id) QUALIFY rank <= 3 * """ + _K + ")"
_SQL_FUSED = f"""
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(route, '+' ORDER BY route) AS sources
  FROM (SELECT query_id, chunk_id, rank, 'vector' AS route FROM vector_route
        UNION ALL SELECT query_id, chunk_id, rank, 'bm25' FROM keyword_route) GROUP BY query_id, chunk_id),
main AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= {_K})"""
_SQL_GRAPH = f"""
ents AS (SELECT id AS entity_id, embedding FROM entities WHERE graph_role = 'keep' AND {_OK.format(v='embedding')}),
ent_hits AS (SELECT query_id, entity_id FROM (SELECT query_id, entity_id,
    round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS similarity FROM ents, asked)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entity_id) <= 5 AND similarity >= 0.55),
pairs AS (SELECT source_entity_id AS a, target_entity_id AS b FROM relations WHERE source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL
  UNION SELECT target_entity_id, source_entity_id FROM relations WHERE source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL),
wide AS (SELECT query_id, entity_id FROM ent_hits UNION SELECT query_id, b FROM ent_hits JOIN pairs ON a = entity_id),
graph_all AS (SELECT query_id, chunk_id, count(*) AS n FROM wide JOIN (SELECT DISTINCT chunk_id, entity_id FROM chunk_entities)
  USING (entity_id) GROUP BY query_id, chunk_id)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").where("id % 100 = 0").where(vectors.usable("embedding", 64))
    # the words of a name without its numbers and signs are the keyword query
    words = F.regexp_replace(F.lower("name"), r"[^\p{L}]+", " ")
    return rows.select(F.col("id").alias("query_id"), words.alias("query_text"), "embedding")


def _done_chunks(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").where("status = 'done'").select(F.col("doc_id").alias("document_id"))
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "text").join(documents, "document_id")


def _vector_route(spark: SparkSession, d: str) -> DataFrame:
    settings = search_settings(spark, d)
    done = _done_chunks(spark, d).select("chunk_id", "document_id")
    rows = table(spark, d, "vec_index").join(done, "chunk_id")
    top = vectors.cosine_top_k(
        rows, _asked(spark, d), 3 * settings["topK"], "chunk_id", min_similarity=settings["similarityThreshold"]
    )
    return top.join(done, "chunk_id")


def _keyword_route(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text")
    done, k = _done_chunks(spark, d).select("chunk_id"), 3 * search_settings(spark, d)["topK"]
    scored = ranking.bm25(chunks, _asked(spark, d), "chunk_id", "text", "query_id", "query_text", among=done, limit=k)
    return ranking.ranked(scored, "query_id", "score", "chunk_id", limit=k)


def _routes(spark: SparkSession, d: str, switches: dict[str, bool]) -> dict[str, DataFrame]:
    """The ranked routes, each computed once: the vector route, made diverse with mmr, and keywords with bm25."""
    near = _vector_route(spark, d)
    if switches["mmr"]:
        near = ranking.diversify(near, search_settings(spark, d)["topK"], "query_id", "document_id")
    routes = {"vector": materialize(near, "vector")}
    if switches["bm25"]:
        routes["bm25"] = materialize(_keyword_route(spark, d), "keyword")
    return routes


def _switches(spark: SparkSession, d: str, **changed: bool) -> dict[str, bool]:
    return features(setting(spark, d, "features")) | changed


def _entity_hits(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities").where("graph_role = 'keep'").select(F.col("id").alias("entity_id"), "embedding")
    return vectors.cosine_top_k(entities, _asked(spark, d), ranking.ENTITY_HITS, "entity_id", min_similarity=ranking.ENTITY_SIMILARITY)


@query(
    f"""WITH {_SQL_DONE}, vs AS (SELECT v.chunk_id, v.embedding FROM vec_index v JOIN done USING (chunk_id) WHERE {_OK.format(v='v.embedding')}),
sims AS (SELECT q.chunk_id AS query_id, vs.chunk_id, round(list_cosine_similarity(vs.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM vs, vs q WHERE q.chunk_id % 100 = 0)
SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
FROM sims WHERE similarity >= 0.3 QUALIFY rank <= 3 * {_K}"""
)
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    settings = search_settings(spark, d)
    rows = table(spark, d, "vec_index").join(_done_chunks(spark, d).select("chunk_id"), "chunk_id")
    asked = rows.where("chunk_id % 100 = 0").withColumn("query_id", F.col("chunk_id"))
    return vectors.cosine_top_k(rows, asked, 3 * settings["topK"], "chunk_id", min_similarity=settings["similarityThreshold"])


@query(f"WITH {_SQL_DONE}, {_SQL_ASKED}, {_SQL_VECTOR} SELECT query_id, chunk_id, document_id, similarity, round(1 - similarity, 6) AS distance, rank FROM vector_route")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vector_route(spark, d).select(
        "query_id", "chunk_id", "document_id", "similarity", F.round(1 - F.col("similarity"), 6).alias("distance"), "rank"
    )


@query(
    f"""WITH {_SQL_DONE}, {_SQL_ASKED}, {_SQL_VECTOR},
head AS (SELECT query_id, max(n) AS most FROM (SELECT query_id, document_id, count(*) AS n FROM vector_route WHERE rank <= {_K} GROUP BY 1, 2) GROUP BY 1),
adj AS (SELECT v.*, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS nth, count(*) OVER (PARTITION BY query_id) AS hits, most
  FROM vector_route v JOIN head USING (query_id)),
val AS (SELECT *, CASE WHEN hits <= {_K} OR most > 0.8 * {_K} THEN -rank::DOUBLE ELSE round(similarity / (1 + 0.15 * greatest(nth - 2, 0)), 9) END AS adjusted FROM adj)
SELECT query_id, chunk_id, document_id, similarity, rank AS first_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS new_rank FROM val QUALIFY new_rank <= {_K}"""
)
def mmr_diverse(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.diversify(_vector_route(spark, d), search_settings(spark, d)["topK"], "query_id", "document_id")
    return out.select("query_id", "chunk_id", "document_id", "similarity", "first_rank", F.col("rank").alias("new_rank"))


@query(
    f"""WITH per AS (SELECT d.doc_id, count(c.id) AS n FROM documents d LEFT JOIN chunks c ON c.document_id = d.doc_id
  WHERE d.status = 'done' GROUP BY d.doc_id)
SELECT count(*) AS done_documents, count(*) FILTER (n >= ceil(0.8 * {_K})) AS dominant,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (n >= ceil(0.8 * {_K})) / count(*), 3) END AS ratio,
  count(*) > 0 AND count(*) FILTER (n >= ceil(0.8 * {_K})) / count(*) >= 0.5 AS recommended FROM per"""
)
def mmr_signal(spark: SparkSession, d: str) -> DataFrame:
    least = -(-8 * search_settings(spark, d)["topK"] // 10)
    done = table(spark, d, "documents").where("status = 'done'").select("doc_id")
    counts = table(spark, d, "chunks").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n"))
    per = done.join(counts, "doc_id", "left")
    ratio = F.coalesce(F.try_divide(F.col("dominant").cast("double"), F.col("done_documents")), F.lit(0.0))
    return per.agg(
        F.count("*").alias("done_documents"), F.coalesce(F.count_if(F.col("n") >= least), F.lit(0)).alias("dominant")
    ).select("done_documents", "dominant", F.round(ratio, 3).alias("ratio"), (ratio >= 0.5).alias("recommended"))


@query(f"WITH {_SQL_ASKED}, {_SQL_WORDS} SELECT word, count(*) AS rows_with, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY word")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text")
    tf = ranking.term_counts(chunks, ranking.query_words(_asked(spark, d), "query_id", "query_text"), "chunk_id", "text")
    return tf.groupBy("word").agg(F.count("*").alias("rows_with"), F.sum("tf").alias("occurrences"))


@query("SELECT count(*) AS n_rows, round(avg(greatest(length(text) - 2, 0)), 6) AS avg_tokens FROM chunks WHERE text IS NOT NULL")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return ranking.corpus_stats(table(spark, d, "chunks"), "text").withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(f"WITH {_SQL_DONE}, {_SQL_ASKED}, {_SQL_WORDS}, {_SQL_BM25} SELECT query_id, chunk_id, score, rank FROM keyword_route")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _keyword_route(spark, d).select("query_id", "chunk_id", "score", "rank")


@query(
    r"""WITH q AS (SELECT id, lower(regexp_replace(name, '["'']', ' ', 'g')) AS t FROM entities WHERE id % 100 = 0 AND name IS NOT NULL)
SELECT id AS query_id, regexp_matches(t, '^[A-Za-z0-9_\s\x{80}-\x{10FFFF}]+$') AS accepted,
  CASE WHEN regexp_matches(t, '^[A-Za-z0-9_\s\x{80}-\x{10FFFF}]+$')
    THEN len(list_distinct(list_filter(string_split_regex(trim(t), '\s+'), lambda x: length(x) >= 3))) ELSE 0 END AS words FROM q"""
)
def bm25_strict_syntax(spark: SparkSession, d: str) -> DataFrame:
    """Which queries the strict keyword syntax accepts, and how many words they search."""
    asked = table(spark, d, "entities").where("id % 100 = 0 and name is not null").select(F.col("id").alias("query_id"), "name")
    words = ranking.query_words(asked, "query_id", "name").groupBy("query_id").agg(F.count("*").alias("n"))
    text = F.lower(F.regexp_replace("name", "[\"']", " "))
    return asked.join(words, "query_id", "left").select(
        "query_id", text.rlike(ranking.BARE).alias("accepted"), F.coalesce("n", F.lit(0)).alias("words")
    )


@query(f"WITH {_SQL_DONE}, {_SQL_ASKED}, {_SQL_VECTOR}, {_SQL_WORDS}, {_SQL_BM25}, {_SQL_FUSED} SELECT query_id, chunk_id, score, sources, rank FROM main")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    routes = _routes(spark, d, _switches(spark, d))
    out = ranking.fuse(routes, "query_id", "chunk_id", limit=search_settings(spark, d)["topK"])
    return out.select("query_id", "chunk_id", "score", "sources", "rank")


@query(f"WITH {_SQL_ASKED}, {_SQL_GRAPH} SELECT query_id, chunk_id, n AS entity_hits FROM graph_all")
def graph_route(spark: SparkSession, d: str) -> DataFrame:
    hits = _entity_hits(spark, d).select("query_id", "entity_id")
    out = ranking.graph_route(hits, table(spark, d, "relations"), table(spark, d, "chunk_entities"), "query_id")
    return out.select("query_id", "chunk_id", F.col("n").alias("entity_hits"))


_SQL_HYBRID = f"""{_SQL_DONE}, {_SQL_ASKED}, {_SQL_VECTOR}, {_SQL_WORDS}, {_SQL_BM25}, {_SQL_FUSED}, {_SQL_GRAPH},
tail AS (SELECT g.query_id, g.chunk_id, g.n, row_number() OVER (PARTITION BY g.query_id ORDER BY g.n DESC, g.chunk_id) AS rank
  FROM graph_all g JOIN done USING (chunk_id) ANTI JOIN main m ON m.query_id = g.query_id AND m.chunk_id = g.chunk_id QUALIFY rank <= 5),
hits AS (SELECT m.query_id, 0 AS section, m.rank, m.chunk_id, CASE WHEN contains(m.sources, '+') THEN 'rrf' ELSE m.sources END AS source,
    m.sources, v.similarity FROM main m LEFT JOIN vector_route v ON v.query_id = m.query_id AND v.chunk_id = m.chunk_id
  UNION ALL SELECT query_id, 1, rank, chunk_id, 'graph', 'graph', NULL FROM tail)"""


def _hybrid(spark: SparkSession, d: str, **changed: bool) -> DataFrame:
    switches = _switches(spark, d, **changed)
    routes = _routes(spark, d, switches)
    main = ranking.fuse(routes, "query_id", "chunk_id", limit=search_settings(spark, d)["topK"])
    similar = routes["vector"].select("query_id", "chunk_id", "similarity")
    main = materialize(main.join(similar, ["query_id", "chunk_id"], "left"), "main")
    out = main.select(
        "query_id",
        F.lit(0).alias("section"),
        "rank",
        "chunk_id",
        F.when(F.col("sources").contains("+"), "rrf").otherwise(F.col("sources")).alias("source"),
        "sources",
        "similarity",
    )
    if not switches["graph"]:
        return out
    hits = _entity_hits(spark, d).select("query_id", "entity_id")
    members = table(spark, d, "chunk_entities").join(_done_chunks(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    most = ranking.APPENDED + search_settings(spark, d)["topK"]  # a query has topK chunks in main at most
    counts = ranking.graph_route(hits, table(spark, d, "relations"), members, "query_id", limit=most)
    fresh = counts.join(main.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    tail = ranking.ranked(fresh, "query_id", F.desc("n"), "chunk_id", limit=ranking.APPENDED)
    return out.unionByName(
        tail.select(
            "query_id",
            F.lit(1).alias("section"),
            "rank",
            "chunk_id",
            F.lit("graph").alias("source"),
            F.lit("graph").alias("sources"),
            F.lit(None).cast("double").alias("similarity"),
        )
    )


@query(f"WITH {_SQL_HYBRID} SELECT query_id, section, rank, chunk_id, source, sources, similarity FROM hits")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


_SQL_MMR = f"""head AS (SELECT query_id, max(n) AS most FROM (SELECT query_id, document_id, count(*) AS n FROM first_route WHERE rank <= {_K} GROUP BY 1, 2) GROUP BY 1),
adj AS (SELECT v.*, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS nth, count(*) OVER (PARTITION BY query_id) AS hits, most
  FROM first_route v JOIN head USING (query_id)),
val AS (SELECT *, CASE WHEN hits <= {_K} OR most > 0.8 * {_K} THEN -rank::DOUBLE ELSE round(similarity / (1 + 0.15 * greatest(nth - 2, 0)), 9) END AS adjusted FROM adj),
vector_route AS (SELECT query_id, chunk_id, document_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS rank FROM val QUALIFY rank <= {_K})"""
_SQL_HYBRID_MMR = _SQL_HYBRID.replace(_SQL_VECTOR, _SQL_VECTOR.replace("vector_route AS", "first_route AS") + ", " + _SQL_MMR)


@query(f"WITH {_SQL_HYBRID_MMR} SELECT query_id, section, rank, chunk_id, source, sources, similarity FROM hits")
def hybrid_search_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of a library that has the diversity rerank switched on."""
    return _hybrid(spark, d, mmr=True, bm25=True, graph=True)


@query(f"WITH {_SQL_DONE}, {_SQL_ASKED}, {_SQL_VECTOR} SELECT query_id, 0 AS section, rank, chunk_id, 'vector' AS source, 'vector' AS sources, similarity FROM vector_route WHERE rank <= {_K}")
def hybrid_search_plain(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of a library with all switches off: the vector route alone."""
    return _hybrid(spark, d, mmr=False, bm25=False, graph=False)


_SQL_SYNTAX = """firsts AS (SELECT query_id, min(word) AS a, max(word) AS z FROM words0 GROUP BY query_id),
terms AS (SELECT query_id, 0 AS alt, a AS word, false AS forbidden FROM firsts UNION ALL SELECT query_id, 0, 'archive', true FROM firsts
  UNION ALL SELECT query_id, 1, z, false FROM firsts UNION ALL SELECT query_id, 1, 'ing', false FROM firsts WHERE z != 'ing'),
words AS (SELECT DISTINCT query_id, word FROM terms), lowered AS"""
_SQL_FITS = """needs AS (SELECT query_id, alt, count(*) FILTER (NOT forbidden) AS need FROM terms GROUP BY ALL),
tparts AS (SELECT query_id, chunk_id, alt, forbidden, (CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg_tokens)) AS part FROM terms JOIN tf USING (word) JOIN df USING (word), stats),
fit AS (SELECT query_id, chunk_id, alt, sum(part) FILTER (NOT forbidden) AS score FROM tparts JOIN needs USING (query_id, alt) GROUP BY ALL
  HAVING NOT bool_or(forbidden) AND count(*) FILTER (NOT forbidden) = max(need))"""


@query(f"WITH {_SQL_DONE}, {_SQL_ASKED}, {_SQL_WORDS.replace('words AS', 'words0 AS', 1).replace('lowered AS', _SQL_SYNTAX)}, {_SQL_FITS} SELECT query_id, chunk_id, round(-sum(score), 6) AS score FROM fit GROUP BY 1, 2")
def bm25_operators(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search with OR, AND, NOT and *: the first of each query's words without 'archive', or the last one and 'ing'."""
    words = ranking.query_words(_asked(spark, d), "query_id", "query_text")
    ends = words.groupBy("query_id").agg(F.min("word").alias("a"), F.max("word").alias("z"))
    text = F.concat("a", F.lit("* NOT archive OR "), "z", F.lit(" AND ing"))
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text")
    return ranking.bm25(chunks, ends.select("query_id", text.alias("query")), "chunk_id", "text", "query_id", "query")


@query(
    f"""WITH {_SQL_HYBRID}, top AS (SELECT query_id, arg_min(similarity, rank) FILTER (similarity IS NOT NULL AND section = 0) AS best, count(*) AS n
  FROM hits GROUP BY query_id)
SELECT query_id, best AS similarity, coalesce(n, 0) AS hits, CASE WHEN best IS NULL THEN 'unknown' WHEN best < 0.45 THEN 'low'
  WHEN best < 0.6 THEN 'medium' ELSE 'high' END AS confidence, n IS NULL AS no_hit FROM asked LEFT JOIN top USING (query_id)"""
)
def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    hits = _hybrid(spark, d)
    scored = F.when((F.col("section") == 0) & F.col("similarity").isNotNull(), F.col("rank"))
    top = hits.groupBy("query_id").agg(F.min_by("similarity", scored).alias("best"), F.count("*").alias("n"))
    return _asked(spark, d).select("query_id").join(top, "query_id", "left").select(
        "query_id",
        F.col("best").alias("similarity"),
        F.coalesce("n", F.lit(0)).alias("hits"),
        ranking.confidence(F.col("best")).alias("confidence"),
        F.col("n").isNull().alias("no_hit"),
    )


@query(
    f"""WITH {_SQL_HYBRID} SELECT query_id, section, rank, format('{{}}. [{{}}] [{{}}] {{}} · {{}} · {{}}-{{}}', rank, hits.source,
  CASE WHEN similarity IS NULL THEN 'BM25' ELSE printf('%.4f', round(similarity, 4)) END, d.name, c.title_path, c.start_offset, c.end_offset) AS line
FROM hits JOIN chunks c ON c.id = hits.chunk_id JOIN documents d ON d.doc_id = c.document_id"""
)
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "title_path", "start_offset", "end_offset")
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "name")
    shown = ranking.shown(F.col("similarity"))
    line = F.format_string(
        "%d. [%s] [%s] %s · %s · %d-%d", "rank", "source", shown, "name", "title_path", "start_offset", "end_offset"
    )
    return _hybrid(spark, d).join(chunks, "chunk_id").join(documents, "document_id").select(
        "query_id", "section", "rank", line.alias("line")
    )


@query(
    f"""WITH {_SQL_DONE}, {_SQL_ASKED}, vs AS (SELECT v.chunk_id, v.embedding FROM vec_index v JOIN done USING (chunk_id) WHERE {_OK.format(v='v.embedding')})
SELECT query_id, count(*) AS above FROM (SELECT query_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS s FROM vs, asked)
WHERE s >= 0.35 GROUP BY query_id"""
)
def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vec_index").join(_done_chunks(spark, d).select("chunk_id"), "chunk_id")
    return vectors.count_above(rows, _asked(spark, d), 0.35, "chunk_id")
