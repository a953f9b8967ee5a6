"""Queries of the entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlode.operators import communities, graph
from fernlode.plans.registry import query
from fernlode.session import materialize
from fernlode.sources.tables import setting, table

_WEIGHTS = """w AS (SELECT least(source_entity_id, target_entity_id) AS a, greatest(source_entity_id, target_entity_id) AS b, count(*) AS weight
  FROM relations WHERE source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL GROUP BY 1, 2)"""
_DEGREES = "deg AS (SELECT e AS id, count(DISTINCT n) AS degree FROM (SELECT a AS e, b AS n FROM w UNION ALL SELECT b, a FROM w) GROUP BY e)"
_NODES = f"nodes AS (SELECT e.id, e.name, coalesce(degree, 0) AS degree FROM entities e LEFT JOIN deg USING (id) WHERE e.graph_role = 'keep' ORDER BY coalesce(degree, 0) DESC, e.id LIMIT {graph.FULL_NODES})"
_SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+"


def _norm(x: str) -> str:
    return f"regexp_replace(lower(trim({x})), '{_SPACE}', '', 'g')"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_weights(table(spark, d, "relations"))


def _pending_sql(extra: str) -> str:
    return f"""SELECT c.id, c.document_id, c.ordinal FROM chunks c JOIN documents d ON d.doc_id = c.document_id AND d.status = 'done'
LEFT JOIN (SELECT chunk_id, bool_or(status = 'ok') AS ok FROM graph_extract WHERE status != 'processing' GROUP BY chunk_id) g ON g.chunk_id = c.id
WHERE ok IS NULL{extra}"""


@query(_pending_sql(" OR NOT ok"))
def pending_chunks_retry(spark: SparkSession, d: str) -> DataFrame:
    return graph.pending_chunks(table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "graph_extract"), True)


@query(_pending_sql(""))
def pending_chunks_new(spark: SparkSession, d: str) -> DataFrame:
    return graph.pending_chunks(table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "graph_extract"), False)


@query(
    r"""WITH x AS (SELECT chunk_id, status, regexp_extract(result, '(?s)\{.*\}') AS j FROM graph_extract WHERE result IS NOT NULL)
SELECT chunk_id, status, j != '' AND json_valid(j) AS readable, CASE WHEN j != '' AND json_valid(j) THEN json_array_length(j, '$.entities') END::INT AS entities,
  CASE WHEN j != '' AND json_valid(j) THEN json_array_length(j, '$.relations') END::INT AS relations FROM x"""
)
def extraction_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_extract").where("result is not null")
    text = F.regexp_extract("result", r"(?s)\{.*\}", 0)
    parsed = rows.select("chunk_id", "status", F.when(F.get_json_object(text, "$.entities").isNotNull(), graph.parse_extraction(F.col("result"))).alias("r"))
    return parsed.select(
        "chunk_id", "status", F.col("r").isNotNull().alias("readable"),
        F.when(F.col("r").isNotNull(), F.size("r.entities")).alias("entities"), F.when(F.col("r").isNotNull(), F.size("r.relations")).alias("relations"),
    )


@query(f"SELECT id, {_norm('name')} AS norm FROM entities")
def entity_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("id", graph.normalized_name(F.col("name")).alias("norm"))


# The rules of names, written out for SQL on their own.
_TRIM = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_TRIM}|{_TRIM}$', '', 'g')"


def _clean(x: str) -> str:
    inner = f"""regexp_replace({_trim(x)}, '^["''【\\[（(]+|["''】\\]）)]+$', '', 'g')"""
    return _trim(f"regexp_replace({inner}, '[。，；：!！?？]+$', '')")


def _meaningful(n: str) -> str:
    return f"""(length({n}) >= 2 AND length({n}) <= CASE WHEN regexp_matches({n}, '《|》|NU-|T/|GB\\s|WS\\s|Q/|〔|（\\d|[A-Z]{{2,}}[/-]\\d', 'i') THEN 60 ELSE 18 END
  AND NOT regexp_matches({n}, '^[\\d\\s.\\-:：年月日时分秒/号]+$') AND NOT regexp_matches({n}, '及各种|以及|等等|什么的|比如|例如|包括|还有'))"""


@query(f"SELECT id, n AS clean, {_meaningful('n')} AS meaningful FROM (SELECT id, {_clean('name')} AS n FROM entities)")
def entity_clean_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").select("id", graph.clean_name(F.col("name")).alias("clean"))
    return rows.withColumn("meaningful", graph.meaningful(F.col("clean")))


_CLASS = r"""CASE WHEN regexp_matches(name, '^[A-Z]{2,4}(-[A-Z]{2,4})+-\d') THEN 'weak'
  WHEN length(name) > 20 OR regexp_matches(name, '[（(][^）)]*$|、|^只能|^不[是定止]|及以上$|以下$|以内$|（[^）]*）[^\n]{0,6}的$') THEN 'drop'
  WHEN regexp_matches(name, '^[^\s\x{3000}]{1,8}(\d+(\.\d+)?\s*(m|cm|分|元|%|倍|岁|℃))$') THEN 'drop'
  WHEN regexp_matches(name, '^[一-龥]{2,4}$') AND metadata_only THEN 'drop'
  WHEN name IN ('用户', '客户', '员工', '人员', '公司', '团队', '部门', '单位', '流程', '制度', '规范', '管理', '工作', '内容', '问题', '情况', '方面', '措施')
    OR regexp_matches(name, '^各[一个]?(护理单元|科室|部门|单位|病区|单元|岗位|级|类)') THEN 'weak' ELSE 'keep' END"""
_TITLES = """t AS (SELECT e.id, e.name, count(DISTINCT coalesce(c.title_path, '')) FILTER (c.id IS NOT NULL) AS titles,
  coalesce(bool_and(regexp_matches(coalesce(c.title_path, ''), '文档历史|文件历史|修订记录|文档变更')) FILTER (c.id IS NOT NULL), false) AS metadata_only
  FROM entities e LEFT JOIN chunk_entities m ON m.entity_id = e.id LEFT JOIN chunks c ON c.id = m.chunk_id GROUP BY e.id, e.name)"""


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, titles, metadata_only) of every entity; different titles are counted in two steps."""
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.coalesce("title_path", F.lit("")).alias("title"))
    found = table(spark, d, "chunk_entities").join(chunks, "chunk_id").select(F.col("entity_id").alias("id"), "title").distinct()
    titles = found.groupBy("id").agg(F.count("*").alias("titles"), graph.only_metadata(F.col("title")).alias("metadata_only"))
    rows = table(spark, d, "entities").select("id", "name").join(titles, "id", "left")
    return rows.fillna({"titles": 0, "metadata_only": False})


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return _titled(spark, d).withColumn("role", graph.classify(F.col("name"), F.col("metadata_only"), generic_words(spark, d)))


def generic_words(spark: SparkSession, d: str) -> tuple[str, ...]:
    """The library's own words without meaning: setting genericEntities, or its place under graph."""
    words = setting(spark, d, "graph").get("genericEntities") or setting(spark, d, "genericEntities").get("genericEntities") or ()
    return tuple(w for w in words if isinstance(w, str))


@query(f"WITH {_TITLES} SELECT id, {_CLASS} AS role, titles FROM t")
def entity_classify(spark: SparkSession, d: str) -> DataFrame:
    return _roles(spark, d).select("id", "role", "titles")


@query(
    f"""WITH {_TITLES}, r AS (SELECT id, {_CLASS} AS role FROM t), gone AS (SELECT id FROM r WHERE role = 'drop'), bad AS (SELECT id FROM r WHERE role != 'keep')
SELECT (SELECT count(*) FROM entities) AS before_entities, (SELECT count(*) FROM gone) AS dropped, (SELECT count(*) FROM r WHERE role = 'weak') AS weakened,
  (SELECT count(*) FROM relations) AS before_relations, (SELECT count(*) FROM relations WHERE NOT coalesce(source_entity_id IN (SELECT id FROM bad), false)
    AND NOT coalesce(target_entity_id IN (SELECT id FROM bad), false)) AS after_relations,
  (SELECT count(*) FROM chunk_entities WHERE entity_id NOT IN (SELECT id FROM gone)) AS after_members"""
)
def clean_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts before and after the rules are applied: dropped entities lose relations and
    memberships, weak ones their relations."""
    roles = _roles(spark, d).select("id", "role")
    relations, members = table(spark, d, "relations"), table(spark, d, "chunk_entities")
    bad = roles.where("role != 'keep'").select("id")
    kept = relations.join(bad.withColumnRenamed("id", "source_entity_id"), "source_entity_id", "left_anti").join(
        bad.withColumnRenamed("id", "target_entity_id"), "target_entity_id", "left_anti"
    )
    held = members.join(roles.where("role = 'drop'").select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    counts = roles.agg(F.count("*").alias("before_entities"), F.count_if(F.col("role") == "drop").alias("dropped"), F.count_if(F.col("role") == "weak").alias("weakened"))
    for name, df in (("before_relations", relations), ("after_relations", kept), ("after_members", held)):
        counts = counts.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return counts


@query(
    """SELECT e.id AS entity_id, c.title_path, count(DISTINCT c.id) AS chunks FROM entities e JOIN chunk_entities m ON m.entity_id = e.id
JOIN chunks c ON c.id = m.chunk_id GROUP BY e.id, c.title_path"""
)
def entity_title_paths(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "chunk_entities").distinct()
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "title_path")
    entities = table(spark, d, "entities").select(F.col("id").alias("entity_id"))
    return members.join(entities, "entity_id", "left_semi").join(chunks, "chunk_id").groupBy("entity_id", "title_path").agg(F.count("*").alias("chunks"))


@query(f"WITH {_WEIGHTS} SELECT a, b, weight FROM w")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"WITH {_WEIGHTS}, {_DEGREES} SELECT e.id, coalesce(degree, 0) AS degree FROM entities e LEFT JOIN deg USING (id)")
def degree(spark: SparkSession, d: str) -> DataFrame:
    found = graph.degrees(_edges(spark, d)).withColumnRenamed("entity_id", "id")
    return table(spark, d, "entities").select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"WITH {_WEIGHTS}, {_DEGREES}, {_NODES} SELECT * FROM nodes")
def full_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.full_nodes(table(spark, d, "entities").select("id", "name", "graph_role"), _edges(spark, d)).drop("graph_role")


@query(
    f"""WITH {_WEIGHTS}, {_DEGREES}, {_NODES}, top AS (SELECT * FROM w ORDER BY weight DESC, a, b LIMIT {graph.FULL_EDGES})
SELECT a, b, weight, round(log2(weight + 1) / log2((SELECT max(weight) FROM top) + 1), 6) AS norm FROM top WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)"""
)
def full_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    nodes = graph.full_nodes(table(spark, d, "entities").select("id", "name", "graph_role"), edges)
    most = edges.agg(F.max("weight").alias("most"))
    out = graph.full_edges(edges, nodes).crossJoin(F.broadcast(most))  # one row
    return out.select("a", "b", "weight", F.round(F.log2(F.col("weight") + 1) / F.log2(F.col("most") + 1), 6).alias("norm"))


@query(
    f"""WITH {_WEIGHTS}, ends AS (SELECT source_entity_id AS id FROM relations UNION SELECT target_entity_id FROM relations),
n AS (SELECT count(*) AS entities, count(*) FILTER (id NOT IN (SELECT id FROM ends WHERE id IS NOT NULL)) AS isolated FROM entities),
cov AS (SELECT count(*) AS uncovered FROM chunks c JOIN documents d ON d.doc_id = c.document_id AND d.status = 'done'
  WHERE c.id NOT IN (SELECT chunk_id FROM graph_extract WHERE status = 'ok' AND chunk_id IS NOT NULL))
SELECT entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM w) AS unique_edges,
  CASE WHEN entities = 0 THEN 0.0 ELSE round(2 * (SELECT count(*) FROM w) / entities, 4) END AS average_degree, isolated,
  CASE WHEN entities = 0 THEN 0.0 ELSE round(isolated / entities, 4) END AS isolated_ratio,
  (SELECT count(DISTINCT chunk_id) FROM graph_extract WHERE status = 'processing') AS processing_chunks, uncovered AS uncovered_chunks FROM n, cov"""
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    entities, relations, extracts = table(spark, d, "entities"), table(spark, d, "relations"), table(spark, d, "graph_extract")
    done = table(spark, d, "documents").where("status = 'done'").select(F.col("doc_id").alias("document_id"))
    ok = extracts.where("status = 'ok'").select(F.col("chunk_id").alias("id")).distinct()
    uncovered = table(spark, d, "chunks").join(done, "document_id", "left_semi").join(ok, "id", "left_anti")
    parts = {
        "entities": entities,
        "relations": relations,
        "unique_edges": _edges(spark, d),
        "isolated": graph.isolated(entities, relations),
        "processing_chunks": extracts.where("status = 'processing'").select("chunk_id").distinct(),
        "uncovered_chunks": uncovered,
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    per = lambda x, f: F.round(F.coalesce(F.try_divide(F.lit(f) * F.col(x), F.col("entities").cast("double")), F.lit(0.0)), 4)
    return out.withColumn("average_degree", per("unique_edges", 2.0)).withColumn("isolated_ratio", per("isolated", 1.0))


@query("SELECT id, name FROM entities WHERE id NOT IN (SELECT source_entity_id FROM relations WHERE source_entity_id IS NOT NULL UNION SELECT target_entity_id FROM relations WHERE target_entity_id IS NOT NULL)")
def isolated_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.isolated(table(spark, d, "entities"), table(spark, d, "relations")).select("id", "name")


@query(f"WITH {_WEIGHTS} SELECT a AS entity_id, b AS neighbour FROM w UNION SELECT b, a FROM w")
def neighbours_union(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return e.select(F.col("a").alias("entity_id"), F.col("b").alias("neighbour")).union(e.select("b", "a")).distinct()


_LOCAL = f"""le AS (SELECT c.id AS center, r.id, r.source_entity_id, r.target_entity_id, r.relation, row_number() OVER (PARTITION BY c.id ORDER BY r.id) AS nth
  FROM (SELECT id FROM entities WHERE id % 100 = 0) c JOIN (SELECT DISTINCT * EXCLUDE (source_chunk_id) FROM relations) r ON r.source_entity_id = c.id OR r.target_entity_id = c.id
  WHERE r.source_entity_id IS NOT NULL AND r.target_entity_id IS NOT NULL QUALIFY nth <= {graph.LOCAL_EDGES})"""


def _centers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("id % 100 = 0").select("id")


@query(f"WITH {_LOCAL} SELECT center, id, source_entity_id, target_entity_id, relation FROM le")
def local_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_edges(table(spark, d, "relations"), _centers(spark, d)).drop("nth")


@query(
    f"""WITH {_LOCAL}, ends AS (SELECT center, source_entity_id AS e, nth, 0 AS s FROM le UNION ALL SELECT center, target_entity_id, nth, 1 FROM le),
f AS (SELECT center, e AS entity_id, min(nth * 2 + s) AS first_at, count(DISTINCT nth) AS degree FROM ends GROUP BY center, e)
SELECT center, entity_id, degree, row_number() OVER (PARTITION BY center ORDER BY entity_id = center DESC, first_at) AS rank FROM f QUALIFY rank <= {graph.LOCAL_NODES}"""
)
def local_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_nodes(graph.local_edges(table(spark, d, "relations"), _centers(spark, d)))


@query(
    """WITH q AS (SELECT id AS query_id, lower(name) AS t FROM entities WHERE id % 100 = 0)
SELECT query_id, e.id, e.name, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(e.name) = t THEN 0 ELSE 1 END, e.name, e.id) AS rank
FROM q JOIN entities e ON lower(e.name) LIKE '%' || t || '%' OR lower(coalesce(e.aliases_json, '')) LIKE '%' || t || '%' QUALIFY rank <= 20"""
)
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose name or aliases contain the text of a query, exact names first.

    % and _ in a query stand for any characters and any one. Rows are found by the longest piece
    between them, then compared as a whole; a query of such signs alone finds nothing.
    """
    from fernlode.operators import ranking

    entities = table(spark, d, "entities").select("id", "name", F.lower("name").alias("n"), F.lower("aliases_json").alias("a"))
    asked = table(spark, d, "entities").where("id % 100 = 0").select(F.col("id").alias("query_id"), F.lower("name").alias("asked"))
    asked = asked.withColumn("word", F.expr("array_max(transform(split(asked, '[%_]+'), x -> struct(length(x) as n, x as x))).x")).where("length(word) > 0")
    found = ranking.term_counts(entities.withColumn("text", F.concat_ws("\n", "n", "a")), asked, "id", "text").select("id", "word")
    hits = found.join(asked, "word").join(entities, "id")
    pattern = F.concat(F.lit("%"), "asked", F.lit("%"))
    hits = hits.where(F.like("n", pattern, F.lit("\x01")) | F.like("a", pattern, F.lit("\x01")))
    exact = F.when(F.col("n") == F.col("asked"), 0).otherwise(1)
    return ranking.ranked(hits, "query_id", exact, "name", "id", limit=20).select("query_id", "id", "name", "rank")


@query(
    """SELECT m.entity_id, c.id AS chunk_id, substr(c.text, 1, 240) AS summary, substr(c.title_path, 1, 120) AS title, d.name AS document
FROM (SELECT entity_id, chunk_id, row_number() OVER (PARTITION BY entity_id ORDER BY chunk_id) AS nth FROM (SELECT DISTINCT * FROM chunk_entities)
  WHERE chunk_id IN (SELECT id FROM chunks)) m JOIN chunks c ON c.id = m.chunk_id JOIN documents d ON d.doc_id = c.document_id WHERE nth <= 3"""
)
def chunk_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The first three chunks of each entity, shortened for a view."""
    chunks = table(spark, d, "chunks")
    known = table(spark, d, "chunk_entities").distinct().join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id"))
    first = known.withColumn("nth", nth).where("nth <= 3").select("entity_id", "chunk_id")
    texts = chunks.select(F.col("id").alias("chunk_id"), "document_id", F.substring("text", 1, 240).alias("summary"), F.substring("title_path", 1, 120).alias("title"))
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("name").alias("document"))
    return first.join(texts, "chunk_id").join(documents, "document_id").select("entity_id", "chunk_id", "summary", "title", "document")


@query("SELECT chunk_id, count(DISTINCT entity_id) AS entities FROM chunk_entities GROUP BY chunk_id")
def chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_entities").distinct().groupBy("chunk_id").agg(F.count("entity_id").alias("entities"))


@query(
    f"""WITH {_WEIGHTS}, {_DEGREES}, {_NODES}, i AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS i, (SELECT count(*) FROM nodes) AS n FROM nodes)
SELECT id, round((90 + 340 * sqrt(i / n)) * cos(2.39996 * i), 4) AS x, round((90 + 340 * sqrt(i / n)) * sin(2.39996 * i), 4) AS y,
  round(least(14, 1.8 + 1.1 * log2(degree + 1)), 4) AS radius FROM i"""
)
def layout_spiral(spark: SparkSession, d: str) -> DataFrame:
    """First places of the full view's nodes, FULL_NODES at most."""
    nodes = graph.full_nodes(table(spark, d, "entities").select("id", "graph_role"), _edges(spark, d))
    order = F.row_number().over(Window.orderBy(F.desc("degree"), "id")) - 1  # a bounded view
    placed = nodes.withColumn("i", order).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n"))))
    r = 90 + 340 * F.sqrt(F.col("i") / F.col("n"))
    return placed.select(
        "id",
        F.round(r * F.cos(F.lit(2.39996) * F.col("i")), 4).alias("x"),
        F.round(r * F.sin(F.lit(2.39996) * F.col("i")), 4).alias("y"),
        F.round(F.least(F.lit(14.0), 1.8 + 1.1 * F.log2(F.col("degree") + 1)), 4).alias("radius"),
    )


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentions(table(spark, d, "graph_extract"))


def _text(items: str, *fields: str) -> Column:
    """An array of structs as text, for comparison."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws("|", *(F.array_join(x[f], ",") if f == "aliases" else x[f] for f in fields))), ";")


_SQL_RECORD = rf"""rec AS (SELECT *, row_number() OVER () AS row_no FROM (SELECT chunk_id, status, regexp_extract(result, '(?s)\{{.*\}}') AS j FROM graph_extract WHERE result IS NOT NULL) WHERE true),
good AS (SELECT row_no, chunk_id, status, j::JSON AS j FROM (SELECT * FROM rec WHERE j != '' AND json_valid(j)) WHERE json_type(j::JSON, '$.entities') = 'ARRAY' AND json_type(j::JSON, '$.relations') = 'ARRAY'),
e0 AS (SELECT row_no, chunk_id, status, unnest(CAST(j->'$.entities' AS JSON[])) AS e, generate_subscripts(CAST(j->'$.entities' AS JSON[]), 1) AS nth FROM good),
e1 AS (SELECT *, {_clean("e->>'name'")} AS name, coalesce(nullif({_trim("e->>'type'")}, ''), 'concept') AS type,
  list_slice(list_filter(list_transform(coalesce(CAST(e->'$.aliases' AS VARCHAR[]), []), lambda x: {_trim('x')}), lambda x: x != ''), 1, 12) AS aliases FROM e0 WHERE {_trim("e->>'name'")} != ''),
e2 AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY nth) - 1 AS pos FROM e1 WHERE {_meaningful('name')} QUALIFY pos < 8),
n2 AS (SELECT DISTINCT row_no, {_norm('name')} AS norm FROM e2),
r0 AS (SELECT row_no, chunk_id, status, unnest(CAST(j->'$.relations' AS JSON[])) AS r, generate_subscripts(CAST(j->'$.relations' AS JSON[]), 1) AS nth FROM good),
r1 AS (SELECT row_no, chunk_id, status, nth, {_trim("r->>'subject'")} AS s, {_trim("r->>'predicate'")} AS p, {_trim("r->>'object'")} AS o FROM r0),
r2 AS (SELECT r1.*, {_norm('s')} AS sn, {_norm('o')} AS on_ FROM r1 WHERE p != '' AND EXISTS (FROM n2 WHERE n2.row_no = r1.row_no AND n2.norm = {_norm('r1.s')})
  AND EXISTS (FROM n2 WHERE n2.row_no = r1.row_no AND n2.norm = {_norm('r1.o')}) QUALIFY row_number() OVER (PARTITION BY r1.row_no ORDER BY nth) <= 6)"""


@query(
    f"""WITH {_SQL_RECORD} SELECT rec.chunk_id, rec.status, good.row_no IS NOT NULL AS usable,
  CASE WHEN good.row_no IS NOT NULL THEN coalesce((SELECT string_agg(name || '|' || type || '|' || array_to_string(aliases, ','), ';' ORDER BY pos) FROM e2 WHERE e2.row_no = rec.row_no), '') END AS entities,
  CASE WHEN good.row_no IS NOT NULL THEN coalesce((SELECT string_agg(s || '|' || p || '|' || o, ';' ORDER BY nth) FROM r2 WHERE r2.row_no = rec.row_no), '') END AS relations
FROM rec LEFT JOIN good USING (row_no)"""
)
def extraction_validate(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each raw record after cleaning, as text."""
    rows = table(spark, d, "graph_extract").where("result is not null")
    rows = rows.select("chunk_id", "status", graph.validated(graph.parse_extraction(F.col("result"))).alias("r"))
    return rows.select(
        "chunk_id", "status", F.col("r").isNotNull().alias("usable"),
        _text("r.entities", "name", "type", "aliases").alias("entities"), _text("r.relations", "subject", "predicate", "object").alias("relations"),
    )


@query(
    r"""WITH x AS (SELECT DISTINCT result FROM graph_extract WHERE status = 'ok' AND result IS NOT NULL),
j AS (SELECT regexp_extract(result, '(?s)\{.*\}') AS j FROM x),
e AS (SELECT unnest(CAST(j->'$.entities' AS JSON[])) AS e FROM j WHERE j != '' AND json_valid(j)),
pairs AS (SELECT DISTINCT """ + _norm("e->>'name'") + """ AS a, """ + _norm("al") + """ AS b
  FROM (SELECT e, unnest(CAST(e->'$.aliases' AS VARCHAR[])) AS al FROM e))
SELECT a, b FROM pairs WHERE a != '' AND b != ''"""
)
def alias_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.alias_edges(_mentions(spark, d))


def _components(spark: SparkSession, d: str) -> DataFrame:
    """(norm, entity): normal names and the least name of their component."""
    return graph.components_of(_mentions(spark, d))


# names that share a component reach each other over aliases; the least one stands for it
_SQL_COMPONENTS = f"""m AS (SELECT DISTINCT chunk_id, pos, name, type, {_norm('name')} AS norm, aliases FROM e2 WHERE status = 'ok'),
al AS (SELECT DISTINCT norm AS a, {_norm('x')} AS b FROM (SELECT norm, unnest(aliases) AS x FROM m)),
arcs AS (SELECT a, b FROM al WHERE a != '' AND b != '' UNION SELECT b, a FROM al WHERE a != '' AND b != ''),
walk AS (SELECT norm, norm AS seen FROM (SELECT DISTINCT norm FROM m) UNION SELECT norm, b FROM walk JOIN arcs ON a = seen),
comp AS (SELECT norm, min(seen) AS entity FROM walk GROUP BY norm)"""


@query(f"WITH RECURSIVE {_SQL_RECORD}, {_SQL_COMPONENTS} SELECT norm, entity FROM comp")
def alias_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)


_SQL_CANON = f"""{_SQL_RECORD}, {_SQL_COMPONENTS},
named AS (SELECT m.*, entity FROM m JOIN comp USING (norm)),
canon AS (SELECT entity, arg_min(name, (chunk_id, pos, name, type)) AS name, arg_min(type, (chunk_id, pos, name, type)) AS type, count(DISTINCT chunk_id) AS chunks FROM named GROUP BY entity),
forms AS (SELECT DISTINCT entity, name AS form FROM named UNION SELECT entity, unnest(aliases) FROM named),
meta AS (SELECT entity, bool_and(regexp_matches(title_path, '文档历史|文件历史|修订记录|文档变更')) AS metadata_only
  FROM named JOIN chunks c ON c.id = named.chunk_id WHERE c.title_path != '' GROUP BY entity),
ce AS (SELECT canon.*, {_CLASS.replace('metadata_only', 'coalesce(metadata_only, false)')} AS role FROM canon LEFT JOIN meta USING (entity))"""


@query(
    f"""WITH RECURSIVE {_SQL_CANON} SELECT entity, name, type, coalesce((SELECT string_agg(form, ';' ORDER BY form) FROM forms WHERE forms.entity = ce.entity AND form != ce.name), '') AS aliases, chunks, role FROM ce"""
)
def canonical_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per component: the earliest form and type, the other forms as aliases, and the role by
    the rules of names and the titles of the chunks."""
    out = graph.canonical(_mentions(spark, d), _components(spark, d), table(spark, d, "chunks"), generic_words(spark, d))
    return out.withColumn("aliases", F.array_join("aliases", ";"))


@query(
    f"""WITH RECURSIVE {_SQL_CANON}, once AS (SELECT DISTINCT j::VARCHAR AS j, chunk_id, min(row_no) AS row_no FROM good WHERE status = 'ok' GROUP BY 1, 2)
SELECT a.entity AS source, p AS predicate, b.entity AS target, r2.chunk_id FROM r2 JOIN once USING (row_no) JOIN comp a ON a.norm = sn JOIN comp b ON b.norm = on_
WHERE a.entity != b.entity AND a.entity IN (SELECT entity FROM ce WHERE role = 'keep') AND b.entity IN (SELECT entity FROM ce WHERE role = 'keep')"""
)
def relation_materialize(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the records between kept components, without self-loops, duplicates kept."""
    kept = graph.canonical(_mentions(spark, d), _components(spark, d), table(spark, d, "chunks"), generic_words(spark, d)).where("role = 'keep'")
    named = _components(spark, d).join(kept.select("entity"), "entity", "left_semi")
    rows = graph.relations_of(table(spark, d, "graph_extract"))
    out = rows.join(named.select(F.col("norm").alias("s"), F.col("entity").alias("source")), "s").join(named.select(F.col("norm").alias("o"), F.col("entity").alias("target")), "o")
    return out.where("source != target").select("source", "predicate", "target", "chunk_id")


@query(
    f"""WITH {_WEIGHTS}, {_DEGREES}, {_NODES}, top AS (SELECT * FROM w ORDER BY weight DESC, a, b LIMIT 8000),
shown AS (SELECT * FROM top WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes))
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM shown) AS edges, (SELECT count(*) FROM nodes) >= 5000 OR (SELECT count(*) FROM shown) >= 8000 AS truncated"""
)
def full_graph_size(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the full view, and whether its limits cut it."""
    edges = _edges(spark, d)
    nodes = graph.full_nodes(table(spark, d, "entities").select("id", "graph_role"), edges)
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(graph.full_edges(edges, nodes).agg(F.count("*").alias("edges")))  # one row each
    return counts.withColumn("truncated", (F.col("nodes") >= graph.FULL_NODES) | (F.col("edges") >= graph.FULL_EDGES))


@query()
def full_graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """The full view's nodes with their type, degree and community; a node without a shown edge is its own."""
    edges = _edges(spark, d)
    nodes = materialize(graph.full_nodes(table(spark, d, "entities").select("id", "name", "type", "graph_role"), edges), "nodes")
    found = communities.communities(graph.full_edges(edges, nodes)).withColumnRenamed("node", "id")
    return nodes.drop("graph_role").join(found, "id", "left").withColumn("community", F.coalesce("community", "id"))


@query()
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the whole weighted graph."""
    return communities.communities(_edges(spark, d))
