"""Entity graph: extraction records, names, rules, views and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlode.functions.text import trimmed
from fernlode.operators.components import connected_components
from fernlode.operators.lifecycle import endpoints

EXTRACTION = (
    "entities array<struct<name:string,type:string,aliases:array<string>>>,"
    "relations array<struct<subject:string,predicate:string,object:string>>"
)
# Limits of an extraction record and of the views.
MAX_ALIASES, MAX_ENTITIES, MAX_RELATIONS = 12, 8, 6
FULL_NODES, FULL_EDGES, LOCAL_EDGES, LOCAL_NODES = 5000, 8000, 160, 81
# Rules of names, as they decide which names become entities and edges.
GENERIC = ("用户", "客户", "员工", "人员", "公司", "团队", "部门", "单位", "流程", "制度", "规范", "管理", "工作", "内容", "问题", "情况", "方面", "措施")
GENERIC_EACH = r"^各[一个]?(护理单元|科室|部门|单位|病区|单元|岗位|级|类)"
DOCUMENT_NUMBER = r"^[A-Z]{2,4}(?:-[A-Z]{2,4})+-[0-9]"
BROKEN = r"[（(][^）)]*\z|、|^只能|^不[是定止]|及以上\z|以下\z|以内\z|（[^）]*）[^\n]{0,6}的\z"
TABLE_CELL = r"^[^\s\x{3000}]{1,8}(?:[0-9]+(?:\.[0-9]+)?\s*(?:m|cm|分|元|%|倍|岁|℃))\z"
METADATA_TITLE = "文档历史|文件历史|修订记录|文档变更"
SHORT_CHINESE = r"^[一-龥]{2,4}\z"
CONNECTORS = "及各种|以及|等等|什么的|比如|例如|包括|还有"
CODE = r"(?i)《|》|NU-|T/|GB\s|WS\s|Q/|〔|（[0-9]|[A-Z]{2,}[/-][0-9]"
DATE_OR_NUMBER = r"^[0-9\s.\-:：年月日时分秒/号]+\z"
OUTER = (r"^[\"'【\[（(]+|[\"'】\]）)]+\z", r"[。，；：!！?？]+\z")
MAX_NAME, MAX_CODED, MAX_ROLE_NAME = 18, 60, 20


def parse_extraction(raw: Column) -> Column:
    """The record as a struct; what stands between the first and last brace counts; null if that
    is no record."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), EXTRACTION)


def normalized_name(name: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+", "")


def clean_name(name: Column) -> Column:
    """Without outer quotes and brackets, then without final punctuation."""
    inner = F.regexp_replace(trimmed(name), OUTER[0], "")
    return trimmed(F.regexp_replace(inner, OUTER[1], ""))


def meaningful(name: Column) -> Column:
    """At least two characters and at most MAX_NAME, or MAX_CODED with the sign of a code or title; no
    connector, no date or number alone."""
    longest = F.when(name.rlike(CODE), MAX_CODED).otherwise(MAX_NAME)
    return (F.length(name) >= 2) & (F.length(name) <= longest) & ~name.rlike(DATE_OR_NUMBER) & ~name.rlike(CONNECTORS)


def validated(record: Column) -> Column:
    """Cleaned entities and the relations whose two ends are among them, within the limits.

    Ends and names are compared in normal form; a relation keeps its own wording. Null unless the
    record has both lists.
    """
    named = F.filter(record["entities"], lambda e: trimmed(e["name"]) != "")
    entities = F.transform(
        named,
        lambda e: F.struct(
            clean_name(e["name"]).alias("name"),
            F.coalesce(F.nullif(trimmed(e["type"]), F.lit("")), F.lit("concept")).alias("type"),
            F.slice(F.filter(F.transform(F.coalesce(e["aliases"], F.array().cast("array<string>")), trimmed), lambda a: a != ""), 1, MAX_ALIASES).alias("aliases"),
        ),
    )
    entities = F.slice(F.filter(entities, lambda e: F.coalesce(meaningful(e["name"]), F.lit(False))), 1, MAX_ENTITIES)
    names = F.transform(entities, lambda e: normalized_name(e["name"]))
    good = F.filter(
        record["relations"],
        lambda r: F.array_contains(names, normalized_name(r["subject"]))
        & F.array_contains(names, normalized_name(r["object"]))
        & (trimmed(r["predicate"]) != ""),
    )
    relations = F.transform(
        F.slice(good, 1, MAX_RELATIONS),
        lambda r: F.struct(
            trimmed(r["subject"]).alias("subject"), trimmed(r["predicate"]).alias("predicate"), trimmed(r["object"]).alias("object")
        ),
    )
    both = record["entities"].isNotNull() & record["relations"].isNotNull()
    return F.when(both, F.struct(entities.alias("entities"), relations.alias("relations")))


def only_metadata(title: Column) -> Column:
    """Aggregate over the title paths of a name's chunks: are all of them metadata sections?"""
    return F.coalesce(F.bool_and(title.rlike(METADATA_TITLE)), F.lit(False))


def classify(name: Column, metadata_only: Column | None = None, generic: tuple[str, ...] = ()) -> Column:
    """keep, weak or drop, by the first rule that holds.

    metadata_only: whether the name occurs in chunks, all of which lie in metadata sections.
    generic: further words without meaning of their own, of one library.
    """
    rules = (
        F.when(name.rlike(DOCUMENT_NUMBER), "weak")
        .when((F.length(name) > MAX_ROLE_NAME) | name.rlike(BROKEN), "drop")
        .when(name.rlike(TABLE_CELL), "drop")
    )
    if metadata_only is not None:
        rules = rules.when(name.rlike(SHORT_CHINESE) & metadata_only, "drop")
    return rules.when(name.isin(*GENERIC, *generic) | name.rlike(GENERIC_EACH), "weak").otherwise("keep")


def pending_chunks(chunks: DataFrame, documents: DataFrame, extracts: DataFrame, retry_failed: bool) -> DataFrame:
    """Chunks of done documents without a finished record; failed ones only with retry_failed."""
    state = extracts.where("status != 'processing'").groupBy("chunk_id").agg(F.bool_or(F.col("status") == "ok").alias("ok"))
    done = documents.where("status = 'done'").select(F.col("doc_id").alias("document_id"))
    joined = chunks.join(done, "document_id", "left_semi").join(state, chunks.id == state.chunk_id, "left")
    open_ = F.col("ok").isNull() | (~F.col("ok") if retry_failed else F.lit(False))
    return joined.where(open_).select("id", "document_id", "ordinal")


def edge_weights(relations: DataFrame) -> DataFrame:
    """(a, b, weight): relations between the same two entities in either direction, a <= b."""
    ends = relations.where("source_entity_id is not null and target_entity_id is not null")
    a, b = F.least("source_entity_id", "target_entity_id"), F.greatest("source_entity_id", "target_entity_id")
    return ends.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, degree): distinct neighbours; a self-loop counts once."""
    both = edges.select(F.col("a").alias("entity_id"), F.col("b").alias("near")).unionByName(
        edges.select(F.col("b").alias("entity_id"), F.col("a").alias("near"))
    )
    return both.distinct().groupBy("entity_id").agg(F.count("*").alias("degree"))


def full_nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The FULL_NODES kept entities of highest degree."""
    joined = entities.where("graph_role = 'keep'").join(degrees(edges).withColumnRenamed("entity_id", "id"), "id", "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id").limit(FULL_NODES)


def full_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The FULL_EDGES heaviest edges, then those of them whose ends are both among nodes."""
    top = edges.orderBy(F.desc("weight"), "a", "b").limit(FULL_EDGES)
    ids = nodes.select("id")
    return top.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def isolated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return entities.join(endpoints(relations).withColumnRenamed("entity_id", "id"), "id", "left_anti")


def local_edges(relations: DataFrame, centers: DataFrame) -> DataFrame:
    """(center, id, source, target, relation): up to LOCAL_EDGES relations that touch each center,
    of least id. A relation with both ends at one center counts once."""
    ends = relations.where("source_entity_id is not null and target_entity_id is not null")
    touch = ends.join(centers.select(F.col("id").alias("center"), F.col("id").alias("source_entity_id")), "source_entity_id").unionByName(
        ends.join(centers.select(F.col("id").alias("center"), F.col("id").alias("target_entity_id")), "target_entity_id")
    )
    once = touch.select("center", "id", "source_entity_id", "target_entity_id", "relation").distinct()
    nth = F.row_number().over(Window.partitionBy("center").orderBy("id"))
    return once.withColumn("nth", nth).where(F.col("nth") <= LOCAL_EDGES)


def local_nodes(edges: DataFrame) -> DataFrame:
    """(center, entity_id, degree): the center and its first neighbours in the order of the edges,
    LOCAL_NODES in all, with their degree within the view."""
    ends = edges.select("center", F.explode(F.array(F.struct("nth", F.lit(0).alias("s"), F.col("source_entity_id").alias("e")), F.struct("nth", F.lit(1).alias("s"), F.col("target_entity_id").alias("e")))).alias("x")).select("center", "x.*")
    first = ends.groupBy("center", F.col("e").alias("entity_id")).agg(F.min(F.struct("nth", "s")).alias("at"), F.countDistinct("nth").alias("degree"))
    order = (F.desc(F.col("entity_id") == F.col("center")), F.col("at"))
    nth = F.row_number().over(Window.partitionBy("center").orderBy(*order))
    return first.withColumn("rank", nth).where(F.col("rank") <= LOCAL_NODES).select("center", "entity_id", "degree", "rank")


def mentions(extracts: DataFrame) -> DataFrame:
    """(chunk_id, pos, name, type, norm, alias_norms, aliases): validated entities of finished records."""
    ok = extracts.where("status = 'ok' and result is not null").select("chunk_id", "result").distinct()
    parsed = ok.select("chunk_id", validated(parse_extraction(F.col("result"))).alias("r"))
    rows = parsed.select("chunk_id", F.posexplode("r.entities").alias("pos", "e"))
    return rows.select(
        "chunk_id", "pos", F.col("e.name").alias("name"), F.col("e.type").alias("type"), normalized_name(F.col("e.name")).alias("norm"),
        F.col("e.aliases").alias("aliases"), F.transform("e.aliases", normalized_name).alias("alias_norms"),
    )


def alias_edges(found: DataFrame) -> DataFrame:
    """(a, b): a name and its alias, in normal form; equal components are one entity."""
    return found.select(F.col("norm").alias("a"), F.explode("alias_norms").alias("b")).where("a != '' and b != ''").distinct()


def components_of(found: DataFrame) -> DataFrame:
    """(norm, entity): normal names of mentions() and the least name of their component."""
    labels = connected_components(alias_edges(found)).select(F.col("node").alias("norm"), "label")
    return found.select("norm").distinct().join(labels, "norm", "left").select("norm", F.coalesce("label", "norm").alias("entity"))


def canonical(found: DataFrame, components: DataFrame, chunks: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """(entity, name, type, aliases, chunks, role): one row per component of the mentions.

    The earliest form and type stand for it, the other forms are its aliases. chunks: id and
    title_path; chunks without a title don't speak for or against a metadata section.
    """
    named = found.join(components, "norm")
    at = F.struct("chunk_id", "pos", "name", "type")
    out = named.groupBy("entity").agg(
        F.min_by("name", at).alias("name"), F.min_by("type", at).alias("type"),
        F.array_union(F.collect_set("name"), F.flatten(F.collect_set("aliases"))).alias("forms"), F.count_distinct("chunk_id").alias("chunks"),
    )
    titles = chunks.where("title_path != ''").select(F.col("id").alias("chunk_id"), "title_path")
    meta = named.select("entity", "chunk_id").join(titles, "chunk_id").groupBy("entity").agg(only_metadata(F.col("title_path")).alias("meta"))
    out = out.join(meta, "entity", "left").withColumn("role", classify(F.col("name"), F.coalesce("meta", F.lit(False)), generic))
    return out.select("entity", "name", "type", F.array_sort(F.array_except("forms", F.array("name"))).alias("aliases"), "chunks", "role")


def relations_of(extracts: DataFrame) -> DataFrame:
    """(chunk_id, s, predicate, o): relations of finished records, ends in normal form; repeats stay."""
    ok = extracts.where("status = 'ok' and result is not null").select("chunk_id", "result").distinct()
    rows = ok.select("chunk_id", F.explode(validated(parse_extraction(F.col("result")))["relations"]).alias("r"))
    return rows.select("chunk_id", normalized_name(F.col("r.subject")).alias("s"), "r.predicate", normalized_name(F.col("r.object")).alias("o"))
