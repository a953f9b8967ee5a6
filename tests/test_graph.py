import json
import random

import pytest

from fernlode.operators import communities, graph, lifecycle
from fernlode.operators.components import connected_components
from pyspark.sql import functions as F

REL = "id long, source_entity_id long, relation string, target_entity_id long, source_chunk_id long"


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, None), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs + pairs[:5], "a long, b long")
    got = {r.node: r.label for r in connected_components(df).collect()}
    assert got == {x: find(x) for a, b in pairs if b is not None for x in (a, b)}
    assert connected_components(df.limit(0)).count() == 0


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1) for s in (0, 10) for a in range(s, s + 6) for b in range(a + 1, s + 6)] + [(0, 10, 1), (3, 3, 2)]
    got = {r.node: r.community for r in communities.communities(spark.createDataFrame(edges, "a long, b long, weight long")).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]
    assert communities.communities(spark.createDataFrame([], "a long, b long, weight long")).count() == 0


def test_communities_over_several_levels(spark):
    """A ring of cliques: as good as the cliques themselves, which need more than one level to be beaten."""
    size, ring = 5, 24
    edges = [(size * c + a, size * c + b, 1) for c in range(ring) for a in range(size) for b in range(a + 1, size)]
    edges += [(size * c, (size * (c + 1) + 1) % (size * ring), 1) for c in range(ring)] + [(1000, 1000, 3), (1001, None, 1)]
    df = spark.createDataFrame([(min(a, b), max(a, b), w) if b is not None else (a, b, w) for a, b, w in edges], "a long, b long, weight long")
    got = {r.node: r.community for r in communities.communities(df).collect()}
    assert set(got) == set(range(size * ring)) | {1000} and all(got[n] == min(m for m in got if got[m] == got[n]) for n in got)

    def q(of):
        plain = [(a, b) for a, b, w in edges if b is not None and a != b]
        k, inside = {}, 0
        for a, b in plain:
            for x in (of[a], of[b]):
                k[x] = k.get(x, 0) + 1
            inside += 2 * (of[a] == of[b])
        m = 2 * len(plain)
        return inside / m - sum(x * x for x in k.values()) / m**2

    assert q(got) >= q({n: n // size for n in range(size * ring)}) - 1e-9


@pytest.mark.parametrize(
    ("name", "role"),
    [("NU-MP-01-046", "weak"), ("NU-MP-02-042-05 血栓评估表", "weak"), ("GPT-4.5", "keep"), ("主管护师及以上", "drop"), ("销售（B2B、咨询顾问", "drop"),
     ("法律、法规、规章或者诊疗技术规范", "drop"), ("只能发音", "drop"), ("平地行走45m", "drop"), ("25岁", "drop"), ("流程", "weak"), ("各部门", "weak"),
     ("护士", "keep"), ("门诊护士长", "keep"), ("特级护理", "keep"), ("危急值报告制度", "keep"), ("基金定投", "keep"), ("Barthel指数", "keep"),
     ("双人核对", "keep"), ("系统", "keep"), ("平台", "keep"), ("user", "keep"), ("客户", "weak"), ("a" * 21, "drop"), ("体温3m", "drop"), (None, "keep")],
)
def test_classify(spark, name, role):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(graph.classify(F.col("name"))).first()[0] == role


def test_classify_by_titles_and_own_words(spark):
    rows = [("纪淑云", "8. 文档历史 > | 版本号"), ("纪淑好", "5.内容 > 职责"), ("纪淑好", "8. 文档历史"), ("患者隐私保护制度", "8. 文档历史"), ("无标题", None)]
    df = spark.createDataFrame(rows, "name string, t string").groupBy("name").agg(graph.only_metadata(F.col("t")).alias("meta"))
    got = {r[0]: r[1] for r in df.select("name", graph.classify(F.col("name"), F.col("meta"))).collect()}
    assert got == {"纪淑云": "drop", "纪淑好": "keep", "患者隐私保护制度": "keep", "无标题": "keep"}
    own = spark.createDataFrame([("护士",)], "name string").select(graph.classify(F.col("name"), None, ("护士",)))
    assert own.first()[0] == "weak"


@pytest.mark.parametrize(
    ("name", "kept"),
    [("被污染的被服及各种污染物", False), ("客人", True), ("原因不明的死胎史，复发性自然流产（≥3次），由于毒血症或发育受限原因早产", False),
     ("2026年8月24日", False), ("12时30分", False), ("123", False), ("《博鳌恒大国际医院新冠疫情期间住院患者陪护人员及探视人员监测管理制度》", True),
     ("NU-SOP-02-003发生医疗锐器伤的应急处理程序", True), ("中华护理学会团体标准T/CNAS 18─2020", True), ("顾比均线止盈法", True), ("a", False), ("还有别的", False)],
)
def test_meaningful_names(spark, name, kept):
    df = spark.createDataFrame([(name,)], "name string").select(graph.clean_name(F.col("name")).alias("n"))
    assert df.select(graph.meaningful(F.col("n"))).first()[0] is kept


def test_graph_tables_with_aliases(spark):
    """Names joined by aliases, isolated entities and orphans on a fixture that has them."""
    def record(entities, relations=()):
        return json.dumps({"entities": [{"name": n, "aliases": list(a)} for n, *a in entities], "relations": [{"subject": s, "predicate": p, "object": o} for s, p, o in relations]}, ensure_ascii=False)

    rows = [(1, "ok", record([("DeepSeek", "DS"), ("Kimi",)], [("Deep Seek", "beats", "kimi"), ("deepseek", "is", "DeepSeek")])), (2, "ok", record([("DS", "深度"), ("深度求索", "深度")], [("DS", "is", "深度求索")])),
            (3, "ok", record([("流程",), ("Kimi",)], [("流程", "uses", "Kimi")])), (4, "failed", record([("Other",)])), (5, "ok", "{broken")]
    extracts = spark.createDataFrame(rows, "chunk_id long, status string, result string")
    chunks = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id long, title_path string")
    found = graph.mentions(extracts)
    assert sorted(tuple(r) for r in graph.alias_edges(found).collect()) == [("deepseek", "ds"), ("ds", "深度"), ("深度求索", "深度")]
    parts = graph.components_of(found)
    assert {r.norm: r.entity for r in parts.collect()} == {"deepseek": "deepseek", "ds": "deepseek", "深度求索": "deepseek", "kimi": "kimi", "流程": "流程"}
    got = {r.entity: (r.name, r.aliases, r.chunks, r.role) for r in graph.canonical(found, parts, chunks).collect()}
    assert got == {"deepseek": ("DeepSeek", ["DS", "深度", "深度求索"], 2, "keep"), "kimi": ("Kimi", [], 2, "keep"), "流程": ("流程", [], 1, "weak")}
    assert sorted((r.chunk_id, r.s, r.predicate, r.o) for r in graph.relations_of(extracts).collect()) == [
        (1, "deepseek", "beats", "kimi"), (1, "deepseek", "is", "deepseek"), (2, "ds", "is", "深度求索"), (3, "流程", "uses", "kimi")]
    entities = spark.createDataFrame([(i, f"e{i}") for i in range(1, 6)], "id long, name string")
    relations = spark.createDataFrame([(1, 1, "r", 2, 9), (2, 1, "r", None, 9)], REL)
    members = spark.createDataFrame([(9, 3), (9, 1)], "chunk_id long, entity_id long")
    assert sorted(r.id for r in graph.isolated(entities, relations).collect()) == [3, 4, 5]
    assert sorted(r.id for r in lifecycle.orphans(entities, members, relations).collect()) == [4, 5]


def test_extraction(spark):
    record = {"entities": [{"name": "【Deep Seek】", "type": "", "aliases": [" DS ", ""]}, {"name": "DS，"}, {"name": "2024年"}, {"name": "a 以及 b"}],
              "relations": [{"subject": "Deep Seek", "predicate": "is", "object": "DS"}, {"subject": "DS", "predicate": "", "object": "DS"}, {"subject": "x", "predicate": "y", "object": "DS"}]}
    rows = [(1, "ok", "```json\n" + json.dumps(record, ensure_ascii=False) + "\n```"), (2, "ok", "nothing"), (3, "ok", None), (4, "failed", "{}")]
    df = spark.createDataFrame(rows, "chunk_id long, status string, result string")
    found = graph.mentions(df)
    assert [(r.name, r.type, r.norm, r.alias_norms) for r in found.orderBy("pos").collect()] == [("Deep Seek", "concept", "deepseek", ["ds"]), ("DS", "concept", "ds", [])]
    labels = {r.node: r.label for r in connected_components(graph.alias_edges(found)).collect()}
    assert labels["deepseek"] == labels["ds"]
    got = df.select(graph.validated(graph.parse_extraction(F.col("result")))["relations"].alias("r")).first().r
    assert [tuple(x) for x in got] == [("Deep Seek", "is", "DS")]


def test_views(spark):
    rel = spark.createDataFrame([(1, 1, "r", 2, 9), (2, 2, "r", 3, 9), (3, 2, "r", 1, 9), (4, 1, "r", 1, 9), (5, None, "r", 1, 9)], REL)
    edges = graph.edge_weights(rel)
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 1, 1), (1, 2, 2), (2, 3, 1)]
    assert sorted(tuple(r) for r in graph.degrees(edges).collect()) == [(1, 2), (2, 2), (3, 1)]
    local = graph.local_edges(rel, spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.id for r in local.collect()) == [1, 3, 4]
    assert [(r.entity_id, r["rank"]) for r in graph.local_nodes(local).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_cascade_and_orphans(spark):
    t = {
        "documents": spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, path string"),
        "chunks": spark.createDataFrame([(10, 1), (20, 2)], "id long, document_id long"),
        "vec_index": spark.createDataFrame([(10, [1.0]), (20, None)], "chunk_id long, embedding array<float>"),
        "chunk_entities": spark.createDataFrame([(10, 5), (20, 6), (20, 6)], "chunk_id long, entity_id long"),
        "graph_extract": spark.createDataFrame([(10, "ok")], "chunk_id long, status string"),
        "relations": spark.createDataFrame([(1, 5, "r", 7, 10), (2, 6, "r", 6, 20), (3, 6, "r", 8, None)], REL),
        "entities": spark.createDataFrame([(5, "x"), (6, "y"), (7, "z"), (8, "w")], "id long, name string"),
    }
    left = lifecycle.cascade_delete(t, spark.createDataFrame([(1,), (1,), (99,)], "doc_id long"))
    assert {k: v.count() for k, v in left.items()} == {"documents": 1, "chunks": 1, "vec_index": 1, "chunk_entities": 2, "graph_extract": 0, "relations": 2, "entities": 2}


def test_states(spark):
    docs = spark.createDataFrame([("a", "h", "done"), ("b", "h", "failed")], "path string, content_hash string, status string")
    assert {r.status: r.n for r in lifecycle.status_counts(docs).collect()} == {"pending": 0, "processing": 0, "done": 1, "failed": 1}
    assert {r.path: r.skipped for r in lifecycle.skip_unchanged(docs.drop("status"), docs).collect()} == {"a": True, "b": False}
