import math
import sqlite3

from pyspark.sql import functions as F

from fernlode.operators import ranking, vectors

V = "query_id long, embedding array<float>"


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cosine_order_threshold_and_unusable(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0], "x"), (2, [0.8, 0.6], "x"), (3, [0.0, 1.0], "x"), (4, [0.0, 0.0], "x"), (5, None, "x"), (6, [1.0], "x"), (7, [None, 1.0], "x")],
        "id long, embedding array<float>, q string",
    )
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], V)
    out = vectors.cosine_top_k(rows, asked, 2, dim=2, min_similarity=0.5)
    assert _rows(out, "query_id", "rank", "id", "similarity") == [(9, 1, 1, 1.0), (9, 2, 2, 0.8)]


def test_cosine_ties_repeats_and_empty(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(3, [1.0, 0.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [2.0, 0.0])], V)
    out = vectors.cosine_top_k(rows, asked, 15, dim=2)
    assert [r.id for r in out.orderBy("rank").collect()] == [0, 1, 2, 3, 3, *range(4, 14)]
    assert vectors.cosine_top_k(rows.limit(0), asked, 5, dim=2).count() == 0
    assert vectors.cosine_top_k(rows, asked.limit(0), 5, dim=2).count() == 0


def _route(spark, *ids):
    return spark.createDataFrame([(0, i, n) for n, i in enumerate(ids, 1)], "query_id long, id long, rank int")


def test_fusion(spark):
    fused = ranking.fuse({"a": _route(spark, 1, 2), "b": _route(spark, 2, 3)}, "query_id", "id", limit=3)
    assert [r.id for r in fused.orderBy("rank").collect()] == [2, 1, 3]
    assert [r.sources for r in fused.orderBy("rank").collect()] == ["a+b", "a", "b"]
    alone = ranking.fuse({"a": _route(spark, 5, 4, 5), "b": _route(spark).limit(0)}, "query_id", "id")
    assert [r.id for r in alone.orderBy("rank").collect()] == [5, 4]


def test_bm25_against_full_text_index(spark):
    texts = ["alpha beta gamma", "beta beta delta", "gamma", "", "检索配置中心检索", "xalphax beta", "BETA in capitals", "unrelated words"]
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(content, tokenize='trigram')")
    base.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for words in ("beta", "alpha beta", "检索配置", "be beta"):
        asked = spark.createDataFrame([(1, words)], "query_id long, q string")
        got = {r.id: r.score for r in ranking.bm25(docs, asked, "id", "text", "query_id", "q").collect()}
        long = " ".join(w for w in words.split() if len(w) > 2)
        want = dict(base.execute("select rowid, bm25(t) from t where t match ?", (long,)).fetchall())
        assert set(got) == set(want)
        assert all(math.isclose(got[i], want[i], abs_tol=2e-6) for i in want)


def test_query_words(spark):
    asked = spark.createDataFrame([(1, 'say "hello" World'), (2, "what?"), (3, None), (4, "  "), (5, "ab")], "q long, t string")
    assert _rows(ranking.query_words(asked, "q", "t"), "q", "word") == [(1, "hello"), (1, "say"), (1, "world")]
    assert (2, "what") in _rows(ranking.query_words(asked, "q", "t", strict=False), "q", "word")


def test_overlapping_occurrences(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, None)], "id long, text string")
    words = spark.createDataFrame([("aaa",)], "word string")
    assert _rows(ranking.term_counts(docs, words, "id", "text"), "id", "tf") == [(1, 2)]


def test_diversify_equals_greedy_choice(spark):
    import random

    rnd = random.Random(4)
    hits, want = [], {}
    for q in range(40):
        n, k = rnd.randint(1, 30), 10
        rows = sorted(((round(rnd.random(), 4), i, rnd.randint(0, 4)) for i in range(n)), reverse=True)
        hits += [(q, i, g, s, r) for r, (s, i, g) in enumerate(rows, 1)]
        head = [g for _, _, g in rows[:k]]
        if n <= k or max(map(head.count, head)) > 0.8 * k:
            want[q] = [i for _, i, _ in rows[:k]]
            continue
        left, used, picked = list(rows), {}, []
        while left and len(picked) < k:
            best = max(left, key=lambda x: (x[0] / (1 + 0.15 * max(0, used.get(x[2], 0) - 1)), -rows.index(x)))
            left.remove(best)
            used[best[2]] = used.get(best[2], 0) + 1
            picked.append(best[1])
        want[q] = picked
    df = spark.createDataFrame(hits, "q long, id long, g long, similarity double, rank int")
    got = {}
    for r in ranking.diversify(df, 10, "q", "g").orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got == want


def test_keyword_operators(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha gamma"), (3, "delta"), (4, None), (5, "")], "id long, text string")
    asked = {
        1: ("alpha NOT beta", {2}), 2: ("beta OR delta", {1, 3}), 3: ("alp* AND gamma", {2}), 4: ("NOT alpha", set()), 5: ("NOT alpha OR delta", {3}),
        6: ("alpha OR alpha", {1, 2}), 7: ("OR", set()), 8: ("al", set()), 9: ("alpha gamma NOT gamma", set()), 10: ("alpha - beta", set()), 11: ("", set()),
        12: ("alpha or beta", {1}),  # small letters make no operator, and "or" is too short to be a word
    }
    queries = spark.createDataFrame([(i, q) for i, (q, _) in asked.items()] + [(99, None)], "query_id long, q string")
    got = ranking.bm25(docs, queries, "id", "text", "query_id", "q").collect()
    assert {i: {r.id for r in got if r.query_id == i} for i in asked} == {i: want for i, (_, want) in asked.items()}
    assert not [r for r in got if r.query_id == 99]


def test_counts_above(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, None)], "query_id long, embedding array<float>")
    got = {r.query_id: r.above for r in vectors.count_above(df, asked, 0.7, dim=2).collect()}
    assert got == {10: 2}
    assert vectors.count_above(df.limit(0), asked, 0.7, dim=2).count() == vectors.count_above(df, asked.limit(0), 0.7, dim=2).count() == 0


def _first_of(df, *operators):
    """Which of the operators stands nearest to the result in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return min((plan.index(x), x) for x in operators if x in plan)[1]


def test_graph_route_against_counting(spark):
    """Memberships of a chunk may lie in several batches and be repeated; a chunk or an entity may be missing."""
    import random

    rnd = random.Random(7)
    hits = [(q, rnd.randint(0, 30)) for q in range(0, 500, 100) for _ in range(3)]
    rel = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(40)])) for _ in range(60)]
    held = [(rnd.choice([None, 7, *range(90)]), rnd.choice([None, *range(45)])) for _ in range(900)]
    near = {(a, b) for x, y in rel if None not in (x, y) for a, b in ((x, y), (y, x))}
    wide = set(hits) | {(q, b) for q, e in hits for a, b in near if a == e}
    want = {}
    for q, e in wide:
        for c in {c for c, x in held if x == e}:
            want[q, c] = want.get((q, c), 0) + 1
    frames = [
        spark.createDataFrame(hits, "query_id long, entity_id long"), spark.createDataFrame(rel, "source_entity_id long, target_entity_id long"),
        spark.createDataFrame(held, "chunk_id long, entity_id long"),
    ]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = ranking.graph_route(*frames, "query_id")
        assert _first_of(out, "Exchange", "MapInArrow") == "MapInArrow"  # nothing as large as the result is shuffled
        rows = out.collect()
        assert len(rows) == len(want) and {(r.query_id, r.chunk_id): r.n for r in rows} == want
        best = ranking.graph_route(*frames[:2], frames[2].where("chunk_id is not null"), "query_id", limit=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in {q for q, _ in hits}:
        first = sorted((-n, c) for (x, c), n in want.items() if x == q and c is not None)[:4]
        assert first == sorted((-r.n, r.chunk_id) for r in best if r.query_id == q)[: len(first)]
    assert ranking.graph_route(frames[0].limit(0), *frames[1:], "query_id").count() == ranking.graph_route(*frames[:2], frames[2].limit(0), "query_id").count() == 0


def test_best_keeps_ties_of_lower_ids():
    import random

    import numpy as np
    from fernlode.operators.best import Best

    rnd = random.Random(3)
    rows = [(rnd.randint(0, 4), rnd.randint(0, 6), i) for i in range(3000)]
    for ascending in (False, True):
        best = Best(6, 5, least=1, ascending=ascending)
        best.most = 40
        given = list(rows)
        if not ascending:
            rnd.shuffle(given)
        for a in range(0, len(given), 70):
            best.add(*(np.array(c) for c in zip(*given[a : a + 70])))
        want = [x for q in range(6) for x in sorted(((q, -v, i) for p, v, i in rows if p == q and v >= 1))[:5]]
        assert [(q, -v, i) for q, v, i in zip(*(x.tolist() for x in best.best()))] == want


def test_keyword_scores_by_limit_and_rows(spark):
    """Many queries of several alternatives against the formula; of some rows, only the best of each query."""
    import random

    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "alphabet", "betatron"]
    texts = {i: " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 9))) for i in range(300)} | {300: None, 301: ""}
    queries = {q: f"{a} {b} NOT {c} OR {d}" for q in range(0, 900, 100) for a, b, c, d in [rnd.choices(vocabulary, k=4)]}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id long, q string")
    known = {i: t for i, t in texts.items() if t is not None}
    mean = sum(max(0, len(t) - 2) for t in known.values()) / len(known)

    def part(word, text):
        n = sum(word in t for t in known.values())
        idf, tf = math.log((len(known) - n + 0.5) / (n + 0.5)), text.count(word)
        return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(0, len(text) - 2) / mean))

    want = {}
    for q, query in queries.items():
        a, b, _, c, _, d = query.split()
        for i, t in known.items():
            cases = [w for w, fits in (({a, b}, a in t and b in t and c not in t), ({d}, d in t)) if fits]
            if cases:
                want[q, i] = -sum(part(w, t) for words in cases for w in words)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = ranking.bm25(docs, asked, "id", "text", "query_id", "q")
        assert _first_of(out, "Exchange", "MapInArrow") == "MapInArrow"  # nothing as large as the result is shuffled
        got = {(r.query_id, r.id): r.score for r in out.collect()}
        some = docs.where("id % 3 = 0").select("id")
        best = ranking.ranked(ranking.bm25(docs, asked, "id", "text", "query_id", "q", among=some, limit=6), "query_id", "score", "id", limit=6)
        best = {(r.query_id, r["rank"]): (r.id, r.score) for r in best.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(math.isclose(got[x], want[x], abs_tol=2e-6) for x in want)
    for q in queries:
        first = sorted((s, i) for (x, i), s in got.items() if x == q and i % 3 == 0)[:6]
        assert [best[q, n] for n in range(1, len(first) + 1)] == [(i, s) for s, i in first]


def test_cosine_sends_the_best_of_a_task(spark, monkeypatch):
    """Ties over many batches: exact, and a task sends k rows of a query at most, however many batches it reads."""
    import random

    rnd = random.Random(2)
    rows = [(i, [rnd.randint(-2, 2) + 0.0, rnd.randint(-2, 2) + 0.0, 1.0]) for i in range(600)]
    asked = [(q, [float(q), 1.0, 0.5]) for q in range(-3, 3)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(2, "id")
    sent, products = [], vectors._products
    monkeypatch.setattr(vectors, "_products", lambda *a: sent.extend(products(*a)) or sent)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        for least in (-1.0, 0.4):
            sent.clear()
            out = vectors.cosine_top_k(df, spark.createDataFrame(asked, V), 5, dim=3, min_similarity=least)
            got = _rows(out, "query_id", "rank", "id", "similarity")
            assert sum(x.count() for x in sent) <= 2 * 5 * len(asked)
            want = []
            for q, v in asked:
                s = sorted((-round(sum(map(float.__mul__, v, r)) / math.hypot(*v) / math.hypot(*r), 6), i) for i, r in rows)
                want += [(q, n, i, -x) for n, (x, i) in enumerate(s[:5], 1) if -x >= least]
            assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shown_similarity_as_in_sql(spark):
    import duckdb

    values = [n / 1e6 for n in range(300_050, 1_000_000, 100)] + [0.58515, 0.50755, -0.58515, 0.0, 1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "similarity double")
    got = [r[0] for r in df.select(ranking.shown(df.similarity)).collect()]
    want = [duckdb.execute("select printf('%.4f', round(?::double, 4))", [v]).fetchone()[0] if v is not None else "BM25" for v in values]
    assert got == want and got[-6] == "0.5851"


def test_hybrid_routes_send_a_bounded_number_of_chunks(spark, monkeypatch):
    """Of each route, a task hands on no more chunks of a query than its result can show."""
    import os

    import pytest
    from fernlode.plans import retrieval

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    seen = {}
    for name in ("bm25", "graph_route"):
        monkeypatch.setattr(ranking, name, lambda *a, f=getattr(ranking, name), n=name, **k: seen.setdefault(n, f(*a, **k)))
    retrieval.hybrid_search_diverse(spark, folder)
    for name, most in (("bm25", 30), ("graph_route", 15)):
        per = seen[name].withColumn("task", F.spark_partition_id()).groupBy("task", "query_id").count().collect()
        assert per and max(r["count"] for r in per) <= most


def test_rounds_of_many_queries(spark, monkeypatch):
    """Queries that go to the tasks in several rounds get the same rows."""
    docs = spark.createDataFrame([(i, f"alpha{i % 3} beta{i % 5}") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(q, f"alpha{q % 3} OR beta{q % 5} NOT alpha1") for q in range(12)], "query_id long, q string")
    hits = spark.createDataFrame([(q, q % 7) for q in range(12)], "query_id long, entity_id long")
    rel = spark.createDataFrame([(1, 2), (3, 9)], "source_entity_id long, target_entity_id long")
    held = spark.createDataFrame([(c, c % 10) for c in range(50)], "chunk_id long, entity_id long")
    once = [_rows(ranking.bm25(docs, asked, "id", "text", "query_id", "q"), "query_id", "id", "score"), _rows(ranking.graph_route(hits, rel, held, "query_id"), "query_id", "chunk_id", "n")]
    monkeypatch.setattr(ranking, "WORD_BLOCK", 9)
    monkeypatch.setattr(ranking, "WIDE_BLOCK", 4)
    again = [_rows(ranking.bm25(docs, asked, "id", "text", "query_id", "q"), "query_id", "id", "score"), _rows(ranking.graph_route(hits, rel, held, "query_id"), "query_id", "chunk_id", "n")]
    assert once[0] and once[1] and once == again
