from fernlode.llm import lookalike


def test_reading():
    same = ["Café am 5", "Café am 5", "Ｃａｆé am ５", "C​a­f﻿é am 5", "Саfé аm 5"]
    assert len({lookalike.reading(s) for s in same}) == 1
    for other in ("café am 5", "Cafe am 5", "Café am 6", "Café\nam 5", "Caféam 5", "Café  am 5"):
        assert lookalike.reading(other) != lookalike.reading(same[0])
    assert lookalike.reading("⽉率ﬁ") == lookalike.reading("月率fi")
    assert lookalike.folded("STRASSE") == lookalike.folded("straße")
    for s in same:
        assert lookalike.reading(lookalike.reading(s)) == lookalike.reading(s)


def test_normalize_column(spark):
    df = spark.createDataFrame([("Ａ​b", 1), (None, 2), ("", 3), ("Ａ​b", 4)], "s string, normal int")
    assert [r.normal for r in lookalike.normalize(df, "s").collect()] == ["ab", None, "", "ab"]
    assert [r.normal for r in lookalike.normalize(df, "s", fold=False).collect()] == ["Ab", None, "", "Ab"]


def test_pairs_against_brute_force(spark):
    texts = ["Аlpha", "Alpha", "Alpha", "alpha", "Al​pha", "", None, "​", "Beta", "Ｂｅｔａ", "中⽉", "中月", "x" * 50000, "x" * 50000 + "⁠"]
    rows = [(i, s) for i, s in enumerate(texts)] + [(None, "Alpha")]
    df = spark.createDataFrame(rows, "id long, name string")
    got = sorted((r.id_a, r.id_b) for r in lookalike.same_reading_pairs(lookalike.readings(df, "id", "name")).collect())
    want = [
        (a, b)
        for a, s in enumerate(texts)
        for b, t in enumerate(texts)
        if a < b and s and t and s != t and lookalike.reading(s) == lookalike.reading(t) and lookalike.reading(s).strip()
    ]
    assert got == sorted(want) and (1, 2) not in got
    assert lookalike.same_reading_pairs(lookalike.readings(df.limit(0), "id", "name")).count() == 0


def test_one_hot_form(spark):
    rows = [(i, "Alpha") for i in range(3000)] + [(5000, "Аlpha")]
    df = spark.createDataFrame(rows, "id long, name string").repartition(4)
    got = lookalike.same_reading_pairs(lookalike.readings(df, "id", "name"))
    assert got.count() == 3000 and got.where("id_b != 5000").count() == 0


def test_many_copies_and_many_texts(spark):
    """Work follows the result: copies of a text aren't paired among themselves, in blocks or not."""
    rows = [(i, "Alpha") for i in range(20000)] + [(50000, "Аlpha"), (50001, "Аlpha")] + [(60000 + i, "Be" + "\u200b" * (i + 1) + "ta") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(4)
    got = lookalike.same_reading_pairs(lookalike.readings(df, "id", "name"))
    kinds = {r.hot: r["count"] for r in got.groupBy((got.id_a < 60000).alias("hot")).count().collect()}
    assert kinds == {True: 40000, False: 60 * 59 // 2} and got.distinct().count() == got.count()


def test_letters_of_the_public_data():
    assert lookalike.reading("Ꭺlрhа") == "Alpha" and lookalike.reading("ІТ") == "IT"
