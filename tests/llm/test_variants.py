import itertools
import random

import pytest

from fernlode.llm import names, variants
from fernlode.operators import components


@pytest.fixture(scope="module")
def lex(spark):
    sounds, simple = variants._sounds(spark)
    return names.Lexicon(sounds, simple, frozenset(("konstantin", "cold", "storage")), frozenset(("云堤", "岭南湾", "望川")))


SAME = [
    ("Emanuel Harwaderrup", "Harwaderrup, Emanuel"), ("HULIZELUE Daniel", "Danile Hulizelue"), ("robert_corsemonkin", "Bob Corsemonkin"),
    ("Ing. Elizabeth Corpenikbeck", "Liz Corpenikbeck"), ("Valentina N. Yoregusius", "Vale Yiregusius"), ("Xaver Glytogelulis - ops", "Xaver Glytogelulis"),
    ("Demtonad Agricultural Machinery B.V.", "Agricultural Machinery, Demtonad"), ("Imbtrasol Eng. Consult.", "Imbtrasol Engineering Consultants Corporation"),
    ("Dung-owil Cold Storage", "Dungowil Cold Storage S.r.l."), ("GORSEREK-CS", "Gorserek Cold Storage GmbH"), ("余松静", "余 松·静"), ("余松静", "余松靖"),
    ("余松静(Yu Songjing)", "余松静"), ("湛石松工程师", "石松湛"), ("月海银电材", "云堤月海银电子材料股份有限公司"), ("Tianmuyue (望川)", "望川天木月贸易集团有限公司"),
    ("青塬菊秋雲軟件技術有限公司", "青塬菊秋云软件技术有限公司"), ("Ｆｌｏｏｒ map XH1056", "floor map XH1056"),
]
OTHER = [
    ("Daniel Trivimakski", "Jonas Trivimakski"), ("Floor map XH1055", "Floor map XH1056"), ("Kenneth A. Echfahavski", "Kenneth B. Echfahavski"),
    ("Gorserek Cold Storage", "Tamnalin Cold Storage"), ("余松静", "余松云"), ("云堤月海银电子材料厂", "望川月海银电子材料厂"), ("7.2 plan", "2.7 plan"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(lex, a, b):
    x, y = (names.parse(names.spelling(s), lex) for s in (a, b))
    assert names.compare(x, y, lex) == names.compare(y, x, lex) == 2
    assert set(names.keys(x, lex)) & set(names.keys(y, lex))


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(lex, a, b):
    x, y = (names.parse(names.spelling(s), lex) for s in (a, b))
    assert names.compare(x, y, lex) == names.compare(y, x, lex) == 0


def test_frequent_surname():
    known = names.Lexicon(common=frozenset(("smith", "robert", "smiths")))
    for a, b, want in [("Bob Smith", "Robert Smith", 2), ("Robert Smith", "R. Smith", 1), ("Bob Smith", "R. Smith", 1), ("Robert Smiht", "Bob Smith", 2),
                       ("Smith, Robert", "Rob Smith", 2), ("Xav Smith", "Xaver Smith", 2), ("Xaver Smith", "X. Smiht", 1), ("Rboert Smith", "Robert Smith", 2),
                       ("Xaver Smith", "Xaver Amith", 2), ("Robert Smith", "Daniel Smith", 0), ("Robert Smith", "D. Smith", 0), ("Robert S.", "Robert Smith", 0)]:
        x, y = (names.parse(names.spelling(s), known) for s in (a, b))
        assert names.compare(x, y, known) == names.compare(y, x, known) == want, (a, b)
        meet = {names.mate(k) for k in names.keys(x, known)} & set(names.keys(y, known))
        assert meet if want else not any(k[0] in "fg" for k in meet), (a, b)
    ron, robin = (names.parse(s, known) for s in ("roberta smith", "robin smith"))
    assert not {names.mate(k) for k in names.keys(ron, known)} & set(names.keys(robin, known)) & {"g|smith|rob<", "g|smith|rob>", "h|smith|r<"}


def test_edits():
    letters = "abc"
    words = ["".join(w) for n in range(4) for w in itertools.product(letters, repeat=n)]
    for a in words:
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in letters for d in (0, 1)}
        edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)} | {a}
        for b in words:
            assert names.near(a, b) == (b in edits), (a, b)


def test_aliases():
    assert names.aliases('["a", "b"]') == ["a", "b"] and names.aliases(None) == [] and names.aliases("小王") == ["小王"]
    assert names.aliases('["Isterdisolwood, Vicky"') == ["Isterdisolwood, Vicky"] and names.aliases("[1, null, \"x\"]") == ["x"]


def test_resolution(spark):
    rows = [
        (1, "Beatrix Galilutzak", "[]", "a"), (2, "begalil81", '["Beatrix Galilutzak"]', "a"), (3, "Galilutzak, B.", None, "a"), (4, "Beatrix Galilutzak", "broken", "a"),
        (5, "Daniel Trivimakski", '["the office"]', "a"), (6, "Jonas Trivimakski", '["the office"]', "a"), (7, "J. Trivimakski", "[]", "a"), (8, "D. Trivimakski", "[]", "a"),
        (9, None, None, "a"), (10, "", "[]", "a"), (11, "Petra Zimna", "[]", "a"), (12, "Patricia Zimna", "[]", "a"), (13, "P. Zimna", "[]", "a"), (None, "Petra Zimna", "[]", "a"),
        (14, "x" * 5000, "[]", "a"), (1, "Beatrix Galilutzak", "[]", "a"),
    ]
    df = spark.createDataFrame(rows, "id long, name string, aliases_json string, entity string")
    resolved = variants.resolve(df)
    got = sorted((r.id_a, r.id_b) for r in variants.pairs(resolved).collect())
    group = [1, 2, 3, 4]
    assert got == sorted([*itertools.combinations(group, 2), (5, 8), (6, 7)])  # P. Zimna fits two people
    assert variants.resolve(df.limit(0)).count() == 0


def test_frequent_alias_links_nothing(spark):
    rows = [(i, f"Name{chr(97 + i)} Surname{chr(97 + i)}{chr(98 + i)}x", '["Shared Alias"]') for i in range(8)]
    df = spark.createDataFrame(rows, "id long, name string, aliases_json string")
    assert variants.pairs(variants.resolve(df)).count() == 0


def test_frequent_alias_of_one_thing_links(spark):
    users = ["qx71", "wombat", "zebra", "lopper", "mistral"]
    rows = [(i, u, '["Beatrix Galilutzak"]') for i, u in enumerate(users)] + [(9, "Beatrix Galilutzak", "[]")]  # some row's own name
    agree = ["Oderwin Tamsalor", "Tamsalor, Oderwin", "Oderwinn Tamsalor", "Oderwin Tamsalorr", "falcon"]
    rows += [(20 + i, u, '["Uncle Fogwell"]') for i, u in enumerate(agree)]  # no own name; four of five agree
    rows += [(40 + i, f"Name{c} Surname{c}{c}x", '["Shared Alias"]') for i, c in enumerate("bcdfghk")]
    df = spark.createDataFrame(rows, "id long, name string, aliases_json string")
    got = sorted((r.id_a, r.id_b) for r in variants.pairs(variants.resolve(df)).collect())
    assert got == sorted([*itertools.combinations([0, 1, 2, 3, 4, 9], 2), *itertools.combinations(range(20, 25), 2)])


def test_conflicting_initials_stay_apart(spark):
    rows = [(1, "Kenneth A. Echfahavski"), (2, "Kenneth Echfahavski"), (3, "Kenneth B. Echfahavski"), (4, "Kennet Echfahavski"),  # two people, and no one knows whose 2 and 4 are
            (11, "Petra C. Zimnagol"), (12, "Petra Zimnagol"), (13, "Petra C. Zimnagool"), (14, "Zimnagol, Petra")]  # one person
    df = spark.createDataFrame([(i, n, "[]") for i, n in rows], "id long, name string, aliases_json string")
    got = sorted((r.id_a, r.id_b) for r in variants.pairs(variants.resolve(df)).collect())
    assert got == sorted([(2, 4), *itertools.combinations(range(11, 15), 2)])


def test_merged_profiles_are_compared(spark):
    """No spelling of the first row fits the last one, but what the merged profile's parts combine to does."""
    rows = [(1, "Robert Corsemonkin", '["Robert Corsemonkine"]'), (2, "Bob Corsemonkin", "[]"), (3, "Bob Corsemonkinee", "[]")]
    df = spark.createDataFrame(rows, "id long, name string, aliases_json string")
    assert variants.pairs(variants.resolve(df)).count() == 3


def test_hot_blocks_and_entities(spark, monkeypatch):
    """Spread blocks give the same pairs."""
    rows = [(i, f"{a}{b} Corsemonkin", "[]") for i, (a, b) in enumerate(itertools.product(("Robert", "Bob", "Rob", "Emanuel"), ("", ".", ",", " -", "  ")))]
    df = spark.createDataFrame(rows, "id long, name string, aliases_json string")
    want = sorted(map(tuple, variants.pairs(variants.resolve(df)).collect()))
    monkeypatch.setattr(variants, "BLOCK_ROWS", 2)
    assert sorted(map(tuple, variants.pairs(variants.resolve(df)).collect())) == want and len(want) > 60


def test_merged_labels(spark, monkeypatch):
    """One task and rounds of joins give the same labels, those of all edges at once."""
    rand = random.Random(1)
    nodes = [rand.randint(-(2**63), 2**63 - 1) for _ in range(60)]
    first, more = ([tuple(rand.sample(nodes, 2)) for _ in range(n)] for n in (25, 20))
    want = {n: n for n in nodes}
    for a, b in first + more:
        low, high = sorted((want[a], want[b]))
        want = {n: low if x == high else x for n, x in want.items()}
    start = spark.createDataFrame([(n, n) for n in nodes], "node long, label long")
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for few in (100_000, 0):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        labels = components.merged_labels(start, frame(first))
        of = {r.node: r.label for r in labels.collect()}
        labels = components.merged_labels(labels, frame([(of[a], of[b]) for a, b in more + more]))
        assert {r.node: r.label for r in labels.collect()} == want
        assert components.merged_labels(labels, frame([(n, n) for n in nodes])) is labels


def test_jobs_of_resolution(spark):
    """What the driver holds for a query follows the number of its jobs, so that is bounded."""
    rows = [(1, "Robert Corsemonkin", '["Robert Corsemonkine"]'), (2, "Bob Corsemonkin", "[]"), (3, "Bob Corsemonkinee", "[]"), (4, "R. Corsemonkin", "[]"),
            (5, "Petra C. Zimnagol", "[]"), (6, "Petra Zimnagol", "[]"), (7, "P. Zimnagol", "[]")]
    df = spark.createDataFrame(rows, "id long, name string, aliases_json string")
    spark.sparkContext.setJobGroup("resolution", "")
    try:
        got = sorted((r.id_a, r.id_b) for r in variants.pairs(variants.resolve(df)).collect())
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert got == sorted([*itertools.combinations(range(1, 5), 2), *itertools.combinations(range(5, 8), 2)])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("resolution"))
    assert 0 < jobs < 160
