import pytest

from fernlode.llm import furniture, residue

BODY = [f"The {a} desk moves the {b} file to hall {n}, because the older copy was unreadable." for n, (a, b) in enumerate((x, y) for x in ("front", "back", "night", "field", "data", "help") for y in ("risk", "price", "valve"))]


def _page(n, host="site.example", nav="Home | Products | Forum", extra=()):
    body = [BODY[n % len(BODY)], BODY[(n * 5 + 3) % len(BODY)]]
    return "\n".join(["---", f"source: https://{host}/{n}", "---", "", nav, "Home / Risk / Plan", f"# Page {n}: notes", "", *body, *extra, "", "Related articles:", f"- [Valve log {n}](/r/{n})", f"- [Price list {n}](/r/1{n})", "", "© 2024 Site", "Quiet corner for readers"])


def test_host_template(spark):
    rows = [(n, _page(n), "site.example", "web") for n in range(30)] + [(100, _page(1, "one.test"), "one.test", "web"), (101, None, "site.example", "web"), (102, "", None, "web"), (103, _page(2), "site.example", "md"), (None, _page(3), "site.example", "web")]
    df = spark.createDataFrame(rows, "doc_id long, normalized_text string, source string, fmt string")
    got = {}
    for r in furniture.furniture_lines(df).collect():
        got.setdefault(r.doc_id, set()).add(r.line_no)
    assert set(got) == {*range(30), 100}
    for n in range(30):
        # menu, breadcrumb, listing and its two slots, copyright, the host's own line; never title or body
        assert got[n] == {5, 6, 12, 13, 14, 16, 17}, n
    assert {5, 6, 12, 13, 14, 16} <= got[100] and not got[100] & {7, 9, 10}
    assert furniture.furniture_lines(df.limit(0)).count() == 0


def test_tree_matching_against_brute_force():
    import itertools
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([(rnd.randint(0, 3), frozenset(rnd.sample(range(4), rnd.randint(0, 2)))) for _ in range(rnd.randint(0, 5))] for _ in range(2))
        weight = lambda p: sum(1 + len(a[i][1] & b[j][1]) for i, j in p)  # noqa: B023, E731
        best = 0
        for k in range(min(len(a), len(b)) + 1):
            for x in itertools.combinations(range(len(a)), k):
                for y in itertools.combinations(range(len(b)), k):
                    if all(a[i][0] == b[j][0] for i, j in zip(x, y)):
                        best = max(best, weight(list(zip(x, y))))
        assert weight(furniture.match_trees(a, b)) == best


def test_listing_slots():
    text = "# T\n\nSome body text that ends here.\n### Tags\n#One\n#Two\nBody again, a whole sentence.\nAdvertisement\nFirst title\nA teaser of it. [more]\nSecond title\nAnother teaser…\nBody text follows the last teaser."
    page = [(no, kind, key in furniture.LISTINGS, bool(key and furniture.TALK.match(key)), False, False, 0, 0) for no, kind, key, _ in furniture.nodes(text, "x.example")]
    assert furniture.judge_page(page) == [4, 5, 6, 8, 9, 10, 11, 12]


RESIDUE = ["Dear {{ customer_name }}, your order ${order_no} is ready.", "404 Not Found", "Service temporarily unavailable", "本应用需要 JavaScript 才能运行。", "Lorem ipsum amentum fusca velit quisar morbius pretor.", "[Error: snippet 'map_9' not found]", "编制：<待填：部门>  审核：__甲方__"]
MENTIONS = ['Visitors of the kiosk saw the line "please enable JavaScript" in 9 cases.', "Typesetters use lorem ipsum to judge line length.", "On the night shift the status page answered with error 404 for 9 minutes.", "In the shell script, `${HOME}` points to the service account."]


@pytest.mark.parametrize("line", RESIDUE)
def test_weak_residue(line):
    assert 1 in [residue.weak_label(s) for s, _, _ in residue.sentences(line)]


@pytest.mark.parametrize("line", MENTIONS)
def test_weak_mentions(line):
    assert all(residue.weak_label(s) == 0 for s, _, _ in residue.sentences(line))


def test_residue_documents(spark):
    rows, bad = [], set()
    for n in range(300):
        lines = [BODY[(n * 7 + k) % len(BODY)].replace("hall", f"hall {n}") for k in range(4)]
        if n % 10 == 0:
            lines.insert(2, RESIDUE[n // 10 % len(RESIDUE)])
            bad.add(n)
        elif n % 10 == 5:
            lines.insert(2, MENTIONS[n // 10 % len(MENTIONS)])
        elif n % 10 == 7:
            lines.insert(2, "```\nDear {{ customer_name }},\n```")
        rows.append((n, "\n\n".join(lines), f"h{n % 20}.example", "x"))
    rows += [(900, None, None, "x"), (901, "", None, "x"), (None, "404 Not Found", None, "x"), (0, rows[0][1], "h0.example", "x"), (902, BODY[0] * 2000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, normalized_text string, source string, id string")
    got = [r.doc_id for r in residue.residue_documents(df).collect()]
    assert sorted(got) == sorted(bad)
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_unseen_hosts(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    import os

    if not os.path.exists(path):
        pytest.skip("no test tables")
    found = residue.validate(spark.read.parquet(path))
    assert found["positives"] > 5 and found["precision"] >= 0.9 and found["recall"] >= 0.9
    apart = residue.validate(spark.read.parquet(path), without=("percent",))  # a kind of slot that training never saw
    assert apart["total"] > 0 and apart["found"] >= 0.5 * apart["total"]


def test_no_residue_to_learn_from(spark):
    df = spark.createDataFrame([(i, BODY[i % len(BODY)], "a.example") for i in range(20)], "doc_id long, normalized_text string, source string")
    assert residue.residue_documents(df).count() == 0
