"""Page furniture and main body of web pages, by wrapper induction.

A page's Markdown is read as a tree: the page, its lines as nodes with a kind and a text, and the
items of a line or list as leaves. Pages of one host are aligned by simple tree matching in small
random groups; nodes that match on most pages are the host's template. Templates of several hosts
make a dictionary that carries over to hosts with a single page. What varies between template nodes
is content, except the slots under a listing heading (teasers, tags, advertisements).

Only hashes and kinds of lines are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.llm.lookalike import reading
from fernlode.session import materialize

#: Pages that are aligned with each other.
GROUP_PAGES = 16
#: Share of a host's pages on which a template node stands, at least: with n pages, TEMPLATE_SHARE +
#: 1 / sqrt(n), as chance plays a part on few pages; and pages a host must have for templates.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.3, 6

# Headings of listings beside the article.
LISTINGS = (
    "tags|related articles|you might also like|advertisement|sponsored|recent comments|most read|most read this week|popular posts|popular downloads|"
    "anzeige|ähnliche beiträge|schlagwörter|meistgelesen|neueste kommentare|gesponsert|"
    "相关阅读|热门文章|标签云|排行榜|推广信息|广告|最新评论|猜你喜欢"
).split("|")
# What a page says to its reader about itself, as patterns on folded lines; see _recurring_talk().
TALK = re.compile(
    r"^(?:"
    r"(?:print|save|share)\b.{0,40}\|.*|share (?:this|on)\b.*|read more\b.{0,6}|listen to this article\b.*|"
    r"was this (?:page|article) (?:useful|helpful).*|\d+ views\b.*|subscribe to our\b.*|follow us\b.*|back to top\b.*|"
    r"report a problem with this page.*|enter your e-?mail.*|change language\b.*|version \d+ \| .*|log ?in\b.{0,60}\||"
    r"some parts of this site\b.*|this site\b.*\b(?:cookies|stores|uses)\b.*|we use cookies\b.*|cookies help us\b.*|"
    r"your privacy settings\b.*|made with care by\b.*|(?:copyright )?©.*|.*\ball rights reserved\.?|"
    r".* is a reading room for .*|the pages of .{2,40} are prepared with care.*|"
    r".*· (?:imprint|privacy|terms)\b.*|"
    r"teilen\b.*\|.*|war dieser beitrag hilfreich.*|weiterlesen\b.{0,6}|nach oben|folgen sie uns\b.*|newsletter abonnieren|"
    r"mit der nutzung dieser seite\b.*|wir verwenden cookies\b.*|diese (?:seite|website) verwendet cookies.*|"
    r"impressum\b.*\|.*|für inhalte fremder seiten\b.*|artikel anhören.*|\d+ aufrufe\b.*|"
    r"分享到.*|打印本页.*|点击展开.*|长按识别.*|点赞\s*\d+.*|返回顶部|扫码.*|关注我们.*|客服热线.*|网站备案.*|友情链接.*|"
    r"版权所有.*|法律声明.*|为获得更好体验.*|我们会在您的设备.*|本站使用.*|本网站部分内容.*|阅读全文.*|收听本文.*"
    r")$"
)
# First items of breadcrumbs.
HOMES = frozenset(("home", "startseite", "首页", "start"))

_SEPARATED = re.compile(r"\s+[|›»>/·]\s+|\s{2,}|\s*\|\s*")
#: Ends of a line's parts, and what is left of a numbered name of the site.
_CLAUSES = re.compile(r"(?<=[.!?])\s+|[。！？:：\[\]【】/|]+")
_BRAND = re.compile(r"@[0\-.]*0")
_DECOR = re.compile(r"^(?:#{1,6}\s+|\*\*|[-*+]\s+|\d+[.)]\s+|>\s+)+|(?:\*\*|[:：])+\s*$")
_LINK = re.compile(r"^(?:[-*+]\s+)?\[([^\]]*)\]\([^)]*\)$")
_FINAL = re.compile(r"[.。！？!?…]['\"”’)）\]]*$|\[more\]$")

# Kinds of nodes.
BLANK, HEADING, LINKS, NUMBERED, BULLET, TAG, TABLE, CODE, TITLE, SENTENCE, TEASER, FRONT = range(12)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(source: str | None, text: str) -> str:
    """Host of a page: its source, or what its front matter says."""
    if source and "." in source and "/" not in source:
        return source.lower()
    found = re.search(r"^source:\s*(\S+)", text[:400], re.M) if text.startswith("---") else None
    return (urlsplit(found[1]).hostname or "") if found else ""


def nodes(text: str, host: str) -> list[tuple[int, int, str, list[str]]]:
    """(line from 1, kind, text of comparison, leaves) of every line."""
    label = max(re.split(r"[.\-]", re.sub(r"^(www|docs|blog|news|wiki)\.", "", host)), key=len, default="")
    brand = re.match(r"[a-z]*", label)[0]
    out: list[tuple[int, int, str, list[str]]] = []
    front = code = False
    for no, line in enumerate(text.split("\n"), 1):
        plain = reading(line).strip()
        if no == 1 and plain == "---":
            front = True
        elif front:
            out.append((no, FRONT, "", []))
            front = plain != "---" or no == 1
            continue
        if front:
            out.append((no, FRONT, "", []))
            continue
        if not plain:
            out.append((no, BLANK, "", []))
            continue
        if plain.startswith("```"):
            code = not code
            out.append((no, CODE, "", []))
            continue
        if code:
            out.append((no, CODE, "", []))
            continue
        low = plain.lower()
        link = _LINK.match(plain)
        bare = _DECOR.sub("", _DECOR.sub("", link[1].lower() if link else low)).strip()
        key = re.sub(r"\d+", "0", bare)
        if len(brand) >= 4:
            key = _BRAND.sub("@", key.replace(brand, "@"))
        items: list[str] = []
        if link:
            kind, items = LINKS, [bare]
        elif re.match(r"#\w", plain):
            kind = TAG
        elif re.match(r"#{1,6}\s", plain):
            kind = HEADING
        elif re.match(r"\d+[.)]\s", plain):
            kind = NUMBERED
        elif re.match(r"[-*+]\s", plain):
            kind, items = BULLET, [bare]
        elif plain.startswith("|"):
            kind = TABLE
        elif re.search(r"(?:…|\.\.\.|\[more\])$", plain):
            kind = TEASER
        elif _FINAL.search(plain) or len(plain) > 90:
            kind = SENTENCE
        else:
            kind = TITLE
        if kind in (TITLE, SENTENCE) and len(low) < 200:
            parts = [p for p in _SEPARATED.split(low) if p]
            if len(parts) > 1:
                items = parts
            elif len(low) < 24:
                items = [low]
        if kind in (TITLE, SENTENCE) and not items:
            items = [x.strip() for x in _CLAUSES.split(key) if x.strip()]
        out.append((no, kind, key, items))
    return out


def match_trees(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of the children of two roots that simple tree matching pairs: the alignment in
    order with the largest sum of matching nodes. A child is (label, leaves); children match if
    their labels are equal, and count one and their leaves in common."""
    m, n = len(a), len(b)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        row, up = best[i + 1], best[i]
        for j in range(n):
            w = up[j] + 1 + len(a[i][1] & b[j][1]) if a[i][0] == b[j][0] else 0
            row[j + 1] = max(w, up[j + 1], row[j])
    out, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _read_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, host, line_no, kind, key, leaves, talk, listing) of each line that isn't blank,
    front matter, code or table; first of the page's own lines is its title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(8))
            for i, source, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                host = host_of(source, text)
                site = _hash(host) if host else 0
                for no, kind, key, items in nodes(text, host):
                    if kind in (FRONT,):
                        continue
                    talk = bool(key) and kind not in (TABLE, CODE) and bool(TALK.match(key))
                    row = (i, site, no, kind, _hash(key) if key else 0, [_hash(x) for x in items], talk, key in LISTINGS)
                    if items and items[0] in HOMES and len(items) > 1:
                        row[5].insert(0, 1)  # a breadcrumb
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_())
            names = ["doc_id", "host", "line_no", "kind", "key", "leaves", "talk", "listing"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return pages.mapInArrow(
        run, "doc_id long, host long, line_no int, kind int, key long, leaves array<long>, talk boolean, listing boolean"
    )


def _align(pdf: pd.DataFrame) -> pd.DataFrame:
    """Evidence of one group of a host's pages: on how many other pages each node matched."""
    seen = Counter(k for _, page in pdf.groupby("doc_id") for k in set(page["key"]))
    trees = []
    for _, page in pdf.sort_values("line_no").groupby("doc_id"):
        # a node that stands on one page only can't match
        trees.append([(k, frozenset(x)) for k, x in zip(page["key"], page["leaves"]) if seen[k] > 1])
    matched: Counter = Counter()
    for i, a in enumerate(trees):
        for b in trees[i + 1 :]:
            for k in {a[p][0] for p, _ in match_trees(a, b)}:
                matched[k] += 2
    n = len(trees)
    return pd.DataFrame(
        {"host": pdf["host"].iloc[0], "key": list(seen), "pages": [seen[k] for k in seen], "matched": [matched[k] for k in seen], "pairs": n * (n - 1), "group": n}
    )


def furniture_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "normalized_text",
    source_col: str = "source",
    web: str = "fmt = 'web'",
) -> DataFrame:
    """(id, line_no): lines of web pages that are menus, banners, sidebars, footers and the like.

    Lines are split at line feeds and counted from 1. Null and empty texts, null ids and rows that
    `web` doesn't hold for have no lines. Blank lines, front matter, code and tables never come.
    Repeated rows of one id are one page. A page whose host is unknown is judged by the dictionary.
    """
    rows = df.where(F.expr(web)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = rows.where("doc_id is not null and length(text) > 0")
    lines = materialize(_read_pages(rows).dropDuplicates(["doc_id", "line_no"]), "lines")

    solid = lines.where(F.col("kind").isin(HEADING, LINKS, NUMBERED, BULLET, TAG, TITLE, SENTENCE, TEASER) & (F.col("host") != 0))
    pages = solid.select("host", "doc_id").distinct()
    counts = pages.groupBy("host").agg(F.count("*").alias("n")).where("n > 1")
    # as many groups as the host has sixteens of pages: a large host is spread over many tasks
    dealt = pages.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / GROUP_PAGES)))
    grouped = solid.join(dealt.select("host", "doc_id", "part"), ["host", "doc_id"]).select("host", "part", "doc_id", "line_no", "key", "leaves")
    evidence = grouped.groupBy("host", "part").applyInPandas(
        lambda key, pdf: _align(pdf), "host long, key long, pages long, matched long, pairs long, group long"
    )
    share = evidence.groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.sum("matched").alias("matched"))
    totals = dealt.groupBy("host", "part").agg(F.count("*").alias("g")).groupBy("host").agg(F.sum("g").alias("n"), F.sum(F.col("g") * (F.col("g") - 1)).alias("pairs"))
    # a node on a share s of the pages matches on a share s * s of the pairs
    template = share.join(totals, "host").where(
        (F.col("n") >= TEMPLATE_PAGES) & (F.col("matched") >= F.pow(TEMPLATE_SHARE + F.lit(1.0) / F.sqrt("n"), 2) * F.col("pairs")) & (F.col("pages") > 2)
    )
    template = materialize(template.select("host", "key"), "template")

    titles = lines.where(F.col("kind").isin(HEADING, TITLE)).groupBy("doc_id").agg(F.min("line_no").alias("first"))
    hosts_of = template.groupBy("key").agg(F.count("*").alias("hosts")).where("hosts > 1").select("key", F.lit(True).alias("known"))
    # menu labels: leaves of template nodes, counted over hosts
    on_template = lines.join(template, ["host", "key"], "left_semi").where(F.size("leaves") > 0)
    labels = on_template.select("host", F.explode("leaves").alias("leaf")).where("leaf != 1").distinct()
    labels = labels.groupBy("leaf").agg(F.count("*").alias("hosts")).select("leaf", F.lit(True).alias("menu"))
    leaves = lines.where("kind != 0").select("doc_id", "line_no", F.explode("leaves").alias("leaf"), F.size("leaves").alias("n"))
    menus = leaves.join(labels, "leaf").groupBy("doc_id", "line_no").agg(F.count("*").alias("menu_leaves"))
    flagged = (
        lines.join(template.withColumn("own", F.lit(True)), ["host", "key"], "left")
        .join(hosts_of, "key", "left")
        .join(menus, ["doc_id", "line_no"], "left")
        .join(_recurring_talk(lines), ["doc_id", "line_no"], "left")
    )
    crumb = F.coalesce(F.try_element_at("leaves", F.lit(1)) == 1, F.lit(False))
    facts = F.struct(
        "line_no",
        "kind",
        "listing",
        F.col("heard").isNotNull().alias("talk"),
        (F.col("own").isNotNull() | F.col("known").isNotNull()).alias("fixed"),
        crumb.alias("crumb"),
        (F.size("leaves") - crumb.cast("int")).alias("n"),
        F.coalesce("menu_leaves", F.lit(0)).cast("int").alias("menu"),
    )
    books = flagged.groupBy("doc_id").agg(F.array_sort(F.collect_list(facts)).alias("lines"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = [], []
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = judge_page([tuple(x.values()) for x in page])
                ids += [i] * len(found)
                nos += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=["doc_id", "line_no"])

    out = books.mapInArrow(judge, "doc_id long, line_no int")
    return out.withColumnRenamed("doc_id", id_col)


def _recurring_talk(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, heard): lines that talk to the reader and stand on other pages as well, of whatever
    host, as a whole or in all of their parts. Recurrence alone can't tell them from stock sentences of
    articles, which stand on as many pages; the wording alone doesn't make a line recur."""
    said = lines.where("talk").select("doc_id", "line_no", "key", "leaves")
    pages = said.select("doc_id", "key").distinct().groupBy("key").agg(F.count("*").alias("pages")).where("pages > 1").select("key")
    whole = said.join(pages, "key", "left_semi").select("doc_id", "line_no")
    parts = said.select("doc_id", "line_no", F.explode(F.array_distinct("leaves")).alias("leaf"), F.size(F.array_distinct("leaves")).alias("n"))
    known = parts.select("doc_id", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("pages")).where("pages > 1").select("leaf")
    pieced = parts.join(known, "leaf", "left_semi").groupBy("doc_id", "line_no").agg(F.count("*").alias("found"), F.max("n").alias("n"))
    return whole.unionByName(pieced.where("found = n").select("doc_id", "line_no")).distinct().withColumn("heard", F.lit(True))


def judge_page(page: list[tuple]) -> list[int]:
    """Furniture among a page's lines (no, kind, listing, talk, fixed, crumb, leaves, menu leaves)."""
    out: set[int] = set()
    k = 0
    while k < len(page):
        no, kind, listing, talk, fixed, crumb, leaves, menu = page[k]
        if kind in (BLANK, CODE, TABLE):
            k += 1
            continue
        is_menu = leaves > 0 and (menu == leaves or (leaves >= 3 and menu >= leaves - 1)) and kind in (LINKS, BULLET, TITLE, SENTENCE)
        # an unknown heading right above links or tags, two at least, heads a listing as well
        below = [x[1] for x in page[k + 1 : k + 3]]
        heads = kind in (TITLE, HEADING) and k > 0 and len(below) == 2 and below[0] == below[1] and below[0] in (TAG, LINKS)
        if listing or heads:
            out.add(no)
            k = _slot(page, k + 1, out)
            continue
        # a heading alone is the article's, however often a host repeats it
        if kind == TAG or talk or (fixed and kind != HEADING) or crumb or is_menu:
            out.add(no)
        k += 1
    return sorted(out)


def _slot(page: list[tuple], k: int, out: set[int]) -> int:
    """Takes the varying lines under a listing heading; the position after them."""
    if k >= len(page) or page[k][1] == BLANK:
        return k
    style = page[k][1]
    if style in (TAG, LINKS, NUMBERED):
        while k < len(page) and page[k][1] == style and not page[k][2]:
            out.add(page[k][0])
            k += 1
        return k
    after_text = False
    first = True
    pairs = k + 1 < len(page) and page[k + 1][1] in (SENTENCE, TEASER) and not page[k + 1][3]
    while k < len(page):
        no, kind, listing, talk, fixed, *_ = page[k]
        if listing or talk or (fixed and not first):
            return k
        if kind == TITLE:
            out.add(no)
            after_text = False
        elif kind in (SENTENCE, TEASER) and pairs and not after_text and not first:
            out.add(no)
            after_text = True
        else:
            return k
        first = False
        k += 1
    return k
