"""Files as documents: binary scan, decoding and conversion to Markdown."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.functions.text import EXTENSIONS, extension, sensitive_path


def scan_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, modified, size, content) of the wanted files under the folders, without those that
    hold keys or passwords. A folder that is missing raises."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    return wanted(rows)


def wanted(rows: DataFrame) -> DataFrame:
    path = F.col("path")
    rows = rows.where(extension(path).isin(*EXTENSIONS) & ~sensitive_path(path))
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def decode(content: bytes) -> str:
    """UTF-8, else GBK, without byte order mark; all line ends become line feeds."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("gbk", "replace")
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def _cells(row: list[str], width: int) -> str:
    return "| " + " | ".join((c.replace("|", "\\|").replace("\n", " ") for c in [*row, *[""] * (width - len(row))])) + " |"


def _pipe_table(rows: list[list[str]]) -> str:
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(max((k + 1 for k, c in enumerate(r) if c.strip()), default=1) for r in rows)
    lines = [_cells(r[:width], width) for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def docx_markdown(content: bytes) -> str:
    """Paragraphs, headings by style, and tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))[0]
    out = []
    for block in body:
        if _tag(block) == "p":
            text = "".join(e.text or "" for e in block.iter() if _tag(e) == "t")
            style = next((v for e in block.iter() if _tag(e) == "pStyle" for k, v in e.attrib.items()), "")
            level = re.search(r"(?:heading|berschrift|标题)\s*(\d)", style, re.I)
            out.append("#" * int(level[1]) + " " + text if level and text else text)
        elif _tag(block) == "tbl":
            rows = [["".join(t.text or "" for t in c.iter() if _tag(t) == "t") for c in r if _tag(c) == "tc"] for r in block if _tag(r) == "tr"]
            out.append(_pipe_table(rows))
    return "\n\n".join(x for x in out if x)


def xlsx_markdown(content: bytes) -> str:
    """Every sheet that isn't empty as a heading and a table."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in root]
    titles = [e.attrib.get("name", "") for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
    out = []
    for n, title in enumerate(titles, 1):
        if f"xl/worksheets/sheet{n}.xml" not in names:
            continue
        rows = []
        for row in (e for e in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{n}.xml")).iter() if _tag(e) == "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row):
                letters = re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
                cells[at - 1 if letters else k] = shared[int(value)] if c.attrib.get("t") == "s" and value else value
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        if table := _pipe_table(rows):
            out.append(f"# {title}\n\n{table}")
    return "\n\n".join(out)


def pptx_markdown(content: bytes) -> str:
    """Slides in order, their paragraphs as a list."""
    book = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((int(m[1]), n) for n in book.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for k, (_, name) in enumerate(slides, 1):
        paragraphs = (e for e in ElementTree.fromstring(book.read(name)).iter() if _tag(e) == "p")
        texts = ["".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in paragraphs]
        out.append("\n".join([f"## 幻灯片 {k}", *(f"- {t}" for t in texts if t.strip())]))
    return "\n\n".join(out)


class _Page(HTMLParser):
    SKIPPED = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "form"))

    def __init__(self) -> None:
        super().__init__()
        self.title, self.out, self.skip, self.mark, self.in_title = "", [], 0, "", False

    def handle_starttag(self, tag, attrs) -> None:  # noqa: ANN001
        self.skip += tag in self.SKIPPED
        self.in_title = tag == "title"
        if re.fullmatch("h[1-6]", tag):
            self.mark = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.mark = "- "
        elif tag in ("p", "div", "article", "section", "tr"):
            self.mark = ""
            self.out.append("\n")

    def handle_endtag(self, tag) -> None:  # noqa: ANN001
        self.skip -= tag in self.SKIPPED and self.skip > 0
        self.in_title = False
        if re.fullmatch("h[1-6]|p|li", tag):
            self.out.append("\n")

    def handle_data(self, data) -> None:  # noqa: ANN001
        if self.in_title:
            self.title += data
        elif not self.skip and data.strip():
            self.out.append(self.mark + " ".join(data.split()))
            self.mark = ""


def html_markdown(html: str, url: str = "", fetched_at: str = "") -> str:
    """The page's text under a front matter that names its source."""
    page = _Page()
    page.feed(html)
    body = re.sub(r"\n{2,}", "\n\n", "".join(page.out)).strip()
    front = f"---\nsource: {url}\nfetched_at: {fetched_at}\n---\n\n" if url else ""
    title = page.title.strip()
    return front + (f"# {title}\n\n" if title and not body.startswith("# ") else "") + body


def parse_files(rows: DataFrame) -> DataFrame:
    """(path, name, fmt, content_hash, size, text, error_message) of scanned files.

    A file that can't be read has a null text and a message; a blank one says so and keeps ''.
    """

    def convert(path: str, content: bytes) -> tuple[str | None, str | None]:
        kind = path.rpartition(".")[2].lower()
        try:
            if kind == "docx":
                text = docx_markdown(content)
            elif kind == "xlsx":
                text = xlsx_markdown(content)
            elif kind == "pptx":
                text = pptx_markdown(content)
            elif kind == "html":
                text = html_markdown(decode(content))
            elif kind in ("md", "txt"):
                text = decode(content)
            else:
                return None, f"no converter for {kind}"
        except Exception as e:  # a broken file fails alone
            return None, f"{type(e).__name__}: {e}"[:200]
        return text, None if text.strip() else "no text"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [convert(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in done], "error_message": [m for _, m in done]})

    base = F.regexp_extract("path", "[^/]+$", 0)
    facts = rows.select("path", base.alias("name"), extension(F.col("path")).alias("fmt"), F.sha2("content", 256).alias("content_hash"), "size")
    texts = rows.select("path", "content").mapInPandas(run, "path string, text string, error_message string")
    return facts.join(texts, "path")
