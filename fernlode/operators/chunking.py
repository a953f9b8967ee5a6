"""Structure-aware chunks of Markdown and plain text, with source offsets.

Offsets count code points; a chunk's body is text[start_offset:end_offset], trimmed. Each text is
handled whole inside a task; texts are spread over tasks by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlode.functions.text import trimmed

# Default lengths; signs that make a number a quantity, not a clause.
TARGET, HARD_STEP, MIN_LENGTH, MAX_LENGTH = 400, 350, 30, 640
UNITS = "倍折元年月日岁斤米升克℃°%版本"
CONTINUED = "（续）"
# Chinese numerals, and numberings with their levels, in the order in which they are
# tried; a chain of numbers has the level of its parts and one.
NUMERALS = "一二三四五六七八九十百千零两"
CLAUSES = (
    (rf"^第[{NUMERALS}0-9]+[章节篇]", 2),
    (rf"^[{NUMERALS}]+、", 3),
    (rf"^第[{NUMERALS}0-9]+条", 4),
    (rf"^[（(][{NUMERALS}]+[)）]", 5),
    (r"^[0-9]{1,3}(?:[.．][0-9]{1,3})+(?![.．0-9])", 0),
    (r"^[0-9]+[.．、](?![0-9])", 6),
    (r"^[（(][0-9]+[)）]", 7),
    (r"^[①-⑳]", 8),
)
_BOLD, _HEADING = r"^\*\*([^*]+)\*\*\s*$", r"^(#{1,6})\s+(.+?)\s*$"


def clause_level(line: Column) -> Column:
    """Level of a numbered line as a column; null if it isn't one, or if a unit of quantity follows the number."""
    level = F.lit(None).cast("int")
    for pattern, n in reversed(CLAUSES):
        this = F.lit(n) if n else F.size(F.split(F.regexp_extract(line, pattern, 0), "[.．]")) + 1
        unit = line.rlike(f"{pattern}[{UNITS}]")
        level = F.when(line.rlike(pattern), F.when(~unit, this)).otherwise(level)
    return level


def line_level(line: Column) -> Column:
    """Level of a heading or numbered line: Markdown headings, bold numbered lines as 2, clauses."""
    bare = trimmed(line)
    bold = trimmed(F.regexp_extract(bare, _BOLD, 1))
    marks = F.length(F.regexp_extract(bare, _HEADING, 1))
    numbered = reduce(lambda a, b: a | b, (bold.rlike(p) for p, _ in CLAUSES))
    return F.when(marks > 0, marks).when(numbered, F.lit(2)).otherwise(clause_level(bare))


def level_of(line: str) -> tuple[int, bool, str] | None:
    """(level, is it a heading, label) of a line."""
    bare = line.strip()
    if m := re.match(_HEADING, bare):
        return len(m[1]), True, m[2].strip()
    if (m := re.match(_BOLD, bare)) and any(re.match(p, m[1].strip()) for p, _ in CLAUSES):
        return 2, True, m[1].strip()
    n = _clause(bare)
    return (n, False, bare[:40]) if n else None


def _clause(line: str) -> int:
    for pattern, n in CLAUSES:
        if m := re.match(pattern, line):
            if line[m.end() : m.end() + 1] in tuple(UNITS):
                return 0
            return n or len(re.split("[.．]", m[0])) + 1
    return 0


@dataclass
class Node:
    level: int
    label: str
    heading: bool
    start: int
    body: int
    end: int = 0
    children: list[Node] = field(default_factory=list)

    def has_heading(self) -> bool:
        return any(c.heading or c.has_heading() for c in self.children)


def structure(text: str) -> Node:
    """Tree of headings and numbered lines; a heading's line isn't part of its body, a clause's is."""
    root = Node(0, "", False, 0, 0, len(text))
    stack, at, fence = [root], 0, False
    for line in text.splitlines(keepends=True):
        if line.lstrip().startswith("```"):
            fence = not fence
        elif not fence and (found := level_of(line.rstrip("\r\n"))):
            level, heading, label = found
            while stack[-1].level >= level:
                stack.pop().end = at
            node = Node(level, label, heading, at, at + len(line) if heading else at)
            stack[-1].children.append(node)
            stack.append(node)
        at += len(line)
    for node in stack[1:]:
        node.end = len(text)
    return root


def _paragraphs(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans between blank lines."""
    out, at = [], a
    for m in re.finditer(r"\n[ \t]*\n\s*", text[a:b]):
        out.append((at, a + m.end()))
        at = a + m.end()
    return [*out, (at, b)] if at < b else out


class _Packer:
    def __init__(self, text: str, target: int, hard_step: int, least: int, most: int):
        self.text, self.target, self.hard_step, self.least, self.most = text, target, hard_step, least, most
        self.out: list[tuple[int, int, str, str, str]] = []

    def emit(self, a: int, b: int, path: tuple[str, ...], mark: str = "", head: str = "") -> None:
        body = self.text[a:b]
        a += len(body) - len(body.lstrip())
        b -= len(body) - len(body.rstrip())
        if b - a >= self.least:
            self.out.append((a, b, " > ".join(p for p in path if p), mark, head))

    def span(self, a: int, b: int, path: tuple[str, ...]) -> None:
        """One chunk if it fits, else paragraphs, sentences, table rows or windows."""
        if len(self.text[a:b].strip()) <= self.most:
            self.emit(a, b, path)
            return
        parts = _paragraphs(self.text, a, b)
        if len(parts) > 1:
            self.greedy(parts, path)
            return
        lines = self.text[a:b].strip("\n").split("\n")
        if len(lines) > 2 and all(x.strip().startswith("|") for x in lines) and re.match(r"^\s*\|[\s:|-]+$", lines[1]):
            self.table(a, b, path)
            return
        sentences, at = [], a
        for m in re.finditer(r"[。；！？\n]+|[.;!?]+(?=\s)", self.text[a:b]):
            sentences.append((at, a + m.end()))
            at = a + m.end()
        if at < b:
            sentences.append((at, b))
        self.greedy(sentences, path, mark=True)

    def greedy(self, parts: list[tuple[int, int]], path: tuple[str, ...], mark: bool = False) -> None:
        """Neighbouring spans joined up to the target; one that is too long alone is split further."""
        first, done = None, 0
        for a, b in parts:
            if first is not None and b - first > (self.most if mark else self.target):
                self.emit(first, a, path, CONTINUED if mark and done else "")
                first, done = None, done + 1
            if b - a > self.most:
                if len(parts) > 1 and not mark:
                    self.span(a, b, path)
                else:
                    for o in range(a, b, self.hard_step):
                        self.emit(o, min(o + self.target, b), path, CONTINUED if o > a or done else "")
                        if o + self.target >= b:
                            break
                done += 1
            elif first is None:
                first = a
        if first is not None:
            self.emit(first, parts[-1][1], path, CONTINUED if mark and done else "")

    def table(self, a: int, b: int, path: tuple[str, ...]) -> None:
        """Rows packed to the target, each piece under the table's own head; offsets cover the rows."""
        rows, at = [], a
        for line in self.text[a:b].splitlines(keepends=True):
            rows.append((at, at + len(line)))
            at += len(line)
        rows = [r for r in rows if self.text[r[0] : r[1]].strip()]
        head = self.text[rows[0][0] : rows[1][1]].strip("\n")
        first, n = None, 0
        for x, y in rows[2:]:
            if first is not None and len(head) + y - first > self.target:
                self.emit(first, x, path, CONTINUED if n else "", head)
                first, n = None, n + 1
            first = x if first is None else first
        if first is not None:
            self.emit(first, rows[-1][1], path, CONTINUED if n else "", head)

    def pack(self, node: Node, path: tuple[str, ...]) -> None:
        inner = (*path, node.label) if node.heading else path
        size = len(self.text[node.body : node.end].strip())
        if not node.children or (self.least <= size <= self.most and not node.has_heading()):
            self.span(node.body, node.end, inner)
            return
        if node.children[0].start > node.body:
            self.span(node.body, node.children[0].start, inner)
        first, last = None, 0
        for child in node.children:
            whole = child.end - child.start
            if child.heading or child.has_heading() or whole > self.target:
                if first is not None:
                    self.emit(first, last, inner)
                    first = None
                self.pack(child, inner)
                continue
            if first is not None and child.end - first > self.target:
                self.emit(first, last, inner)
                first = None
            first = child.start if first is None else first
            last = child.end
        if first is not None:
            self.emit(first, last, inner)


def chunk_text(
    text: str, fmt: str = "md", target: int = TARGET, hard_step: int = HARD_STEP, least: int = MIN_LENGTH, most: int | None = None
) -> list[tuple[int, str, str, int, int]]:
    """(ordinal, text, title path, start, end); the text is the path, the mark and the body.

    A text without a chunk of the least length is one chunk; a blank one has none.
    """
    if not text.strip():
        return []
    if most is None:
        most = MAX_LENGTH if target == TARGET else target
    packer = _Packer(text, target, hard_step, least, most)
    if fmt == "txt":
        packer.span(0, len(text), ())
    else:
        packer.pack(structure(text), ())
    if not packer.out:
        packer.least = 1
        packer.emit(0, len(text), ())
    out = []
    for n, (a, b, path, mark, head) in enumerate(sorted(packer.out)):
        title = path + (mark if path and not head else "")
        body = f"{head}\n{text[a:b]}" if head else text[a:b]
        shown = path + mark
        out.append((n, f"{shown} > {body}" if shown else body, title, a, b))
    return out


def chunk_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "normalized_text", fmt_col: str = "fmt", **options: int
) -> DataFrame:
    """(document_id, ordinal, text, title_path, start_offset, end_offset) of every document.

    Null and blank texts have no chunk; a null format is Markdown; repeated rows give repeated chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, *c)
                for i, t, f in zip(pdf["id"], pdf["text"], pdf["fmt"])
                if t
                for c in chunk_text(t, f or "md", **options)
            ]
            yield pd.DataFrame(rows, columns=["document_id", "ordinal", "text", "title_path", "start_offset", "end_offset"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(fmt_col).alias("fmt"))
    return rows.mapInPandas(
        run, "document_id long, ordinal int, text string, title_path string, start_offset int, end_offset int"
    )


# A whole line in bold, with a number or without, and the ends of a sentence.
BOLD_LINE = r"\*\*\s*((?:[0-9]+|[一二三四五六七八九十]+|第.{1,4}[章条部分])[．.、：:\s])?([^*\n]{1,40})\*\*\s*"
SENTENCE_END = "。；，,；"


def promote_bold(text: Column) -> Column:
    """Whole bold lines whose text without its number has 2 to 40 characters and ends no sentence become
    headings of level 2."""

    def line(x: Column) -> Column:
        number, body = trimmed(F.regexp_extract(x, f"^{BOLD_LINE}$", 1)), trimmed(F.regexp_extract(x, f"^{BOLD_LINE}$", 2))
        heading = x.rlike(f"^{BOLD_LINE}$") & (F.length(body) >= 2) & ~body.rlike(f"[{SENTENCE_END}]$")
        return F.when(heading, F.concat(F.lit("## "), number, body)).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def tidy_pdf(text: Column) -> Column:
    """Without the spaces between Chinese characters."""
    return F.regexp_replace(text, "(?<=[一-龥]) +(?=[一-龥])", "")


def broken_layout(text: Column) -> Column:
    """Do more than a quarter of more than ten lines that aren't blank have three characters at most,
    marks aside?"""
    lines = F.filter(F.split(text, "\n", -1), lambda x: trimmed(x) != "")
    short = F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"[#|*\-\s\x{3000}]", "")) <= 3)
    return (F.size(lines) > 10) & (F.size(short) > 0.25 * F.size(lines))


def hard_windows(length: Column, size: int = TARGET, step: int = HARD_STEP) -> Column:
    """Starts of overlapping windows over a long text."""
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length - 1, F.lit(step)))
