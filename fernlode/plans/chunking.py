"""Queries of parsing and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlode.operators import chunking
from fernlode.plans.registry import query
from fernlode.sources.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.split("normalized_text", "\n", -1).alias("lines"))
    return docs.select("doc_id", F.posexplode("lines").alias("line_no", "line"))


# The rules of numbered lines, written out for SQL, which has no lookahead: the sign after a number is part of the match.
_SQL_UNITS = "[倍折元年月日岁斤米升克℃°%版本]"
_SQL_RULES = (
    ("^第[一二三四五六七八九十百千零两0-9]+[章节篇]", "", "2"),
    ("^[一二三四五六七八九十百千零两]+、", "", "3"),
    ("^第[一二三四五六七八九十百千零两0-9]+条", "", "4"),
    ("^[（(][一二三四五六七八九十百千零两]+[)）]", "", "5"),
    ("^[0-9]{1,3}([.．][0-9]{1,3})+", "([^.．0-9]|$)", "len(string_split_regex(regexp_extract({x}, '^[0-9.．]+'), '[.．]')) + 1"),
    ("^[0-9]+[.．、]", "([^0-9]|$)", "6"),
    ("^[（(][0-9]+[)）]", "", "7"),
    ("^[①-⑳]", "", "8"),
)
_SQL_WHITE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+"


def _white(x: str) -> str:
    return f"regexp_replace({x}, '^{_SQL_WHITE}|{_SQL_WHITE}$', '', 'g')"


def _clause_sql(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, '{p}{end}') THEN CASE WHEN NOT regexp_matches({x}, '{p}{_SQL_UNITS}') THEN {level.format(x=x)} END" for p, end, level in _SQL_RULES)
    return f"CASE {cases} END"


_SQL_LINES = "ls AS (SELECT doc_id, unnest(string_split(normalized_text, chr(10))) AS line, generate_subscripts(string_split(normalized_text, chr(10)), 1) - 1 AS line_no FROM documents)"
_SQL_BOLD = _white("regexp_extract(bare, '^\\*\\*([^*]+)\\*\\*\\s*$', 1)")
_SQL_LEVEL = f"""CASE WHEN regexp_matches(bare, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(bare, '^(#{{1,6}})\\s', 1))
  WHEN {" OR ".join(f"regexp_matches(bold, '{p}{end}')" for p, end, _ in _SQL_RULES)} THEN 2 ELSE {_clause_sql("bare")} END"""


@query(
    f"""WITH {_SQL_LINES}, b AS (SELECT doc_id, {_white('line')} AS bare FROM ls), c AS (SELECT *, {_SQL_BOLD} AS bold FROM b)
SELECT doc_id, {_SQL_LEVEL} AS level, count(*) AS n FROM c GROUP BY 1, 2"""
)
def line_classify(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("doc_id", chunking.line_level(F.col("line")).alias("level")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_SQL_LINES}, h AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^# ') THEN trim(substr(line, 3)) END AS h1,
  CASE WHEN regexp_matches(line, '^## ') THEN trim(substr(line, 4)) WHEN regexp_matches(line, '^# ') THEN '' END AS h2 FROM ls),
f AS (SELECT doc_id, coalesce(last_value(h1 IGNORE NULLS) OVER w, '') AS a, coalesce(last_value(h2 IGNORE NULLS) OVER w, '') AS b FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, a || CASE WHEN a != '' AND b != '' THEN ' > ' ELSE '' END || b AS title_path, count(*) AS lines FROM f GROUP BY 1, 2"""
)
def title_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lines under each path of first and second headings."""
    line = F.col("line")
    h1 = F.when(line.rlike("^# "), F.trim(F.substr(line, F.lit(3))))
    h2 = F.when(line.rlike("^## "), F.trim(F.substr(line, F.lit(4)))).when(line.rlike("^# "), "")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(spark, d).select("doc_id", "line_no", h1.alias("h1"), h2.alias("h2"))
    rows = rows.select("doc_id", *(F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit("")).alias(c) for c in ("h1", "h2")))
    joint = F.when((F.col("h1") != "") & (F.col("h2") != ""), " > ").otherwise("")
    return rows.groupBy("doc_id", F.concat("h1", joint, "h2").alias("title_path")).agg(F.count("*").alias("lines"))


@query(
    f"""SELECT doc_id, s AS start_char, least(s + {chunking.TARGET}, n) AS end_char FROM (SELECT doc_id, n, unnest(CASE WHEN n <= {chunking.TARGET} THEN [0]
  ELSE range(0, n, {chunking.HARD_STEP}) END) AS s FROM (SELECT doc_id, length(normalized_text)::INT AS n FROM documents WHERE normalized_text != ''))"""
)
def hard_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("normalized_text != ''").select("doc_id", F.length("normalized_text").alias("n"))
    rows = docs.select("doc_id", "n", F.explode(chunking.hard_windows(F.col("n"))).alias("start_char"))
    return rows.select("doc_id", "start_char", F.least(F.col("start_char") + chunking.TARGET, F.col("n")).alias("end_char"))


@query(
    """SELECT doc_id, len(list_filter(string_split_regex(normalized_text, '[。；！？\\n]+'), lambda x: trim(x) != '')) AS sentences,
  coalesce(list_max(list_transform(string_split_regex(normalized_text, '[。；！？\\n]+'), lambda x: length(x))), 0) AS longest FROM documents WHERE normalized_text IS NOT NULL"""
)
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("normalized_text is not null")
    parts = F.split("normalized_text", r"[。；！？\n]+", -1)
    return docs.select(
        "doc_id",
        F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("long").alias("sentences"),
        F.array_max(F.transform(parts, F.length)).cast("long").alias("longest"),
    )


@query(
    """SELECT c.document_id, count(*) AS chunks, count(*) FILTER (WHERE substr(d.normalized_text, c.start_offset + 1, c.end_offset - c.start_offset) = c.text) AS exact,
  max(c.ordinal) + 1 = count(*) AS dense FROM chunks c JOIN documents d ON d.doc_id = c.document_id GROUP BY c.document_id"""
)
def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Do the stored chunks' offsets give their texts, and do the ordinals count without a gap?"""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "normalized_text")
    rows = table(spark, d, "chunks").join(docs, "document_id")
    body = F.substr("normalized_text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return rows.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.count_if(body == F.col("text")).alias("exact"), (F.max("ordinal") + 1 == F.count("*")).alias("dense")
    )


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents").where("status = 'done'"))


_SQL_BOLD_LINE = r"^\*\*\s*(([0-9]+|[一二三四五六七八九十]+|第.{1,4}[章条部分])[．.、：:\s])?([^*\n]{1,40})\*\*\s*$"


@query(
    f"""WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, x, {_white(f"regexp_extract(x, '{_SQL_BOLD_LINE}', 1)")} AS number, {_white(f"regexp_extract(x, '{_SQL_BOLD_LINE}', 3)")} AS body FROM ls)
SELECT doc_id, count(*) FILTER (length(body) >= 2 AND NOT regexp_matches(body, '[。；，,；]$')) AS bold,
  (sum(CASE WHEN length(body) >= 2 AND NOT regexp_matches(body, '[。；，,；]$') THEN 3 + length(number) + length(body) ELSE length(x) END) + count(*) - 1)::INT AS size FROM p GROUP BY doc_id"""
)
def promote_bold_headings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", chunking.promote_bold(F.col("text")).alias("new"))
    changed = F.filter(F.arrays_zip(F.split("text", "\n", -1).alias("a"), F.split("new", "\n", -1).alias("b")), lambda x: x["a"] != x["b"])
    return docs.select("doc_id", F.size(changed).cast("long").alias("bold"), F.length("new").alias("size"))


@query(
    r"""SELECT doc_id, length(regexp_replace(regexp_replace(text, '([一-龥]) +([一-龥])', '\1\2', 'g'), '([一-龥]) +([一-龥])', '\1\2', 'g')) AS size,
  len(lines) > 10 AND len(list_filter(lines, lambda x: length(regexp_replace(x, '[#|*\-\s\x{3000}]', '', 'g')) <= 3)) > 0.25 * len(lines) AS sparse
  FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: """ + _white("x") + """ != '') AS lines FROM documents WHERE fmt = 'pdf' AND text IS NOT NULL)"""
)
def pdf_text_cleanup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("fmt = 'pdf' and text is not null")
    tidy = chunking.tidy_pdf(F.col("text"))
    return docs.select("doc_id", F.length(tidy).alias("size"), chunking.broken_layout(tidy).alias("sparse"))


@query(
    r"""SELECT doc_id, length(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')) AS size,
  text != regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g') AS changed FROM documents WHERE text IS NOT NULL"""
)
def normalize_newlines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    clean = F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    return docs.select("doc_id", F.length(clean).alias("size"), (F.col("text") != clean).alias("changed"))


@query("SELECT fmt, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR regexp_full_match(text, '\\s*')) AS blank, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY fmt")
def formats(spark: SparkSession, d: str) -> DataFrame:
    blank = F.col("text").isNull() | F.col("text").rlike(r"^\s*$")
    return table(spark, d, "documents").groupBy("fmt").agg(
        F.count("*").alias("n"), F.count_if(blank).alias("blank"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")
    )
