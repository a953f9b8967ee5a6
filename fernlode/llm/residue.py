"""Template residue, filler, error messages and script notices in place of content.

A regularised linear classifier over hashed character n-grams, length and title features scores
every sentence of every text; the classifier alone decides. It is trained by Spark on a bounded
sample of documents, whose sentences get weak labels from response statuses and a few phrases of
each kind. A phrase that makes up little of a sentence of prose is talked about there, not shown, and
labels it as no residue, as does page furniture. Quotes and code are taken out before scoring.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fernlode.llm.furniture import TALK, host_of
from fernlode.llm.lookalike import reading

#: Bounds of the training sample: documents that are read for it, and plain sentences kept per hundred.
SAMPLE_DOCS, PLAIN_SHARE = 20_000, 4
#: Hashed features; orders of the character n-grams.
BITS, ORDERS = 16, (2, 4, 6)
REGULARISATION = 1e-5
#: Probability from which a sentence counts.
THRESHOLD = 0.5
#: Share of a sentence of prose that phrases must make up in order to be shown, not talked about.
SHOWN_SHARE = 0.25

# Weak labels by family, on lower-case text. Families of messages hold for sentences of
# up to LONGEST characters as a whole, the others for the part of a sentence that they match.
LONGEST = 120
_SLOT = r"[\w.\- ]{1,40}"
MESSAGES = {
    "status": r"^(?:error|http|status|fehler|错误)[ :]*[45]\d\d\b|^[45]\d\d[ :\-]+(?:[a-z\-]+ ){0,3}(?:found|gateway|forbidden|error|unavailable|time-?out|unauthorized|requests)\b|"
    r"(?:错误|超时|fehler|error)[ :(]*[45]\d\d\)?$|[(（][45]\d\d[)）]|(?:upstream|server) answered [45]\d\d|"
    r"^(?:not found|bad gateway|forbidden|internal server error|service (?:temporarily )?unavailable|gateway time-?out|too many requests|access denied)",
    "missing": r"\bdoes not exist|there is nothing at|not found\b|could not (?:be )?(?:fetch|load|found)|fail(?:ed|s)? to load|nicht gefunden|konnte nicht geladen|"
    r"kein inhalt|页面不存在|已被.{0,6}删除|加载失败|找不到|已失效",
    "refused": r"permission denied|not allowed to|not available in your|zugriff verweigert|fehlt ihnen|没有权限|无权访问|请联系管理员",
    "broken": r"unexpected error|went wrong|connection failed|error establishing|^traceback|^\w+error: '|返回异常|系统繁忙|开小差|interner fehler|include of .{1,60} failed|missing fragment|^\W?(?:error|fehler|错误)\b.{0,3}:",
    "later": r"try again|come back in|später (?:erneut|noch)|请刷新|请稍后|maintenance\.",
    "session": r"session has|sign in again|重新登录|登录已超时|slowed down|过于频繁|not a robot",
    "scripts": r"(?:javascript|\bjs\b|\bscripts?\b|scripting|脚本|skripte?\b|skripting).{0,30}(?:enable|requir|disabled|blocked|allow|switch|need|启用|开启|打开|禁用|需要|允许|才能|aktivier|benötig)|"
    r"(?:enable|requir|switch|turn|allow|need|does not support|启用|开启|未开启|不支持|需要|允许|aktivier\w*|benötigt|ohne).{0,30}(?:javascript|\bjs\b|\bscripts?\b|scripting|脚本|skripte?\b|skripting)",
    "unwritten": r"^(?:tb[acd]|coming soon|untitled section|section title|to be (?:written|done))\b|本节待|^placeholder\b|click to (?:add|edit)|单击此处|此处填写(?:正文|内容)|^platzhalter|^mustertext|"
    r"^replace this|dummy (?:text|section)|add your caption|type something",
}
SIGNS = {
    "braces": rf"\{{\{{\s*{_SLOT}\s*\}}\}}|\$\{{\s*{_SLOT}\s*\}}|\{{[^\W\d]\w{{1,30}}\}}",
    "percent": rf"<%=?\s*{_SLOT}\s*%>|%%{_SLOT}%%|@@{_SLOT}@@",
    "marks": rf"__[^\W_][\w.\-]{{0,38}}?__|«{_SLOT}»|\[\[{_SLOT}\]\]|#[^\W\d]\w{{1,30}}#|\$[^\W\d][\w ]{{1,30}}\$|xx[^\W\d]\w{{1,30}}?xx",
    "brackets": rf"[【\[<](?:(?:待填|此处填|请填写)[^】\]>]{{0,30}}|bitte [^】\]>]{{1,30}}eintragen|(?:your|add|enter|insert) {_SLOT})[】\]>]",
    "values": r"#ref!|#name\?|\[object object\]|\bnull null\b|\(null\)|\b(?:by|for|dear|to|and|zwischen|und|von|ab) (?:undefined|nan|null)\b|[于由与为](?:undefined|nan|null)(?![a-z])",
    "repeats": r"\b([^\W\d_]{3,12}(?: [^\W\d_]{3,12})?)\b(?:[ ,.]+(?:even )?(?:more )?\1\b){2,}|([一-鿿]{2,6})\2{2,}",
    "latin": r"\b(?:lorem|ipsum|dolor|sit amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|veniam|nostrud)\b",
}
FAMILIES = (*MESSAGES, *SIGNS)
# Words that prose of a living language has and filler hasn't; a number that may be a status.
PROSE = re.compile(r"\b(?:the|of|to|is|was|with|for|der|die|das|und|mit|ist)\b|[的了是在]")
_NUMBER = re.compile(r"(?<![\w.\-/])[45]\d\d(?![\w\-])")
_CODED = re.compile(r"[\w+/=]{60,}", re.A)
#: Stands where a quote or code was.
SHOWN = "\x04"
_MESSAGE = {k: re.compile(v) for k, v in MESSAGES.items()}
_SIGN = {k: re.compile(v) for k, v in SIGNS.items()}


def families(sentence: str) -> tuple[set[str], float]:
    """Families of weak labels that a sentence shows, and the share of it that they make up."""
    found, covered = set(), 0
    if len(sentence) <= LONGEST:
        found = {k for k, p in _MESSAGE.items() if p.search(sentence)}
        if found:
            return found, 1.0
    for k, p in _SIGN.items():
        length = sum(m.end() - m.start() for m in p.finditer(sentence))
        if length:
            found.add(k)
            covered += length
    return found, covered / max(1, len(sentence))


_QUOTED = re.compile(r"`[^`]*`|“[^”]*”|\"[^\"]{4,}\"|„[^“”]*[“”]|「[^」]*」")
_LINK = re.compile(r"(?:[-*+]\s+)?\[[^\]]*\]\(/[^)]*\)$")
_SENTENCES = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])(?=\S)|\n")
#: A trailing record mark, which isn't part of the sentence.
_TRAILING = re.compile(r"\s*[（(](?:rec\.|存|id|ref|req|trace)[^()（）]*[)）]\s*$")


def sentences(text: str) -> list[tuple[str, bool, bool]]:
    """(sentence in lower case, is it the first line, is it a heading) of a text, without front
    matter, fenced code, indented code and table rows."""
    text = reading(text)
    if text.startswith("---\n") and (end := text.find("\n---", 4)) > 0:
        text = text[end + 4 :]
    parts = re.split(r"^\s*(?:```|~~~).*$", text, flags=re.M)
    out: list[tuple[str, bool, bool]] = []
    for part in parts[::2]:
        for line in part.lower().split("\n"):
            bare = line.strip()
            if not bare or line.startswith(("    ", "\t")) or bare.startswith("|") or _LINK.match(bare):
                continue
            heading = bare.startswith("#") and bare.lstrip("#")[:1] == " "
            bare = _TRAILING.sub("", re.sub(r"^(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s+|\*\*)+", "", bare)).strip("* ")
            pieces = _SENTENCES.split(bare) if len(bare) > 80 else [bare]
            for piece in pieces:
                said = _QUOTED.sub(SHOWN, piece).strip()
                # else it shows something, or is a code
                if len(said) >= len(piece) / 2 and said != SHOWN and not _CODED.search(said):
                    out.append((said, not out, heading))
    return out


def weak_label(sentence: str, without: frozenset[str] = frozenset()) -> int | None:
    """1 residue, 0 a quote, a mention, page furniture or a number that is no status, None plain, or of a family
    that is left out."""
    if SHOWN in sentence or TALK.match(sentence):
        return 0
    found, share = families(sentence)
    if not found:
        return 0 if _NUMBER.search(sentence) else None
    if share < SHOWN_SHARE and PROSE.search(sentence):
        return 0
    return None if found & without else 1


def features(batch: list[tuple[str, bool, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the sentences: hashed n-grams of each order, then length and title."""
    size = 1 << BITS
    text = "".join(f"\x02{s}\x03\n" for s, _, _ in batch)  # n-grams know where a sentence begins and ends
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48  # one digit stands for all
    ends = np.flatnonzero(codes == 10)
    row = np.searchsorted(ends, np.arange(len(codes)), side="left")
    length = np.diff(np.concatenate([[-1], ends])) - 1
    rows, cols, values = [], [], []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order * 7919, np.uint64)
        for k in range(order):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = row[:n] == row[order - 1 : order - 1 + n]
        inside &= codes[order - 1 : order - 1 + n] != 10
        rows.append(row[:n][inside])
        cols.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
        values.append(1.0 / np.sqrt(np.maximum(length[rows[-1]] - order + 1, 1)))
    # a short sentence is a feature as a whole
    short = [(k, zlib.crc32(s.encode("utf-8", "surrogatepass")) & (size - 1)) for k, (s, _, _) in enumerate(batch) if len(s) <= 24]
    if short:
        at, whole = np.array(short).T
        rows.append(at)
        cols.append(whole)
        values.append(np.ones(len(at)))
    every = np.arange(len(batch))
    bucket = np.minimum(np.log2(np.maximum(length, 1)).astype(np.int64), 10)
    first = np.array([f for _, f, _ in batch])
    heading = np.array([h for _, _, h in batch])
    rows += [every, every[first], every[heading]]
    cols += [size + bucket, np.full(first.sum(), size + 11), np.full(heading.sum(), size + 12)]
    values += [np.ones(len(batch)), np.ones(first.sum()), np.ones(heading.sum())]
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


WIDTH = (1 << BITS) + 13


def scores(batch: list[tuple[str, bool, bool]], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of residue for each sentence."""
    if not batch:
        return np.empty(0)
    row, col, value = features(batch)
    z = np.bincount(row, weights[col] * value, len(batch)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_SCHEMA = StructType([StructField("host", StringType()), StructField("families", StringType()), StructField("label", DoubleType()), StructField("features", VectorUDT())])
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _vectors(batch: list[tuple[str, bool, bool]]) -> pa.Array:
    """features() as sparse vectors of Spark's own kind."""
    row, col, value = features(batch)
    key, at = np.unique(row * np.int64(WIDTH) + col, return_inverse=True)
    joint = np.bincount(at, value)
    offsets = pa.array(np.searchsorted(key, np.arange(len(batch) + 1) * WIDTH), pa.int32())
    indices = pa.ListArray.from_arrays(offsets, pa.array(key % WIDTH, pa.int32()))
    values = pa.ListArray.from_arrays(offsets, pa.array(joint, pa.float64()))
    n = len(batch)
    return pa.StructArray.from_arrays([pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, WIDTH), pa.int32()), indices, values], fields=list(_VECTOR))


def labelled(documents: DataFrame, n_docs: int, id_col: str = "doc_id", text_col: str = "normalized_text", source_col: str = "source") -> DataFrame:
    """(host, families, label, features): training sentences of at most about SAMPLE_DOCS documents."""
    share = max(1, -(-n_docs // SAMPLE_DOCS))
    rows = documents.where(F.length(text_col) > 0).where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, hosts, labels, kinds = [], [], [], []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(source, text) or (source or "")
                for one in sentences(text):
                    label = weak_label(one[0])
                    if label is None:
                        # short lines are few sentences in number but many in kind
                        share_ = PLAIN_SHARE * (8 if len(one[0]) < 40 else 1)
                        if zlib.crc32(f"{len(text)} {one[0]}".encode("utf-8", "surrogatepass")) % 100 >= share_:
                            continue
                        label = 0
                    kept.append(one)
                    hosts.append(host)
                    labels.append(float(label))
                    kinds.append(",".join(sorted(families(one[0])[0])) if label else "")
            if kept:
                columns = [pa.array(hosts, pa.string()), pa.array(kinds, pa.string()), pa.array(labels, pa.float64()), _vectors(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=_SCHEMA.names)

    pairs = rows.select(F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    # the sample is bounded; spread, as a few files may hold all of it
    pairs = pairs.repartition(max(2, documents.sparkSession.sparkContext.defaultParallelism))
    return pairs.mapInArrow(run, _SCHEMA)


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias, fitted by Spark; with a single label, a model that finds nothing."""
    data = rows.select("label", "features").persist()
    kinds = {r[0]: r[1] for r in data.groupBy("label").count().collect()}
    if len(kinds) < 2:
        data.unpersist()
        return np.zeros(WIDTH), -30.0
    # the rarer label counts as much as the other one, within reason
    weight = float(np.clip(kinds[0.0] / kinds[1.0], 1, 20))
    # each partition of the bounded sample sends a whole gradient every round, so few of them
    weighted = data.coalesce(8).withColumn("w", F.when(F.col("label") == 1, weight).otherwise(1.0))
    fit = LogisticRegression(regParam=REGULARISATION, elasticNetParam=0.0, maxIter=60, tol=1e-4, standardization=False, weightCol="w", aggregationDepth=2)
    model = fit.fit(weighted)
    data.unpersist()
    return model.coefficients.toArray(), float(model.intercept)


def validate(documents: DataFrame, without: tuple[str, ...] = (), **columns: str) -> dict[str, float]:
    """Precision and recall on the weak labels of hosts that training never saw.

    without: families whose sentences training never saw on any host; found and total then count
    those of them, on all hosts, that show no other family.
    """
    rows = labelled(documents, documents.count(), **columns).persist()
    held = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    left_out = F.arrays_overlap(F.split("families", ","), F.array(*map(F.lit, without))) if without else F.lit(False)
    weights, bias = train(rows.where(~held & ~left_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(3)
            flat = weights[parts.field("indices").flatten().to_numpy()] * parts.field("values").flatten().to_numpy()
            sizes = np.diff(parts.field("indices").offsets.to_numpy())
            z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), flat, len(sizes)) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z > 0)], names=["families", "host", "label", "hit"])

    scored = rows.where(held | left_out).select("families", "host", "label", "features")
    scored = scored.mapInArrow(run, "families string, host string, label double, hit boolean")
    alone = F.size(F.array_except(F.split("families", ","), F.array(*map(F.lit, without)))) == 0 if without else F.lit(False)
    counts = scored.groupBy("label", "hit", alone.alias("apart"), held.alias("held")).count().collect()
    rows.unpersist()
    n = lambda **x: sum(r["count"] for r in counts if all(r[k] == v for k, v in x.items()))
    tp, fp, fn = n(label=1.0, hit=True, held=True), n(label=0.0, hit=True, held=True), n(label=1.0, hit=False, held=True)
    found, missed = n(label=1.0, hit=True, apart=True), n(label=1.0, hit=False, apart=True)
    return {"precision": tp / max(1, tp + fp), "recall": tp / max(1, tp + fn), "positives": tp + fn, "found": found, "total": found + missed}


def residue_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "normalized_text", source_col: str = "source"
) -> DataFrame:
    """(id): documents of which some passage is residue.

    Whole texts are scored. Null and empty texts, null ids and texts that are only code never come;
    repeated rows of an id come once; with no residue to learn from nothing comes.
    """
    n_docs = documents.count()
    weights, bias = train(labelled(documents, n_docs, id_col, text_col, source_col))
    model = documents.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            found: list[int] = []
            held: list[tuple[str, bool, bool]] = []
            owner: list[int] = []

            def flush() -> None:
                p = scores(held, w, b)
                hits = np.flatnonzero(p >= THRESHOLD)
                found.extend({owner[k] for k in hits})
                held.clear()
                owner.clear()

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = sentences(text.as_py())
                held += parts
                owner += [i] * len(parts)
                if len(held) > 20_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(found)), pa.int64())], names=["id"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.where("id is not null and length(text) > 0").mapInArrow(run, "id long").distinct().withColumnRenamed("id", id_col)
