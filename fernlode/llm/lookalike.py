"""One consistent form for strings that read alike but differ in their characters.

Each distinct value goes once through the vectorised normaliser: compatibility composition, removal
of default-ignorable characters, mapping of spaces, dashes and look-alike letters, and, for the
comparison key, full case folding.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlode.session import materialize

# Default-ignorable code points of the public character database that occur in texts.
IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯"
    "ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]+"
)
# Spaces that read as one blank, and hyphens that read as the plain one.
_SPACES = "               　"
_HYPHENS = "‐‑˗−"
# Letters that the public confusables data map to one Latin letter, in pairs; capitals
# drawn like I go to I, which those data give as l.
_LETTERS = (
    "ͿJ ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa γy ιi νv οo ρp σo υu ϜF ϱp ϲc ϳj ϹC ϺM ЅS ІI ЈJ АA ВB ЕE КK МM НH ОO РP СC "
    "ТT УY ХX Ьb аa гr еe оo рp сc уy хx ѕs іi јj ѡw ѴV ѵv ҮY үy һh ҽe ӀI ӏi ԁd ԌG ԛq ԜW ԝw ՍU ՏS ՕO աw գq զq հh ոn ռn սu ցg քf օo "
    "ᎠD ᎡR ᎢT Ꭵi ᎩY ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG Ꮒh ᏃZ Ꮟb ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK Ꮷd ᏳG ᏴB ᴄc ᴏo ᴜu ᴠv ᴡw ᴢz ꙇi ꬵf ꬽo ɑa ɡg ɣy ɩi ɪi ɯw ʋu ʏy"
)
_MAP = str.maketrans(
    {p[0]: p[1] for p in _LETTERS.split()} | dict.fromkeys(_SPACES, " ") | dict.fromkeys(_HYPHENS, "-")
)


def reading(text: str) -> str:
    """The form in which strings that read the same are equal; case, accents, digits and line
    breaks are kept."""
    if text.isascii():
        return text
    # composed last, as removed characters may have kept a letter and its accent apart
    text = IGNORABLE.sub("", unicodedata.normalize("NFKC", text)).translate(_MAP)
    return unicodedata.normalize("NFKC", text)


def folded(text: str) -> str:
    """The comparison form: as reading(), without case."""
    return unicodedata.normalize("NFKC", reading(text).casefold())


def normalize(df: DataFrame, col: str, out: str = "normal", fold: bool = True) -> DataFrame:
    """df with one more column, the consistent form of a string column.

    Null stays null and empty stays empty. Every distinct value of an Arrow batch is computed once.
    An `out` that df has already is replaced.
    """
    function = folded if fold else reading

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        memo = {v: function(v) for v in values.dropna().unique()}
        return pd.Series([memo.get(v) for v in values], dtype=object)

    return df.withColumn(out, form(F.col(col)))


def readings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, form): 16-byte digests of each text as it is and of its reading form.

    Rows whose id is null or whose text is null, empty or nothing but ignorable characters take no
    part. Digests, not texts, are what later gets shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            codes = pc.dictionary_encode(batch.column(1))
            raws, forms = [], []
            for value in codes.dictionary.to_pylist():
                form = reading(value)
                raws.append(digest(value))
                forms.append(digest(form) if form.strip() else None)
            at = codes.indices
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raws, pa.binary()).take(at), pa.array(forms, pa.binary()).take(at)],
                names=["id", "raw", "form"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("text") > 0))
    return rows.mapInArrow(run, "id long, raw binary, form binary").where("form is not null")


#: Rows of one text, or texts of one form, that one key of a join holds.
BLOCK_ROWS = 1000


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK_ROWS).cast("int")


def _block(hashed: str | Column, blocks: str) -> Column:
    return F.pmod(F.xxhash64(hashed), F.col(blocks).cast("long")).cast("int")


def same_reading_pairs(rows: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """(*by, id_a, id_b), id_a < id_b: rows of readings() with the same form and different raw text.

    Equal texts are no pair. First the different texts of a form are paired, then both sides of such a
    pair are replaced by the ids that have the text, so the work follows the number of result rows,
    however many copies a text has. A text's ids, and a form's texts, go in blocks of BLOCK_ROWS, so
    no key of a join holds more of them than that.
    """
    by = by or []
    rows = materialize(rows, "readings")  # digests only; the texts are normalised once
    texts = rows.groupBy(*by, "form", "raw").agg(F.count("*").alias("n"))
    forms = texts.groupBy(*by, "form").agg(F.count("*").alias("texts")).where("texts > 1")
    some = materialize(texts.join(forms, [*by, "form"]).withColumn("blocks", _blocks(F.col("n"))), "texts")
    some = some.withColumn("salts", _blocks(F.col("texts")))
    left = some.select(*by, "form", _block("raw", "salts").alias("salt"), F.col("raw").alias("raw_a"), F.col("blocks").alias("blocks_a"))
    right = some.select(*by, "form", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("raw").alias("raw_b"), F.col("blocks").alias("blocks_b"))
    pairs = left.join(right, [*by, "form", "salt"]).where("raw_a < raw_b")
    pairs = pairs.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
    pairs = pairs.withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1))).drop("form", "salt", "blocks_a", "blocks_b")
    ids = rows.join(some.select(*by, "raw", "blocks"), [*by, "raw"]).select(*by, "raw", "id", _block("id", "blocks").alias("block"))
    a = ids.select(*by, F.col("raw").alias("raw_a"), F.col("block").alias("block_a"), F.col("id").alias("x"))
    b = ids.select(*by, F.col("raw").alias("raw_b"), F.col("block").alias("block_b"), F.col("id").alias("y"))
    both = pairs.join(a, [*by, "raw_a", "block_a"]).join(b, [*by, "raw_b", "block_b"]).where("x != y")
    return both.select(*by, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
