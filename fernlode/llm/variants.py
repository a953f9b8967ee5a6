"""Variant spellings of names typed by people, by merge-and-rematch resolution.

Each row starts as a profile of its spellings. Profiles that share a blocking key are compared, the
matching ones merge, which unions their spellings and initials, and profiles that grew enter
blocking again with what their parts combine to, until no merge follows. Profiles whose initials
conflict don't merge, and one without initials merges only where all that fit it agree. A surname
with initials alone joins only where a single profile fits it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.llm import names
from fernlode.operators.components import merged_labels
from fernlode.session import materialize

#: Spellings of a block, or rows of an entity, that one key of a join holds.
BLOCK_ROWS = 1000
#: Spellings that one task makes keys of, about.
KEY_ROWS = 4000
#: Rows up to which an alias that is no row's own name is not doubted.
DOUBTED_ROWS = 4


def _sounds(spark: SparkSession) -> tuple[dict[str, str], dict[str, str]]:
    """Latin syllable and simplified form of each character of the main Han block, by the public
    transliterator that Spark brings; about 21,000 entries whatever the data."""
    icu = spark._jvm.com.ibm.icu.text.Transliterator
    chars = [chr(c) for c in range(0x4E00, 0x9FA6)]
    simple = icu.getInstance("Traditional-Simplified").transliterate("\n".join(chars)).split("\n")
    latin = icu.getInstance("Han-Latin; Latin-ASCII; Lower").transliterate("\n".join(simple)).split("\n")
    return dict(zip(chars, (x.strip() for x in latin))), {c: s for c, s in zip(chars, simple) if c != s}


def spellings(df: DataFrame, id_col: str, name_col: str, aliases_col: str) -> DataFrame:
    """(id, form, own): folded spellings of each row; own marks the name, not an alias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, name, extra in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = names.spelling(name) if name else ""
                if own:
                    out.append((i, own, True))
                out += {(i, f, False) for f in map(names.spelling, names.aliases(extra)) if f and f != own and f not in names.GENERAL_ALIASES}
            columns = zip(*out) if out else [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "form", "own"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), name_col, aliases_col).where("id is not null")
    return rows.mapInArrow(run, "id long, form string, own boolean")


def _lexicon(spark: SparkSession, forms: DataFrame, n: int) -> names.Lexicon:
    """Words that more than one in 2,000 names has, and places that more than one in 100 long
    Chinese names starts with; so at most some thousand of them, whatever the number of names."""
    sounds, simple = _sounds(spark)
    words = forms.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate("form", "-", ""), F.lit(r"([\p{L}]{2,})"), F.lit(1)))).alias("w"))
    common = words.groupBy("w").count().where(F.col("count") > max(30, n // 2000)).select("w").collect()
    long_ = forms.where(r"form rlike '^[\\u4e00-\\u9fa5]{6,}$'")
    starts = long_.select(F.explode(F.array(F.substring("form", 1, 2), F.substring("form", 1, 3))).alias("w"))
    total = long_.count()
    often = {r.w: r["count"] for r in starts.groupBy("w").count().where(F.col("count") > max(2, total // 100)).collect()}
    places = {w for w, c in often.items() if len(w) == 3 and c > 0.6 * often.get(w[:2], 0)}
    places |= {w for w in often if len(w) == 2 and not any(p[:2] == w for p in places)}
    return names.Lexicon(sounds, simple, frozenset(r.w for r in common), frozenset(places))


def resolve(
    df: DataFrame, id_col: str = "id", name_col: str = "name", aliases_col: str = "aliases_json"
) -> DataFrame:
    """(id, entity): entity is the same for rows that mean the same thing.

    Rows without a usable name and alias have no row. Null, empty and broken alias lists count as
    far as they can be read. Repeated rows and equal names fall together. An alias in
    GENERAL_ALIASES links nothing. One that is some row's own name, or stands in up to DOUBTED_ROWS
    rows, links them. Any other is first compared as a spelling alone, and links all of its rows, at
    any number, once more than half of them are found to be one thing without it; it is general if
    its rows stay unlike.
    """
    spark = df.sparkSession
    rows = materialize(spellings(df, id_col, name_col, aliases_col), "spellings")
    forms = materialize(rows.select("form").distinct().withColumn("node", F.xxhash64("form")), "forms")
    owned = rows.where("own").select("form").distinct()
    often = rows.where("not own").groupBy("form").agg(F.count_distinct("id").alias("n")).where(F.col("n") > DOUBTED_ROWS)
    doubted = materialize(often.join(owned, "form", "left_anti").select("form"), "doubted")
    doubt = None
    if not doubted.isEmpty():
        doubt = materialize(rows.where("not own").join(doubted, "form").select("id", "form").distinct(), "doubt")
        rows = materialize(rows.join(doubted, "form", "left_anti").select("id", "form", "own"), "spellings")
    n = forms.count()
    lex = spark.sparkContext.broadcast(_lexicon(spark, forms, n))  # bounded, see _lexicon

    def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f, names.keys(names.parsed(f, lex.value), lex.value)) for f in pdf["form"]]
            yield pd.DataFrame([(f, k, None) for f, ks in found for k in ks], columns=["form", "key", "said"])

    def mark_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f, names.parsed(f, lex.value)) for f in pdf["form"]]
            yield pd.DataFrame([(f, x[0]) for f, n in found if n.kind == "p" for x in set(n.initials)], columns=["form", "mark"])

    @F.pandas_udf("int")
    def alike(a: pd.Series, b: pd.Series, said_a: pd.Series, said_b: pd.Series) -> pd.Series:
        """0: not alike; 2: the same; 3: the same, and one of the two has initials; -1 and 1: a and b has initials alone, which fit."""
        known, out = lex.value, []
        for x, y, s, t in zip(a, b, said_a, said_b):
            score = names.compare(names.parsed(s, known), names.parsed(t, known), known)
            if score:
                x, y = names.parsed(x, known), names.parsed(y, known)
                if score == 1:
                    score = -1 if x.kind == "q" else 1
                else:
                    score = 2 + ((x.kind == "p" and bool(x.initials)) != (y.kind == "p" and bool(y.initials)))
            out.append(score)
        return pd.Series(out, dtype="int32")

    spread = forms.select("form").repartition(max(spark.sparkContext.defaultParallelism, n // KEY_ROWS))
    keyed = materialize(spread.mapInPandas(key_rows, _KEYED), "keys")
    marks = materialize(spread.mapInPandas(mark_rows, "form string, mark string").select(F.xxhash64("form").alias("node"), "mark"), "marks")
    # spellings of one row are one profile from the start
    own = rows.where("own").select("id", F.col("form").alias("a"))
    tied = own.join(rows.where("not own").select("id", F.col("form").alias("b")), "id").select("a", "b")
    lone = rows.where("not own").join(own, "id", "left_anti").groupBy("id").agg(F.min("form").alias("a"))
    tied = tied.unionByName(rows.join(lone, "id").where("form != a").select("a", F.col("form").alias("b")))
    links = tied.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    sure = forms.select("node", F.col("node").alias("label"))
    fresh = keyed
    state = matches = seen = None
    while True:
        pairs = _blocked(fresh, keyed)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b", "said_a", "said_b"], "left_anti")
        scored = materialize(pairs.withColumn("score", alike("a", "b", "said_a", "said_b")), "scored")
        done = scored.select("a", "b", "said_a", "said_b")
        seen = done if seen is None else seen.unionByName(done)
        found = scored.where("score != 0").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), "score")
        if matches is not None:
            found = found.join(matches, ["a", "b", "score"], "left_anti")
        found = materialize(found, "found")
        matches = found if matches is None else matches.unionByName(found)
        links = links.unionByName(found.where("score = 2").select("a", "b"))
        merged = merged_labels(sure, links if state is None else _between(links, sure))
        if state is not None and merged is sure and found.where("score != 2").isEmpty():
            grown = grown.limit(0)  # profiles are as before, so all their combinations are keys
        else:
            sure = merged
            state = _agreeing(sure, matches.where("score = 3").select("a", "b"), marks)
            weak = matches.where("abs(score) = 1").select(F.expr("if(score = -1, a, b)").alias("q"), F.expr("if(score = -1, b, a)").alias("p"))
            while True:  # initials whose fitting profiles have all become one
                turned = _between(weak, state, "q", "p").where("q != p")
                single = turned.groupBy("q").agg(F.min("p").alias("p"), F.max("p").alias("p2")).where("p = p2")
                joined = merged_labels(state, single.select(F.col("q").alias("a"), F.col("p").alias("b")))
                if joined is state:
                    break
                state = joined
            named = forms.join(state, "node").select("form", "label")
            # profiles that grew: their spellings' parts recombine into new keys
            grown = materialize(_recombined(named, keyed, lex), "grown")
        fresh, links = grown, links.limit(0)
        if grown.isEmpty():
            resolved = materialize(rows.join(named, "form").groupBy("id").agg(F.min("label").alias("entity")), "resolved")
            if doubt is None:
                return resolved
            agreed = materialize(_agreed(doubt, resolved), "agreed")
            if agreed.isEmpty():
                return resolved
            added = doubt.join(agreed, "form")
            links = added.join(rows, "id").select(F.xxhash64(rows.form).alias("a"), F.xxhash64(added.form).alias("b"))
            rows = materialize(rows.unionByName(added.select("id", "form", F.lit(False).alias("own"))), "spellings")
            doubt = materialize(doubt.join(agreed, "form", "left_anti"), "doubt")
        keyed = materialize(keyed.unionByName(grown), "keys")


_KEYED = "form string, key string, said string"


def _blocked(fresh: DataFrame, keyed: DataFrame) -> DataFrame:
    """(a, b, said_a, said_b), a < b: spellings of a fresh and any profile that share a block, with what
    they are compared as. Blocks above BLOCK_ROWS are spread by a salt on one side, repeated on the other."""
    # as names.mate()
    mate = F.when(F.col("key").rlike("[<>]$"), F.translate("key", "<>", "><")).otherwise(F.col("key"))
    left = fresh.select("key", F.col("form").alias("x"), F.coalesce("said", "form").alias("said_x"))
    right = keyed.select(mate.alias("key"), F.col("form").alias("y"), F.coalesce("said", "form").alias("said_y"))
    hot = materialize(right.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS), "hot")
    n_hot = hot.count()
    if n_hot:
        hot = hot.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("salts"))
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        one = F.lit(1)
        left = left.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", one) - 1))).drop("salts")
        right = right.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("y"), F.coalesce("salts", one).cast("long")).cast("int")).drop("salts")
    both = left.join(right, ["key", "salt"] if n_hot else ["key"]).where("x != y")
    turned = F.col("x") > F.col("y")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return both.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("said_x", "said_y").alias("said_a"), pick("said_y", "said_x").alias("said_b")).distinct()


def _between(links: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): the labels of both ends of each link."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    return links.join(of(a), a).join(of(b), b).select(F.col(f"label_{a}").alias(a), F.col(f"label_{b}").alias(b))


def _agreeing(sure: DataFrame, mixed: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, label): the profiles of sure, merged by those mixed matches by which none gets conflicting initials.

    marks: (node, mark), the initials beside a full name. What has no initials has merged among itself, and
    what has them where it matched, into the profiles of sure, which union their initials. A profile without
    then merges with those that match it by mixed (a, b), one side of which has initials, only if all of
    those share an initial; else it fits several people and stays alone.
    """
    if mixed.isEmpty():
        return sure
    ends = _between(mixed, sure).where("a != b").distinct()
    # letters
    profile = materialize(marks.join(sure, "node").groupBy("label").agg(F.collect_set("mark").alias("marks")), "profiles")
    known = ends.join(profile.select(F.col("label").alias("a"), F.col("marks").alias("m1")), "a", "left")
    known = materialize(known.join(profile.select(F.col("label").alias("b"), F.col("marks").alias("m2")), "b", "left"), "known")
    both = known.where("m1 is not null and m2 is not null and arrays_overlap(m1, m2)").select("a", "b")
    bare = known.where("(m1 is null) != (m2 is null)").select(F.expr("if(m1 is null, a, b)").alias("e"), F.expr("if(m1 is null, b, a)").alias("m"), F.coalesce("m1", "m2").alias("marks")).distinct()
    # the empty mark counts all that match
    each = bare.select("e", F.explode(F.array_append("marks", F.lit(""))).alias("mark")).groupBy("e", "mark").agg(F.count("*").alias("n"))
    most = lambda which: F.max(F.when(which, F.col("n")))
    good = each.groupBy("e").agg(most(F.col("mark") == "").alias("n"), most(F.col("mark") != "").alias("k")).where("n = k").select("e")
    return merged_labels(sure, both.unionByName(bare.join(good, "e", "left_semi").select(F.col("e").alias("a"), F.col("m").alias("b"))))


def _agreed(doubt: DataFrame, resolved: DataFrame) -> DataFrame:
    """(form): aliases of which more than half of the rows are one entity."""
    groups = doubt.join(resolved, "id", "left").groupBy("form", "entity").agg(F.count("*").alias("n"))
    most = F.max(F.when(F.col("entity").isNotNull(), F.col("n")))
    return groups.groupBy("form").agg(most.alias("most"), F.sum("n").alias("n")).where("2 * most > n").select("form")


def _recombined(named: DataFrame, keyed: DataFrame, lex) -> DataFrame:  # noqa: ANN001
    """New (form, key, said) rows: keys of a surname of one spelling with a given name of another one of
    the same profile, with that combination, which is what is then compared. Nothing comes out once
    every combination has been a key."""
    sizes = named.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    parts = named.join(sizes, "label").select("label", "form")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lab, form in zip(pdf["label"], pdf["form"]):
                name = names.parsed(form, lex.value)
                if name.kind == "p":
                    common = [w in lex.value.common for w in name.words]
                    k = 0 if common == [False, True] or (name.comma and common[0] == common[1]) else 1
                    for i in sorted({k, names.surname(name)} if any(common) else {k}):  # a frequent surname, or given name
                        out.append((lab, form, name.words[i], name.words[1 - i]))
            yield pd.DataFrame(out, columns=["label", "form", "surname", "given"])

    pieces = materialize(parts.mapInPandas(split, "label long, form string, surname string, given string"), "pieces")
    surnames = pieces.groupBy("label", "surname").agg(F.min("form").alias("form"))
    givens = pieces.select("label", "given").distinct()
    mixed = surnames.join(givens, "label").select("form", F.concat_ws(" ", "given", "surname").alias("mix")).distinct()

    def mix_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = lex.value
            # a combination that doesn't fit the spelling it is made from took a given name for a surname
            good = [(f, m) for f, m in zip(pdf["form"], pdf["mix"]) if names.compare(names.parsed(f, known), names.parsed(m, known), known) == 2]
            out = [(f, k, m) for f, m in good for k in names.keys(names.parsed(m, known), known) if k.startswith(("p|", "f|", "g|", "h|"))]
            yield pd.DataFrame(out, columns=["form", "key", "said"])

    made = mixed.mapInPandas(mix_keys, _KEYED).groupBy("form", "key").agg(F.min("said").alias("said"))
    return made.join(keyed, ["form", "key"], "left_anti")


def pairs(resolved: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows of one entity, as the result is defined. An entity's
    rows are spread in blocks on one side and repeated for each block on the other."""
    sizes = resolved.groupBy("entity").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    some = resolved.join(sizes, "entity")
    a = some.select("entity", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block"), F.col("id").alias("id_a"))
    b = some.select("entity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("id_b"))
    return a.join(b, ["entity", "block"]).where("id_a < id_b").select("id_a", "id_b")
