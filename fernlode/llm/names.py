"""Reading of typed names: parts, blocking keys and the comparison of two spellings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from fernlode.llm.lookalike import folded

# Short and pet forms of given names.
NICKNAMES = """
vicky victoria, peggy margaret, meg margaret, maggie margaret, chris christopher, dan daniel, danny daniel, tim timothy,
ken kenneth, greg gregory, dora dorothea, bella isabella, quen quentin, flo florian, trixi beatrix, kathi katharina,
kate katharina, kostja konstantin, ted theodore, ted edward, ned edward, ed edward, uschi ursula, lenny leonard,
uli ulrich, toni antonia, mick michael, mike michael, nick nicholas, fritz frederick, fred frederick, susi susanna,
sue susanna, jackie jacqueline, gabi gabriele, sascha alexander, alex alexander, manny emanuel, sam samuel,
ben benjamin, tom thomas, steffi stephanie, liz elizabeth, beth elizabeth, lisa elizabeth, millie amelia, bob robert,
rob robert, bill william, will william, tilda matilda, otti ottilie, mina wilhelmina, hetty henrietta, des desmond,
nate nathaniel, josie josephine, becky rebecca, bart bartholomew, walt walter, liv olivia, pip philippa,
zack zacharias, hanne hannelore, trish patricia, pat patricia, jim james, joe joseph, sepp josef, hans johannes,
max maximilian, andy andreas, matt matthew, kathy katharina, drea andrea, heinz heinrich, klaus nikolaus
"""
# Titles, articles, legal forms and general aliases, folded.
TITLES = frozenset("dr prof ing mr mrs ms miss herr frau dipl mag sir".split())
FILLERS = frozenset("the and und of".split())
LEGAL = re.compile(
    r"\b(gesellschaft mbh|gmbh|aktiengesellschaft|ag|bv|nv|sa|srl|spa|corporation|corp|incorporated|inc|limited|ltd|"
    r"company|co|kg|llc|plc)\b"
)
HAN_TITLES = ("工程师", "总工", "经理", "主任", "老师", "先生", "女士", "小姐", "教授", "博士", "主管")
HAN_LEGAL = ("集团股份有限公司", "股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "集团公司", "公司", "集团", "厂")
GENERAL_ALIASES = frozenset(
    ("小王", "负责人", "供应商", "the office", "lab", "hq", "the supplier", "our partner", "the lab", "office")
)

_FORMAL: dict[str, set[str]] = {}
for _pair in NICKNAMES.replace("\n", " ").split(","):
    _short, _long = _pair.split()
    _FORMAL.setdefault(_short, set()).add(_long)
GIVEN = frozenset(_FORMAL) | frozenset(x for long in _FORMAL.values() for x in long)

HAN = re.compile(r"[㐀-鿿]")


@dataclass(frozen=True)
class Lexicon:
    """What the tasks know of all names: sounds of characters, frequent words and places."""

    sounds: dict[str, str] = field(default_factory=dict, hash=False)
    simple: dict[str, str] = field(default_factory=dict, hash=False)
    common: frozenset = frozenset()
    places: frozenset = frozenset()

    @cached_property
    def hot(self) -> frozenset:
        """Frequent words and their forms with one letter less."""
        return frozenset(s for w in self.common for s in _shorter(w))


@dataclass
class Name:
    """A spelling's parts. kind: p person, q surname with initials only, o organisation, z and c
    the same in Chinese characters, i item with a number, x anything else."""

    kind: str
    words: tuple[str, ...] = ()
    initials: tuple[str, ...] = ()
    place: str = ""
    head: str = ""
    comma: bool = False


def spelling(text: str) -> str:
    """One form for comparing spellings: folded, single blanks."""
    return " ".join(folded(text).split())


def aliases(text: str | None) -> list[str]:
    """Strings of a JSON list; a broken list gives what stands in it."""
    if not text:
        return []
    try:
        value = json.loads(text)
    except ValueError:
        value = re.findall(r'"([^"]+)"?', text) or [text.strip("[] ")]
    value = value if isinstance(value, list) else [value]
    return [v for v in value if isinstance(v, str) and v.strip()]


def words_of(form: str) -> list[str]:
    """Words for counting; letters only."""
    return re.findall(r"[^\W\d_]{2,}", form.replace("-", ""))


def parse(form: str, lex: Lexicon) -> Name:
    """Parts of a spelling()."""
    text = re.sub(r"(?<=\w)\s+-\s+\w+$", "", form)
    if re.search(r"\d", text):
        return Name("i", tuple(sorted(re.findall(r"[^\W\d_]+", text))), tuple(re.findall(r"\d+", text)))
    if HAN.search(text):
        return _parse_han(text, lex)
    comma = "," in text
    text = re.sub(r"\((\w{1,5})\)\s*$", "", text)  # a department, as for persons; too short for a core
    if short := re.fullmatch(r"(\w{4,})-(\w{2,4})", text):  # an organisation's core and the initials of its business
        return Name("o", (short[1],), tuple(short[2]))
    text = re.sub(r"\b(\w)\.(?=\w\b)", r"\1", text).replace("&", " and ")
    text = re.sub(r"(?<=\w)-(?=\w)", "", text)
    flat = " ".join(re.findall(r"[^\W\d_]+", text))
    stripped = LEGAL.sub(" ", flat) if len(flat.split()) > 2 else flat
    tokens = [w for w in stripped.split() if w not in TITLES and w not in FILLERS]
    names, letters = tuple(w for w in tokens if len(w) > 1), tuple(w for w in tokens if len(w) == 1)
    if len(names) >= 3 or (stripped != flat and names):
        return Name("o", names)
    if len(names) == 2:
        return Name("p", names, letters, comma=comma)
    if len(names) == 1 and letters:
        return Name("q", names, letters)
    return Name("x", names)


def _parse_han(text: str, lex: Lexicon) -> Name:
    inside = re.search(r"[(（]([^)）]*)[)）]?", text)
    outer = re.sub(r"[(（][^)）]*[)）]?", "", text)
    latin = "".join(re.findall(r"[a-z]+", outer))
    han = "".join(lex.simple.get(c, c) for c in outer if HAN.match(c))
    aside = "".join(lex.simple.get(c, c) for c in inside[1] if HAN.match(c)) if inside else ""
    if latin:  # a core in Latin letters with business or place in characters
        return Name("c", (han,), place=aside, head=latin)
    for title in HAN_TITLES:
        if han.endswith(title) and len(han) - len(title) >= 2:
            han = han[: -len(title)]
            break
    legal = next((s for s in HAN_LEGAL if han.endswith(s) and len(han) - len(s) >= 3), "")
    if not legal and 2 <= len(han) <= 4:
        return Name("z", (han,))
    if len(han) < 5 and not legal:
        return Name("x", (han,))
    han = han[: len(han) - len(legal)]
    place = next((han[:n] for n in (3, 2) if han[:n] in lex.places and len(han) - n >= 3), "")
    han = han[len(place) :]
    if place and han[:1] in "市省县镇" and len(han) > 3:
        han = han[1:]
    sound = "".join(lex.sounds.get(c, c) for c in han[:3])
    return Name("c", (han[3:], han[:3]), place=place or aside, head=sound)


def _shorter(word: str) -> set[str]:
    """The word and all forms with one letter less; two words within one edit share one."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def surname(name: Name) -> int:
    """Which of a person's two words is the surname: by the table of given names, else by position."""
    known = [w in GIVEN for w in name.words]
    if known[0] != known[1]:
        return 0 if known[1] else 1
    return 0 if name.comma else 1


def _fine(word: str, given: str) -> set[str]:
    """Keys of a frequent surname with a given name, one for each way in which _given() may hold. Those
    that end in > meet only the same that end in <, so that a beginning or an initial meets the
    names that it may stand for, but these don't meet each other."""
    forms = {given} | _FORMAL.get(given, set())
    near_ = {x for f in forms for x in (_shorter(f) if len(f) >= 4 else {f})}
    out = {"f|" + g for g in near_} | {f"h|{x[0]}>" for x in forms}
    if len(given) >= 3:
        out |= {f"g|{given}<"} | {f"g|{given[:n]}>" for n in range(3, len(given))}
    return {f"{k[:2]}{s}|{k[2:]}" for k in out for s in _shorter(word)}


def mate(key: str) -> str:
    """The key that this one meets."""
    return key[:-1] + {">": "<", "<": ">"}[key[-1]] if key[-1:] in (">", "<") else key


def keys(name: Name, lex: Lexicon) -> list[str]:
    """Blocking keys; two spellings that may match share at least one, or one has the mate() of the other's."""
    w = name.words
    if name.kind == "i":
        return ["i|" + " ".join(w) + "|" + " ".join(name.initials)]
    if name.kind == "z":
        sounds = [lex.sounds.get(c, c) for c in w[0]]
        return ["z|" + " ".join(sorted(sounds)), "y|" + "".join(sounds)]
    if name.kind == "c":
        return ["c|" + name.head]
    if name.kind == "x":
        return ["y|" + w[0]] if w else []
    out: set[str] = set()
    if name.kind in "pq":
        for k, word in enumerate(w):
            if len(word) < 4:
                continue
            if not lex.hot.isdisjoint(_shorter(word)):  # may be a spelling of a frequent word
                if name.kind == "q":
                    out |= {f"h|{s}|{x[0]}<" for s in _shorter(word) for x in name.initials}
                elif surname(name) == k or len(w[1 - k]) < 4 or w[1 - k] in lex.common:
                    out |= _fine(word, w[1 - k])
            if word in lex.common and name.kind == "p":
                continue
            rest = [w[1 - k]] if name.kind == "p" else []
            first = {x[0] for r in rest for x in {r} | _FORMAL.get(r, set())} | (set(name.initials) if not rest else set())
            out |= {f"p|{s}|{f}" for s in _shorter(word) for f in first}
        if name.kind == "p":
            out |= {"y|" + w[0] + w[1], "y|" + w[1] + w[0]}
            if all(x in lex.common for x in w):
                out.add("pp|" + " ".join(sorted(w)))
    if name.kind == "o" or name.kind == "p":
        cores = {x for x in w if len(x) >= 4 and x not in lex.common} | {a + b for a, b in zip(w, w[1:])}
        if name.kind == "o":
            out |= {"o|" + s for x in cores for s in _shorter(x)}
    return sorted(out)


def near(a: str, b: str) -> bool:
    """Within one insertion, deletion, substitution or exchange of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:] and len(x) > 1)


def _given(a: str, b: str) -> bool:
    if a == b or (min(len(a), len(b)) >= 4 and near(a, b)):
        return True
    fa, fb = {a} | _FORMAL.get(a, set()), {b} | _FORMAL.get(b, set())
    if fa & fb or any(len(x) >= 5 and len(y) >= 5 and near(x, y) for x in fa for y in fb):
        return True
    return min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a))


def _abbreviates(short: str, long: str) -> bool:
    """The characters of short stand in long, in order."""
    rest = iter(long)
    return all(c in rest for c in short)


def _word(a: str, b: str) -> bool:
    if min(len(a), len(b)) >= 4 and near(a, b):
        return True
    a, b = sorted((a, b), key=len)
    return len(a) >= 2 and a[0] == b[0] and _abbreviates(a, b)


def compare(a: Name, b: Name, lex: Lexicon) -> int:
    """2: the same; 1: the same if nobody else fits the initials; 0: not known to be."""
    if a.kind > b.kind:
        a, b = b, a
    pair = a.kind + b.kind
    if pair == "ii":
        return 2 if (a.words, a.initials) == (b.words, b.initials) else 0
    if pair == "pp":
        if a.initials and b.initials and not set(a.initials) & set(b.initials):
            return 0
        for i in (0, 1):
            for j in (0, 1):
                s, t = a.words[i], b.words[j]
                if min(len(s), len(t)) >= 4 and near(s, t) and _given(a.words[1 - i], b.words[1 - j]):
                    frequent = s in lex.common and a.words[1 - i] not in lex.common
                    if frequent and not near(a.words[1 - i], b.words[1 - j]) and (surname(a), surname(b)) != (i, j):
                        continue  # only the given name agrees closely
                    return 2
        return 0
    if pair == "pq":
        for i in (0, 1):
            given = a.words[1 - i]
            fits = {given[0]} | {x[0] for x in _FORMAL.get(given, ())}
            last = a.words[i] not in lex.common or surname(a) == i
            if near(a.words[i], b.words[0]) and len(b.words[0]) >= 4 and last and b.initials[0] in fits:
                return 1
        return 0
    if pair == "qq":
        return 2 if a.words == b.words and a.initials[0] == b.initials[0] else 0
    if pair == "zz":
        s, t = a.words[0], b.words[0]
        if len(s) != len(t):
            return 0
        for turned in (t, t[-1:] + t[:-1], t[1:] + t[:1]):
            same = sum(x == y for x, y in zip(s, turned))
            alike = all(x == y or lex.sounds.get(x, x) == lex.sounds.get(y, y) for x, y in zip(s, turned))
            if same == len(s) or (alike and len(s) > 2 and same >= len(s) - 1 and turned == t):
                return 2
        return 0
    if pair in ("pz", "xz"):
        return 2 if "y|" + "".join(lex.sounds.get(c, c) for c in b.words[0]) in keys(a, lex) else 0
    if pair == "cc":
        if not a.head or a.head != b.head or (a.place and b.place and a.place != b.place):
            return 0
        if len(a.words) > 1 and len(b.words) > 1 and sum(x != y for x, y in zip(a.words[1], b.words[1])) > 1:
            return 0
        s, t = sorted((a.words[0], b.words[0]), key=len)
        for legal in HAN_LEGAL:
            s, t = s.removesuffix(legal) if len(s) > len(legal) else s, t.removesuffix(legal) if len(t) > len(legal) else t
        sound = lambda x: "".join(lex.sounds.get(c, c) for c in x)
        return 2 if not s or _abbreviates(s, t) or sound(s) == sound(t) else 0
    if pair == "oo" and bool(a.initials) != bool(b.initials):
        a, b = (a, b) if a.initials else (b, a)
        rest = [x[0] for x in b.words if not near(x, a.words[0])]
        return 2 if len(rest) == len(b.words) - 1 and sorted(rest) == sorted(a.initials) else 0
    if pair in ("oo", "op"):
        s, t = list(a.words), list(b.words)
        for x, y in ((s, t), (t, s)):  # a word typed as two
            for k in range(len(x) - 1):
                if x[k] + x[k + 1] in y:
                    x[k : k + 2] = [x[k] + x[k + 1]]
                    break
        rare = [x for x in s if len(x) >= 4 and x not in lex.common and any(near(x, y) and len(y) >= 4 for y in t)]
        if not rare or (pair == "op" and len(s) == len(t)):
            return 0
        left, used = list(t), 0
        for x in s:
            hit = next((y for y in left if _word(x, y)), None)
            if hit:
                left.remove(hit)
                used += 1
        return 2 if used == min(len(s), len(t)) and used >= 2 else 0
    return 0


@lru_cache(maxsize=200_000)
def _cached(form: str, lex_id: int) -> Name:
    return parse(form, _LEX[lex_id])


_LEX: dict[int, Lexicon] = {}


def parsed(form: str, lex: Lexicon) -> Name:
    """parse(), remembered per worker."""
    _LEX[id(lex)] = lex
    return _cached(form, id(lex))
