"""Splitting of texts above a token limit at natural boundaries, with overlap.

Each text is handled whole inside one task. Dynamic programming over all boundary positions picks
the cuts: a cut costs by how much it breaks (paragraph, line, sentence, clause, word, character),
and pieces of uneven size cost by the square of their distance from the even size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.llm.tokens import TOKENIZER_DIR, Transducer, transducer

#: Cost of a cut by what it breaks.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 0.0, 0.1, 0.25, 0.7, 1.2, 3.0
#: Weight of a piece's squared relative distance from the even size, and cost of a piece.
IMBALANCE, PIECE = 1.0, 0.15
#: Of the room beside the overlap, a piece fills at least this share with text of its own; the last is free.
LEAST_SHARE = 0.5
#: Tokens of a run without spaces that counts as a word and isn't cut; Chinese text mostly has longer ones.
WORD_TOKENS = 16
#: Least room beside the overlap: a character has four tokens at most, and may encode differently at a cut.
LEAST_ROOM = 12

#: A place's cost is that of the first group that ends there.
_PLACES = re.compile(
    r"(\n[ \t\r]*\n\s*)|(\n)|([。！？]+[”」』）)]*|[.!?…]+[\"'”)]*(?=\s))|([，；：、]|[,;:](?=\s))"
)
_GRADES = np.array([PARAGRAPH, LINE, SENTENCE, CLAUSE])


class _Text:
    """A text's units of the tokenizer's split and the places where it may be cut."""

    def __init__(self, fst: Transducer, text: str, room: int):
        self.fst = fst
        self.units = fst.split(text)
        ids = list(map(fst.piece, self.units))
        count = len(self.units)
        sizes = np.fromiter(map(len, ids), np.int64, count)
        self.chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.units), np.int64, count))])
        self.tokens = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        begins = np.append((data & 0xC0) != 0x80, True)  # a byte that doesn't continue a character starts one
        before = np.cumsum(begins) - 1
        end = np.cumsum(fst.byte_len[np.fromiter(chain.from_iterable(ids), np.int64, int(self.tokens[-1]))])
        whole = np.zeros(len(end) + 1, bool)
        whole[self.tokens] = True
        # between two characters: at a unit's end, or inside a long run
        inside = np.concatenate([[False], begins[end]]) & np.append(False, np.repeat(sizes > min(WORD_TOKENS, room // 8), sizes))
        self.at_token = np.flatnonzero(whole | inside)
        self.at_char = before[np.concatenate([[0], end])[self.at_token]]
        self.cost = np.where(whole[self.at_token], WORD, CHARACTER)
        # where a piece may begin: between any two characters
        self.begin_token = np.concatenate([[0], np.flatnonzero(begins[end]) + 1])
        self.begin_char = np.concatenate([[0], before[end[begins[end]]]])
        spans = [(m.start(), m.end(), m.lastindex - 1) for m in _PLACES.finditer(text)]
        if spans:
            head, tail, grade = np.array(spans).T
            # white space goes to the next word where the tokenizer joins them
            place = np.searchsorted(self.at_char, tail, side="right") - 1
            good = self.at_char[place] > head
            np.minimum.at(self.cost, place[good], _GRADES[grade[good]])

    def begins(self, token: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
        """(token, character) of the last place that shares `overlap` tokens with what ends at a token."""
        at = np.searchsorted(self.begin_token, np.maximum(token - overlap, 0), side="right") - 1
        return self.begin_token[at], self.begin_char[at]

    def count(self, text: str, a: int, b: int) -> int:
        """Tokens of text[a:b] encoded alone. The split runs from left to right, so it agrees with
        the whole text's from the first common end on, up to the space before b."""
        u = int(np.searchsorted(self.chars, a, side="right")) - 1
        w = int(np.searchsorted(self.chars, b, side="right")) - 1
        while w > u and self.units[w - 1].isspace():
            w -= 1
        tail = self.fst.count(text[int(self.chars[w]) : b])
        if self.chars[u] == a:
            return int(self.tokens[w] - self.tokens[u]) + tail if w >= u else self.fst.count(text[a:b])
        near = min(u + 6, w)
        at, n = a, 0
        for unit in self.fst.split(text[a : int(self.chars[near])])[:-1] if near > u + 1 else ():
            at += len(unit)
            n += len(self.fst.piece(unit))
            v = int(np.searchsorted(self.chars, at))
            if self.chars[v] == at and v < near:
                return n + int(self.tokens[w] - self.tokens[v]) + tail
        return self.fst.count(text[a:b])


def _cuts(ends: np.ndarray, starts: np.ndarray, costs: np.ndarray, most: int, least: int, even: float) -> list[int] | None:
    """Positions of the cuts, the first and the last place included, of least cost; None if there is no way.

    A piece from place j to place i has ends[i] - starts[j] tokens, `most` of them at most, and
    ends[i] - ends[j] of its own, `least` of them at least, but for the last piece. As a piece has
    a least length, a whole run of places depends on earlier ones alone and is computed at once.
    """
    n = len(ends)
    best, came = np.full(n, np.inf), np.zeros(n, np.int64)
    best[0] = 0.0
    low = np.searchsorted(starts, ends - most, side="left")
    high = np.searchsorted(ends, ends - least, side="right")  # j < high
    i = int(np.searchsorted(high, 1))
    scale = IMBALANCE / (most * most)
    while i < n:
        stop = min(int(np.searchsorted(high, i, side="right")), n)  # places whose pieces start before i
        a, b = int(low[i]), int(high[stop - 1])
        if b > a:
            js = np.arange(a, b)
            size = ends[i:stop, None] - (starts[a:b] + even)[None, :]
            value = best[a:b] + scale * size * size
            value[(js[None, :] < low[i:stop, None]) | (js[None, :] >= high[i:stop, None])] = np.inf
            k = value.argmin(axis=1)
            best[i:stop] = value[np.arange(stop - i), k] + costs[i:stop] + PIECE
            came[i:stop] = a + k
        i = stop
    a = int(low[-1])
    if a >= n - 1:
        return None
    last = best[a : n - 1] + scale * (ends[-1] - starts[a : n - 1] - even) ** 2
    j = a + int(last.argmin())
    if not np.isfinite(last[j - a]):
        return None
    path = [n - 1, j]
    while path[-1]:
        path.append(int(came[path[-1]]))
    return path[::-1]


def _forced(places: _Text, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces for odd texts whose parts encode longer than they do within the text: each ends at the
    last place between characters that keeps it within the limit; where the overlap leaves no room
    for more text, none is shared."""
    out: list[tuple[int, int, int, int]] = []
    chars, at, done, shared = places.begin_char, 0, 0, 0
    while done < len(text):
        b = int(np.searchsorted(places.begin_token, places.begin_token[at] + limit, side="right")) - 1
        while b > at and (chars[b] <= done or (size := places.count(text, int(chars[at]), int(chars[b]))) > limit):
            b = b - 1 if chars[b] > done else at
        if b <= at:
            if shared:  # without overlap
                at, shared = int(np.searchsorted(chars, done)), 0
                continue
            b = at + 1  # a single character above the limit
            size = places.count(text, int(chars[at]), int(chars[b]))
        out.append((int(chars[at]), int(chars[b]), size, shared))
        done = int(chars[b])
        at = int(np.searchsorted(places.begin_token, max(0, int(places.begin_token[b]) - overlap), side="right")) - 1
        shared = int(places.begin_token[b] - places.begin_token[at])
    return out


def check_limits(limit: int, overlap: int) -> None:
    if overlap < 0 or limit <= 2 * overlap + LEAST_ROOM:
        raise ValueError("the limit leaves no room beside the overlap")


def plan_pieces(fst: Transducer, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first character, end character, tokens, tokens shared with the piece before) of each piece.

    A text within the limit is one piece. Each piece starts at the last place between characters
    that shares at least `overlap` tokens with the piece before; no piece exceeds `limit` tokens,
    counted again on the piece's own text. The cuts are the cheapest of all ways to cut at unit
    ends, and between characters of long runs, whose pieces but the last hold LEAST_SHARE of the
    room beside the overlap. Where pieces encode longer than within the text the limit is tightened
    and, if that leaves no room, the text is cut by length alone.
    """
    check_limits(limit, overlap)
    if len(text) <= limit // 4 and (total := fst.count(text)) <= limit:  # no character has more than four bytes
        return [(0, len(text), total, 0)]
    places = _Text(fst, text, limit - overlap)
    total = int(places.tokens[-1])
    if total <= limit:
        return [(0, len(text), total, 0)]
    ends, costs = places.at_token, places.cost
    starts, begin = places.begins(ends, overlap)
    most = limit
    while most > 2 * overlap + LEAST_ROOM:
        pieces = int(np.ceil((total - overlap) / (most - overlap)))
        even = (total + (pieces - 1) * overlap) / pieces
        path = _cuts(ends, starts, costs, most, max(1, int(LEAST_SHARE * (most - overlap))), even)
        if path is None:
            break
        sizes = [places.count(text, int(begin[p]), int(places.at_char[q])) for p, q in zip(path, path[1:])]
        if max(sizes) <= limit:
            return [
                (int(begin[p]), int(places.at_char[q]), size, int(ends[p] - starts[p]))
                for p, q, size in zip(path, path[1:], sizes)
            ]
        most -= max(4, max(sizes) - limit)
    return _forced(places, text, limit, overlap)


def split_texts(
    df: DataFrame,
    limit: int,
    overlap: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """(id, piece_no from 1, start_char, end_char, n_tokens, shared_tokens, piece) of every text.

    Offsets are code points, piece == text[start_char:end_char], and the pieces without their
    shared beginnings join to the text. Null and empty texts have no pieces; a text within the
    limit is one piece; repeated rows give repeated pieces; other columns are not read. A limit
    that leaves no room beside the overlap is refused before anything runs.
    """
    check_limits(limit, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(tokenizer, folder)
        for batch in batches:
            rows: list[tuple] = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text := value.as_py():
                    for k, (a, b, n, shared) in enumerate(plan_pieces(fst, text, limit, overlap), 1):
                        rows.append((i, k, a, b, n, shared, text[a:b]))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            names = ["id", "piece_no", "start_char", "end_char", "n_tokens", "shared_tokens", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    out = df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run,
        "id long, piece_no int, start_char int, end_char int, n_tokens int, shared_tokens int, piece string",
    )
    return out.withColumnRenamed("id", id_col)
