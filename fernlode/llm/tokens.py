"""Encoding of texts with a public byte-level BPE vocabulary by a lazily built transducer.

The merges of a rank file are compiled, state by state and only as far as the texts need it, into
a deterministic finite-state transducer over characters. A state holds the bytes read since the
last decided token boundary and, for every later boundary that may still become final, the token
that ends there. A boundary is decided, and its tokens are emitted, as soon as every way to go on
passes through it; a way ends where no token of the vocabulary starts with the bytes since its
boundary, so the lookahead is bounded by the longest token.

It rests on a known property of BPE: a token sequence is the encoding of its bytes exactly when
every neighbouring pair is the encoding of the pair's own bytes. So each prefix of a text has one
last token, which is all a state must remember.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("FERNLODE_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern by which the public rank files split a text before the merges.
SPLIT_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

#: Entries after which a worker's memo of pieces, or its arcs and pairs, start anew; affects speed only.
MEMO_ENTRIES, ARC_ENTRIES = 400_000, 1_000_000


class Transducer:
    """Lazily determinised transducer of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_len = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        self.byte_len[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self._alone: dict[bytes, bool] = {}  # at most the vocabulary
        self._forget()
        self.memo: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(SPLIT_PATTERN).findall

    def _forget(self) -> None:
        """An automaton of the start state alone."""
        self._pairs: dict[tuple[int, int], bool] = {}
        self._states: dict[tuple, int] = {}
        self._info: list[tuple] = []
        self._arcs: dict[tuple[int, str], tuple[int, tuple[int, ...]]] = {}
        self._ends: dict[int, tuple[int, ...]] = {}
        self.start = self._state((b"", -1, ()))

    def _merge(self, data: bytes) -> list[bytes]:
        """Encoding by the definition: join the neighbours of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _reachable(self, token: bytes) -> bool:
        ok = self._alone.get(token)
        if ok is None:
            ok = self._alone[token] = self._merge(token) == [token]
        return ok

    def _fits(self, left: int, right: bytes) -> bool:
        if left < 0:
            return True
        key = (left, self.ranks[right])
        ok = self._pairs.get(key)
        if ok is None:
            first = self.bytes_of[left]
            ok = self._pairs[key] = self._merge(first + right) == [first, right]
        return ok

    def _state(self, key: tuple) -> int:
        n = self._states.get(key)
        if n is None:
            n = self._states[key] = len(self._info)
            self._info.append(key)
        return n

    def _step(self, key: tuple, byte: bytes) -> tuple[tuple, tuple[int, ...]]:
        """One byte. key: bytes since the decided boundary, the token before it, and
        (boundary, boundary before it, token between) for the undecided ones."""
        window, before, marks = key
        window += byte
        end = len(window)
        last = {0: (None, before)} | {p: (q, t) for p, q, t in marks}
        for p in sorted(last):
            piece = window[p:]
            token = self.ranks.get(piece)
            if token is not None and self._reachable(piece) and self._fits(last[p][1], piece):
                last[end] = (p, token)
                break
        else:
            if end not in last:
                raise ValueError("the rank file lacks a single byte")
        live = [p for p in last if p == end or window[p:] in self.prefixes]
        paths = []
        for p in live:
            path = [p]
            while p:
                p = last[p][0]
                path.append(p)
            paths.append(path[::-1])
        common = 0
        for column in zip(*paths):
            if len(set(column)) > 1:
                break
            common = column[0]
        emitted = []
        p = common
        while p:
            emitted.append(last[p][1])
            p = last[p][0]
        kept = {p for path in paths for p in path if p > common}
        marks = tuple((p - common, last[p][0] - common, last[p][1]) for p in sorted(kept))
        # a decided boundary that can't start a token any more still precedes the next one
        return (window[common:], last[common][1], marks), tuple(emitted[::-1])

    def _arc(self, state: int, char: str) -> tuple[int, tuple[int, ...]]:
        key, out = self._info[state], ()
        for b in char.encode("utf-8", "surrogatepass"):
            key, more = self._step(key, bytes((b,)))
            out += more
        arc = self._arcs[state, char] = (self._state(key), out)
        return arc

    def _end(self, state: int) -> tuple[int, ...]:
        window, _, marks = self._info[state]
        by, p, out = {q: (r, t) for q, r, t in marks}, len(window), []
        while p:
            p, token = by[p]
            out.append(token)
        ends = self._ends[state] = tuple(out[::-1])
        return ends

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece of the split."""
        found = self.memo.get(text)
        if found is not None:
            return found
        if len(self._arcs) + len(self._pairs) > ARC_ENTRIES:
            self._forget()
        state, out, arcs = self.start, [], self._arcs
        for char in text:
            arc = arcs.get((state, char)) or self._arc(state, char)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        end = self._ends.get(state)
        out.extend(self._end(state) if end is None else end)
        ids = tuple(out)
        if len(text) <= 40:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def split(self, text: str) -> list[str]:
        return self._split(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; none for an empty or null text."""
        return list(chain.from_iterable(map(self.piece, self._split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.piece, self._split(text)))) if text else 0

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text, streamed: each id gives the characters that are complete by then. Bytes that are
        no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.bytes_of[i]):
                yield text
        if text := machine.decode(b"", final=True):
            yield text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=2)
def transducer(name: str, folder: str = TOKENIZER_DIR) -> Transducer:
    """One per worker process; the rank file is read where the task runs."""
    return Transducer(read_ranks(os.path.join(folder, f"{name}.tiktoken")))


def encode_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """(id, ids array<int>): the whole text's token ids, without special tokens.

    A null and an empty text give an empty list; a null id stays null; repeated rows give repeated
    rows; columns besides the two are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(tokenizer, folder)
        schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            ids, offsets = [], [0]
            for text in batch.column(1):
                if (s := text.as_py()):
                    ids.append(np.fromiter(chain.from_iterable(map(fst.piece, fst.split(s))), np.int32))
                    offsets.append(offsets[-1] + len(ids[-1]))
                else:
                    offsets.append(offsets[-1])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], schema=schema)

    out = df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """(id, n_tokens long) by the same transducer; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(tokenizer, folder)
        for batch in batches:
            sizes = [fst.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["id", "n_tokens"]
            )

    out = df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_tokens")
