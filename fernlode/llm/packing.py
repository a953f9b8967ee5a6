"""Packing of items into containers of fixed capacity by swap-based local search.

Items are dealt by a hash of their id into lots of a bounded size, whose number follows the number
of items; every lot is packed in a task of its own. Items above the capacity are cut into full
containers and a rest that is packed like any other item; nothing else is cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one lot, on average; the room lost to a lot's last containers falls with it.
LOT_ITEMS = 4000


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item positions; sizes lie in 1..capacity.

    Items go in order of arrival into the fullest open container that takes them. The local search
    then takes the emptiest container and tries to move its items into the others' room, to
    exchange one of its items for a smaller one elsewhere (the other container gets fuller), or one
    of its items for two smaller ones. Each step looks at all containers and items and raises the sum
    of squared fills, so it ends: when no step is left, or when no fewer containers can hold the
    sizes. A container that becomes empty is dropped.
    """
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for item in range(len(sizes)):
        at = bisect_left(room, (sizes[item], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if left > sizes[item]:
            insort(room, (left - sizes[item], b))
    search = _Search(bins, sizes, capacity)
    search.run(-(-sum(sizes) // capacity))
    return [b for b in search.bins if b]


class _Search:
    """Local search over the containers of a lot."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.capacity = [set(b) for b in bins], capacity
        self.size = np.array(sizes, np.int64)
        self.of = np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins):
            self.of[items] = b
        self.fill = np.bincount(self.of, self.size, len(bins)).astype(np.int64) if bins else np.empty(0, np.int64)
        self.keys = np.sort(self._key(np.arange(len(sizes))))

    def _key(self, item: np.ndarray | int) -> np.ndarray:
        """Orders items by container, then size."""
        return (self.of[item] * (self.capacity + 1) + self.size[item]) * len(self.size) + item

    def run(self, bound: int) -> None:
        """Until a whole round over the underfull containers changes nothing, or `bound` of them are left."""
        moved = True
        while moved:
            moved = False
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            for b in under[np.argsort(self.fill[under], kind="stable")].tolist():
                while self.fill[b] > 0 and np.count_nonzero(self.fill) > bound and self._step(b):
                    moved = True
            if np.count_nonzero(self.fill) <= bound:
                return

    def _put(self, items: list[int], b: int) -> None:
        for i in items:
            old = self.of[i]
            self.keys = np.delete(self.keys, np.searchsorted(self.keys, self._key(i)))
            self.bins[old].remove(i)
            self.fill[old] -= self.size[i]
            self.of[i] = b
            self.bins[b].add(i)
            self.fill[b] += self.size[i]
            self.keys = np.insert(self.keys, np.searchsorted(self.keys, self._key(i)), self._key(i))

    def _step(self, b: int) -> bool:
        """One move or exchange of an item of container b, the largest first, if there is any. What
        shifts d tokens to container c raises the squared fill where c is fuller than b less d."""
        fill, n = self.fill, len(self.size)
        filled = int(fill[b])
        for item in sorted(self.bins[b], key=lambda i: (-self.size[i], i)):
            s = int(self.size[item])
            good = (fill <= self.capacity - s) & (fill > filled - s)
            good[b] = False
            if good.any():  # move: the tightest room
                self._put([item], int(np.where(good, fill, -1).argmax()))
                return True
            j = np.flatnonzero((self.size < s) & (self.of != b))
            c = fill[self.of[j]]
            d = s - self.size[j]
            good = (d <= self.capacity - c) & (c > filled - d)
            if good.any():  # one for one
                best = np.where(good, d * (c - filled + d), -1).argmax()
                other = int(j[best])
                target = int(self.of[other])
                self._put([other], b)
                self._put([item], target)
                return True
            place, who = np.divmod(self.keys, n)
            at, size = np.divmod(place, self.capacity + 1)
            c = fill[at]
            first = np.flatnonzero((size < s) & (at != b) & (c < self.capacity) & (c > filled - s))
            if not len(first):
                continue
            # one for two: with each smaller item the smallest other one of its container that fits
            need = np.maximum(s - size[first] - (self.capacity - c[first]), 1)
            second = np.searchsorted(place, at[first] * (self.capacity + 1) + need)
            second += second == first
            inside = second < n
            first, second = first[inside], second[inside]
            d = s - size[first] - size[second]
            good = (at[second] == at[first]) & (d > 0) & (c[first] > filled - d)
            if good.any():
                best = np.where(good, d * (c[first] - filled + d), -1).argmax()
                target = int(at[first[best]])
                self._put([int(who[first[best]]), int(who[second[best]])], b)
                self._put([item], target)
                return True
        return False


def pack_items(
    df: DataFrame,
    capacity: int,
    id_col: str = "doc_id",
    size_col: str = "n_tokens",
    lot_items: int = LOT_ITEMS,
    n_items: int | None = None,
) -> DataFrame:
    """(bin_id, id, part_no, n_tokens): which container takes which item.

    Items above the capacity come as parts 0, 1, ...: full containers and a rest. Items without
    size (null, 0 or less) and null ids get no container. Repeated ids are packed once each.
    n_items: a known or estimated number of rows; df is counted if it is None.
    """
    if n_items is None:
        n_items = df.count()
    lots = max(1, -(-n_items // lot_items))
    items = df.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("long").alias("size")).where(
        "id is not null and size > 0"
    )
    dealt = items.withColumn("lot", F.pmod(F.xxhash64("id", F.lit(20)), F.lit(lots)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "size"], ignore_index=True)
        ids, size = pdf["id"].to_numpy(), pdf["size"].to_numpy()
        full = (size - 1) // capacity
        rest = size - full * capacity
        who = np.repeat(np.arange(len(ids)), full)
        part = np.concatenate([np.arange(f) for f in full]) if full.any() else np.empty(0, np.int64)
        out = [pd.DataFrame({"no": np.arange(len(who)), "id": ids[who], "part_no": part, "n_tokens": capacity})]
        bins = pack(rest.tolist(), capacity)
        no = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) + len(who)
        at = np.array([i for b in bins for i in b], np.int64)
        out.append(pd.DataFrame({"no": no, "id": ids[at], "part_no": full[at], "n_tokens": rest[at]}))
        both = pd.concat(out, ignore_index=True)
        both["bin_id"] = (np.int64(key[0]) << np.int64(32)) + both["no"].astype(np.int64)
        return both[["bin_id", "id", "part_no", "n_tokens"]].astype("int64")

    # as many tasks as lots: a lot is small in bytes, so merging tasks by size would line lots up
    dealt = dealt.repartition(min(lots, 20_000), "lot")
    out = dealt.groupBy("lot").applyInPandas(run, "bin_id long, id long, part_no long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
