"""Most similar vectors for every vector, by a forest of random-projection trees.

The trees share their uppermost levels, which are fitted on a bounded sample and cut the rows into
cells of a bounded number of rows; below them every cell refits its trees on its own rows, so that a
leaf holds the same number of vectors whatever the size of the table. A vector is sent once to its
own cell and, through the priority queue, to the cells that lie nearest beyond a split; inside a
cell one queue over all of its trees picks the leaves. Vectors travel in compressed blocks without
loss. Similarities of what leaves hold together are computed exactly, so the forest only decides
what is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.llm.forest import Forest
from fernlode.session import materialize

#: Bound of the sample that the uppermost levels are fitted on, and its rows for each cell, so at most
#: SAMPLE_ROWS / CELL_SAMPLE cells; a table with more rows than MOST_CELL_ROWS for each of them has
#: its cells dealt into parts, all of which a vector searches.
SAMPLE_ROWS, CELL_SAMPLE = 200_000, 24
#: A table has CELLS cells as long as that gives between these numbers of rows to a cell.
CELLS, LEAST_CELL_ROWS, MOST_CELL_ROWS = 32, 16_384, 65_536
#: Cells beside its own that a vector visits at most, and leaves inside a cell over all of its trees.
CELL_VISITS, VISITS = 4, 2
#: Vectors of a leaf, on average, and trees of a cell.
LEAF_ROWS, TREES = 512, 2
#: How far beyond a split a cell is visited: in standard deviations of the projected difference of two
#: vectors of the least similarity. Of a parted pair, one lies within half of that difference.
REACH = 0.54
#: Vectors that a routing task holds before it sends its blocks.
HELD_ROWS = 60_000
#: Rows of copies up to which they are sent to all tasks; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a cell that are routed and compared at once.
BLOCK_ROWS = 8192


def _usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(vector_col)
    # no null entry, right length, and some entry that isn't zero or NaN
    return df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("vector")).where(
        F.col("id").isNotNull()
        & (F.size("vector") == dim)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
        & F.exists("vector", lambda x: x != 0)
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float32).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    out = np.empty(vectors.shape, np.float32)
    for a in range(0, len(vectors), BLOCK_ROWS):
        wide = vectors[a : a + BLOCK_ROWS].astype(np.float64)
        wide /= np.abs(wide).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
        out[a : a + BLOCK_ROWS] = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    return out


def _pack(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A block without loss: bytes of equal significance lie together and compress well. Vectors of
    few binary places go as whole numbers of the last place, others as floats."""
    head = np.diff(ids, prepend=0).astype("<i8")
    whole = vectors.astype(np.float64) * 16384
    places = -1
    if (np.abs(whole) < 2**40).all() and (whole == np.rint(whole)).all():
        numbers = whole.astype(np.int64)
        joint = int(np.bitwise_or.reduce(numbers, axis=None))
        places = min((joint & -joint).bit_length() - 1, 14) if joint else 14
        numbers >>= places
        if np.abs(numbers).max(initial=0) >= 2**15:
            places = -1
    if places >= 0:
        body = (np.abs(numbers) * 2 + (numbers < 0)).astype("<u2").view(np.uint8).reshape(-1, 2).T
    else:
        body = np.ascontiguousarray(vectors, np.float32).view(np.uint8).reshape(-1, 4).T
    parts = bytes((places + 1,)), head.view(np.uint8).reshape(-1, 8).T.tobytes(), body.tobytes()
    return zstandard.compress(b"".join(parts), 3)


def _unpack(block: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(block)
    places = raw[0] - 1
    planes = np.frombuffer(raw, np.uint8, 8 * n, 1).reshape(8, n)
    ids = np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())
    body = np.frombuffer(raw, np.uint8, offset=1 + 8 * n)
    if places < 0:
        return ids, np.ascontiguousarray(body.reshape(4, -1).T).view(np.float32).reshape(n, dim)
    coded = np.ascontiguousarray(body.reshape(2, -1).T).view("<u2").astype(np.int64)
    numbers = np.where(coded & 1, -(coded >> 1), coded >> 1) << places
    return ids, (numbers / 16384).astype(np.float32).reshape(n, dim)


def _copies(rows: DataFrame) -> DataFrame:
    """(id, first, nth): rows whose vector occurs more than once; first is the group's least id.

    Hashes of 128 bits stand for the vectors; the counts are combined before the shuffle.
    """
    keyed = rows.select("id", F.xxhash64("vector").alias("h"), F.hash("vector").alias("g"))
    groups = keyed.groupBy("h", "g").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = materialize(groups, "copied")
    small = groups.count() <= BROADCAST_ROWS
    return materialize(keyed.join(F.broadcast(groups) if small else groups, ["h", "g"]).select("id", "first", "copies"), "copies")


def _best(rows: np.ndarray, others: np.ndarray, similar: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k most similar others of each row, each other once; ties go to the lower id."""
    _, once = np.unique(rows * np.int64(len(ids)) + others, return_index=True)
    order = once[np.lexsort((ids[others[once]], -similar[once], rows[once]))]
    at = rows[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def search_cell(
    ids: np.ndarray, unit: np.ndarray, kinds: np.ndarray, k: int, least: float, trees: int, visits: int, leaf_rows: int, share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, similarity): up to k neighbours, among the rows of kind 0 and 1, of those of
    kind 1 and 2. The cell's trees are fitted here, on its own rows."""
    homes, askers = np.flatnonzero(kinds < 2), np.flatnonzero(kinds > 0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(homes) and len(askers):
        depth = max(0, round(math.log2(len(homes) / leaf_rows)))
        local = None
        if depth:
            rng = np.random.default_rng(5)
            some = homes if len(homes) <= 64 << depth else rng.choice(homes, 64 << depth, replace=False)
            local = Forest(unit[some], trees, depth)
            home = np.concatenate([local.route(unit[homes[a : a + BLOCK_ROWS]], 0)[0] for a in range(0, len(homes), BLOCK_ROWS)])
            visits = max(visits, math.ceil(share * trees * 2**depth) - trees)
            order = np.argsort(home.ravel(), kind="stable")
            edge = np.searchsorted(home.ravel()[order], np.arange(trees * 2**depth + 1))
            members = homes[order // trees]
        for a in range(0, len(askers), BLOCK_ROWS):
            part = askers[a : a + BLOCK_ROWS]
            if local is None:
                meets = [(part, homes)]
            else:
                own, seen, _ = local.route(unit[part], visits)
                leaf = np.concatenate([own, seen], axis=1)
                at = np.argsort(leaf.ravel(), kind="stable")
                cuts = np.searchsorted(leaf.ravel()[at], np.arange(trees * 2**depth + 1))
                who = part[at // leaf.shape[1]]
                meets = ((who[cuts[n] : cuts[n + 1]], members[edge[n] : edge[n + 1]]) for n in range(trees * 2**depth) if cuts[n] < cuts[n + 1])
            hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for who_, there in meets:
                for b in range(0, len(who_) if len(there) else 0, 2048):
                    mine = who_[b : b + 2048]
                    s = unit[mine] @ unit[there].T
                    if least > -1:
                        x, y = np.nonzero(s >= least - 1e-5)
                    else:
                        m = min(k + 1, s.shape[1])
                        y = np.argpartition(-s, m - 1, axis=1)[:, :m].ravel()
                        x = np.repeat(np.arange(len(s)), m)
                    left, right = mine[x], there[y]
                    other = ids[left] != ids[right]
                    left, right = left[other], right[other]
                    # the last word in double precision
                    exact = np.einsum("ij,ij->i", unit[left].astype(np.float64), unit[right].astype(np.float64))
                    near_ = exact >= least
                    hits.append((left[near_], right[near_], exact[near_]))
            if hits:
                left, right, exact = (np.concatenate(c) for c in zip(*hits))
                best = _best(left, right, exact, ids, k)
                found.append((ids[left[best]], ids[right[best]], exact[best]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest(
    df: DataFrame,
    k: int,
    id_col: str = "id",
    vector_col: str = "embedding",
    dim: int = 64,
    min_similarity: float = -1.0,
    queries: str | None = None,
    trees: int = TREES,
    visits: int = VISITS,
    leaf_rows: int = LEAF_ROWS,
    cell_visits: int = CELL_VISITS,
    cell_rows: int | None = None,
    visit_share: float = 0.0,
    n_rows: int | None = None,
) -> DataFrame:
    """(id, neighbour, similarity): up to k most similar other vectors of each vector.

    Cosine similarity; ties go to the lower id. Null, zero, shorter or longer vectors and those
    with null or NaN entries take no part; an empty table has no result. Exact copies of a vector
    are compared once and share its neighbours, each copy counting as a neighbour of its own. Of
    repeated rows of an id one counts.
    min_similarity leaves out less similar ones, which makes the search cheap for near pairs: only
    cells within reach of such a pair are visited.
    visit_share: visits at least this share of all cells, and of a cell's leaves, for data whose
    neighbours are hardly nearer than the rest, where no fixed number of visits finds them.
    queries: an SQL condition on `id`; only those rows are asked for, against all rows.
    cell_rows: rows of a cell, about; by default they follow the number of rows within bounds.
    """
    spark = df.sparkSession
    rows = _usable(df, id_col, vector_col, dim)
    if n_rows is None:
        n_rows = df.count()
    per_cell = cell_rows or min(max(n_rows // CELLS, LEAST_CELL_ROWS), MOST_CELL_ROWS)
    depth = max(0, min(round(math.log2(max(n_rows, 1) / per_cell)), int(math.log2(SAMPLE_ROWS / CELL_SAMPLE))))
    forest = None
    if depth:
        wanted = min(SAMPLE_ROWS, max(CELL_SAMPLE << depth, 8192))
        sample = rows.select("vector").sample(min(1.0, 1.3 * wanted / n_rows), seed=11).limit(wanted).toArrow()
        if sample.num_rows:
            forest = Forest(_unit(_matrix(sample["vector"].combine_chunks(), dim)), 1, depth)
        else:
            depth = 0
    cells = 2**depth
    parts = max(1, -(-n_rows // (cells * 2 * max(per_cell, MOST_CELL_ROWS))))  # of each cell, dealt by id
    beyond = min(cells - 1, max(cell_visits, math.ceil(visit_share * cells) - 1))
    reach = REACH * math.sqrt((2 - 2 * min_similarity) / dim) if min_similarity > -1 and not visit_share else math.inf
    shared = spark.sparkContext.broadcast(forest)  # bounded: at most SAMPLE_ROWS / CELL_SAMPLE normals
    asked = rows.withColumn("asked", F.expr(queries) if queries else F.lit(True))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            ids, vectors, ask = (np.concatenate(x) for x in zip(*held))
            held.clear()
            home = np.zeros(len(ids), np.int64)
            who, cell, kind = [np.arange(len(ids))], [home], [ask.astype(np.uint8)]
            tree = shared.value
            if tree is not None:
                unit = _unit(vectors)
                for a in range(0, len(ids), BLOCK_ROWS):
                    home[a : a + BLOCK_ROWS] = tree.route(unit[a : a + BLOCK_ROWS], 0)[0][:, 0]
                asks = np.flatnonzero(ask)  # only what is asked for visits other cells
                for a in range(0, len(asks), BLOCK_ROWS):
                    mine = asks[a : a + BLOCK_ROWS]
                    _, visited, far = tree.route(unit[mine], beyond)
                    x, y = np.nonzero(far <= reach)
                    who.append(mine[x])
                    cell.append(visited[x, y])
                    kind.append(np.full(len(x), 2, np.uint8))
            who, cell, kind = (np.concatenate(x) for x in (who, cell, kind))
            if parts > 1:  # a row lives in one part of its cell, and asks in all of them
                own = np.where(kind < 2, ids[who] % parts, -1)
                again = np.flatnonzero(kind > 0)
                every = np.repeat(again, parts)
                part = np.tile(np.arange(parts), len(again))
                new = part != own[every]
                lives = np.flatnonzero(kind < 2)
                take = np.concatenate([lives, every[new]])
                cell = cell[take] * parts + np.concatenate([own[lives], part[new]])
                kind = np.concatenate([kind[lives], np.full(new.sum(), 2, np.uint8)])
                who = who[take]
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.diff(cell[order])) + 1
            out = [(int(cell[at[0]]), len(at), _pack(ids[who[at]], vectors[who[at]]), kind[at].tobytes()) for at in np.split(order, edges)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["cell", "n", "block", "kinds"])

        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(
                    (
                        batch.column(0).to_numpy(),
                        _matrix(batch.column(1), dim),
                        batch.column(2).to_numpy(zero_copy_only=False).astype(bool),
                    )
                )
                count += batch.num_rows
            if count >= HELD_ROWS:
                yield from send()
                count = 0
        if count:
            yield from send()

    def search(table: pa.Table) -> pa.Table:
        blocks = [_unpack(b, n, dim) for n, b in zip(table["n"].to_pylist(), table["block"].to_pylist())]
        ids = np.concatenate([i for i, _ in blocks])
        unit = np.concatenate([_unit(v) for _, v in blocks])
        kinds = np.frombuffer(b"".join(table["kinds"].to_pylist()), np.uint8)
        _, once = np.unique(ids, return_index=True)
        if len(once) < len(ids):  # repeated rows
            ids, unit, kinds = ids[once], unit[once], kinds[once]
        found = search_cell(ids, unit, kinds, k, min_similarity, trees, visits, leaf_rows, visit_share)
        return pa.table({"id": found[0], "neighbour": found[1], "similarity": found[2].astype(np.float64)})

    copies = _copies(rows)
    spare = copies.where("id != first")
    n_spare = spare.count()
    if n_spare:
        spare = F.broadcast(spare) if n_spare <= BROADCAST_ROWS else spare
        asked = asked.join(spare.select("id"), "id", "left_anti")
        if queries:  # the first of a group searches for all of its copies
            wanted = copies.where("id != first").where(queries).select(F.col("first").alias("id"), F.lit(True).alias("wanted")).distinct()
            wanted = F.broadcast(wanted) if n_spare <= BROADCAST_ROWS else wanted
            asked = asked.join(wanted, "id", "left").withColumn("asked", F.col("asked") | F.coalesce("wanted", F.lit(False)))
    blocks = asked.select("id", "vector", "asked").mapInArrow(route, "cell long, n int, block binary, kinds binary")
    blocks = blocks.repartition(min(cells * parts, 20_000), "cell")  # tasks follow the cells, so their size stays
    near = blocks.groupBy("cell").applyInArrow(search, "id long, neighbour long, similarity double")
    if n_spare:
        near = _with_copies(near, copies, k, queries)
    return _top(near, k)


def _top(near: DataFrame, k: int) -> DataFrame:
    """The k best of each id; an id has at most k candidates from each leaf, so its group is small."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, k)
    # an id comes from several cells, but never with one neighbour twice: a row lives in one cell
    top = near.groupBy("id").agg(best.alias("best")).select("id", F.explode("best").alias("b"))
    return top.select("id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.s")).alias("similarity"))


def _with_copies(near: DataFrame, copies: DataFrame, k: int, queries: str | None) -> DataFrame:
    """Lets the copies of a vector, of which one was searched, appear as askers and neighbours.

    Of a group, the k + 1 least ids can be among anyone's k nearest, as ties go to the lower id.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("first").orderBy("id"))
    heads = copies.select("first", "id", nth.alias("nth")).where(F.col("nth") <= k + 1).select("first", "id")
    others = near.join(heads.select(F.col("first").alias("neighbour"), F.col("id").alias("copy")), "neighbour", "left")
    others = others.select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity")
    askers = copies.select(F.col("first").alias("id"), F.col("id").alias("copy"))
    more = others.join(askers, "id", "left").select(F.coalesce("copy", "id").alias("id"), "neighbour", "similarity")
    same = copies.join(heads.select("first", F.col("id").alias("neighbour")), "first").where("id != neighbour")
    out = more.unionByName(same.select("id", "neighbour", F.lit(1.0).alias("similarity")))
    return out.where(queries) if queries else out
