import numpy as np

from fernlode.llm import neighbours
from fernlode.llm.forest import Forest

SCHEMA = "id long, embedding array<float>, neighbour string"


def _frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in enumerate(vectors)], SCHEMA)


def _exact(v, k, least=-1.0):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    out = {}
    for i in range(len(v)):
        order = np.argsort(-np.round(s[i], 9), kind="stable")[:k].tolist()
        out[i] = [j for j in order if s[i, j] >= least and j != i]
    return out


def test_blocks_are_exact():
    rng = np.random.default_rng(1)
    ids = np.sort(rng.choice(10**9, 300, replace=False))
    for v in (rng.standard_normal((300, 8)), np.round(rng.standard_normal((300, 8)) * 512) / 512, np.zeros((300, 8)), np.full((300, 8), 1e30)):
        v = v.astype(np.float32)
        got_ids, got = neighbours._unpack(neighbours._pack(ids, v), 300, 8)
        assert (got == v).all() and (got_ids == ids).all()


def test_near_pairs_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3000, 16))
    v = np.concatenate([base, base[:600] + 0.15 * rng.standard_normal((600, 16))]).astype(np.float32)
    want = {(i, j) for i, near in _exact(v, 10, 0.9).items() for j in near}
    real = {(i, j) for i, near in _exact(v, 3600, 0.9).items() for j in near}
    for settings in ({}, {"cell_rows": 400}):  # one cell, several cells
        got = neighbours.nearest(_frame(spark, v), 10, dim=16, min_similarity=0.9, leaf_rows=200, **settings).collect()
        found = {(r.id, r.neighbour) for r in got}
        assert len(found) == len(got) and found <= real
        assert len(want & found) >= 0.97 * len(want)


def test_cells_in_parts_and_full_mantissa_vectors(spark, monkeypatch):
    """A cell above its bound of rows is dealt into parts and still searched whole; what is sent stays within the disk budget."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((2500, 16))
    v = np.concatenate([base, base[:500] + 0.1 * rng.standard_normal((500, 16))]).astype(np.float32)
    want = {(i, j) for i, near in _exact(v, 10, 0.9).items() for j in near}
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 4 * neighbours.CELL_SAMPLE)
    monkeypatch.setattr(neighbours, "MOST_CELL_ROWS", 150)
    found = {(r.id, r.neighbour) for r in neighbours.nearest(_frame(spark, v), 10, dim=16, min_similarity=0.9, leaf_rows=50, cell_rows=150).collect()}
    assert len(want & found) >= 0.97 * len(want)
    ids = np.arange(3000)
    assert len(neighbours._pack(ids, rng.standard_normal((3000, 64)).astype(np.float32))) <= 0.96 * 3000 * 256


def test_repeated_rows_count_once(spark):
    v = [[1.0, 0.0], [1.0, 0.1], [1.0, 0.2]]
    rows = _frame(spark, v).union(_frame(spark, v))
    got = [(r.id, r.neighbour) for r in neighbours.nearest(rows, 10, dim=2, min_similarity=0.9).collect()]
    assert sorted(got) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_all_neighbours_with_many_visits(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((2000, 12)).astype(np.float32)
    got = neighbours.nearest(_frame(spark, v), 5, dim=12, leaf_rows=100, trees=4, visits=40, queries="id % 10 = 0").collect()
    want = _exact(v, 5)
    per = {}
    for r in got:
        per.setdefault(r.id, set()).add(r.neighbour)
    assert set(per) == {i for i in range(2000) if i % 10 == 0} and all(len(x) == 5 for x in per.values())
    assert np.mean([len(per[i] & set(want[i])) / 5 for i in per]) >= 0.9


def test_unusable_vectors_and_copies(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [a, b, c, None, [0.0, 0.0, 0.0], [1.0], [1.0, None, 0.0], [float("nan"), 0.0, 0.0], a, a]
    got = neighbours.nearest(_frame(spark, rows), 10, dim=3, min_similarity=0.9).collect()
    pairs = {(r.id, r.neighbour) for r in got}
    group = {0, 1, 8, 9}
    assert pairs == {(x, y) for x in group for y in group if x != y}
    assert neighbours.nearest(_frame(spark, rows).limit(0), 10, dim=3).count() == 0
    assert neighbours.nearest(_frame(spark, [None, None]), 10, dim=3).count() == 0


def test_copy_that_is_asked_for_while_its_first_is_not(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((200, 8)).astype(np.float32)
    v[20], v[30], v[31] = v[3], v[7], v[7]  # 31 is not asked for either
    got = neighbours.nearest(_frame(spark, v), 5, dim=8, queries="id % 10 = 0").collect()
    per = {}
    for r in got:
        per.setdefault(r.id, set()).add(r.neighbour)
    want = _exact(v, 5)
    assert per == {i: set(want[i]) for i in range(0, 200, 10)}


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([np.tile([[1.0, 0.0, 0.0, 0.0]], (900, 1)), rng.standard_normal((900, 4))]).astype(np.float32)
    got = neighbours.nearest(_frame(spark, v), 10, dim=4, min_similarity=0.999, leaf_rows=100).collect()
    per = {}
    for r in got:
        per.setdefault(r.id, []).append(r.neighbour)
    assert sorted(per[5]) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10] and sorted(per[700]) == list(range(10))
    assert all(len(x) <= 10 for x in per.values())


def test_queue_takes_the_nearest_leaves():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((2000, 6)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tree = Forest(v, 1, 4)
    home, seen, _ = tree.route(v[:50], 15)
    for h, s in zip(home, seen):
        assert sorted([*h, *s]) == list(range(16))  # all sixteen leaves in the end
