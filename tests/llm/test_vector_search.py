import math
import random

import numpy as np

from tunelake.llm import vector_search as vs

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cell int, mark long, dims string, kth int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, 3, "d", 4) for i, v in rows], SCHEMA)


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in vector)


def slow(rows, k=5, every=50):
    rows = list(dict.fromkeys((i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if usable(v)))
    out = []
    for q, qv in rows:
        if q is None or q % every:
            continue
        products = [(sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv)]
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, s)), i is None, i) for s, i in products]
        out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, **more):
    return sorted((tuple(r) for r in vs.search(frame(spark, rows), **more).collect()), key=repr)


def vectors(draw, count, dims, clusters):
    centres = draw.normal(size=(clusters, dims))
    points = centres[draw.integers(0, clusters, count)] + draw.normal(size=(count, dims)) * draw.choice([0.01, 0.3, 1.0])
    return points * draw.choice([0.02, 0.2, 1.0], size=(count, 1))


def test_clustered_vectors_in_small_blocks(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(n, v.tolist()) for n, v in enumerate(vectors(draw, 1500, 6, 12))]
    # A third of the rows are copies of one vector, whose scores tie.
    rows += [(2000 + n, rows[3][1]) for n in range(700)]
    monkeypatch.setattr(vs, "BLOCK", 128)
    assert found(spark, rows) == slow(rows)


def test_pruned_pairs_hold_nothing():
    draw = np.random.default_rng(2)
    for dims in (1, 3, 12):
        data, queries = vectors(draw, 600, dims, 5), vectors(draw, 40, dims, 3)
        data, queries = np.floor(256 * data), np.floor(256 * queries)
        left, right = vs.CoverTree(queries, 8), vs.CoverTree(data, 64)
        scores = queries @ data.T
        kth = np.sort(scores, axis=1)[:, -5]
        keep = vs.surviving(left, right, kth)
        row, column = np.nonzero(scores >= kth[:, None])
        assert keep[left.owner[row], right.owner[column]].all()
        if dims < 12:
            assert keep.mean() < 0.7


def test_tree_invariants():
    draw = np.random.default_rng(3)
    points = vectors(draw, 500, 4, 7)
    tree = vs.CoverTree(points, 50)
    assert tree.sizes[0] == 1 and tree.sizes[-1] == 50 and sorted(tree.order) == list(range(500))
    under = tree.owner
    for level in reversed(range(len(tree.sizes))):
        size = tree.sizes[level]
        assert (np.linalg.norm(points - tree.centres[under], axis=1) <= tree.reach[level][under] + 1e-9).all() and under.max() < size
        if level:
            under = tree.parents[level][under]
    same = vs.CoverTree(np.ones((30, 4)), 8)
    assert same.sizes == [1] and same.reach[0][0] == 0


def test_awkward_rows(spark):
    draw = random.Random(4)
    rows = [(n, [draw.choice([-1.0, 0.0, 0.5, 0.001, -0.001]) for _ in range(2)]) for n in range(-60, 160)]
    rows += [(n, [0.25] * 3) for n in (500, 501, 502)] + [(550, []), (551, []), (600, [1.0] * 7)]
    rows += [(650, None), (651, [None, 1.0]), (652, [math.nan, 1.0]), (653, [math.inf, 0.0]), (700, [1e308, 0.0])]
    rows += [(None, [1.0, 1.0]), (None, [2.0, 2.0]), (50, [3.0, 3.0]), (50, [3.0, 3.0]), (51, [3.0, 3.0]), (51, [3.0, 3.0])]
    got = found(spark, rows)
    assert got == slow(rows)
    assert not {r[0] for r in got} & {600, 650, 700}


def test_large_numbers(spark):
    rows = [(n, [float(10**9 + n), -float(2**40 - n)]) for n in range(60)] + [(n, [1e200 * n, 1.0]) for n in range(100, 110)]
    assert found(spark, rows, every=25) == slow(rows, every=25)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []
