import math

import numpy as np

from tunelake.llm import neighbours


def brute(rows):
    units = []
    for _, vector in rows:
        good = vector is not None and len(vector) and all(v is not None and math.isfinite(v) for v in vector) and any(vector)
        units.append(np.array(vector, dtype=np.float64) / np.linalg.norm(np.array(vector, dtype=np.float64)) if good else None)
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for n, (vec_id, _) in enumerate(rows):
        least[top(n)] = min(least.get(top(n), vec_id), vec_id)
    return sorted((vec_id, links[n], least[top(n)], least[top(n)] == vec_id) for n, (vec_id, _) in enumerate(rows))


def test_against_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(n, draw.normal(size=16).astype(np.float32).tolist()) for n in range(400)]
    for size in (2, 5, 60, 700):
        centre = draw.normal(size=16)
        rows += [(len(rows) + n, (centre + 0.12 * draw.normal(size=16)).astype(np.float32).tolist()) for n in range(size)]
    rows += [(5000 + n, rows[0][1]) for n in range(30)] + [(6000, [2 * v for v in rows[0][1]])]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [float("nan")] * 16), (7004, [None] * 16), (7005, [float("inf")] + [1.0] * 15), (7006, [1e-30] * 16), (7007, [1.0] * 16), (7008, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, sim double, unit string")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(frame).collect())
    expected = brute(rows)
    assert [f[:1] for f in found] == [e[:1] for e in expected]
    mine, theirs = sum(f[1] for f in found), sum(e[1] for e in expected)
    assert 0.97 * theirs <= mine <= theirs
    assert sum(f == e for f, e in zip(found, expected)) >= 0.97 * len(expected)
    assert all(f[1] <= e[1] for f, e in zip(found, expected))


def test_a_dense_group_does_not_outvote_small_ones(spark, monkeypatch):
    # One tree and no refinement miss many pairs, while nearly all links are in the dense group.
    monkeypatch.setattr(neighbours, "TREES", 1)
    monkeypatch.setattr(neighbours, "ROUNDS", 0)
    draw = np.random.default_rng(11)
    centre = draw.normal(size=24)
    dense = centre + 0.1 * draw.normal(size=(1500, 24))
    single = draw.normal(size=(300, 24))
    twins = single + 0.35 * draw.normal(size=(300, 24))
    rows = [(n, v.tolist()) for n, v in enumerate(np.concatenate([dense, single, twins]))]
    found = {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    cosines = (single * twins).sum(axis=1) / np.linalg.norm(single, axis=1) / np.linalg.norm(twins, axis=1)
    pairs = [n for n in range(300) if cosines[n] >= 0.9]
    assert len(pairs) > 200 and sum(found[1500 + n] >= 1 for n in pairs) >= 0.97 * len(pairs)


def test_repeated_and_missing_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (4, [0.0, 1.0]), (None, None)], "vec_id long, embedding array<float>")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(frame).collect()), key=repr)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (4, 0, 4), (None, 0, None)], key=repr)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0
