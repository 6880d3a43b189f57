"""The block scans against plain Python, with groups that span many blocks and heavy ties."""

import random

import pytest
from pyspark.sql import functions as F

from tunelake.operators import scans


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = [0] * 400 + [rng.randrange(1, 6) for _ in range(600)]
    return [(k, i, rng.choice([0.0, 0.0, 0.0, 0.5, rng.uniform(-5, 5)])) for i, k in enumerate(keys)]


def frame(spark, rows, parts=7):
    return spark.createDataFrame(rows, "k long, i long, v double").repartition(parts)


def grouped(rows):
    groups = {}
    for k, i, v in rows:
        groups.setdefault(k, []).append((i, v))
    return groups


def test_running_measures(spark, rows):
    got = scans.running(
        frame(spark, rows),
        ["k"],
        ["i"],
        scans.number_block(F.col("i"), 16),
        {
            "upto": scans.total(F.col("v")),
            "best_before": scans.peak(F.col("v"), inclusive=False),
            "least": scans.lowest(F.col("v")),
            "last_half": scans.latest(F.when(F.col("v") == 0.5, F.col("i")), inclusive=False),
        },
    ).collect()
    want = {}
    for k, items in grouped(rows).items():
        sum_, best, least, last = 0.0, None, None, None
        for i, v in sorted(items):
            sum_ += v
            least = v if least is None else min(least, v)
            want[k, i] = (round(sum_, 6), best, least, last)
            best = v if best is None else max(best, v)
            last = i if v == 0.5 else last
    assert {(r.k, r.i): (round(r.upto, 6), r.best_before, r.least, r.last_half) for r in got} == want


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_order_statistics(spark, rows, parts):
    picks = {"p50": scans.floor_rank(0.5), "p90": scans.floor_rank(0.9), "c99": scans.ceil_rank(0.99)}
    got = scans.order_statistics(frame(spark, rows, parts), ["k"], "v", picks).collect()
    for r in got:
        values = sorted(v for _, v in grouped(rows)[r.k])
        n = len(values)
        assert r.samples == n
        assert r.p50 == values[min(n - 1, int(n * 0.5))]
        assert r.p90 == values[min(n - 1, int(n * 0.9))]
        assert r.c99 == values[max(0, min(n - 1, -int(-n * 0.99 // 1) - 1))]
    assert len(got) == 6


def test_ranked_with_ties(spark, rows, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 16)
    got = scans.ranked(frame(spark, rows), ["k"], [-F.col("v")], "i").collect()
    want = {}
    for k, items in grouped(rows).items():
        for place, (i, _) in enumerate(sorted(items, key=lambda x: (-x[1], x[0])), 1):
            want[k, i] = place
    assert {(r.k, r.i): r["rank"] for r in got} == want


def test_slots_cover_counts(spark):
    groups = spark.createDataFrame([(1, 0), (2, 5), (3, 1000)], "k long, n long")
    got = scans.slots(groups, F.col("n"), "s", block_rows=64).groupBy("k").agg(F.count("*"), F.count_distinct("s"), F.max("s"))
    assert sorted(tuple(r) for r in got.collect()) == [(2, 5, 5, 4), (3, 1000, 1000, 999)]


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    series = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 10, "c")], "k long, at long, p string")
    points = spark.createDataFrame([(1, 5), (1, 10), (1, 19), (1, 25), (2, 99), (3, 1)], "k long, at long")
    block = lambda at: scans.number_block(at, 8)
    got = scans.as_of(points, series, ["k"], "at", ["p"], block, strict=strict).collect()
    at_ten = None if strict else "a"
    assert {(r.k, r.at): r.p for r in got} == {
        (1, 5): None, (1, 10): at_ten, (1, 19): "a", (1, 25): "b", (2, 99): "c", (3, 1): None,
    }


def test_salted_join_keeps_all_rows(spark, rows):
    salted, sizes = scans.spread_hot(frame(spark, rows), ["k"], "i", hot_rows=50)
    side = scans.meet_hot(sizes.withColumn("label", F.col("k") * 10))
    got = salted.join(side, ["k", "_salt"]).groupBy("k").agg(F.count("*").alias("n"), F.min("label").alias("l"))
    assert {r.k: r.n for r in got.collect()} == {k: len(v) for k, v in grouped(rows).items()}
    assert salted.filter("k = 0").select("_salt").distinct().count() > 1
