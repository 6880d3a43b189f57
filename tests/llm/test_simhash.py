import random

import numpy as np
import xxhash

from helpers import table, with_ids
from tunelake.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[n : n + 4]) for n in range(len(words) - 3)] if len(words) >= 4 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    parent = list(range(len(values)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for n in range(len(values)):
        for m in range(n):
            if bin(values[n] ^ values[m]).count("1") <= simhash.RADIUS:
                a, b = top(n), top(m)
                parent[max(a, b)] = min(a, b)
    return [top(n) for n in range(len(values))]


TEXTS = [None, "", " \n", "One two", "one TWO", "Á É one two three", "a\x0bb c d e", "x " * 70_000, "one two three four five"]


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_close_pairs_are_all_pairs():
    draw = np.random.default_rng(1)
    centre = draw.integers(0, 1 << 62, 40)
    values = np.array([int(c) ^ sum(1 << int(b) for b in draw.integers(0, 63, draw.integers(0, 6))) for c in np.repeat(centre, 20)])
    groups = np.sort(draw.integers(0, 5, len(values)))
    left, right = simhash.close_pairs(values, groups)
    expected = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if groups[i] == groups[j] and bin(int(values[i] ^ values[j])).count("1") <= 4}
    assert set(zip(left.tolist(), right.tolist())) == expected and len(left) == len(expected)


def test_close_pairs_of_several_words():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, (6, 4)).astype(np.uint64)
    values = np.repeat(base, 15, axis=0)
    for row in values:
        for bit in draw.integers(0, 256, draw.integers(0, 60)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    groups = np.sort(draw.integers(0, 3, len(values)))
    left, right = simhash.close_pairs(values, groups, 50)
    far = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2)
    expected = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if groups[i] == groups[j] and far[i, j] <= 50}
    assert set(zip(left.tolist(), right.tolist())) == expected and len(left) == len(expected) > 50


def clusters():
    draw = random.Random(4)
    values = []
    for _ in range(25):
        value = draw.getrandbits(63)
        for _ in range(draw.choice([1, 3, 30])):
            values.append(value)
            for bit in draw.sample(range(63), draw.randint(0, 5)):
                value ^= 1 << bit
    return list(dict.fromkeys(values))


def test_links_keep_all_components_at_any_bucket_size(spark):
    values = clusters()
    # Many values that agree in every block but one: only tiles can part them.
    values += [(1 << 40) | n for n in range(200)]
    values = list(dict.fromkeys(values))
    expected = roots(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (8, 64, 512):
        from tunelake.llm.graph import components

        found = {r["a"]: r["b"] for r in components(simhash.links(frame, limit)).collect()}
        mine = [found.get(v, v) for v in values]
        assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))


def test_documents(spark):
    draw = random.Random(9)
    vocabulary = [f"w{n}" for n in range(400)]
    texts = list(TEXTS)
    for _ in range(30):
        base = [draw.choice(vocabulary) for _ in range(300)]
        for _ in range(4):
            texts.append(" ".join(base))
            base[draw.randrange(300)] = "changed"
    values = [slow_fingerprint(t) for t in texts]
    expected = roots(values)
    found = simhash.near_duplicates(table(spark, texts)).select("doc_id", simhash.hex_digits(simhash.F.col("fp")).alias("h"), "component_id").collect()
    assert len(found) == len(texts)
    for row in found:
        assert row["h"] == f"{values[row['doc_id']]:016x}" and row["component_id"] == expected[row["doc_id"]]


def test_repeated_and_missing_ids(spark):
    pairs = [(3, "same text here now ok"), (3, "same text here now ok"), (None, "same text here now ok"), (2, "an entirely different line of words"), (None, "alone in the wide world today")]
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(with_ids(spark, pairs)).collect()), key=repr)
    assert found == [(2, 2), (3, 3), (3, 3), (None, 3), (None, None)]


def test_empty_table(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
