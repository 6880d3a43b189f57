import random
import time
from pathlib import Path

import pytest

from helpers import rows_of, table, with_ids
from tunelake.llm import near_copies as nc


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[n : n + 5]) for n in range(max(1, len(words) - 4))} if words else set()


def similar(one, two):
    return (one == two) or len(one & two) >= 0.8 * len(one | two)


def groups_of(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for n in range(len(texts)):
        for m in range(n):
            if similar(sets[n], sets[m]):
                a, b = top(n), top(m)
                root[max(a, b)] = min(a, b)
    return [top(n) for n in range(len(texts))]


def edited(draw, words, rate):
    return [f"new{draw.random()}" if draw.random() < rate else word for word in words]


def corpus(draw, originals, copies, lengths=(30, 80, 300)):
    texts = []
    for _ in range(originals):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice(lengths))]
        texts.append(" ".join(words))
        texts += [" ".join(edited(draw, words, draw.choice([0.002, 0.01, 0.02]))) for _ in range(copies)]
    draw.shuffle(texts)
    return texts


def test_recall_and_precision_between_080_and_095(spark):
    draw = random.Random(1)
    texts = corpus(draw, 250, 1)
    # Pairs just around the threshold: from 0.70 to 0.95.
    for _ in range(300):
        words = [f"w{draw.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(words), " ".join(edited(draw, words, draw.uniform(0.002, 0.03)))]
    sets = [shingle_set(t) for t in texts]
    expected = groups_of(texts)
    stay = {r["doc_id"] for r in nc.one_of_each(table(spark, texts)).collect()}
    gone = set(range(len(texts))) - stay
    wanted = {n for n, root in enumerate(expected) if n != root}
    # Nothing clean goes, and hardly anything is missed, near the threshold as well.
    assert gone <= wanted
    near = [n for n in wanted if len(sets[n] & sets[expected[n]]) < 0.87 * len(sets[n] | sets[expected[n]])]
    assert len(near) > 40 and len(gone) >= 0.97 * len(wanted) and len(gone & set(near)) >= 0.9 * len(near)


def test_large_group_and_tight_buckets(spark, monkeypatch):
    draw = random.Random(2)
    base = [f"w{draw.randrange(3000)}" for _ in range(150)]
    long = [f"v{draw.randrange(3000)}" for _ in range(3000)]
    texts = [" ".join(edited(draw, base, 0.015)) for _ in range(700)] + [" ".join(base)]
    # One word changed in a long text: fingerprints that hardly differ in any bit.
    texts += [" ".join(long[:n] + ["x"] + long[n + 1 :]) for n in range(0, 3000, 10)]
    monkeypatch.setattr(nc, "BUCKET", 64)
    stay = [r["doc_id"] for r in nc.one_of_each(table(spark, texts)).collect()]
    expected = set(groups_of(texts[:701])) | {701}
    assert 0 in stay and 701 in stay and len(stay) <= len(expected) + 7


@pytest.mark.parametrize("bucket", [512, 24])
def test_no_neighbour_is_left_out(spark, monkeypatch, bucket):
    # Every copy lies among thirty texts that are nearly similar enough: some of them have nearer fingerprints.
    draw = random.Random(4)
    texts = []
    for _ in range(8):
        base = [f"w{draw.randrange(30000)}" for _ in range(200)]
        decoys = [edited(draw, base, 0.018) for _ in range(30)]
        texts += [" ".join(words) for words in decoys] + [" ".join(edited(draw, words, 0.019)) for words in decoys[:6]]
    monkeypatch.setattr(nc, "NEAREST", 1)
    monkeypatch.setattr(nc, "BUCKET", bucket)
    expected = groups_of(texts)
    wanted = {n for n, root in enumerate(expected) if n != root}
    gone = set(range(len(texts))) - {r["doc_id"] for r in nc.one_of_each(table(spark, texts)).collect()}
    assert len(wanted) > 20 and gone <= wanted and len(gone) >= 0.97 * len(wanted)


def test_pairs_follow_the_size_of_a_group(spark, monkeypatch):
    # Texts around one original whose fingerprints are near, but which are not similar enough: few pairs leave the tasks.
    draw, counts, found = random.Random(6), [], nc.candidates
    base = [f"w{draw.randrange(30000)}" for _ in range(200)]
    texts = [" ".join(edited(draw, base, 0.02)) for _ in range(400)]

    def counted(rows, limit):
        pairs, more = found(rows, limit)
        counts.append(pairs.count())
        return pairs, more

    monkeypatch.setattr(nc, "candidates", counted)
    expected = groups_of(texts)
    gone = set(range(len(texts))) - {r["doc_id"] for r in nc.one_of_each(table(spark, texts)).collect()}
    wanted = {n for n, root in enumerate(expected) if n != root}
    assert gone <= wanted and len(gone) >= 0.97 * len(wanted) and sum(counts) < 25 * len(texts)


def test_few_bands_are_on_disk_at_a_time(spark, monkeypatch):
    # More bands than are taken together: no step brings all of them, and nothing of a step stays but what it wrote.
    draw, counts, found = random.Random(8), [], nc.candidates
    texts = corpus(draw, 150, 3, (30, 60))
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p.name for disk in disks for p in Path(disk.getPath()).glob("*/shuffle_*")}

    def counted(rows, limit):
        counts.append(rows.count())
        return found(rows, limit)

    monkeypatch.setattr(nc, "MEAN", 1)
    monkeypatch.setattr(nc, "candidates", counted)
    before = files()
    marked = nc.groups(table(spark, texts))
    ends = time.time() + 20
    while (left := files() - before) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert len(nc.bands(len(texts))) > 16 and max(counts) <= 16 * len(texts)
    wanted = {n for n, root in enumerate(groups_of(texts)) if n != root}
    gone = {r["doc_id"] for r in marked.filter("not first").collect()}
    assert len(wanted) > 300 and gone <= wanted and len(gone) >= 0.97 * len(wanted)


def test_bounds_never_rule_a_link_out():
    draw = random.Random(5)
    for size in (4, 5, 30, 400, 3000):
        for _ in range(20):
            words = [f"w{draw.randrange(30000)}" for _ in range(size + 4)]
            one, two = nc.shingles(" ".join(words)), nc.shingles(" ".join(edited(draw, words, 0.02)))
            both = len(set(one.tolist()) & set(two.tolist()))
            apart = sum(bin(a ^ b).count("1") for a, b in zip(nc.parity(one), nc.parity(two)))
            assert apart <= len(one) + len(two) - 2 * both and len(nc.parity(one)) * 8 == nc.PARITY_BITS
            if size < nc.SMALLEST:
                assert both < nc.LEAST * (len(one) + len(two) - both) or both == len(one) == len(two)
    assert nc.SMALLEST == 4


def test_awkward_rows(spark):
    one, two = "one two three four five six seven", "an entirely different line of words about nothing"
    pairs = [(1, one), (1, two), (2, one.upper()), (3, None), (4, ""), (5, " \n\t"), (6, "a b"), (7, "A B"), (8, "a b c"), (None, one), (None, one), (9, one), (9, one)]
    assert sorted(rows_of(nc.one_of_each(with_ids(spark, pairs)).select("doc_id", "text")), key=repr) == sorted([(1, one), (1, two), (3, None), (6, "a b"), (8, "a b c"), (None, one), (None, one)], key=repr)
    long = "word " * 200_000 + " ".join(f"w{n}" for n in range(300_000))
    assert [r["doc_id"] for r in nc.one_of_each(with_ids(spark, [(5, long), (4, long + " end")])).collect()] == [4]


def test_names_that_clash(spark):
    columns = "doc_id long, text string, stay string, often int, key string, node long, fp string, __id int, _key int, first int"
    frame = spark.createDataFrame([(2, "a b c d e f", "s", 1, "k", 3, "f", 4, 5, 6), (1, "a b c d e f", "t", 1, "k", 3, "f", 4, 5, 6), (1, "x", "t", 1, "k", 3, "f", 4, 5, 6)], columns)
    found = nc.one_of_each(frame)
    assert found.columns == frame.columns and sorted(tuple(r)[:3] for r in found.collect()) == [(1, "a b c d e f", "t"), (1, "x", "t")]


def test_one_text_of_an_id_stays_for_two_groups(spark):
    # Both texts of id 1 are first of their groups.
    other = "some quite different words that stand here alone"
    found = nc.one_of_each(with_ids(spark, [(1, "a b c d e f"), (1, other), (2, "a b c d e f"), (3, other)]))
    assert sorted(r["text"] for r in found.collect()) == ["a b c d e f", other]


@pytest.mark.parametrize("nodes", [0, 1, 10_000, 10**9])
def test_bands_follow_the_number_of_nodes(nodes):
    bands = nc.bands(nodes)
    width = len(bands[0])
    assert all(len(set(b.tolist())) == width for b in bands)
    meet = (1 - nc._SHARE) ** width
    assert (1 - meet) ** len(bands) <= nc.MISSED < (1 - meet) ** (len(bands) - 1)
    assert nodes / 2**width <= nc.MEAN


def test_empty_table(spark):
    assert nc.one_of_each(table(spark, [])).count() == 0
