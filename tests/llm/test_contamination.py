import random

from helpers import rows_of, table, with_ids
from tunelake.llm import contamination


def slow_best(pattern, text):
    """Dynamic programming: best distance of the pattern to any part of the text, and its first end."""
    column = list(range(len(pattern) + 1))
    best = (column[-1], 0)
    for at, letter in enumerate(text, 1):
        last, column[0] = column[0], 0
        for n, own in enumerate(pattern, 1):
            last, column[n] = column[n], min(column[n] + 1, column[n - 1] + 1, last + (own != letter))
        best = min(best, (column[-1], at))
    return best


def words(draw, count):
    return " ".join("".join(draw.choice("abcdeno ") for _ in range(draw.randint(2, 7))) for _ in range(count))


def edited(draw, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = draw.randrange(len(letters))
        kind = draw.randrange(3)
        if kind == 0:
            letters[at] = draw.choice("xyzé")
        elif kind == 1:
            del letters[at]
        else:
            letters.insert(at, draw.choice("xyzé"))
    return "".join(letters)


def test_best_match_is_dynamic_programming():
    draw = random.Random(2)
    for _ in range(200):
        pattern, text = words(draw, 3), words(draw, draw.randint(0, 12))
        assert contamination.best_match(contamination.letters(pattern), len(pattern), text) == slow_best(pattern, text)


def test_against_brute_force(spark):
    draw = random.Random(5)
    items = [(n, words(draw, draw.choice([3, 8, 30]))) for n in range(12)] + [(20, None), (21, "  "), (22, "tiny"), (23, "tiny")]
    texts = [None, "", "TINY"]
    for _ in range(60):
        _, item = items[draw.randrange(12)]
        plain = contamination.normalise(item)
        limit = contamination.budget(len(plain))
        texts.append(f"{words(draw, 5)}\n {edited(draw, item.upper(), draw.randint(0, limit + 3))} {words(draw, 5)}")
    expected = []
    for doc_id, text in enumerate(texts):
        for item_id, item in items:
            plain = contamination.normalise(item or "")
            if text and plain:
                distance, end = slow_best(plain, contamination.normalise(text))
                if distance <= contamination.budget(len(plain)):
                    expected.append((doc_id, item_id, distance, contamination.budget(len(plain)), end))
    bench = spark.createDataFrame(items, "item_id long, text string")
    # Several blocks of items give the same rows as one.
    for block_chars in (10**6, 100):
        found = contamination.find(table(spark, texts), bench, block_chars=block_chars)
        assert rows_of(found) == sorted(expected, key=repr)
    docs = table(spark, texts)
    flagged = {r["doc_id"] for r in docs.filter(contamination.contaminated(docs["text"], bench)).collect()}
    assert flagged == {e[0] for e in expected}


def test_repeats_long_texts_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    far = "word " * 200_000 + "The quick  brown fox jumps over the lazy dog"
    found = contamination.find(with_ids(spark, [(4, far), (4, far), (None, far)]), bench)
    assert [r[:3] for r in rows_of(found)] == [(4, 1, 0), (4, 1, 0), (None, 1, 0)]
    assert contamination.find(table(spark, []), bench).count() == 0
    assert contamination.find(table(spark, ["a"]), bench.limit(0)).count() == 0
