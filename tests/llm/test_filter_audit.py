import random
import re
from itertools import permutations
from math import factorial

import pytest

from helpers import table, with_ids
from tunelake.llm import filter_audit


def fails(doc_id, text, firsts):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)}
    return out | {"D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and firsts.get(text, doc_id) < doc_id}


def slow(docs, labels):
    firsts = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    failed = [fails(doc_id, text, firsts) for doc_id, text, _ in docs]
    good = [doc_id is not None and any(q == 1 for i, q, _ in labels if i == doc_id) for doc_id, _, _ in docs]
    toxic = [doc_id is not None and any(t == 1 for i, _, t in labels if i == doc_id) for doc_id, _, _ in docs]
    out = []
    for part in {lang or "" for _, _, lang in docs}:
        mine = [n for n, (_, _, lang) in enumerate(docs) if (lang or "") == part]
        rows, totals = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [n for n in left if failed[n][f]]
                left = [n for n in left if not failed[n][f]]
                totals[f] += len(gone)
                all_fails = sum(failed[n][f] for n in mine)
                alone = sum(failed[n][f] and sum(failed[n].values()) == 1 for n in mine)
                rows.append((part, "".join(order), step, len(left), len(gone), all_fails - len(gone), alone, sum(good[n] for n in gone), sum(toxic[n] for n in gone), f))
        out += [(*row[:-1], totals[row[-1]]) for row in rows]
    return sorted(out)


def random_text(draw):
    words = [draw.choice(["alpha", "Beta", "GAMMA", "d#", "e&f", "x", "ünder"]) if draw.random() < 0.1 else f"w{draw.randint(0, draw.choice([3, 400]))}" for _ in range(draw.choice([0, 5, 199, 200, 230]))]
    return "".join(word + draw.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for word in words)


def test_rows(spark):
    draw = random.Random(8)
    texts = [random_text(draw) for _ in range(60)]
    docs = [(n, draw.choice([*texts, None, "", " "]), draw.choice(["en", "de", "", None])) for n in draw.sample(range(1000), 120)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (2000, texts[0], "fr"), (2000, texts[0], "fr"), (2000, "other", None)]
    docs.append((3000, "Word " * 100_000 + "#", "long"))
    labels = [(n, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for n, _, _ in docs if n is not None and draw.random() < 0.6]
    labels += [(2000, 0, 1), (2000, 1, 0), (5555, 1, 1), (None, 1, 1)]
    rows = [(i, t, lang, "s", 1, 0.5, "x", 1, 2, "y") for i, t, lang in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, good string, failed long, first double, docs string, copy int, state int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sets = filter_audit.failed_sets(frame, marks)
    got = sorted(tuple(r) for r in filter_audit.audit(sets).collect())
    assert got == slow(docs, labels)
    # Every removed document is removed once in every order.
    for part in {row[0] for row in got}:
        mine = [row for row in got if row[0] == part]
        assert sum(row[4] for row in mine) == sum({row[1][row[2] - 1]: row[9] for row in mine}.values())


@pytest.mark.parametrize("filters", [1, 2, 3, 4, 5, 6])
def test_edges_count_orders(filters):
    used = filter_audit.edges(filters)
    assert len(used) == filters << (filters - 1)
    for state, one, orders in used:
        before = bin(state).count("1")
        assert orders == factorial(before) * factorial(filters - before - 1)
    assert all(sum(o for _, f, o in used if f == n) == factorial(filters) for n in range(filters))


def test_other_filters(spark):
    sets = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 4, 2, 0), ("q", 2, 1, 0, 0)], "part string, failed int, docs long, good long, toxic long")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(sets, "XY").collect()}
    assert len(found) == 8
    assert found["p", "XY", 1] == (5, 6, 0, 2, 3, 1, 8) and found["p", "XY", 2] == (5, 0, 4, 0, 0, 0, 4)
    assert found["p", "YX", 1] == (7, 4, 0, 0, 2, 0, 4) and found["p", "YX", 2] == (5, 2, 4, 2, 1, 1, 8)
    with pytest.raises(ValueError):
        filter_audit.audit(sets, "ABCDEFG")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failed_sets(table(spark, []), none)).count() == 0
    kept = filter_audit.audit(filter_audit.failed_sets(with_ids(spark, [(1, None)]), none)).collect()
    assert len(kept) == 600 and {r["removed"] for r in kept} == {0, 1}
