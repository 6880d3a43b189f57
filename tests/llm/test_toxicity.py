import random
import zlib

import numpy as np
import pytest

from helpers import table
from tunelake.llm import toxicity


def corpus(count, seed=1):
    """Toxic texts hold a listed word or, in half of them, one of a hidden family that only labels tell."""
    draw = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    texts, labels = [], []
    for _ in range(count):
        words = ["".join(draw.choice(syllables) for _ in range(draw.randint(2, 4))) for _ in range(draw.randint(20, 120))]
        toxic = draw.random() < 0.2
        if toxic:
            bad = draw.choice(["idiot", "worthless"]) if draw.random() < 0.5 else "qxul" + draw.choice(syllables)
            words[draw.randrange(len(words))] = bad
        texts.append(" ".join(words))
        labels.append(float(toxic))
    return texts, labels


def test_held_out_scores():
    texts, labels = corpus(1500)
    score = toxicity.fit(texts, labels).scorer()
    fresh, truth = corpus(600, 2)
    predicted = np.array([score(text) >= toxicity.THRESHOLD for text in fresh])
    truth = np.array(truth) == 1
    assert predicted[truth].mean() > 0.95 and predicted[~truth].mean() < 0.03


def test_label_model_sees_dependence_and_errors():
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.3
    good = np.where(truth, draw.random(4000) < 0.8, draw.random(4000) < 0.02)
    other = np.where(truth, draw.random(4000) < 0.6, draw.random(4000) < 0.1)
    votes = np.stack([good, good, other], axis=1).astype(float)
    labels = np.where(draw.random(4000) < 0.1, ~truth, truth).astype(float)
    found = toxicity.label_model(votes, labels)
    assert abs(found["toxic"][0] - 0.8) < 0.06 and abs(found["clean"][2] - 0.1) < 0.04
    assert abs(found["share"][0] - 0.5) < 0.05 and found["share"][2] == 1
    assert ((found["posterior"] > 0.5) == truth).mean() > ((labels > 0.5) == truth).mean()


def test_copies_count_once():
    text = " ".join(f"word{n}" for n in range(50))
    found = [toxicity.evidence(t) for t in (text, text, text + " more", "other words only here now")]
    assert toxicity.first_of_copies(found) == [0, 3]


def test_words_after_a_long_clean_start(spark):
    draw = random.Random(6)
    names = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnp"]
    clean = [" ".join(draw.choice(names) for _ in range(20_000)) for _ in range(40)]
    assert len(clean[0]) > 70_000
    table_of = spark.createDataFrame([(n, text + (" zargish" if n % 2 else " fine")) for n, text in enumerate(clean)], "doc_id long, text string")
    marks = spark.createDataFrame([(n, float(n % 2)) for n in range(40)], "doc_id long, toxic double")
    assert any("zarg" in feature for feature in toxicity.fit_table(table_of, marks).weights)


@pytest.mark.parametrize("texts", [120, 3000])
def test_one_rule_at_every_size(texts):
    draw = random.Random(texts)
    names = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnp"]
    sets = [{draw.choice(names) for _ in range(12)} | ({"zargish"} if n % 10 == 0 else set()) for n in range(texts)]
    weights = np.array([float(n % 10 == 0) for n in range(texts)])
    assert toxicity.mined(sets, weights, 100)[0] in ("=zargish", "^zar", "^zarg", "^zargi", "^zargis") and len(toxicity.mined(sets, weights, 100)) == 5
    assert toxicity.mined(sets, np.array([float(n % 7 == 3) for n in range(texts)]), 100) == []


def test_table(spark):
    texts, labels = corpus(400, 3)
    texts += [None, "", "idiot " + "word " * 100_000, "1234"]
    docs = table(spark, texts)
    marks = spark.createDataFrame([(n, 1, int(v)) for n, v in enumerate(labels)] + [(0, 1, None), (5, 0, int(labels[5])), (None, 1, 1), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_table(docs, marks)
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(found) == len(texts)
    for n, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(n).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.3)
    assert found[402]["predicted"] == 1 and found[400]["score"] == found[401]["score"] == found[403]["score"] < 0.3
    flipped = spark.createDataFrame([(n, 1, 1 - int(v)) for n, v in enumerate(labels) if zlib.crc32(str(n).encode()) % 4 == 2], "doc_id long, quality int, toxic int")
    rest = marks.filter("doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    assert toxicity.fit_table(docs, rest.unionByName(flipped)).weights == model.weights


def test_nothing_labelled(spark):
    docs = table(spark, ["you idiot", "hello"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, toxicity.fit_table(docs, none)).collect()}
    assert found == {0: 1, 1: 0}
    empty = table(spark, [])
    assert toxicity.score_documents(empty, toxicity.fit_table(empty, none)).count() == 0
