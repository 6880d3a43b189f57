import random
import zlib

import numpy as np

from helpers import table
from tunelake.llm import language

WORDS = {
    "de": "der und nicht schön straße ich zwischen werden auch über".split(),
    "en": "the and with thing house which would there from about".split(),
    "fr": "le une être garçon où avec mais très dans cette".split(),
}


def corpus(count, seed=3):
    draw = random.Random(seed)
    rows = []
    for n in range(count):
        lang = draw.choice(sorted(WORDS))
        rows.append((" ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(5, 200))), lang))
    return rows


def network(seed=3):
    rows = corpus(300, seed)
    return language.train([t for t, _ in rows], [lang for _, lang in rows], steps=200)


def slow_chances(net, window):
    """The network without tables: embeddings times filters, place by place."""
    pooled = []
    for width, weights in net.filters.items():
        values = []
        for at in range(len(window) - width + 1):
            values.append(sum(net.embedding[window[at + k]] @ weights[k] for k in range(width)))
        pooled.append(np.max(values, axis=0))
    active = np.tanh(np.concatenate(pooled) + net.shift)
    score = np.exp(active @ net.output + net.bias)
    return score / score.sum()


def test_tables_give_the_convolution():
    net = network()
    rows = language.windows(language.to_bytes("Straße, the garçon " * 60))
    fast = language.window_chances(net, rows)
    for row, chance in zip(rows, fast):
        assert np.allclose(slow_chances(net, row), chance, atol=1e-4)


def test_windows_cover_whole_texts():
    codes = language.to_bytes("ab" * 1000)
    assert np.array_equal(language.windows(codes).ravel()[: len(codes)], codes)


def test_late_text_decides():
    net = network()
    text = " ".join(WORDS["en"]) + " " + " ".join(WORDS["de"] * 2000)
    best, score = language.predictions(net, [text])
    assert net.labels[best[0]] == "de" and score[0] > 0.9


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(400, 5)
    texts = [t for t, _ in rows] + [None, "", "1234 !!", "x", "😀"]
    langs = [lang for _, lang in rows] + ["de"] * 5
    docs = table(spark, texts, langs)
    found = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert len(found) == len(texts)
    out = [n for n in range(400) if zlib.crc32(str(n).encode()) % 3 == 1]
    assert all(found[n]["held_out"] == (zlib.crc32(str(n).encode()) % 3 == 1) for n in range(400))
    assert sum(found[n]["lang_pred"] == langs[n] for n in out) / len(out) > 0.97
    for n in (400, 401, 402, 404):
        assert (found[n]["lang_pred"], found[n]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_labels_of_the_held_out_fold_are_never_used(spark):
    rows = corpus(200, 6)
    wrong = [lang if zlib.crc32(str(n).encode()) % 3 != 1 else "xx" for n, (_, lang) in enumerate(rows)]
    one = language.fit(table(spark, [t for t, _ in rows], wrong))
    assert one.labels == ["de", "en", "fr"]


def test_no_or_one_label(spark):
    docs = table(spark, ["abc", "def"])
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()} == {"und"}
    docs = table(spark, ["abc"] * 9, ["en"] * 9)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, language.fit(docs)).collect()} == {("en", 1.0)}
    empty = table(spark, [])
    assert language.identify(empty, language.fit(empty)).count() == 0


def test_windows_from_the_whole_text(spark):
    long = "header " * 2_000 + "body " * 10_000
    rows = spark.createDataFrame([(n, long) for n in range(5)] + [(9, "short"), (10, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["w"] for r in rows.select("doc_id", language.drawn_windows(rows.text, rows.doc_id).alias("w")).collect()}
    assert found[9] == "short" and found[10] is None
    assert all(len(found[n]) == language.SAMPLE_CHARS + 7 and "body" in found[n] for n in range(5)) and len({found[n] for n in range(5)}) == 5
