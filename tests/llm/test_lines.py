import re
from pathlib import Path

import duckdb
import pytest

from helpers import rows_of, table, with_ids
from tunelake.llm import lines

LONG = " ".join(f"w{n}" for n in range(60))


def brute(pairs, least=5):
    seen, out = {}, []
    found = []
    for doc_id, text in pairs:
        at = 0
        for part in (text.split("\n") if text else []):
            plain = " ".join(re.split(r"[ \t\r\f\x0b]+", part.lower())).strip()
            if plain and len(plain.split(" ")) >= least:
                found.append((doc_id is None, doc_id or 0, at, at + len(part), plain, doc_id))
            at += len(part) + 1
    for _, _, start, end, plain, doc_id in sorted(found, key=lambda f: f[:3]):
        if plain not in seen:
            seen[plain] = (doc_id, start)
        elif seen[plain] != (doc_id, start):
            out.append((doc_id, start, end, *seen[plain]))
    return sorted(out, key=repr)


PAIRS = [(5, f"head\n{LONG}\ntail"), (2, f"{LONG.upper()}  \nshort line\nshort line"), (9, None), (8, ""), (7, f"{LONG}\n{LONG}"), (3, "😀 a b c d e\n😀  a b c d e"), (3, "😀 a b c d e"), (None, LONG), (11, "x " * 50_000)]


def test_against_brute_force(spark):
    found = lines.repeats(with_ids(spark, PAIRS), "line", 5).select("doc_id", "start", "end", "kept_doc_id", "kept_start")
    assert rows_of(found) == brute(PAIRS)


def test_texts_without_repeats(spark):
    pairs = [p for p in PAIRS if p[0] not in (3, None)]
    frame = with_ids(spark, pairs)
    kept = lines.without_repeats(frame, "line", 5)
    assert kept.columns == frame.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[5] == "head\n\ntail" and texts[7] == "\n" and texts[9] is None and texts[8] == ""
    assert texts[2] == dict(pairs)[2] and texts[11] == dict(pairs)[11]


def test_passages_inside_lines(spark):
    passage = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen? Seventeen."
    texts = [f"first words of a line {passage} and more of it", f"another line. {passage}\nrest", "all of this is new text, none of it is anywhere else. Short one."]
    found = lines.repeats(table(spark, texts)).collect()
    cut = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]], r["kept_doc_id"]) for r in found}
    assert cut == {(1, "Nine ten eleven twelve thirteen fourteen fifteen sixteen?", 0)}


def covered(spark, texts):
    """Texts that stay, and the spans of every text that repeat."""
    found = lines.repeats(table(spark, texts), "passage").collect()
    places = {n: set() for n in range(len(texts))}
    for row in found:
        places[row["doc_id"]] |= set(range(row["start"], row["end"]))
    left = {r["doc_id"]: r["text"] for r in lines.without_repeats(table(spark, texts)).collect()}
    assert left == {n: "".join(c for at, c in enumerate(text) if at not in places[n]) for n, text in enumerate(texts)}
    return left


def test_passages_of_short_sentences(spark):
    short = "We went home. It was late. Nobody spoke. The lamp was out. Rain fell all night."
    lines_of = short.replace(". ", ".\n\n")
    left = covered(spark, [f"alone here.\n{short}\nother end", f"new start. {short}\nnew end", f"x y.\n{lines_of}\nz"])
    assert left[0] == f"alone here.\n{short}\nother end" and left[1] == "new start. \nnew end" and left[2] == "x y.\n\nz"
    # A short sentence after a long one goes with it; one whose neighbours differ stays.
    long = " ".join(f"word{n}" for n in range(9))
    left = covered(spark, [f"{long}. And yes.", f"Before. {long}. And yes. After.", "This differs here. And yes. That differs too."])
    assert left[1] == "Before.  After." and left[2] == "This differs here. And yes. That differs too."


def test_passages_without_spaces(spark):
    passage = "今日はとても良い天気です。私たちは公園へ行きました。"
    left = covered(spark, [f"最初の文。{passage}", f"別の文書。{passage}終わり。"])
    assert left[0].endswith(passage) and left[1] == "別の文書。終わり。"


def test_every_repeated_run_is_covered():
    import random

    draw = random.Random(5)
    for _ in range(300):
        run = [" ".join(f"r{draw.randrange(10**6)}" for _ in range(draw.randint(1, 9))) + "." for _ in range(draw.randint(1, 6))]
        if sum(len(s.split()) for s in run) < 8:
            continue
        alike = []
        for mark in "ab":
            text = f"{mark} head. " + " ".join(run) + f" {mark} tail. {mark} end of all this and more."
            at = text.index(run[0])
            found = list(lines.passage_units(text, lines.UNITS["passage"], 8))
            alike.append({d: set(range(s - at, e - at)) for s, e, d in found})
        same = set().union(*(alike[1][d] for d in alike[0].keys() & alike[1].keys()))
        assert {n for n, c in enumerate(" ".join(run)) if c != " "} <= same


def test_paragraphs(spark):
    text = f"a b c d e\nf g\n\n{LONG}\n \n{LONG}"
    found = lines.repeats(table(spark, [text]), unit="paragraph", min_words=5).collect()
    assert [(r["start"], r["kept_start"]) for r in found] == [(text.rindex("w0 "), text.index("w0 "))]


def test_empty_table(spark):
    assert lines.repeats(table(spark, [])).count() == 0
    assert lines.without_repeats(table(spark, [])).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_sql_gives_the_same_rows(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    for unit, text in (("sentence", lines.SENTENCES_SQL), ("passage", lines.REPEATS_SQL)):
        theirs = sorted(connection.execute(text).fetchall(), key=repr)
        assert rows_of(lines.repeats(spark.read.parquet(path), unit)) == theirs and theirs


def test_passages_in_sql_and_in_spark(spark):
    rows = [(1, "a b c. d e f! g h i? j\tk l.\tm n o.\n\np q  r. s t u. v w x"), (2, "Z. d e f! g h i? j k l. m n o. s t u. v w x"), (3, "短い文。もう一つの短い文です。次の文章もまた同じです。"), (4, "前。短い文。もう一つの短い文です。次の文章もまた同じです。"), (5, "averyverylongwordthatweighsalotbyitslengthaloneanditslettersgoonandonandonandon. x"), (6, "averyverylongwordthatweighsalotbyitslengthaloneanditslettersgoonandonandonandon. y"), (7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    connection = duckdb.connect()
    documents = frame.toPandas()
    connection.register("documents", documents)
    theirs = sorted(connection.execute(lines.REPEATS_SQL).fetchall(), key=repr)
    assert rows_of(lines.repeats(frame, "passage")) == theirs and {r[0] for r in theirs} == {2, 4, 6}
