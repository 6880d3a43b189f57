import hashlib
import math
import random
import re

from helpers import table, with_ids
from tunelake.llm import disclosure

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        value = int(c) * (1 + n % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PATTERNS.items()}


TEXTS = [
    None,
    "",
    "ñ😀 mail a.b@c.de, x@y, z@w.x.y. and a@b.c+d@e.f end@ q@q.q@r.r",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3 10.0.0.0256 1..2.3.4.5",
    "card 4539 1488 0343 6467 and 4539-1488-0343-6467 4539148803436467 1234567890123 0 0000000000000",
    "+1 (377) 555-0271 +1 +49-30 123456789012345678 +33 1 23 45 67 89 x +1+1(2)34567890)",
    "4539148803436467@10.0.0.1 +4539148803436467",
    "a@b.c " * 700 + "1.1.1.1 " * 600,
    "x" * 2_000 + "@" + "1" * 1_000,
    "1 " * 60_000,
    "no data here",
]


def test_base_spans(spark):
    found = {r["doc_id"]: r for r in disclosure.report(disclosure.find(table(spark, TEXTS))).collect()}
    assert len(found) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        spans = brute(text)
        base = [f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k]]
        row = found[n]
        assert [row[f"n_{k}"] for k in PATTERNS] == [len(spans[k]) for k in PATTERNS], text and text[:60]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert row["spans"].split(",")[: len(base)] == (base or [""])[: len(base)]


def test_long_runs_take_linear_time(spark):
    # The plain patterns above would need minutes for these.
    texts = ["x" * 200_000 + "@" + "1" * 100_000, "x" * 200_000 + "@y.z", "1." * 100_000]
    found = {r["doc_id"]: r["spans"] for r in disclosure.report(disclosure.find(table(spark, texts))).collect()}
    assert found[0] == "" and found[1] == "email:0:200004"
    assert found[2].startswith("ip:0:7,ip:8:15,") and found[2].count("ip:") == 25_000


FILL = [f"common words go here and there number {'abcdefghij'[n]}{'klmnopqrst'[m]}" for n in range(10) for m in range(10)]
HIDDEN = [f"the {w} Zanzibarine writes to bob@corp.org {w} often" for w in ("quick", "slow", "calm", "there")]


def test_disclosing_terms(spark):
    texts = FILL + HIDDEN + ["only once: rarityword ann@corp.org", "Zanzibarine far away from all data"]
    found = disclosure.find(table(spark, texts))
    terms = {r["doc_id"]: {texts[r["doc_id"]][t["start"] : t["end"]].lower(): t["share"] for t in r["terms"]} for r in found.collect()}
    docs = len(texts)
    share = math.log(docs * 4 / (5 * 4)) / math.log(docs / 4)
    for n in range(len(FILL), len(FILL) + 4):
        assert abs(terms[n]["zanzibarine"] - share) < 1e-9 and "there" not in terms[n]
    # One document proves nothing; a document without an entity discloses what others prove.
    assert terms[docs - 2] == {} and set(terms[docs - 1]) == {"zanzibarine"} and all(not terms[n] for n in range(len(FILL)))


def brute_terms(texts):
    """Shares of all terms by counting whole documents."""
    rows = [(text or "", [(k, (text or "")[a:b].lower(), hash((text or "")[max(0, a - 64) : b + 64])) for k, s in brute(text).items() for a, b in s]) for text in texts]
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", text)} for text, _ in rows]
    inside = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", text))} for text, _ in rows]
    counts, shares = {}, {}
    for found in words:
        for word in found:
            counts[word] = counts.get(word, 0) + 1
    entities = {}
    for n, (_, spans) in enumerate(rows):
        for kind, value, place in spans:
            entities.setdefault((kind, value), {}).setdefault(n, set()).add(place)
    entities = {e: docs for e, docs in entities.items() if len(docs) >= 2 and len(set().union(*docs.values())) > 1}
    most = {e: len(docs) * (len(texts) / len(docs)) ** 0.2 + 1e-6 for e, docs in entities.items()}
    bound = {n: max((most[e] for e, docs in entities.items() if n in docs), default=0) for n in range(len(texts))}
    held = {e: {w for n in docs for w in inside[n] if 2 <= counts[w] <= bound[n]} for e, docs in entities.items()}
    tested = sum(map(len, held.values()))
    for e, docs in entities.items():
        for word in held[e]:
            both = [n for n in docs if word in inside[n] and counts[word] <= bound[n]]
            ways = 0 if counts[word] == len(both) else math.log(counts[word] / len(both)) + 1
            accidents = math.log(tested) + len(both) * (ways + math.log(len(docs) / len(texts)))
            if len(both) >= 2 and len(set().union(*(docs[n] for n in both))) > 1 and accidents <= math.log(0.01):
                share = math.log(len(texts) * len(both) / (counts[word] * len(docs))) / math.log(len(texts) / len(docs))
                if share >= disclosure.GENERALISE:
                    shares[word] = max(share, shares.get(word, 0))
    return shares


def test_terms_count_whole_documents(spark):
    draw = random.Random(5)
    words = [f"{a}{b}wort" for a in "bcdfghjk" for b in ("al", "en", "ir", "ou", "üm")]
    texts = []
    for n in range(300):
        body = [draw.choice(words[: draw.choice([5, 40])]) for _ in range(draw.choice([5, 60]))]
        if draw.random() < 0.4:
            entity, name = draw.choice([("ann@corp.org", "annword"), ("bob@corp.org", "Bobword bobword"), ("10.1.2.3", "serverword"), ("+49 30 1234567", "x"), ("Anna.Maria@corp.org", "maria")])
            body.insert(draw.randrange(len(body)), entity)
            body += [name] * (draw.random() < 0.9)
        texts.append(" ".join(body))
    # A name near one address twice and far from it once.
    texts += ["Farname writes to far@corp.org today", "now far@corp.org heard from Farname too", "Farname " + "filler " * 60 + "far@corp.org"]
    expected = brute_terms(texts)
    assert "farname" in expected and len(expected) > 1
    found = disclosure.find(table(spark, texts)).collect()
    for row in found:
        text = texts[row["doc_id"]]
        mine = {(m.start(), m.end()): expected[m.group().lower()] for m in re.finditer(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], lambda m: "@" * len(m.group()), text)) if m.group().lower() in expected}
        assert {(t["start"], t["end"]) for t in row["terms"]} == set(mine)
        assert all(abs(t["share"] - mine[t["start"], t["end"]]) < 1e-9 for t in row["terms"])


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, "mail a@b.cd now", "x", 1, "y", 2)], "doc_id long, text string, of string, mark int, spans string, __mark int")
    assert [tuple(r) for r in disclosure.sanitised(frame).collect()] == [(1, "mail [EMAIL] now", "x", 1, "y", 2)]


def test_copies_prove_nothing(spark):
    texts = FILL + ["the same Wordington writes to eve@corp.org"] * 6
    assert all(not r["terms"] for r in disclosure.find(table(spark, texts)).collect())


def test_sanitised_texts(spark):
    texts = FILL + HIDDEN + [None, "", "call +1 (377) 555-0271 or a@b.cd, 4539148803436467@10.0.0.1"]
    frame = table(spark, texts)
    clean = disclosure.sanitised(frame)
    assert clean.columns == frame.columns
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert len(out) == len(texts)
    assert all(out[n] == texts[n] for n in range(len(FILL))) and out[len(texts) - 3] is None and out[len(texts) - 2] == ""
    # The card number is part of an address that starts with it: one span, named after the kind that comes first.
    assert out[len(texts) - 1] == "call [PHONE] or [EMAIL], [EMAIL]"
    for n in range(len(FILL), len(FILL) + 4):
        assert "bob" not in out[n] and "Zanzibarine" not in out[n] and "[EMAIL]" in out[n]
    assert not any(any(spans.values()) for spans in (brute(t) for t in out.values()))


def test_repeated_rows_and_empty_table(spark):
    pairs = [(1, "mail a@b.cd now")] * 3 + [(None, "mail a@b.cd now"), (1, "other text")]
    assert disclosure.find(with_ids(spark, pairs)).count() == 5
    assert sorted(r["text"] for r in disclosure.sanitised(with_ids(spark, pairs)).collect()) == ["mail [EMAIL] now"] * 4 + ["other text"]
    assert disclosure.find(table(spark, [])).count() == 0 and disclosure.sanitised(table(spark, [])).count() == 0


def test_term_table_stands_in_no_plan_with_a_shuffle(spark, capsys):
    rows = spark.createDataFrame([(1, "some words here"), (2, "others")], "doc_id long, text string")
    found = disclosure._places_of(rows, spark.createDataFrame([("words", 0.9)], "term string, share double"))
    found.explain()
    assert len(capsys.readouterr().out) < 100_000
    assert [(r["doc_id"], [tuple(t) for t in r["terms"]]) for r in found.collect()] == [(1, [(5, 10, 0.9)])]
