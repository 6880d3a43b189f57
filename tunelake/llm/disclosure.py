"""Personal data: base patterns, and terms that disclose what the patterns found.

Protected entities are the e-mail addresses, network addresses, card numbers and phone numbers that fixed
patterns find. How much a term tells about an entity is estimated from co-occurrence in the corpus: with N
documents, pointwise mutual information log(N * n(t, e) / (n(t) * n(e))) as a share of the information
log(N / n(e)) that the entity itself carries. A share of 1 means that whoever reads the term can name the
entity. A term whose share of some entity reaches ``GENERALISE`` is generalised, from ``REMOVE`` on it is removed, wherever it stands in any
document. All counts are over whole documents; a pair counts as evidence only if it occurs in ``SUPPORT`` documents and the
entity has different neighbourhoods in them, so that copies of one passage prove nothing, and only if less than ``ACCIDENTS`` such pairs are to be
expected among all pairs that were looked at, so that rare words do not count for meeting a common entity.

A share of ``GENERALISE`` bounds n(t) by n(e) and N. Words above the bound of every entity of their document are left out before they meet the entities, so
common words cost one count each. Hot entities are salted where they meet their documents. Which documents hold a disclosing term is found with
a table of a fixed number of slots, which may let other words through; an exact join follows.

All work is done by DataFrame functions. A pattern's places come from the gaps and the matches that one
pattern gives when it splits and when it extracts; the patterns cannot backtrack over long runs.

Defined cases: a null text counts as empty; rows with one id and equal texts are one document for the counts
and get equal results; a null id is kept; texts without personal data and disclosing terms are never changed; an empty table
gives no rows; other columns are not read, and ``sanitised`` keeps them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelake.llm.common import bit_filter, free_names
from tunelake.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE, SUPPORT, ACCIDENTS = 0.8, 0.95, 2, 0.01
#: Characters on both sides of an entity that make its neighbourhood.
REACH = 64
#: Salts of an entity where it meets its documents, and slots (a power of two, a bit each) of the table of disclosing terms, of which a term takes two: 128 KB at any size.
SALTS, SLOT_BITS = 16, 20
# The patterns of the kinds. Possessive runs match what greedy ones do here, without going back; a match
# starts where the last one ended or where a run begins, since starts inside a run can give nothing else.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
_LEAST_LETTERS = 3
_STEP = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside lambdas an expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, value: total + value)


def places(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, value) of all matches: code points, end exclusive.

    Starts are running sums over gaps and matches, taken by blocks and blocks of blocks so that they stay cheap for many matches.
    """

    def before(values: Column, block: Column, n: Column) -> Column:
        return _sum(F.slice(values, block * _STEP + 1, n - block * _STEP))

    def place(hit: Column, n: Column, found: Column, lengths: Column, blocks: Column, wide: Column) -> Column:
        block = F.floor(n / _STEP).cast("int")
        above = F.floor(block / _STEP).cast("int")
        start = _sum(F.slice(wide, F.lit(1), above)) + before(blocks, above, block) + before(lengths, block, n) + F.length(F.get(found["gaps"], n))
        return _let(start, lambda at: F.struct(at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("value")))

    def summed(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(values) / _STEP).cast("int"))
        return F.transform(numbers, lambda k: _sum(F.slice(values, k * _STEP + 1, F.lit(_STEP))))

    def placed(found: Column, lengths: Column) -> Column:
        each = lambda blocks, wide: F.transform(found["hits"], lambda hit, n: place(hit, n, found, lengths, blocks, wide))
        return _let(summed(lengths), lambda blocks: _let(summed(blocks), lambda wide: each(blocks, wide)))

    def measured(found: Column) -> Column:
        lengths = F.transform(found["hits"], lambda hit, n: F.length(hit) + F.length(F.get(found["gaps"], n)))
        return _let(lengths, lambda values: placed(found, values))

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.struct(F.split(text, pattern, F.lit(-1)).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return _let(parts, measured)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, size - place, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(place % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Leading zeros do not count; a part of more than three digits is above 255.
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))
    if kind == "card":
        size = F.length(_digits(value))
        return F.when(size.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_PLACES = "array<struct<start:int,end:int,value:string>>"


def base_places(text: Column) -> dict[str, Column]:
    """Places of every kind; texts that cannot hold a kind are not searched for it."""

    def of(kind: str) -> Column:
        hits = F.filter(places(text, PATTERNS[kind]), lambda hit: _valid(kind, hit["value"]))
        return F.when(text.rlike(_NEEDS[kind]), hits).otherwise(F.array().cast(_PLACES))

    return {kind: of(kind) for kind in KINDS}


def _named(kind: str) -> Column:
    """Places of one kind with its name."""
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _rows(frame: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return frame.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))


def _level(text: Column) -> Column:
    """The text with the one letter replaced that is longer in lower case, so that places stay."""
    return F.replace(text, F.lit("\u0130"), F.lit("I"))


def _words(text: Column) -> Column:
    """Different terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(_level(text)), r"[^\p{L}]+")), lambda word: F.length(word) >= _LEAST_LETTERS)


def _found(rows: DataFrame) -> DataFrame:
    """Base places of every row, written once; of a row with entities also its entities, each with a hash of its neighbourhood, and its terms."""
    spans = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text", *[column.alias(kind) for kind, column in base_places(F.col("text")).items()])
    spans = spans.withColumn("spans", F.concat(*[_named(kind) for kind in KINDS]))
    low = lambda s: F.greatest(s["start"] - REACH, F.lit(0))
    around = F.transform(
        "spans",
        lambda s: F.struct(
            F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"),
            F.xxhash64(F.substring(F.col("text"), low(s) + 1, s["end"] + REACH - low(s))).alias("place"),
        ),
    )
    held = F.size("spans") > 0
    around = F.when(held, around).otherwise(F.array().cast("array<struct<entity:string,place:bigint>>"))
    words = F.when(held, _words(F.regexp_replace("text", PATTERNS["email"], " "))).otherwise(F.array().cast("array<string>"))
    kept = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return cut_lineage(spans.select("doc_id", "mark", kept.alias("spans"), around.alias("around"), words.alias("words")))


def _most(total: Column, of_entity: Column) -> Column:
    """No term in more documents reaches ``GENERALISE`` for an entity in so many: what the share comes to if every one of these holds the term."""
    return of_entity * F.pow(total / of_entity, F.lit(1 - GENERALISE)) + F.lit(1e-6)


def disclosing(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``entity``, ``term``, ``share``: pairs with enough evidence whose share reaches ``GENERALISE``."""
    total = F.lit(found.count()).cast("double")
    docs = found.filter(F.size("around") > 0).select("doc_id", "mark", "around", "words").dropDuplicates(["doc_id", "mark"])
    docs = cut_lineage(docs.withColumn("doc", F.xxhash64("doc_id", "mark", F.lit("document"))))
    each = docs.select("doc", F.explode("around").alias("e")).groupBy("doc", "e.entity").agg(F.min("e.place").alias("low"), F.max("e.place").alias("high"))
    each = cut_lineage(each)
    # Two different neighbourhoods suffice, which the least and the largest hash tell.
    entities = each.groupBy("entity").agg(F.count("*").alias("of_entity"), F.min("low").alias("low"), F.max("high").alias("high"))
    entities = cut_lineage(entities.filter((F.col("of_entity") >= SUPPORT) & (F.col("low") != F.col("high"))).select("entity", "of_entity"))
    salted = entities.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = each.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["entity", "salt"])
    most = F.max(_most(total, F.col("of_entity"))).alias("most")
    by_doc = cut_lineage(named.groupBy("doc").agg(F.collect_list(F.struct("entity", "low", "high")).alias("entities"), most))
    counts = rows.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("of_term")).filter(F.col("of_term") >= SUPPORT)
    terms = docs.select("doc", "words").join(by_doc.select("doc", "most"), "doc").select("doc", "most", F.explode("words").alias("term"))
    rare = terms.join(counts, "term").filter(F.col("of_term") <= F.col("most")).select("doc", "term", "of_term")
    met = rare.join(by_doc.select("doc", "entities"), "doc").select("term", "of_term", F.explode("entities").alias("e"))
    pairs = met.groupBy("e.entity", "term", "of_term").agg(F.count("*").alias("both"), F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    pairs = cut_lineage(pairs.join(entities, "entity"))
    tested = F.lit(max(1, pairs.count()))
    pairs = pairs.filter((F.col("both") >= SUPPORT) & (F.col("low") != F.col("high")))
    # The chance that so many of a term's documents hold the entity by accident, at most: the ways to choose them times the entity's share of all documents.
    ways = F.when(F.col("of_term") == F.col("both"), 0.0).otherwise(F.log(F.col("of_term") / F.col("both")) + 1)
    pairs = pairs.filter(F.log(tested) + F.col("both") * (ways + F.log(F.col("of_entity") / total)) <= math.log(ACCIDENTS))
    information = F.log(total / F.col("of_entity"))
    mutual = F.log(total * F.col("both") / (F.col("of_term") * F.col("of_entity")))
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    return cut_lineage(pairs.select("entity", "term", share.alias("share")).filter(F.col("share") >= GENERALISE))


def _places_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id``, ``mark``, ``terms``: all places of the terms in all documents, with their share."""
    # A term takes two bits of one byte; the table stands once in the plan, whose text repeats it.
    byte_of = lambda value: F.shiftrightunsigned(value, 64 - SLOT_BITS + 3)
    bits_of = lambda value: [value.bitwiseAND(F.lit(7)), F.shiftright(value, 3).bitwiseAND(F.lit(7))]
    value = F.xxhash64("term")
    slots = F.array(*[F.shiftleft(byte_of(value) * 8 + bit, 64 - SLOT_BITS) for bit in bits_of(value)])
    table = F.lit(bit_filter(terms.select(F.explode(slots).alias("slot")), "slot", SLOT_BITS))

    def known(word: Column) -> Column:
        """Whether both bits of a word are taken."""

        def taken(value: Column) -> Column:
            byte = F.conv(F.hex(F.substring(table, byte_of(value).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            first, second = bits_of(value)
            return _let(byte, lambda b: (F.getbit(b, first.cast("int")) == 1) & (F.getbit(b, second.cast("int")) == 1))

        return _let(F.xxhash64(word), taken)

    some = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text", F.filter(_words(F.col("text")), known).alias("some")).filter(F.size("some") > 0)
    # Only the words in question are looked for; addresses come first, so that no word is found inside one.
    words = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("some", "|"), F.lit(r")(?!\p{L})"))
    pattern = F.when(F.contains("text", F.lit("@")), F.concat(F.lit(f"(?:{PATTERNS['email']})|"), words)).otherwise(words)
    found = F.transform(places(_level(F.col("text")), pattern), lambda p: F.struct(F.lower(p["value"]).alias("term"), p["start"].alias("start"), p["end"].alias("end")))
    # Written without a shuffle: the plan that holds the table is told to listeners once, not anew for each stage of the join.
    hits = cut_lineage(some.select("doc_id", "mark", F.explode(found).alias("w")).select("doc_id", "mark", "w.*"))
    met = hits.join(terms, "term").groupBy("doc_id", "mark", "start", "end").agg(F.max("share").alias("share"))
    return met.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))


def find(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``mark`` (text hash), ``spans`` of the base kinds and ``terms`` with their share."""
    rows = _rows(frame, id_column, text_column)
    found = _found(rows)
    terms = cut_lineage(disclosing(rows, found).groupBy("term").agg(F.max("share").alias("share")))
    hits = _places_of(rows, terms).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "terms")
    hits = cut_lineage(hits)
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    joined = found.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left")
    return joined.select("doc_id", "mark", "spans", F.coalesce("terms", none).alias("terms"))


def report(found: DataFrame) -> DataFrame:
    """One row per document: counts per kind, digest of the base spans, all spans as text."""
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    show = lambda kind, spans: F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[show(kind, of(kind)) for kind in KINDS])
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, show("term", F.col("terms")))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitised(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``frame`` with entities and disclosing terms replaced in their texts; nothing else changes.

    Entities become ``[EMAIL]`` and so on, generalised terms ``[TERM]``, removed terms nothing. Overlapping
    spans are replaced as one, under the name of the first.
    """
    found = find(frame, id_column, text_column)
    entity = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    term = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= REMOVE, "").otherwise("[TERM]").alias("label")))
    changed = found.filter((F.size("spans") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "mark"])
    each = changed.select("doc_id", "mark", F.explode(F.concat(entity, term)).alias("s")).select("doc_id", "mark", "s.*")
    order = W.partitionBy("doc_id", "mark").orderBy("start", F.desc("end"), "label")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    group = F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))
    merged = each.withColumn("fresh", fresh).withColumn("group", group).groupBy("doc_id", "mark", "group")
    merged = merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("fresh") == 1, F.col("label"))).alias("label"))
    of, mark, spans = free_names(frame, "of", "mark", "spans")
    parts = merged.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias(spans))
    parts = cut_lineage(parts.select(F.col("doc_id").alias(of), F.col("mark").alias(mark), spans))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    same = F.col(id_column).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(mark))
    last = lambda n: F.when(n == 0, F.lit(0)).otherwise(F.get(spans, n - 1)["end"])
    pieces = F.transform(spans, lambda s, n: F.concat(F.substring(text, last(n) + 1, s["start"] - last(n)), s["label"]))
    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    new = F.when(F.col(spans).isNull(), F.col(text_column)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return frame.join(parts.hint("merge"), same, "left").withColumn(text_column, new).select(*frame.columns)
