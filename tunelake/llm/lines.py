"""Substring de-duplication by hashing lines or paragraphs.

A text is cut into units with their offsets in the original: paragraphs, lines, or (the default) lines that
are cut once more after each sentence, so that a passage pasted into the middle of a line is met too. Units are normalised (lower case, runs of
white space as one space, none at the ends), and their digests are grouped over all documents. The
occurrence with the smallest (doc_id, start) stays; every later one is removed from its text. Removals
are reported with offsets in the original, in code points, end exclusive.

The unit ``passage`` takes runs of adjacent sentences and lines instead of single ones: from every sentence on, and
back from every sentence, the shortest run that weighs ``min_words`` words. Whatever run of whole sentences
occurs again and weighs that much is covered by such runs, however short its sentences are. What is removed has a copy
at an earlier place, and the earliest copy of any text is never removed. Spans of one text may overlap.

Defined cases: a null text has no units and stays null; units below ``min_words`` words (empty ones too)
always stay, as do runs between differing sentences that weigh less; rows with one id are one document, whose equal units are ranked by start and whose fully
equal ones at one start all stay if they are the earliest; a null id ranks after all others; an empty
table gives no rows; other columns are not read, and ``without_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import documents, free_names
from tunelake.session import cut_lineage

#: Separators of units; a paragraph ends at an empty line. Passages are runs of what theirs cuts.
UNITS = {"sentence": r"\n|(?<=[.!?]) ", "line": r"\n", "paragraph": r"\n[ \t\r]*\n", "passage": r"\n|(?<=[.!?])[ \t]|(?<=[。！？])"}
UNIT, MIN_WORDS = "sentence", 8
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Letters of scripts that put no spaces between words: two weigh as much as a word. Elsewhere eight characters do.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_DENSE_WORD, _LONG_WORD = 2, 8


def text_units(text: str | None, separator: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and digest of every unit that is long enough to count."""
    if not text:
        return
    start = 0
    ends = [(m.start(), m.end()) for m in re.finditer(separator, text)] + [(len(text), len(text))]
    for end, after in ends:
        plain = _SPACE.sub(" ", text[start:end].lower()).strip(" ")
        if plain and plain.count(" ") + 1 >= min_words:
            yield start, end, hashlib.sha256(plain.encode()).digest()[:16]
        start = after


def _weight(plain: str) -> int:
    """Words of a unit, or what its length comes to where words are not parted by spaces."""
    dense = 0 if plain.isascii() else len(_DENSE.findall(plain))
    return max(plain.count(" ") + 1, dense // _DENSE_WORD, len(plain) // _LONG_WORD)


def passage_units(text: str | None, separator: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and digest of the shortest runs of ``min_words`` from every sentence on, and back from it."""
    if not text:
        return
    parts, start = [], 0
    ends = [(m.start(), m.end()) for m in re.finditer(separator, text)] + [(len(text), len(text))]
    for end, after in ends:
        plain = _SPACE.sub(" ", text[start:end].lower()).strip(" ")
        if plain:
            parts.append((start, end, plain, _weight(plain)))
        start = after
    runs, first, total = {}, 0, 0
    for last, part in enumerate(parts):
        total += part[3]
        # All that start at ``first`` and reach the weight only here run on to ``last``; the last of them is the run back from it.
        while total >= min_words:
            runs[first, last] = None
            total -= parts[first][3]
            first += 1
        if first and (first - 1, last) not in runs:
            runs[first - 1, last] = None
    for first, last in runs:
        plain = " ".join(part[2] for part in parts[first : last + 1])
        yield parts[first][0], parts[last][1], hashlib.sha256(plain.encode()).digest()[:16]


def units(frame: DataFrame, unit: str = UNIT, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``digest``: one row per unit, without its text."""
    separator, units_of = UNITS[unit], passage_units if unit == "passage" else text_units

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # A slice of rows at a time keeps what is built small, however many units a text has.
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                rows = [
                    (None if pd.isna(doc_id) else int(doc_id), *found)
                    for doc_id, text in zip(part["doc_id"], part["text"])
                    for found in units_of(text, separator, min_words)
                ]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "digest"])
                yield out.astype({"doc_id": "Int64", "start": "int64", "end": "int64"})

    return documents(frame, id_column, text_column).mapInPandas(cut, "doc_id long, start long, end long, digest binary")


def repeats(frame: DataFrame, unit: str = UNIT, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per unit to remove: its place, and the place of the occurrence that stays.

    A unit that is everywhere costs one partial minimum per task; the join that follows has one row per
    digest on one side, and its large partitions can be split.
    """
    found = cut_lineage(units(frame, unit, min_words, id_column, text_column))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    firsts = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies"))
    firsts = cut_lineage(
        firsts.filter("copies > 1").select("digest", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
    )
    later = ~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start")))
    return found.join(firsts, "digest").filter(later).select("doc_id", "start", "end", F.lower(F.hex("digest")).alias("digest"), "kept_doc_id", "kept_start")


def without_repeats(frame: DataFrame, unit: str = "passage", min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``frame`` with all repeated units cut out of their texts; nothing else changes."""
    spans = repeats(frame, unit, min_words, id_column, text_column).groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")
    )
    of, cuts = free_names(frame, "of", "cuts")
    spans = cut_lineage(spans.select(F.col("doc_id").alias(of), F.col("spans").alias(cuts)))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for text, parts in zip(texts, removed):
            if text is not None and parts is not None:
                kept, at = [], 0
                for part in sorted(parts, key=lambda p: p["start"]):
                    kept.append(text[at : part["start"]])
                    at = max(at, part["end"])
                text = "".join([*kept, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = frame.join(spans, F.col(id_column).cast("long") == F.col(of), "left")
    changed = joined.withColumn(text_column, F.when(F.col(cuts).isNull(), F.col(text_column)).otherwise(cut(F.col(text_column), F.col(cuts))))
    return changed.select(*frame.columns)


#: The rows of single sentences in SQL. A space after a sentence becomes a line end, which moves no offset; offsets come
#: from running lengths.
SENTENCES_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) AS n FROM cut
), placed AS (
  SELECT doc_id, unit,
         CAST(coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM numbered
), plain AS (
  SELECT doc_id, start, start + length(unit) AS "end",
         trim(regexp_replace(lower(unit), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS body
  FROM placed
), hashed AS (
  SELECT doc_id, start, "end", substr(sha256(body), 1, 32) AS digest
  FROM plain WHERE body <> '' AND length(body) - length(replace(body, ' ', '')) + 1 >= 8
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
  FROM hashed WINDOW w AS (PARTITION BY digest ORDER BY doc_id NULLS LAST, start)
)
SELECT doc_id, start, "end", digest, kept_doc_id, kept_start FROM ranked
WHERE NOT (doc_id IS NOT DISTINCT FROM kept_doc_id AND start = kept_start)
"""


#: The rows of passages in SQL. Blanks after sentences become line ends; a sign that ends a sentence without one gets a mark,
#: which has no length of its own. A run has at most eight sentences, as each weighs a word at least.
REPEATS_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t]', '\1' || chr(10), 'g'), '([。！？])', '\1' || chr(1) || chr(10), 'g'), chr(10)) AS parts
  FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS n FROM cut
), measured AS (
  SELECT doc_id, n, rtrim(raw, chr(1)) AS unit, CASE WHEN raw LIKE '%' || chr(1) THEN 0 ELSE 1 END AS gap FROM numbered
), placed AS (
  SELECT doc_id, unit, n,
         CAST(coalesce(sum(length(unit) + gap) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM measured
), plain AS (
  SELECT doc_id, n, start, start + length(unit) AS "end", trim(regexp_replace(lower(unit), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS body FROM placed
), weighed AS (
  SELECT doc_id, start, "end", body, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i,
         greatest(length(body) - length(replace(body, ' ', '')) + 1,
                  length(regexp_replace(body, '[^\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{3ffff}]', '', 'g')) // 2,
                  length(body) // 8) AS weight
  FROM plain WHERE body <> ''
), summed AS (
  SELECT *, sum(weight) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM weighed
), runs AS (
  SELECT a.doc_id, a.i AS first, b.i AS last, a.start, b."end" FROM summed a JOIN summed b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 7
   WHERE b.upto - a.upto + a.weight >= 8
), shortest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, first ORDER BY last) = 1
  UNION SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, last ORDER BY first DESC) = 1
), hashed AS (
  SELECT s.doc_id, s.start, s."end", substr(sha256(string_agg(w.body, ' ' ORDER BY w.i)), 1, 32) AS digest
    FROM shortest s JOIN weighed w ON w.doc_id = s.doc_id AND w.i BETWEEN s.first AND s.last GROUP BY s.doc_id, s.first, s.last, s.start, s."end"
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
  FROM hashed WINDOW w AS (PARTITION BY digest ORDER BY doc_id NULLS LAST, start)
)
SELECT doc_id, start, "end", digest, kept_doc_id, kept_start FROM ranked
WHERE NOT (doc_id IS NOT DISTINCT FROM kept_doc_id AND start = kept_start)
"""
