"""Audit of how filters interact, whatever order they are applied in.

A document is reduced to the set of filters that it fails. The sets of filters already applied are the states of a lattice: an
edge leads from a state to the one with one filter more, and what it removes is the difference of what the two states keep.
An order of the filters is a path through the lattice. Counting paths forward from the empty state and backward
from the full one gives the number of orders that use an edge, so the sum of a filter's removals over all orders
(its Shapley value times their number) comes from ``m * 2 ** (m - 1)`` edges, not from ``m!`` orders; the steps of single orders
are read from the same edges. Counts of fails and of fails of one filter alone are the edges out of the empty and into the full state.

All of it is aggregation: the texts are read once, one narrow row per document is shuffled for the labels and one for the
copies, and at most ``2 ** (m + 2)`` sums per part remain.

Defined cases: a null text is empty, so it is a copy of other empty texts; a null part is the empty string; a row without an
id is no copy of any and no text is a copy of it; rows with one id and one text are no copies of each other; each row counts; a
document is good (toxic) if any of its label rows says so, and neither without a label; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelake.session import cut_lineage

#: Bounds of the filters of ``text_failures``.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
#: Filters of one audit; their orders are listed one by one.
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions on a whole text that is not null: few words, repeated words, upper case, markup signs."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    words = F.filter(F.split(spaced, " "), lambda word: word != "")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def of_words(condition) -> Column:
        # The words are cut once for both conditions on them.
        return F.get(F.transform(F.array(words), condition), F.lit(0))

    both = of_words(lambda w: F.struct((F.size(w) < LEAST_WORDS).alias("few"), (100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w)).alias("same")))
    return {
        "A": both["few"],
        "B": both["same"],
        "C": 100 * upper > MOST_UPPER * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def edges(filters: int) -> list[tuple[int, int, int]]:
    """``(state, filter, orders)`` of every edge: how many orders use it, paths to it times paths from it."""
    states = range(1 << filters)
    reaching, leaving = [0] * len(states), [0] * len(states)
    reaching[0] = leaving[-1] = 1
    for state in states:
        for one in range(filters):
            if state >> one & 1:
                reaching[state] += reaching[state ^ 1 << one]
    for state in reversed(states):
        for one in range(filters):
            if not state >> one & 1:
                leaving[state] += leaving[state | 1 << one]
    return [(s, f, reaching[s] * leaving[s | 1 << f]) for s in states for f in range(filters) if not s >> f & 1]


def _steps(names: str) -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, state, filter)`` of all orders."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, one in enumerate(order, 1):
            out.append(("".join(names[n] for n in order), step, state, one))
            state |= 1 << one
    return out


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id``, ``digest`` and others) with ``copy``: whether a smaller id has the same text.

    The first of every text is found by a partial minimum. It meets its row by text and id, so that no text
    brings all its copies to one task.
    """
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).filter(F.col("first").isNotNull())
    firsts = cut_lineage(firsts.select(F.col("digest").alias("of"), "first"))
    joined = rows.join(firsts, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    return joined.withColumn("copy", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("of", "first")


def failed_sets(
    frame: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """``part``, ``failed`` (bits of the filters A to E), ``docs``, ``good``, ``toxic``: documents by what they fail."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    bits = [F.when(failure, 1 << n).otherwise(0) for n, failure in enumerate(text_failures(F.col("text")).values())]
    part = F.coalesce(F.col(part_column).cast("string"), F.lit(""))
    texts = frame.select(F.col(id_column).cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    rows = cut_lineage(texts.select("doc_id", "part", sum(bits[1:], bits[0]).alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = copies(rows).join(marks, F.col("doc_id") == F.col("labelled"), "left")
    failed = F.col("failed") + F.when(F.col("copy"), 1 << len(bits)).otherwise(0)
    counts = marked.groupBy("part", failed.alias("failed")).agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return cut_lineage(counts.na.fill(0))


def audit(sets: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from the sums of ``failed_sets``; ``names`` has one letter per filter."""
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    spark, filters = sets.sparkSession, len(names)
    states = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))).alias("state"))
    keeps = F.col("failed").bitwiseAND(F.col("state")) == 0
    sums = {name: F.sum(F.when(keeps, F.col(name)).otherwise(0)).alias(name) for name in ("docs", "good", "toxic")}
    kept = states.groupBy("part", "state").agg(*sums.values())
    # A state is the start of the edges of filters it lacks, and the end of the edges of those it has.
    ends = [
        F.struct(F.lit(n).alias("filter"), F.when(has, F.col("state").bitwiseXOR(F.lit(1 << n))).otherwise(F.col("state")).alias("start"), F.when(has, -1).otherwise(1).alias("sign"))
        for n, has in ((n, F.col("state").bitwiseAND(F.lit(1 << n)) != 0) for n in range(filters))
    ]
    ended = kept.select("part", "docs", "good", "toxic", F.explode(F.array(*ends)).alias("e")).select("part", "docs", "good", "toxic", "e.*")
    lost = {f"{name}_lost": F.sum(F.col(name) * F.col("sign")).alias(f"{name}_lost") for name in ("docs", "good", "toxic")}
    removals = ended.groupBy("part", "start", "filter").agg(*lost.values(), F.sum(F.when(F.col("sign") < 0, F.col("docs"))).alias("kept"))
    used = spark.createDataFrame(edges(filters), "start int, filter int, orders long")
    weighed = removals.join(F.broadcast(used), ["start", "filter"])
    of_filter = W.partitionBy("part", "filter")
    # The last edge of a filter: all others have been applied.
    alone = F.col("start") == F.lit((1 << filters) - 1) - F.pow(F.lit(2), F.col("filter")).cast("int")
    weighed = weighed.select(
        "*",
        F.sum(F.col("docs_lost") * F.col("orders")).over(of_filter).alias("shapley"),
        F.max(F.when(F.col("start") == 0, F.col("docs_lost"))).over(of_filter).alias("fails"),
        F.max(F.when(alone, F.col("docs_lost"))).over(of_filter).alias("unique_fails"),
    )
    steps = spark.createDataFrame(_steps(names), "filter_order string, step int, start int, filter int")
    return weighed.join(F.broadcast(steps), ["start", "filter"]).select(
        "part",
        "filter_order",
        "step",
        "kept",
        F.col("docs_lost").alias("removed"),
        (F.col("fails") - F.col("docs_lost")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )


#: The same rows in SQL, with every order walked through.
SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         min(doc_id) OVER (PARTITION BY text) AS first
  FROM texts
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS failed
  FROM worded LEFT JOIN marks USING (doc_id)
), sets AS (
  SELECT part, failed, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
         list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS before,
         1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit
  FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders)
), walked AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN failed & coalesce(before, 0)::BIGINT = 0 AND failed & bit = 0 THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN failed & coalesce(before, 0)::BIGINT = 0 AND failed & bit <> 0 THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN failed & coalesce(before, 0)::BIGINT <> 0 AND failed & bit <> 0 THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = bit THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed & coalesce(before, 0)::BIGINT = 0 AND failed & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed & coalesce(before, 0)::BIGINT = 0 AND failed & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM walked
"""
