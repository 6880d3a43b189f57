"""Small tables with the awkward cases every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, bucket int, start int, spans string"


def table(spark, texts, langs=None):
    """Documents 0, 1, ...; the further columns clash with names that operators use inside."""
    langs = langs or [None] * len(texts)
    rows = [(n, t, lang, "s", len(t) if t is not None else None, 0.5, "x", 1, 2, "y") for n, (t, lang) in enumerate(zip(texts, langs))]
    return spark.createDataFrame(rows, SCHEMA)


def with_ids(spark, pairs):
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, "x", 1, 2, "y") for i, t in pairs], SCHEMA)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
