"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns of clashing names."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, queue string, fp bigint, h int"


def docs(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "x", "y", 1, 2) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "one two three four five"),
    (7, "One TWO three four five"),
    (8, "one two three four five"),
    (8, "one two three four five"),
    (None, "a row without a key"),
    (9, "word " * 30_000),
    (10, "ÄÖÜ ß éè 漢字 \U0001f600 <|endoftext|> don't 'st x²Ⅳ"),
    (11, "!!! 123 ... 456"),
    (12, "x" * 50_000),
]
