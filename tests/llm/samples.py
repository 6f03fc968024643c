"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, digest string, row int, fp long, node int, n_tokens int, shard string, `count` int"


def docs(spark, rows):
    """A table of (doc_id, text) with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "d", 1, 2, 3, 4, "s", 5) for i, t in rows], SCHEMA)


AWKWARD = [
    (1, "One small  text here"),
    (2, None),
    (3, ""),
    (4, "One small\ttext here"),
    (4, "One small\ttext here"),
    (None, "without an id"),
    (None, None),
    (9, "word " * 30_000),
    (10, "x" * 20_000),
    (11, "   \n\n tabs\t\tand  spaces \n"),
    (12, "späte Größe, ñandú; 12.5 % don't <|endoftext|> we'll"),
    (13, "漢字とかな и кириллица   \x1c \x85 end 😀"),
    (5, "One small text here"),
]
