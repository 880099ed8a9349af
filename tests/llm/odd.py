"""Rows that operators must take: nulls, blanks, repeats, very long texts, and columns of clashing names."""

LONG = " ".join(f"word{i % 977} runs{i % 31}" for i in range(40_000))
TEXT = "the quick brown fox jumps over the lazy dog and then goes home to sleep for a while"
DOCS = [
    (1, TEXT, "en", 1),
    (2, TEXT, "en", 2),
    (2, TEXT, "en", 2),
    (3, None, None, None),
    (4, "", "en", 0),
    (5, " \n\t ", "en", 3),
    (6, LONG, "en", len(LONG)),
    (7, "one two", "de", 7),
    (8, TEXT.upper() + " again", "en", 9),
    (None, "no id at all, but words enough to count them", "fr", 5),
    (9, "ünï©ode 🙂 texts: ß and ﬁ", "de", 4),
]


def documents(spark, rows=DOCS):
    """doc_id and text with columns whose names the operators use inside."""
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return own.selectExpr("*", "'x' as score", "'y' as band", "'z' as class", "1 as place", "'k' as doc_key", "'h' as digest", "'w' as word")
