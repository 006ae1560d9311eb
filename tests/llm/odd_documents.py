"""Documents with nulls, empty and long texts, ties, repeats and clashing column names."""

LONG = "alpha beta gamma delta " * 20_000
ODD = [
    (1, "one two three four five", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "en", "b"),
    (5, "word", "en", None), (6, "one two three four five", "en", "a"), (6, "one two three four five", "en", "a"),
    (None, "a text without an id", "en", "a"), (None, None, None, None), (None, "another one without an id", "en", "c"),
    (7, LONG, "en", "a"), (8, "ünïcödé 𝒳 текст 汉字 " * 30, "xx", "b"), (6, "the same id, another text", "en", "b"),
]
#: Columns named like those that the operators add or use inside.
CLASHES = ["score", "digest", "fp", "spans", "size", "copies", "rate", "mixed", "row", "body", "key", "doc", "tie"]


def odd_rows(spark, rows=ODD):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    full = [(*r, None if r[1] is None else len(r[1]), *[f"{c}-{r[0]}" for c in CLASHES]) for r in rows]
    return spark.createDataFrame(
        full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
