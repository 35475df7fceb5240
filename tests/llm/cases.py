"""Rows that operators must not stumble over."""

#: NULLs, empty and blank texts, ties, repeated rows, repeated ids, long texts,
#: characters of all lengths, special strings.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away into the deep dark woods today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away into the deep dark woods today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away into the deep dark woods today"),
    (2, "another text with the same id as before"),
    (3, None),
    (4, ""),
    (5, "   \t\n "),
    (None, "the quick  brown fox jumps over the lazy dog and runs far away into the deep dark woods today"),
    (None, None),
    (None, "a row whose id is NULL and whose text is its own"),
    (6, "Überraschung 中文 \U0001f600 é naïve space <|endoftext|> </s> ▁x ▁ y"),
    (7, "one"),
    (8, "ONE"),
    (9, "long " * 3000 + "tail"),
    (10, "long " * 3000 + "tail"),
    (11, "x" * 20000),
    (12, "a line\nanother line\na line\na line\n\n\nanother line\n"),
]


def frame(spark, rows, extra=True):
    """Documents with columns whose names operators use for their own results."""
    schema = "doc_id long, text string, source string, n_chars long"
    full = [(i, t, f"s{(i or 0) % 3}" if i != 5 else None, len(t or "")) for i, t in rows]
    if extra:
        names = "id size kept fp digest name row n_words before part key head length component_id ids n_tokens"
        schema += "".join(f", {n} string" for n in names.split())
        full = [(*r, *(None for _ in names.split())) for r in full]
    return spark.createDataFrame(full, schema)
