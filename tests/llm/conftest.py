import pytest

#: Columns whose names clash with those the operators use inside.
CLASHING = ["_h", "_n", "_name", "_text", "rid", "score", "size", "target", "taken", "kept", "cid", "rejected", "lang_pred", "_key", "blocks", "part"]


def documents(spark, rows, extra=True):
    """documents (doc_id, text, lang, source, n_chars) with further columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    df = spark.createDataFrame(rows, schema)
    if extra:
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows and one long text."""
    long = " ".join(f"word{i % 5000}" for i in range(40_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    return [(1, base, "en", "a"), (2, base.upper(), "en", "a"), (2, base.upper(), "en", "a"), (3, "", "en", "b"), (4, None, None, None),
            (5, " \t\n", "en", "b"), (None, "null id text", "en", None), (None, None, None, "b"), (6, "É é ẞ 漢字 🙂", "fr", "c"),
            (7, "é É ẞ 漢字 🙂", "fr", "c"), (8, long, "en", "a"), (9, long + " tail", "en", "a"), (10, "12345 !!! ---", "de", "b"), (11, "A.", "en", "c")]
