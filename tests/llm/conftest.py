import pytest

TEXTS = [
    "A first line that is long enough to count.\nShort.\nA second line that is long enough to count!",
    None,
    "",
    "a FIRST line that is long enough to count.\nshort.\na second line that is long enough to count!",
    "A first line that is long enough to count.\nAnother line, quite different from all the others.",
    "word " * 30_000,
    "Größe 梦 😀 <|im_end|> password = \"hX9kk22LqqA\"",
    "A first line that is long enough to count.\nShort.\nA second line that is long enough to count!",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, very long and repeated rows, a null id, and columns with names that operators use themselves."""
    clash = ["own", "row", "spans", "removed", "rk1", "__rk1", "__toxic", "severity", "share", "group", "id", "line", "fp0"]
    rows = [(i, t, "en", "s", len(t or ""), True, 1, "x", *clash) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no id here", "en", "s", 10, False, 2, "y", *clash), (None,) * (8 + len(clash))]
    names = ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, kept boolean, h1 long, name string, {names}")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
