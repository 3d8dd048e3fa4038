import random

import pytest

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts, or of rows of (doc_id, text[, lang, source])."""

    def build(rows, extra=False):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            full.append((*row, *(None, None)[len(row) - 2 :])[:4] if len(row) < 4 else row)
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use themselves
            for name in ("_row", "size", "kind", "n", "copies", "bucket", "k", "payload", "spans", "text_hash"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """Makes reproducible prose of a number of words."""
    words = [a + b for a in ("an", "ber", "co", "de", "el", "fa") for b in ("ra", "to", "mi", "né", "sch", "")]

    def write(count, seed=0):
        chosen = random.Random(seed)
        return " ".join(chosen.choice(words) for _ in range(count))

    return write


@pytest.fixture(scope="session")
def hard_texts(prose):
    """Nulls, empty and blank texts, one word, copies, near copies, a very long text, odd characters."""
    long, near = prose(120, 1), prose(120, 1).replace("fané", "other", 1)
    return [
        None, "", " \t\n", "one", "one", "a b c d", "a b c d", long, long, near, prose(5000, 2),
        "Ab  x  y\r\nz   w", "日本語 テキスト 😀 😀", "x" * 20_000, long + "\n" + long, "ha " * 300,
    ]
