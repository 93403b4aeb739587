import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use themselves
            for name in ("key", "fp", "size", "part", "score", "hits", "_key", "d", "v", "k", "h", "u"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
