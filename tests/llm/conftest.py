import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators add under the same names, to see that they are not confused.
CLASHES = ["score", "fp", "key", "ids", "spans", "root", "node", "id", "v"]


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang]) rows, with further columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])

    return make
