import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) tuples, with clashing further columns."""
    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        table = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("size", "score", "label", "words", "fp", "group", "held_out", "predicted", "hash", "target"):
                table = table.selectExpr("*", f"'x' AS {name}")
        return table
    return build
