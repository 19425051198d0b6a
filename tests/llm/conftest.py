import pytest

DOC = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text), with columns whose names operators use inside."""
    def make(rows, clash=True):
        df = spark.createDataFrame([tuple(r) for r in rows], DOC).repartition(3)
        if not clash:
            return df
        extra = {"row": "1", "keep": "'x'", "n_lines": "null", "fp": "2", "root": "'r'", "spans": "'s'", "rest": "3", "p_toxic": "'p'",
                 "severity": "0.5", "rank": "1", "length": "7", "bucket": "'b'", "rule": "4", "kept": "'k'", "findings": "5", "blob_id": "6"}
        return df.selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])
    return make


# Null and empty texts, white space, ties, repeated rows and ids, a null id, a very long line and a very long word.
ODD = [
    (1, None), (2, ""), (3, " \t\n\n"), (4, "one"), (5, "Two words"), (6, "one"), (6, "one"), (7, "other text of a repeated id"), (7, "one more text of that id"),
    (None, "a row without an id"), (8, "long " * 20_000), (9, "x" * 60_000), (10, "línea únicá ñandú 漢字 😀 " * 30), (11, "\x00\x1c ok"),
]
