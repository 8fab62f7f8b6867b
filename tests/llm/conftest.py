import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Frame of (doc_id, text[, lang[, source]]) rows with the columns of ``documents``."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
                 len(r[1]) if r[1] else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, repeated rows."""
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (None, "a text without an id", "en", "a"),
            (None, None, None, None), (4, "x" * 200_000, "en", "a"), (5, "ab cd " * 30_000, "fr", "b"),
            (6, "same row", "en", "a"), (6, "same row", "en", "a"), (7, "\x00 nul \x00", "en", "a"),
            (8, "é ü 漢字 😀", "fr", "c"), (9, "\n\n\n", "en", "c")]


@pytest.fixture(scope="session")
def clashing(documents, odd_rows):
    """The odd rows with columns named like helper columns of the operators."""
    from pyspark.sql import functions as F
    names = ["id", "batch", "row", "size", "fp", "root", "bucket", "kind", "body", "n", "first", "_key",
             "_words", "start", "taken", "target", "_id", "_row", "lines", "hashes", "removed", "kept", "_in",
             "_found", "_keep", "_rows", "_hit", "_first", "_text_row", "n_words"]
    return documents(odd_rows).withColumns({c: F.lit("clash") for c in names})
