import pytest
from tests_odd import ODD

#: Names that the operators use inside; a table may have columns of the same names.
CLASHING = ("id", "node", "component", "block", "pair", "f0", "score", "predicted", "copy", "pieces", "lang_pred", "_key",
            "_source", "share", "rate", "weight", "size", "tile", "leaf", "marks", "at", "window", "text_hash", "vector")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with many columns of clashing names, from (doc_id, text[, lang[, source]]) rows."""

    def make(rows, clashing=True):
        rows = [(*r, None, None)[:4] for r in rows]
        found = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
        if clashing:
            from pyspark.sql import functions as F

            found = found.select("*", *(F.lit("x").alias(c) for c in CLASHING))
        return found

    return make


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)
