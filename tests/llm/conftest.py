from __future__ import annotations

import pytest


@pytest.fixture(scope="module")
def docs(spark):
    """Build a documents table from (doc_id, text[, source]) rows, with columns that clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", s[0] if s else "src", len(t or ""), "x", 1.5) for i, t, *s in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, id string, kept double"
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def real(sf_dir):
    """(doc_id, text) of the small documents table."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(table[c].to_pylist() for c in ("doc_id", "text"))))
