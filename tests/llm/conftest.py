from __future__ import annotations

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    return duckdb.execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text[, source]) rows, with columns whose names clash with inner ones."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, hash string, cls string, copies_ string"
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, schema)

    return build
