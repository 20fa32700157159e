from __future__ import annotations

import pytest

from retention_spark.llm.shared import workers_import_package


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source, lang), with columns that nobody
    asked for."""
    workers_import_package(spark)
    schema = "doc_id long, text string, source string, lang string, n_chars long, key string, " \
             "size string, score string, hash string, word string, text_key string, a string"

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else "en", 0,
                 "k", "z", "q", "h", "w", "t", "a") for r in rows]
        return spark.createDataFrame(full, schema)

    return make
