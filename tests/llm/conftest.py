"""Small hand-made tables for the operators of ``callscope.llm``."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts; ids count from 0 unless pairs (id, text) are given."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS)

    return make
