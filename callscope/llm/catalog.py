"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from callscope.llm.common import ORACLES, QUERIES


def load():
    import corpus_pipeline
    from callscope.llm import attribution, extraction, jaccard, langid, neighbours, packing, periods, pieces, piecetable, pii, quality, repeats, windowsketch  # noqa: F401

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
    return QUERIES, ORACLES
