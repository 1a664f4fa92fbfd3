"""The pipeline against plain Python versions of its stages."""

import corpus_pipeline
import regex
import test_jaccard
import test_packing
import test_quality
from test_packing import plain  # noqa: F401

from callscope.llm import pii, repeats
from callscope.llm.common import table


def passes(text):
    n, chars, symbols, dup_lines, repeated = test_quality.brute(text)
    words = test_quality.WORD.findall(text or "")
    lines = sum(1 for x in (text or "").split("\n") if test_quality.WORD.search(x))
    return not (
        n < 20 or 100 * repeated > 30 * n or 100 * symbols > 5 * chars or dup_lines >= 3 and 100 * dup_lines > 30 * lines
        or 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n
        or 100 * len(regex.findall(r"\p{Lu}", text)) > 60 * chars or 100 * len(regex.findall(r"\p{L}", text)) < 50 * chars
        or not 2 * n <= chars <= 15 * n)


def without_repeats(texts):
    """What stays of the texts, in the order of their ids."""
    first, out, size = {}, {}, repeats.WINDOW
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if first.setdefault(raw[p:p + size], (i, p)) != (i, p):
                gone[p:p + size] = b"\1" * size
        out[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_equal_their_plain_versions(spark, sf, tmp_path, plain):  # noqa: F811
    docs = table(spark, sf, "documents")
    expected = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            expected = {i: t for i, t in expected.items() if passes(t)}
        elif name == "near_duplicates":
            ids = sorted(expected)
            groups = test_jaccard.brute([expected[i] for i in ids], width=5, num=80)
            expected = {i: expected[i] for at, (i, (_, least)) in enumerate(zip(ids, groups)) if least == at}
        elif name == "repeated_passages":
            expected = without_repeats(expected)
        else:
            expected = {i: pii.replace_in(t, corpus_pipeline.PII_KEY, {})[0] for i, t in expected.items()}
        rows = docs.collect()
        assert {r.doc_id: r.text for r in rows} == expected and len(rows) == len(expected)
        assert all(r.n_chars == len(r.text) for r in rows)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    test_packing.check(rows, expected, 1024, plain)


def test_odd_rows_go_through_all_stages(docs_of, spark, sf, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    docs = docs_of([(1, words), (1, words), (2, words + " more"), (None, words + " other end"), (4, None), (5, ""), (6, "short")])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(docs.select("doc_id").distinct().collect(), key=str) == [(1,), (None,)]
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_registered(spark):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"] is corpus_pipeline.run
