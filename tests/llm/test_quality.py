import random
import re

import pytest
from oracle import compare, oracle_connection
from pyspark.sql import functions as F

from callscope.llm import quality
from callscope.llm.catalog import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(3)
    some = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    return some + [None, "", " \n\t", "x", "é　ü \x0b ß", "a\n\na\n a\nb", "# a | b && <c>", "a b c d e f g h " * 30,
                   " ".join(map(str, range(3000))) + " " + " ".join(map(str, range(2500)))]


def test_measures_equal_a_plain_count(docs_of):
    all_texts = texts()
    rows = quality.measures(docs_of(all_texts)).orderBy("doc_id").collect()
    found = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]
    assert found == [brute(t) for t in all_texts]


def test_the_order_of_the_rules_keeps_the_verdict(docs_of):
    df = docs_of(texts())
    rules = [*quality.BASE, *quality.MORE]
    kept = [{r.doc_id for r in quality.cascade(df, order).where("rejected_by is null").collect()} for order in (rules, rules[::-1])]
    assert kept[0] == kept[1]


def test_rules_are_ordered_by_rejections_per_second(docs_of):
    df = docs_of(["one two three"] * 50 + [" ".join("word" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(40))])
    found = quality.estimate(df, [*quality.BASE, *quality.MORE])
    assert [e.gain for e in found] == sorted((e.gain for e in found), reverse=True)
    assert found[0].rejected > 0.9
    assert {e.rule.name for e in found} == {r.name for r in (*quality.BASE, *quality.MORE)}


def test_empty_table_and_clashing_columns(docs_of):
    empty = docs_of([])
    assert [e.rejected for e in quality.estimate(empty, quality.BASE)] == [0.0, 0.0]
    assert quality.cascade(quality.measures(empty), quality.BASE).count() == 0
    odd = docs_of(["a b", None]).withColumn("n", F.lit(1)).withColumn("at", F.lit(2)).withColumn("h", F.lit(3))
    assert {r.rejected_by for r in quality.cascade(odd, quality.BASE).collect()} == {"too_short"}


def test_no_python_in_the_plan(docs_of):
    plan = quality.cascade(quality.measures(docs_of(["a"])), [*quality.BASE, *quality.MORE])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op3_quality_cascade"])
def test_query_agrees_with_sql(spark, sf, name):
    queries, oracles = load()
    assert compare(spark, oracle_connection(sf), sf, queries[name], oracles[name]) == []


def test_long_texts_may_be_filtered_by_the_verdict(docs_of):
    # a filter must not split the text once per window
    import time

    df = docs_of([" ".join("".join("abcdefghij"[int(c)] for c in str(i)) for i in range(n)) for n in (20_000, 40_000)])
    start = time.perf_counter()
    assert quality.cascade(df, [*quality.BASE, *quality.MORE]).where("rejected_by is null").count() == 2
    assert quality.measures(df).where("n_repeat_words = 0").count() == 2
    assert time.perf_counter() - start < 30


def test_a_column_of_the_working_name_stays(docs_of):
    df = docs_of(["a b c", None]).withColumns({"_words": F.lit("kept"), "_Words_": F.lit("too")})
    rows = sorted(quality.measures(df).collect(), key=lambda r: r.doc_id)
    assert [(r["_words"], r["_Words_"], r.n_words) for r in rows] == [("kept", "too", 3), ("kept", "too", 0)]
