import random
import re

import pytest
from pyspark.sql import functions as F

from callscope.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(texts, width):
    out = []
    for text in texts:
        words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    return out


def brute(texts, width=4, num=85, den=100):
    """(set size, smallest index reachable) by comparing all pairs."""
    sets = sets_of(texts, width)
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, groups=12, most=40):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "One two", "one TWO", "one", "é É", "É É"]
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 5, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, most])):
            texts.append(edited(rng, base, rng.choice([0, 0, 1, 2, 3, 4, 6, 9])) if len(base) > 8 else " ".join(base))
    rng.shuffle(texts)
    return texts


def found(df, **kw):
    rows = jaccard.components(df, **kw).collect()
    return [(r.n_shingles, r.component_id) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed, kw", [(1, {}), (3, {"width": 5, "num": 80})])
def test_groups_equal_all_pairs(docs_of, seed, kw):
    texts = corpus(seed)
    assert found(docs_of(texts), **kw) == brute(texts, **kw)


def test_large_tables_are_joined_and_labelled_by_rounds(docs_of):
    texts = corpus(2)
    assert found(docs_of(texts), small=0) == brute(texts)


def test_a_large_group_on_the_border_of_the_threshold(docs_of):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(rng, base, rng.choice([1, 2, 3, 4, 5])) for _ in range(250)]
    assert found(docs_of(texts)) == brute(texts)


def test_empty_table_repeated_rows_and_clashing_columns(docs_of):
    assert jaccard.components(docs_of([])).count() == 0
    df = docs_of([(5, "a b c d e"), (5, "a b c d e"), (9, "A b c d e"), (None, None), (7, None)])
    df = df.withColumns({"id": F.lit(1), "n": F.lit(1), "k": F.lit(1), "h": F.lit(1)})
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df).collect()), key=str)
    assert rows == [(5, 2, 5), (5, 2, 5), (7, 0, 7), (9, 2, 5), (None, 0, None)]


def test_documents_of_the_small_data_set(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert [r.doc_id for r in docs] == list(range(len(docs)))
    assert found(jaccard.table(spark, sf, "documents")) == brute([r.text for r in docs])
