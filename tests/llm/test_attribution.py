import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import attribution, tokens


def brute(text, spans, rule):
    """Byte by byte: which token and which section each belongs to."""
    encode = tokens.encoder()
    sizes = [len(c.encode()) for c in text]
    begin_of = np.cumsum([0, *sizes])
    owner = [-1] * int(begin_of[-1])
    for k, (a, b) in enumerate(spans):
        for p in range(begin_of[a], begin_of[b]):
            owner[p] = k
    counts = [0.0] * (len(spans) + 1)  # the last: outside
    at = 0
    ids = encode.ids(text)
    for end in encode.byte_ends(text, ids).tolist():
        inside = owner[at:end]
        if rule == "start":
            counts[inside[0]] += 1
        elif rule == "split":
            for k in inside:
                counts[k] += 1 / len(inside)
        else:
            named = sorted(set(inside) - {-1})
            best = max(named, key=inside.count) if named else -1
            counts[-1 if inside.count(-1) > (inside.count(best) if best >= 0 else 0) else best] += 1
        at = end
    return counts, len(ids)


# Sections of five characters, every third left out, the last one empty. (Workers cannot import this module; a lambda goes by value.)
gaps = lambda text: [(i, min(i + 5, len(text))) for i in range(0, len(text), 5) if i % 3] + ([(len(text), len(text))] if text else [])


@pytest.mark.parametrize("rule", attribution.RULES)
@pytest.mark.parametrize("sections", [attribution.lines, gaps])
def test_counts_equal_a_byte_by_byte_count(docs_of, rule, sections):
    rng = random.Random(1)
    texts = [None, "", "\n", "a\n\nb", "x" * 30] + ["".join(rng.choice(["word", " the", "\n", "é", "語", "  ", ".", "👩‍👧", "ing"]) for _ in range(60)) for _ in range(25)]
    df = docs_of(texts).withColumns({"section": F.lit(1), "begin": F.lit(1), "n_tokens": F.lit(1)})
    got = {}
    for r in attribution.token_counts(df, sections=sections, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    for i, text in enumerate(texts):
        text = text or ""
        spans = sections(text)
        counts, total = brute(text, spans, rule)
        rows = got[i]
        assert all(rows[k].n_tokens == pytest.approx(counts[k]) and (rows[k].begin, rows[k].end) == s for k, s in enumerate(spans))
        assert sum(r.n_tokens for r in rows.values()) == pytest.approx(total) and {r.doc_tokens for r in rows.values()} == {total}
        assert -1 not in rows or rows[-1].n_tokens == pytest.approx(counts[-1])


def test_lines_cover_the_text():
    for text in ("", "a", "a\n", "\n\n", "a\nb"):
        assert "".join(text[a:b] for a, b in attribution.lines(text)) == text


def test_bad_sections_and_rules_are_refused(docs_of):
    with pytest.raises(ValueError):
        attribution.token_counts(docs_of(["a"]), rule="none")
    with pytest.raises(Exception, match="without overlaps"):
        attribution.token_counts(docs_of(["abcd"]), sections=lambda t: [(0, 3), (2, 4)]).collect()
    assert attribution.token_counts(docs_of([])).count() == 0


def test_documents_of_the_small_data_set(spark, sf):
    texts = {r.doc_id: r.text for r in attribution.table(spark, sf, "documents").collect()}
    rows = {}
    for r in attribution.op1_token_attribution(spark, sf).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        found = sorted(rows[i], key=lambda r: r.section)
        counts, total = brute(text or "", attribution.lines(text or ""), "majority")
        assert [r.n_tokens for r in found if r.section >= 0] == counts[:-1] and found[0].doc_tokens == total
