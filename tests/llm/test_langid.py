import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import langid


def parse(sample, text):
    """Phrases of the text, each the longest prefix of the rest that occurs in the sample."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end + 1] in sample and text[at:end] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_equal_a_plain_parse(monkeypatch):
    rng = random.Random(1)
    samples = {lang: "".join(rng.choice(letters) for _ in range(300)) for lang, letters in (("x", "abc "), ("y", "bcdé "))}
    model = langid.train(samples)
    texts = ["".join(rng.choice("abcdé q語") for _ in range(rng.randrange(1, 130))) for _ in range(40)]
    texts += ["a" * 1000, "ab" * 700, "abcab" * 300, samples["x"] * 3, "qq" * 200, ("a" * 37 + "b") * 40, "語a" * 120]
    expected = [[parse(samples[x], t) for x in "xy"] for t in texts]
    for part in (1, 7, 50, 256, 5000):
        monkeypatch.setattr(langid, "PART", part)
        assert langid.phrases(model, texts).tolist() == expected


def test_parts_that_never_meet():
    # phrases of seven letters, in step with no part
    model = langid.train({"x": "aaaaaaa", "y": "abababab"})
    texts = ["a" * n for n in (256, 257, 1791, 1792, 1793, 100_000)] + ["ab" * 5000, "ba" * 4001]
    assert langid.phrases(model, texts).tolist() == [[parse(s, t) for s in ("aaaaaaa", "abababab")] for t in texts]


def test_many_languages_with_large_alphabets():
    rng = random.Random(4)
    scripts = [(0x61, 26)] * 30 + [(0x430, 32)] * 8 + [(0x4E00, 3500)] * 6 + [(0xAC00, 1800)] * 6
    samples = {f"l{i}": "".join(chr(first + int(many * rng.random() ** 2)) if rng.random() < 0.85 else " " for _ in range(12_000))
               for i, (first, many) in enumerate(scripts)}
    model = langid.train(samples)
    assert len(model.letters) > 5000 and model.nbytes < 40e6  # about 64 bytes a character
    texts = [s[300:420] + s[9000:9300] for s in samples.values()]
    assert langid.judge(model, texts)[0] == list(samples)


def test_a_model_too_large_to_hand_out_is_an_error(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 100)
    with pytest.raises(ValueError, match="MODEL_BYTES"):
        langid.identify(docs_of(["a"]), langid.train({"x": "abc"}))


def test_automaton_holds_exactly_the_substrings():
    text = "abcbcabb cab"
    steps = langid.suffix_automaton(text)

    def spelled(word):
        state = 0
        for c in word:
            if c not in steps[state]:
                return False
            state = steps[state][c]
        return True

    some = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(spelled(w) for w in some) and not any(spelled(w + c) for w in some for c in "abc " if w + c not in text)


def test_undecided_texts_null_columns_and_empty_tables(docs_of, spark):
    model = langid.train({"b": "aaaa bbbb", "a": "cccc dddd"})
    df = docs_of([None, "", " 12 !? ", "語語", "bbbb", "cccc " * 3000, "bbbb"]).withColumn("score", F.lit(1))
    rows = langid.identify(df, model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score > 0) for r in rows] == [
        ("und", False), ("und", False), ("und", False), ("a", False), ("b", True), ("a", True), ("b", True)]
    assert rows[0].source is None and "text" not in rows[0].asDict()
    none = langid.learn(docs_of([None, "x"]))
    assert {r.lang_pred for r in langid.identify(docs_of(["x", None]), none).collect()} == {"und"}
    assert langid.identify(docs_of([]), model).count() == 0


def test_held_out_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in langid.table(spark, sf.replace("0.001", "0.01"), "documents").collect()}
    rows = langid.op10_cross_parsing(spark, sf.replace("0.001", "0.01")).collect()
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(judged) > 150 and np.mean(judged) > 0.95
