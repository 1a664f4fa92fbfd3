import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from callscope.llm import pieces

ODD = ["", " ", "  ", "a", " a", "a ", "\n\t\r", "▁", "▁▁ a▁", "語①ﬁ", "é 👩‍👧\x00", "<s></s><unk><0x41>", "x" * 200, "ab" * 70 + " " + "語" * 60, "   lead", "a    b"]


@pytest.fixture(scope="module")
def table():
    return pieces.pieces_of(pieces.MODEL, 1.0)


@pytest.fixture(scope="module")
def weights(table):
    """Weight by piece, read from the model itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return {model.id_to_piece(i): (i, (2.0 - model.get_score(i)) ** -1.0) for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}


def ways(word, weights):
    """All segmentations of a word with their chances."""
    found = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in weights for p in parts):
            found[tuple(weights[p][0] for p in parts)] = math.prod(weights[p][1] for p in parts)
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


def test_samples_follow_the_weights_of_all_paths(table, weights):
    n = 40_000
    got = Counter(tuple(s.tolist()) for s in pieces.sample(table, ["there"] * n, np.arange(n), 3))
    expected = ways("▁there", weights)
    assert set(got) <= set(expected) and len(expected) > 10
    for way, chance in expected.items():
        assert abs(got[way] / n - chance) < 5 * math.sqrt(chance * (1 - chance) / n) + 3 / n


def test_long_words_stay_possible(table, weights):
    # thousands of characters without a border: sums are scaled on the way
    text = "thereandback" * 1500 + "語①" * 900
    found = pieces.sample(table, [text] * 3, np.arange(3), 1)
    assert [pieces.decode(table, f) for f in found] == [text] * 3
    long, short = ("thereandback" * 1500, ["thereandback"] * 1500)
    mean = [np.mean([len(table.surface[i]) for s in pieces.sample(table, t, np.arange(len(t)), 1) for i in s.tolist()]) for t in ([long], short)]
    assert abs(mean[0] - mean[1]) < 0.3


def test_words_fall_apart_where_no_piece_crosses(table, monkeypatch):
    rng = random.Random(6)
    parts = ["the", "ing", "語", "語①語", "é", "xqz", "ation", "▁", "0", "12", "Q#", "//", "éa"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 20, 60, 60, 300, 900)] + [" a ".join("語" * 90 for _ in range(4))]
    keys = np.arange(len(texts))
    cuts = {}
    for long in (10**9, 48, 0):
        monkeypatch.setattr(pieces, "LONG", long)
        cuts[long] = [s.tolist() for s in pieces.sample(table, texts, keys, 9)]
    assert cuts[10**9] == cuts[48] == cuts[0]


def test_a_long_text_without_blanks_takes_no_longer_than_one_with(table):
    rng = random.Random(7)
    letters = [chr(0x4E00 + rng.randrange(3000)) for _ in range(1 << 19)]
    words = ["some", "words", "that", "were", "drawn", "to", "fill", "a", "line", "of", "text"]
    plain = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(80_000))[:1 << 19]
    times = []
    for text in ("".join(letters), plain):
        begun = time.process_time()
        found = pieces.sample(table, [text], np.array([1]), 0)
        times.append(time.process_time() - begun)
        assert pieces.decode(table, found[0]) == text
    # three bytes a character and three pieces; the step by step form took some minutes
    assert times[0] < 6 * times[1] + 5


def test_decoding_returns_every_text(table):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["the", " ", "ing", "\n", "é", "▁", "語", "x1", "  ", "👩"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    found = pieces.sample(table, texts, np.arange(len(texts)), 0)
    assert [pieces.decode(table, f) for f in found] == texts
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [len(f) > 0 for f in found] == [len(t) > 0 for t in texts] and max(f.max(initial=0) for f in found) < model.get_piece_size()


def key_of_draw(number, place, seed):
    """The row key whose draw at a place of the text comes from ``number``: the hash turned back."""
    def unmixed(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * pow(0xD6E8FEB86659FD93, -1, 1 << 64) % (1 << 64)
        return x ^ (x >> 32)

    stream = (unmixed(number) - place * int(pieces._BASE)) % (1 << 64)
    return (unmixed(stream) - int(pieces.mix(np.array([seed], np.uint64))[0])) % (1 << 64)


@pytest.mark.parametrize("number", [(1 << 64) - 1, (1 << 64) - (1 << 39), 0])
def test_the_largest_draw_takes_a_piece(table, number):
    # as float32 these draws are one, which no cumulative chance exceeds
    for text in ("qzxjkvw", "thereand", "語①語①", "q" * 40, "thereandback" * 9):
        keys = np.array([key_of_draw(number, len(text), 5)], np.uint64).view(np.int64)
        found = pieces.sample(table, [text], keys, 5)[0]
        assert pieces.decode(table, found) == text


def test_same_key_same_pieces_in_any_batch(docs_of):
    texts = [f"some words that may be cut in many ways {i % 7}" for i in range(60)] + [None, ""]
    df = docs_of(texts).withColumns({"decoded": F.lit(1), "pieces": F.lit(2)})
    a = {r.doc_id: r.pieces for r in pieces.encode(df.repartition(1)).collect()}
    b = {r.doc_id: r.pieces for r in pieces.encode(df.repartition(7)).collect()}
    c = {r.doc_id: r.pieces for r in pieces.encode(df, seed=1).collect()}
    assert a == b and a != c and a[60] is None and a[61] == []
    assert len({tuple(a[i]) for i in range(0, 60, 7)}) > 1
    back = pieces.decoded(pieces.encode(df)).collect()
    assert all(r.decoded == r.text for r in back)
    assert pieces.decoded(pieces.encode(docs_of([]))).count() == 0
    named = docs_of(["a b c", "a b c"]).withColumn("key", F.lit("k"))
    assert len({tuple(r.pieces) for r in pieces.encode(named, key="key").collect()}) == 1


def test_documents_of_the_small_data_set(spark, sf):
    rows = pieces.op7_piece_sampling(spark, sf).collect()
    assert len(rows) == pieces.table(spark, sf, "documents").count()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)
