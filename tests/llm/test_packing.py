import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callscope.llm import packing, tokens


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.VOCABULARY)


def check(rows, texts, size, plain):
    """Ids, cuts and places hold; returns the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = plain.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // size) and all(p.length == size for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for inside in by_sequence.values():
        inside.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in inside))
        assert [r.offset for r in inside] == [0, *ends[:-1]] and ends[-1] <= size
    return len(by_sequence)


def test_ids_equal_those_of_the_vocabularys_library(plain):
    encode = tokens.encoder()
    assert encode.fast is not None
    odd = ["", "a" * 5000, " " * 3000, "\n" * 999 + "x", "語" * 700, "\x00\x01   x", "é 👩‍👩‍👧 'S 'll", "1234567 ١٢٣", "\r\n\t \f\v end ",
           "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext", "x" * 50 + "<|endoftext|>\n"]
    for text in odd:
        assert encode.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
        ends = encode.byte_ends(text, encode.ids(text))
        assert (ends[-1] if len(ends) else 0) == len(text.encode())


def test_special_tokens_in_a_whole_table(spark, sf, plain):
    """Every text with the vocabulary's special token inside has the ids of the library's call."""
    docs = packing.table(spark, sf, "documents").withColumn(
        "text", F.concat(F.substring("text", 1, 90), F.lit("<|endoftext|>"), F.expr("substring(text, 91)"), F.lit(" <|endoftext|>")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(packing.pack(docs, per_partition=60).collect(), texts, 1024, plain)
    assert plain.encode("a<|endoftext|>b", add_special_tokens=False).ids == tokens.encoder().ids("a<|endoftext|>b").tolist() == [64, 50256, 65]


def test_documents_of_the_small_data_set(spark, sf, plain):
    docs = packing.table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, per_partition=60).collect()
    assert check(rows, texts, 1024, plain) <= 1.04 * -(-sum(r.length for r in rows) // 1024)


def test_small_sizes_rounds_and_odd_rows(docs_of, plain):
    rng = random.Random(4)
    texts = [None, "", "x"] + [" ".join("word" for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rows = packing.pack(docs_of(texts).withColumns({"serial": F.lit(1), "bin": F.lit(2), "doc": F.lit(3)}), size=16, per_partition=20, slack=0).collect()
    used = check(rows, dict(enumerate(texts)), 16, plain)
    assert used <= packing.lower_bound(np.array([r.length for r in rows]), 16) + 4
    assert packing.pack(docs_of([])).count() == 0
    twice = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sorted(r.length for r in twice) == [2, 3, 3] and len({(r.sequence_id, r.offset) for r in twice}) == 3


def fewest(lengths, size):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in sorted(set(range(len(bins))), key=lambda b: bins[b]):
            if bins[b] + lengths[k] <= size:
                bins[b] += lengths[k]
                place(k + 1, bins)
                bins[b] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bound_and_packing_enclose_the_best(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 16, 30])
    lengths = np.array(sorted((rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 9))), reverse=True))
    bins, offsets, left = packing.best_fit_decreasing(lengths, size)
    assert packing.lower_bound(lengths, size) <= fewest(lengths.tolist(), size) <= len(left)
    for b in range(len(left)):
        assert lengths[bins == b].sum() + left[b] == size
