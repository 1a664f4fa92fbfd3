import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from callscope.llm import piecetable
from callscope.llm.piecetable import Piece, PieceTable, Settings

MARKS = {"p": "<P>", "m": "<M>", "s": "<S>"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_model(key, text, settings=Settings()):
    """Splices strings."""
    text = text or ""
    units = re.findall(settings.unit, text)
    n, h = len(units), hashlib.sha256(f"{settings.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in MARKS.values()) or h3 % 100 >= settings.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    part = {"p": "".join(units[:low]), "m": "".join(units[low:high]), "s": "".join(units[high:])}
    form = "spm" if h4 % 100 < settings.spm else "psm"
    return n, form, len(part["p"]), len(part["m"]), "".join(MARKS[x] + part[x] for x in form)


def texts(seed):
    rng = random.Random(seed)
    parts = ["a", "é語\U0001f600", " ", "\n", "\n\n", "\r\n", "<", "<P", "S>", "<M", ">", "word "]
    out = [None, "", "\n", "no end", "<P>", "x<S>y", "<M>\n", "<<P", "long line " * 30_000, "\n" * 50_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("settings", [Settings(), Settings(seed="x", rate=60, spm=20)])
def test_equals_spliced_strings_and_comes_back(docs_of, settings):
    rows = list(enumerate(texts(1)))
    made = piecetable.fill_in_middle(docs_of(rows).repartition(3), settings=settings)
    found = {r.doc_id: r for r in made.collect()}
    for key, text in rows:
        n, form, prefix, middle, output = plain_model(key, text, settings)
        r = found[key]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, prefix, middle, output)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(text or ""))
        buffers = {"text": (text or "").encode(), **settings.buffers()}
        assert b"".join(buffers[p.buffer][p.begin:p.end] for p in r.pieces).decode() == output
    back = {r.doc_id: r.text for r in piecetable.restore(made.drop("text"), settings=settings).collect()}
    assert back == {key: text or "" for key, text in rows}
    if settings.rate == 100:
        assert {r.form for r in found.values()} == {"plain", "psm", "spm"}


def test_pieces_are_cut_where_asked():
    table = PieceTable({"text": b"abcdef", "x": b"--"}, [Piece("text", 0, 3), Piece("x", 0, 2), Piece("text", 3, 6)])
    for places in [(0, 0), (0, 8), (3, 5), (1, 4), (4, 4), (8, 8)]:
        assert table.cut(*places).bytes() == b"abc--def"
    whole = PieceTable({"text": b"abcdef"}, [Piece("text", 0, 6)])
    assert [p[1:] for p in whole.cut(0, 6).pieces] == [(0, 0), (0, 6), (0, 0)]
    assert [p[1:] for p in whole.cut(2, 2).pieces] == [(0, 2), (0, 0), (2, 6)]
    for order in [(0, 2, 1), (2, 0, 1), (1, 2, 0)]:
        cut = whole.cut(1, 4)
        assert cut.arranged(order).arranged(piecetable.inverse(order)).bytes() == b"abcdef"


def test_other_units_and_sentinels(docs_of):
    settings = Settings(unit="\\S+\\s*", prefix="[PRE]", suffix="[SUF]", middle="[MID]")
    rows = [(i, "  Ünits are  words\nhere " * (i % 4)) for i in range(40)]
    made = piecetable.fill_in_middle(docs_of(rows), settings=settings, columns=["form", "output", "n"])
    assert {r.doc_id: r.n for r in made.collect()} == {i: len(re.findall(settings.unit, t)) for i, t in rows}
    assert {r.doc_id: r.text for r in piecetable.restore(made, settings=settings).collect()} == dict(rows)
    for bad in [{"prefix": ""}, {"prefix": "<S>"}, {"prefix": "aba"}, {"prefix": ">x<"}, {"middle": "x<S>"}]:
        with pytest.raises(ValueError):
            Settings(**bad)


def test_repeated_rows_null_keys_empty_table_and_clashing_columns(docs_of):
    rows = [(1, "a\nb\n"), (1, "a\nb\n"), (None, "a\nb\nc"), (2, None)]
    df = docs_of(rows).withColumns({"_key": F.lit("k"), "form": F.lit(9), "key": F.lit(1)})
    made = piecetable.fill_in_middle(df, columns=["form", "output"]).collect()
    want = sorted((str(k), *plain_model(k, t)[1::3]) for k, t in rows)
    assert sorted((str(r.doc_id), r.form, r.output) for r in made) == want
    assert {r["_key"] for r in made} == {"k"} and {r["key"] for r in made} == {1}
    assert piecetable.fill_in_middle(docs_of([])).count() == 0
    assert piecetable.restore(df.select(F.lit(None).cast("string").alias("output"), F.lit("psm").alias("form"))).first().text is None
    with pytest.raises(ValueError):
        piecetable.fill_in_middle(df, columns=["other"])
