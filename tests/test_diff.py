"""Line diff against an exhaustive model; bulk diffs."""

import random
import time
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st

from callscope.functions import linediff
from callscope.functions.linediff import line_diff, pretty_lines
from callscope.operators import diff


def exhaustive(a, b):
    """The same choice rule, with plain recursion for the common length."""
    @lru_cache(maxsize=None)
    def common(i, j):
        if i == len(a) or j == len(b):
            return 0
        if a[i] == b[j]:
            return 1 + common(i + 1, j + 1)
        return max(common(i + 1, j), common(i, j + 1))

    i = j = 0
    out = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("eq", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and common(i + 1, j) >= common(i, j + 1)):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out


def test_random_pairs():
    rng = random.Random(5)
    for _ in range(1500):
        letters = "ab" if rng.random() < 0.5 else "abcdefg"
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        assert line_diff(a, b) == exhaustive(tuple(a), tuple(b))


lines = st.lists(st.sampled_from(["a", "b", "c", "{", "}"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(lines, lines)
def test_any_pair(a, b):
    assert line_diff(a, b) == exhaustive(tuple(a), tuple(b))


def test_longer_pairs():
    rng = random.Random(6)
    for size in (60, 120):
        a = [rng.choice("abcdef") for _ in range(size)]
        b = [c for c in a if rng.random() > 0.2] + [rng.choice("abc") for _ in range(size // 3)]
        rng.shuffle(b[: size // 4])
        assert line_diff(a, b) == exhaustive(tuple(a), tuple(b))


def test_counting_differences_gives_the_same_diff(monkeypatch):
    rng = random.Random(12)
    for _ in range(1500):
        lines = [[rng.choice("abcdef"[:rng.randrange(1, 7)]) for _ in range(rng.randrange(14))] for _ in range(2)]
        with monkeypatch.context() as patch:
            patch.setattr(linediff, "FEW", -1)
            by_bits = line_diff(*lines)
        with monkeypatch.context() as patch:
            patch.setattr(linediff, "isqrt", lambda n: 10**6)
            patch.delattr(linediff, "_CommonSuffixes")
            assert line_diff(*lines) == by_bits


def test_long_payloads_with_few_differences():
    rng = random.Random(13)
    left = [str(rng.randrange(50_000)) for _ in range(100_000)]
    right = list(left)
    for k in range(40):
        right.insert(rng.randrange(len(right)), f"new {k}")
        del right[rng.randrange(len(right))]
    begin = time.perf_counter()
    found = line_diff(left, right)
    assert time.perf_counter() - begin < 5
    assert [x for kind, x in found if kind != "add"] == left and [x for kind, x in found if kind != "del"] == right
    assert sum(kind != "eq" for kind, _ in found) <= 80


def test_whole_payload_is_diffed():
    a = [str(i) for i in range(6000)]
    b = [x for x in a if int(x) % 7] + ["end"]
    lines = line_diff(a, b)
    assert [x for kind, x in lines if kind != "add"] == a
    assert [x for kind, x in lines if kind != "del"] == b
    assert sum(kind == "eq" for kind, _ in lines) == len(b) - 1


def test_pretty_lines():
    assert pretty_lines('{"a":[1,2.0,{"b":null}],"c":{},"d":"é\\n"}') == [
        "{", '  "a": [', "    1,", "    2,", "    {", '      "b": null', "    }", "  ],", '  "c": {},', '  "d": "é\\n"', "}"]
    assert pretty_lines(None) == ["null"]


def calls(spark, rows):
    return spark.createDataFrame(
        rows, "id long, session_id string, tool_name string, ms long, arguments string, data string").selectExpr(
        "id", "session_id", "tool_name", "timestamp_millis(ms) as timestamp", "arguments",
        "if(data is null, null, struct(data, false as truncated, 1L as size_bytes)) as response")


def test_previous_call_is_strictly_earlier(spark):
    rows = [(1, "s", "t", 0, "1", "1"), (2, "s", "t", 5, "1", "1"), (3, "s", "t", 5, "1", "1"), (4, "s", "u", 6, "1", "1"),
            (5, "s", "t", 9, "1", "1"), (6, "r", "t", 9, "1", "1")]
    got = diff.previous_same_tool(calls(spark, rows)).collect()
    assert {r.id: r.previous_id for r in got} == {1: None, 2: 1, 3: 1, 4: None, 5: 2, 6: None}


def test_diff_of_calls(spark):
    rows = [(1, "s", "t", 0, '{"a":1,"b":2}', "[1,2]"), (2, "s", "t", 1, '{"a":1,"b":3}', "[1,2]"), (3, "s", "t", 2, '{"b":3,"a":1}', None)]
    df = calls(spark, rows)
    lines = diff.diff_vs_previous(df, changed_only=True).orderBy("id", "section", "line_no").collect()
    assert [(r.section, r.type, r.line) for r in lines if r.id == 2] == [
        ("arguments", "eq", "{"), ("arguments", "eq", '  "a": 1,'), ("arguments", "del", '  "b": 2'),
        ("arguments", "add", '  "b": 3'), ("arguments", "eq", "}")]
    summary = {r.id: (r.arguments_changed, r.response_changed, r.different_tools)
               for r in diff.diff_summary(diff.pairs_with_previous(df)).collect()}
    assert summary == {2: (True, False, False), 3: (False, True, False)}
    everything = diff.diff_vs_previous(df)
    assert everything.where("id = 2 and section = 'response'").count() == 4
    assert diff.split_left(everything).where("id = 2 and section = 'arguments'").count() == 4
    assert {r.gutter for r in diff.unified(everything).collect()} == {" ", "+", "-"}


def test_lines_leave_in_bounded_batches(spark, monkeypatch):
    """A worker lets lines go as it finds them: none waits for the other pairs of its input, or for the end of a long one."""
    import pyarrow as pa

    monkeypatch.setattr(diff, "BATCH_LINES", 64)
    texts = [("\n".join(f"a{i % 7}" for i in range(n)), "\n".join(f"a{i % 5}" for i in range(n + 3))) for n in (1, 40, 500, 3, 200)] * 20
    read = []

    def batches():
        for k in range(0, len(texts), 10):
            read.append(k)
            part = texts[k:k + 10]
            yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part))), *(pa.array(side) for side in zip(*part))], names=["k", "before", "after"])

    out, got = diff._diff_lines(batches()), {}
    for batch in out:
        rows = batch.to_pylist()
        assert sum(len(r["_lines"]) for r in rows) <= 64 and max(r["k"] for r in rows) < read[-1] + 10
        for r in rows:
            lines = got.setdefault(r["k"], [])
            assert r["_first"] == len(lines)
            lines.extend(zip(r["_types"], r["_lines"]))
    assert got == {k: line_diff(a.split("\n"), b.split("\n")) for k, (a, b) in enumerate(texts)}
    long = '["' + '","'.join(map(str, range(9000))) + '"]'
    found = diff.diff_vs_previous(calls(spark, [(1, "s", "t", 0, long, "1"), (2, "s", "t", 1, long[:-1] + ',"x"]', "1")])).where("section = 'arguments'")
    assert [r.line_no for r in found.orderBy("line_no").collect()] == list(range(9004))


def test_envelope_without_data_is_shown_whole(spark):
    df = calls(spark, [(1, "s", "t", 0, "1", "null")])
    shown = df.select(diff.shown_response().alias("r")).first().r
    assert shown == '{"data":null,"truncated":false,"sizeBytes":1}'


def test_numbers_print_as_in_scripts():
    from callscope.functions.linediff import number_text

    shown = {"1e-7": "1e-7", "0.00001": "0.00001", "1e21": "1e+21", "123456789012345678901": "123456789012345680000",
             "1.50": "1.5", "-0.0": "0", "1e2": "100", "-2.5e-9": "-2.5e-9", "100": "100"}
    assert {text: number_text(text) for text in shown} == shown
