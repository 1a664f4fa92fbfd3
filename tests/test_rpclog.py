"""Wire logs as files: lines by byte ranges, numbers by place, files that grow."""

import io
import random

import pytest

from callscope.sources import capture, rpclog
from callscope.streaming import sinks

LOG_LINE = '2026-01-02T03:04:05.{ms:03d}Z\t{side}\t{{"id":{id},{rest}}}'


def test_every_line_is_in_one_range():
    rng = random.Random(5)
    for _ in range(200):
        lines = [b"x" * rng.choice([0, 0, 1, 3, 40]) for _ in range(rng.randrange(12))]
        data = b"\n".join(lines) + rng.choice([b"", b"\n"])
        expected, at = [], 0
        for line in data.split(b"\n"):
            expected.append((at, line))
            at += len(line) + 1
        if not expected[-1][1]:
            expected.pop()  # nothing behind the last line end
        step, block = rng.randrange(1, 30), rng.randrange(1, 9)
        got = [x for b in range(0, len(data), step)
               for x in rpclog.lines_between(io.BytesIO(data), b, min(b + step, len(data)), block)]
        assert got == expected


def test_files_rotation_splits_and_odd_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes(b"2026-01-02T03:04:05Z\tagent\tone\ttwo\n\nno tabs\nwhen\tagent\tx\n\xff\xfe")
    (tmp_path / "sub" / "a.2.log").write_text("2026-01-02T03:04:06.5Z\tserver\té")
    (tmp_path / "b.log").write_text("")
    (tmp_path / "notes.txt").write_text("2026-01-02T03:04:06Z\tserver\tno log\n")
    small, whole = (rpclog.read_rpc_log(spark, str(tmp_path), split_bytes=n) for n in (7, 1 << 20))
    rows = [tuple(r) for r in whole.selectExpr("conn", "direction", "seq", "unix_millis(ts) as ms", "line").orderBy("conn", "seq").collect()]
    begin = 1767323045000
    assert rows == [
        ("a", "agent", 0, begin, "one\ttwo"), ("a", None, 35, None, None), ("a", None, 36, None, None),
        ("a", "agent", 44, None, "x"), ("a", None, 57, None, None), ("a", "server", 2 << 40, begin + 1500, "é"),
    ]
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))
    assert small.rdd.getNumPartitions() > 8 and whole.rdd.getNumPartitions() == 2
    assert rpclog.read_rpc_log(spark, str(tmp_path / "sub"), names=r"(?P<conn>none)(?P<n>)").count() == 0


def test_a_large_file_in_many_tasks(spark, tmp_path):
    count = 20_000
    with open(tmp_path / "busy.log", "w") as out:
        for i in range(count):
            out.write(LOG_LINE.format(ms=i % 1000, side="agent", id=i, rest='"method":"m"') + "\n")
    log = rpclog.read_rpc_log(spark, f"file:{tmp_path}", split_bytes=1 << 16)
    assert log.rdd.getNumPartitions() > 15
    assert log.selectExpr("count(distinct seq)", "count_if(ts is not null)", "count_if(line like '{%}')").first() == (count, count, count)


def test_two_files_of_one_number_are_an_error(spark, tmp_path):
    for folder in "xy":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.1.log").write_text("line\n")
    with pytest.raises(Exception, match="number 1 of connection a"):
        rpclog.read_rpc_log(spark, str(tmp_path)).count()


def test_a_growing_log_gives_the_pairs_of_the_whole_one(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    rng, lines = random.Random(1), []
    for i in range(300):
        lines.append(LOG_LINE.format(ms=i, side="agent", id=i % 7, rest='"method":"m"'))
        if rng.random() < 0.8:
            lines.append(LOG_LINE.format(ms=i + 1, side="server", id=i % 7, rest=f'"result":{i}'))
    text = "\n".join(lines) + "\n"
    third = len(text) // 3
    for number, cut in enumerate((third, 2 * third, len(text))):  # the cuts are within lines
        (logs / "a.log").write_text(text[:cut])
        (logs / f"b.{number}.log").write_text(lines[number] + "\n" + "half a line")
        stream = rpclog.stream_rpc_log(spark, str(logs), split_bytes=1000)
        sinks.to_parquet(stream, out, state, available_now=True).awaitTermination()
    got, whole = spark.read.parquet(out), rpclog.read_rpc_log(spark, str(logs)).where("line is not null")
    assert sorted(map(str, got.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    pairs, expected = (capture.pair_rpc_log(x).select("conn", "request_seq", "response_seq", "result") for x in (got, whole))
    assert sorted(map(str, pairs.collect())) == sorted(map(str, expected.collect())) and pairs.count() > 100


def test_a_log_that_became_shorter_is_an_error(spark, tmp_path):
    reader = rpclog._StreamReader({"path": str(tmp_path)})
    (tmp_path / "a.log").write_text("one\ntwo\nthr")
    end = reader.latestOffset()
    assert end == {"a.log": 8} and [(p.begin, p.end) for p in reader.partitions({}, end)] == [(0, 8)]
    (tmp_path / "a.log").write_text("new\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(end, reader.latestOffset())
