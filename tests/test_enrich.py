"""Redaction, truncation, classification, pricing: hand-written edges."""

import json

from pyspark.sql import functions as F

from callscope.config import Pricing
from callscope.operators import enrich
from callscope.schema import normalize_schema


def text(value):
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def redacted(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, arguments string")
    return [r.arguments for r in enrich.redact_arguments(df).orderBy("i").collect()]


def model(value, depth=0):
    from callscope.config import REDACTED, SECRET_WORDS

    if depth <= 5 and isinstance(value, list):
        return [model(v, depth + 1) for v in value]
    if depth <= 5 and isinstance(value, dict):
        return {k: REDACTED if any(w in k.lower() for w in SECRET_WORDS) else model(v, depth + 1)
                for k, v in sorted(value.items())}
    return value


def nested(depth, leaf):
    for _ in range(depth):
        leaf = {"n": leaf}
    return leaf


def test_redaction_matches_recursive_model(spark):
    values = [nested(d, {"token": 1, "z": [1, None, True, 1.5]}) for d in range(8)]
    values += [[nested(d, {"My_Secret": {"deep": 1}})] for d in range(7)]
    values += [{"author": 1, "monkey": [1], "plain": "password"}, {"x": '{"token":1}'}, "token", None, 7, [[{"KEY": 1}]], {}]
    assert [json.loads(t) for t in redacted(spark, [text(v) for v in values])] == [model(v) for v in values]


def test_redaction_of_odd_text(spark):
    assert redacted(spark, [None, "not json token", r'{"token":"s"}', '{"b": 1}']) == [
        None, "not json token", '{"token":"[REDACTED]"}', '{"b":1}']


def enveloped(spark, responses):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "i int, response string")
    rows = enrich.truncate_response(df).orderBy("i").collect()
    return [r.response and (r.response.data, r.response.truncated, r.response.size_bytes) for r in rows]


def test_truncation_borders(spark):
    fits, over = text("a" * 9998), text("a" * 9999)
    long = text("b" * 12000)
    assert enveloped(spark, [fits, over, long]) == [
        (fits, False, 10000), (text("a" * 9999), True, 10001), (text("b" * 10000), True, 12002)]


def test_truncation_of_arrays(spark):
    exact = ["b" * 4996, "b" * 4997]  # 2 + 4998 + 1 + 4999 = 10000 bytes
    assert enveloped(spark, [text(exact)]) == [(text(exact), False, 10000)]
    wide = ["é" * 3000] * 4
    assert enveloped(spark, [text(wide)]) == [(text(wide[:1]), True, 24013)]
    stops = ["x" * 9000, "y" * 2000, "z"]  # the small last item is not taken once one did not fit
    assert enveloped(spark, [text(stops)])[0][0] == text(stops[:1])
    numbers = list(range(6000))
    data, truncated, size = enveloped(spark, [text(numbers)])[0]
    assert truncated and size == len(text(numbers))
    kept, used = [], 2
    for n in numbers:
        if used + len(str(n)) > 10000:
            break
        kept.append(n)
        used += len(str(n)) + 1
    assert json.loads(data) == kept


def test_truncation_of_objects_nulls_and_envelopes(spark):
    big = {"a": "x" * 20000, "b": ["y" * 600], "c": 1}
    got = enveloped(spark, [
        text(big), "null", None, '{"data":{"x":1},"sizeBytes":77,"truncated":true}', '{"truncated":true}', "0", "false", '""'])
    assert got == [
        (text({"a": "x" * 500, "b": ["y" * 600], "c": 1}), True, len(text(big))), None, None, ('{"x":1}', True, 77),
        ('{"truncated":true}', False, 18), ("0", False, 1), ("false", False, 5), ('""', False, 2)]


def test_classification(spark):
    cases = [
        ("success", -32601, "timeout", None), ("timeout", -32601, None, "timeout"), ("error", -32601, None, "hallucination"),
        ("error", -32602, "timed out", "hallucination"), ("error", -32603, "No Such Tool here", "hallucination"),
        ("error", None, "UNRECOGNIZED option", "hallucination"), ("error", None, "time out", "timeout"),
        ("error", None, "Timed  Out", "timeout"), ("error", None, "Deadline exceeded", "timeout"),
        ("error", None, "unknown method after timeout", "hallucination"), ("error", -1, None, "tool_failure"),
        ("error", None, "", "tool_failure"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "status string, error_code int, error_msg string").coalesce(1)
    assert [r.error_class for r in enrich.classify_errors(df).collect()] == [c[3] for c in cases]


def test_tokens_and_prices(spark):
    df = spark.createDataFrame(
        [("a", None, 5), ("b", '{"é":1}', None)], "server_name string, arguments string, n long")
    df = df.withColumn("response", F.when(F.col("n").isNotNull(), F.struct(F.col("n").alias("size_bytes"))))
    rows = enrich.estimate_tokens(df, 0).orderBy("server_name").collect()
    assert [(r.input_tokens, r.output_tokens) for r in rows] == [(1, 2), (2, 0)]
    priced = enrich.price_calls(enrich.estimate_tokens(df), Pricing(per_server={"b": (1e6, 0)})).orderBy("server_name").collect()
    assert [round(r.cost_usd, 9) for r in priced] == [round(3e-6 + 2 * 15e-6, 9), 2.0]


def test_override_table_replaces_both_rates(spark):
    df = spark.createDataFrame([("a", 1000000, 0), ("b", 1000000, 0)], "server_name string, input_tokens long, output_tokens long")
    table = spark.createDataFrame([("b", 7.0, 9.0)], "server_name string, input_per_million double, output_per_million double")
    rows = enrich.price_calls(df, overrides=table).orderBy("server_name").collect()
    assert [r.cost_usd for r in rows] == [3.0, 7.0]


def test_schema_upgrade_is_idempotent(spark):
    old = spark.createDataFrame([(1, None)], "id long, input_tokens long")
    once = normalize_schema(old)
    assert once.first().asDict() == {
        "id": 1, "input_tokens": 0, "error_code": None, "output_tokens": 0, "cost_usd": 0.0, "error_class": None}
    assert normalize_schema(once).schema == once.schema


def test_sizes_do_not_depend_on_the_layout_of_arguments(spark):
    texts = ['{"a": [1, 2, 3], "note": "the key is here"}', '{"a":[1,2,3],"note":"the key is here"}', '{ "a" : [1,2 ,3], "note":"the key is here" }']
    secret = ['{"to\\"ken" : 1, "x": 2}', '{"to\\"ken_key": "s"}', '{"\\u0074oken": "s"}', '{"token"\n: "s"}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts + secret)], "i int, arguments string")
    df = df.selectExpr("*", "named_struct('data', cast(null as string), 'truncated', false, 'size_bytes', 0L) as response")
    rows = enrich.estimate_tokens(enrich.redact_arguments(df)).orderBy("i").collect()
    assert len({r.input_tokens for r in rows[:3]}) == 1 and len({r.arguments for r in rows[:3]}) == 1
    assert [r.arguments for r in rows[3:]] == [
        '{"to\\"ken":1,"x":2}', '{"to\\"ken_key":"[REDACTED]"}', '{"token":"[REDACTED]"}', '{"token":"[REDACTED]"}']
