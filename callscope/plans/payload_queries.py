"""Queries: redaction, truncation, diffs, over the given text tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.operators import diff, enrich
from callscope.plans import testdata
from callscope.plans.catalog import query
from callscope.plans.testdata import WITH_CALLS, stamp



def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- redaction ------------------------------------------------------------------

@query("redact_arguments", """
select doc_id, concat('{"deep":{"a":[{"b":{"c":{"Secret":"[REDACTED]","d":{"token":"kept below the limit"}}}}]},',
 '"items":[{"api_key":"[REDACTED]","n":', cast(n_chars as varchar), '}],"query":{"lang":"', lang, '","x_Authorization":"[REDACTED]"},"text":',
 cast(to_json(text) as varchar), '}') as arguments from documents""")
def _redact(spark, sf):
    deep = F.struct(F.array(F.struct(F.struct(F.struct(
        F.col("text").alias("Secret"), F.struct(F.lit("kept below the limit").alias("token")).alias("d"),
    ).alias("c")).alias("b"))).alias("a"))
    arguments = F.to_json(F.struct(
        "text",
        F.struct(F.col("source").alias("x_Authorization"), "lang").alias("query"),
        F.array(F.struct(F.col("doc_id").alias("api_key"), F.col("n_chars").alias("n"))).alias("items"),
        deep.alias("deep"),
    ))
    return enrich.redact_arguments(_documents(spark, sf).select("doc_id", arguments.alias("arguments")))


@query("redact_flat_arguments", """
select doc_id, concat('{"author":"[REDACTED]","lang":"', lang, '","monkey":"[REDACTED]","password":"[REDACTED]"}') as arguments from documents""")
def _redact_flat(spark, sf):
    arguments = F.to_json(F.struct(
        F.col("source").alias("author"), "lang", F.col("n_chars").alias("monkey"), F.col("text").alias("password")))
    return enrich.redact_arguments(_documents(spark, sf).select("doc_id", arguments.alias("arguments")))


# -- truncation -------------------------------------------------------------------

def _truncated(df, key, response):
    out = enrich.truncate_response(df.select(key, response.alias("response")))
    return out.select(key, "response.truncated", "response.size_bytes", "response.data")


_SCALAR = """select {key}, size > 10000 as truncated, size as size_bytes,
 case when size <= 10000 then j else cast(to_json(left(t, 10000)) as varchar) end as data
 from (select {key}, t, j, cast(octet_length(encode(j)) as bigint) as size from (select {key}, {column} as t, cast(to_json({column}) as varchar) as j from {table}))"""


@query("truncate_response_text", _SCALAR.format(key="doc_id", column="text", table="documents"))
def _truncate_text(spark, sf):
    return _truncated(_documents(spark, sf), "doc_id", F.to_json(F.col("text").cast("variant")))


@query("truncate_response_html", _SCALAR.format(key="page_id", column="html", table="pages"))
def _truncate_html(spark, sf):
    return _truncated(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", F.to_json(F.col("html").cast("variant")))


@query("truncate_response_array", """
with items as (select doc_id, unnest(words) as w, generate_subscripts(words, 1) as pos from (select doc_id, string_split(text, ' ') as words from documents)),
 sized as (select doc_id, pos, j, octet_length(encode(j)) as b from (select doc_id, pos, cast(to_json(w) as varchar) as j from items)),
 summed as (select *, 2 + coalesce(sum(b + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before,
  2 + sum(b) over (partition by doc_id) + count(*) over (partition by doc_id) - 1 as size from sized),
 stops as (select doc_id, coalesce(min(pos) filter (where before + b > 10000), 1000000000) as stop from summed group by doc_id)
select s.doc_id, max(size) > 10000 as truncated, cast(max(size) as bigint) as size_bytes,
 concat('[', string_agg(j, ',' order by pos) filter (where size <= 10000 or pos < stop), ']') as data
from summed s join stops t on t.doc_id = s.doc_id group by s.doc_id""")
def _truncate_array(spark, sf):
    return _truncated(_documents(spark, sf), "doc_id", F.to_json(F.split("text", " ")))


@query("truncate_response_object", """
select doc_id, size > 10000 as truncated, size as size_bytes, case when size <= 10000 then j else
 concat('{"lang":', cast(to_json(left(lang, 500)) as varchar), ',"n_chars":', cast(n_chars as varchar), ',"nested":{"text":', cast(to_json(text) as varchar),
  '},"text":', cast(to_json(left(text, 500)) as varchar), '}') end as data
from (select *, cast(octet_length(encode(j)) as bigint) as size from (select *,
 concat('{"lang":', cast(to_json(lang) as varchar), ',"n_chars":', cast(n_chars as varchar), ',"nested":{"text":', cast(to_json(text) as varchar),
  '},"text":', cast(to_json(text) as varchar), '}') as j from documents))""")
def _truncate_object(spark, sf):
    response = F.to_json(F.struct("text", "lang", "n_chars", F.struct("text").alias("nested")))
    return _truncated(_documents(spark, sf), "doc_id", response)


# -- diffs -----------------------------------------------------------------------

# A number for each (conversation, turn), without a bound on either.
TURN_ID = "(cast((conv_id + turn) * (conv_id + turn + 1) / 2 as bigint) + turn)"


def _conversation_calls(spark, sf):
    """Turns as calls: conversation = session, role = tool, turn = order."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    data = F.to_json(F.split("text", " "))
    return turns.select(
        F.expr(TURN_ID).alias("id"),
        F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("tool_name"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60).alias("timestamp"),
        F.to_json(F.split("text", "\n")).alias("arguments"),
        F.struct(data.alias("data"), F.lit(False).alias("truncated"), F.octet_length(data).cast("long").alias("size_bytes")).alias("response"),
    )


_TURNS = f"""with turns as (select {TURN_ID} as id, conv_id, role, turn, text,
  lag({TURN_ID}) over w as previous_id, lag(text) over w as previous_text from conversations
  window w as (partition by conv_id, role order by turn)),
 pairs as (select * from turns where previous_id is not null) """


@query("previous_same_tool", WITH_CALLS + f"""select id, p.id2 as previous_id, {stamp('p.ts2')} as previous_timestamp from calls c left join
 (select a.id as id1, b.id as id2, b.timestamp as ts2, row_number() over (partition by a.id order by epoch_us(b.timestamp) // 1000 desc, b.timestamp, b.id) as rn
  from calls a join calls b on a.session_id = b.session_id and a.tool_name = b.tool_name
   and epoch_us(b.timestamp) // 1000 < epoch_us(a.timestamp) // 1000) p on p.id1 = c.id and p.rn = 1""")
def _previous(spark, sf):
    calls = testdata.calls(spark, sf).select("id", "session_id", "tool_name", "timestamp")
    return diff.previous_same_tool(calls).select("id", "previous_id", "previous_timestamp")


@query("previous_turn_of_role", _TURNS + "select id, previous_id from turns")
def _previous_turn(spark, sf):
    return diff.previous_same_tool(_conversation_calls(spark, sf)).select("id", "previous_id")


# Lines of these payloads are unique, so the diff has a closed form: before the next
# common line, what was only before is deleted, then what is only after is added.
@query("diff_vs_previous", WITH_CALLS + """, pairs as (select id, lag(id) over w as previous_id, arguments, response_bytes,
  lag(arguments) over w as old_arguments, lag(response_bytes) over w as old_bytes from calls
  window w as (partition by session_id, tool_name order by timestamp, id)),
 sides as (
  select previous_id, id, 'arguments' as section, ['{', concat('  "k": ', json_extract_string(old_arguments, '$.k')), '}'] as l,
   ['{', concat('  "k": ', json_extract_string(arguments, '$.k')), '}'] as r from pairs where previous_id is not null
  union all select previous_id, id, 'response',
   case when old_bytes is null then ['null'] else ['{', '  "data": null,', concat('  "sizeBytes": ', cast(old_bytes as bigint), ','), '  "truncated": false', '}'] end,
   case when response_bytes is null then ['null'] else ['{', '  "data": null,', concat('  "sizeBytes": ', cast(response_bytes as bigint), ','), '  "truncated": false', '}'] end
  from pairs where previous_id is not null),
 shared as (select *, list_filter(l, lambda x: list_contains(r, x)) as c from sides),
 lines as (
  select previous_id, id, section, c, unnest(l) as line, generate_subscripts(l, 1) as pos, 'l' as side from shared
  union all select previous_id, id, section, c, unnest(r), generate_subscripts(r, 1), 'r' from shared),
 kinds as (select *, case when list_contains(c, line) then 'eq' when side = 'l' then 'del' else 'add' end as type from lines),
 placed as (select *, coalesce(sum(case when type = 'eq' then 1 else 0 end) over (partition by previous_id, id, section, side order by pos), 0) as run from kinds),
 kept as (select * from placed where type <> 'eq' or side = 'l')
select previous_id, id, section, row_number() over (partition by previous_id, id, section
  order by run, case type when 'eq' then 0 when 'del' then 1 else 2 end, pos) - 1 as line_no, type, line,
 case type when 'add' then '+' when 'del' then '-' else ' ' end as gutter from kept""")
def _diff_previous(spark, sf):
    return diff.unified(diff.diff_vs_previous(testdata.calls(spark, sf)))


# Both sides of every diff must read like the payloads: '[', one line per item, ']'.
def _side_sql(text: str) -> str:
    def lines(section: str, separator: str) -> str:
        return f"""select previous_id, id, '{section}' as section, unnest(list_concat(['['], list_transform(range(1, len(s) + 1),
         lambda i: concat('  ', cast(to_json(s[i]) as varchar), case when i < len(s) then ',' else '' end)), [']'])) as line,
         generate_subscripts(range(0, len(s) + 2), 1) as position from (select *, string_split({text}, {separator}) as s from pairs)"""

    return _TURNS + lines("arguments", "chr(10)") + " union all " + lines("response", "' '")


def _numbered(side):
    order = Window.partitionBy("previous_id", "id", "section").orderBy("line_no")
    return side.select("previous_id", "id", "section", "line", F.row_number().over(order).alias("position"))


@query("diff_left_side", _side_sql("previous_text"))
def _left(spark, sf):
    return _numbered(diff.split_left(diff.diff_vs_previous(_conversation_calls(spark, sf))))


@query("diff_right_side", _side_sql("text"))
def _right(spark, sf):
    return _numbered(diff.split_right(diff.diff_vs_previous(_conversation_calls(spark, sf))))


@query("diff_summary", _TURNS + """select previous_id, id, string_split(previous_text, chr(10)) <> string_split(text, chr(10)) as arguments_changed,
 string_split(previous_text, ' ') <> string_split(text, ' ') as response_changed, false as different_tools from pairs""")
def _summary(spark, sf):
    return diff.diff_summary(diff.pairs_with_previous(_conversation_calls(spark, sf)))


@query("diff_summary_of_calls", WITH_CALLS + """, pairs as (select *, lag(id) over w as previous_id, lag(arguments) over w as previous_arguments,
  lag(coalesce(response_bytes, -1)) over w as previous_bytes from calls
  window w as (partition by session_id, tool_name order by timestamp, id))
select previous_id, id, arguments <> previous_arguments as arguments_changed, coalesce(response_bytes, -1) <> previous_bytes as response_changed,
 false as different_tools from pairs where previous_id is not null""")
def _summary_calls(spark, sf):
    return diff.diff_summary(diff.pairs_with_previous(testdata.calls(spark, sf)))


# Any two calls can be compared, also calls of different tools: here each turn with the next one.
@query("diff_summary_across_tools", f"""with pairs as (select {TURN_ID} as id, role, text, lag({TURN_ID}) over w as previous_id,
  lag(role) over w as previous_role, lag(text) over w as previous_text from conversations window w as (partition by conv_id order by turn))
select previous_id, id, string_split(previous_text, chr(10)) <> string_split(text, chr(10)) as arguments_changed,
 string_split(previous_text, ' ') <> string_split(text, ' ') as response_changed, previous_role <> role as different_tools
from pairs where previous_id is not null""")
def _summary_across(spark, sf):
    calls = _conversation_calls(spark, sf)
    chosen = diff.previous_same_tool(calls.select("id", "session_id", "timestamp", F.lit("any").alias("tool_name")))
    return diff.diff_summary(diff.pairs_of(calls, chosen.select("id", "previous_id")))
