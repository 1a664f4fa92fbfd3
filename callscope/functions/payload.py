"""JSON payload expressions: parsing, redaction, truncation.

A payload is kept as compact JSON text. Work on its structure goes through
Spark's variant type, so it stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.config import (
    OBJECT_STRING_CHARS, REDACTED, REDACTION_DEPTH, RESPONSE_LIMIT_BYTES, SECRET_WORDS,
)

RESPONSE_TYPE = "struct<data:string,truncated:boolean,size_bytes:bigint>"


def compact(json_text: Column) -> Column:
    """Canonical compact text of a JSON payload (keys sorted)."""
    return F.to_json(F.try_parse_json(json_text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def field(parsed: Column, path: str) -> Column:
    """A nested value as a variant; SQL NULL when absent, JSON null when null."""
    return F.try_variant_get(parsed, path, "variant")


def field_text(parsed: Column, path: str) -> Column:
    """A nested value as plain text; NULL when absent or null."""
    return F.try_variant_get(parsed, path, "string")


def text_or_null(value: Column) -> Column:
    """JSON text of a value, NULL for JSON null or an absent value."""
    return F.nullif(F.to_json(value), F.lit("null"))


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true in a script condition: anything but
    absent, null, false, 0 and the empty string."""
    return F.coalesce(~F.to_json(value).isin("null", "false", "0", "-0", "0.0", "-0.0", '""'), F.lit(False))


# -- redaction ---------------------------------------------------------------

def _is_secret(key: str, words: tuple[str, ...]) -> str:
    return f"coalesce(lower({key}) rlike '{'|'.join(words)}', false)"


@lru_cache(maxsize=None)
def _redacted(value: str, depth: int, max_depth: int, words: tuple[str, ...]) -> str:
    """SQL of the redacted ``value``. Members of an object and items of an
    array take the same path as (key, value) entries, items with a NULL key,
    so each level holds the next one once."""
    if depth > max_depth:
        return value
    entry, item, entries = f"e{depth}", f"i{depth}", f"m{depth}"
    inner = _redacted(f"{entry}.value", depth + 1, max_depth, words)
    opened = (
        f"coalesce(map_entries(try_cast({value} as map<string,variant>)), "
        f"transform(try_cast({value} as array<variant>), {item} -> named_struct('key', cast(null as string), 'value', {item})))"
    )
    cleaned = (
        f"transform({opened}, {entry} -> named_struct('key', {entry}.key, 'value', "
        f"if({_is_secret(f'{entry}.key', words)}, parse_json('\"{REDACTED}\"'), {inner})))"
    )
    closed = (
        f"case when {entries} is null or size({entries}) = 0 then {value} "
        f"when {entries}[0].key is null then cast(transform({entries}, {item} -> {item}.value) as variant) "
        f"else to_variant_object(map_from_entries({entries})) end"
    )
    return f"element_at(transform(array({cleaned}), {entries} -> {closed}), 1)"


def redact(json_text: str, max_depth: int = REDACTION_DEPTH, words: tuple[str, ...] = SECRET_WORDS) -> Column:
    """Replace the value of every object key that contains a secret word.

    Objects and arrays are walked down to ``max_depth`` (the top level is 0);
    anything deeper is returned as it is. Strings that hold JSON are not
    opened. The result is compact JSON either way, so its size does not depend
    on how the text was laid out; a text that is not JSON stays as it is.
    Texts without a secret word in a key skip the walk.
    """
    if any(not word.replace("_", "").isalnum() for word in words):
        raise ValueError("secret words may hold letters, digits and underscores only")
    column = f"`{json_text}`"
    # A key is a string that a colon follows. Escaped characters may hide a word, and escaped
    # quotes the end of its string, so a text with those passes on any word in it.
    words_or_escape = f"{'|'.join(words)}|[\\\\\\\\]u"
    candidate = (
        f"(lower({column}) rlike '(?:{words_or_escape})[^\"]*+\"[ \\t\\n\\r]*+:'"
        f" or (instr({column}, '\\\\\"') > 0 and lower({column}) rlike '{words_or_escape}'))"
    )
    walked = _redacted("root", 0, max_depth, tuple(words))
    return F.expr(
        f"if({candidate}, "
        f"coalesce(to_json(element_at(transform(array(try_parse_json({column})), root -> {walked}), 1)), {column}), "
        f"coalesce(to_json(try_parse_json({column})), {column}))"
    )


# -- truncation --------------------------------------------------------------

def _leading_items(parsed: Column, limit: int) -> Column:
    """The longest run of leading array items that fits into ``limit`` bytes."""
    # An item and its comma take two bytes at least, so no more than this can fit.
    items = F.slice(parsed.try_cast("array<variant>"), 1, limit // 2)
    texts = F.transform(items, lambda item: F.to_json(item))

    def kept(texts: Column) -> Column:
        start = F.struct(F.lit(2).alias("size"), F.lit(0).alias("count"))

        def step(state: Column, text: Column) -> Column:
            # Once an item does not fit, the size stays over the limit and nothing else does.
            size = state["size"] + F.octet_length(text)
            return F.struct((size + 1).alias("size"), (state["count"] + (size <= limit).cast("int")).alias("count"))

        return F.aggregate(texts, start, step)["count"]

    def cut(texts: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.slice(texts, F.lit(1), kept(texts)), ","), F.lit("]"))

    return bound(texts, cut)


def _short_strings(parsed: Column, chars: int) -> Column:
    """An object with every top-level string cut to ``chars`` characters."""
    members = parsed.try_cast("map<string,variant>")
    return F.to_json(F.to_variant_object(F.transform_values(
        members,
        lambda _, v: F.when(
            F.schema_of_variant(v) == "STRING",
            F.substring(F.try_variant_get(v, "$", "string"), 1, chars).cast("variant"),
        ).otherwise(v),
    )))


def envelope(parsed: Column, text: Column, limit: int = RESPONSE_LIMIT_BYTES) -> Column:
    """A parsed response, and its compact text, to ``{data, truncated, size_bytes}``.

    ``size_bytes`` is always the size before the cut. A response that already
    is such an envelope passes through. NULL and JSON null stay NULL.
    """
    kind = F.schema_of_variant(parsed)
    size = F.octet_length(text).cast("long")
    supplied = F.try_variant_get(parsed, "$.sizeBytes", "bigint")
    enveloped = field(parsed, "$.truncated").isNotNull() & supplied.isNotNull()
    cut = (
        F.when(kind.startswith("ARRAY"), _leading_items(parsed, limit))
        .when(kind.startswith("OBJECT"), _short_strings(parsed, OBJECT_STRING_CHARS))
        .otherwise(F.to_json(F.substring(F.try_variant_get(parsed, "$", "string"), 1, limit).cast("variant")))
    )
    return (
        F.when(parsed.isNull() | F.is_variant_null(parsed), F.lit(None))
        .when(enveloped, F.struct(
            F.to_json(field(parsed, "$.data")).alias("data"),
            truthy(field(parsed, "$.truncated")).alias("truncated"),
            supplied.alias("size_bytes"),
        ))
        .otherwise(F.struct(
            F.when(size <= limit, text).otherwise(cut).alias("data"),
            (size > limit).alias("truncated"),
            size.alias("size_bytes"),
        ))
        .cast(RESPONSE_TYPE)
    )
