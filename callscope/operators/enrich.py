"""Per-call enrichment: redact, truncate, estimate tokens, price, classify.

Every step is a projection; the same functions serve batch and streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.config import (
    HALLUCINATION_CODES, HALLUCINATION_TEXT, REDACTION_DEPTH, RESPONSE_LIMIT_BYTES, SECRET_WORDS, TIMEOUT_TEXT, Pricing,
)
from callscope.functions import payload


def redact_arguments(df: DataFrame, column: str = "arguments", max_depth: int = REDACTION_DEPTH,
                     words: tuple[str, ...] = SECRET_WORDS) -> DataFrame:
    """Hide the values of secret-looking argument keys (see ``payload.redact``).

    Quirks kept on purpose: the word match is a substring match, so ``author``
    and ``monkey`` are hidden too, and secrets deeper than ``max_depth``
    survive. Responses are not redacted.
    """
    return df.withColumn(column, payload.redact(column, max_depth, words))


def truncate_response(df: DataFrame, limit: int = RESPONSE_LIMIT_BYTES, column: str = "response") -> DataFrame:
    """Cut a raw JSON response to ``limit`` bytes and record its full size.

    Arrays keep the leading items that fit, objects keep all members with
    top-level strings cut to 500 characters (and may stay over the limit),
    scalars keep their first ``limit`` characters. Characters are code points.
    A struct column is taken to be enveloped already and passes unchanged.
    """
    if isinstance(df.schema[column].dataType, T.StructType):
        return df
    # Separate steps: the response is parsed and printed once per row.
    parsed = df.withColumn("_parsed", F.try_parse_json(column)).withColumn("_text", F.to_json("_parsed"))
    return parsed.withColumn(column, payload.envelope(F.col("_parsed"), F.col("_text"), limit)).drop("_parsed", "_text")


def estimate_tokens(df: DataFrame, chars_per_token: float = 4, compacted: bool = False) -> DataFrame:
    """Tokens from byte sizes: redacted arguments in, untruncated response out.

    Arguments count by their compact JSON; ``compacted`` says that they already
    are (:func:`redact_arguments` leaves them so) and saves parsing them again.
    Missing arguments count as the four bytes of ``null``; a divisor of 0 means 4.
    """
    divisor = F.lit(float(chars_per_token or 4))
    arguments = F.col("arguments") if compacted else F.coalesce(payload.compact(F.col("arguments")), F.col("arguments"))
    argument_bytes = F.octet_length(F.coalesce(arguments, F.lit("null")))
    response_bytes = F.coalesce(F.col("response.size_bytes"), F.lit(0))
    return df.withColumns({
        "input_tokens": F.ceil(argument_bytes / divisor).cast("long"),
        "output_tokens": F.ceil(response_bytes / divisor).cast("long"),
    })


def price_calls(df: DataFrame, pricing: Pricing = Pricing(), overrides: DataFrame | None = None) -> DataFrame:
    """Cost in USD from the token estimates.

    Overrides come either from ``pricing.per_server`` (job options, so a
    literal lookup without a join) or as a table with ``server_name,
    input_per_million, output_per_million``. The table is joined without a
    hint: Spark broadcasts it only while it is below its own size threshold.
    """
    rate_in, rate_out = F.lit(float(pricing.input_per_million)), F.lit(float(pricing.output_per_million))
    if overrides is not None:
        rates = overrides.select(
            "server_name",
            F.col("input_per_million").cast("double").alias("_rate_in"),
            F.col("output_per_million").cast("double").alias("_rate_out"),
        )
        df = df.join(rates, "server_name", "left")
        overridden = F.col("_rate_in").isNotNull()
        rate_in = F.when(overridden, F.col("_rate_in")).otherwise(rate_in)
        rate_out = F.when(overridden, F.col("_rate_out")).otherwise(rate_out)
    for server, (server_in, server_out) in pricing.per_server.items():
        here = F.col("server_name") == server
        rate_in = F.when(here, F.lit(float(server_in))).otherwise(rate_in)
        rate_out = F.when(here, F.lit(float(server_out))).otherwise(rate_out)
    cost = F.col("input_tokens") / 1e6 * rate_in + F.col("output_tokens") / 1e6 * rate_out
    return df.withColumn("cost_usd", cost).drop("_rate_in", "_rate_out")


def classify_errors(df: DataFrame) -> DataFrame:
    """Why a call failed: the agent's fault, the tool's, or a deadline."""
    message = F.coalesce(F.col("error_msg"), F.lit(""))
    return df.withColumn(
        "error_class",
        F.when(F.col("status") == "success", F.lit(None).cast("string"))
        .when(F.col("status") == "timeout", "timeout")
        .when(F.col("error_code").isin(*HALLUCINATION_CODES), "hallucination")
        .when(message.rlike(f"(?i){HALLUCINATION_TEXT}"), "hallucination")
        .when(message.rlike(f"(?i){TIMEOUT_TEXT}"), "timeout")
        .otherwise("tool_failure"),
    )


def enrich(df: DataFrame, pricing: Pricing = Pricing(), overrides: DataFrame | None = None) -> DataFrame:
    """All steps in order. Incoming token, cost and class values are replaced."""
    df = truncate_response(redact_arguments(df))
    df = price_calls(estimate_tokens(df, pricing.chars_per_token, compacted=True), pricing, overrides)
    return classify_errors(df)
