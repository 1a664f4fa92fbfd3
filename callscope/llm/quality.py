"""Quality rules as a short-circuit cascade, on built-in expressions only.

A rule is an expression over the text that is true where the rule rejects it.
:func:`estimate` measures what each rule costs and how much it rejects on a
sample, and orders the rules by rejections per second. :func:`cascade` tests
them in that order inside one CASE expression, which stops at the first
rejection, so the costly rules only see what the cheap ones let through. The
order changes the time, never the verdict.

Defined results: a NULL or empty text has no words and is rejected by the
length rule; a rule that yields NULL does not reject; repeated rows are judged
one by one; other columns pass through unread.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import SPACE, ORACLES, query, table, words
from callscope.session import cut_lineage

WINDOW = 8
WORDS = "_words"


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true where a text is to go; ``words`` are its words, split once."""

    name: str
    rejects: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Estimate:
    """One rule on the sample: seconds per row and the share of rows it rejects."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", "")).cast("long")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _bound(lines(text), lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"))


def n_repeat_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more, the first time included.

    Windows are compared by 64-bit hashes. Only a text with a repeated hash is
    looked at closely: its hashes are sorted with their places, equal
    neighbours are kept, and their windows are laid over each other.
    """
    starts = F.sequence(F.lit(1), F.size(tokens) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, F.lit(width))))

    def repeats(found: Column) -> Column:
        # a window's hash and place, in the order of the hashes
        ranked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return _bound(ranked, lambda r: _covered(F.sort_array(F.transform(
            F.filter(r, lambda x, i: F.coalesce((F.get(r, i - 1)["h"] == x["h"]) | (F.get(r, i + 1)["h"] == x["h"]),
                                                F.get(r, i - 1)["h"] == x["h"], F.get(r, i + 1)["h"] == x["h"])),
            lambda x: x["at"])), width))

    counted = _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(tokens) > width, counted).otherwise(F.lit(0).cast("long"))


def _covered(starts: Column, width: int) -> Column:
    """How many words the windows at the sorted ``starts`` cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
    return F.aggregate(
        starts, zero,
        lambda a, at: F.struct((a["n"] + F.least(F.lit(width), at - a["last"])).alias("n"), at.alias("last")),
        lambda a: a["n"])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def too_short(least: int = 20) -> Rule:
    return Rule("too_short", lambda text, tokens: F.size(tokens) < least)


def repeated_words(percent: int = 30, width: int = WINDOW) -> Rule:
    return Rule("repeated_words", lambda text, tokens: n_repeat_words(tokens, width) * 100 > F.size(tokens) * percent)


def symbols(percent: int = 5) -> Rule:
    """More symbols than ``percent`` of the characters in words."""
    return Rule("symbols", lambda text, tokens: n_symbols(text) * 100 > word_chars(text) * percent)


def repeated_lines(percent: int = 30, least: int = 3) -> Rule:
    """Repeated lines are more than ``percent`` of the lines, and ``least`` at least: a short text may open and close with one line."""
    return Rule("repeated_lines", lambda text, tokens: _bound(lines(text), lambda kept: _bound(
        F.size(kept) - F.size(F.array_distinct(kept)), lambda n: (n >= least) & (n * 100 > F.size(kept) * percent))))


def stuttering(percent: int = 30) -> Rule:
    """More than ``percent`` of the words equal the word before them."""
    return Rule("stuttering", lambda text, tokens: F.size(
        F.filter(tokens, lambda word, i: F.coalesce(F.get(tokens, i - 1) == word, F.lit(False)))) * 100 > F.size(tokens) * percent)


def shouting(percent: int = 60) -> Rule:
    """More capital letters than ``percent`` of the characters in words."""
    return Rule("shouting", lambda text, tokens: F.length(F.regexp_replace(text, "\\P{Lu}+", "")) * 100 > word_chars(text) * percent)


def few_letters(percent: int = 50) -> Rule:
    return Rule("few_letters", lambda text, tokens: F.length(F.regexp_replace(text, "\\P{L}+", "")) * 100 < word_chars(text) * percent)


def word_length(least: int = 2, most: int = 15) -> Rule:
    """Mean length of the words outside ``least`` to ``most``."""
    return Rule("word_length", lambda text, tokens: ~word_chars(text).between(F.size(tokens) * least, F.size(tokens) * most))


#: What every document has to pass, and what the method judges beyond it.
BASE = (too_short(), repeated_words())
MORE = (symbols(), repeated_lines(), stuttering(), shouting(), few_letters(), word_length())


def estimate(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 1000, seed: int = 7,
             rounds: int = 2) -> list[Estimate]:
    """Cost and selectivity of the rules on about ``sample_rows`` rows, best first.

    The sample is drawn over the whole table and written down once; every rule
    then runs alone over it, the fastest of ``rounds`` runs counts, and what
    the splitting into words takes by itself is taken off. The order only
    moves time, so an estimate may be kept and used again for other tables.
    An empty sample leaves the rules as they came.
    """
    total = df.count()
    if not total:
        return [Estimate(rule, 1.0, 0.0) for rule in rules]
    share = min(1.0, sample_rows / total)
    sample = df.select(F.col(text)).sample(share, seed) if share < 1 else df.select(F.col(text))
    sample = cut_lineage(sample.withColumn(WORDS, words(F.col(text))))

    def timed(reject: Column) -> tuple[float, int, int]:
        start = time.perf_counter()
        n, out = sample.agg(F.count(F.lit(1)), F.count_if(F.coalesce(reject, F.lit(False)))).first()
        return time.perf_counter() - start, n, out

    idle = min(timed(F.size(WORDS) < 0)[0] for _ in range(rounds + 1))
    found = []
    for rule in rules:
        runs = [timed(rule.rejects(F.col(text), F.col(WORDS))) for _ in range(rounds)]
        seconds, (_, n, out) = min(r[0] for r in runs), runs[0]
        # what is under a tenth of the empty run cannot be told from noise
        found.append(Estimate(rule, max(seconds - idle, idle / 10) / max(n, 1), out / max(n, 1)))
    return sorted(found, key=lambda e: (-e.gain, e.seconds))


def cascade(df: DataFrame, rules: Sequence[Rule], text: str = "text", by: str = "rejected_by") -> DataFrame:
    """Adds ``by``: the first of the rules, in this order, that rejects the row; NULL if it stays."""
    def verdict(tokens: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(rules):
            out = F.when(F.coalesce(rule.rejects(F.col(text), tokens), F.lit(False)), F.lit(rule.name)).otherwise(out)
        return out

    # The words are bound inside the expression: as a column of their own, a filter on the verdict
    # would be pushed below them, and split the text again for each window.
    return df.withColumn(by, _bound(words(F.col(text)), verdict))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base figures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    counted = _bound(words(F.col(text)), lambda tokens: F.struct(F.size(tokens).cast("long").alias("n"), n_repeat_words(tokens).alias("repeated")))
    own = WORDS
    while own.lower() in {c.lower() for c in df.columns}:
        own += "_"
    return df.withColumn(own, counted).withColumns({
        "n_words": F.col(f"`{own}`.n"), "word_chars": word_chars(F.col(text)), "n_symbols": n_symbols(F.col(text)),
        "n_dup_lines": n_dup_lines(F.col(text)), "n_repeat_words": F.col(f"`{own}`.repeated"),
    }).drop(own)


SQL = """
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
         row_number() over () as rid
  from documents),
win as (
  select rid, i, list_slice(ws, i, i + 7) as g
  from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w)),
rep as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from rep) group by rid),
m as (
  select doc_id, text, ws, len(ws) as n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls,
         coalesce(cov.n, 0) as n_repeat_words
  from w left join cov using (rid)),
b as (
  select *, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
  from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 5 * word_chars or (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * len(ls))
            or 100 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > 30 * n_words
            or 100 * length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) > 60 * word_chars
            or 100 * length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) < 50 * word_chars
            or word_chars not between 2 * n_words and 15 * n_words) as kept
from b
"""


@query("op3_quality_cascade", SQL)
def op3_quality_cascade(spark, sf_dir):
    """The base figures of every document, and the verdict of the cascade over those that pass the base."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [e.rule for e in estimate(documents, MORE)]
    judged = cascade(measures(documents), order).withColumn(
        "base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))
