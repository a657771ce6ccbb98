"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects or passes a text by itself, so their order changes the cost and never the verdict. On a sample, every
rule is timed and the texts it rejects are counted; rules are then ordered by rejections per cost, and a ``CASE`` chain
stops at the first that rejects.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox.llm.tables import word_list
from runvox.scale import materialise

SAMPLE_ROWS = 2000
WINDOW = 8
_BLANK = " \t\n\x0b\x0c\r"


class Rule(NamedTuple):
    """A text goes where ``rejects`` is true (null counts as false)."""
    name: str
    rejects: Column


def _without(text: str, characters: str) -> str:
    escaped = "".join(f"\\u{ord(c):04x}" for c in characters)
    return f"translate({text}, '{escaped}', '')"


def _count(text: str, characters: str) -> Column:
    """How many of the text's code points are one of ``characters``."""
    return F.expr(f"CAST(length({text}) - length({_without(text, characters)}) AS BIGINT)")


def _repeats(window: int) -> str:
    """SQL for the words inside windows that the text has twice or more. Windows are compared by 64-bit hashes of their
    word hashes. ``transform(array(x), v -> ...)[0]`` binds ``v``, so that ``x`` is worked out once."""
    hashes = f"transform(array(transform(_words, w -> xxhash64(w))), h -> transform(sequence(1, size(h) - {window - 1}), i -> xxhash64(slice(h, i, {window}))))[0]"
    equal = "filter(p, (x, i) -> (i > 0 AND p[i - 1].h = x.h) OR (i < size(p) - 1 AND p[i + 1].h = x.h))"
    places = f"transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), p -> sort_array(transform({equal}, x -> x.i)))[0]"
    covered = (f"aggregate({places}, named_struct('last', -{window}, 'n', 0), "
               f"(a, x) -> named_struct('last', x, 'n', a.n + least({window}, x - a.last)), a -> a.n)")
    several = f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {covered} END"
    return f"CASE WHEN size(_words) <= {window} THEN 0 ELSE transform(array({hashes}), h -> {several})[0] END"


def counters(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (whose own column names must not clash) and n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words. A null text has none of anything."""
    d = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", word_list(F.col("_text")))
    lines = f"filter(split(_text, '\\n'), x -> {_without('x', _BLANK)} <> '')"
    d = d.withColumn("_lines", F.expr(f"transform(array({lines}), l -> named_struct('n', size(l), 'd', size(array_distinct(l))))[0]"))
    d = d.withColumn("n_repeat_words", F.expr(_repeats(WINDOW)).cast("long"))
    return d.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        F.expr(f"CAST(length({_without('_text', _BLANK)}) AS BIGINT)").alias("word_chars"),
        _count("_text", "#*$%&|<>").alias("n_symbols"), F.col("_lines.n").cast("long").alias("n_lines"),
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines")).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> list[Rule]:
    """The rules beyond the base, on the counters and the text."""
    chars, words = F.col("word_chars"), F.col("n_words")
    return [Rule("word_length", (chars < 2 * words) | (chars > 12 * words)),
            Rule("symbols", 10 * F.col("n_symbols") > words),
            Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
            Rule("digits", 5 * _count("_text", "0123456789") > chars),
            Rule("marks", 2 * _count("_text", "!?") > words),
            Rule("brackets", 10 * _count("_text", "{}[]\\^~=") > words)]


def ordered(rows: DataFrame, candidates: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, measured on about ``sample_rows`` rows. An empty sample keeps the order."""
    total = rows.count()
    if not total:
        return list(candidates)
    sample = materialise(rows.sample(min(1.0, sample_rows / total), seed=7))
    gains = {}
    for rule in candidates:
        seconds = []
        for _ in range(2):
            start = time.perf_counter()
            gone = sample.agg(F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long")).alias("n")).first()["n"] or 0
            seconds.append(time.perf_counter() - start)
        gains[rule.name] = gone / min(seconds)
    return sorted(candidates, key=lambda r: -gains[r.name])


def verdict(chain: Sequence[Rule]) -> Column:
    """False at the first rule that rejects; those after it are not evaluated."""
    out = None
    for rule in chain:
        out = F.when(rule.rejects, False) if out is None else out.when(rule.rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def report(docs: DataFrame, candidates: Sequence[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per row of ``docs``.

    A null or empty text has no words, fails the base and is not kept. Rows that repeat an id, and null ids, are judged
    row by row. An empty table gives no rows; other columns are not read.
    """
    rows = counters(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    sample_of = counters(docs.select("text").sample(_share(docs), seed=7).select(F.col("text").cast("string").alias("text")))
    chain = ordered(sample_of.where(~base_failed()), rules() if candidates is None else candidates)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base_failed().alias("base_failed"), F.when(base_failed(), False).otherwise(verdict(chain)).alias("kept"))


def _share(docs: DataFrame) -> float:
    return min(1.0, 2 * SAMPLE_ROWS / max(1, docs.count()))
