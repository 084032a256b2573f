"""Quality rules as a short-circuit cascade of native expressions.

The rules, those of the base included, are ordered by what a bounded sample says
of them: rows rejected per second spent. A cheap rule that rejects much runs
first. What a rule needs (words, lines, sorted windows ...) is computed just
before it and only for rows that no rule has rejected yet, so most rows that go
never reach the dear ones. The order never changes whether a row is rejected,
only the cost.

Defined results: null or empty text has no words and fails the base rules; a
text of white space likewise. Equal rows get equal verdicts. Where several rules
reject a row, ``_rejected_by`` names the first in the measured order, which may
differ from run to run. Columns of the input pass through unchanged, whatever
their names, but for those that have the names of the operator's own results.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"

#: Rows that the cost and the selectivity of the rules are estimated on, at most.
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """A rule rejects a row where ``reject`` holds; it looks features up by name."""

    name: str
    reject: Callable[[Column], Column]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _sorted_grams(words: Column) -> Column:
    """Hash and place of every three-word window, equal windows next to each other."""
    n = F.size(words)
    grams = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n >= 3, F.sort_array(grams)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _twins(grams: Column) -> Column:
    """Places of the windows that have an equal one; F.get is null outside the array."""
    found = F.transform(
        grams,
        lambda g, k: F.when((g["h"] == F.get(grams, k - 1)["h"]) | (g["h"] == F.get(grams, k + 1)["h"]), g["i"]),
    )
    return F.array_compact(found)


def _covered_words(twins: Column) -> Column:
    return F.size(F.array_distinct(F.concat(twins, F.transform(twins, lambda i: i + 1), F.transform(twins, lambda i: i + 2))))


def _without(pattern: str) -> Callable[[Column], Column]:
    return lambda body: F.length(F.regexp_replace(body, pattern, ""))


#: What is computed of a text: from which other column, and how. What a lambda looks into is a column of its own.
_MADE: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "words": ("body", word_array),
    "lines": ("body", lambda body: F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    "grams": ("words", _sorted_grams),
    "twins": ("grams", _twins),
    "n_words": ("words", F.size),
    "word_chars": ("words", lambda words: F.length(F.array_join(words, ""))),
    "n_symbols": ("body", _without(r"[^#*$%&|<>]+")),
    "n_lines": ("lines", F.size),
    "n_dup_lines": ("lines", lambda lines: F.size(lines) - F.size(F.array_distinct(lines))),
    "n_repeat_words": ("twins", _covered_words),
    "n_upper": ("body", _without(r"[^A-Z]+")),
    "n_lower": ("body", _without(r"[^a-z]+")),
    "n_shouts": ("body", _without(r"[^!]+")),
}
#: The features that rules may look up, all longs.
FEATURES = tuple(name for name in _MADE if name not in ("words", "lines", "grams", "twins"))


class _Table:
    """The input's columns under numbers, and the text, to which features are added when they are asked for."""

    def __init__(self, df: DataFrame, text: str):
        self.df = df.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(df.columns)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
        self.wanted: Column | None = None  # for which rows features are computed

    def __getitem__(self, name: str) -> Column:
        if name not in self.df.columns:
            source, make = _MADE[name]
            value = make(F.col(source) if source == "body" else self[source])
            value = value.cast("long") if name in FEATURES else value
            self.df = common.once(self.df, name, value if self.wanted is None else F.when(self.wanted, value))
        return F.col(name)


def _result(df: DataFrame, rows: DataFrame, **own: Column) -> DataFrame:
    """The input's columns, and the operator's own beside them."""
    taken = {name.lower() for name in own}
    return df.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(rows.columns) if c.lower() not in taken], *[c.alias(name) for name, c in own.items()])


def with_features(df: DataFrame, text: str = "text", out: str = "_q") -> DataFrame:
    """Adds one struct with all features."""
    table = _Table(df, text)
    found = F.struct(*[table[name].alias(name) for name in FEATURES])
    return _result(table.df, df, **{out: found})


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


#: The two halves of the base rule.
BASE = (Rule("few_words", lambda q: q["n_words"] < 50), Rule("repeats", lambda q: 100 * q["n_repeat_words"] > 50 * q["n_words"]))


def default_rules() -> list[Rule]:
    """Thresholds in whole numbers, so that every engine gives the same verdict."""
    return [
        Rule("short_words", lambda q: q["word_chars"] < 2 * q["n_words"]),
        Rule("long_words", lambda q: q["word_chars"] > 15 * q["n_words"]),
        Rule("symbols", lambda q: 100 * q["n_symbols"] > 30 * q["n_words"]),
        Rule("dup_lines", lambda q: 100 * q["n_dup_lines"] > 50 * q["n_lines"]),
        Rule("shouting", lambda q: q["n_upper"] > q["n_lower"]),
        Rule("exclamations", lambda q: 100 * q["n_shouts"] > 30 * q["n_words"]),
    ]


def _seconds(df: DataFrame, count: Column) -> tuple[float, int]:
    """The shorter of two runs (the first one compiles), and the count."""
    found = []
    for _ in range(2):
        begun = time.perf_counter()
        n = df.agg(F.count_if(count).alias("n")).first()["n"]
        found.append((time.perf_counter() - begun, n))
    return min(found)


def order_rules(df: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on at most ``rows`` rows.

    A rule's cost is the time of a job that computes it, with all it needs, from
    the texts, less that of a job that only reads them. The sample bounds an
    estimate only: verdicts are over all rows and do not depend on it. Its texts
    are cached while the rules are timed and then dropped.
    """
    texts = df.select(F.col(text).alias("text")).limit(rows).cache()
    try:
        total = texts.count()
        idle, _ = _seconds(texts, F.col("text").isNull())
        scored = []
        for rule in rules:
            table = _Table(texts, "text")
            reject = F.coalesce(rule.reject(table), F.lit(False))
            spent, hits = _seconds(table.df, reject)
            scored.append((-(hits / total if total else 0.0) / max(spent - idle, 1e-3), rule.name, rule))
    finally:
        texts.unpersist()
    return [rule for *_, rule in sorted(scored, key=lambda s: s[:2])]


def cascade(rules: list[Rule], q: Column) -> Column:
    """The name of the first rule that rejects, or null: CASE stops at the first hit."""
    found = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        found = found.when(rule.reject(q), F.lit(rule.name))
    return found


def apply(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS, counts: bool = True) -> DataFrame:
    """The input with ``_rejected_by`` (null for rows that stay) and ``_q`` (features).

    counts: all features of all rows are asked for as well; else a feature is
    null where a rule before those that need it has rejected the row.
    """
    ordered = order_rules(df, [*BASE, *(rules if rules is not None else default_rules())], text, sample_rows)
    if counts:
        found = with_features(df, text)
        return found.select(*[F.col(f"`{c}`") for c in found.columns if c.lower() != "_rejected_by"], cascade(ordered, F.col("_q")).alias("_rejected_by"))
    table, last = _Table(df, text), None
    for i, rule in enumerate(ordered):
        reject = F.when(F.coalesce(rule.reject(table), F.lit(False)), F.lit(rule.name))
        reject = reject if last is None else F.coalesce(F.col(last), reject)
        last = f"by{i}"
        table.df = common.once(table.df, last, reject)
        table.wanted = F.col(last).isNull()
    made = [name for name in FEATURES if name in table.df.columns]
    return _result(table.df, df, _q=F.struct(*[F.col(name) for name in made]), _rejected_by=F.col(last))
