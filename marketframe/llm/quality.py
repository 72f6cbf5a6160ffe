"""Quality by weak supervision, in DataFrame operations only.

Rules look at counts of a text and vote for or against its quality, or abstain.
Junk comes in kinds, so each kind of defect (repetition, odd symbols, shouting,
lack of substance) is a hidden cause that several rules view from different
sides: odd symbols also show as few short words and few sentence ends. For each
defect, expectation-maximisation over how often each pattern of its rules' votes
occurs estimates, without labels, how often each rule objects, abstains and
approves on texts with and without it. The votes, weighted by these accuracies,
give the posterior probability that a text lacks the defect, and the product
over the defects is its quality, which replaces the demand that every rule be
passed: an objection of a rule that often errs is overruled by the other views,
and a text that few rules approve can be rejected without any objection.

The tables where each estimate begins say only that rules object more on bad
texts and approve more on good ones, alike for every rule; they stay in the
estimate with the weight of ``PSEUDO_ROWS`` rows.

The texts are read once; a table of counts, a few dozen bytes a row, serves the
estimate and the verdict. The estimate needs only the number of rows of each
pattern, of which there are at most ``3 ** rules`` at any size of input, and
far fewer in fact, as votes depend on each other.

Edge cases: a null or empty text has no words, fails the base rule, and isn't
kept; rows are judged one by one, so repeated rows get the same verdict; without
any row nothing is estimated and the starting tables hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import let, saved, text_of, words_of

WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of at most this many characters are counted as short.
SHORT = 3


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in ``words``.

    Windows are hashed to 64 bits, sorted with their places, and equal
    neighbours marked: n log n for a text of n words.
    """
    none = F.lit(0).cast("bigint")

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(reach, none, lambda a, x: a + x)

    def marked(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def of(hashes: Column) -> Column:
        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(paired, marked))

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(each) - (window - 1)), lambda i: F.xxhash64(F.slice(each, i, window)))

    hashed = lambda: let(F.transform(words, lambda w: F.xxhash64(w)), lambda x: let(windows(x), of))
    return F.when(F.size(words) < window, none).otherwise(hashed())


def counts(text: Column) -> Column:
    """A struct of what the rules look at."""

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
            repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.length(w) <= SHORT)).cast("bigint").alias("n_short"),
        )

    return F.struct(
        let(words_of(text), of).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        (_count_of(text, "\n") + 1).alias("n_lines"),
        _count_of(text, CAPITALS).alias("n_capitals"),
        _count_of(text, "!?").alias("n_shouts"),
        _count_of(text, ".").alias("n_stops"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes against where ``bad`` holds, else for where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


RULES = (
    Rule("length", "n_words < 20", "n_words >= 40"),
    Rule("vocabulary", "n_words >= 50 AND 10 * n_distinct < 2 * n_words", "10 * n_distinct >= 4 * n_words"),
    Rule("repetition", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    Rule("capitals", "10 * n_capitals > 4 * word_chars", "10 * n_capitals <= 2 * word_chars"),
    Rule("shouting", "10 * n_shouts > 3 * n_words", "20 * n_shouts <= n_words"),
    Rule("short_words", "100 * n_short < 8 * n_words", "100 * n_short >= 15 * n_words"),
    Rule("sentences", "100 * n_stops < n_words OR 2 * n_stops > n_words", "100 * n_stops >= 2 * n_words AND 4 * n_stops <= n_words"),
)

#: The rules that view each kind of defect.
VIEWS = {
    "repetition": ("vocabulary", "repetition", "lines", "short_words"),
    "symbols": ("symbols", "word_length", "short_words", "sentences"),
    "shouting": ("capitals", "shouting", "short_words"),
    "substance": ("length", "sentences", "short_words"),
}

#: Where the estimate begins, for every rule alike: how often it objects, abstains and approves on bad and on good rows.
FIRST = {False: {-1: 0.3, 0: 0.3, 1: 0.4}, True: {-1: 0.05, 0: 0.25, 1: 0.7}}
FIRST_SHARE = 0.9
#: The weight of these tables, in rows, at any number of rows: enough that no vote that never occurs gets probability 0.
PSEUDO_ROWS = 10.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 500) -> tuple[float, list[dict[int, float]]]:
    """(share of rows without the defect, for each rule the log odds that each of its votes carries) by expectation-maximisation.

    ``patterns``: votes (1, -1 or 0 for each rule) and how many rows cast them.
    How often a rule objects, abstains and approves is estimated for good and for
    bad rows apart, so a rule that is right when it objects need not be right
    when it approves, and nothing fixes which way a vote counts.
    """
    share, rates = FIRST_SHARE, [FIRST] * rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        odds, before, good = log_odds(rates), share, 0.0
        seen = [{y: {v: FIRST[y][v] * PSEUDO_ROWS for v in (-1, 0, 1)} for y in (False, True)} for _ in range(rules)]
        for votes, n in patterns:
            p = posterior(votes, share, odds)
            good += n * p
            for table, v in zip(seen, votes, strict=True):
                table[True][v] += n * p
                table[False][v] += n * (1 - p)
        share = (good + FIRST_SHARE * PSEUDO_ROWS) / (total + PSEUDO_ROWS)
        rates = [{y: {v: c / sum(t[y].values()) for v, c in t[y].items()} for y in (False, True)} for t in seen]
        if abs(share - before) < 1e-9:
            break
    return share, log_odds(rates)


def log_odds(rates: list[dict]) -> list[dict[int, float]]:
    """For each rule and vote, the log of how much oftener good rows get it than bad ones."""
    return [{v: math.log(r[True][v] / r[False][v]) for v in (-1, 0, 1)} for r in rates]


def posterior(votes, share: float, odds: list[dict[int, float]]) -> float:
    x = math.log(share / (1 - share)) + sum(o[v] for v, o in zip(votes, odds, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def judged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, views: dict[str, tuple[str, ...]] = VIEWS, threshold: float = 0.5
) -> DataFrame:
    """``key``, the counts, the votes, ``base_failed``, ``quality`` (the posterior) and ``kept`` for every row."""
    found = docs.select(F.col(key).alias("key"), counts(text_of(text)).alias("c")).select("key", "c.*").select("w.*", "*").drop("w")
    votes = [F.coalesce(r.vote(), F.lit(0)).cast("tinyint").alias(f"vote_{r.name}") for r in rules]
    table = saved(found.select("*", *votes), "quality-counts")
    names = [f"vote_{r.name}" for r in rules]
    # at most 3 ** len(rules) rows, whatever the size of the table
    patterns = table.groupBy(*names).agg(F.count("*").alias("n")).collect()
    quality = F.lit(1.0)
    for seen_by in views.values():
        columns = [f"vote_{name}" for name in seen_by]
        share, odds_of = estimate(sorted(_summed(patterns, columns).items()), len(columns))
        odds = F.lit(math.log(share / (1 - share)))
        for name, o in zip(columns, odds_of, strict=True):
            odds = odds + F.when(F.col(name) == 1, o[1]).when(F.col(name) == -1, o[-1]).otherwise(o[0])
        quality = quality / (1 + F.exp(-odds))
    base_failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return (
        table.withColumn("base_failed", base_failed)
        .withColumn("quality", quality)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .withColumnRenamed("key", key)
    )


def _summed(patterns: list, columns: list[str]) -> dict[tuple[int, ...], int]:
    """How many rows have each combination of votes in ``columns``."""
    out: dict[tuple[int, ...], int] = {}
    for row in patterns:
        votes = tuple(row[c] for c in columns)
        out[votes] = out.get(votes, 0) + row["n"]
    return out
