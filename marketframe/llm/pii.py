"""Personal data by patterns that bootstrap from seeds, in DataFrame operations only.

Seeds are what the plain rules find: addresses of mail and hosts, card and phone
numbers. A mention is a token, or a row of number groups, that looks like an
identifier; a seed's mention has its kind, others are unseen. The lexical patterns
of a mention are the last word and the last two words before it. Patterns and the
values of mentions are the two sides of a graph, whose edges carry how often they met.

The graph is scored in rounds: a pattern's confidence for a kind is the score of the
values after it, weighted by occurrences, over all occurrences of its words in the
whole corpus, whatever follows them; at least ``SUPPORT`` different values must stand
behind it, so that copies of one text make no pattern. An unseen value's score is that
at least one of its confident patterns is right; it is taken if most of its mentions
stand in such contexts, and counts as a seed of that score in the next round. Rounds
end when no value is added, ``ROUNDS`` at most. All mentions of the taken values are
spans of the kind that the patterns brought.

Only patterns can ever be confident whose occurrences are mostly followed by mentions,
so the others are dropped before the first round. To count the words of the rest, a
table of ``BUCKETS`` marks, the same at any size, tells which words and pairs can be
among them; what else falls in a marked bucket is dropped by the join with the patterns.

Matches are placed by the lengths of what lies between them, so each rule reads a text
with a match twice, others once. Rules are linear in the text's length: starts are bound
to the start of a run, repetitions give nothing back.

Edge cases: a null text is empty, an empty one has no spans; rows are judged one by
one, so repeated rows and rows with a null key have their own results; an empty table
gives an empty result. Mentions have at most ``LONGEST`` code points (no identifier is
longer); base spans have any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import let, saved, text_of, words_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
#: The plain rules. A match begins where a run begins, or where the match before it ended.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: What a text must have for a rule to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_TOKEN = r"A-Za-z0-9@._%+()/-"
#: A token with a digit or an at sign, and the number groups that follow it after single spaces.
MENTION = rf"(?<![{_TOKEN}])(?=[A-Za-z._%+()/-]*+[0-9@])[{_TOKEN}]++(?:\x20[(]?[0-9][0-9().-]*+)*+"
EDGES = "._%/()-"
SHORTEST, LONGEST, DIGITS = 5, 64, 3
#: Of the text before a mention so many characters are looked at for its last two words.
REACH = 160

SUPPORT, CONFIDENT, MOSTLY, ROUNDS = 3, 0.6, 0.5, 5
BUCKETS = 1 << 20
#: The most that one pattern says for a value.
CERTAIN = 0.99


def _sums(lengths: Column, chunk: int = 128) -> Column:
    """The sum of all elements before each one.

    In chunks, as an array that grows by one element is copied each time.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), none.alias("before"))

    def grown(values: Column, of) -> Column:
        return F.aggregate(values, start, lambda a, x: F.struct((a["sum"] + of(x)).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int")), lambda i: grown(F.slice(lengths, i * chunk + 1, chunk), lambda x: x))
    whole = let(chunks, lambda c: F.flatten(F.zip_with(c, grown(c, lambda x: x["sum"])["before"], lambda part, at: F.transform(part["before"], lambda x: x + at))))
    return F.when(F.size(lengths) == 0, none).otherwise(whole)


PLACED = "array<struct<start:bigint,value:string,before:string>>"


def placed(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with their starts and what lies between each and the one before."""

    def between(matches: Column) -> Column:
        def joined(parts: Column) -> Column:
            lengths = F.zip_with(parts, matches, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
            return let(
                _sums(lengths),
                lambda sums: F.transform(matches, lambda m, i: F.struct((F.get(sums, i) + F.length(F.get(parts, i))).alias("start"), m.alias("value"), F.get(parts, i).alias("before"))),
            )

        return F.when(F.size(matches) == 0, F.array().cast(PLACED)).otherwise(let(F.split(text, pattern, -1), joined))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), between)


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits end in their check digit."""
    full = F.lpad(digits, 20, "0")
    doubled = F.translate(full, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(1, 21):
        total = total + F.substring(doubled if i % 2 else full, i, 1).cast("int")
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the rule for ``kind`` is one of it."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))
    if kind == "card":
        return let(F.translate(value, " -", ""), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(10, 15)
    return F.lit(True)


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, k: int) -> Column:
    kind = KINDS[k]
    matches = F.filter(placed(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
    spans = F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["value"])).alias("end")))
    hint = HINTS[kind]
    return spans if hint is None else F.when(F.contains(text, F.lit(hint)), spans).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """(start, kind, end) of the plain rules, by start, then kind as listed."""
    return F.sort_array(F.concat(*(_spans(text, k) for k in range(len(KINDS)))))


def _holds(value: Column, kind: str) -> Column:
    return F.exists(F.regexp_extract_all(value, F.lit(PATTERNS[kind]), 0), lambda m: valid(kind, m))


def kind_of(value: Column) -> Column:
    """The first kind of which a mention holds a match, as its number; null for an unseen one."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        out = F.when(_holds(value, KINDS[k]), k).otherwise(out)
    return out


def mentions(text: Column) -> Column:
    """What looks like an identifier: (start, end, value, kind, one, two), the last being its patterns, null where there are no words."""

    def trimmed(m: Column) -> Column:
        left = F.ltrim(m["value"], F.lit(EDGES))
        words = words_of(F.lower(F.substring(m["before"], -REACH, REACH)))

        def of(v: Column, w: Column) -> Column:
            start = m["start"] + F.length(m["value"]) - F.length(left)
            last = F.get(w, F.size(w) - 1)
            return F.struct(
                start.alias("start"), (start + F.length(v)).alias("end"), F.lower(v).alias("value"), kind_of(v).alias("kind"),
                last.alias("one"), F.concat(F.get(w, F.size(w) - 2), F.lit(" "), last).alias("two"),
            )

        return let(F.rtrim(left, F.lit(EDGES)), lambda v: let(words, lambda w: of(v, w)))

    def looks(m: Column) -> Column:
        digits = F.length(m["value"]) - F.length(F.translate(m["value"], "0123456789", ""))
        return F.length(m["value"]).between(SHORTEST, LONGEST) & ((digits >= DIGITS) | F.contains(m["value"], F.lit("@")))

    return F.filter(F.transform(F.filter(placed(text, MENTION), lambda m: F.length(m["value"]) <= 2 * LONGEST), trimmed), looks)


def _bucket(words: Column) -> Column:
    return F.pmod(F.xxhash64(words), F.lit(BUCKETS)).cast("int")


def _marks(patterns: DataFrame) -> bytearray:
    """A byte for each bucket: 1 where a pattern falls in it. At most BUCKETS / 64 rows reach the driver."""
    at = patterns.select(_bucket(F.col("pattern")).alias("b"))
    packed = at.groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("bits"))
    out = bytearray(BUCKETS)
    for row in packed.collect():
        bits = row.bits & (1 << 64) - 1
        out[64 * row.w : 64 * row.w + 64] = bytes(int(c) for c in reversed(f"{bits:064b}"))
    return out


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, n``: how often the words of each of ``patterns`` stand in ``texts`` (``text``)."""
    marks = F.lit(_marks(patterns))
    marked = lambda x: F.substring(marks, _bucket(x) + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

    def hits(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))
        return F.concat(F.filter(w, marked), F.filter(pairs, marked))

    seen = texts.select(F.explode(let(words_of(F.lower("text")), hits)).alias("pattern"))
    return seen.groupBy("pattern").agg(F.count("*").alias("n")).join(patterns.select("pattern"), "pattern", "left_semi")


@dataclass(frozen=True)
class Learned:
    """What was learned: ``values`` (``value, kind, score``) and ``patterns`` (``pattern, kind, confidence``) of the last round."""

    values: DataFrame
    patterns: DataFrame


def learned(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> Learned:
    """Scores of unseen values by rounds over ``edges`` (``pattern, n, value, kind, occ``).

    ``totals``: ``value, total``, all mentions of each unseen value.
    """
    spark = edges.sparkSession
    values = spark.createDataFrame([], "value string, known int, score double")
    count, k = 0, F.coalesce("kind", "known")
    for _ in range(rounds):
        scored = edges.join(values, "value", "left").select("pattern", "n", k.alias("k"), "occ", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("score")).alias("s"))
        weighed = scored.where("k IS NOT NULL").groupBy("pattern", "n", "k").agg(F.sum(F.col("s") * F.col("occ")).alias("w"), F.sum("s").alias("behind"))
        confidence = F.col("w") / (F.col("n") + 1)
        patterns = saved(weighed.where((F.col("behind") >= SUPPORT) & (confidence >= CONFIDENT)).select("pattern", "k", confidence.alias("confidence")), "patterns")
        told = edges.where("kind IS NULL").join(patterns, "pattern")
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(CERTAIN))))
        # the one-word pattern of a mention holds its two-word one, so the mentions in confident contexts are counted by the larger of the two sums
        length = F.when(F.contains("pattern", F.lit(" ")), 2).otherwise(1)
        in_context = F.greatest(*[F.coalesce(F.sum(F.when(length == i, F.col("occ"))), F.lit(0)) for i in (1, 2)])
        judged = told.groupBy("value", "k").agg((1 - F.exp(doubt)).alias("score"), in_context.alias("occ"))
        taken = judged.join(totals, "value").where((F.col("score") >= CONFIDENT) & (F.col("occ") >= MOSTLY * F.col("total")))
        best = taken.groupBy("value").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
        values = saved(best.select("value", (-F.col("b.k")).alias("known"), F.col("b.score").alias("score")), "values")
        before, count = count, values.count()
        if count == before:
            break
    return Learned(values.withColumnRenamed("known", "kind"), patterns.withColumnRenamed("k", "kind"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, spans`` for every row: (start, kind, end) of the plain rules, and all; kinds are numbers in ``KINDS``."""
    texts = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    # what can hold a match at all: a digit or an at sign
    some = F.col("text").rlike("[0-9@]")
    none = lambda kind: F.array().cast(kind)
    mention = "array<struct<start:bigint,end:bigint,value:string,kind:int,one:string,two:string>>"
    table = saved(
        texts.select(
            "key", F.monotonically_increasing_id().alias("row"),
            F.when(some, base_spans(F.col("text"))).otherwise(none(SPANS)).alias("base"),
            F.when(some, mentions(F.col("text"))).otherwise(none(mention)).cast(mention).alias("mentions"),
        ),
        "mentions",
    )
    each = table.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    met = each.select("value", "kind", F.explode(F.array("one", "two")).alias("pattern")).where("pattern IS NOT NULL")
    edges = saved(met.groupBy("pattern", "value", "kind").agg(F.count("*").alias("occ")), "edges")
    sums = edges.groupBy("pattern").agg(F.count("*").alias("different"), F.sum("occ").alias("followed")).where(F.col("different") >= SUPPORT)
    patterns = saved(sums, "patterns-met")
    total = F.greatest("followed", F.coalesce("n", F.lit(0)))
    able = patterns.join(occurrences(texts, patterns), "pattern", "left").withColumn("n", total).where(F.col("followed") >= CONFIDENT * (F.col("n") + 1))
    narrow = saved(edges.join(able.select("pattern", "n"), "pattern"), "edges-of-patterns")
    unseen = narrow.where("kind IS NULL").select("value").distinct()
    totals = saved(each.where("kind IS NULL").join(unseen, "value", "left_semi").groupBy("value").agg(F.count("*").alias("total")), "totals")
    found = learned(narrow, totals)
    hit = each.where("kind IS NULL").select("row", "start", "end", "value").join(found.values.select("value", "kind"), "value")
    added = hit.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).cast(SPANS).alias("added"))
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"])))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", apart)))
    return table.join(added, "row", "left").select(F.col("key").alias(key), "base", spans.alias("spans"))
