"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each should take.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. Bigrams are ordered by how many words hold them, rare ones first. The
prefix of a word is its first three bigrams in this order; two of the three are
disjoint, and dynamic programming picks the disjoint pair of least total count as
the word's pivots. One edit hits one of two disjoint pivots at most, so of two near
words the one whose prefix ends first has a pivot among the other's prefix grams.

Position limits: if the edit is behind the first pivot, all up to this pivot's end
stays; else all from the second pivot's start stays. So the first pivot is looked up
by its place from the start and what precedes it, the second by its place from the
end and what follows it. Of what lies on the far side of the pivot, either the next
few code points or all others are unchanged too and are part of the key, which keeps
the lists of a key short in a vocabulary of any size. Keys are 64-bit hashes: a collision only adds a candidate,
and every candidate is verified by its edit distance. No link is lost.

The order needs to be total, not exact: bigrams are counted in ``BUCKETS`` buckets,
and those of one bucket count as the same gram. These counts, fixed in number for
any alphabet, are all that is sent to every task. All joins are by shuffle: Spark sizes
a table by its compressed file, and takes the entries, some forty rows a word, for
little more than the words themselves, so by its own choice it would broadcast them.

A word's form is its near word with the largest count (ties: the least in
code-point order), if that count is at least ``ratio`` times its own; roots follow
forms to the last by pointer doubling. Counts grow along forms, so there is no cycle.

Edge cases: a null or empty text has no words; a null key counts as an empty string
in the hash that deletes code points; repeated rows count repeatedly; an empty table
gives an empty result. Words of any length are handled whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import saved, text_of

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5
#: One in so many runs loses a code point.
SLIP = 199
BUCKETS = 1 << 16
#: Bigrams of a prefix: an edit changes two at most, so of three one is left, and the first and last in the word are disjoint.
PREFIX = 3
#: An edit brings two bigrams at most, which can push an equal gram so far behind the third.
TIES = 2
#: Code points beside the part of a word that stays, which stay as well if the edit is farther off.
NEAR = 3


def lowered(run: Column) -> Column:
    """``run`` with A-Z in lower case; most have none, which a comparison tells sooner than a replacement."""
    return F.when(run == F.lower(run), run).otherwise(F.translate(run, CAPITALS, CAPITALS.lower()))


def slipped(run: Column, before: Column, slip: int = SLIP) -> Column:
    """``run`` without one code point where ``slip`` divides the CRC of ``before`` and ``run``."""
    h = F.crc32(F.concat(before, run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts with so many code points and occurrences at least."""
    before = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("before")
    # a shorter run can't become a word
    runs = docs.select(before, F.explode(F.regexp_extract_all(text_of(text), F.lit(f"{LETTERS}{{{least_length},}}"), 0)).alias("run"))
    words = runs.select("before", lowered(F.col("run")).alias("run")).select(slipped(F.col("run"), F.col("before")).alias("word"))
    words = words.where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def gram_counts(words: DataFrame) -> list[int]:
    """How many bigrams of ``words`` fall in each bucket."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("g"))
    counted = grams.groupBy(F.pmod(F.crc32(F.col("g").cast("binary")), F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n"))
    out = [0] * BUCKETS
    for row in counted.collect():  # BUCKETS rows at most
        out[row.b] = row.n
    return out


def prefix_of(word: str, rank) -> tuple[list[int], int]:
    """Where the prefix grams of ``word`` start, by rank and place, and the rank of the third.

    Grams of the third's rank that follow it are in too, as far as an edit can push one.
    """
    items = sorted((int(rank[bucket(word[i : i + 2])]), i) for i in range(len(word) - 1))
    last = items[PREFIX - 1][0]
    return [i for r, i in items[: PREFIX + TIES] if r <= last], last


def pivots_of(word: str, starts: list[int], weight) -> tuple[int, int]:
    """The two disjoint grams among ``starts`` of least total weight, in order of place.

    Dynamic programming over the places: the best single gram that ends before
    each place, then the best pair.
    """
    best, single, waiting = None, None, []
    for i in sorted(starts):
        w = int(weight[bucket(word[i : i + 2])])
        while waiting and waiting[0][1] <= i - 2:
            single = min(filter(None, (single, waiting.pop(0))))
        if single is not None:
            best = min(filter(None, (best, (single[0] + w, single[1], i))))
        waiting.append((w, i))
    return best[1], best[2]


def keys_of(word: str, i: int, from_start: bool, lengths: Iterable[int]) -> Iterator[str]:
    """The keys of the gram at ``i`` towards words of ``lengths``: what a pivot of such a word, looked up, would have.

    The part up to (or from) the gram stays; of the rest of the pivot's word, either
    the ``NEAR`` code points beside this part stay (or none, where the rest is shorter), or all others.
    """
    size = len(word)
    kept = i + 2 if from_start else size - i
    sides = set()
    for length in lengths:
        rest = length - kept
        if rest < 0:
            continue
        near = NEAR if rest >= NEAR else 0
        if near not in sides and kept + near <= size:
            sides.add(near)
            yield f"{kept}n{near}{from_start:d}" + (word[: kept + near] if from_start else word[size - kept - near :])
        if (far := rest - near) + kept <= size:
            yield f"{kept}f{length}{from_start:d}" + (word[:kept] + word[size - far :] if from_start else word[:far] + word[size - kept :])


def asked(word: str, rank, weight) -> tuple[list[str], int]:
    """The keys that the pivots of ``word`` are looked up by, and the rank of its last prefix gram."""
    starts, last = prefix_of(word, rank)
    first, second = pivots_of(word, starts[:PREFIX], weight)
    return [*keys_of(word, first, True, [len(word)]), *keys_of(word, second, False, [len(word)])], last


def held(word: str, rank, weight) -> tuple[list[str], int]:
    """The keys that ``word`` is found by, and the rank of its last prefix gram."""
    starts, last = prefix_of(word, rank)
    lengths = (len(word) - 1, len(word), len(word) + 1)
    return [k for i in starts for side in (True, False) for k in keys_of(word, i, side, lengths)], last


def _entries(words: DataFrame, of: Callable, counts: list[int]) -> DataFrame:
    """``k, word, n, last``: a row for each key that ``of`` (``asked`` or ``held``) gives a word."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        weight = np.array(counts, dtype=np.int64)
        rank = np.empty(BUCKETS, dtype=np.int64)
        rank[np.lexsort((np.arange(BUCKETS), weight))] = np.arange(BUCKETS)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys, which, lasts = [], [], []
                for j, word in enumerate(batch.column(0).to_pylist()):
                    mine, last = of(word, rank, weight)
                    keys += [xxhash.xxh64_intdigest(k) for k in mine]
                    which += [j] * len(mine)
                    lasts += [last] * len(mine)
                own = batch.take(pa.array(which, pa.int64()))
                columns = [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), own.column(0), own.column(1), pa.array(lasts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "word", "n", "last"])

    return words.select("word", "n").mapInArrow(rows, "k bigint, word string, n bigint, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, na, b, nb``: each two near words of ``words`` (``word, n``; different words of three code points or more) once."""
    counts = gram_counts(words)
    names = lambda df, x: df.select("k", *[F.col(c).alias(x + c) for c in ("word", "n", "last")])
    asks, holds = names(_entries(words, asked, counts), "p"), names(_entries(words, held, counts), "q")
    met = asks.join(holds.hint("merge"), "k").where("plast <= qlast AND pword <> qword AND abs(length(pword) - length(qword)) <= 1").where(F.levenshtein("pword", "qword", 1) == 1)
    one, two = F.struct(F.col("pword").alias("w"), F.col("pn").alias("n")), F.struct(F.col("qword").alias("w"), F.col("qn").alias("n"))
    pairs = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("na"), F.col("y.w").alias("b"), F.col("y.n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to the last.

    Each round doubles the steps that a pointer spans; counts grow at least
    ``RATIO``-fold a step, so five rounds serve any table.
    """
    now = saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(now.join(then.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (``word, n``)."""
    words = saved(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m"))
    )
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    takes = -F.col("best.m") >= ratio * F.col("n")
    found = saved(
        words.join(near.hint("merge"), "word", "left").select(
            "word", F.when(takes, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(takes, -F.col("best.m")).alias("form_n"),
        ),
        "variants",
    )
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
