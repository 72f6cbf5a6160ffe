"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Of each of ``HASHES`` hash
functions the minimum over the set is found; bands of ``ROWS`` minima give the
candidates, and the low ``BITS`` bits of the minima, packed into words, give
an estimate of the similarity that is corrected for chance collisions (equal
low bits of unequal minima), by counting bits. Pairs that the estimate leaves
possible are confirmed on their full sets.

Copies (equal sets) form classes first, so that only one of them is compared.
Within a band's bucket all members are compared with its smallest one; members
of one component need no further comparison. In what is left, buckets whose
members are still in different components, those outside the largest component
are compared with all others in blocks, by the packed bits and then on the full
sets, each pair in the first bucket that it shares, so no link between different
texts is lost. Only links that join components are emitted. Rows of very
frequent sets, buckets and leaders are spread over the tasks.

With 32 bands of 5 rows a pair at exactly 0.8 misses every band with a
probability of 3e-6; the estimate's margin is five standard deviations.

Edge cases: null texts and texts without words have an empty set and are linked
with nothing; texts with fewer words than a shingle have their whole sequence as
one shingle; rows with a null key belong to no component and are kept; repeated
rows of one key are the same document and are kept or dropped together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import attached, hot_from, saved, text_of
from marketframe.llm.components import components

BANDS, ROWS, BITS = 32, 5, 4
HASHES = BANDS * ROWS
SHINGLE = 4
PERCENT = 80
#: What an estimate may fall short of the threshold: five standard deviations.
MARGIN = 0.17
#: Members of a bucket that are compared with each other at once.
BLOCK = 2048
#: Shingles of a block's members together, on average at most.
BLOCK_SHINGLES = 1_000_000

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_MIXERS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, A-Z in lower case."""
    data = np.frombuffer(text, dtype=np.uint8)
    word = ~_BLANK[data]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    place[: starts[0]] = 0
    h = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * (_POWERS[place & 255] + (place >> 8).astype(np.uint64))
    h[~word] = 0
    return _mix(np.add.reduceat(h, starts))


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _MIXERS[i]
    return np.unique(_mix(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 512):
        np.minimum(least, ((h[at : at + 512, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 / BITS of them to a word; rows are documents."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_hashes(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    return _mix((rows * _MIXERS[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MIXERS[9])


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, n, digest, bits, bands``: set size, digest of the set, packed low bits, band hashes (null for empty sets)."""

    def rows(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            size, digest, least = [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py().encode(), shingle)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                least.append(minima(s))
            if not size:
                continue
            m = np.stack(least)
            bits, bands = packed(m).astype(np.int64).tolist(), band_hashes(m).astype(np.int64).tolist()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                    pa.array([b if n else None for b, n in zip(bits, size, strict=True)], longs),
                    pa.array([b if n else None for b, n in zip(bands, size, strict=True)], longs),
                ],
                ["key", "n", "digest", "bits", "bands"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInArrow(
        rows, f"key {kind}, n bigint, digest binary, bits array<bigint>, bands array<bigint>"
    )


def estimated(a: Column, b: Column) -> Column:
    """Similarity from packed bits: the share of equal values, less the share that is equal by chance."""
    ones = int("1" * 64, 2) // ((1 << BITS) - 1)
    ones -= (ones >> 63) << 64
    fold = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    unequal = F.zip_with(a, b, lambda x, y: F.bit_count(fold(x.bitwiseXOR(y)).bitwiseAND(F.lit(ones))))
    equal = 1 - F.aggregate(unequal, F.lit(0), lambda s, x: s + x) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def possible(bits_a: Column, bits_b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether a pair can reach the threshold by its sizes and its estimate."""
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes & (estimated(bits_a, bits_b) >= percent / 100 - MARGIN)


#: Members of a bucket that are compared with one copy of its leader's text.
CHUNK = 512


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, with ``shared`` and ``total`` shingles.

    ``pairs``: a, b, members. Where one ``a`` meets very many others (``members``)
    they are dealt in chunks, each with one copy of its text, which is read first
    and held as a set while the others pass by.
    """
    # powers of two, so that one a has few different numbers of chunks
    chunks = F.expr(f"shiftleft(1L, cast(ceil(log2(greatest(members / {CHUNK}, 1))) AS INT))")
    dealt = pairs.select("a", "b", chunks.alias("of"), F.pmod(F.xxhash64("b"), chunks).alias("chunk"))
    right = dealt.join(texts.select(F.col("key").alias("b"), "text"), "b").select("a", "of", "chunk", "b", "text")
    left = dealt.select("a", "of", "chunk").distinct().join(texts.select(F.col("key").alias("a"), "text"), "a")
    left = left.select("a", "of", "chunk", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    group = ("a", "of", "chunk")
    both = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, F.asc_nulls_first("b"))

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, known = None, None
        for batch in batches:
            keep, shared, total = [], [], []
            ids = zip(*(batch.column(c).to_pylist() for c in group), strict=True)
            for i, (cell, other, text) in enumerate(zip(ids, batch.column("b").to_pylist(), batch.column("text"), strict=True)):
                own = shingle_set(text.as_py().encode(), shingle)
                if other is None:
                    at, known = cell, own
                    continue
                assert cell == at
                n = len(np.intersect1d(known, own, assume_unique=True))
                if n and 100 * n >= percent * (len(known) + len(own) - n):
                    keep.append(i)
                    shared.append(n)
                    total.append(len(known) + len(own) - n)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(take), batch.column("b").take(take), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"]
            )

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(rows, f"a {kind}, b {kind}, shared bigint, total bigint")


def _cells(members: DataFrame) -> DataFrame:
    """``members`` of mixed buckets dealt to cells (bucket, row, col).

    The members outside the bucket's main component (``side`` 0, in blocks by
    row) meet all members (``side`` 1, in blocks by column), so those of the main
    one are never compared with each other. ``rows`` and ``cols``: how many
    blocks the bucket has.
    """
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = members.withColumn("col", block("col", "cols")).withColumn("row", all_of("rows")).withColumn("side", F.lit(1))
    left = members.where("NOT main").withColumn("row", block("row", "rows")).withColumn("col", all_of("cols")).withColumn("side", F.lit(0))
    return left.unionByName(right).drop("rows", "cols")


CELL = ("bucket", "row", "col")


def _by_cell(batches: Iterator, columns: tuple[str, ...], sets=None):
    """(cell, columns of its rows) for rows that come sorted by cell; ``sets`` turns a text into its set as it comes."""
    cell, held = None, []
    for batch in batches:
        ids = zip(*(batch.column(c).to_pylist() for c in CELL), strict=True)
        plain = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        texts = batch.column("text") if sets else [None] * batch.num_rows
        for at, row, text in zip(ids, plain, texts, strict=True):
            if at != cell:
                if held:
                    yield cell, list(zip(*held, strict=True))
                cell, held = at, []
            held.append((*row, sets(text.as_py().encode())) if sets else row)
    if held:
        yield cell, list(zip(*held, strict=True))


def _candidates(bucket: int, rep, root, n, bits, bands, main, side, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): members that may be similar, are in different components, and meet in this bucket first."""
    ones, chance = np.uint64(int("1" * 64, 2) // ((1 << BITS) - 1)), 2.0**-BITS
    codes = {r: i for i, r in enumerate(dict.fromkeys(root))}
    places = {r: i for i, r in enumerate(sorted(set(rep)))}
    root, place = np.array([codes[r] for r in root]), np.array([places[r] for r in rep])
    n, main, side = np.array(n), np.array(main), np.array(side)
    bits, bands = np.array(bits, dtype=np.int64).view(np.uint64), np.array(bands, dtype=np.int64)
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        # two members outside the main component meet twice; the smaller one is taken from the left
        js = right[(root[right] != root[i]) & (main[right] | (place[right] > place[i]))]
        js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent]
        if not len(js):
            continue
        x = bits[js] ^ bits[i]
        x = x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)
        equal = 1 - np.bitwise_count(x & ones).sum(axis=1) / HASHES
        js = js[(equal - chance) / (1 - chance) >= percent / 100 - MARGIN]
        js = js[bands[js, (bands[js] == bands[i]).argmax(axis=1)] == bucket]
        if len(js):
            yield int(i), js


def _linked(bucket: int, rep, root, n, bits, bands, main, side, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of a cell that its full sets confirm and that join components.

    Shared shingles are counted through lists of the members that have each
    shingle, for all candidates of a member at once.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    having, ends = owner[order], np.cumsum(np.bincount(ids))
    begins, own_end = ends - np.bincount(ids), np.cumsum(size)
    codes = {r: i for i, r in enumerate(dict.fromkeys(root))}
    component = np.array([codes[r] for r in root])
    for i, js in _candidates(bucket, rep, root, n, bits, bands, main, side, percent):
        js = js[component[js] != component[i]]
        if not len(js):
            continue
        own = ids[own_end[i] - size[i] : own_end[i]]
        shared = np.bincount(np.concatenate([having[begins[x] : ends[x]] for x in own.tolist()]), minlength=len(sets))[js]
        for j in js[100 * shared >= percent * (size[i] + size[js] - shared)].tolist():
            if component[i] != component[j]:
                component[component == component[j]] = component[i]
                yield i, j


def across(members: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links (a, b) between components: enough of them to join what the full sets of a bucket's members join.

    ``members``: bucket, rep, root, n, bits, bands, main, rows, cols. The packed
    bits choose which members of a cell need their texts at all; then the cell's
    full sets are compared, and a pair that is already joined is passed over, so
    a cell gives fewer links than it has members, and no list of pairs is made.
    """
    kind = members.schema["rep"].dataType.simpleString()
    columns = ("rep", "root", "n", "bits", "bands", "main", "side")

    def need(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for cell, found in _by_cell(batches, columns):
            wanted: set[int] = set()
            for i, js in _candidates(cell[0], *found, percent):
                wanted.add(i)
                wanted.update(js.tolist())
            if wanted:
                at = sorted(wanted)
                rep, main, side = (pa.array([found[columns.index(c)][i] for i in at]) for c in ("rep", "main", "side"))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([cell[k]] * len(at), t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))), rep, main, side.cast(pa.int32())], [*CELL, "rep", "main", "side"]
                )

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for cell, found in _by_cell(batches, columns, lambda t: shingle_set(t, shingle)):
            rep = found[0]
            links = [(rep[i], rep[j]) for i, j in _linked(cell[0], *found, percent)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links, strict=True)], ["a", "b"])

    sort = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL, "side", "rep")
    known = members.select("rep", "root", "n", "bits", "bands").dropDuplicates(["rep"])
    wanted = sort(_cells(members)).select(*CELL, *columns).mapInArrow(need, f"bucket bigint, row int, col int, rep {kind}, main boolean, side int")
    wanted = saved(wanted, "cells")
    whole = wanted.join(known, "rep").join(texts.withColumnRenamed("key", "rep"), "rep")
    return sort(whole).select(*CELL, *columns, "text").mapInArrow(compare, f"a {kind}, b {kind}")


def _mixed(several: DataFrame, reps: DataFrame, hot: DataFrame) -> DataFrame:
    """Members (see ``across``) of the buckets whose members are in several components."""
    sized = several.join(reps.select("rep", "n"), "rep")
    parts = sized.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    of = parts.groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("m", "w", "root")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    # as many blocks as members or their shingles ask for
    blocks = lambda m, w: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    of = of.where("roots > 1").select(
        "bucket", F.col("top.root").alias("top"), blocks(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("rows"), blocks(F.col("m"), F.col("w")).alias("cols")
    )
    found = attached(several, saved(of, "mixed-buckets"), "bucket", hot).where("top IS NOT NULL")
    found = found.select("bucket", "rep", "root", (F.col("root") == F.col("top")).alias("main"), "rows", "cols")
    return saved(found.join(reps.select("rep", "n", "bits", "bands"), "rep"), "mixed")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = saved(signatures(docs, key, text, shingle), "signatures")
    sets = rows.where("n > 0 AND key IS NOT NULL")
    # equal sets have equal signatures
    reps = sets.groupBy("digest").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    reps = saved(reps, "classes")
    bands = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = saved(bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).where("members > 1"), "bucket-leaders")
    often = hot_from(BANDS * reps.count())
    hot = buckets.where(F.col("members") > often)
    met = saved(attached(bands, buckets, "bucket", hot).where("leader IS NOT NULL"), "buckets")
    texts = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    texts = saved(texts.join(met.select(F.col("rep").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"]), "texts")

    first = met.where("rep <> leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.max("members").alias("members"))
    bits = lambda side: reps.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
    # a leader of hot buckets has many pairs; any other has fewer than BANDS times those of a bucket that isn't hot
    leaders = hot.select(F.col("leader").alias("a")).distinct()
    first = attached(first, bits("a"), "a", leaders).join(bits("b"), "b")
    first = saved(first.where(possible(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "members"), "pairs")
    links = saved(confirmed(first, texts, percent, shingle).select("a", "b"), "links-1")
    roots = components(links)

    # a bucket of two has had its only pair compared
    several = met.where("members > 2").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    left = _mixed(saved(several.select("bucket", "rep", "root"), "several"), reps, hot)
    more = saved(across(left, texts, percent, shingle), "links-2")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    classes = reps.select("digest", "rep", "copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = saved(classes.select("digest", F.coalesce("root", "rep").alias("component"), "copies"), "components")
    common = classes.where(F.col("copies") > hot_from(rows.count()))
    out = attached(rows.select("key", "n", "digest"), classes.drop("copies"), "digest", common)
    component = F.coalesce("component", "key")
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that a smaller key of their group stands for."""
    dropped = grouped(docs, key, text, percent, shingle).where("NOT kept").select(key).distinct()
    return docs.join(dropped, key, "left_anti").select(*docs.columns)
