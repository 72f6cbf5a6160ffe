"""Removal of long repeats by column-wise construction over many documents.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere
else is removed. Equal texts are grouped first and stand as one, which all goes
if it is long enough. Texts are cut into segments by content: each window of
``LENGTH`` bytes has an anchor, its least hashed gram, and consecutive windows
with the same anchor form a segment. Equal windows have equal anchors at the
same distance, so windows of segments with different anchors need never be
compared, and segments are dealt to tasks by their anchor. Equal segments (by a
128-bit cryptographic digest) are counted; of the others with a shared anchor
one each enters the construction.

There, segments that share an anchor are lined up at it and read column by
column from the right: each round inserts one symbol of every segment, read in
place, and updates the order of all suffixes that start in the column by a
stable sort on the symbol, and their common prefixes by range minima; the
symbols before the suffixes, in that order, are the column of the collection's
(positional) Burrows-Wheeler transform. A suffix whose common prefix with a
neighbour reaches ``LENGTH`` starts a repeated window. A round reads order and
common prefixes of the one before in sequence and nothing older; both are held
by the task, since at most ``GROUPS`` segments and one more anchor's are lined up
at once.

Copies are pre-aggregated within each task before they are dealt. An anchor that
very many different segments share (the end of a passage that a third of all
documents quote) is split by the bytes that blocks of its windows hold, so that
its parts go through the construction in many tasks; where even single windows
are too many, they hold equal bytes, and are counted with map-side combining.

Edge cases: null texts are empty; texts shorter than ``LENGTH`` bytes keep all;
equal rows are copies of each other, so both lose what is long enough; rows with
a null key are documents like any other. Spans may begin or end within a
character, as the text is taken as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import attached, hot_from, saved, text_of

LENGTH = 200
GRAM = 24
#: Bytes of text that are cut into segments at once.
CHUNK = 1 << 20
#: Segments that are lined up at once; groups stay whole.
GROUPS = 20_000
#: Anchors with more different segments than this are split by content.
HOT = 2_000
#: Rows of one anchor that are held at once while they are counted.
HELD = 200_000
_POSITION = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(20240811)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(0, 1 << 62, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the grams at every place."""
    h, w = {1: _BYTES[data]}, 1
    while w < 16:
        h[2 * w] = h[w][:-w] * _STEPS[w.bit_length()] + h[w][w:]
        w *= 2
    n = len(data) - GRAM + 1
    return _mix(h[16][:n] * _STEPS[10] + h[8][16 : 16 + n])


def segments(data: np.ndarray, ends: np.ndarray, last: int | None = None) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash) of the segments of concatenated texts.

    ``ends``: where each text ends. Only windows that start before ``last`` count.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    if len(data) < LENGTH:
        return none
    grams = gram_hashes(data)
    # the least gram of each window, the leftmost of equal ones: the high bits of the hash, then the place
    least, w, span = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64), 1, LENGTH - GRAM + 1
    while w < 128:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    least = np.minimum(least[: len(least) - (span - 128)], least[span - 128 :])
    anchor = (least & _POSITION).astype(np.int64)
    left = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(len(data))
    p = np.flatnonzero(left[: len(anchor)] >= LENGTH)
    if last is not None:
        p = p[p < last]
    if not len(p):
        return none
    cuts = np.flatnonzero((np.diff(p) != 1) | (np.diff(anchor[p]) != 0)) + 1
    start, windows = p[np.concatenate(([0], cuts))], np.diff(np.concatenate(([0], cuts, [len(p)])))
    return start, windows, grams[anchor[start]]


def text_segments(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, anchor hash) of the segments of texts."""
    out, i = [], 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (size == 0 or size + len(raw[j]) <= CHUNK):
            size += len(raw[j])
            j += 1
        ends = np.cumsum([len(r) for r in raw[i:j]])
        begins = ends - [len(r) for r in raw[i:j]]
        if j == i + 1 and size > CHUNK:
            # a long text in parts; windows belong to the part that they start in
            for at in range(0, size, CHUNK):
                part = np.frombuffer(raw[i], np.uint8, min(size - at, CHUNK + LENGTH - 1), at)
                s, w, m = segments(part, np.array([len(part)]), CHUNK)
                out.append((np.full(len(s), i), s + at, w, m))
        else:
            s, w, m = segments(np.frombuffer(b"".join(raw[i:j]), np.uint8), ends)
            of = np.searchsorted(ends, s, side="right")
            out.append((of + i, s - begins[of], w, m))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), *segments(np.zeros(0, np.uint8), np.zeros(0)))


def rounds(group: np.ndarray, texts: list[bytes], shift: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, common) of every round of the construction, the last column first.

    ``group``: a number for each anchor; ``shift``: how far the anchor is from
    the segment's start. Column x of a segment is its byte at x from the anchor.
    ``order``: the segments by group and by what they hold from the column on,
    those without a byte there first; ``common``: how many bytes each shares with
    the one before it in the order.
    """
    n = len(texts)
    length = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    begin = np.cumsum(length) - length + shift  # where the anchor is
    order = np.argsort(group, kind="stable")
    common = np.zeros(n, dtype=np.int32)
    key_of = np.cumsum(np.concatenate(([0], np.diff(group[order]) != 0)))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = key_of * 512
    for x in range(int((length - shift).max()) - 1, -int(shift.max()) - 1, -1):
        # the symbol that each segment inserts: 0 where it has no byte
        has = (x >= -shift[order]) & (x < (length - shift)[order])
        now = np.where(has, data[np.where(has, begin[order] + x, -1)].astype(np.int64) + 1, 0)
        key = rank[order] + now
        by = np.argsort(key, kind="stable")
        same = np.zeros(n, dtype=bool)
        same[1:] = (key[by][1:] == key[by][:-1]) & (now[by][1:] > 0)
        new = np.zeros(n, dtype=np.int32)
        at = np.flatnonzero(same)
        if len(at):
            # the least common prefix from after the one neighbour to the other, in the order of the round before
            bounds = np.empty(2 * len(at), dtype=np.int64)
            bounds[0::2], bounds[1::2] = by[at - 1] + 1, by[at] + 1
            # the last bound may lie behind the end
            new[at] = np.minimum.reduceat(np.append(common, 0), bounds)[0::2] + 1
        order, common = order[by], new
        yield x, order, common


def transform(texts: list[bytes], shift: np.ndarray, x: int, order: np.ndarray) -> list[int]:
    """The column of the Burrows-Wheeler transform that goes with the order of column ``x``: the byte before each suffix, -1 where there is none."""
    at = [int(shift[i]) + x - 1 for i in order]
    return [texts[i][p] if 0 <= p < len(texts[i]) else -1 for i, p in zip(order.tolist(), at, strict=True)]


def repeated_windows(group: np.ndarray, texts: list[bytes], shift: np.ndarray) -> list[np.ndarray]:
    """For each segment the windows that are found in another segment of its group (see ``rounds``)."""
    who_of, where_of = [], []
    for x, order, common in rounds(group, texts, shift):
        hit = common >= LENGTH
        if hit.any():
            hit[:-1] |= hit[1:]
            who_of.append(order[hit])
            where_of.append(x + shift[order[hit]])
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    if who_of:
        who, where = np.concatenate(who_of), np.concatenate(where_of)
        o = np.lexsort((where, who))
        who, where = who[o], where[o]
        cuts = np.flatnonzero(np.diff(who)) + 1
        for i, w in zip(who[np.concatenate(([0], cuts))], np.split(where, cuts), strict=True):
            found[i] = w
    return found


def anchor_shift(text: bytes) -> int:
    """Where in a segment its anchor is: the leftmost least gram among those that all its windows hold."""
    grams = gram_hashes(np.frombuffer(text, np.uint8))
    windows = len(text) - LENGTH + 1
    held = grams[windows - 1 : LENGTH - GRAM + 1] & ~_POSITION
    return windows - 1 + int(np.argmin(held))


def _runs(windows: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(windows) != 1) + 1
    return [(int(r[0]), int(r[-1])) for r in np.split(windows, cuts)] if len(windows) else []


def grouped_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``v, z, n``: a digest of each different text, its bytes, compressed for the shuffles, and how many rows have it."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        to = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column("text")]
            v = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array([to.compress(r) for r in raw], pa.binary())], ["v", "z"])

    packed = docs.select(text_of(text).alias("text")).mapInArrow(rows, "v binary, z binary")
    return packed.groupBy("v").agg(F.first("z").alias("z"), F.count("*").alias("n"))


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, v``: the key of each row and the digest of its text."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            v = [hashlib.blake2b(t.as_py().encode(), digest_size=16).digest() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(v, pa.binary())], ["k", "v"])

    return docs.select(F.col(key).alias("k"), text_of(text).alias("text")).mapInArrow(rows, f"k {kind}, v binary")


CONTENT = ("m", "c", "d")


def shared_segments(texts: DataFrame) -> DataFrame:
    """Segments whose anchor occurs twice or more.

    ``v, start, windows``: where; ``twice``: the whole segment occurs again;
    ``anchor``: not null if it is to be compared with others of that anchor.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        met: set[tuple[int, int]] = set()
        for batch in batches:
            raw = [unpack.decompress(z.as_py()) for z in batch.column("z")]
            of, start, windows, m = text_segments(raw)
            if not len(of):
                continue
            parts = zip(of.tolist(), start.tolist(), (start + windows + LENGTH - 1).tolist(), strict=True)
            content = b"".join([hashlib.blake2b(raw[i][s:e], digest_size=16).digest() for i, s, e in parts])
            c, d = np.frombuffer(content, np.uint64).reshape(-1, 2).T
            # all but the first of equal segments in a task are known to occur twice, and so is that first one; they
            # are dealt at random, so that the copies of a frequent text don't meet in one task
            order = np.lexsort((d, c))
            equal = (c[order][1:] == c[order][:-1]) & (d[order][1:] == d[order][:-1])
            again, first = np.zeros(len(of), bool), np.zeros(len(of), bool)
            again[order[1:][equal]] = True
            first[order[:-1][equal]] = True
            first |= batch.column("n").to_numpy()[of] > 1
            sure = again.copy()
            for i in np.flatnonzero(first & ~again):
                mark = (int(c[i]), int(d[i]))
                if mark in met:
                    sure[i] = True  # a twin of it went out as known to occur twice
                elif len(met) < 500_000:
                    met.add(mark)
            deal = np.where(sure, _mix(m + c + start.astype(np.uint64) * _STEPS[5] + of.astype(np.uint64)), m)
            arrays = [batch.column("v").take(pa.array(of)), pa.array(start), pa.array(windows)]
            arrays += [pa.array(x.view(np.int64)) for x in (deal, m, np.ascontiguousarray(c), np.ascontiguousarray(d))] + [pa.array(np.where(sure, 2, np.where(first, 1, 0)).astype(np.int32))]
            out = pa.RecordBatch.from_arrays(arrays, ["v", "start", "windows", "deal", *CONTENT, "known"])
            for i in range(0, out.num_rows, 10_000):
                yield out.slice(i, 10_000)

    schema = "v binary, start bigint, windows bigint"
    rows = texts.mapInArrow(cut, f"{schema}, deal bigint, m bigint, c bigint, d bigint, known int")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "deal").sortWithinPartitions("deal", *CONTENT)
    return dealt.mapInArrow(_classified, f"{schema}, twice boolean, anchor bigint")


def _whole_groups(batches: Iterator, by: str, least: int = 1) -> Iterator:
    """Batches of ``least`` rows or more that end where a value of ``by`` ends; rows come sorted by it."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) <= least or held[0].column(by)[0] == batch.column(by)[-1]:
            continue
        rows = pa.concat_batches(held)
        values = rows.column(by).to_numpy()
        cut = int(np.searchsorted(values, values[-1], side="left"))  # the last group may go on
        yield rows.slice(0, cut)
        held = [rows.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def _classified(batches: Iterator) -> Iterator:
    """The rows whose anchor occurs twice, marked (see ``shared_segments``); rows come sorted by deal, anchor and content.

    An anchor with very many rows is passed on in parts: what is known of it
    so far (that it has several contents, that a content occurred before) goes
    on with the next part.
    """
    import pyarrow as pa

    held, many = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        deal = held.column("deal").to_numpy()
        cut = int(np.searchsorted(deal, deal[-1], side="left"))  # the last group may go on
        if cut:
            yield from _marked(held.slice(0, cut), many)
            held, many = held.slice(cut), False
        if held.num_rows > HELD:
            other = np.logical_or.reduce([(x := held.column(name).to_numpy()) != x[-1] for name in CONTENT])
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if last:
                many = True
                yield from _marked(held.slice(0, last), many)
                held = held.slice(last)
            if held.num_rows > 1:  # rows of one content: the first stays and is known to occur twice
                rest = held.slice(1)
                known = pa.array(np.full(rest.num_rows, 2, dtype=np.int32))
                yield from _marked(rest.set_column(rest.schema.get_field_index("known"), "known", known), many)
                first = held.slice(0, 1)
                held = first.set_column(first.schema.get_field_index("known"), "known", pa.array([1], pa.int32()))
    if held is not None:
        yield from _marked(held, many)


def _marked(batch, many: bool) -> Iterator:
    """Rows of whole groups; ``many``: the first group is known to have several contents."""
    import pyarrow as pa

    deal, m, c, d = (batch.column(x).to_numpy().view(np.uint64) for x in ("deal", *CONTENT))
    known = batch.column("known").to_numpy()
    sure = known == 2
    new_group = np.concatenate(([True], deal[1:] != deal[:-1]))
    new_content = new_group | np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (m[1:] != m[:-1])))
    g, t = np.cumsum(new_group) - 1, np.cumsum(new_content) - 1
    size, contents = np.bincount(g), np.bincount(g, weights=new_content)
    if many:
        size[0], contents[0] = size[0] + 1, contents[0] + 1
    twice = (np.bincount(t)[t] > 1) | (np.bincount(t, weights=known > 0)[t] > 0) | sure
    shared = (size[g] > 1) | twice
    enter = new_content & (contents[g] > 1) & ~sure
    keep = np.flatnonzero(shared)
    at = pa.array(keep)
    anchor = pa.array(m.view(np.int64)[keep], mask=~enter[keep])
    columns = [batch.column(x).take(at) for x in ("v", "start", "windows")]
    out = pa.RecordBatch.from_arrays([*columns, pa.array(twice[keep]), anchor], ["v", "start", "windows", "twice", "anchor"])
    for i in range(0, out.num_rows, 10_000):
        yield out.slice(i, 10_000)


SEGMENT = "v binary, start bigint, twice boolean, anchor bigint, segment binary"
SEGMENT_COLUMNS = ("v", "start", "twice", "anchor", "segment")


def _fetched(places: DataFrame, texts: DataFrame) -> DataFrame:
    """``places`` (v, start, windows, twice, anchor) with the bytes of the segments."""
    listed = places.groupBy("v").agg(F.collect_list(F.struct("start", "windows", "twice", "anchor")).alias("parts"))

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        of = zstandard.ZstdDecompressor()
        for batch in batches:
            parts = batch.column("parts")
            lengths = np.diff(parts.offsets.to_numpy())
            flat = parts.flatten()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            start, windows = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
            z, texts_of = batch.column("z"), {}
            made = []
            for i, s, w in zip(row.tolist(), start.tolist(), windows.tolist(), strict=True):
                if i not in texts_of:
                    texts_of = {i: of.decompress(z[i].as_py())}
                made.append(texts_of[i][s : s + w + LENGTH - 1])
            at = pa.array(row)
            arrays = [batch.column("v").take(at), flat.field("start"), flat.field("twice"), flat.field("anchor"), pa.array(made, pa.binary())]
            out = pa.RecordBatch.from_arrays(arrays, SEGMENT_COLUMNS)
            for i in range(0, out.num_rows, 10_000):
                yield out.slice(i, 10_000)

    return listed.join(texts, "v").select("v", "z", "parts").mapInArrow(rows, SEGMENT)


def _compared(fetched: DataFrame) -> DataFrame:
    """``v, first, last``: byte spans of repeated windows of segments that don't occur twice as a whole."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _whole_groups(batches, "anchor", GROUPS):
            anchor, twice = batch.column("anchor").to_numpy(), batch.column("twice").to_pylist()
            start = batch.column("start").to_pylist()
            texts = batch.column("segment").to_pylist()
            found = repeated_windows(anchor, texts, np.array([anchor_shift(t) for t in texts]))
            of, first, last = [], [], []
            for i, windows in enumerate(found):
                if not twice[i]:
                    for a, b in _runs(windows):
                        of.append(i)
                        first.append(start[i] + a)
                        last.append(start[i] + b + LENGTH)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("v").take(at), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["v", "first", "last"])

    parts = int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fetched.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(rows, "v binary, first bigint, last bigint")


def _split(segments: DataFrame, width: int) -> DataFrame:
    """Segments cut into blocks of ``width`` windows, with an anchor of their own for each block and content.

    Windows are told apart by how far their anchor is from their start, and a
    block takes ``width`` neighbouring distances. Its new anchor is a digest of
    the old one, the block, and the bytes that all its windows hold, so that
    equal windows stay together and most others part.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of, start, anchors, parts = [], [], [], []
            at = zip(batch.column("start").to_pylist(), batch.column("anchor").to_pylist(), batch.column("segment").to_pylist(), strict=True)
            for i, (s, anchor, text) in enumerate(at):
                shift, windows = anchor_shift(text), len(text) - LENGTH + 1
                for block in range((shift - windows + 1) // width, shift // width + 1):
                    first, last = max(0, shift - block * width - width + 1), min(windows - 1, shift - block * width)
                    if first > last:
                        continue
                    core = text[shift - block * width : shift - block * width - width + 1 + LENGTH]
                    digest = hashlib.blake2b(core, digest_size=8, key=f"{anchor}:{block}".encode()).digest()
                    of.append(i)
                    start.append(s + first)
                    anchors.append(int.from_bytes(digest, "little", signed=True))
                    parts.append(text[first : last + LENGTH])
            take = pa.array(of, pa.int64())
            arrays = [batch.column("v").take(take), pa.array(start, pa.int64()), batch.column("twice").take(take), pa.array(anchors, pa.int64()), pa.array(parts, pa.binary())]
            out = pa.RecordBatch.from_arrays(arrays, SEGMENT_COLUMNS)
            for i in range(0, out.num_rows, 10_000):
                yield out.slice(i, 10_000)

    return segments.mapInArrow(rows, SEGMENT)


def _parted(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments to compare, segments of anchors with more than ``HOT``); anchors with one segment are dropped."""
    counts = saved(segments.groupBy("anchor").count().where("count > 1"), "anchor-counts")
    some, hot = counts.where(F.col("count") <= HOT), counts.where(F.col("count") > HOT)
    return segments.join(some.select("anchor"), "anchor"), segments.join(hot.select("anchor"), "anchor")


def _equal_windows(windows: DataFrame) -> DataFrame:
    """Spans of single windows, split so far that an anchor stands for one content, that occur twice: counted by their bytes with map-side combining."""
    again = saved(windows.groupBy("anchor", "segment").count().where("count > 1").drop("count"), "equal-windows")
    found = windows.where("NOT twice").join(again, ["anchor", "segment"], "left_semi")
    return found.select("v", F.col("start").alias("first"), (F.col("start") + LENGTH).alias("last"))


def _removed(texts: DataFrame) -> DataFrame:
    """``v, n_bytes, kept, spans`` of texts ``v, z, n, marks``; a text that several rows have goes as a whole if it is long enough."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        of = zstandard.ZstdDecompressor()
        spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            size, kept, spans = [], [], []
            for z, n, m in zip(batch.column("z"), batch.column("n").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                data = of.decompress(z.as_py())
                found = sorted((x["first"], x["last"]) for x in m or ())
                if n > 1:
                    found = [(0, len(data))] if len(data) >= LENGTH else []
                joined: list[list[int]] = []
                for a, b in found:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                at, parts = 0, []
                for a, b in joined:
                    parts.append(data[at:a])
                    at = b
                size.append(len(data))
                kept.append(b"".join([*parts, data[at:]]))
                spans.append([{"first": a, "last": b} for a, b in joined])
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type)], ["v", "n_bytes", "kept", "spans"])

    return texts.select("v", "z", "n", "marks").mapInArrow(rows, f"v binary, n_bytes bigint, kept binary, spans {SPANS}")


SPANS = "array<struct<first:bigint,last:bigint>>"


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept, spans`` for every row of ``docs``.

    ``kept``: the bytes that stay; ``spans``: the maximal removed runs.
    """
    texts = saved(grouped_texts(docs, text), "texts")
    shared = saved(shared_segments(texts), "segments")
    places = shared.where("anchor IS NOT NULL")
    hot = saved(places.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    fetched = _fetched(places, texts)
    if hot.isEmpty():
        compared = _compared(fetched)
    else:
        # an anchor that very many different segments share is split by content, twice if need be, then window by window
        fetched = saved(fetched, "fetched")
        few, many = [fetched.join(hot, "anchor", "left_anti")], fetched.join(hot.select("anchor"), "anchor", "left_semi")
        for width in (32, 4):
            some, many = _parted(saved(_split(many.select(*SEGMENT_COLUMNS), width), f"split-{width}"))
            few.append(some)
        single = saved(_split(many.select(*SEGMENT_COLUMNS), 1), "split-1")
        rows_of = few[0].select(*SEGMENT_COLUMNS)
        for x in few[1:]:
            rows_of = rows_of.unionByName(x.select(*SEGMENT_COLUMNS))
        compared = _compared(rows_of).unionByName(_equal_windows(single))
    whole = shared.where("twice").select("v", F.col("start").alias("first"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("last"))
    marks = whole.unionByName(compared).groupBy("v").agg(F.collect_list(F.struct("first", "last")).alias("marks"))

    # the texts of very many rows keep fewer than LENGTH bytes, so their results are narrow
    often = hot_from(docs.count())
    common = texts.where(F.col("n") > often)
    known = _removed(common.withColumn("marks", F.lit(None).cast(SPANS)))
    rest = _removed(texts.where(F.col("n") <= often).join(marks, "v", "left"))
    out = attached(digests(docs, key, text), rest, "v", common, known)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["last"] - x["first"])
    return out.select(F.col("k").alias(key), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept", "spans")
