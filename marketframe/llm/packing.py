"""Best-fit packing by hierarchical residual rounds.

Documents become pieces of at most ``capacity`` tokens. In the first round each
partition packs its pieces best-fit, largest first. Nearly full bins are done;
underfull ones go on as items of the next round, on fewer partitions, where
they are packed best-fit again, and so on up the tree until a round no longer
saves bins. The number of partitions follows the number of items, so that no
task gets more than about ``ITEMS`` of them, at any size of input.

Edge cases: a null or empty text is the end token alone; rows with a null or
repeated key are packed like any other; an empty table gives no rows. Only
documents longer than a sequence are cut, the first piece takes the remainder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import saved, text_of

CAPACITY = 1024
#: Items that a task packs at once.
ITEMS = 8_000
#: Bins filled to this share are done.
NEARLY_FULL = 0.98


def byte_bpe_encoder(json_file: str, ranks_file: str, pattern: str):
    """A loader of a function from a text to its ids.

    ``ranks_file`` holds the same vocabulary as ``json_file``; the ids are the
    same and come several times faster. Special strings are recognised in the
    text, as the tokenizers library does by default. Texts that the faster form
    refuses (millions of blanks in a row) are encoded by the library itself.
    """

    def load():
        import base64
        import json

        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        with open(json_file, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        slow: list[Tokenizer] = []

        def encode(text: str):
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                if not slow:
                    slow.append(Tokenizer.from_file(json_file))
                return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        return encode

    return load


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, load, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode, end = load(), np.array([end_id], dtype="<u4")
        for batch in batches:
            of, number, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(batch.column("text")):
                got = np.concatenate((encode(t.as_py()), end)).astype("<u4")
                for j, (s, n) in enumerate(cuts(len(got), capacity)):
                    of.append(i)
                    number.append(j)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(got[s : s + n].tobytes()))
                    if with_ids:
                        ids.append(got[s : s + n].astype("i8"))
            columns = [batch.column("key").take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInArrow(rows, schema).withColumnRenamed("key", key)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each item, in the given order, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is a bin with room r
    for i, size in enumerate(sizes):
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            left = room - size
        else:
            b, left = len(bins), capacity - size
            bins.append([i])
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def _round(items: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """Bins made of ``items`` (fill, members) by best fit within each of ``parts`` partitions."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        sizes, members = table.column("fill").to_pylist(), table.column("members").combine_chunks()
        bins = best_fit(sizes, capacity)
        flat, offsets = members.values, members.offsets.to_pylist()
        take, ends, n = [], [0], 0
        for b in bins:
            for i in b:
                take += range(offsets[i], offsets[i + 1])
            ends.append(len(take))
        out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(take, pa.int64())))
        ids = [(number << 54) + (part << 32) + n for n in range(len(bins))]
        fill = [sum(sizes[i] for i in b) for b in bins]
        yield from pa.table([pa.array(ids), pa.array(fill, pa.int64()), out], ["id", "fill", "members"]).to_batches(10_000)

    schema = items.schema["members"].dataType.simpleString()
    dealt = items.repartition(parts, "deal").sortWithinPartitions(F.desc("fill"), "deal")
    return dealt.select("fill", "members").mapInArrow(rows, f"id bigint, fill bigint, members {schema}")


def packed(made: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """``made`` (see ``pieces``, without ids; a table, not a plan to be run anew) with ``sequence_id`` and ``offset``."""
    member = F.struct(F.col(key).alias("key"), "piece", "start", "length", "ids_crc32")
    # equal rows are dealt by their places in the table too, so that they don't meet in one task
    deal = F.xxhash64(key, "piece", "ids_crc32", F.monotonically_increasing_id())
    items = made.select(F.col("length").alias("fill"), F.array(member).alias("members"), deal.alias("deal"))
    n, number, done = made.count(), 0, []
    while True:
        parts = max(1, -(-n // ITEMS))
        bins = saved(_round(items, number, parts, capacity), f"bins-{number}")
        left = bins.where(F.col("fill") < int(capacity * NEARLY_FULL))
        under = left.count()
        # fewer bins than items in this round: another can save some; nothing saved: stop
        if number and under > 0.999 * n or parts == 1 or not under or number == 12:
            done.append(bins)
            break
        done.append(bins.where(F.col("fill") >= int(capacity * NEARLY_FULL)))
        items = left.select("fill", "members", F.xxhash64(F.lit(number), "id").alias("deal"))
        n, number = under, number + 1
    full = done[0]
    for x in done[1:]:
        full = full.unionByName(x)
    before = lambda m: F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    placed = F.transform("members", lambda x, i: F.struct(x.alias("m"), before(F.slice("members", 1, i)).alias("offset")))
    one = full.select(F.col("id").alias("sequence_id"), F.explode(placed).alias("x"))
    return one.select(
        F.col("x.m.key").alias(key), "x.m.piece", "x.m.start", "x.m.length", "x.m.ids_crc32", "sequence_id", F.col("x.offset").alias("offset")
    )


def sequences(made: DataFrame, places: DataFrame, key: str = "doc_id") -> DataFrame:
    """``sequence_id, ids``: the packed token ids; ``made`` has ids, and (key, piece) is unique."""
    rows = made.select(key, "piece", "ids").join(places.select(key, "piece", "sequence_id", "offset"), [key, "piece"])
    listed = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return listed.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
