import hashlib
import zlib
from collections import Counter

import pytest

from marketframe.llm import sharding as sh


def check(df, rows, shards):
    got = sh.interleaved(df, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = Counter(r.shard for r in got)
    sizes = [by.get(j, 0) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for j in range(shards):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sizes[j]))
    return got


@pytest.mark.parametrize("bucket", [3, 20_000])
@pytest.mark.parametrize("shards", [1, 7, 200])
def test_shards(docs, corpus, monkeypatch, bucket, shards):
    monkeypatch.setattr(sh, "BUCKET_ROWS", bucket)
    check(docs, corpus, shards)


def test_any_buckets_give_the_same(docs, monkeypatch):
    place = lambda: {(r.doc_id, r.shard, r.slot) for r in sh.interleaved(docs, 7).collect()}
    whole = place()
    monkeypatch.setattr(sh, "BUCKET_ROWS", 4)
    assert place() == whole


def test_mixture(spark):
    rows = [(i, "x", "en", "big" if i % 3 else ("mid" if i % 2 else None), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = check(df, rows, 10)
    for source, n in Counter(r[3] for r in rows).items():
        each = [sum(r.source == source and r.shard == j for r in got) for j in range(10)]
        assert max(each) - min(each) <= 3 and sum(each) == n
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)


def test_files(spark, docs, tmp_path):
    df = docs.where("doc_id < 900")
    sh.write_shards(df, sh.interleaved(df, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == df.count() and back.select("shard").distinct().count() == 4


def test_empty(empty):
    assert sh.interleaved(empty, 5).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a", None, "s", 1)] * 5 + [(None, None, None, None, None)] * 2
    check(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), rows, 3)


def test_against_plain_placement(docs, corpus):
    """Ranks, fractions and cuts by sorting everything in one list."""
    digest = lambda x: hashlib.md5(f"17:{x}".encode()).hexdigest()
    by_source = {}
    for i, t, _, source, _ in corpus:
        data = (t or "").encode()
        by_source.setdefault("" if source is None else "=" + source, []).append((digest(i), i, zlib.crc32(data), len(data) + 16))
    everything = []
    for s, rows in by_source.items():
        u = (int(digest(s)[:6], 16) + 0.5) / 2**24
        everything += [((r + u) / len(rows), s, o, i) for r, (o, i, *_) in enumerate(sorted(rows))]
    everything.sort()
    n = len(everything)
    for shards in (1, 7, 40):
        want = {}
        for p, (*_, i) in enumerate(everything):
            shard = p * shards // n
            want[i] = (shard, p - -(-shard * n // shards))
        assert {r.doc_id: (r.shard, r.slot) for r in sh.interleaved(docs, shards).collect()} == want


def test_hot_keys_and_tiny_sources(spark, monkeypatch):
    monkeypatch.setattr(sh, "BUCKET_ROWS", 5)
    rows = [(None, "a", None, "s", 1)] * 300 + [(7, "b", None, "s", 1)] * 200 + [(1000 + i, "c", None, f"t{i}", 1) for i in range(300)]
    got = check(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), rows, 8)
    each = [sum(r.source == "s" and r.shard == j for r in got) for j in range(8)]
    assert max(each) - min(each) <= 30  # sources of one row are spread over all shards
