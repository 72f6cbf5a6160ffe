import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketframe.llm import packing as pk

JSON = public_tokenizers.path("byte_bpe_50k.json")
LOAD = pk.byte_bpe_encoder(JSON, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_ids_are_those_of_the_library(corpus):
    slow, fast = Tokenizer.from_file(JSON), LOAD()
    texts = [t for _, t, *_ in corpus if t] + ["<|endoftext|> x <|endoftext|>", "a<|endoftext|", "\x00　 \n\n\t x", "ﬁ ſ İ 中文 😀", "a" * 5000, " " * 999]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_texts_that_the_fast_form_refuses():
    text = " " * 3_000_000 + "x<|endoftext|>"
    assert LOAD()(text).tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(pk, "ITEMS", 100)
    made = pk.pieces(spark.createDataFrame([(None, "a b c")] * 1000, "doc_id bigint, text string"), LOAD, 2, 64)
    first = pk.packed(made, 64).groupBy("sequence_id").count().toPandas()
    assert first["count"].sum() == 1000 and len(first) <= 1000 * made.first().length / 64 * 1.1 + 1


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cuts(n):
    got = pk.cuts(n)
    assert sum(x for _, x in got) == n and all(x == 1024 for _, x in got[1:]) and 0 < got[0][1] <= 1024
    assert [s for s, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]


def test_best_fit_is_best_fit():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    bins = pk.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300))
    rooms = []
    for s in sizes:
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms[rooms.index(min(fits))] -= s
        else:
            rooms.append(100 - s)
    assert sorted(100 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)


def check(df, rows, capacity):
    made = pk.pieces(df, LOAD, 2, capacity, with_ids=True).cache()
    got = pk.packed(made.drop("ids"), capacity).toPandas()
    enc = Tokenizer.from_file(JSON)
    want = []
    for k, text, *_ in rows:
        ids = enc.encode(text or "", add_special_tokens=False).ids + [2]
        want += [(k, j, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())) for j, (s, n) in enumerate(pk.cuts(len(ids), capacity))]
    none = lambda v: -1 if v is None or v != v else int(v)
    assert sorted((none(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == sorted((none(k), *x) for k, *x in want)
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum()[:-1]] and bin_.length.sum() <= capacity
    return got, made


def test_corpus(docs, corpus):
    got, made = check(docs, corpus, 128)
    bins, least = got.sequence_id.nunique(), math.ceil(got.length.sum() / 128)
    assert bins <= least * 1.02 + 1
    packed = pk.packed(made.drop("ids"), 128)
    seqs = {r.sequence_id: r.ids for r in pk.sequences(made.where("doc_id is not null"), packed.where("doc_id is not null")).collect()}
    assert sum(map(len, seqs.values())) == got[got.doc_id.notna()].length.sum()
    made.unpersist()


def test_many_rounds(docs, corpus, monkeypatch):
    monkeypatch.setattr(pk, "ITEMS", 10)
    got, made = check(docs, corpus, 64)
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 64) * 1.06
    made.unpersist()


def test_odd_rows(spark, empty):
    assert pk.packed(pk.pieces(empty, LOAD, 2)).count() == 0
    rows = [(None, None), (1, "a"), (1, "a"), (1, ""), (2, "word " * 3000)]
    got, made = check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 1024)
    assert len(got) == 4 + 3
    made.unpersist()
