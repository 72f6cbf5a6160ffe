import collections
import os.path
import random
import time

import numpy as np
from pyspark.sql import functions as F

from marketframe.llm import repeats as rp


def brute(texts):
    """(removed, spans, kept) of each text, by a dictionary of all strings of the length."""
    n, seen = rp.LENGTH, collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def check(df, rows):
    got = collections.defaultdict(list)
    for r in rp.repeats(df).collect():
        got[r.doc_id].append((r.n_removed, r.n_spans, bytes(r.kept)))
        assert sum(s.last - s.first for s in r.spans) == r.n_removed and r.n_bytes == r.n_removed + len(r.kept)
    want = collections.defaultdict(list)
    for (i, *_), x in zip(rows, brute([r[1] for r in rows]), strict=True):
        want[i].append(x)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_corpus(docs, corpus):
    check(docs, corpus)


def test_periodic_and_hot(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = word(450)
    rows = [(i, word(60) + hot + word(40)) for i in range(40)]
    rows += [(100, "abcde" * 100), (101, "abcde" * 41 + "X"), (102, "a" * 200), (103, "a" * 201), (104, word(199)), (105, word(150) * 2), (None, hot[100:320]), (106, word(1000)), (106, word(500)), (107, hot), (107, hot)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows)


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(rp, "HOT", 5)
    monkeypatch.setattr(rp, "HELD", 7)
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, few = word(230), [word(3) for _ in range(6)]
    rows = [(i, word(80) + hot + rng.choice(few) + word(60)) for i in range(60)]
    rows += [(100 + i, word(90) + hot[: rng.randrange(190, 215)] + word(30)) for i in range(30)]
    rows += [(200 + i, hot) for i in range(20)] + [(300 + i, hot[:199] + rng.choice("xyz")) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rp, "CHUNK", 700)
    rng = random.Random(5)
    a = "".join(rng.choice("abcdef") for _ in range(5000))
    raw = [a.encode(), (a[1000:1900] + "Z" + a[300:700]).encode(), b""]
    of, start, windows, m = rp.text_segments(raw)
    covered = sorted((int(i), int(s) + k) for i, s, w in zip(of, start, windows, strict=True) for k in range(w))
    assert covered == [(i, p) for i, b in enumerate(raw) for p in range(len(b) - rp.LENGTH + 1)]


def test_equal_windows_share_their_anchor():
    rng = random.Random(6)
    a = bytes(rng.choice(b"ab") for _ in range(600))
    raw = [a, b"x" * 37 + a[100:500] + b"yy"]
    of, start, windows, m = rp.text_segments(raw)
    anchor = {(int(i), int(s) + k): int(h) for i, s, w, h in zip(of, start, windows, m, strict=True) for k in range(w)}
    for p in range(100, 301):
        assert anchor[0, p] == anchor[1, p - 100 + 37]


def test_construction_against_brute_force():
    rng = random.Random(7)
    texts, group = [], []
    for g in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(420))
        for _ in range(rng.randrange(1, 6)):
            s, e = rng.randrange(0, 60), rng.randrange(300, 376)
            t = bytearray(base[s:e])
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(b"abc")
            texts.append((g, s, bytes(t)))
    group = np.array([g for g, _, _ in texts])
    got = rp.repeated_windows(group, [t for _, _, t in texts], np.array([60 - s for _, s, _ in texts]))
    for i, (g, s, t) in enumerate(texts):
        want = []
        for p in range(len(t) - rp.LENGTH + 1):
            for j, (g2, s2, t2) in enumerate(texts):
                q = p + s - s2
                if j != i and g2 == g and q >= 0 and t2[q : q + rp.LENGTH] == t[p : p + rp.LENGTH] and len(t2) >= q + rp.LENGTH:
                    want.append(p)
                    break
        assert got[i].tolist() == want


def test_empty(empty):
    assert rp.repeats(empty).count() == 0


def test_string_keys(docs):
    assert rp.repeats(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).where("n_removed > 0").count() > 5


def test_rounds_keep_the_transform_and_common_prefixes():
    """Every round's order, transform and common prefixes against sorting the suffixes."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    shift = np.array([rng.randrange(len(t)) for t in texts])
    group = np.array([rng.randrange(4) for _ in texts])
    suffix = lambda i, x: texts[i][shift[i] + x :] if 0 <= shift[i] + x else b""
    seen = []
    for x, order, common in rp.rounds(group, texts, shift):
        seen.append(x)
        rest = [(int(group[i]), suffix(i, x)) for i in order]
        assert sorted(rest) == rest
        for a, b, n in zip(rest, rest[1:], common[1:]):
            assert n == (len(os.path.commonprefix([a[1], b[1]])) if a[0] == b[0] else 0)
        before = [texts[i][shift[i] + x - 1] if 0 < shift[i] + x <= len(texts[i]) else -1 for i in order]
        assert rp.transform(texts, shift, x, order) == before
    assert seen == list(range(max(len(t) - s for t, s in zip(texts, shift)) - 1, -max(shift) - 1, -1))


def test_many_equal_rows_take_no_longer(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    text, part = word(3000), word(250)
    rows = [(1, text)] * 3000 + [(None, text)] * 3000 + [(2, word(50) + part), (3, part + word(60)), (4, text[500:900] + word(10))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    began = time.time()
    got = rp.repeats(df).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {(r.doc_id, r.n_removed, r.n_spans, r["count"]) for r in got} == {(1, 3000, 1, 3000), (None, 3000, 1, 3000), (2, 250, 1, 1), (3, 250, 1, 1), (4, 400, 1, 1)}
    assert time.time() - began < 60
