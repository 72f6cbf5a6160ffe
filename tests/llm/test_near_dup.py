import random
import re

import numpy as np
import pytest

from marketframe.llm import near_dup as nd
from marketframe.llm.components import components


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n=4, percent=80):
    sets = [shingles(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {rows[i][0]: (len(sets[i]), least[find(i)]) for i in range(len(rows))}


def check(df, rows, **how):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.grouped(df, **how).collect()}
    assert got == brute(rows, how.get("shingle", 4), how.get("percent", 80))


@pytest.mark.parametrize("shingle", [4, 5])
def test_corpus(docs, corpus, shingle):
    check(docs, corpus, shingle=shingle)


def chain(rng, n, edits):
    """Texts of which neighbours are alike but the ends aren't."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    out = []
    for _ in range(n):
        out.append(" ".join(words))
        for _ in range(edits):
            words[rng.randrange(100)] = f"w{rng.randrange(10**6)}"
    return out


def test_chains_and_strangers(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(5)
    texts = [t for _ in range(4) for t in chain(rng, 30, 2)]
    base = chain(rng, 1, 0)[0].split(" ")
    for _ in range(60):  # a template: many pairs just below and just above the threshold
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows)


def test_estimate(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        n = 2000
        a = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        size = int(2 * n * j / (1 + j))  # shared values of two sets of n
        x, y = a[:n], np.concatenate((a[:size], a[n : 2 * n - size]))
        rows = [nd.packed(nd.minima(s)[None, :])[0].astype(np.int64).tolist() for s in (x, y)]
        got = spark.createDataFrame([tuple(rows)], "a array<bigint>, b array<bigint>").select(nd.estimated(F.col("a"), F.col("b"))).first()[0]
        assert abs(got - size / (2 * n - size)) < nd.MARGIN


def test_signature_is_of_the_whole_text():
    a = b" ".join(str(i).encode() for i in range(20000))
    s = nd.shingle_set(a)
    assert len(s) == 19997
    assert (nd.minima(s) == ((s >> np.uint64(32)).astype(np.uint32)[:, None] ^ nd._XOR).__mul__(nd._MUL).min(axis=0)).all()
    assert len(nd.shingle_set(b"x" * 100000)) == 1 and nd.shingle_set(b"x" * 1000)[0] != nd.shingle_set(b"x" * 1001)[0]


def test_odd_rows(spark, empty):
    assert nd.grouped(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "A  b c\nd e"), (8, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in nd.grouped(df).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("8", 8, True), ("None", 5, True)]
    assert nd.deduplicated(df).count() == 4


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(500, i) for i in range(501, 560)] + [(9, 9)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}
