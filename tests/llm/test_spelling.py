import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketframe.llm import spelling


def near(a: str, b: str) -> bool:
    """One edit apart, by trying every place."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts: dict, ratio=5) -> dict:
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        takes = best is not None and counts[best] >= ratio * n
        out[w] = [best if takes else None, n, len(others), counts[best] if takes else None]
    for w in counts:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def counted(rows, slip=199) -> dict:
    counts: dict = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def result(df) -> dict:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@settings(max_examples=1500, deadline=None)
@given(st.text("abé", min_size=6, max_size=12), st.integers(0, 12), st.sampled_from("abcé"), st.integers(0, 2), st.integers(0, 5))
def test_near_words_share_a_key(word, at, new, kind, seed):
    """Whatever the order of grams, one of two near words asks for a key of the other."""
    at = min(at, len(word) - 1)
    other = (word[:at] + new + word[at:], word[:at] + word[at + 1 :], word[:at] + new + word[at + 1 :])[kind]
    if other == word or len(other) < 4:
        return
    weight = np.random.default_rng(seed).integers(0, 3, spelling.BUCKETS)
    rank = np.empty(spelling.BUCKETS, dtype=np.int64)
    rank[np.lexsort((np.arange(spelling.BUCKETS), weight))] = np.arange(spelling.BUCKETS)
    (a1, l1), (a2, l2) = (spelling.asked(w, rank, weight) for w in (word, other))
    (h1, _), (h2, _) = (spelling.held(w, rank, weight) for w in (word, other))
    assert (l1 <= l2 and set(a1) & set(h2)) or (l2 <= l1 and set(a2) & set(h1))


def test_pivots_are_disjoint_and_least():
    rng, weight = random.Random(3), np.random.default_rng(3).integers(0, 9, spelling.BUCKETS)
    for _ in range(300):
        word = "".join(rng.choice("abcdef") for _ in range(9))
        starts = sorted(rng.sample(range(8), 5))
        w = lambda i, word=word: int(weight[spelling.bucket(word[i : i + 2])])
        a, b = spelling.pivots_of(word, starts, weight)
        assert a + 2 <= b and w(a) + w(b) == min((w(x) + w(y) for x in starts for y in starts if x + 2 <= y), default=None)


def test_against_all_pairs(spark):
    rng, counts = random.Random(5), {}
    for _ in range(150):
        base = "".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 10)))
        counts[base] = rng.choice([5, 30, 200, 5000])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(base))
            base = rng.choice([base[:i] + base[i + 1 :], base[:i] + "b" + base[i:], base[:i] + "e" + base[i + 1 :]])
            if len(base) >= 6:
                counts.setdefault(base, rng.choice([5, 6, 25, 26, 130, 700]))
    counts |= {"aaaaaaaaaa": 50, "aaaaaaaaa": 5, "aaaaaaaaaaa": 250, "a" * 3000: 9, "a" * 2999 + "b": 60, "a" * 3001: 9}
    got = result(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert got == plain(counts)
    assert sum(v[0] is not None for v in got.values()) > 50 and any(v[0] not in (None, v[1]) for v in got.values())


def test_texts_to_variants(spark):
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(bases) if rng.random() < 0.98 else rng.choice(bases)[1:] for _ in range(400))) for i in range(30)]
    rows += [(None, "Übung ÜBUNGEN übungen; " * 20), (None, None), (77, ""), (78, None), (79, "x" * 10_000 + " " + "y" * 5), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS word", "'c' AS n", "'c' AS key", "'c' AS run")
    words = spelling.vocabulary(df)
    assert {r.word: r.n for r in words.collect()} == counted(rows)
    assert any(len(w) == 7 for w in counted(rows))
    assert result(spelling.variants(words)) == plain(counted(rows))


def test_no_table_is_broadcast(spark):
    """Files don't tell how large a table is in memory, nor words how many entries they have."""
    def executions() -> list:
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return [found.apply(i) for i in range(found.size())]

    before = max((x.executionId() for x in executions()), default=-1)
    counts = {"a" * i + x + "b" * 8: n for i in range(9) for x, n in (("c", 5), ("d", 50), ("e", 500))}
    assert result(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint").coalesce(1))) == plain(counts)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in executions() if x.executionId() > before]
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]


def test_nothing(spark, empty):
    df = spelling.variants(spelling.vocabulary(empty))
    assert df.collect() == [] and df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
