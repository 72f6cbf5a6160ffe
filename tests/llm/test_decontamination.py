import random
import re

from corpora import prose

from marketframe.llm import decontamination as dc


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, items):
    sets = {i: shingles(t) for i, t in items}
    out = set()
    for k, text, *_ in rows:
        have = shingles(text)
        for i, s in sets.items():
            if k is not None and s and 100 * len(s & have) >= 80 * len(s):
                out.add((k, i, len(s), len(s & have)))
    return out


def planted(corpus):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(6, 60))) for i in range(25)] + [(50, "too short to tell"), (51, None), (52, "")]
    items.append((60, items[3][1]))
    rows = [list(r) for r in corpus]
    for i, text in items[:25]:
        row = rows[rng.randrange(60)]
        words = text.split(" ")
        if i % 3 == 1:
            text = text.upper().replace(" ", " , ")
        elif i % 3 == 2:
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        row[1] = f"{row[1]} {text} {row[1]}"
    return rows, items


def test_leaks(spark, corpus, monkeypatch):
    rows, items = planted(corpus)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumnRenamed("lang", "item").withColumnRenamed("source", "hashes")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(rows, items)
    assert len(want) > 15
    got = {tuple(r)[:4] for r in dc.leaks(df, bench).collect()}
    assert got == want
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)  # the sketches are joined by a shuffle
    assert {tuple(r)[:4] for r in dc.leaks(df, bench).collect()} == want
    left = {r.doc_id for r in dc.clean(df, bench).collect()}
    assert left == {r[0] for r in rows} - {k for k, *_ in want}
    assert dc.clean(df, bench).columns == df.columns


def test_odd_rows(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (None, "a b c d e f")], "item_id bigint, text string")
    df = spark.createDataFrame([(None, "a b c d e f g h"), (2, "x A b. C d e f, g h y"), (2, "x A b. C d e f, g h y"), (3, None)], "doc_id bigint, text string")
    assert [tuple(r)[:4] for r in dc.leaks(df, bench).collect()] == [(2, 1, 4, 4)]
    assert dc.clean(df, bench).count() == 2
    assert dc.leaks(empty, bench).count() == 0 and dc.leaks(df, bench.limit(0)).count() == 0


def test_repeated_items(spark):
    """Repeated rows and different texts under one id lose no leak."""
    rng = random.Random(3)
    w = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    bench = [(1, " ".join(w("a", 14)))] * 2 + [(2, " ".join(w(tag, 14))) for tag in "bcdefgh"] + [(3, None), (3, "x y z u v w")]
    docs = []
    for tag in "abcdefgh":
        docs.append((len(docs), " ".join(["before", *w(tag, 14), "after"])))
        for cut in (1, 2):  # 8 of the 10 shingles, without the first or last two
            docs.append((len(docs), " ".join([*w(tag, 14)[2:], "after"]) if cut == 1 else " ".join(["before", *w(tag, 14)[:-2]])))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(tuple(r)[:4] for r in dc.leaks(df, spark.createDataFrame(bench, "item_id bigint, text string")).collect())
    assert got == sorted((k, 1 if "a3" in t.split() else 2, 10, 10 if "before" in t and "after" in t else 8) for k, t in docs)


def test_short_items(spark):
    bench = [(1, "Rare, word!"), (2, "one two three four"), (3, "漢字の文。"), (4, "a a a"), (5, "..."), (6, "p q r s t"), (1, "rare word")]
    docs = [(1, "a rare word here"), (2, "rare: Word"), (3, "word rare"), (4, "zero one two three four five"), (5, "one two three"), (6, "x 漢字の文、y"), (7, "a a b"), (8, "b a a a a"), (9, "rareword"), (10, None), (11, "o p q r s t u")]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, 1, 1, 1), (2, 1, 1, 1), (4, 2, 1, 1), (6, 3, 1, 1), (8, 4, 1, 1), (11, 6, 1, 1)]


def test_sketch_length(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(54)))], "item_id bigint, text string")
    from pyspark.sql import functions as F

    items = bench.select(F.col("item_id").alias("item"), dc.shingle_hashes(F.col("text")).alias("hashes")).withColumn("n", F.size("hashes"))
    assert dc.sketches(items).count() == 50 - 40 + 4  # sizes from 32 to 63 ask for four hits


def test_no_python_in_the_plan(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert not re.search("Python|Pandas|Arrow", dc.leaks(docs, bench)._jdf.queryExecution().toString())


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Both plans give the same rows; within the bound no join shuffles, so no text is dealt anew."""
    docs = spark.createDataFrame([(1, "x a b c d e f"), (2, "b c d e f g h y"), (3, "nothing of the kind is here"), (None, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d e f g h")], "item_id bigint, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found, left = dc.leaks(docs, bench), dc.clean(docs, bench)
    near = sorted(map(tuple, found.collect())), sorted(map(str, left.collect()))
    assert "SortMergeJoin" not in plan(dc.clean(docs, bench)) and "hashpartitioning" not in plan(dc.clean(docs, bench))
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    found, left = dc.leaks(docs, bench), dc.clean(docs, bench)
    assert "SortMergeJoin" in plan(found) and "SortMergeJoin" in plan(left)
    assert len(near[0]) == 2 and len(near[1]) == 2
    assert near == (sorted(map(tuple, found.collect())), sorted(map(str, left.collect())))


def test_size_partitions(spark):
    """A document that holds just enough of an item has the hits that the item's size class asks for."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    for n in (5, 9, 12, 20, 36, 68, 132):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        shingle_count = n - 4
        cut = shingle_count - -(-80 * shingle_count // 100)  # so many shingles may go
        docs = spark.createDataFrame([(1, " ".join(words[cut:])), (2, " ".join(words[: n - cut])), (3, " ".join(words[cut + 1 :]))], "doc_id bigint, text string")
        got = dc.leaks(docs, spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string"))
        assert {r.doc_id for r in got.collect()} == {1, 2}, n
    sizes = spark.createDataFrame([(1,), (7,), (8, ), (16,), (64,)], "n int").select("n", dc.hits(dc.size_class(F.col("n"))).alias("hits"))
    assert [tuple(r) for r in sizes.orderBy("n").collect()] == [(1, 1), (7, 1), (8, 2), (16, 3), (64, 5)]
