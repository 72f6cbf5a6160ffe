import random

import pytest
from corpora import SCHEMA, WORDS, prose

@pytest.fixture
def corpus():
    """Documents with exact and near copies, shared passages, junk, nulls, empty and long texts."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(60)]
    shared = prose(rng, 70)
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(6)]
    base = prose(rng, 150).split(" ")
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randrange(1, 5)):
            near[rng.randrange(len(near))] = rng.choice(WORDS).upper()
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], texts[5].upper(), "ab " * 300, "é" * 250, "x" * 1000, prose(rng, 6000), "", " \n\t ", "one", "One TWO", "one two three"]
    rows = [(i, t, "en", f"s{min(i % 7, 3)}", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, None, "en", "s0", 0)]
    return rows


@pytest.fixture
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("key", "k", "v", "n", "digest", "bits", "score", "h", "rep", "label", "start")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
