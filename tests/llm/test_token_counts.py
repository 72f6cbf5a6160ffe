import public_tokenizers
import sentencepiece

from marketframe.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOAD = tc.piece_counter(MODEL)


def counted(docs, path, load=LOAD, version="v1", **how):
    return {r.doc_id: r for r in tc.token_counts(docs, path, load, version, **how).collect()}


def test_counts(docs, corpus, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = counted(docs, str(tmp_path / "cache"), limit=50)
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        n = len(model.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 50)


def test_cache_serves_all_it_holds(docs, spark, tmp_path):
    path = str(tmp_path / "cache")
    first = counted(docs, path)
    before = spark.read.parquet(path).count()
    assert before == docs.selectExpr("coalesce(text, '')").distinct().count()

    def load():
        def count(texts):
            assert not texts, "nothing is left to encode"
            return []

        return count

    assert {k: v.n_tokens for k, v in counted(docs, path, load).items()} == {k: v.n_tokens for k, v in first.items()}
    assert spark.read.parquet(path).count() == before


def test_cache_appends_misses_only(spark, docs, tmp_path):
    path = str(tmp_path / "cache")
    counted(docs, path)
    before = spark.read.parquet(path).count()
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(5000, "brand new text"), (5001, "brand new text")], "doc_id bigint, text string"))
    assert counted(more, path)[5001].n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("brand new text"))
    assert spark.read.parquet(path).count() == before + 1
    counted(docs, path, version="v2")  # another tokenizer version has entries of its own
    assert spark.read.parquet(path).count() == 2 * before + 1


def test_repeated_rows_and_entries(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id bigint, text string")
    path = str(tmp_path / "cache")
    assert tc.token_counts(df, path, LOAD, "v").count() == 3
    spark.read.parquet(path).write.mode("append").partitionBy("tokenizer").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").partitionBy("tokenizer").parquet(path + "2")
    assert tc.token_counts(df, path + "2", LOAD, "v").count() == 3


def test_empty(empty, tmp_path):
    assert tc.token_counts(empty, str(tmp_path / "cache"), LOAD, "v").count() == 0


def test_other_tokenizer(spark, tmp_path):
    df = spark.createDataFrame([(1, "<|endoftext|> a")], "doc_id bigint, text string")
    load = tc.bpe_counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert tc.token_counts(df, str(tmp_path / "c"), load, "bpe").first().n_tokens == 2
