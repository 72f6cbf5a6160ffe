"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import chat, decontamination, near_dup, packing, pii, quality, repair, repeats, secret_scan, sharding, spelling, token_counts, toxicity
from marketframe.llm.common import new_path, saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    # each run begins with an empty cache; a production job would name a lasting one
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"),
        new_path(spark, "token-cache"),
        token_counts.piece_counter(model),
        token_counts.version_of(model),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(n, secret_scan.KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Scores from here on count as toxic.
TOXIC = 0.3


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = lambda key: F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4))
    model = toxicity.fit(docs, labels.select("doc_id", "toxic"), train=fold("doc_id") != 2)
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    load = packing.byte_bpe_encoder(known.path("byte_bpe_50k.json"), known.path("byte_bpe_50k.tiktoken"), known.PATTERN)
    made = saved(packing.pieces(table(spark, sf_dir, "documents"), load, END_ID), "pieces")
    return packing.packed(made)


#: The id that ends a document in a packed sequence.
END_ID = 2


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.grouped(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_chats(chat.records_of_turns(turns.unionByName(more), mixed=True)))


SHARDS = 40


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    audits, rows = repair.repaired(repair.damaged(turns))
    found = audits.join(repair.digests(rows), "conv", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return turns.select("conv_id", repair.conv_key().alias("conv")).distinct().join(found, "conv", "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    name = lambda x: F.element_at(F.array(*map(F.lit, pii.KINDS)), x["kind"] + 1)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(n, range(len(pii.KINDS))), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_secret_scan": op2_secret_scan,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_quality_rules": op5_quality_rules,
        "op6_decontamination": op6_decontamination,
        "op7_packing": op7_packing,
        "op8_near_dup": op8_near_dup,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_sharding": op10_sharding,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_personal_data": op13_personal_data,
    }


WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents),
     b AS (SELECT item_id AS id, {WORDS} AS w FROM benchmark),
     ds AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
     bs AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
     n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
     m AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, shared / n AS containment
FROM m JOIN n ON n.id = m.item_id WHERE 100 * shared >= 80 * n
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8_SQL = rf"""
WITH RECURSIVE
     d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
     s AS (SELECT DISTINCT id, array_to_string(w[i:i + 3], ' ') AS s
           FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
     m AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
     l AS (SELECT a, b FROM m JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
     r(id, root) AS (SELECT id, id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
     c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON c.id = doc_id LEFT JOIN n ON n.id = doc_id
"""


CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
OP9_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e AS (SELECT *, regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || escaped || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


#: The CRC-32 of the text ``s``, by the table ``t`` that follows from the polynomial.
CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE
     k AS (SELECT {CRC_TABLE} AS t),
     d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
     c AS (SELECT id, run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY ALL),
     h AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM c, k),
     w AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
     v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
     x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
     e AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
           UNION SELECT x.word, v.word FROM x JOIN v ON x.cut = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.cut = v.word),
     b AS (SELECT a AS word, count(*) AS n_near, arg_min(e.b, (-v.n, e.b)) AS b, max(v.n) AS m FROM e JOIN v ON v.word = e.b GROUP BY a),
     f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN b.b END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
     r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f g ON g.word = r.root AND g.form IS NULL
"""


def _repair_sql() -> str:
    """The dynamic programme of ``repair`` with whole audits: for each row and state the least (cost, audit, rows that remain)."""
    new = lambda cost, letter, line, of: f"{{'c': {of}.c + {cost}, 'a': '{letter}' || {of}.a, 'r': " + (f"list_prepend({line}, {of}.r)" if line else f"{of}.r") + "}"
    own = "role || ':' || text"
    follows = {"n": "u", "s": "u", "u": "a", "a": "u"}
    role = {"u": "user", "a": "assistant"}
    least = lambda options: f"list_min([{', '.join(options)}])"
    best = []
    for state, to in follows.items():
        kept = lambda then: f"CASE WHEN f NOT IN (1, 2) AND i1 = '{then}' THEN {new('x', 'K', own, then)} END"
        anew = new("2 + x", "R", f"'{role[to]}:' || text", to)
        options = [new(3, "D", "", state), kept(to), f"CASE WHEN f NOT IN (1, 2) THEN {anew} END"]
        if state == "n":
            options.append(kept("s"))
        best.append(f"{least(options)} AS {state}")
    inserted = lambda to: new(2, "I", f"'{role[to]}:'", to)
    pairs = f"SELECT conv_id, i, n, s, {least(['u', inserted('a')])} AS u, {least(['a', inserted('u')])} AS a FROM b"
    whole = f"SELECT conv_id, i, {least(['n', inserted('u')])} AS n, {least(['s', inserted('u')])} AS s, u, a FROM ({pairs})"
    end = "{'c': 0, 'a': '', 'r': []::VARCHAR[]}"
    missing = "{'c': 2, 'a': 'I', 'r': ['assistant:']}"
    both = "{'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']}"
    return rf"""
WITH RECURSIVE
     k AS (SELECT {CRC_TABLE} AS t),
     t AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, k),
     g AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(x, '.!?', '') ELSE x END AS text,
           unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) FROM t WHERE h <> 0),
     o AS (SELECT conv_id, turn, role, text, left(role, 1) AS i1, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
     m AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
           lag(i1) OVER (PARTITION BY conv_id ORDER BY i) || i1 AS pair FROM o),
     p(conv_id, i, n, s, u, a) AS (
           SELECT conv_id, max(i) + 1, {end}, {both}, {missing}, {end} FROM m GROUP BY conv_id
           UNION ALL SELECT * FROM (WITH b AS (SELECT conv_id, i, {', '.join(best)} FROM (SELECT m.*, CASE WHEN m.f = 3 THEN 1 ELSE 0 END AS x, p.n, p.s, p.u, p.a FROM p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i - 1)) {whole})),
     q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 1) AS blank, count_if(f = 2) AS duplicate, count_if(f = 3) AS truncated,
           count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(p.n.c, 0)::BIGINT AS cost, coalesce(p.n.a, '') AS audit, sha256(coalesce(array_to_string(p.n.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = 1
"""


OP12_SQL = _repair_sql()


def oracle_sql() -> dict[str, str]:
    return {
        "op9_chat_formatting": OP9_SQL,
        "op6_decontamination": OP6_SQL,
        "op8_near_dup": OP8_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_conversation_repair": OP12_SQL,
    }
