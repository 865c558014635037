"""One thin query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, importance, langid, lines, mixing, pieces, pivots, quality, secrets, sharding, simhash, tokens, trie
from .common import held_out, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_formatted(chat.format_conversations(turns))
    each = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(each, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    kinds = F.array(*map(F.lit, secrets.KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path).select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_pivot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 6
    return trie.prefix_trie(trie.with_shared_heads(table(spark, sf_dir, "conversations"), conv - conv % 100, heads, 5))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = sharding.shard(docs, 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_token_files,
        op3_secret_scans,
        op4_source_mixing,
        op5_piece_encoding,
        op6_simhash_groups,
        op7_language_id,
        op8_rule_quality,
        op9_pivot_links,
        op10_line_rules,
        op11_prefix_trie,
        op12_importance_resampling,
        op13_histogram_shards,
    )
}


_RENDERED = """
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
"""
_ESCAPED = "replace({}, '&', '&amp;')"
for _c in chat.ChatTemplate().controls:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{chat.ChatTemplate().entities[_c[0]] + _c[1:]}')"

#: CRC-32 in SQL: the table of 256 remainders (crc.t), and the fold over a text's UTF-8 bytes.
_CRC_TABLE = """bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda b: ('0x' || b)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Only what DuckDB can express; the other operators are tested against brute force, round trips or held-out accuracy.
ORACLE_SQL = {
    "op1_chat_formatting": f"""
        WITH t AS ({_RENDERED})
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum({len("<|im_start|>" + chr(10) + "<|im_end|>" + chr(10))} + length(replace({_ESCAPED.format("role")}, chr(10), '&#10;')) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op11_prefix_trie": f"""
        WITH RECURSIVE {_CRC_TABLE},
        t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
        dealt AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
        turns AS (SELECT conv_id, row_number() OVER w AS d, length(text) AS chars, string_agg(md5(md5(role) || md5(text)), '' ORDER BY own, i) OVER w AS path FROM dealt WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
        spot AS (SELECT conv_id, d, chars, path FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        node AS (SELECT path, any_value(d) AS d, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n FROM spot GROUP BY path),
        up AS (SELECT path, count(*) AS kids FROM (SELECT left(path, length(path) - 32) AS path FROM node WHERE d > 0) GROUP BY path),
        below AS (SELECT a.path, count(*) FILTER (up.kids IS NULL) AS leaves, sum((node.n - 1) * node.chars) AS saved FROM node LEFT JOIN up ON up.path = node.path JOIN spot a ON a.conv_id = node.conv_id AND a.d <= node.d GROUP BY a.path),
        ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, d) AS path FROM spot GROUP BY conv_id) GROUP BY path)
        SELECT node.conv_id, node.d AS depth, CASE WHEN node.d > 0 THEN p.conv_id END AS parent_conv_id, node.n AS n_convs, coalesce(up.kids, 0) AS n_children, below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens,
               sha256(coalesce(ends.ids, '')) AS ends_sha256
        FROM node JOIN below ON below.path = node.path LEFT JOIN up ON up.path = node.path LEFT JOIN ends ON ends.path = node.path LEFT JOIN node p ON node.d > 0 AND p.path = left(node.path, length(node.path) - 32)
    """,
    "op12_importance_resampling": f"""
        WITH RECURSIVE {_CRC_TABLE},
        cut AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS word FROM documents),
        aim AS (SELECT unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS word FROM benchmark),
        known AS (SELECT word, {_CRC.format("word")} % 10000 AS bucket FROM (SELECT word FROM cut UNION SELECT word FROM aim), crc),
        s AS (SELECT bucket, count(*) AS n FROM cut JOIN known USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM aim JOIN known USING (word) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM cut) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000))))::BIGINT AS gain
                 FROM (SELECT DISTINCT bucket FROM known) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM cut JOIN known USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN w USING (doc_id)),
        r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS rank FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN rank END AS rank FROM r
    """,
    "op13_histogram_shards": f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS (SELECT doc_id, text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, ''))[:15] AS k1, md5(doc_id::VARCHAR)[:15] AS k2 FROM documents),
        c AS (SELECT *, (sum(size) OVER (ORDER BY k1, k2))::BIGINT AS upto, (sum(size) OVER ())::BIGINT AS total FROM d),
        p AS (SELECT *, (8 * (2 * upto - size) // total)::INT AS shard FROM c)
        SELECT doc_id, size::BIGINT AS size, {_CRC.format("coalesce(text, '')")} AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1, k2) - 1 AS slot, NULL::INT AS grown_shard FROM p, crc
    """,
}
