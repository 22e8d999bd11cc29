"""The queries opN_<name> of this subpackage, on whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import chat, lines, minhash, mixing, neighbours, packing, pitman_yor, quality, rules, substrings

WORDS = r"'[^\x20\x09-\x0D]+'"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_copied(_read(spark, sf_dir, "documents")).drop("kept_text")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(_read(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    vectors, model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, vectors, model)
    held_out = F.coalesce(quality.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(_read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = rows.unionByName(more).withColumn("content", chat.text_part(F.coalesce("text", F.lit(""))))
    out = chat.format_chats(rows)
    turns = F.concat_ws("", F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = chat.loss_text(F.col("formatted"), F.col("loss"))
    return out.select(
        "conv_id",
        F.size(chat.read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(_read(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.verdict("base")).alias("base_failed"), rules.verdict("2024.2").alias("kept"), F.col("failed").alias("failed_bits"),
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = pitman_yor.score(docs, quality.remainder(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_source_mixing": op3_source_mixing,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_neighbours": op6_neighbours,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_scores": op10_lm_scores,
}

_ESC = r"'[<\[]\\*(\||/?s>|/?INST\])'"

SQL: dict[str, str] = {
    "op8_chat_format": rf"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(8 + length(role) + len(regexp_extract_all(role, {_ESC})) + 5 * len(regexp_extract_all(role, chr(10))) + 1
                + length(text) + len(regexp_extract_all(text, {_ESC})) + 7)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op9_quality_rules": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
                (n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
                coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters
            FROM w LEFT JOIN cov USING (doc_id)
        ),
        f AS (
            SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
                + CASE WHEN 20 * n_symbols > word_chars THEN 16 ELSE 0 END + CASE WHEN n_lines >= 6 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
                + CASE WHEN n_letters >= 40 AND 2 * n_upper > n_letters THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f""",
    "op3_source_mixing": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS capacity FROM s0),
        s2 AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(capacity) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
            FROM s1 WINDOW b AS (ORDER BY capacity / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        s3 AS (SELECT *, arg_min(level, capacity / weight) FILTER (level * weight <= capacity) OVER () AS final FROM s2),
        s4 AS (SELECT source, source_size, least(capacity, coalesce(weight * final, capacity))::DOUBLE AS target FROM s3),
        s5 AS (SELECT *, greatest(1, least(64, coalesce(floor(min(target) FILTER (target > 0) OVER () / 64), 64)))::BIGINT AS block FROM s4),
        s6 AS (SELECT *, round(sum(target) OVER () / block)::BIGINT AS seats, greatest(1, ceil(source_size / 500000))::BIGINT AS shards FROM s5),
        q0 AS (SELECT source, target / (2 * k + 1) AS q, k, seats FROM (SELECT source, target, seats, unnest(range(0, (target / block * 1.2)::BIGINT + 16)) AS k FROM s6 WHERE target > 0)),
        q1 AS (SELECT source, count(*)::BIGINT AS source_blocks FROM (SELECT * FROM q0 QUALIFY row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) <= seats) GROUP BY source),
        r0 AS (
            SELECT d.*, s6.source_size, s6.target, s6.block, coalesce(q1.source_blocks, 0) AS source_blocks,
                ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT % s6.shards AS shard
            FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source LEFT JOIN q1 ON d.source IS NOT DISTINCT FROM q1.source
        ),
        h0 AS (SELECT source, shard, block, source_blocks, sum(size)::BIGINT AS shard_size FROM r0 GROUP BY ALL),
        h1 AS (
            SELECT source, shard, count(*) AS quota FROM (
                SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place
                FROM (SELECT *, unnest(range(0, (shard_size / block * 2.5)::BIGINT + 16)) AS k FROM h0 WHERE shard_size > 0)
            ) WHERE place <= source_blocks GROUP BY source, shard
        ),
        h2 AS (
            SELECT h0.source, h0.shard, ceil(shard_size / block)::BIGINT AS n, least(coalesce(quota, 0), 2 * ceil(shard_size / block))::BIGINT AS quota,
                coalesce(('0x' || substr(md5('8:' || coalesce(h0.source, '') || ':' || h0.shard), 1, 15))::BIGINT % nullif(ceil(shard_size / block)::BIGINT, 0), 0) AS shift
            FROM h0 LEFT JOIN h1 ON h0.source IS NOT DISTINCT FROM h1.source AND h0.shard = h1.shard
        ),
        t0 AS (
            SELECT r0.*, n, quota, shift, (sum(size) OVER (PARTITION BY r0.source, r0.shard ORDER BY ('0x' || substr(md5('9:' || doc_id), 1, 15))::BIGINT, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS x0
            FROM r0 JOIN h2 ON r0.source IS NOT DISTINCT FROM h2.source AND r0.shard = h2.shard
        ),
        t1 AS (SELECT *, x0 + size AS x1, x0 // block AS b0, (x0 + size) // block AS b1, coalesce(quota % nullif(n, 0), 0) AS e, coalesce(quota // nullif(n, 0), 0) AS r, greatest(n, 1) AS m FROM t0),
        t2 AS (
            SELECT *, x0 * r + (b0 * e + shift) // m * block + (x0 - b0 * block) * (((b0 + 1) * e + shift) // m - (b0 * e + shift) // m) AS g0,
                x1 * r + (b1 * e + shift) // m * block + (x1 - b1 * block) * (((b1 + 1) * e + shift) // m - (b1 * e + shift) // m) AS g1 FROM t1
        )
        SELECT doc_id, size, source_size, target, (g1 - g0)::BIGINT AS taken FROM t2""",
}
