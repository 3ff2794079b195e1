"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import (
    bpe,
    chat,
    decontaminate,
    fingerprints,
    hard_negatives,
    lexical,
    near_dup,
    pii,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
    training_order,
)
from bindery.llm.shared import table
from bindery.staging import shared_folder


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside of the held-out quarter."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~_held_out())
    model = toxicity.fit(docs.join(labels, "doc_id"))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and conversation -7, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.chat_digest(chat.format_chats(rows.unionByName(own)))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), written AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?(?:ROLE|INST|SYS)\])', '\1\\\2\3', 'g') AS used_role,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:ROLE|INST|SYS)\])', '\1\\\2\3', 'g') AS used_text
  FROM rows
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[ROLE]' || used_role || '[/ROLE]' || used_text || '</s>'))::BIGINT AS formatted_chars,
       sum(CASE WHEN used_role <> role OR used_text <> text THEN 1 ELSE 0 END)::BIGINT AS n_escaped
FROM written GROUP BY conv_id
"""


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint, beside those of its edited text and the next document."""
    return fingerprints.edit_fingerprints(table(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_pii(table(spark, folder, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip_digest(table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and where a limit of 4,096 tokens cuts it."""
    return token_counts.count_documents(
        table(spark, folder, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096
    )


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near copies among all documents: 3-word shingles, similarity 0.85."""
    return near_dup.near_components(table(spark, folder, "documents"), width=3, num=85, den=100)


def op7_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's sequences in training order, read back from their shards."""
    path = f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    training_order.write_shards(
        table(spark, folder, "documents"), path, _tokenizer("piece_bpe_32k.model"), key=20_240_601
    )
    return training_order.read_sequences(spark, path).select(
        "doc_id", "sequence", "slot", "shard", "byte_offset", "n_tokens",
        F.sha2("record", 256).alias("record_sha256"),
    )


def op8_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in shards of at most 1 MiB of text."""
    shards = sharding.extendible_shards(table(spark, folder, "documents"), limit=1 << 20)
    return shards.select(
        F.col("key").alias("doc_id"), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"
    )


OP8_SQL = """
WITH rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5('k' || doc_id), 1, 15))::BIGINT), 60, '0') AS path
  FROM documents
), sums AS (
  SELECT depth, left(path, depth) AS shard, sum(n_bytes)::BIGINT AS bytes, count(*) AS n
  FROM rows, (SELECT unnest(range(0, 61))::INTEGER AS depth) d GROUP BY ALL
), fits AS (
  SELECT *, bytes <= 1048576 OR n = 1 AS final FROM sums
), shards AS (
  SELECT a.* FROM fits a LEFT JOIN fits b ON b.depth = a.depth - 1 AND b.shard = left(a.shard, a.depth - 1)
  WHERE a.final AND (a.depth = 0 OR NOT b.final)
)
SELECT r.doc_id, r.n_bytes, s.shard, s.depth, s.bytes AS shard_bytes, s.n AS shard_rows
FROM shards s JOIN rows r ON left(r.path, s.depth) = s.shard
"""

def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in documents: 0.8 of an item's 5-word shingles."""
    return decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL
), items AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM item_words, unnest(range(1, len(w) - 3)) t(i)
), sizes AS (
  SELECT item_id, count(*)::INTEGER AS n_item FROM items GROUP BY item_id
), docs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM doc_words, unnest(range(1, len(w) - 3)) t(i)
), shared AS (
  SELECT doc_id, item_id, count(*)::INTEGER AS n_shared FROM docs JOIN items USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_item FROM shared JOIN sizes USING (item_id)
WHERE 100 * n_shared >= 80 * n_item
"""


def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes that repeated 400-byte strings cover."""
    kept = suffix_dedup.drop_repeats(table(spark, folder, "documents"), length=400)
    return kept.select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["begin"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), lengths AS (
  SELECT doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM lengths
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT DISTINCT item_id, text FROM benchmark) b, unnest(regexp_extract_all(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t(term)
  GROUP BY ALL
), held AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), terms AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), whole
), scored AS (
  SELECT item_id, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id), whole
  GROUP BY ALL
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth vector."""
    moved = table(spark, folder, "embeddings").select(
        "vec_id", "embedding",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
    )
    return hard_negatives.mine_hard_negatives(moved, every=50, positives=5, negatives=3, low=50, high=95)


OP13_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_fingerprints": op3_fingerprints,
    "op4_pii": op4_pii,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_near_duplicates": op6_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op7_training_order": op7_training_order,
    "op8_extendible_shards": op8_extendible_shards,
    "op10_decontamination": op10_decontamination,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE = {
    "op12_lexical_search": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
    "op10_decontamination": OP10_SQL,
    "op2_chat_format": OP2_SQL,
    "op8_extendible_shards": OP8_SQL,
}
