"""The queries of the training-data operators and, where SQL can say it, their SQL.

Each ``opN_<name>`` applies its operator with production parameters to its whole table and derives
the asked columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    exact_dedup,
    fingerprint,
    language_id,
    mixing,
    probminhash,
    quality_crf,
    secrets,
    sentencepiece_codec,
    sharding,
    spelling_variants,
    substring_dedup,
    token_alignment,
)
from ._common import table

#: The model file of the encoding operator; a parameter of everything that uses it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The byte-level vocabulary that is aligned with it.
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def fold(parts: int, value: int):
    """Whether crc32 of doc_id as text leaves ``value`` modulo ``parts``; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == value, F.lit(False))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.train(docs.filter(~fold(5, 0)), table(spark, sf_dir, "labels").filter(~fold(5, 0)))
    scored = quality_crf.predict(docs, model, carry=["doc_id"])
    return scored.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~fold(3, 1)))
    return language_id.predict(docs, model, carry=["doc_id"]).select("doc_id", fold(3, 1).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(
            secrets.as_text("base"),
            256,
        ).alias("base_sha256"), secrets.as_text("spans").alias("spans"), "n_live", "n_copied"
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, carry=["doc_id"])


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8).drop("source")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat_format.planted(spark))
    made = chat_format.format_texts(turns)
    read = made.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of one to four parts, by a hash of the source's name."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=1 + F.crc32("source") % 4)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_alignment.align(table(spark, sf_dir, "documents"), BYTE_MODEL, PIECE_MODEL, carry=["doc_id"])
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_crf,
        op2_language_id,
        op3_secret_scan,
        op4_sentencepiece,
        op5_probminhash,
        op6_exact_dedup,
        op7_fingerprint,
        op8_sharding,
        op9_chat_format,
        op10_mixing,
        op11_spelling_variants,
        op12_token_alignment,
        op13_substring_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op9_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
          SELECT *, regexp_replace(text, '(\[)(\\*)(/?INST\])|(<)(\\*)(/?s>|\|)', '\1\4\\\2\5\3\6', 'g') AS escaped FROM c)
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + 1 + length(escaped) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
          p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
          m AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k),
          r AS (SELECT p.doc_id, p.i FROM p JOIN m ON p.k = m.k WHERE m.least < p.doc_id),
          e AS (SELECT doc_id, i, coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -50) AS before FROM r),
          g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(greatest(i, before + 50), i + 50)) AS j FROM e) GROUP BY doc_id),
          x AS (SELECT w.doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w),
          a AS (SELECT x.doc_id, string_agg(ws[x.j], ' ' ORDER BY x.j) AS kept, count(*) AS n FROM x LEFT JOIN (SELECT doc_id, unnest(gone) AS j FROM g) d ON x.doc_id = d.doc_id AND x.j = d.j WHERE d.j IS NULL GROUP BY x.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(a.n, 0))::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON w.doc_id = a.doc_id""",
}
