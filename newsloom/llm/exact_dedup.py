"""Exact dedup over content-defined chunk recipes (DataFrame functions only).

A text is normalised, cut into chunks at content-defined places, and becomes the ordered list of
its chunk identifiers (its recipe). Chunks are deduplicated to 64-bit identifiers, and every
identifier is verified: all chunks that carry it must agree in length and SHA-256. An identifier
that fails is replaced by the digests themselves in every recipe that uses it. Equal recipes are
then equal texts, and only recipes (one long per chunk) are shuffled, never the documents.

Defined results: a null text counts as empty; all empty texts are one group; a null doc_id sorts
after every other; of identical repeated rows exactly one stays; extra columns pass through
``deduplicate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, rows_kept, text_digest, with_row_id

#: Characters that do not count when texts are compared.
IGNORED = r"[\x20\x09-\x0D]+"
def cells(first: int, last: int, step: int, start: int, size: int) -> str:
    """A character class: of every ``step`` code points from ``first`` to ``last`` those from ``start`` on, ``size`` of them."""
    return "[" + "".join(f"\\x{{{c + start:X}}}-\\x{{{c + start + size - 1:X}}}" for c in range(first, last, step)) + "]"


#: A chunk ends, once it is long enough, after one of these: about one of every fifty to two hundred places
#: in Latin prose, digits, the other alphabets (U+0080 to U+2FFF) and the large scripts above them.
CUT = "|".join(
    [
        "(?<=[snr][dtlg][aeiou])",
        "(?<=[0-9]{3})(?<=[0-3][0-4][5-9])",
        r"(?<=[\x{80}-\x{2FFF}]{2})(?<=" + cells(0x80, 0x3000, 32, 16, 4) + cells(0x80, 0x3000, 32, 24, 8) + ")",
        r"(?<=[\x{3000}-\x{10FFFF}]{2})(?<=" + cells(0x3000, 0x20000, 1024, 256, 128) + cells(0x3000, 0x20000, 1024, 512, 128) + ")",
    ]
)


def chunk_pattern(least: int, most: int) -> str:
    return rf"(?s).{{{least},{most}}}?(?:{CUT})|(?s).{{1,{most}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def recipes(docs: DataFrame, *, least: int = 512, most: int = 4096) -> DataFrame:
    """One row per input row: _row, doc_id, text_digest (of the text as it is), n_chars, text_sha256 and recipe (id, size, sha of each chunk)."""
    chunks = F.regexp_extract_all(F.col("_text"), F.lit(chunk_pattern(least, most)), F.lit(0))
    return with_row_id(
        docs.select(
            "doc_id",
            text_digest(F.col("text")).alias("text_digest"),
            F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
            normalised(F.col("text")).alias("_text"),
        ).select(
            "doc_id",
            "text_digest",
            "n_chars",
            F.sha2("_text", 256).alias("text_sha256"),
            F.transform(
                chunks,
                lambda c: F.struct(F.xxhash64(c).alias("id"), F.octet_length(c).alias("size"), F.unhex(F.sha2(c, 256)).alias("sha")),
            ).alias("recipe"),
        )
    )


def unverified_ids(rows: DataFrame) -> DataFrame:
    """Chunk identifiers that stand for more than one chunk (normally none)."""
    chunks = rows.select(F.explode("recipe").alias("c")).select("c.id", F.struct("c.size", "c.sha").alias("proof"))
    return chunks.groupBy("id").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).filter("a <> b").select("id")


def verified_recipes(rows: DataFrame) -> DataFrame:
    """Adds ``key``, equal for two rows exactly when their chunk lists are equal."""
    failed = unverified_ids(rows)
    touched = rows.select("_row", F.explode("recipe.id").alias("id")).join(failed, "id", "left_semi").select("_row").distinct()
    marked = rows.join(touched.withColumn("_failed", F.lit(True)), "_row", "left")
    proof = F.transform("recipe", lambda c: F.concat_ws(":", c["size"].cast("string"), F.hex(c["sha"])))
    return marked.select(
        "_row",
        "doc_id",
        "n_chars",
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
        F.struct(
            F.col("recipe.id").alias("ids"),
            F.when(F.col("_failed"), proof).alias("proof"),
        ).alias("key"),
        *[c for c in rows.columns if c == "text_digest"],
    )


def judged_rows(docs: DataFrame, *, least: int = 512, most: int = 4096) -> DataFrame:
    """The columns of ``exact_groups`` and text_digest."""
    rows = verified_recipes(materialise(recipes(docs, least=least, most=most)))
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row").alias("row")))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).filter("n > 1")
    return rows.join(groups, "key", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_chunks",
        "text_digest",
    )


def exact_groups(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    return judged_rows(docs, **sizes).drop("text_digest")


def deduplicate(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns; ids may repeat or be null."""
    return rows_kept(docs, judged_rows(docs, **sizes).select("doc_id", "text_digest", "kept"), F.col("doc_id"))
