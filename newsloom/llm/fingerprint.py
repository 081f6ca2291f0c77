"""Document fingerprints by a homomorphic multiset hash (DataFrame functions only).

A text is the multiset of its paragraphs (lines that are not blank). Each paragraph is hashed to a
wide vector of words; the fingerprint is the sum of the vectors, each word modulo a power of two. So
the order of paragraphs does not matter, equal multisets have equal fingerprints, and inserting or
deleting paragraphs adds or subtracts their vectors.

A paragraph's vector has three parts: its count of sentences, four words of two 64-bit digests of
the whole paragraph (equality), and for two 64-bit digests of each of its sentences the lowest 60
bits as a vector of 60 lanes, three lanes of 20 bits to a word (likeness). With n sentences and c the
count of set bits in a lane, 2c - n is a sum of random signs, so the inner product of two
fingerprints estimates the inner product of their sentence multisets, and likeness is their cosine,
0 to 1, with a standard error of about 0.09.

Defined results: null text is empty; the fingerprint of an empty text is the zero vector; two zero
vectors are alike (1), a zero vector and another are not (0). Lanes carry into each other beyond a
million sentences, which blurs likeness but not equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = r"[\r\n]+"
SENTENCE_END = r"(?<=[.!?;])\x20+"
#: Words of a fingerprint are modulo 2^60: three lanes of 20 bits.
MODULUS_MASK = (1 << 60) - 1
LANE_MASK = (1 << 20) - 1
ONE_BIT_OF_EACH_LANE = 1 | 1 << 20 | 1 << 40
HALF = (1 << 32) - 1
SEEDS = ("a", "b")
WORDS = 1 + 2 * len(SEEDS) + 20 * len(SEEDS)


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, h: (acc + term(h)).bitwiseAND(F.lit(MODULUS_MASK)))


def _spread(j: int):
    """Bits j, j + 20 and j + 40 of a digest, each in a lane of its own."""
    return lambda h: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ONE_BIT_OF_EACH_LANE))


def with_vectors(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds for each item (text column, new column) the text's vector: array<long> of WORDS words.

    Built in steps of one projection each, so that no step's result is computed twice.
    """
    columns = rows.columns
    paragraphs = {v: F.filter(F.split(F.coalesce(t, F.lit("")), PARAGRAPH), lambda p: F.trim(p) != "") for t, v in texts.items()}
    rows = rows.select(*columns, *[p.alias(f"_p_{v}") for v, p in paragraphs.items()])
    digests = [
        F.struct(
            F.transform(f"_p_{v}", lambda p: F.struct(*[F.xxhash64(F.lit(s), p).alias(s) for s in SEEDS])).alias("whole"),
            F.flatten(
                F.transform(
                    f"_p_{v}",
                    lambda p: F.transform(F.split(p, SENTENCE_END), lambda u: F.struct(*[F.xxhash64(F.lit(s), u).alias(s) for s in SEEDS])),
                )
            ).alias("parts"),
        ).alias(f"_d_{v}")
        for v in texts.values()
    ]
    rows = rows.select(*columns, *digests)
    made = []
    for v in texts.values():
        equal = [
            w for s in SEEDS for w in (
                _sum(F.col(f"_d_{v}.whole.{s}"), lambda x: x.bitwiseAND(F.lit(HALF))),
                _sum(F.col(f"_d_{v}.whole.{s}"), lambda x: F.shiftrightunsigned(x, 32)),
            )
        ]
        alike = [_sum(F.col(f"_d_{v}.parts.{s}"), _spread(j)) for s in SEEDS for j in range(20)]
        made.append(F.array(F.size(F.col(f"_d_{v}.parts")).cast("long"), *equal, *alike).alias(v))
    return rows.select(*columns, *made)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint after inserting b's paragraphs into a."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS_MASK)))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint after deleting b's paragraphs from a."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MODULUS_MASK)))


def as_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda w: F.lpad(F.lower(F.hex(w)), 15, "0")), "")


def signs(v: Column) -> Column:
    """The 120 sums of signs of a vector, as doubles."""
    lane = lambda w, at: F.shiftright(w, at).bitwiseAND(F.lit(LANE_MASK)).cast("double") * 2 - v[0].cast("double")
    words = F.slice(v, 1 + 2 * len(SEEDS) + 1, 20 * len(SEEDS))
    return F.flatten(F.transform(words, lambda w: F.array(lane(w, 0), lane(w, 20), lane(w, 40))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column, signs_a: Column, signs_b: Column) -> Column:
    """0 to 1 from two vectors and their signs; equal vectors are exactly 1."""
    norm = F.sqrt(_dot(signs_a, signs_a) * _dot(signs_b, signs_b))
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(signs_a, signs_b) / norm))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def id_buckets(docs: DataFrame, rows_per_bucket: int, most_cuts: int) -> tuple[Column, int, int]:
    """A bucket number that does not decrease along (doc_id, _tie), null ids first, how many buckets there
    can be, and how many rows have no id.

    ``_tie`` orders rows without an id; their buckets are equal parts of its range. At most ``most_cuts``
    quantiles of doc_id are fetched to the driver; beyond most_cuts * rows_per_bucket rows each quantile
    interval is cut again into equal widths, which even ids fill evenly; a bucket of others sorts with spilling.
    """
    rows, n, low = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id")).first()
    without = -(-(rows - n) // rows_per_bucket)
    of_null = F.floor((F.col("_tie").cast("double") / 2.0**64 + 0.5) * max(without, 1)).cast("long") - max(without, 1)
    if not n:
        return of_null, without + 1, rows
    cuts = max(1, min(most_cuts, -(-n // rows_per_bucket)))
    inner = max(1, -(-n // (cuts * rows_per_bucket)))
    points = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)] + [1.0], 10 * cuts)).first()[0]
    edges = sorted({low, *points})
    bounds = F.array(*[F.lit(int(x)).cast("long") for x in edges])
    at = F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    low_edge, high_edge = F.element_at(bounds, at), F.coalesce(F.try_element_at(bounds, at + 1), F.element_at(bounds, at) + 1)
    share = (F.col("doc_id").cast("double") - low_edge.cast("double")) / F.greatest(high_edge.cast("double") - low_edge.cast("double"), F.lit(1.0))
    inside = F.least(F.floor(share * inner), F.lit(inner - 1)).cast("int")
    return F.when(F.col("doc_id").isNull(), of_null).otherwise((at * inner + inside).cast("long")), (len(edges) + 1) * inner + 1 + without, rows - n


#: Buckets whose first rows (two numbers each) may be broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 500_000


def with_next(docs: DataFrame, *, rows_per_bucket: int = 2_000, most_cuts: int = 2_000, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, text, its vector v, and text and vector of the next row by ascending doc_id (``next_text``, ``x``);
    the last row's next is the first.

    The table is dealt by ranges of doc_id; every text moves once, with its vector, so that each vector is
    made once. Only the last row of a range needs a row of another range: the first of the next one that
    has rows, found from ids alone. Rows with equal ids are ordered by text (null as empty); rows without an id
    come first, by the digest of their text and then by the text.
    """
    bucket, most, without = id_buckets(docs.select("doc_id"), rows_per_bucket, most_cuts)
    text = F.coalesce("text", F.lit(""))
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64(text)) if without else F.lit(None).cast("long")
    rows = docs.select("doc_id", text.alias("text"), tie.alias("_tie"))
    ids = (rows if without else docs.select("doc_id", tie.alias("_tie"))).withColumn("_bucket", bucket)
    first = ids.groupBy("_bucket").agg(F.min("doc_id").alias("_first"), F.min("_tie").alias("_first_tie"))
    order = Window.orderBy("_bucket")  # one row per bucket
    head = F.struct("_first", "_first_tie")
    heads = first.select("_bucket", F.coalesce(F.lead(head).over(order), F.first(head).over(order)).alias("_h")).select("_bucket", "_h.*")
    heads = F.broadcast(heads) if most <= most_broadcast else heads
    same = F.col("doc_id").eqNullSafe(F.col("_first")) & F.col("_tie").eqNullSafe(F.col("_first_tie"))
    firsts = rows.join(heads, same).groupBy("_bucket").agg(F.min("text").alias("_head_text"))
    firsts = with_vectors(firsts, {"_head_text": "_head_v"}).withColumnRenamed("_bucket", "_of")
    along = Window.partitionBy("_bucket").orderBy("doc_id", "_tie", "text")
    made = with_vectors(rows, {"text": "v"}).withColumn("_bucket", bucket)
    following = made.withColumn("_next", F.lead(F.struct("text", "v")).over(along))
    return following.join(firsts, (F.col("_bucket") == F.col("_of")) & F.col("_next").isNull(), "left").select(
        "doc_id", "text", "v", F.coalesce("_next.text", "_head_text").alias("next_text"), F.coalesce("_next.v", "_head_v").alias("x")
    )


def fingerprints(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_chars, edited text and the vectors of the text, the edited text and the next text.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many
    (or all) of the next document.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, **parameters).withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)),
    )
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "v", "x", "edited")
    return with_vectors(rows, {"edited": "e"}).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "v", "e", "x")


def compare_with_edits(docs: DataFrame, **parameters) -> DataFrame:
    """The digest of ``fingerprints``: strings and likenesses."""
    made = fingerprints(docs, **parameters)
    signed = made.withColumns({f"s{c}": signs(F.col(c)) for c in "vex"})
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("v")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e"), F.col("sv"), F.col("se")).alias("near_edited"),
        likeness(F.col("v"), F.col("x"), F.col("sv"), F.col("sx")).alias("near_next"),
    )
