"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Three base kinds are found in every text. Their values, and opaque mixed-class tokens anywhere in
the text, are candidates. Candidates are aggregated by digest over the whole corpus into the number
of distinct repositories and owners that hold them: a value seen with many owners is a copied
example, one that only few owners hold is a live credential. The scan adds a span of kind ``live`` for
each of those; base spans always stay. Only digests of values leave the task that has read a text.

Defined results: null text is empty; a null owner or repository counts as one of its own; repeated
rows of one repository count once; every input row gives one output row, also where doc_id is null
or repeated; positions are code points, end exclusive; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import key_of, materialise, with_row_id

#: kind -> (pattern, group of the value, least code points of the value); fixed values of the scan.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = [*BASE, "live"]
#: Candidates besides the base kinds: tokens of 24 and more characters of three classes.
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
#: Matches that are walked together.
CHUNK = 256
SPAN = "struct<start:int,kind:int,end:int,value_start:int,value:string>"


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value_start, value>> of the leftmost non-overlapping matches.

    The gaps between matches come from ``split``, the matches from ``regexp_extract_all``; positions
    are the running sums of their lengths. Values end where their match ends. Running sums are taken over
    chunks of ``CHUNK`` matches and then over the chunks, so that no list grows match by match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("match"), values.alias("value")),
        lambda x: F.struct(
            F.char_length(x["gap"]).alias("gap"),
            F.coalesce(F.char_length(x["match"]), F.lit(0)).alias("size"),
            x["value"].alias("value"),
        ),
    )
    one = lambda at, x: F.struct(
        (at + x["gap"]).alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        (at + x["gap"] + x["size"]).alias("end"),
        (at + x["gap"] + x["size"] - F.char_length(x["value"])).alias("value_start"),
        x["value"].alias("value"),
    )
    walk = lambda part: F.aggregate(
        part,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(one(acc["at"], x)))).otherwise(acc["out"]).alias("out"),
        ),
    )
    chunks = F.transform(rows_in_chunks(rows), walk)
    ends = lambda c: F.aggregate(
        c, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda acc, x: F.struct(
            (acc["at"] + x["at"]).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"])).alias("starts"),
        )
    )
    moved = lambda by: lambda s: F.struct(
        (s["start"] + by).alias("start"),
        s["kind"].alias("kind"),
        (s["end"] + by).alias("end"),
        (s["value_start"] + by).alias("value_start"),
        s["value"].alias("value"),
    )
    # One-element arrays bind what is used twice, so that it is computed once.
    whole = F.transform(F.array(chunks), lambda c: F.flatten(F.zip_with(c, ends(c)["starts"], lambda x, by: F.transform(x["out"], moved(by)))))[0]
    # Most texts hold no long match at all: one cheap test spares them the walk.
    long_enough = {"assign": pattern, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}.get(kind, pattern)
    return F.when(text.rlike(long_enough), whole).otherwise(F.array().cast(f"array<{SPAN}>"))


def rows_in_chunks(rows: Column) -> Column:
    cut = lambda r: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int")),
        lambda i: F.slice(r, i * CHUNK + 1, CHUNK),
    )
    return F.transform(F.array(rows), cut)[0]


def looks_live(value: Column) -> Column:
    """Letters and digits together, eight characters or more."""
    return (F.char_length(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def scan(docs: DataFrame, *, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per input row: _row, doc_id, repository, owner, base (spans) and candidates."""
    text = F.coalesce("text", F.lit(""))
    base = F.sort_array(F.concat(*[spans(text, kind, *rule) for kind, rule in BASE.items()]))
    # A token under the opaque pattern that is of one case or without digits is a word or a number.
    opaque = F.filter(
        spans(text, "live", OPAQUE, 0, 24),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"),
    )
    found = docs.select("doc_id", key_of(repository).alias("repository"), key_of(owner).alias("owner"), base.alias("base"), opaque.alias("opaque"))
    candidate = F.transform(
        F.filter(F.concat("base", "opaque"), lambda s: looks_live(s["value"])),
        lambda s: F.struct(s["value_start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("digest")),
    )
    # Values stay behind: what is written down and shuffled are places and digests.
    places = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return with_row_id(found.withColumn("candidates", F.array_distinct(candidate)).drop("opaque").withColumn("base", places))


def ownership(scanned: DataFrame) -> DataFrame:
    """digest, n_owners, n_repositories over the whole corpus. Every step combines before it shuffles."""
    held = scanned.select("owner", "repository", F.explode("candidates.digest").alias("digest")).distinct()
    by_owner = held.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def find_secrets(
    docs: DataFrame,
    *,
    repository: str = "doc_id",
    owner: str = "source",
    most_owners: int = 2,
    most_repositories: int = 50,
) -> DataFrame:
    """doc_id, base and all spans with the counts of each kind, and of copied candidates.

    A candidate is live when at most ``most_owners`` owners and ``most_repositories`` repositories
    hold it; any more and it is a copied example.
    """
    scanned = materialise(scan(docs, repository=repository, owner=owner))
    held = scanned.select("_row", F.explode("candidates").alias("c")).select("_row", "c.*")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    judged = (
        held.join(ownership(scanned).withColumn("live", live), "digest")
        .groupBy("_row")
        .agg(
            F.collect_list(F.when(F.col("live"), F.struct("start", F.lit(KINDS.index("live")).alias("kind"), "end"))).alias("live"),
            F.count_if(~F.col("live")).alias("n_copied"),
        )
    )
    return scanned.join(judged, "_row", "left").select(
        "doc_id",
        "base",
        F.sort_array(F.concat("base", F.coalesce("live", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"),
        *[count_of("base", kind).alias(f"n_{kind}") for kind in BASE],
        F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def count_of(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def as_text(column: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
