"""The versioned corpus as a table with commits: a run reads the state and its own rows, not the history.

What runs say of an article folds in any order of parts: the last title, the last date of high confidence and the
last of any, the first and the last sight are least or greatest places. So a commit adds a part with the run's own
fold (a delta), reading folds parts by key, and now and then all parts are folded into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

#: Parts after which they are folded into one.
MOST_PARTS = 16
KEYS = {"articles": ["url"], "versions": ["url", "content_hash"], "observations": ["run_id", "url", "content_hash", "section"], "runs": ["run_id"]}


def parts_of_rows(rows: DataFrame) -> dict[str, DataFrame]:
    """The fold of rows (run_id, ord, url, title, content_hash, section, retrieved_at, published_at, date_source,
    date_confidence) as tables that fold again."""
    date = F.struct("ord", F.col("published_at").alias("date"), F.col("date_source").alias("source"), F.col("date_confidence").alias("confidence"))
    dated = F.col("published_at").isNotNull()
    seen = F.struct("ord", "retrieved_at")
    section = F.coalesce("section", F.lit(""))
    return {
        "articles": rows.groupBy("url").agg(
            F.max(F.struct("ord", "title")).alias("title"),
            F.max(F.when(dated & (F.col("date_confidence") == "high"), date)).alias("high"),
            F.max(F.when(dated, date)).alias("any"),
            F.min(seen).alias("first"),
            F.max(seen).alias("last"),
        ),
        "versions": rows.groupBy("url", "content_hash").agg(F.min(F.struct("ord", "title", "retrieved_at")).alias("first")),
        "observations": rows.groupBy("run_id", "url", "content_hash", section.alias("section")).agg(F.min(seen).alias("first")),
        "runs": rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("records")),
    }


def folded(name: str, parts: DataFrame) -> DataFrame:
    """One row for each key, from the rows of several parts."""
    least = {"first"}
    values = [c for c in parts.columns if c not in KEYS[name]]
    return parts.groupBy(*KEYS[name]).agg(*[(F.min if c in least else F.max)(c).alias(c) for c in values])


class CorpusTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """articles, versions, observations or runs, one row for each key; null before the first commit."""
        parts = self.versions.content(number).get("parts", [])
        if not parts:
            return None
        rows = self.spark.read.parquet(*[f"{p}/{name}" for p in parts])
        return rows if len(parts) == 1 else folded(name, rows)

    def write(self, tables: dict[str, DataFrame]) -> str:
        part = self.versions.new_part()
        for name, rows in tables.items():
            rows.write.parquet(f"{part}/{name}")
        return part

    def commit(self, rows: DataFrame) -> DataFrame:
        """Take the runs of ``rows`` that the table does not have; gives the counters of these runs: run_id, records,
        new_articles, new_versions, unchanged_records, new_observations. All runs of one call become visible at once."""
        number = self.versions.number()
        parts = self.versions.content(number).get("parts", [])
        runs = self.read("runs", number)
        fresh = rows if runs is None else rows.join(runs.select("run_id"), "run_id", "left_anti")
        part = self.write(parts_of_rows(fresh))
        made = {name: self.spark.read.parquet(f"{part}/{name}") for name in KEYS}
        counters = self.counters(fresh, made, number)
        if not made["runs"].limit(1).count():
            self.versions.remove([part])
            return self.spark.createDataFrame([], counters.schema)
        counters.write.parquet(f"{part}/counters")
        parts = [*parts, part]
        self.versions.commit(number, {"parts": parts})
        if len(parts) > MOST_PARTS:
            self.compact()
        return self.spark.read.parquet(f"{part}/counters")

    def counters(self, fresh: DataFrame, made: dict[str, DataFrame], number: int) -> DataFrame:
        """What each new run added: a row is the first of its article, version or observation if no commit has the
        key and its place is the least one in the new part."""
        firsts = None
        for name, flag in (("articles", "a"), ("versions", "v"), ("observations", "o")):
            known = self.read(name, number)
            new = made[name] if known is None else made[name].join(known.select(*KEYS[name]), KEYS[name], "left_anti")
            one = new.select(F.col("first.ord").alias("ord"), *[F.lit(int(flag == f)).alias(f) for f in "avo"])
            firsts = one if firsts is None else firsts.unionAll(one)
        told = firsts.groupBy("ord").agg(*[F.max(f).alias(f) for f in "avo"])
        added = [F.coalesce(F.sum(f), F.lit(0)) for f in "avo"]
        return fresh.select("run_id", "ord").join(told, "ord", "left").groupBy("run_id").agg(
            F.count(F.lit(1)).alias("records"),
            added[0].alias("new_articles"),
            added[1].alias("new_versions"),
            (F.count(F.lit(1)) - added[1]).alias("unchanged_records"),
            added[2].alias("new_observations"),
        )

    def compact(self) -> None:
        """Fold all parts into one."""
        number = self.versions.number()
        part = self.write({name: self.read(name, number) for name in KEYS})
        self.versions.commit(number, {"parts": [part]})

    def articles(self, number: int | None = None) -> DataFrame | None:
        """url, title, date, source, confidence, first_seen_at and last_seen_at of every article. A date of high
        confidence is only replaced by another of high confidence."""
        state = self.read("articles", number)
        if state is None:
            return None
        date = F.coalesce("high", "any")
        return state.select(
            "url",
            F.col("title.title").alias("title"),
            *[date[c].alias(c) for c in ("date", "source", "confidence")],
            F.col("first.retrieved_at").alias("first_seen_at"),
            F.col("last.retrieved_at").alias("last_seen_at"),
        )

    def vacuum(self) -> int:
        """Delete the parts that the last commit does not name (of killed runs, and folded ones); gives how many."""
        named = set(self.versions.content().get("parts", []))
        at = self.versions.path("parts")
        if not self.versions.files.exists(at):
            return 0
        there = [f"{self.versions.folder}/parts/{s.getPath().getName()}" for s in self.versions.files.listStatus(at)]
        gone = [p for p in there if p not in named]
        self.versions.remove(gone)
        return len(gone)
