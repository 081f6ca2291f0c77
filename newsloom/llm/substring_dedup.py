"""Substring dedup by compaction of a De Bruijn graph over words.

Every window of ``span`` words is an edge of the graph, from its first ``span - 1`` words to its last.
Edges are dealt by their minimiser, the least hash of the ``k``-word pieces inside a window: windows
that follow each other and share it are one path, so that one row stands for up to ``span - k + 1``
edges. Paths whose minimiser is found in one document only are unique and go at once. A minimiser with
one path is not branching: the whole path is compacted, its source is its place in the least document.
Where paths of one minimiser differ, their windows are read again and each edge gets its own source.
Compacted pieces that follow each other in a document and in their source are then glued to spans, and
each span is verified: the words at its own place and at its source must have the same SHA-256. A
failure (two texts with one 64-bit hash) starts again with other hashes.

Only paths (hashes and places) are shuffled and grouped, never windows of whole texts; texts meet the
few places that are asked of them in a broadcast of counted places, or by a shuffle beyond two million.

Defined results: a null text has no words; texts of fewer than ``span`` words stay as they are; a row
without an id counts as the one with the largest id; rows of one id are never sources of each other;
repeated rows get the same result each; extra columns pass through, but those with the name of a made
column give way; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words whose hashes a task works on together.
TOGETHER = 1_000_000
#: Places (some 30 bytes each) that may be broadcast.
MOST_PLACES = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
PATHS = "doc long, row long, start int, n int, node long, path long"
EDGES = "node long, path long, offset int, edge long, doc long, row long, start int"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` hashes, put together from runs of powers of two."""
    whole, done, power, run = None, 0, 1, hashes
    while True:
        if size & power:
            if whole is None:
                whole, done = run, power
            else:
                n = len(hashes) - done - power + 1
                whole = whole[:n] * BASE ** np.uint64(power) + run[done : done + n]
                done += power
        if done == size:
            return whole
        run = run[:-power] * BASE ** np.uint64(power) + run[power:]
        power *= 2


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every run of ``width`` values."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at, size = np.where(values[b] < values[a], b, a), size + step
    return at


def paths_of(hashes: np.ndarray, ends: np.ndarray, span: int, k: int) -> dict[str, np.ndarray]:
    """Paths of texts that stand behind each other in ``hashes``: text, start and n (windows) of each,
    with the hashes of its minimiser and of all its words."""
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    if len(hashes) < span:
        return {c: np.zeros(0, np.int64) for c in ("text", "start", "n", "node", "path")}
    pieces, windows = mixed(rolled(hashes, k)), rolled(hashes, span)
    place = least_places(pieces, span - k + 1)
    whole = np.flatnonzero(text[: len(windows)] == text[span - 1 :])
    first = np.ones(len(whole), bool)
    first[1:] = (np.diff(whole) != 1) | (np.diff(place[whole]) != 0) | (np.diff(text[whole]) != 0)
    at = np.flatnonzero(first)
    n = np.diff(at, append=len(whole))
    start = whole[at]
    # The first and the last window of a path overlap: together they hold all its words.
    path = mixed(windows[start] * BASE + mixed(windows[start + n - 1] + n.astype(np.uint64)))
    starts = ends - np.diff(ends, prepend=0)
    return {"text": text[start], "start": start - starts[text[start]], "n": n, "node": pieces[place[start]].view(np.int64), "path": path.view(np.int64)}


def hashed_words(batch: pa.RecordBatch, column: str = "hashes") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, ends) of runs of rows with about ``TOGETHER`` words, or one longer text."""
    lists = batch.column(column)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        yield start, lists.slice(start, stop - start).flatten().to_numpy().view(np.uint64), ends[start:stop] - before
        start = stop


def keyed(docs: DataFrame) -> list[Column]:
    """The identity of a row: its id (the largest number where there is none) and a hash of id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("row")]


def word_hashes(seed: int) -> Column:
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))).alias("hashes")


def paths(docs: DataFrame, *, span: int = 50, k: int = 16, seed: int = 0) -> DataFrame:
    """Every path of every text: doc, row, start (word), n (windows), node (minimiser), path (all its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, ends in hashed_words(batch):
                made = paths_of(hashes, ends, span, k)
                rows = pa.array(first + made["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(rows),
                        batch.column("row").take(rows),
                        pa.array(made["start"].astype(np.int32)),
                        pa.array(made["n"].astype(np.int32)),
                        pa.array(made["node"]),
                        pa.array(made["path"]),
                    ],
                    names=["doc", "row", "start", "n", "node", "path"],
                )

    return docs.select(*keyed(docs), word_hashes(seed)).mapInArrow(run, PATHS)


def with_asked(docs: DataFrame, asked: DataFrame, *columns: Column, how: str = "inner") -> DataFrame:
    """doc, row and ``columns`` of ``docs`` with what ``asked`` (materialised, one row for each doc and row, with an
    array of places) wants of them: by a broadcast of no more than ``MOST_PLACES`` places, else by a shuffle."""
    places = asked.agg(F.sum(F.size(asked.columns[-1]))).first()[0] or 0
    return docs.select(*keyed(docs), *columns).join(F.broadcast(asked) if places <= MOST_PLACES else asked, ["doc", "row"], how)


def edges(docs: DataFrame, asked: DataFrame, *, span: int, seed: int) -> DataFrame:
    """The windows of the asked paths: node, path, offset in it, edge (hash of its words), doc, row, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, ends in hashed_words(batch):
                windows = mixed(rolled(hashes, span))
                wanted = batch.column("wanted").slice(first, len(ends))
                each = wanted.flatten()
                text = np.repeat(np.arange(len(ends)), wanted.value_lengths().to_numpy(zero_copy_only=False))
                start, n = each.field("start").to_numpy(), each.field("n").to_numpy()
                of = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                begins = ends - np.diff(ends, prepend=0)
                made = windows[begins[text[of]] + start[of] + offset].view(np.int64)
                rows, of_path = pa.array(first + text[of]), pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        each.field("node").take(of_path),
                        each.field("path").take(of_path),
                        pa.array(offset.astype(np.int32)),
                        pa.array(made),
                        batch.column("doc").take(rows),
                        batch.column("row").take(rows),
                        pa.array((start[of] + offset).astype(np.int32)),
                    ],
                    names=["node", "path", "offset", "edge", "doc", "row", "start"],
                )

    return with_asked(docs, asked, word_hashes(seed)).mapInArrow(run, EDGES)


def glued(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (``keys``, start, n, source) of which one begins where the other ends, in both places, are one."""
    shift = F.col("source.start") - F.col("start")
    line = Window.partitionBy(*keys, "source.doc", "source.row", shift).orderBy("start")
    ended = F.lag(F.col("start") + F.col("n")).over(line)
    told = pieces.withColumn("_new", (F.coalesce(ended, F.lit(-1)) != F.col("start")).cast("int"))
    told = told.withColumn("_shift", shift).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    of = [F.col("source.doc").alias("_of_doc"), F.col("source.row").alias("_of_row")]
    one = told.groupBy(*keys, *of, "_shift", "_run").agg(
        F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("source").alias("source")
    )
    return one.select(*keys, "start", "n", "source")


def digests(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """SHA-256 of the words (joined by a space) of the asked places: doc, row, start, words, sha."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, text, wanted in zip(*(batch.column(c) for c in ("doc", "row", "text", "wanted")), strict=True):
                words = re.findall(WORD, text.as_py())
                for w in wanted.as_py():
                    said = " ".join(words[w["start"] : w["start"] + w["words"]])
                    out.append((doc.as_py(), row.as_py(), w["start"], w["words"], hashlib.sha256(said.encode("utf-8", "surrogatepass")).digest()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                names=["doc", "row", "start", "words", "sha"],
            )

    return with_asked(docs, asked, F.col("text")).mapInArrow(run, "doc long, row long, start int, words int, sha binary")


def verified(docs: DataFrame, spans: DataFrame, store: Stored) -> bool:
    """Whether all spans (materialised) have the words of their sources."""
    places = spans.select("doc", "row", "start", "words").unionByName(spans.select("source.doc", "source.row", "source.start", "words")).distinct()
    asked = store.put("places", places.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "words")).alias("wanted")))
    found = store.put("digests", digests(docs, asked))
    own = spans.join(found, ["doc", "row", "start", "words"], "left").select("source", "words", F.col("sha").alias("own"))
    there = found.select(
        F.struct("doc", "row", "start").alias("source"),
        "words",
        F.col("sha").alias("theirs"),
    )
    failed = own.join(there, ["source", "words"], "left").filter(~F.coalesce(F.col("own") == F.col("theirs"), F.lit(False)))
    return not failed.limit(1).count()


def repeated_spans(docs: DataFrame, *, span: int = 50, k: int = 16, tries: int = 5) -> DataFrame:
    """The longest spans of ``span`` words or more whose every window also starts in a document with a
    smaller id: doc, row (the identity of a document), start, words and source (doc, row, start)."""
    for seed in range(tries):
        store = Stored(docs.sparkSession)
        every = store.put("paths", paths(docs, span=span, k=k, seed=seed))
        shared = every.groupBy("node").agg(F.min("doc").alias("_low"), F.max("doc").alias("_high")).filter("_low < _high").select("node")
        # Written first: a join of two tables can split a node of very many rows, one of a table and a sum cannot.
        rows = store.put("shared", every.join(store.put("several", shared), "node"))
        store.drop("paths", "several")
        place = F.struct("doc", "row", "start")
        found = store.put("nodes", rows.groupBy("node", "path").agg(F.min(place).alias("source"), F.max("n").alias("n")))
        branching = store.put("branching", found.groupBy("node").agg(F.count(F.lit(1)).alias("_paths")).filter("_paths > 1").select("node"))
        whole = found.join(branching, "node", "left_anti").select("node", "path", F.lit(0).alias("start"), "n", "source")
        wanted = F.collect_list(F.struct("source.start", "n", "node", "path")).alias("wanted")
        asked = store.put("asked", found.join(branching, "node", "left_semi").groupBy("source.doc", "source.row").agg(wanted))
        each = store.put("edges", edges(docs, asked, span=span, seed=seed))
        least = each.groupBy("node", "edge").agg(F.min(place).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        met = each.join(store.put("least", least), ["node", "edge"], "left")
        single = met.select("node", "path", F.col("offset").alias("start"), F.lit(1).alias("n"), F.coalesce("_least", place).alias("source"))
        pieces = store.put("pieces", whole.unionByName(glued(single, ["node", "path"])))
        store.drop("nodes", "branching", "asked", "edges", "least")
        own = rows.join(pieces.withColumnsRenamed({"start": "_offset", "n": "_n"}), ["node", "path"]).filter("source.doc < doc")
        own = own.select("doc", "row", (F.col("start") + F.col("_offset")).alias("start"), F.col("_n").alias("n"), "source")
        made = glued(own.distinct(), ["doc", "row"])
        spans = store.put("spans", made.select("doc", "row", "start", (F.col("n") + (span - 1)).alias("words"), "source"))
        store.drop("shared", "pieces")
        good = verified(docs, spans, store)
        store.drop("places", "digests")
        if good:
            return spans
        store.drop("spans")
    raise RuntimeError(f"spans differ from their sources under {tries} hashes")


def remove_repeats(docs: DataFrame, *, span: int = 50, k: int = 16, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (its columns ``carry``, all if not given) with n_words, n_removed, removed (start and
    words of the spans that go, none overlapping) and kept (the words that stay, joined by a space)."""
    made = T.StructType.fromDDL("n_words long, n_removed long, removed array<struct<start: int, words: int>>, kept string")
    spans = repeated_spans(docs, span=span, k=k)
    cuts = Stored(docs.sparkSession).put("cuts", spans.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "words")).alias("cuts")))
    kept = [f for f in docs.schema if f.name not in made.names and (carry is None or f.name in carry)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, said = [], [], []
            for text, cut in zip(batch.column("text"), batch.column("cuts"), strict=True):
                words, stays, runs, end = re.findall(WORD, text.as_py() or ""), [], [], 0
                for c in sorted((c["start"], c["words"]) for c in cut.as_py() or ()):
                    start, stop = max(c[0], end), c[0] + c[1]
                    if stop > end:
                        stays += words[end:start]
                        runs.append({"start": start, "words": stop - start})
                        end = stop
                stays += words[end:]
                counts.append((len(words), len(words) - len(stays)))
                removed.append(runs)
                said.append(" ".join(stays))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.column("carried").flatten()[: len(names)],
                    pa.array([c[0] for c in counts], pa.int64()),
                    pa.array([c[1] for c in counts], pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))),
                    pa.array(said, pa.string()),
                ],
                names=[*names, *made.names],
            )

    carried = F.struct(*names, F.lit(0)).alias("carried")  # under one name: those of docs may be any
    return with_asked(docs, cuts, F.col("text"), carried, how="left").mapInArrow(run, T.StructType([*kept, *made.fields]))
