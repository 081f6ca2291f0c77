"""Spelling variants by a trie over frequency vectors.

A word becomes the vector of its letter-group counts (code points modulo the number of groups). Words
stand in a trie by successive counts. A word finds the words one edit away by a depth-first walk with a
budget of one surplus (a count that is one higher) and, for words of its own length, one deficit (one
lower) after it; from the shorter word of a pair, or from the one with the first surplus, so that every
pair is met once. The words at the leaves that are reached are verified letter by letter.

The trie is cut into shards that no task is too small for: by length first, then, where a shard holds too
many letters, by the count of its next group, and so on down. The driver knows only that top of the trie:
at most ``SHARDS`` nodes are ever cut, each of which holds more than its part of all letters. A word goes to the
shard of its own vector, and as a question to those that its budget reaches. A shard that cannot be cut any more
(one vector) is dealt in parts by a hash of its words. Inside a shard the same trie goes on to all groups.

Defined results: null texts have no words; a null id is the empty string in the hash that deletes letters;
repeated rows count each; ties of forms go to the smallest word in code-point order; an empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stored

LETTERS = r"[A-Za-z\x{C0}-\x{FF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = 37
#: Longer words share one branch of the first level.
LONGEST = 64
#: Nodes of the trie that may be cut on the driver; and letters up to which a shard is never cut.
SHARDS, LEAST_LETTERS = 1000, 1_000_000
#: States of a walk, and letters of candidates, that a task holds at once.
TOGETHER = 2_000_000


def words(docs: DataFrame, *, least: int = 7, occurrences: int = 2, noise: int | None = 31) -> DataFrame:
    """word and n: runs of letters of ``least`` code points or more, A to Z in lower case, that occur at least
    ``occurrences`` times. Where ``noise`` divides the crc32 h of ``<doc_id>:<run>``, the run has lost its
    code point h % length before it is counted."""
    runs = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    said = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    said = said.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if noise is not None:
        at = F.col("h") % F.char_length("word")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at.cast("int")), F.substring(F.col("word"), (at + 2).cast("int"), F.char_length("word")))
        said = said.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word"))).select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("word")).alias("word"))
    return said.filter(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)


def codes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words behind each other, and their lengths."""
    joined = "".join(words.to_pylist()).encode("utf-32-le")
    return np.frombuffer(joined, np.uint32), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def vectors(codes: np.ndarray, sizes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row * groups + codes % groups, minlength=len(sizes) * groups).reshape(len(sizes), groups)


class Trie:
    """Rows of counts (no two may be equal) by successive columns; a row may end before the last one."""

    def __init__(self, rows: np.ndarray, depths: np.ndarray):
        self.width = int(rows.max(initial=0)) + 3
        order = np.lexsort(rows.T[::-1])
        rows, depths = rows[order], depths[order]
        node, n = np.zeros(len(rows), np.int64), 1
        keys, below, ends = [], [], []
        for level in range(rows.shape[1]):
            here = np.flatnonzero(depths > level)
            if not len(here):
                break
            key = node[here] * self.width + rows[here, level] + 1
            first = np.diff(key, prepend=-1) != 0
            child = n + np.cumsum(first) - 1
            keys.append(key[first])
            below.append(child[first])
            node[here], n = child, n + int(first.sum())
            done = depths[here] == level + 1
            ends.append((child[done], order[here[done]]))
        #: Edges by (node, count); they are in this order level by level, as nodes are numbered that way.
        self.keys, self.below = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, below))
        self.row = np.full(n, -1)
        for child, row in ends:
            self.row[child] = row

    def walk(self, vectors: np.ndarray, surplus: int, deficit: int, strict: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vector, row) of every row within the budget; the first ``strict`` columns must be equal. Many vectors go
        down together; too many states are halved, and one half waits."""
        if not len(self.keys):
            return
        n = len(vectors)
        waiting = [(0, np.arange(n), np.zeros(n, np.int64), np.full(n, surplus), np.full(n, deficit))]
        while waiting:
            level, of, node, s, d = waiting.pop()
            if len(of) > TOGETHER:
                half = len(of) // 2
                waiting += [(level, of[:half], node[:half], s[:half], d[:half]), (level, of[half:], node[half:], s[half:], d[half:])]
                continue
            parts = []
            for step, may in ((0, None), (1, s > 0), (-1, (d > 0) & (s == 0))):
                at = np.arange(len(of)) if may is None else np.flatnonzero(may) if level >= strict else np.zeros(0, np.int64)
                key = node[at] * self.width + vectors[of[at], level] + (1 + step)
                # A count beyond the widest one has no edge, and would be another node's.
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[place] == key) & (vectors[of[at], level] + step <= self.width - 3)
                at, place = at[hit], place[hit]
                parts.append((of[at], self.below[place], s[at] - (step == 1), d[at] - (step == -1)))
            of, node, s, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            done = self.row[node] >= 0
            if done.any():
                yield of[done], self.row[node[done]]
                of, node, s, d = (x[~done] for x in (of, node, s, d))
            if len(of):
                waiting.append((level + 1, of, node, s, d))


class Top:
    """The shards: paths (length, counts of the groups in ``order``) where the trie is cut."""

    def __init__(self, order: list[int], shards: list[tuple[tuple[int, ...], int]], parts: list[int]):
        self.order, self.parts = np.array(order), np.array(parts)
        depth = max(map(len, (p for p, _ in shards)), default=1)
        rows = np.array([[*p, *[0] * (depth - len(p))] for p, _ in shards], np.int64).reshape(-1, depth)
        self.trie, self.depth = Trie(rows, np.array([len(p) for p, _ in shards], np.int64)), depth

    def paths(self, codes: np.ndarray, sizes: np.ndarray, longer: int = 0) -> np.ndarray:
        ordered = vectors(codes, sizes)[:, self.order[: self.depth - 1]]
        return np.column_stack([np.minimum(sizes + longer, LONGEST), ordered])

    def homes(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.reached(codes, sizes, 0, 0, 0)

    def reached(self, codes: np.ndarray, sizes: np.ndarray, longer: int, surplus: int, deficit: int) -> tuple[np.ndarray, np.ndarray]:
        found = list(self.trie.walk(self.paths(codes, sizes, longer), surplus, deficit, strict=1))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def cut(found: DataFrame) -> Top:
    """The shards of the words of ``found`` (materialised)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = vectors(*codes_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(made.sum(0)), pa.array((made**2).sum(0))], names=["g", "s", "q"])

    whole = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("word")).alias("letters")).first()
    rows = found.select("word").mapInArrow(sums, "g long, s long, q long").groupBy("g").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    spread = {r.g: r.q / whole.n - (r.s / whole.n) ** 2 for r in rows}
    order = sorted(range(GROUPS), key=lambda g: (-spread.get(g, 0), g))
    most = max(LEAST_LETTERS, (whole.letters or 0) // SHARDS)

    def below(large: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
        """The nodes under ``large`` nodes (all of one depth; [()] is the root) with their letters."""
        depth = len(large[0])
        known = {p: i for i, p in enumerate(large)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, sizes = codes_of(batch.column(0))
                ordered = np.column_stack([np.minimum(sizes, LONGEST), vectors(codes, sizes)[:, order[:depth]]])
                heads, inverse = np.unique(ordered[:, :depth], axis=0, return_inverse=True) if depth else (np.zeros((1, 0)), np.zeros(len(sizes), np.int64))
                parent = np.array([known.get(tuple(h), -1) for h in heads.tolist()], np.int64)[inverse]
                under = parent >= 0
                yield pa.RecordBatch.from_arrays([pa.array(parent[under]), pa.array(ordered[under, depth]), pa.array(sizes[under])], names=["parent", "count", "letters"])

        got = found.select("word").mapInArrow(count, "parent long, count long, letters long").groupBy("parent", "count").agg(F.sum("letters").alias("letters"))
        return [((*large[r.parent], r["count"]), r.letters) for r in got.collect()]

    shards, large = [], [()]
    while large:
        nodes = below(large)
        shards += [(p, w) for p, w in nodes if w <= most or len(p) > GROUPS]
        large = [p for p, w in nodes if w > most and len(p) <= GROUPS]
    shards.sort()
    return Top(order, shards, [math.ceil(w / most) for _, w in shards])


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` (code points, as long as those of ``a`` or longer by one) are one edit from those of ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    ahead, behind = a == b[:, :n], a == b[:, 1:]
    before = np.where(ahead.all(1), n, np.argmin(ahead, 1))
    after = np.where(behind.all(1), n, np.argmin(behind[:, ::-1], 1))
    return before + after >= n


def pairs_of_length(asked: tuple[np.ndarray, np.ndarray], there: tuple[np.ndarray, np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, row) one edit apart: words that ask and words of the trie (code points of words of one length each, in
    rows, and their vectors in the order of the trie). Where both have one length, pairs with equal vectors are met twice."""
    (codes, counts), (codes_there, counts_there) = asked, there
    leaves, leaf_of = np.unique(counts_there, axis=0, return_inverse=True)
    members = np.argsort(leaf_of, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(leaf_of, minlength=len(leaves)))])
    heads, head_of = np.unique(counts, axis=0, return_inverse=True)
    askers = np.argsort(head_of, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(head_of, minlength=len(heads)))])
    trie = Trie(leaves, np.full(len(leaves), leaves.shape[1]))
    most = max(1, TOGETHER // codes_there.shape[1])
    for head, leaf in trie.walk(heads, 1, int(same)):
        n_there = (first[leaf + 1] - first[leaf])
        of = np.repeat(np.arange(len(head)), begin[head + 1] - begin[head])  # one for each word that asks at a leaf
        asker = askers[begin[head[of]] + np.arange(len(of)) - np.searchsorted(of, of)]
        upto = np.cumsum(n_there[of])
        start = 0
        while start < len(of):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
            n = n_there[of[start:stop]]
            a = np.repeat(asker[start:stop], n)
            b = members[np.repeat(first[leaf[of[start:stop]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            good = verified(codes[a], codes_there[b])
            yield a[good], b[good]
            start = stop


def near_pairs(found: DataFrame) -> DataFrame:
    """Every pair of words of ``found`` (word, n; materialised) one edit apart, both ways: word, near, near_n."""
    top = cut(found)
    shared = found.sparkSession.sparkContext.broadcast(top)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for batch in batches:
            codes, sizes = codes_of(batch.column(0))
            row, shard = top.homes(codes, sizes)
            rows = [(row, shard, row % top.parts[shard], np.ones(len(row), bool))]
            for longer, deficit in ((0, 1), (1, 0)):
                row, shard = top.reached(codes, sizes, longer, 1, deficit)
                row, shard = np.unique(np.column_stack([row, shard]), axis=0).T
                of = np.repeat(np.arange(len(row)), top.parts[shard])
                rows.append((row[of], shard[of], np.arange(len(of)) - np.searchsorted(of, of), np.zeros(len(of), bool)))
            row, shard, part, home = (np.concatenate(x) for x in zip(*rows, strict=True))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part), pa.array(home), batch.column(0).take(at), batch.column(1).take(at)], names=["shard", "part", "home", "word", "n"])

    def search(rows: pa.Table) -> pa.Table:
        order = shared.value.order  # one order for all: which word of a pair has the first surplus depends on it
        size, home = pc.utf8_length(rows.column("word")).to_numpy(), rows.column("home").to_numpy()
        names, n = rows.column("word").combine_chunks(), rows.column("n").to_numpy()
        first, second = [], []

        def of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            codes, sizes = codes_of(names.take(pa.array(place)))
            return codes.reshape(len(place), -1), vectors(codes, sizes)[:, order]

        for length in np.unique(size[home]).tolist():
            there = np.flatnonzero(home & (size == length))
            known = of(there)
            for same in (True, False):
                asks = np.unique(names.take(pa.array(np.flatnonzero(~home & (size == length - (not same))))).to_numpy(zero_copy_only=False), return_index=True)[1]
                asks = np.flatnonzero(~home & (size == length - (not same)))[asks]
                if not len(asks):
                    continue
                for a, b in pairs_of_length(of(asks), known, same):
                    first.append(asks[a])
                    second.append(there[b])
        a, b = (pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (first, second))
        numbers = pa.array(n)
        return pa.table({"word": names.take(a), "n": numbers.take(a), "near": names.take(b), "near_n": numbers.take(b)})

    routed = found.select("word", "n").mapInArrow(route, "shard long, part long, home boolean, word string, n long")
    met = routed.groupBy("shard", "part").applyInArrow(search, "word string, n long, near string, near_n long")
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return met.select(both.alias("p")).select("p.*").distinct()


def variants(docs: DataFrame, *, least: int = 7, occurrences: int = 2, noise: int | None = 31, times: int = 10) -> DataFrame:
    """Words with form (the near word of largest n, if that is at least ``times`` the word's n), root (where forms
    end), n, n_near (near words) and form_n."""
    store = Stored(docs.sparkSession)
    found = store.put("words", words(docs, least=least, occurrences=occurrences, noise=noise))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form = F.when(-F.col("best.n") >= times * F.col("n"), F.col("best.word"))
    judged = store.put(
        "judged",
        found.join(near, "word", "left").select(
            "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n")
        ),
    )
    # Every form is ``times`` as frequent as its word: a chain has few steps, and each round doubles what is followed.
    largest = judged.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(max(largest, 2), max(times, 2)))
    roots = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for turn in range(max(1, math.ceil(math.log2(max(steps, 2))))):
        roots = store.put(f"roots{turn}", roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
