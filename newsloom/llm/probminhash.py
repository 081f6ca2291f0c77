"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every text becomes its five-word shingles with weights 1.25 - 0.25 / times seen, from 1 up to 1.25. Each
shingle is a Poisson process of arrivals whose rate is its weight; an arrival falls into one of the
signature's registers, which keep their earliest shingle, and a shingle stops as soon as its next arrival
is later than every register (early termination). Two texts agree in a register with their probability
Jaccard similarity. A link is a Jaccard similarity of 0.8 or more of the *sets* of shingles: as weights
stay within 1 and 1.25, such a pair has a probability Jaccard similarity of 0.64 at the very least (all
shared shingles weighed differently) and of 0.76 or more if only shingles of one side repeat. With 24
bands of 4 registers it shares no band with chance 3e-6 without repeats, 5e-5 and 1.2 per cent in these cases.

1. Texts with equal word sequences are one node, found by digest; signatures are only banded per node.
2. Nodes that share a band's registers form buckets. Each member of a bucket is compared with the
   bucket's least node: as many comparisons as members, however large a group of copies is.
3. Verified comparisons give components. What is left are pairs of one bucket in different
   components: a bucket's largest component against the rest, and the rest among themselves, dealt
   to meetings of two bounded blocks. Pairs whose signatures agree in 55 per cent of the registers are compared
   too, unless links of the same meeting join them already, so no pair but a link leaves a meeting.
4. A comparison is exact: the sets of shingle digests (64 bits).

Classes are the connected components; a class keeps one row of its smallest doc_id.

Defined results: null text is empty; texts without a word are equal only if they are identical, and
are near to nothing; a text of fewer than five words has one shingle, all its words; a null doc_id
sorts after all others; of repeated rows one is kept; extra columns are not read. Intermediate tables
stand in ``spark.checkpoint.dir``; those that the result does not read are removed on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ._common import Stored, broadcast_if_small, giving_back, rows_kept, text_blocks, text_digest, with_row_id

U64 = np.uint64
#: Odd multipliers of a shingle's words, by place.
MULTIPLIERS = [U64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(64)]


class Words(dict):
    """Digest of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = digest = xxhash.xxh64_intdigest(word)
        return digest


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A well-mixed digest of each 64-bit number (the finaliser of splitmix64)."""
    x = x + U64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def cut(texts: list[str], words: Words, width: int) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(words of each text, owner, shingle): the shingle digests of all texts in a row, repeats included.

    A text has a shingle for each run of ``width`` words, and one of all its words if it has fewer.
    """
    found = [t.lower().split() for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    digests = np.fromiter(chain.from_iterable(map(words.__getitem__, f) for f in found), U64, int(sizes.sum()))
    padded = np.concatenate([digests, np.zeros(width, U64)])
    place = np.arange(len(digests)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place  # words from here to the end of the text
    total = np.zeros(len(digests), U64)
    for i in range(width):
        total += np.where(left > i, padded[i : i + len(digests)], U64(0)) * MULTIPLIERS[i]
    whole = (left >= width) | (place == 0)
    return found, np.repeat(np.arange(len(texts)), sizes)[whole], mixed(total[whole], width)


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """[texts, registers] int32; all texts advance together, one arrival of every live shingle per round."""
    earliest = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, U64)
    table, latest = earliest.reshape(texts, registers), np.zeros(texts)
    time = np.zeros(len(owner))
    arrival = 0
    while len(owner):
        arrival += 1
        bits = mixed(shingle, arrival)
        time = time - np.log(((bits >> U64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        slot = owner * registers + (mixed(bits, 77) % U64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        holder[slot[won]] = shingle[won]
        now = owner[np.append(True, owner[1:] != owner[:-1])]  # texts that still have arrivals
        latest[now] = table[now].max(axis=1)
        live = time < latest[owner]
        owner, shingle, weight, time = owner[live], shingle[live], weight[live], time[live]
    # A register's number is mixed in: values of different registers differ, so agreement is a set intersection.
    register = np.tile(np.arange(registers, dtype=U64), texts)
    return (mixed(holder * U64(31) + register, 5) >> U64(32)).astype(np.uint32).view(np.int32).reshape(texts, registers)


def sketch(texts: list[str], words: Words, width: int, registers: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(key of the word sequence, number of shingles, signature) of each text."""
    found, owner, all_shingles = cut(texts, words, width)
    keys = ["w" + xxhash.xxh128_hexdigest(" ".join(f)) if f else "t" + xxhash.xxh128_hexdigest(t) for f, t in zip(found, texts, strict=True)]
    order = np.lexsort((all_shingles, owner))
    owner, all_shingles = owner[order], all_shingles[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (all_shingles[1:] != all_shingles[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(owner)))
    owner, all_shingles = owner[at], all_shingles[at]
    return keys, np.bincount(owner, minlength=len(texts)), signatures(owner, all_shingles, 1.25 - 0.25 / times, len(texts), registers)


def sketches(docs: DataFrame, *, width: int, registers: int, batch_chars: int = 1_000_000) -> DataFrame:
    """doc_id, text_digest, key, n_shingles, signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start, texts in text_blocks(batch.column("text"), batch_chars):
                keys, sizes, signature = sketch(texts, words, width, registers)
                rows = batch.slice(start, len(texts))
                ends = np.arange(0, signature.size + 1, registers, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("text_digest"),
                        pa.array(keys),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(signature.ravel())),
                    ],
                    names=["doc_id", "text_digest", "key", "n_shingles", "signature"],
                )

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("text_digest"), text.alias("text")).mapInArrow(
        giving_back(run), "doc_id long, text_digest binary, key string, n_shingles int, signature array<int>"
    )


def shingle_sets(texts: DataFrame, *, width: int, batch_chars: int = 1_000_000) -> DataFrame:
    """node and its distinct shingle digests, from rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start, part in text_blocks(batch.column("text"), batch_chars):
                _, owner, found = cut(part, words, width)
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                sets = [np.unique(found[i:j]).view(np.int64) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(start, len(part)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))),
                    ], names=["node", "shingles"]
                )

    return texts.mapInArrow(giving_back(run), "node long, shingles array<long>")


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether two sets have a Jaccard similarity of ``threshold`` or more."""
    common = F.size(F.array_intersect(a, b))
    return common >= (F.size(a) + F.size(b) - common) * F.lit(threshold) - 1e-9


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "_a"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "shingles": "_b"}),
        "b",
    )
    return both.filter(similar(F.col("_a"), F.col("_b"), threshold)).select("a", "b")


def components(edges: DataFrame, stored: Stored, name: str) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b).

    Each round takes the least label among the neighbours and then the label of the label; the rounds
    grow with the logarithm of a component's diameter. Only their number of changes reaches the driver,
    and only the last round's labels stay on disk.
    """
    ways = stored.put(f"{name}-ways", edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored.put(f"{name}-0", ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    turn = 0
    while True:
        near = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        stepped = hooked.join(jump, "component").select("node", "old", F.least("component", "next").alias("component"))
        changed = Observation()
        labels = stored.put(f"{name}-{turn + 1}", stepped.observe(changed, F.count_if(F.col("old") != F.col("component")).alias("n"))).drop("old")
        stored.drop(f"{name}-{turn}")
        turn += 1
        if not changed.get["n"]:
            stored.drop(f"{name}-ways")
            return labels


def joined_by(more: DataFrame, parts: DataFrame, stored: Stored) -> DataFrame:
    """``parts`` (node, component) after the further links (a, b): only the components that these touch are labelled anew."""
    name = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("_a", "a").alias("a"),
        F.coalesce("_b", "b").alias("b"),
    )
    over = components(between, stored, "over").select(F.col("node").alias("component"), F.col("component").alias("_over"))
    # A node that had no link is its own component; it is not in ``parts``.
    nodes = parts.unionByName(
        more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").withColumn("component", F.col("node"))
    )
    return nodes.join(over, "component", "left").select("node", F.coalesce("_over", "component").alias("component"))


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (band, node, component, ...) of open buckets, dealt to meetings of two blocks.

    One component of each bucket, the largest, need not be compared with itself. The others (the rest)
    stand on the left, all rows on the right, each in blocks of about ``block`` rows by digest, and every
    left block meets every right one under a key of its own: no task needs more than two blocks at once,
    and a large component costs only its size times the number of blocks of the rest.
    """
    members = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("_largest"),
        F.sum("n").alias("_all"),
        F.max("n").alias("_most"),
    )
    wide = rows.join(sizes, "band").withColumns(
        {
            "rest": F.col("component") != F.col("_largest"),
            "_l": F.expr(f"(_all - _most - 1) div {block} + 1"),
            "_r": F.expr(f"(_all - 1) div {block} + 1"),
            "_h": F.xxhash64("node"),
        }
    )
    kept = rows.columns
    left = wide.filter("rest").select(
        *kept,
        "rest",
        F.lit(True).alias("on_left"),
        F.expr("pmod(_h, _l)").alias("l"),
        F.explode(F.expr("sequence(0L, _r - 1)")).alias("r"),
    )
    right = wide.select(
        *kept,
        "rest",
        F.lit(False).alias("on_left"),
        F.explode(F.expr("sequence(0L, _l - 1)")).alias("l"),
        F.expr("pmod(_h, _r)").alias("r"),
    )
    return left.unionByName(right).repartition("band", "l", "r").sortWithinPartitions("band", "l", "r")


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each meeting of blocks, from batches sorted by band, l and r."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "l", "r")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(keys[:, start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def agreeing(met: pa.Table, registers: int, least: int, ratio: float, tile: int = 512) -> Iterator[
    tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
]:
    """Row numbers (i, j) of a meeting and the signatures: pairs of different components whose sizes allow
    a link and that agree in ``least`` registers or more; pairs of two rest rows once."""
    on_left, rest = met.column("on_left").to_numpy(), met.column("rest").to_numpy()
    component, size, node = (met.column(c).to_numpy() for c in ("component", "n_shingles", "node"))
    signature = met.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, registers)
    left, right = np.flatnonzero(on_left), np.flatnonzero(~on_left)
    for a in range(0, len(left), tile):
        i = left[a : a + tile]
        for b in range(0, len(right), tile):
            j = right[b : b + tile]
            apart = component[i][:, None] != component[j]
            apart &= np.minimum(size[i][:, None], size[j]) >= np.maximum(size[i][:, None], size[j]) * ratio - 1e-9
            apart &= ~rest[j] | (node[i][:, None] < node[j])
            if not apart.any():
                continue
            agree = np.zeros(apart.shape, np.int16)
            for r in range(registers):
                agree += signature[i, r][:, None] == signature[j, r]
            x, y = np.nonzero(apart & (agree >= least))
            if len(x):
                yield i[x], j[y], signature[i[x]], signature[j[y]]


def first_shared(s: np.ndarray, t: np.ndarray, number: np.ndarray, bands: int) -> np.ndarray:
    """Whether the band of this meeting (``number``) is the first that two signatures share: pairs are compared there only."""
    shared = (s == t).reshape(len(s), bands, -1).all(axis=2)
    return shared.any(axis=1) & (shared.argmax(axis=1) == number)


def partners(rows: DataFrame, *, threshold: float, bands: int, registers: int, least: int, block: int) -> DataFrame:
    """The places (band, node) of ``rows`` where a node has an agreeing partner in another component that is to be compared there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in meetings(batches):
            node, number, found = met.column("node").to_numpy(), met.column("number").to_numpy(), set()
            for i, j, s, t in agreeing(met, registers, least, threshold):
                here = first_shared(s, t, number[i], bands)
                found.update(node[i[here]].tolist(), node[j[here]].tolist())
            if found:
                band = met.column("band")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([band] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())],
                    names=["band", "node"],
                )

    return dealt(rows, block).mapInArrow(giving_back(run), "band long, node long").distinct()


def links_between(rows: DataFrame, sets: DataFrame, *, threshold: float, bands: int, registers: int, least: int, block: int) -> DataFrame:
    """Links (a, b) between different components of one bucket, from rows (band, node, component, n_shingles, signature).

    A pair is compared exactly in the first band that it shares, unless links found before in the same
    meeting already join its components: what leaves a meeting are fewer links than it has components.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in meetings(batches):
            node, component, number = (met.column(c).to_numpy() for c in ("node", "component", "number"))
            lists = met.column("shingles").combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            shingles = lambda k: flat[ends[k] : ends[k + 1]]  # noqa: B023, E731
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:  # noqa: B023
                    root[x] = x = root.get(up, up)  # noqa: B023
                return x

            a, b = [], []
            for i, j, s, t in agreeing(met, registers, least, threshold):
                first = first_shared(s, t, number[i], bands)
                for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                    p, q = find(int(component[x])), find(int(component[y]))
                    if p == q:
                        continue
                    u, v = shingles(x), shingles(y)
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    if common >= (len(u) + len(v) - common) * threshold - 1e-9:
                        root[max(p, q)] = min(p, q)
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt(rows.join(sets, "node"), block).mapInArrow(giving_back(run), "a long, b long").distinct()


def judged_rows(
    docs: DataFrame,
    *,
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 24,
    rows: int = 4,
    agreement: float = 0.55,
    block: int = 1024,
) -> DataFrame:
    """The columns of ``near_classes`` and text_digest."""
    registers, stored = bands * rows, Stored(docs.sparkSession)
    made = stored.put("made", with_row_id(sketches(docs, width=width, registers=registers)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    of_node = F.min_by(F.struct("doc_id", "text_digest", "n_shingles", "signature"), "_row")
    copies = made.groupBy("key").agg(F.min("_row").alias("node"), first.alias("best"), F.count(F.lit(1)).alias("n_copies"), of_node.alias("_of"))
    nodes = stored.put("nodes", copies.select("key", "node", "best", "n_copies", "_of.*"))
    with_words = nodes.filter("n_shingles > 0")
    band = lambda i: F.xxhash64(F.lit(i), F.slice("signature", i * rows + 1, rows))
    banded = with_words.select("node", "n_shingles", F.posexplode(F.array(*[band(i) for i in range(bands)])).alias("number", "band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = stored.put("members", banded.join(buckets, "band"))

    # A text is found by its digest and doc_id; equal ones are the same text, so one is enough.
    known = stored.put(
        "known",
        with_words.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("_id"), "text_digest"),
    )
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("text_digest"), text.alias("text")).join(
        broadcast_if_small(known),
        "text_digest",
    )
    texts = found.filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    sets = stored.put("sets", shingle_sets(texts, width=width).groupBy("node").agg(F.first("shingles").alias("shingles")))

    stars = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    parts = components(stored.put("links", linked(stars, sets, threshold)), stored, "parts")

    labelled = members.join(parts, "node", "left").select("node", "n_shingles", "number", "band", F.coalesce("component", "node").alias("component"))
    several = lambda some: some.groupBy("band").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    ).filter("low <> high").select("band")
    open_rows = stored.put("open", labelled.join(several(labelled), "band", "left_semi").join(with_words.select("node", "signature"), "node"))
    stored.drop("members", "known", "links")
    sizes = {"threshold": threshold, "bands": bands, "registers": registers, "least": int(agreement * registers), "block": block}
    likely = stored.put("likely", open_rows.join(partners(open_rows, **sizes), ["band", "node"], "left_semi"))
    more = stored.put("more", links_between(likely, sets, **sizes))
    parts = stored.put("classes", joined_by(more, parts, stored))
    stored.drop("open", "likely", "sets", "more")

    classed = nodes.select("key", "node", "best", "n_copies").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = classed.groupBy("component").agg(F.min("best").alias("first"), F.sum("n_copies").alias("class_size"))
    by_key = classed.join(classes, "component").select(
        "key", F.col(
            "first.doc_id"
        ).alias("class_id"), F.col("first._row").alias("_kept"), "class_size", F.col("best.doc_id").alias("copy_id"), "n_copies"
    )
    joined = made.select("doc_id", "key", "n_shingles", "_row", "text_digest").join(by_key, "key")
    return joined.select(
        "doc_id",
        "class_id",
        "class_size",
        (F.col("_row") == F.col("_kept")).alias("kept"),
        "copy_id",
        "n_copies",
        "n_shingles",
        "text_digest",
    )


def near_classes(docs: DataFrame, **parameters) -> DataFrame:
    """One row per input row: doc_id, class_id (least doc_id of the class), class_size, kept (true for the
    first row of class_id), copy_id (least doc_id of its equal texts), n_copies, n_shingles.
    """
    return judged_rows(docs, **parameters).drop("text_digest")


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class; ids may repeat or be null."""
    judged = judged_rows(docs, **parameters).select("doc_id", "text_digest", "kept")
    return rows_kept(docs, judged, F.col("doc_id").cast("long"))
