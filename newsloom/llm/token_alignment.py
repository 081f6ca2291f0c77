"""Cross-tokenizer alignment over token-byte incidence matrices.

A text is encoded by a byte-level BPE (A, tokenizers format) and by a SentencePiece model (B). Both cut
the same bytes; the offsets where tokens of both end cut a text into groups. Links are found in matrices
kept as compressed sparse rows (numpy arrays, built here): A has a row for each token of A with its
bytes, B a row for each token of B. The row products of A with the transpose of B (Gustavson: a row of
the product is the sum of the rows that the left row names) are the overlap links with their number of
shared bytes; the products of the group incidences are the links of tokens that share a group.

Tasks work block by block (half a million characters). Equal groups of a block are multiplied once, and a
block hands on each of its pairs of ids once, with its count. The counts of all blocks are summed, the
highest of each id of B is found, and each block gets back the counts of its own pairs. So neither links
nor texts are shuffled, only a block's distinct pairs and the numbers of its groups; no table of all pairs
has to fit anywhere.

Defined results: null and empty texts have no tokens, nor have texts whose joined token bytes differ from
space + text (B reads U+2581 as a space); they get zeros and an empty digest. Special tokens inside texts
are plain text. Ids may be null or repeat; extra columns pass through, but those with the name of a made
column give way; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Stored, text_blocks
from .sentencepiece_codec import BYTE, MARK, PROBES, Codec, verify_parity

#: How byte-level models of this kind cut words: the public pattern, a fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a product that are made at once.
TOGETHER = 4_000_000
COUNTS = "n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others behind U+00FF."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids and token bytes of a byte-level BPE. Where its merges are in the order of the ids, words are
    merged by rank; other models are left to the tokenizers library."""

    def __init__(self, data: bytes):
        self.data = data
        said, letters = json.loads(data), byte_letters()
        vocabulary, cut = said["model"]["vocab"], said["pre_tokenizer"] or {}
        self.bytes_of = [b""] * (max([*vocabulary.values(), *[t["id"] for t in said["added_tokens"]]]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"].get("merges", [])]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said["normalizer"]
        self.ranked = None
        if plain and all(vocabulary.get("".join(m)) == 256 + i for i, m in enumerate(merges)):
            import tiktoken

            ranks = {self.bytes_of[i]: i for i in range(256 + len(merges))}
            self.ranked = tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.data.decode())
        library.encode_special_tokens = True
        return library

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked is not None:
            return [self.ranked.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in texts]
        return [np.array(e.ids, np.int64) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def verify(self) -> None:
        """Raises ValueError where the ids of the probes are not the library's."""
        for text in PROBES:
            if self.encode([text])[0].tolist() != self.library.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"ids differ for {text[:80]!r}")


class Pieces:
    """Ids and token bytes of a SentencePiece model, rebuilt on the tokenizers library."""

    def __init__(self, data: bytes):
        self.codec = Codec(data)
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.codec.model.pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.codec.encode(texts)


def row_products(rows: np.ndarray, columns: np.ndarray, other_rows: np.ndarray, other_columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and value of the entries of the product of two 0/1 matrices in compressed sparse rows
    (row ends from 0 on, column numbers), some million summands at a time and never a row in two."""
    size = np.diff(other_rows)[columns]
    upto = np.concatenate([[0], np.cumsum(size)])[rows]
    start, width = 0, int(other_columns.max(initial=0)) + 1
    while start < len(rows) - 1:
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + TOGETHER, side="right")) - 1)
        inside = slice(rows[start], rows[stop])
        n, named = size[inside], columns[inside]
        row = np.repeat(np.repeat(np.arange(start, stop), np.diff(rows[start : stop + 1])), n)
        place = np.arange(len(row)) + np.repeat(other_rows[named] - (np.cumsum(n) - n), n)
        key = row * width + other_columns[place]
        if (np.diff(key) < 0).any():
            key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        yield key[first] // width, key[first] % width, np.diff(first, append=len(key))
        start = stop


def ends_from(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def overlap_links(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens (places in A and B, by their numbers of bytes) that share bytes, and how many: A · Bᵀ."""
    rows = ends_from(sizes_a)
    owner = np.repeat(np.arange(len(sizes_b)), sizes_b)  # Bᵀ: each byte names its token
    return row_products(rows, np.arange(rows[-1]), np.arange(len(owner) + 1), owner)


def group_links(groups_a: np.ndarray, groups_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens that share a group, from the group of every token (not decreasing): the product of the incidences."""
    rows = np.concatenate([[0], np.cumsum(np.bincount(groups_b, minlength=int(groups_a.max(initial=-1)) + 1))])
    return row_products(np.arange(len(groups_a) + 1), groups_a, rows, np.arange(len(groups_b)))


def spread(ids: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    x = (ids.astype(np.uint64) << np.uint64(24)) + place.astype(np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Block:
    """The tokens of texts that stand behind each other, cut into groups; equal groups have one number."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids_a, ids_b))
        ends_a, ends_b = ends_from(sizes_a[self.a]), ends_from(sizes_b[self.b])
        marks = np.zeros(ends_a[-1] + 1, np.int8)
        marks[ends_a] = 1
        marks[ends_b] += 1
        #: First token of every group, and the end of the last one.
        self.first_a, self.first_b = np.flatnonzero(marks[ends_a] == 2), np.flatnonzero(marks[ends_b] == 2)
        self.n_a, self.n_b = np.diff(self.first_a), np.diff(self.first_b)
        #: Groups in front of each text's end.
        self.text_ends = np.searchsorted(self.first_a, ends_from(np.array([len(x) for x in ids_a], np.int64)))
        self.number()

    def of_groups(self, groups: np.ndarray) -> tuple[np.ndarray, ...]:
        """Group (counted from 0) and place of every token of the ``groups``, in A and in B."""
        out = []
        for first, n in ((self.first_a, self.n_a), (self.first_b, self.n_b)):
            sizes = n[groups]
            of = np.repeat(np.arange(len(groups)), sizes)
            out += [of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[groups], sizes)]
        return tuple(out)

    def number(self) -> None:
        hashes = np.zeros(len(self.n_a), np.uint64)
        if len(hashes):
            for seed, (ids, first, n) in enumerate(((self.a, self.first_a, self.n_a), (self.b, self.first_b, self.n_b))):
                hashes += np.add.reduceat(spread(ids, np.arange(len(ids)) - np.repeat(first[:-1], n), seed << 50), first[:-1])
        _, self.sample, self.group = np.unique(hashes, return_index=True, return_inverse=True)
        like = self.sample[self.group]
        same = (self.n_a[like] == self.n_a).all() and (self.n_b[like] == self.n_b).all()
        if same:
            _, at, _, bt = self.of_groups(like)
            same = (self.a[at] == self.a).all() and (self.b[bt] == self.b).all()
        if not same:  # one hash for two groups: number them by their ids
            whole = [(self.a[i:j].tobytes(), self.b[k:m].tobytes()) for i, j, k, m in zip(self.first_a, self.first_a[1:], self.first_b, self.first_b[1:])]
            places: dict = {}
            self.group = np.array([places.setdefault(w, len(places)) for w in whole])
            _, self.sample = np.unique(self.group, return_index=True)

    def names(self) -> list[str]:
        """The ids of every distinct group, as text."""
        _, at, _, bt = self.of_groups(self.sample)
        a, b = list(map(str, self.a[at].tolist())), list(map(str, self.b[bt].tolist()))
        ends = [x.tolist() for n in (self.n_a, self.n_b) for e in [ends_from(n[self.sample])] for x in (e[:-1], e[1:])]
        return [f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in zip(*ends, strict=True)]

    def links(self, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group number and pair (id of A * 2^32 + id of B) of every overlap link of the distinct groups."""
        of_a, at, _, bt = self.of_groups(self.sample)
        a, b = self.a[at], self.b[bt]
        found = [(of_a[i], (a[i] << 32) + b[j]) for i, j, _ in overlap_links(sizes_a[a], sizes_b[b])]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Encoders:
    """Both tokenizers in a task."""

    def __init__(self, data_a: bytes, data_b: bytes):
        self.a, self.b = ByteLevel(data_a), Pieces(data_b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in e.bytes_of], np.int64) for e in (self.a, self.b))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A of space + text and by B of the text; none for texts whose bytes either does not give back."""
        some = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int64)
        out: tuple[list, list] = ([none] * len(texts), [none] * len(texts))
        made = zip(some, self.a.encode([" " + texts[i] for i in some]), self.b.encode([texts[i] for i in some]), strict=True)
        for i, a, b in made:
            said = (" " + texts[i]).encode()
            # Ranked tokens are cut out of the text itself: their sizes tell whether all of it is there.
            whole = self.sizes_a[a].sum() == len(said) if self.a.ranked is not None else b"".join(map(self.a.bytes_of.__getitem__, a.tolist())) == said
            if whole and b"".join(map(self.b.bytes_of.__getitem__, b.tolist())) == said:
                out[0][i], out[1][i] = a, b
        return out


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each end and the next."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def align(
    docs: DataFrame, path_a: str, path_b: str, *, column: str = "text", carry: list[str] | None = None, block_chars: int = 500_000
) -> DataFrame:
    """Rows of ``docs`` (its columns ``carry``, all if not given) with n_a, n_b, n_groups, n_links (overlap
    links), n_group_links (pairs of tokens that share a group), groups_sha256, n_best (links whose pair is
    as frequent as any of its id of B) and count_sum (links by the frequency of their pair)."""
    data_a, data_b = model_bytes(path_a), model_bytes(path_b)
    ByteLevel(data_a).verify()
    verify_parity(path_b)
    sc = docs.sparkSession.sparkContext
    shared_a, shared_b = sc.broadcast(data_a), sc.broadcast(data_b)
    made = T.StructType.fromDDL(COUNTS)
    names = [f.name for f in docs.schema if f.name not in {*made.names, "n_best", "count_sum"} and (carry is None or f.name in carry)]
    carried = docs.select(F.struct(*names, F.lit(0)).alias("carried"), F.col(column).alias("text"))
    more = T.StructType.fromDDL("groups array<int>, pairs array<long>, counts array<long>, link_ends array<int>, links array<int>")
    kept = T.StructField("carried", carried.schema["carried"].dataType)
    first = T.StructType([T.StructField("block", T.LongType()), kept, *made.fields, *more.fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, block = Encoders(shared_a.value, shared_b.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in text_blocks(batch.column("text"), block_chars):
                ids_a, ids_b = encoders.encode(texts)
                b = Block(ids_a, ids_b, encoders.sizes_a, encoders.sizes_b)
                of, pair = b.links(encoders.sizes_a, encoders.sizes_b)
                times = np.bincount(b.group, minlength=len(b.sample))
                pairs, links = np.unique(pair, return_inverse=True)
                order = np.argsort(of, kind="stable")
                counts = np.zeros(len(pairs), np.int64)
                np.add.at(counts, links, times[of])
                per_group = np.bincount(of, minlength=len(b.sample))
                named, n = b.names(), len(texts)
                said = [";".join(map(named.__getitem__, b.group[i:j].tolist())) for i, j in zip(b.text_ends, b.text_ends[1:])]
                columns = [
                    pa.array(np.full(n, block)),
                    batch.column("carried").slice(start, n),
                    pa.array([len(x) for x in ids_a], pa.int64()),
                    pa.array([len(x) for x in ids_b], pa.int64()),
                    pa.array(np.diff(b.text_ends)),
                    pa.array(sums(per_group[b.group], b.text_ends)),
                    pa.array(sums(b.n_a * b.n_b, b.text_ends)),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]),
                    pa.ListArray.from_arrays(pa.array(b.text_ends.astype(np.int32)), pa.array(b.group.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, t) for t in lists]], names=first.names)
                whole = [pairs, counts, ends_from(per_group).astype(np.int32), links[order].astype(np.int32)]
                whole = [pa.array([x], t) for x, t in zip(whole, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.nulls(1, c.type) for c in columns[1:]], *whole], names=first.names)
                block += 1

    lists = [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    blocks = Stored(docs.sparkSession).put("blocks", carried.mapInArrow(encode, first))
    each = blocks.filter("pairs IS NOT NULL").select(F.col("block").alias("of"), F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("of", "p.pairs", "p.counts")
    total = each.groupBy("pairs").agg(F.sum("counts").alias("count"))
    piece = F.col("pairs").bitwiseAND(F.lit((1 << 32) - 1)).alias("piece")
    highest = total.groupBy(piece).agg(F.max("count").alias("highest"))
    known = total.withColumn("piece", piece).join(highest, "piece").select("pairs", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = each.select("of", "pairs").join(known, "pairs").select("of", "pairs", "count", "best")
    out = T.StructType([blocks.schema["carried"], *made.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        is_block = left.column("carried").is_null().to_numpy()
        one = {c: left.column(c).filter(pa.array(is_block))[0].values.to_numpy() for c in ("pairs", "link_ends", "links")}
        rows = left.filter(pa.array(~is_block)).combine_chunks()
        order = np.argsort(right.column("pairs").to_numpy())
        place = order[np.searchsorted(right.column("pairs").to_numpy(), one["pairs"], sorter=order)] if len(order) else order
        ends = ends_from(rows.column("groups").combine_chunks().value_lengths().to_numpy())
        groups = rows.column("groups").combine_chunks().flatten().to_numpy()
        sums_of = []
        for name in ("best", "count"):
            values = right.column(name).cast(pa.int64()).to_numpy()[place]
            sums_of.append(pa.array(sums(sums(values[one["links"]], one["link_ends"])[groups], ends)))
        return pa.Table.from_arrays([*[rows.column(n) for n in out.names[:-2]], *sums_of], names=out.names)

    result = blocks.drop("counts").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(counted, out)
    return result.select(*[F.col("carried").getField(n).alias(n) for n in names], *out.names[1:])


def token_links(docs: DataFrame, path_a: str, path_b: str, *, shared: str = "bytes", column: str = "text", block_chars: int = 100_000) -> DataFrame:
    """One row for each link of each text, with the columns of ``docs``: place_a, id_a, place_b, id_b, n
    (bytes shared where ``shared`` is "bytes"; 1 for tokens that share a group where it is "groups")."""
    sc = docs.sparkSession.sparkContext
    shared_a, shared_b = sc.broadcast(model_bytes(path_a)), sc.broadcast(model_bytes(path_b))
    made = T.StructType.fromDDL("place_a long, id_a long, place_b long, id_b long, n long")
    kept = [f for f in docs.schema if f.name not in made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(shared_a.value, shared_b.value)
        for batch in batches:
            for start, texts in text_blocks(batch.column(column), block_chars):
                for at, (a, b) in enumerate(zip(*encoders.encode(texts), strict=True), start):
                    one = Block([a], [b], encoders.sizes_a, encoders.sizes_b)
                    if shared == "bytes":
                        found = overlap_links(encoders.sizes_a[one.a], encoders.sizes_b[one.b])
                    else:
                        found = group_links(*(np.repeat(np.arange(len(n)), n) for n in (one.n_a, one.n_b)))
                    for i, j, n in found:
                        row = pa.array(np.full(len(i), at))
                        numbers = [pa.array(x.astype(np.int64)) for x in (i, one.a[i], j, one.b[j], n)]
                        yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(row) for f in kept], *numbers], names=[*[f.name for f in kept], *made.names])

    return docs.select(*dict.fromkeys([*[f.name for f in kept], column])).mapInArrow(run, T.StructType([*kept, *made.fields]))
