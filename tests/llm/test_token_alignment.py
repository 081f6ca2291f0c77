"""Cross-tokenizer alignment against a plain walk over both tokenizers' spans."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsloom.llm import queries, token_alignment

SMALL = "/root/testdata/sf0.001"
A, B = queries.BYTE_MODEL, queries.PIECE_MODEL


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {v: k for k, v in a.get_vocab().items()}


def places(parts):
    out, at = [], 0
    for part in parts:
        out.append((at, at + len(part)))
        at += len(part)
    return out


def walk(text, libraries):
    """Ids of A and of B, links as places, groups as ids; None without tokens."""
    if not text:
        return None
    a_lib, b_lib, names = libraries
    letters = token_alignment.byte_letters()
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    bytes_a = [bytes(letters[c] for c in names[i]) for i in a]
    bytes_b = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    at, bt = places(bytes_a), places(bytes_b)
    links = [(i, j) for i, (s, e) in enumerate(at) for j, (u, v) in enumerate(bt) if s < v and u < e]
    ends = sorted({e for _, e in at} & {e for _, e in bt})
    groups = [([x for x, (s, e) in zip(a, at) if low <= s < high], [x for x, (s, e) in zip(b, bt) if low <= s < high]) for low, high in zip([0, *ends], ends)]
    return a, b, links, groups


def plain(texts, libraries):
    walked = [walk(t, libraries) for t in texts]
    count = Counter((w[0][i], w[1][j]) for w in walked if w for i, j in w[2])
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for w in walked:
        if not w:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        pairs = [(w[0][i], w[1][j]) for i, j in w[2]]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in w[3])
        best = sum(count[p] == highest[p[1]] for p in pairs)
        out.append((len(w[0]), len(w[1]), len(w[3]), len(pairs), best, sum(count[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest(), sum(len(x) * len(y) for x, y in w[3])))
    return out


def values(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_group_links


ODD = [
    None, "", " ", "\n\n", "a ▁ b", "</s> <|endoftext|> <unk><0x0A> ok", "\U0001f600 中文字符 русский ñandú", "a" * 3000, "  lead  two ", "don't  can't\t1234567",
    "same words here", "same words here", "\x00\x01", "İﬁ ½", "é",
]


def test_odd_texts(spark, libraries):
    docs = spark.createDataFrame([(i if i % 4 else None, str(i), t) for i, t in enumerate(ODD)], "doc_id long, n_a string, text string")
    got = token_alignment.align(docs.withColumn("place", docs.n_a.cast("int")), A, B, block_chars=2000)
    assert got.columns[:3] == ["doc_id", "text", "place"] and len(got.columns) == 11
    assert [values(r) for r in sorted(got.collect(), key=lambda r: r.place)] == plain(ODD, libraries)
    assert token_alignment.align(docs.limit(0), A, B).count() == 0


def test_query_over_its_whole_table(spark, libraries):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(rows, plain([t[:1500] for t in rows.values()], libraries), strict=True))
    short = spark.createDataFrame([(i, t[:1500]) for i, t in rows.items()], "doc_id long, text string")  # the plain walk is slow
    got = {r.doc_id: values(r) for r in token_alignment.align(short, A, B, block_chars=20_000).collect()}
    assert got == want
    whole = {r.doc_id: r for r in queries.op12_token_alignment(spark, SMALL).collect()}
    assert set(whole) == set(rows)
    sample = sorted(rows, key=lambda i: len(rows[i]))[:150]
    for i, w in ((i, walk(rows[i], libraries)) for i in sample):
        assert (whole[i].n_a, whole[i].n_b, whole[i].n_groups, whole[i].n_links) == (tuple(len(x) for x in (w[0], w[1], w[3], w[2])) if w else (0,) * 4)


def test_links_of_both_kinds(spark, libraries):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for shared in ("bytes", "groups"):
        got = sorted((r.doc_id, r.place_a, r.id_a, r.place_b, r.id_b) for r in token_alignment.token_links(docs, A, B, shared=shared).collect())
        want = []
        for i, w in enumerate(walk(t, libraries) for t in ODD):
            if w and shared == "bytes":
                want += [(i, j, w[0][j], k, w[1][k]) for j, k in w[2]]
            elif w:
                at = bt = 0
                for x, y in w[3]:
                    want += [(i, j, w[0][j], k, w[1][k]) for j in range(at, at + len(x)) for k in range(bt, bt + len(y))]
                    at, bt = at + len(x), bt + len(y)
        assert got == sorted(want)


def test_row_products(monkeypatch):
    """Any 0/1 matrices, in parts of any size, against the dense product."""
    draw = np.random.default_rng(5)
    for most in (1, 7, 1000):
        monkeypatch.setattr(token_alignment, "TOGETHER", most)
        left, right = draw.integers(0, 2, (9, 6)), draw.integers(0, 2, (6, 8))
        csr = [(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1]) for m in (left, right)]
        out = np.zeros((9, 8), int)
        for i, j, n in token_alignment.row_products(*csr[0], *csr[1]):
            out[i, j] += n
        assert (out == left @ right).all()


def test_groups_of_one_hash(monkeypatch, libraries):
    """Where hashes cannot tell groups apart, their ids do."""
    encoders = token_alignment.Encoders(token_alignment.model_bytes(A), token_alignment.model_bytes(B))
    ids = encoders.encode(["two words and two words", "other things"])
    good = token_alignment.Block(*ids, encoders.sizes_a, encoders.sizes_b)
    monkeypatch.setattr(token_alignment, "spread", lambda ids, place, seed: np.ones(len(ids), np.uint64))
    poor = token_alignment.Block(*ids, encoders.sizes_a, encoders.sizes_b)
    assert [good.names()[g] for g in good.group] == [poor.names()[g] for g in poor.group]
