"""Every query of the training-data operators over its whole smallest table, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece

from newsloom.llm import queries, secrets

from .test_model_operators import plain_sets

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r for r in duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang, source FROM '{SMALL}/documents.parquet'").fetchall()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def rows(spark, name):
    got = queries.QUERIES[name](spark, SMALL).collect()
    return {r.doc_id: r for r in got}, len(got)


def test_quality_query(spark, documents):
    got, n = rows(spark, "op1_quality_crf")
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall())
    assert n == len(documents) and set(got) == set(documents)
    by_text = defaultdict(set)
    for i, r in got.items():
        assert r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        by_text[documents[i][1]].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    held = [(r.score, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_language_query(spark, documents):
    got, n = rows(spark, "op2_language_id")
    assert n == len(documents) and all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.lang_pred, documents[i][2]) for i, r in got.items() if r.held_out and documents[i][2]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 20
    assert {r.lang_pred for i, r in got.items() if not any(map(str.isalpha, documents[i][1]))} <= {"und"}


def test_secret_query(spark):
    """On the next larger table, as the smallest has no secrets."""
    folder = "/root/testdata/sf0.01"
    documents = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, folder).collect()}
    assert set(got) == set(documents)
    for i, text in documents.items():
        spans = []
        for order, (kind, (pattern, group, least)) in enumerate(secrets.BASE.items()):
            spans += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
        said = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
        count = Counter(k for *_, k in spans)
        assert (got[i].base_sha256, got[i].n_assign, got[i].n_access, got[i].n_hex) == (
            sha(",".join(said)),
            count["assign"],
            count["access"],
            count["hex"],
        )
        assert set(said) <= set(got[i].spans.split(","))
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 0


def test_piece_query(spark, documents):
    got, n = rows(spark, "op4_sentencepiece")
    original = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    assert n == len(documents)
    for i, (_, text, _, _) in documents.items():
        ids = original.encode(text)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].round_trip and got[i].decoded_sha256 == sha(original.decode(ids))


def test_near_query_finds_every_link(spark, documents):
    got, n = rows(spark, "op5_probminhash")
    items = sorted(documents.items())
    sets = {i: plain_sets(d[1]) for i, d in items}
    root = {i: i for i in documents}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, _ in items:
        for s in sets[i]:
            holders[s].append(i)
    seen = set()
    for group in holders.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                        root[max(find(i), find(j))] = min(find(i), find(j))
    texts = {}
    for i, d in items:
        first = texts.setdefault(d[1], i)
        root[max(find(i), find(first))] = min(find(i), find(first))
    assert n == len(documents) and {i: r.class_id for i, r in got.items()} == {i: find(i) for i in documents}
    assert all(r.kept == (i == r.class_id) for i, r in got.items()) and len({r.class_id for r in got.values()}) < n


def test_exact_query_equals_its_sql(spark):
    expected = duckdb.connect().execute(
        f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'"
    ).execute(queries.ORACLES["op6_exact_dedup"]).fetchall()
    got = queries.op6_exact_dedup(spark, SMALL).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == Counter(expected)


def test_fingerprint_query(spark, documents):
    got, n = rows(spark, "op7_fingerprint")
    order = sorted(documents)
    assert n == len(documents)
    by_text = defaultdict(set)
    for k, i in enumerate(order):
        text, following = documents[i][1], documents[order[(k + 1) % len(order)]][1]
        h = len(text) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), sha(text[: len(text) - h] + following[:h]))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        by_text[text].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len({f for fs in by_text.values() for f in fs}) > 0.9 * len(by_text)
    near = [r.near_edited - r.near_next for i, r in got.items() if r.n_chars > 2000]
    assert sum(near) / len(near) > 0.3


def test_sharding_query(spark, documents):
    got, n = rows(spark, "op8_sharding")
    assert n == len(documents) and {r.law for r in got.values()} == {"rows"} and {r.grown_shard for r in got.values()} == {None}
    slots = defaultdict(list)
    by_source = defaultdict(Counter)
    for i, r in got.items():
        raw = documents[i][1].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        by_source[documents[i][3]][r.shard] += 1
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for counts in by_source.values():  # the mixture of every shard: within one row and the ties of the order
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 2


def test_chat_query_equals_its_sql(spark):
    expected = duckdb.connect().execute(
        f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'"
    ).execute(queries.ORACLES["op9_chat_format"])
    names = [d[0] for d in expected.description]
    got = queries.op9_chat_format(spark, SMALL).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(expected.fetchall())


def test_mixing_query(spark, documents):
    got, n = rows(spark, "op10_mixing")
    assert n == len(documents) and sorted(r.position for r in got.values()) == list(range(n))
    assert all(not r.exact or r.release <= r.slot < r.deadline for r in got.values())
    weights = {r.source: r.weight for r in got.values()}
    parts = {s: 1 + zlib.crc32(s.encode()) % 4 for s in weights}  # the query's targets are unequal
    assert len(set(parts.values())) > 1 and all(r.exact for r in got.values())
    assert all(abs(w - parts[s] / sum(parts.values())) < 1e-9 for s, w in weights.items())
