"""Substring dedup against a plain version that holds every window."""

import hashlib
import random
import re

import duckdb
import pytest

from newsloom.llm import queries, substring_dedup

SMALL = "/root/testdata/sf0.001"
NO_ID = (1 << 63) - 1


def plain(rows, span):
    least, words = {}, []
    for doc_id, text in rows:
        order = NO_ID if doc_id is None else doc_id
        words.append(re.findall(substring_dedup.WORD, text or ""))
        for p in range(len(words[-1]) - span + 1):
            key = tuple(words[-1][p : p + span])
            least[key] = min(least.get(key, order), order)
    out = []
    for (doc_id, _), found in zip(rows, words, strict=True):
        order = NO_ID if doc_id is None else doc_id
        gone = set()
        for p in range(len(found) - span + 1):
            if least[tuple(found[p : p + span])] < order:
                gone.update(range(p, p + span))
        out.append((doc_id, len(found), len(gone), " ".join(w for i, w in enumerate(found) if i not in gone)))
    return sorted(out, key=str)


def removed(docs, **sizes):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, **sizes).collect()), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_against_every_window(spark, letters):
    """Branching graphs, null and repeated ids, passages inside passages."""
    draw, rows = random.Random(len(letters)), []
    for _ in range(80):
        words = [draw.choice(letters) for _ in range(draw.randint(0, 80))]
        if rows and draw.random() < 0.5:
            other = (draw.choice(rows)[1] or "").split()
            at = draw.randint(0, len(other))
            words[len(words) // 2 : len(words) // 2] = other[at : at + 40]
        rows.append((None if draw.random() < 0.1 else draw.randint(0, 50), draw.choice([" ", "\n", "\t "]).join(words) if draw.random() > 0.05 else None))
    rows += rows[:5]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), span=6, k=3) == plain(rows, 6)


def test_query_over_its_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op13_substring_dedup(spark, SMALL).collect())
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows, 50))
    assert got == want and sum(r[2] for r in got) > 1000


def test_one_passage_in_every_text(spark):
    """A hot node: the passage stays in the least document only, and what is around it stays everywhere."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r for r in got if r[0] == 0] == [(0, 73, 0, rows[0][1])]
    assert all(r == (r[0], 73, 70, f"a{r[0]} b{r[0]} c{r[0]}") for r in got if r[0])
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(spans) == 299 and {(s.start, s.words, s.source.doc, s.source.start) for s in spans} == {(2, 70, 0, 2)}


def test_one_word_repeated(spark):
    rows = [(1, "x " * 5000), (2, "x " * 3000 + "y"), (3, "x " * 49)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, 5000, 0, " ".join(["x"] * 5000)), (2, 3001, 3000, "y"), (3, 49, 0, " ".join(["x"] * 49))]


def test_odd_rows_and_empty_table(spark, odd, odd_rows, empty):
    got = substring_dedup.remove_repeats(odd.withColumn("kept", odd.lang))
    assert got.columns == [*odd.columns, "n_words", "n_removed", "removed", "kept"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == plain([r[:2] for r in odd_rows], 50)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_colliding_hashes_start_again(spark, monkeypatch):
    """Where a hash cannot tell two texts apart, the spans fail their check and other hashes are taken."""
    from pyspark.sql import functions as F

    true = substring_dedup.word_hashes

    def poor(seed):
        words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(substring_dedup.WORD), F.lit(0))
        return true(seed) if seed else F.transform(words, lambda w: F.xxhash64(F.length(w))).alias("hashes")

    monkeypatch.setattr(substring_dedup, "word_hashes", poor)
    rows = [(1, "aa bb cc dd"), (2, "ee ff gg hh"), (3, "x aa bb cc dd")]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), span=4, k=2) == plain(rows, 4)


def test_its_sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows, 50))
    assert sorted(con.execute(queries.ORACLES["op13_substring_dedup"]).fetchall()) == want
