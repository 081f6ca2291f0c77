"""Repeated rows and rows without an id through the dedup stages and the pipeline."""

from collections import Counter

import corpus_pipeline
from newsloom.llm import exact_dedup, probminhash

from .conftest import DOCUMENTS, prose


def changed(text: str, at: int) -> str:
    words = text.split()
    words[at] = "other"
    return " ".join(words)


BASE, ALONE, NAMELESS, LAST = prose(31, 150), prose(32, 60), prose(33, 150), prose(34, 150)
#: Rows of one text twice under its least id, under an id that a third document copies, near copies with a
#: repeated id, rows without an id, and one id with two texts.
ROWS = [
    *[(5, BASE, "en", "a", None)] * 2, *[(7, BASE.replace(" ", "  "), "en", "a", None)] * 2, (2, changed(BASE, 40), "en", "b", None),
    *[(2, changed(BASE, 40), "en", "b", None)] * 2, *[(None, ALONE, "en", "a", None)] * 30, *[(None, NAMELESS, "en", "a", None)] * 3,
    (
        None,
        changed(NAMELESS, 20),
        "en",
        "b",
        None,
    ), (9, LAST, "en", "a", None), (9, changed(LAST, 90), "en", "a", None), (3, prose(35, 90), "en", "c", None),
]


def texts(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_exact_dedup_keeps_one_row(spark):
    docs = spark.createDataFrame(ROWS, DOCUMENTS)
    expected = {
        (7, BASE.replace(" ", "  ")),
        (2, changed(BASE, 40)),
        (None, ALONE),
        (None, NAMELESS),
        (None, changed(NAMELESS, 20)),
        *[(i, t) for i, t, *_ in ROWS if i in (9, 3)],
    }
    got = exact_dedup.deduplicate(docs)
    assert texts(got.collect()) == Counter(expected) and got.columns == docs.columns


def test_near_dedup_keeps_one_row(spark):
    docs = spark.createDataFrame(ROWS, DOCUMENTS)
    got = probminhash.deduplicate(docs)
    kept = got.collect()
    assert Counter(r.doc_id for r in kept) == {2: 1, None: 2, 9: 1, 3: 1} and got.columns == docs.columns
    assert texts(kept)[(None, ALONE)] == 1
    assert sum(r.kept for r in probminhash.near_classes(docs).collect()) == 5


def test_repeated_rows_with_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, ALONE, "b", "x"), (1, ALONE, "a", "y"), (1, ALONE, None, "z")],
        "doc_id long, text string, source string, _digest string",
    )
    for stage in (exact_dedup, probminhash):
        assert [tuple(r) for r in stage.deduplicate(docs).collect()] == [(1, ALONE, None, "z")]


def test_pipeline_of_a_doubled_table(spark, tmp_path):
    once = spark.createDataFrame(ROWS, DOCUMENTS).coalesce(1)
    once.write.parquet(f"{tmp_path}/documents.parquet")
    once.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == {2: 1, None: 2, 9: 1, 3: 1}
