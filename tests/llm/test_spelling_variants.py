"""Spelling variants against a plain search over deleted letters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.llm import queries, spelling_variants

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def counted(rows, least, occurrences):
    n, lower = Counter(), str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: k for w, k in n.items() if k >= occurrences and len(w) >= least}


def near_words(n):
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            holes[i, shorter].add(w)
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for some in holes.values():
        for w in some:
            near[w] |= some - {w}
    return near


def plain(rows, least=7, occurrences=2, times=10):
    n = counted(rows, least, occurrences)
    near, form = near_words(n), {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= times * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items())


def found(docs, **how):
    made = spelling_variants.variants(docs, **how)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, made.collect()), key=lambda r: r[0])


def test_query_over_its_whole_table(spark, monkeypatch):
    """With one shard for each length, and with shards cut deeper."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = sorted(map(tuple, queries.op11_spelling_variants(spark, SMALL).collect()), key=lambda r: r[0])
    assert got == want and sum(r[4] for r in got) > 1000
    monkeypatch.setattr(spelling_variants, "LEAST_LETTERS", 3000)
    assert found(docs) == want


@pytest.mark.parametrize("letters", [40, 400, 10**6])
def test_small_alphabets(spark, monkeypatch, letters):
    """Dense neighbourhoods, anagrams, chains of forms, letters of one group, and shards of one vector in parts."""
    monkeypatch.setattr(spelling_variants, "LEAST_LETTERS", letters)
    monkeypatch.setattr(spelling_variants, "TOGETHER", 500)
    draw = random.Random(letters)
    rows = []
    for i in range(300):
        words = ["".join(draw.choice("abzé") for _ in range(draw.randint(2, 5))) for _ in range(20)]
        rows.append((draw.choice([None, i]), draw.choice([" ", "-", "_"]).join(words)))
    rows += [(9, "Chain " * 1200), (10, "chainx " * 110), (11, "chainxy " * 9), (12, "chainxyz"), (13, None), (14, ""), (15, "×÷abé " * 3)]
    got = found(spark.createDataFrame(rows, DOCS), least=2, occurrences=1)
    assert got == plain(rows, 2, 1)
    chain = {r[0]: r for r in got}
    assert chain["chainxy"][2] in ("chain", "chainx") and any(r[1] != r[2] for r in got if r[1])


def test_long_words_and_no_words(spark, empty, odd):
    long = "ab" * 3000
    rows = [(i, f"{long} {long}c {long[:70]} {long[:71]}" + " x" * 5) for i in range(4)]
    assert found(spark.createDataFrame(rows, DOCS)) == plain(rows)
    assert found(empty) == [] and isinstance(found(odd), list)


def test_one_edit(spark):
    """The check of two words, at every place of an insertion and a replacement."""
    a = np.array([[1, 2, 3]] * 7)
    b = np.array([[9, 1, 2, 3], [1, 9, 2, 3], [1, 2, 3, 9], [1, 2, 2, 3], [1, 3, 2, 3], [1, 2, 4, 4], [3, 1, 2, 9]])
    assert spelling_variants.verified(a, b).tolist() == [True, True, True, True, True, False, False]
    c = np.array([[1, 2, 3], [1, 2, 9], [9, 9, 3], [2, 1, 3], [9, 2, 3], [1, 9, 3], [3, 2, 1]])
    assert spelling_variants.verified(a, c).tolist() == [False, True, False, False, True, True, False]
