"""Quality, language, SentencePiece, ProbMinHash and the pipeline against plain versions."""

import random
import struct
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import DOCUMENTS, WORDS, prose

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from newsloom.llm import language_id, probminhash, quality_crf, queries, sentencepiece_codec

MODEL = queries.PIECE_MODEL


def plain_marginals(unary, transition):
    """By listing every labelling of a short chain."""
    n, weights = len(unary), {}
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        weights[tuple(y)] = np.exp(sum(u for u, v in zip(unary, y, strict=True) if v) + sum(transition[a, b] for a, b in zip(y, y[1:])))  # noqa: B905
    total = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)]


def test_forward_backward_matches_enumeration():
    draw = np.random.default_rng(3)
    counts = np.array([1, 5, 3, 1, 6])
    unary, transition = draw.normal(size=counts.sum()) * 2, draw.normal(size=(2, 2))
    got, _ = quality_crf.forward_backward(unary, transition, counts)
    first = np.cumsum(counts) - counts
    plain = np.concatenate([plain_marginals(unary[a : a + c], transition) for a, c in zip(first, counts, strict=True)])
    assert np.allclose(got[:, 1], plain)


def test_segments_change_nothing():
    """A chain cut into segments has the marginals and pairs of the whole chain."""
    draw = np.random.default_rng(4)
    counts = np.array([1, 40, 7, 129, 8, 9])
    unary, transition = draw.normal(size=counts.sum()) * 3, draw.normal(size=(2, 2)) * 2
    whole, pairs = quality_crf.forward_backward(unary, transition, counts, segment=10_000)
    for segment in (2, 7, 8, 64):
        got, found = quality_crf.forward_backward(unary, transition, counts, segment=segment)
        assert np.allclose(got, whole) and np.allclose(found, pairs)


def test_scores_of_pieces_and_a_long_text():
    draw = np.random.default_rng(6)
    weights = draw.normal(size=3 * quality_crf.OWN + 1)
    texts = ["a b\n\nC d!\nC d!", "", "one", "x\n" * 50]
    x, _, counts = quality_crf.line_features(texts)
    got, _, same = quality_crf.unary_scores(texts, weights)
    assert np.allclose(got, quality_crf.with_neighbours(x, counts) @ weights) and (counts == same).all()
    small, _, _ = quality_crf.read_lines(texts, lambda own: own, quality_crf.OWN, most_lines=3, most_chars=5)
    assert np.allclose(small, x)
    model = quality_crf.Model(weights, draw.normal(size=(2, 2)), 1.0, 0.0)
    began = time.time()
    assert 0 <= quality_crf.score(["ab cd.\n" * 300_000], model)[0] <= 1
    assert time.time() - began < 60


def test_line_features_see_repetition_and_shouting():
    x, lengths, counts = quality_crf.line_features(["of of of of", "HE!! SHE!!\n\nHE!! SHE!!", ""])
    assert counts.tolist() == [1, 3, 1] and lengths.tolist() == [11, 10, 0, 10, 0]
    repeats, seen = x[:, quality_crf.CLASSES + 3], x[:, quality_crf.CLASSES + 6]
    assert repeats[0] == 0.75 and repeats[1] == 0 and seen.tolist() == [0, 0, 0, 1, 0]


def test_quality_learns_held_out_lines(spark, odd, empty):
    good = [(i, prose(i, 60).capitalize() + ".\n" + prose(1000 + i, 40)) for i in range(80)]
    bad = [(100 + i, prose(i, 30) + "\n" + prose(2000 + i, 60).upper().replace(" ", "!! ")) for i in range(80)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    held = F.col("doc_id") % 4 == 0
    model = quality_crf.train(docs.filter(~held), labels.filter(~held))
    got = quality_crf.predict(docs.filter(held), model, carry=["doc_id"]).collect()
    assert all((r.score >= 0.3) == (r.doc_id < 100) for r in got) and len(got) == 40
    assert quality_crf.predict(odd, model, carry=odd.columns).count() == odd.count()
    assert quality_crf.predict(empty, model, carry=["doc_id"]).count() == 0
    assert quality_crf.train(docs, labels.limit(0)).constant == 0.5


def plain_phrases(sequence, training, segment):
    """Greedy longest matches by searching the training text."""
    count = 0
    for start in range(0, len(sequence), segment):
        part, at = sequence[start : start + segment], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in training:
                size += 1
            at += size
            count += 1
    return count


def as_string(sequence):
    return "".join(map(chr, sequence))


def test_cross_parsing_matches_plain_search():
    draw = random.Random(5)
    chinese = [chr(0x4E00 + i) for i in range(150)]
    samples = {
        k: ["".join(draw.choice(letters) for _ in range(300))] for k, letters in {"x": "abcde ", "y": "cdefg ", "z": "aéîo ", "zh": chinese}.items()
    }
    model = language_id.build(samples)
    texts = [
        "".join(draw.choice(["a", "b", "é", "o", " ", "1", "!", *chinese[:9]]) for _ in range(n)) for n in (0, 1, 7, 50, 333)
    ] + ["ABC cde", "жжж", "жaж"]
    sequences = [language_id.encode(t, model.symbols) for t in texts]
    got = language_id.Parser(model, 64).phrases(sequences)
    for j, language in enumerate(model.languages):
        training = as_string(np.append(language_id.encode(samples[language][0], model.symbols), np.uint16(1)))
        assert [plain_phrases(as_string(s), training, 64) for s in sequences] == got[:, j].tolist()


def test_language_prediction(spark, odd, empty):
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "opqrstuv"}
    draw = random.Random(9)
    word = lambda k: "".join(draw.choice(letters[k]) for _ in range(5))
    rows = [(i, " ".join(word(k) for _ in range(30)), k, "s", None) for i, k in enumerate(list(letters) * 40)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    model = language_id.train(docs.filter("doc_id % 3 <> 1 OR doc_id < 9"))
    assert language_id.predict(docs, model, carry=["doc_id", "lang"]).filter("lang <> lang_pred OR score NOT BETWEEN 0 AND 1").count() == 0
    other = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "жук")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.predict(other, model).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert language_id.predict(odd, model).count() == odd.count() and language_id.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(empty), carry=["doc_id"]).collect()} == {"und"}


def test_language_of_large_scripts(spark):
    """Chinese and Japanese text of some thousand letters, Cyrillic and Latin: no letter is lost to a cap."""
    draw = random.Random(12)
    letters = {
        "zh": [chr(0x4E00 + 3 * i) for i in range(3000)],
        "ja": [chr(0x4E00 + 5 * i) for i in range(1500)] + [chr(0x3042 + i) for i in range(80)] * 30,
        "ru": "абвгдежзиклмно",
        "uk": "абвгдеєжзиїклмн",
        "en": "abcdefgh",
    }
    # Words recur, as in prose; a language is told by them.
    words = {k: ["".join(draw.choice(v) for _ in range(3)) for _ in range(150)] for k, v in letters.items()}
    rows = [(i, "".join(draw.choice(words[k]) + draw.choice([" ", ""]) for _ in range(120)), k, "s", None) for i, k in enumerate(list(letters) * 30)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    model = language_id.train(docs.filter("doc_id < 75"))
    assert len(set(model.symbols.tolist())) > 600
    assert language_id.predict(docs.filter("doc_id >= 75"), model).filter("lang <> lang_pred").count() == 0
    # The learned passage is drawn from anywhere in a text.
    late = spark.createDataFrame([(i, "x " * 500 + "late " * 100, "xx", "s", None) for i in range(40)], DOCUMENTS)
    assert any("late" in t for t in language_id.training_sample(late, docs_per_language=100, chars_per_doc=100, seed=1)["xx"])


@pytest.mark.parametrize("text", ["", "  a", "a  ", "▁▁ x▁", "日本 \U0001f600", "</s>\n\n\t x", "the " * 300])
def test_parity_of_single_texts(text):
    sentencepiece_codec.verify_parity(MODEL, [text])


def test_parity_and_round_trip(spark, odd, odd_rows, empty):
    draw = random.Random(1)
    pieces = ["the", "Étion", " ", "  ", "\n", "x1", "</s>", "▁", "строка", "中", "\U0001f600", "\x07", "don't", "aaaa"]
    texts = ["".join(draw.choice(pieces) for _ in range(n)) for n in (1, 5, 20, 80, 200, 800) for _ in range(20)]
    sentencepiece_codec.verify_parity(MODEL, texts)
    got = sentencepiece_codec.encode(odd, MODEL, carry=["doc_id"])
    assert got.filter("NOT round_trip").count() == 0 and got.count() == len(odd_rows)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, MODEL), MODEL).collect()
    assert Counter(r.decoded for r in back) == Counter(r[1] or "" for r in odd_rows)
    assert sentencepiece_codec.encode(empty, MODEL).count() == 0


def test_unigram_model_is_rebuilt():
    """A model of the other kind, made here by hand: the best-scored path wins, unknown characters are fused."""
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -3.0, 1), ("c", -4.0, 1)]
    tokenizer = sentencepiece_codec.build_tokenizer(sentencepiece_codec.ModelFile(pieces, sentencepiece_codec.UNIGRAM))
    assert tokenizer.encode("ab  c").ids == [3, 4, 5] and tokenizer.decode([3, 4, 5]) == "ab c"


def field(number, value):
    """A protobuf field: int, float, bytes or str."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number * 8 + 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number * 8) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number * 8 + 2) + varint(len(raw)) + raw


def unigram_file(path, *, fallback, dummy, extra):
    """A unigram model made by hand: pieces of random letters with random scores, all bytes if asked."""
    draw = random.Random(21)
    normal = {"".join(draw.choice("▁abcdeé中") for _ in range(draw.randrange(1, 5))): -draw.uniform(1, 12) for _ in range(400)} | {
        c: -draw.uniform(8, 14) for c in "▁abcde"
    }
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [
        (f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback
    ] + [(p, s, 1) for p, s in normal.items()]
    data = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, int(fallback))) + field(
        3,
        field(1, "identity") + field(3, int(dummy)) + field(4, int(extra)) + field(5, 1),
    )
    Path(path).write_bytes(data)
    return str(path)


@pytest.mark.parametrize(
    ("fallback", "dummy", "extra"),
    [(True, True, False), (True, True, True), (False, True, True), (True, False, False), (False, False, True)],
)
def test_unigram_parity_with_the_original_library(tmp_path, fallback, dummy, extra):
    """Ids and decoded texts of a unigram model equal the original library's: scores, unknown characters, bytes, spaces."""
    path = unigram_file(tmp_path / "u.model", fallback=fallback, dummy=dummy, extra=extra)
    draw = random.Random(22)
    texts = [
        "".join(
            draw.choice(["a", "b", "c", "de", "é", "中", " ", "  ", "\t", "\n", "zz", "ж"]) for _ in range(n)
        ) for n in (1, 2, 5, 20, 80) for _ in range(40)
    ]
    sentencepiece_codec.verify_parity(path, texts)


def test_threads_give_the_same_ids(spark, odd):
    rows = [sorted((r.doc_id or 0, r.ids) for r in sentencepiece_codec.encode(odd, MODEL, carry=["doc_id"], threads=n).collect()) for n in (1, 4)]
    assert rows[0] == rows[1]


def plain_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows, threshold=0.8):
    sets = [plain_sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, r in enumerate(rows):
        for j in range(i):
            same = (r[1] or "") == (rows[j][1] or "") or (sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]))
            if same:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_rows():
    draw = random.Random(4)
    rows = []
    for g in range(30):
        words = prose(500 + g, draw.choice([6, 40, 150, 300])).split()
        for _ in range(draw.choice([1, 1, 2, 8])):
            changed = list(words)
            for _ in range(draw.choice([0, 0, 1, 2])):
                changed[draw.randrange(len(changed))] = draw.choice(WORDS)
            rows.append((len(rows), " ".join(changed), "en", "a", None))
    return rows


def test_near_classes_match_brute_force(spark, odd, odd_rows, empty):
    rows = near_rows()
    got = {r.doc_id: r for r in probminhash.near_classes(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    plain = plain_classes(rows)
    least = {}
    for r, c in zip(rows, plain, strict=True):
        least.setdefault(c, r[0])
    assert [got[r[0]].class_id for r in rows] == [least[c] for c in plain]
    assert sum(r.kept for r in got.values()) == len(least) and len(got) == len(rows)
    strange = probminhash.near_classes(odd).collect()
    assert len(strange) == len(odd_rows)
    assert {r.doc_id: r.class_id for r in strange if r.doc_id in (1, 2, 3, 4, 5, 6)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert probminhash.near_classes(empty).count() == 0


def test_links_that_no_least_node_shows(spark):
    """A chain: each text is near to the next one only; the class is the whole chain."""
    words = prose(77, 200).split()
    rows = []
    for i in range(12):
        words[i * 12] = f"new{i}"
        words[i * 12 + 6] = f"other{i}"
        rows.append((i, " ".join(words), "en", "a", None))
    random.Random(2).shuffle(rows)
    assert {r.class_id for r in probminhash.near_classes(spark.createDataFrame(rows, DOCUMENTS)).collect()} == {0}


def test_signature_agreement_estimates_similarity():
    words = probminhash.Words()
    a = [f"a{i}" for i in range(300)]
    b = a[:250] + [f"b{i}" for i in range(50)]
    _, sizes, s = probminhash.sketch([" ".join(a), " ".join(b), ""], words, 5, 512)
    true = len(plain_sets(" ".join(a)) & plain_sets(" ".join(b))) / len(plain_sets(" ".join(a)) | plain_sets(" ".join(b)))
    assert abs((s[0] == s[1]).mean() - true) < 0.08 and sizes.tolist() == [296, 296, 0]


def test_pipeline(spark, tmp_path):
    rows = near_rows() + [
        (900, "12345 !!", "en", "b", None),
        (901, None, "en", "b", None),
        (902, prose(900, 80), "en", "b", None),
        (903, prose(900, 80).replace(" ", "  "), "en", "b", None),
    ]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    alive = [r for r in rows if r[0] not in (900, 901)]
    best = {}
    for r in alive:
        k = "".join(r[1].split())
        if k not in best or (-len(r[1]), r[0]) < (-len(best[k][1]), best[k][0]):
            best[k] = r
    alive = sorted(best.values())
    classes = plain_classes(alive)
    expected = {alive[classes.index(c)][0] for c in set(classes)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == expected and len(got) == len(expected)
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_labelled_rows_are_drawn_once(spark):
    """A third of all rows equal, one id for many texts: no more texts than asked for, and all of them different."""
    rows = [(1, "the same words again and again", "en")] * 5000 + [(i, f"some words of text {i}", "en") for i in range(2000)] + [(7, f"autre texte {i}", "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = language_id.training_sample(docs, docs_per_language=50, chars_per_doc=100, seed=7)
    assert {k: len(v) for k, v in drawn.items()} == {"en": 50, "fr": 50} and all(len(set(v)) == 50 for v in drawn.values())


def test_any_number_of_languages(spark):
    """500 languages of labelled text: the whole training text keeps its bound, and they are told apart."""
    def said(language, seed):
        letters = random.Random(language)
        words = ["".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        draw = random.Random(f"{language}-{seed}")
        return " ".join(draw.choice(words) for _ in range(60))

    rows = [(10 * k + i, said(k, i), f"l{k:03d}") for k in range(500) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs.filter("doc_id % 10 < 2"), docs_per_language=100, chars_per_doc=800, seed=7, most_chars=100_000)
    assert sum(len(t) for v in sample.values() for t in v) <= 100_000 and len(sample) == 50
    model = language_id.train(docs.filter("doc_id % 10 < 2"), most_chars=1_000_000)
    assert len(model.languages) == 500
    assert language_id.predict(docs.filter("doc_id % 10 = 2"), model).filter("lang <> lang_pred").count() <= 5
