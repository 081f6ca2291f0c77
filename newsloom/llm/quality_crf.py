"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad. Its features are its own (shares of character classes, word
lengths, repetition), those of the lines before and after it, and a bias; a transition matrix ties
neighbours together. Forward-backward gives each line's probability of being good, and their mean,
weighted by line length, is put through a fitted logistic curve: the document's score.

Labels are known for documents only. Training takes a bounded sample of labelled documents, gives
each line its document's label, and after a first fit takes back the label of bad documents' lines
that look good (a bad document needs bad lines, not only bad lines), then fits again.

Lines are read in pieces of bounded size and chains are advanced in segments side by side, so that memory
and steps stay bounded for a text of a million lines; whole texts are scored.

Defined results: a null or empty text is one empty line; without labelled rows, or with labels of
one kind only, scores are the share of good labels (0.5 without any); equal texts have equal scores; a
document with labels of both kinds is taken as good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_blocks

#: Character classes, by place: lower, upper, digit, space, full stop and comma, exclamation and question,
#: bars and brackets, other ASCII signs, letters beyond ASCII, anything else.
LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, BAR, SIGN, LETTER, OTHER = range(10)
CLASSES = 10
OWN = CLASSES + 7


#: Signs of the classes full stop and comma, exclamation and question, bars and brackets: fixed values.
SIGNS = {STOP: ".,;:'\"-", SHOUT: "!?", BAR: "|[]{}()<>/\\_=~`"}


def class_of(ch: str) -> int:
    """The class of a character below U+3000."""
    if ord(ch) >= 128:
        return UPPER if ch.isupper() else LETTER if ch.isalpha() else SPACE if ch.isspace() else OTHER
    for test, kind in ((str.islower, LOWER), (str.isupper, UPPER), (str.isdigit, DIGIT), (str.isspace, SPACE)):
        if test(ch):
            return kind
    for kind, signs in SIGNS.items():
        if ch in signs:
            return kind
    return SIGN if ord(ch) > 32 else OTHER


def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    table[:0x3000] = [class_of(chr(c)) for c in range(0x3000)]
    table[0x3000:0xE000] = LETTER
    return table


TABLE = class_table()


def repeated_lines(lines: list[list[str]]) -> np.ndarray:
    """1 for each line that an earlier line of its text equals."""
    seen_before = np.zeros(sum(map(len, lines)))
    at = 0
    for text in lines:
        seen: set[str] = set()
        for line in text if len(text) > 1 else ():
            if line in seen:
                seen_before[at] = 1.0
            seen.add(line)
            at += 1
        at += len(text) == 1
    return seen_before


def own_features(flat: list[str], seen_before: np.ndarray) -> np.ndarray:
    """[lines, OWN] from lines, whatever texts they belong to."""
    n = len(flat)
    codes = np.frombuffer("\n".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, flat), np.int64, n)
    line = np.repeat(np.arange(n), lengths + 1)[: len(codes)]
    kind = TABLE[codes]
    classes = np.bincount(line * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    ends = np.cumsum(lengths + 1) - 1
    classes[line[ends[:-1]], SPACE] -= 1  # the line ends between lines
    space = kind == SPACE
    starts = ~space
    starts[1:] &= space[:-1]  # the first character of a word; line ends are spaces
    words = np.bincount(line[starts], minlength=n).astype(np.float64)
    # A word is repeated when it equals the word before it in the line: compared by a digest of its characters.
    place = np.flatnonzero(starts)
    repeats = np.zeros(n)
    if len(place) > 1:
        total = np.concatenate(
            [
                [np.uint64(0)],
                np.cumsum((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xBF58476D1CE4E5B9)) * ~space, dtype=np.uint64),
            ]
        )
        digest = total[np.append(place[1:], len(codes))] - total[place]
        same = (digest[1:] == digest[:-1]) & (line[place[1:]] == line[place[:-1]])
        repeats = np.bincount(line[place[1:]][same], minlength=n).astype(np.float64)
    size, some = np.maximum(lengths, 1), np.maximum(words, 1)
    letters = classes[:, UPPER] + classes[:, LOWER] + classes[:, LETTER]
    return np.column_stack(
        [
            classes / size[:, None],
            (lengths == 0).astype(float),
            np.log1p(lengths) / 8,
            np.minimum((lengths - classes[:, SPACE]) / some, 20) / 10,
            repeats / some,
            (classes[:, UPPER] > 0.5 * letters).astype(float),
            np.minimum((classes[:, SHOUT] + classes[:, BAR] + classes[:, SIGN]) / some, 3),
            seen_before,
        ]
    )


def pieces(flat: list[str], most_chars: int, most_lines: int) -> Iterator[tuple[int, int]]:
    """Runs of lines of bounded size (a longer line is alone)."""
    start = 0
    while start < len(flat):
        stop, chars = start, 0
        while stop < len(flat) and stop - start < most_lines and (stop == start or chars + len(flat[stop]) <= most_chars):
            chars += len(flat[stop])
            stop += 1
        yield start, stop
        start = stop


def read_lines(
    texts: list[str],
    made,
    width: int,
    *,
    most_chars: int = 1_000_000,
    most_lines: int = 20_000,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what ``made`` makes of the own features [lines, width], lengths, lines of each text); no more than
    one piece's features stand in memory at once."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    seen_before = repeated_lines(lines)
    flat = [x for ls in lines for x in ls]
    out = np.zeros((len(flat), width))
    for start, stop in pieces(flat, most_chars, most_lines):
        out[start:stop] = made(own_features(flat[start:stop], seen_before[start:stop]))
    return out, np.fromiter(map(len, flat), np.int64, len(flat)), counts


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features [lines, OWN], lengths, lines of each text)."""
    return read_lines(texts, lambda own: own, OWN)


def ends_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(counts) - counts, np.cumsum(counts) - 1


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends), and a bias."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    first, last = ends_of(counts)
    before[first] = 0
    after[last] = 0
    return np.hstack([features, before, after, np.ones((len(features), 1))])


def unary_scores(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``with_neighbours`` @ weights, lengths, counts): each line is projected three times, as itself and as
    the neighbour of two, so that neighbours' features need not be copied."""
    parts, lengths, counts = read_lines(texts, lambda own: own @ weights[:-1].reshape(3, OWN).T, 3)
    first, last = ends_of(counts)
    scores = parts[:, 0] + weights[-1]
    inner = np.ones(len(scores), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    scores[at] += parts[at - 1, 1]
    scores[at - 1] += parts[at, 2]
    return scores, lengths, counts


def falling(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length, the first line of each, and how many still run at each step."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    running = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
    return order, first, running


def carry(before: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """log sum over the labels before of before + transition, for each label after."""
    return np.logaddexp(before[..., :1] + transition[0], before[..., 1:] + transition[1])


def forward_backward(unary: np.ndarray, transition: np.ndarray, counts: np.ndarray, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [lines, 2] and the sum over neighbouring pairs of their joint probabilities [2, 2].

    ``unary`` is the score of the label good; bad scores 0. Chains are cut into segments of ``segment``
    lines that advance together. For each segment the scores of its paths by (label before, last label)
    are found first; these are joined from segment to segment along a text, and give every segment its start.
    """
    n = len(unary)
    both = np.stack([np.zeros(n), unary], axis=1)
    parts = -(-counts // segment)
    text = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    sizes = np.minimum(segment, counts[text] - number * segment)
    begins = np.cumsum(sizes) - sizes
    order, first, running = falling(sizes)
    before, after = np.zeros((len(text), 2)), np.zeros((len(text), 2))  # of the line before, and beta of the last line
    if len(text) > len(counts):
        paths = np.zeros((len(text), 2, 2))
        walk = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)[None].repeat(len(text), axis=0)  # from each label before
        for t, k in enumerate(running):
            walk[:k] = np.logaddexp(walk[:k, :, :1] + transition[0], walk[:k, :, 1:] + transition[1]) + both[first[:k] + t][:, None, :]
        paths[order] = walk
        start = np.cumsum(parts) - parts
        longest = np.argsort(-parts, kind="stable")
        for s in range(1, parts.max()):
            at = start[longest[: np.searchsorted(-parts[longest], -s, side="left")]] + s - 1
            if s == 1:  # the first line has no line before: its segment is walked once more below
                head = both[begins[at]].copy()
                for t in range(1, segment):
                    head = carry(head, transition) + both[begins[at] + t]
                ahead = head
            else:
                ahead = np.logaddexp(before[at][:, :1] + paths[at][:, 0], before[at][:, 1:] + paths[at][:, 1])
            before[at + 1] = ahead - ahead.max(axis=1, keepdims=True)
        for s in range(parts.max() - 1, 0, -1):
            at = start[longest[: np.searchsorted(-parts[longest], -s, side="left")]] + s
            back = np.logaddexp(paths[at][:, :, 0] + after[at][:, :1], paths[at][:, :, 1] + after[at][:, 1:])
            after[at - 1] = back - back.max(axis=1, keepdims=True)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    inside = (number > 0)[order]
    for t, k in enumerate(running):
        at = first[:k] + t
        if t:
            alpha[at] = carry(alpha[at - 1], transition)
        else:
            alpha[at] = np.where(inside[:, None], carry(before[order], transition), 0.0)
        alpha[at] += both[at]
        alpha[at] -= alpha[at].max(axis=1, keepdims=True)
    beta[(begins + sizes - 1)] = after
    for t in range(len(running) - 1, 0, -1):
        at = first[: running[t]] + t
        ahead = beta[at] + both[at]
        beta[at - 1] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
        beta[at - 1] -= beta[at - 1].max(axis=1, keepdims=True)
    joint = alpha + beta
    joint = np.exp(joint - joint.max(axis=1, keepdims=True))
    marginals = joint / joint.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + transition + (beta[at] + both[at])[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    return marginals, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float
    constant: float | None = None


def fit_chain(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient ascent (Adam) on the mean log-likelihood of the line labels."""
    weights, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1.0)
    parameters = np.zeros(len(weights) + 4)
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, rounds + 1):
        marginals, pairs = forward_backward(x @ weights, transition, counts)
        slope = np.concatenate([x.T @ (labels - marginals[:, 1]) / len(x), ((seen - pairs) / len(x)).ravel()]) - l2 * parameters
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        parameters += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, transition = parameters[:-4], parameters[-4:].reshape(2, 2)
    return weights, transition


def aggregate(marginals: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean probability of good, by text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    weight = lengths + 1.0
    return np.bincount(owner, marginals[:, 1] * weight, len(counts)) / np.bincount(owner, weight, len(counts))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: list[str], labels: list[int], rounds: int = 150) -> Model:
    good = np.array(labels, np.int64)
    if not len(good) or good.min() == good.max():
        return Model(np.zeros(0), np.zeros((2, 2)), 1.0, 0.0, float(good.mean()) if len(good) else 0.5)
    features, lengths, counts = line_features(texts)
    x = with_neighbours(features, counts)
    of_document = np.repeat(good, counts)
    weights, transition = fit_chain(x, counts, of_document, rounds)
    marginals, _ = forward_backward(x @ weights, transition, counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    worst = np.full(len(counts), np.inf)
    np.minimum.at(worst, owner, marginals[:, 1])
    revised = np.where((of_document == 0) & (marginals[:, 1] > 0.5) & (marginals[:, 1] > worst[owner]), 1, of_document)
    weights, transition = fit_chain(x, counts, revised, rounds)
    marginals, _ = forward_backward(x @ weights, transition, counts)
    z = logit(aggregate(marginals, lengths, counts))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method for the two parameters of the logistic curve
        p = 1 / (1 + np.exp(-(slope * z + offset)))
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve(
            np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-3 * np.eye(2),
            [((good - p) * z).sum(), (good - p).sum()],
        )
        slope, offset = slope + np.clip(step[0], -1, 1), offset + np.clip(step[1], -1, 1)
    return Model(weights, transition, float(slope), float(offset))


def score(texts: list[str], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    if not texts:
        return np.zeros(0)
    unary, lengths, counts = unary_scores(texts, model.weights)
    marginals, _ = forward_backward(unary, model.transition, counts)
    return 1 / (1 + np.exp(-(model.slope * logit(aggregate(marginals, lengths, counts)) + model.offset)))


def train(docs: DataFrame, labels: DataFrame, *, most_docs: int = 3000, most_chars: int = 20_000_000, seed: int = 11) -> Model:
    """Fit on at most about ``most_docs`` labelled documents (doc_id, text; doc_id, quality), drawn by digest.

    Of a text longer than ``most_chars / most_docs`` characters a passage of that length is drawn: the
    sample that the driver holds is bounded by both. Rows with a null label or text are not used.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, most = known.count(), most_chars // most_docs
    digest = F.xxhash64(F.lit(seed), "doc_id")
    draw = F.pmod(digest, F.lit(1 << 30)).cast("double") / (1 << 30)
    chosen = draw < min(1.0, most_docs / max(n, 1))
    start = F.pmod(F.shiftright(digest, 32), F.greatest(F.char_length("text") - most, F.lit(0)) + 1).cast("int") + 1
    passage = F.when(F.char_length("text") > most, F.substring("text", start, F.lit(most))).otherwise(F.col("text"))
    sample = docs.filter(chosen).filter("text IS NOT NULL").select("doc_id", passage.alias("text"))
    rows = sample.join(known.filter(chosen), "doc_id").orderBy("doc_id", "text").limit(2 * most_docs).collect()
    return fit([r["text"] for r in rows], [int(r["quality"] > 0) for r in rows])


def predict(docs: DataFrame, model: Model, *, carry: list[str], batch_chars: int = 2_000_000) -> DataFrame:
    """The columns ``carry`` of every row of ``docs`` and its score (a column ``score`` of ``docs`` gives way)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name in carry and f.name != "score"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start, texts in text_blocks(batch.column("text"), batch_chars):
                rows = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(score(texts, model))], names=[*names, "score"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
