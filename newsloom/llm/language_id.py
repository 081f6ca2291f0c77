"""Language identification by cross-parsing entropy over suffix automata.

For every language a suffix automaton of labelled text is built. A text is parsed greedily against
each automaton: the longest match from the current place is one phrase, and the next phrase starts
after it. The language whose automaton needs the fewest phrases, each weighed by the logarithm of its
training length and divided by the length of the text, wins.

Texts are lower-cased; every letter of the training text is a symbol of its own, whatever its script,
digits are one symbol, and runs of anything that is no letter are one break. A letter that no training
text has is a phrase of its own in every language. Parsing restarts every ``segment`` symbols, at the same
places for all languages, which bounds the number of dependent steps however long a text is; whole texts
are parsed. The transitions of all automata stand in one table in which the rows of states overlap: a
state's transition for a symbol is at the state's base plus the symbol, if the entry there names the state.
It has hardly more entries than there are transitions (at most three for each training symbol), so that
a model grows with the training text, and not with the alphabet too. Languages are built one after the other, each
into arrays of its own, and the characters drawn for each shrink where there are so many languages that together
they would pass ``most_chars``: the model's size and the driver's memory have a bound at any number of languages.

Defined results: repeated labelled rows (equal id and text) are drawn once; of more languages than ``most_chars``
has room for (2,000 characters each), those with the most rows are learned; a text that is null or has no letter is
``und`` with score 0; ties go to the
language first in alphabetical order; without training text every text is ``und``; extra columns
pass through ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import giving_back, text_blocks

UND = "und"
#: Symbols: a letter without training text, a break, a digit; learned letters follow.
UNSEEN, BREAK, DIGIT, LETTERS = 0, 1, 2, 3
STATE_BITS = 24
STATES = (1 << STATE_BITS) - 1
#: Characters of the whole training text, and of the passage of a language that is still worth having.
MOST_CHARS, LEAST_PASSAGE = 4_000_000, 2_000


@dataclass(frozen=True)
class Model:
    """languages, symbol of each code point, the table of all transitions, where phrases begin, and log lengths."""

    languages: list[str]
    symbols: np.ndarray  # int32 by code point
    base: np.ndarray  # int32 by state
    entries: np.ndarray  # int64 by base + symbol: the state and the next state, or -1
    starts: np.ndarray  # first state of each language
    first: np.ndarray  # [languages, symbols]: the state of a phrase that starts with a symbol
    weights: np.ndarray  # log2 of each training length


def symbol_table(texts: list[str]) -> tuple[np.ndarray, int]:
    """The symbol of every code point, and the number of symbols."""
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    symbols = np.full(0x110000, BREAK, np.int32)
    symbols[[c for c in range(0x110000) if chr(c).isalpha()]] = UNSEEN
    for s, c in enumerate(letters, LETTERS):
        for form in {c, c.upper(), c.title()}:
            if len(form) == 1:
                symbols[ord(form)] = s
    symbols[ord("0") : ord("9") + 1] = DIGIT
    return symbols, LETTERS + len(letters)


def encode(text: str, symbols: np.ndarray) -> np.ndarray:
    """The symbols of a text without repeated breaks."""
    s = symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(s) < 2:
        return s
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != BREAK) | (s[:-1] != BREAK)
    return s[keep]


def suffix_automaton(sequence: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the automaton that accepts every substring of ``sequence``."""
    moves, link, size, last = [{}], [-1], [0], 0
    for c in sequence.tolist():
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def overlapped(states: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, entries) of the table of one automaton: an entry holds a state and the next one, or is -1. States with several
    transitions are placed first, the largest first, each where its entries are free; those with one fill the gaps."""
    sizes = np.fromiter(map(len, states), np.int64, len(states))
    several = np.flatnonzero(sizes > 1)
    several = several[np.argsort(-sizes[several], kind="stable")]
    room = 2 * int(sizes.sum()) + 4 * alphabet
    taken = bytearray(room)
    base, entries = np.zeros(len(states), np.int64), np.full(room, -1, np.int64)
    begin = alphabet
    for state in several.tolist():
        symbols = sorted(states[state])
        low, rest = symbols[0], symbols[1:]
        at = taken.find(0, begin)
        tries = 0
        while any(taken[at + s - low] for s in rest):
            at = taken.find(0, at + 1)
            tries += 1
        if tries > 8:  # what lies before is nearly full
            begin += (at - begin) // 4
        base[state] = at - low
        for s, to in states[state].items():
            taken[at + s - low] = 1
            entries[at + s - low] = (state << STATE_BITS) | to
    one = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(np.frombuffer(taken, np.uint8)[alphabet:] == 0)[: len(one)] + alphabet
    symbol = np.fromiter((next(iter(states[i])) for i in one), np.int64, len(one))
    to = np.fromiter((next(iter(states[i].values())) for i in one), np.int64, len(one))
    base[one] = free - symbol
    entries[free] = (one << STATE_BITS) | to
    used = int(np.flatnonzero(entries >= 0).max(initial=0)) + 1
    return base, np.append(entries[:used], np.full(alphabet, -1, np.int64))


def build(samples: dict[str, list[str]]) -> Model:
    """The model of all languages. Only one automaton stands in memory as dictionaries; its table is moved behind those
    of the languages before it."""
    languages = sorted(samples)
    symbols, alphabet = symbol_table([t for texts in samples.values() for t in texts])
    bases, tables, starts, first, weights, states, width = [], [], [], [], [], 0, 0
    for language in languages:
        parts = [np.append(encode(t, symbols), np.int32(BREAK)) for t in samples[language]]
        sequence = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        automaton = suffix_automaton(sequence)
        base, entries = overlapped(automaton, alphabet)
        # Both states of an entry count on from the states before.
        bases.append((base + width).astype(np.int32))
        tables.append(np.where(entries >= 0, entries + (states << STATE_BITS) + states, -1))
        row = np.full(alphabet, -1, np.int64)
        row[list(automaton[0])] = [to + states for to in automaton[0].values()]
        first.append(row)
        starts.append(states)
        weights.append(np.log2(max(2, len(sequence))))
        states, width = states + len(automaton), width + len(entries)
    if states >= STATES:
        raise ValueError("texts given to build() are too long for the table of transitions; train() bounds them")
    nothing = np.full(alphabet, -1, np.int64)  # the state after the last has no transitions
    begun = np.array(first, np.int64).reshape(len(languages), alphabet)
    return Model(
        languages,
        symbols,
        np.concatenate([*bases, np.array([width], np.int32)]),
        np.concatenate([*tables, nothing]),
        np.array(starts, np.int64),
        np.where(begun < 0, states, begun).astype(np.int32),
        np.array(weights),
    )


def training_sample(docs: DataFrame, *, docs_per_language: int, chars_per_doc: int, seed: int, most_chars: int = MOST_CHARS) -> dict[str, list[str]]:
    """Up to docs_per_language texts of each language, the first by digest; of a longer text a passage of
    chars_per_doc characters whose place the digest chooses. All together have ``most_chars`` characters at most: with
    many languages each has fewer passages, then shorter ones."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "text")
    most_languages = max(1, most_chars // LEAST_PASSAGE)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return {}
    each = min(docs_per_language * chars_per_doc, most_chars // len(counts))
    texts = max(1, min(docs_per_language, each // chars_per_doc))
    chars = max(1, min(chars_per_doc, each // texts))
    languages = known.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in counts], "lang string, _n long")
    digest = F.xxhash64(F.lit(seed), "doc_id", "text")
    spare = F.greatest(F.char_length("text") - chars, F.lit(0))
    start = F.pmod(F.shiftright(digest, 32), spare + 1).cast("int") + 1
    # A digest's share first, so that few rows are sorted; wide enough that the wanted number is there nearly always.
    share = F.least(F.lit(1.0), (4 * texts + 40) / F.col("_n"))
    drawn = known.join(F.broadcast(languages), "lang").filter(F.pmod(digest, F.lit(1 << 30)).cast("double") / (1 << 30) < share)
    cut = drawn.select("lang", F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.substring("text", start, F.lit(chars)).alias("text"), digest.alias("_d"))
    once = cut.groupBy("lang", "_d").agg(F.min("h").alias("h"), F.min("text").alias("text"))  # repeated rows once
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_d"))
    sample: dict[str, list[str]] = {}
    for row in sorted(once.withColumn("_place", place).filter(F.col("_place") <= texts).collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        sample.setdefault(row["lang"], []).append(row["text"])
    return sample


def train(docs: DataFrame, *, docs_per_language: int = 100, chars_per_doc: int = 800, seed: int = 7, most_chars: int = MOST_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows (lang, text, doc_id): docs_per_language * chars_per_doc
    characters of each language and ``most_chars`` of all at most, and all that are drawn are used."""
    return build(training_sample(docs, docs_per_language=docs_per_language, chars_per_doc=chars_per_doc, seed=seed, most_chars=most_chars))


class Parser:
    """Parses many segments in step, all languages side by side."""

    def __init__(self, model: Model, segment: int):
        self.model, self.segment = model, segment

    def moves(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether there is none) after ``symbol``; [languages, segments]."""
        entries = self.model.entries.take(self.model.base.take(state) + symbol, mode="clip")
        failed = (entries >> STATE_BITS) != state
        entries &= STATES
        return entries, failed

    def phrases(self, sequences: list[np.ndarray]) -> np.ndarray:
        """[texts, languages]: the number of phrases of each text against each automaton."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        pieces = -(-lengths // self.segment)
        owner = np.repeat(np.arange(len(sequences)), pieces)
        counts = np.zeros((len(sequences), len(self.model.languages)), np.int64)
        if not len(owner):
            return counts
        at = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + at * self.segment
        size = np.minimum(self.segment, lengths[owner] - at * self.segment)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        flat = np.concatenate(sequences).astype(np.int64)
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # segments longer than t
        state = np.repeat(self.model.starts.astype(np.int64)[:, None], len(owner), axis=1)
        found = np.ones(state.shape, np.int32)
        for t in range(size[0]):
            k = active[t]
            symbol = flat[begin[:k] + t]
            moved, failed = self.moves(state[:, :k], symbol)
            np.copyto(moved, self.model.first.take(symbol, axis=1), where=failed)
            state[:, :k] = moved
            if t:
                found[:, :k] += failed
        for j in range(len(self.model.languages)):
            counts[:, j] = np.bincount(owner, found[j], len(sequences)).astype(np.int64)
        return counts


def decide(model: Model, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) of each text. The score is the winner's share of the inverse rates."""
    rates = counts * model.weights / np.maximum(lengths, 1)[:, None]
    best = rates.argmin(axis=1)
    inverse = 1.0 / np.maximum(rates, 1e-9) ** 2
    return best, inverse[np.arange(len(best)), best] / inverse.sum(axis=1)


def predict(
    docs: DataFrame, model: Model, *, carry: list[str] | None = None, segment: int = 512, batch_chars: int = 500_000, names: tuple[str, str] = (
        "lang_pred",
        "score",
    )
) -> DataFrame:
    """The prediction and its score, under ``names``, for every row, after the columns ``carry`` of ``docs``
    (all, if not given); columns of those names give way."""
    docs = docs.select(*dict.fromkeys([*(docs.columns if carry is None else carry), "text"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in names and (carry is None or f.name in carry)]
    before = [f.name for f in kept]
    out = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        parser = Parser(model, segment)
        for batch in batches:
            for start, texts in text_blocks(batch.column("text"), batch_chars):
                rows = batch.slice(start, len(texts))
                said, scores = [UND] * len(texts), np.zeros(len(texts))
                usable = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model.languages else []
                if usable:
                    sequences = [encode(texts[i], model.symbols) for i in usable]
                    best, score = decide(model, parser.phrases(sequences), np.array([len(s) for s in sequences]))
                    scores[usable] = score
                    for i, b in zip(usable, best, strict=True):
                        said[i] = model.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(n) for n in before], pa.array(said, pa.string()), pa.array(scores)],
                    names=[*before, *names],
                )

    return docs.mapInArrow(giving_back(run), out)
