"""Language identification by unigrams over a fixed public vocabulary, marginal over segmentations.

Each language gives every piece of the vocabulary a probability. A word's probability is the sum, over all ways to cut
it into pieces, of the products of their probabilities, which a forward pass adds up from left to
right; a text's is the product over its words. The pieces' probabilities are fitted by expectation
maximisation: every distinct word of a language, with its count, adds to each piece the times it is
expected in the word's segmentations, found by following the forward pass back. Pieces are smoothed
by those of all languages together, so a piece that a language never showed still has a share.

Texts are put in Unicode's composed form and lower-cased. A word is a letter and the letters and marks that follow (a run over ``LONGEST``
characters counts as several); it starts with the vocabulary's mark of a word's start. A character that the vocabulary lacks is a
piece of its own, equally likely in all languages.

Words are counted by language in a distributed table that grows with the corpus, once; the rounds
read distinct words, never texts. What goes to the tasks is one number a piece and language, of at most
``MOST_LANGUAGES`` languages. Scoring reads each text once, without a shuffle.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing was
learned; the score is the share of the predicted language among all learned ones, by likelihood and by documents; ties go
to the language first by code point; a null doc_id is never learned from nor held out; repeated rows
are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, map_batches, read_table, release
from loomgraph.llm.toxicity import held_out

ROUNDS, MOST_LANGUAGES, LONGEST = 3, 256, 1 << 16
#: Weight of the languages' common share of a piece, in pieces; probability of a character out of the vocabulary.
SMOOTHING, UNKNOWN = 200.0, 1e-8
WORD_START, UNDETERMINED = "▁", "und"
#: Words that a counting task, a fitting step and a scoring worker hold.
COUNTED_WORDS, FITTED_WORDS, KNOWN_WORDS = 300_000, 20_000, 200_000
#: Ranges of pieces that fitting adds up apart.
RANGES = 32
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_PIECE = regex.compile(rf"{WORD_START}?[\p{{L}}\p{{M}}]*")
_BASE, _SPREAD, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18
_CELLS = 1 << 21
#: Steps after which the forward pass is scaled anew.
_RESCALE = 16


def words_of(text: str | None) -> list[str]:
    """A text's words, in order."""
    return _WORDS(unicodedata.normalize("NFC", text or "").lower()) if text else []


def _parts(word: str) -> list[str]:
    """What is scored of a word: itself, or its spans where it is very long, with the mark of a start."""
    return [WORD_START + word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def public_pieces(path: str) -> list[str]:
    """The pieces of a vocabulary file that a lower-cased word can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in own if p and p == p.lower() and _PIECE.fullmatch(p)})


class Vocabulary:
    """Numbers of pieces, found for all substrings of many words at once; the last number stands for characters it lacks."""

    def __init__(self, pieces: list[str]) -> None:
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        self._keys, self._ids = np.zeros((1 << _SLOT_BITS) + len(pieces) + 1, dtype=np.uint64), np.full((1 << _SLOT_BITS) + len(pieces) + 1, -1, dtype=np.int32)
        self._probes = 1
        for number, piece in enumerate(pieces):
            key = self._prefix_keys(np.frombuffer(piece.encode("utf-32-le"), dtype="<u4")[None])[0, -1]
            first = at = int(self._slots(np.array([key]))[0])
            while self._ids[at] >= 0:
                at += 1
            self._keys[at], self._ids[at] = key, number
            self._probes = max(self._probes, at - first + 1)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _prefix_keys(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + codes[:, j]
        return out

    def substrings(self, words: list[str]) -> np.ndarray:
        """(word, end, length - 1) -> number of the piece that ends there, -1 for none; words have one length."""
        n = len(words[0])
        prefix = self._prefix_keys(np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n))
        out = np.full((len(words), n, min(n, self.longest)), -1, dtype=np.int32)
        power = np.uint64(1)
        for m in range(1, out.shape[2] + 1):
            power = np.multiply(power, _BASE, dtype=np.uint64)
            keys = prefix[:, m:] - prefix[:, :-m] * power
            slots = self._slots(keys)
            found = np.where(self._keys[slots] == keys, self._ids[slots], np.int32(-1))
            missed = np.nonzero((found < 0) & (self._ids[slots] >= 0))
            for p in range(1, self._probes):
                at = slots[missed] + p
                found[missed] = np.where((found[missed] < 0) & (self._keys[at] == keys[missed]), self._ids[at], found[missed])
            out[:, m - 1 :, m - 1] = found
        lone = out[:, :, 0]
        lone[lone < 0] = self.size
        return out


def forward(pieces: np.ndarray, probability: Callable[[np.ndarray], np.ndarray], shares: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The log of the sum over all segmentations, (word, language), of words of one length.

    ``probability`` gives (word, length, language) for piece numbers, 0 where there is none. With
    ``shares`` also, for each end and length, the share of the segmentations up to that end
    whose last piece has that length (first language only).
    """
    n_words, n, longest = pieces.shape
    sums = None
    kept = np.zeros((n_words, n, longest)) if shares else None
    scale = None
    for j in range(1, n + 1):
        m = min(j, longest)
        p = probability(pieces[:, j - 1, :m])
        if sums is None:
            sums = np.zeros((n_words, n + 1, p.shape[2]))
            sums[:, 0], scale = 1.0, np.zeros((n_words, p.shape[2]))
        terms = sums[:, j - m : j][:, ::-1] * p
        sums[:, j] = terms.sum(axis=1)
        if kept is not None:
            kept[:, j - 1, :m] = terms[:, :, 0] / sums[:, j, :1]
        if j % _RESCALE == 0:
            now = sums[:, j].copy()
            sums[:, max(0, j - longest + 1) : j + 1] /= now[:, None]
            scale += np.log(now)
    return np.log(sums[:, n]) + scale, kept


def expected(shares: np.ndarray) -> np.ndarray:
    """(word, end, length - 1) -> how often the piece is expected there, from the shares of ``forward``."""
    n_words, n, longest = shares.shape
    reached = np.zeros((n_words, n + 1))
    reached[:, n] = 1.0
    out = np.zeros_like(shares)
    for j in range(n, 0, -1):
        m = min(j, longest)
        out[:, j - 1, :m] = reached[:, j, None] * shares[:, j - 1, :m]
        reached[:, j - m : j] += out[:, j - 1, :m][:, ::-1]
    return out


@lru_cache(maxsize=2)
def _vocabulary(pieces: tuple[str, ...]) -> Vocabulary:
    """The vocabulary of these pieces, kept by a worker for its next task."""
    return Vocabulary(list(pieces))


def _by_length(words: list[str], longest: int, columns: int) -> Iterator[np.ndarray]:
    """Places of words of one length, as many as are worked on at once."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, _CELLS // (n * min(n, longest) * columns))
        yield from (at[i : i + step] for i in range(0, len(at), step))


@dataclass
class Model:
    """Probabilities by (piece, language), the last row for characters out of the vocabulary; log shares of documents."""

    pieces: list[str]
    languages: list[str]
    probabilities: np.ndarray
    priors: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(word, language) log-probabilities of distinct words."""
        vocabulary = _vocabulary(tuple(self.pieces))
        parts = [_parts(w) for w in words]
        flat = [x for own in parts for x in own]
        out = np.empty((len(flat), len(self.languages)))
        padded = np.vstack([self.probabilities, np.zeros((1, len(self.languages)))])  # number -1: no piece
        for at in _by_length(flat, vocabulary.longest, len(self.languages)):
            out[at], _ = forward(vocabulary.substrings([flat[i] for i in at.tolist()]), padded.__getitem__)
        return out if len(flat) == len(words) else np.add.reduceat(out, np.cumsum([0, *map(len, parts[:-1])]), axis=0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (lang, text), and (lang, null, n) for the number of rows; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[str | None]] = {}

        def flushed() -> pa.RecordBatch:
            langs = [lang for lang, own in held.items() for _ in own]
            out = pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array([w for own in held.values() for w in own], type=pa.string()), pa.array([n for own in held.values() for n in own.values()], type=pa.int64())], names=["lang", "word", "n"])
            held.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = held.setdefault(lang, Counter())
                own[None] += 1
                own.update(words_of(text.as_py()))
            if sum(map(len, held.values())) > COUNTED_WORDS:
                yield flushed()
        if held:
            yield flushed()

    return cut(map_batches(docs, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _round(counted: DataFrame, pieces: list[str], languages: list[str], probabilities: np.ndarray) -> np.ndarray:
    """The times that each language's words are expected to hold each piece, under the probabilities so far."""
    place = {lang: i for i, lang in enumerate(languages)}
    sent = counted.sparkSession.sparkContext.broadcast((pieces, np.vstack([probabilities, np.zeros((1, len(languages)))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_pieces, padded = sent.value
        vocabulary = _vocabulary(tuple(own_pieces))
        totals = np.zeros((len(own_pieces) + 1) * len(languages))
        words: list[str] = []
        langs: list[int] = []
        counts: list[int] = []

        def add() -> None:
            lang, n = np.array(langs), np.array(counts, dtype=np.float64)
            for at in _by_length(words, vocabulary.longest, 3):
                numbers = vocabulary.substrings([words[i] for i in at.tolist()])
                of = lang[at]
                _, shares = forward(numbers, lambda x: padded[x, of[:, None]][:, :, None], shares=True)  # noqa: B023
                hit = numbers >= 0
                where = (numbers * len(languages) + of[:, None, None])[hit]
                totals[:] += np.bincount(where, weights=(expected(shares) * n[at][:, None, None])[hit], minlength=len(totals))
            for x in (words, langs, counts):
                x.clear()

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for part in _parts(word):
                    words.append(part)
                    langs.append(place[lang])
                    counts.append(n)
            if len(words) >= FITTED_WORDS:
                add()
        if words:
            add()
        yield packed(np.array_split(totals, RANGES))

    def packed(ranges: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(ranges)), type=pa.int32()), pa.array([x.tobytes() for x in ranges], type=pa.binary())], names=["part", "masses"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, masses in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(masses.as_buffer())
                sums[part] = sums[part] + own if part in sums else own.copy()
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([own.tobytes()], type=pa.binary())], names=["part", "masses"])

    # A task gives its masses in a few packed ranges of pieces; the ranges are added up apart, one row each is left.
    shape = "part int, masses binary"
    each = map_batches(counted.where("word is not null").select("lang", "word", "n"), run, shape)
    rows = {r.part: np.frombuffer(r.masses) for r in map_batches(each.repartition(RANGES, "part"), add_up, shape).collect()}
    sent.unpersist()
    n = (len(pieces) + 1) * len(languages)
    return (np.concatenate([rows[i] for i in range(RANGES)]) if rows else np.zeros(n)).reshape(-1, len(languages))


def smoothed(expected_counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Probabilities from expected counts; characters out of the vocabulary keep theirs."""
    own = expected_counts[:-1]
    common = own.sum(axis=1) + 1.0
    out = (own + smoothing * (common / common.sum())[:, None]) / (own.sum(axis=0) + smoothing)
    return np.vstack([out, np.full((1, out.shape[1]), UNKNOWN)])


def fit(docs: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> Model:
    """The model of (lang, text) rows, all of them."""
    counted = word_counts(docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    rows = counted.where("word is null").select("lang", "n").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn; the model goes to every task")
    shares = dict(sorted((r.lang, r.n) for r in rows))
    languages = list(shares)
    probabilities = np.full((len(pieces) + 1, len(languages)), 1.0 / max(1, len(pieces)))
    probabilities[-1] = UNKNOWN
    for _ in range(rounds if languages else 0):
        probabilities = smoothed(_round(counted, pieces, languages, probabilities))
    release(counted)
    n = np.array(list(shares.values()), dtype=np.float64)
    return Model(pieces, languages, probabilities, np.log(n / n.sum()) if len(n) else n)


def posteriors(scores: np.ndarray, priors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each row of log-likelihoods, the first of several, and its share."""
    at = scores + priors
    best = at.argmax(axis=1)
    return best, 1.0 / np.exp(at - at.max(axis=1, keepdims=True)).sum(axis=1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known: dict[str, int] = {}
        scores = np.zeros((0, len(own.languages)))
        for batch in batches:
            found = [words_of(t.as_py()) if own.languages else [] for t in batch.column(1)]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = [w for words in found for w in words]
            if len(known) > KNOWN_WORDS:
                known, scores = {}, scores[:0]
            new = [w for w in dict.fromkeys(flat) if w not in known]
            if new:
                scores = np.vstack([scores, own.word_scores(new)])
                known.update(zip(new, range(len(known), len(known) + len(new))))
            at = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
            langs, shares = np.full(len(found), UNDETERMINED, dtype=object), np.zeros(len(found))
            filled = np.flatnonzero(sizes)
            if len(filled):
                heads = (np.cumsum(sizes) - sizes)[filled]
                sums = np.stack([np.add.reduceat(scores[:, c][at], heads) for c in range(len(own.languages))], axis=1)
                best, shares[filled] = posteriors(sums, own.priors)
                langs[filled] = np.array(own.languages, dtype=object)[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs.tolist(), type=pa.string()), pa.array(shares)], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that are not held out."""
    learned = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    out = predict(docs, fit(learned, public_pieces(path), rounds))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return identify(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
