"""Toxicity by class-conditional interpolated Kneser-Ney bigram models with shared backoff counts.

A model per class gives the probability of a word after the word before it (or a text's start):
its count after that word in the class less a discount that depends on the count (1, 2, or 3 and
more), plus the discounted mass times the class's lower order. That is the number of distinct
words that the class has before the word, discounted alike, plus the mass times a backoff shared by
the classes, the number of distinct words before it in the whole corpus, labelled or not. Within a
class a bigram counts once a document, so a phrase repeated in one document weighs no more; where
a document is judged every occurrence of a word counts, in its place. A document's two
log-likelihoods are compared per word: the mean log ratio and two power means of the ratio, in
which few telling words in a long text still count; likewise under the lower orders alone, for
bigrams are sparse. Logistic regression on these six numbers turns them into a score; it is fitted
on rows apart from those whose counts made the models, at most ``CALIBRATION_ROWS`` of them.

Counts are kept in distributed tables that grow with the vocabulary, by hashes of words (48 bits) and bigrams; a key travels as
the 32 bits that follow those of its range, and ranges grow in number with the input, so that about one key in 10,000 shares its
counts with another at any size. The driver holds five totals. Texts are written once as batches of word numbers.
Each batch sends its distinct bigrams, packed by ranges of hashes, and gets each one's counts over
all batches back; then likewise its distinct words. Of the batches that hold a key one is told that
it is the key's owner, which is how distinct bigrams are counted by their words.

Defined results: a text without words (empty, null) has ratio 0 throughout; a null doc_id is never
learned from nor held out; several labels of one doc_id count as their greatest; with labels of
one class or none every score is that class's share, (toxic + 0.1) / (labels + 1); repeated rows
are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, cut_bucketed, map_batches, read_table, release, shuffle_partitions, text_of, unfolded, whole_row
from loomgraph.llm.tokens import mix, pieces, words

BATCH_WORDS, BUCKET_KEYS = 3 << 18, 1 << 19
#: Bits of a word's hash; bits of a key's hash that follow those of its bucket.
WORD_BITS, KEY_BITS = np.uint64(48), np.uint64(32)
DISCOUNTS = (0.0, 1.0, 1.5, 2.0)
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
START = np.uint64(0x9E3779B97F4A7C15)
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
_BLANK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
COMPARISONS = ("mean", "power1", "power2", "low_mean", "low_power1", "low_power2")
_PART = "batch binary, bucket int, width int, counts binary"


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _batches(docs: DataFrame, batch_words: int) -> DataFrame:
    """Runs of the rows (doc_id, digest, text): ids, digests, numbers of words, the distinct words' hashes and every word as its place among them."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        ids, digests, sizes, hashes = zip(*held)
        vocabulary, places, often = np.unique(np.concatenate([np.array([START]), *hashes]) & _WORD_MASK, return_inverse=True, return_counts=True)
        # The commonest words have the least numbers, so numbers compress well; the start of a text is number 0.
        often[places[0]] = np.iinfo(np.int64).max
        order = np.lexsort((vocabulary, -often))
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        # The id is random: equal batches stay apart. The table is written before it is used, so ids last.
        columns = [
            pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([[x for part in ids for x in part]], pa.list_(pa.int64())), pa.array([[x for part in digests for x in part]], pa.list_(pa.binary())),
            pa.array([np.concatenate(sizes).tolist()], pa.list_(pa.int64())), pa.array([len(vocabulary)], pa.int64()), pa.array([_rising(vocabulary[order] >> (np.uint64(64) - WORD_BITS))], pa.binary()), *_packed(number[places[1:]]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["batch", "doc_ids", "digests", "sizes", "distinct", "vocabulary", "width", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            ids, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to, data, offsets in pieces(batch.column(2), 1 << 20):
                w = words(data, offsets, lower=True, blank=_BLANK)
                held.append((ids[at:to], digests[at:to], np.diff(w.first), w.hashes))
                n += len(w.hashes) + to - at
                if n >= batch_words:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    shape = "batch binary, doc_ids array<long>, digests array<binary>, sizes array<long>, distinct long, vocabulary binary, width int, places binary"
    return map_batches(docs, run, shape)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Values in ``width`` bytes, first bytes first: like bytes stand together and compress."""
    return _COMPRESS.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def _unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(_DECOMPRESS.decompress(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def _packed(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The bytes that each count takes, and the counts in that width, compressed."""
    width = next(w for w, kind in _WIDTHS.items() if counts.max(initial=0) <= np.iinfo(kind).max)
    return pa.array([width], pa.int32()), pa.array([_planes(counts.ravel(), width)], pa.binary())


def _read(counts: bytes, width: int) -> np.ndarray:
    return _unplanes(counts, width).astype(np.int64)


_WORD_MASK = ~((np.uint64(1) << (np.uint64(64) - WORD_BITS)) - np.uint64(1))


def _rising(values: np.ndarray, bits: int = int(WORD_BITS)) -> bytes:
    """Values below 2**bits that mostly rise, as their differences."""
    return _planes(np.diff(values, prepend=np.uint64(0)), bits // 8)


def _unrising(data: bytes, bits: int = int(WORD_BITS)) -> np.ndarray:
    return np.cumsum(_unplanes(data, bits // 8), dtype=np.uint64) & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))


def _bigrams(vocabulary: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: its distinct bigrams' hashes, their first and second words' places, and each word's bigram."""
    before = np.empty_like(places)
    before[1:] = places[:-1]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[first] = 0
    pairs, which = np.unique(before * len(vocabulary) + places, return_inverse=True)
    u, w = pairs // len(vocabulary), pairs % len(vocabulary)
    return mix(mix(vocabulary[u]) + vocabulary[w]), u, w, which


def _by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys by hash, and the bounds of the buckets (their top bits) in it."""
    order = np.argsort(keys, kind="stable")
    bucket = (keys[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return order, np.searchsorted(bucket, np.arange((1 << bits) + 1))


def _deal(batch: bytes, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A batch's keys and a row of counts for each column, by bucket; of a key the bits after the bucket's go, in rising order."""
    order, bounds = _by_bucket(keys, bits)
    short = (keys << np.uint64(bits)) >> (np.uint64(64) - KEY_BITS)
    rows = []
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[b] : bounds[b + 1]]
        rows.append((batch, b, *_packed(counts[:, own]), _rising(short[own], int(KEY_BITS))))
    if rows:
        batches, buckets, widths, packed, short_keys = zip(*rows)
        columns = [pa.array(batches, pa.binary()), pa.array(buckets, pa.int32()), pa.concat_arrays(widths), pa.concat_arrays(packed), pa.array(short_keys, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["batch", "bucket", "width", "counts", "keys"])


def _answers(dealt: DataFrame, columns: int, buckets: int) -> DataFrame:
    """(batch, parts), kept by batch: for each dealt key, by bucket, the sums of its counts over all batches, and whether the batch is its owner.

    Answers are written before they are gathered, so what was dealt is gone from the disk by then.
    """

    def add(table: pa.Table) -> pa.Table:
        parts = [_unrising(x.as_buffer(), int(KEY_BITS)) for x in table.column("keys")]
        counts = [_read(c.as_buffer(), w).reshape(columns, -1) for c, w in zip(table.column("counts"), table.column("width").to_pylist())]
        found, first, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        owner = np.zeros(len(back), dtype=np.int64)
        owner[first] = 1
        # Sums of whole numbers in doubles are exact below 2**53.
        total = np.stack([np.bincount(back, weights=np.concatenate([c[k] for c in counts]), minlength=len(found)).astype(np.int64) for k in range(columns)])
        ends = np.cumsum([0, *map(len, parts)])
        packed = [_packed(np.vstack([total[:, back[a:b]], owner[None, a:b]])) for a, b in zip(ends[:-1], ends[1:])]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "width": pa.concat_arrays([w for w, _ in packed]), "counts": pa.concat_arrays([c for _, c in packed])})

    answered = cut(dealt.groupBy("bucket").applyInArrow(add, _PART))
    gathered = cut_bucketed(answered.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "width", "counts"))).alias("parts")), buckets, "batch")
    release(answered)
    return gathered


def _gathered(keys: np.ndarray, parts: pa.Scalar, columns: int, bits: int) -> np.ndarray:
    """The answers in the order of ``keys``; the last row says whether the batch is the key's owner."""
    out = np.empty((columns + 1, len(keys)), dtype=np.int64)
    if len(keys):
        order, _ = _by_bucket(keys, bits)
        out[:, order] = np.concatenate([_read(p["counts"], p["width"]).reshape(columns + 1, -1) for p in parts.as_py()], axis=1)
    return out


def _taken(counts: np.ndarray) -> np.ndarray:
    return np.array(DISCOUNTS)[np.minimum(counts, 3)]


def _contents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, vocabulary, word places and sizes of each batch of texts."""
    named = {name: batch.column(name) for name in ("vocabulary", "places", "width", "sizes")}
    for i in range(batch.num_rows):
        vocabulary = _unrising(named["vocabulary"][i].as_buffer()) << (np.uint64(64) - WORD_BITS)
        yield i, vocabulary, _read(named["places"][i].as_buffer(), named["width"][i].as_py()), np.array(named["sizes"][i].as_py(), dtype=np.int64)


def _class_bigrams(marks: pa.Scalar, sizes: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    """The bigrams (as numbered in ``which``, one a word) of the batch's toxic and of its ordinary rows, each once a row."""
    label = np.full(len(sizes), -1)
    for mark in marks.as_py() or ():
        label[mark["place"]] = mark["toxic"]
    n = int(which.max(initial=0)) + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    return [np.unique(row[label[row] == c] * n + which[label[row] == c]) % n for c in (1, 0)]


def log_ratios(bigram: np.ndarray, before: np.ndarray, word: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of each bigram's toxic over its ordinary probability, and the same of its second word in the lower orders.

    Rows (toxic, ordinary) of ``bigram`` are its counts; of ``before`` the first word's counts and its
    discounted masses; of ``word`` the second's distinct predecessors in the classes and the corpus;
    ``totals`` are the sums of these three over all words and the discounted masses of the first two.
    """
    backoff = np.maximum(word[2], 1) / max(totals[2], 1)
    logs, lows = [], []
    for c in (0, 1):
        n, mass = max(totals[c], 1), max(totals[3 + c], 1.0)
        lower = np.maximum(word[c] - _taken(word[c]), 0) / n + mass / n * backoff
        context = np.maximum(before[c], 1)
        # A context with bigrams has a mass of 1 at least; bigrams that share a hash must not leave it less.
        spare = np.maximum(before[2 + c], 1.0)
        logs.append(np.log(np.where(before[c] > 0, np.maximum(bigram[c] - _taken(bigram[c]), 0) / context + spare / context * lower, lower)))
        lows.append(np.log(lower))
    return logs[0] - logs[1], lows[0] - lows[1]


def _compared(ratios: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the three length-normalised comparisons of its words' ratios; the greatest is taken out before powers."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    top = np.full(len(sizes), -np.inf)
    np.maximum.at(top, doc, ratios)
    top = np.where(sizes > 0, top, 0.0)
    mean = lambda x, empty: np.where(sizes > 0, np.bincount(doc, weights=x, minlength=len(sizes)) / np.maximum(sizes, 1), empty)
    below = ratios - top[doc]
    return np.column_stack([mean(ratios, 0.0), top + np.log(mean(np.exp(below), 1.0)), top + np.log(mean(np.exp(2 * below), 1.0)) / 2])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method; constant for labels of one class."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.1) / (len(y) + 1)
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _bits(keys: int, bucket_keys: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, keys / bucket_keys)))))


def compare(docs: DataFrame, known: DataFrame, batch_words: int = BATCH_WORDS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, digest and the six comparisons of each row of ``docs``, by class models of the rows ``known`` (labelled, toxic)."""
    buckets = shuffle_partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"), text_of().alias("text"))
    batches = cut_bucketed(_batches(texts, batch_words), buckets, "batch")
    size = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))
    total = batches.agg(size.alias("words"), F.sum("distinct").alias("own")).first()
    of_pairs, of_words = _bits(total.words or 0, bucket_keys), _bits(total.own or 0, max(1, bucket_keys // 4))
    # Labels meet the rows' places in batches, so no text moves. The join is by sorting at any size of the labels.
    rows = batches.select("batch", F.posexplode("doc_ids").alias("place", "doc_id"))
    marks = rows.join(known.hint("merge"), F.col("doc_id") == F.col("labelled")).groupBy("batch").agg(F.collect_list(F.struct("place", "toxic")).alias("marks"))
    marked = cut_bucketed(marks, buckets, "batch")

    def deal_pairs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i, vocabulary, places, sizes in _contents(batch):
                keys, _, _, which = _bigrams(vocabulary, places, sizes)
                counts = np.stack([np.bincount(own, minlength=len(keys)) for own in _class_bigrams(batch.column("marks")[i], sizes, which)])
                yield from _deal(batch.column("batch")[i].as_py(), keys, counts, of_pairs)

    def deal_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i, vocabulary, places, sizes in _contents(batch):
                keys, u, w, which = _bigrams(vocabulary, places, sizes)
                if not len(keys):
                    continue
                n = len(vocabulary)
                own = [np.bincount(u[x], minlength=n) for x in _class_bigrams(batch.column("marks")[i], sizes, which)]
                toxic, ordinary, owner = _gathered(keys, batch.column("parts")[i], 2, of_pairs)
                of = lambda at, x: np.bincount(at, weights=x * owner, minlength=n).astype(np.int64)  # noqa: B023, E731
                # Masses are halves at most, so they travel doubled.
                counts = [*own, of(u, 2 * _taken(toxic)), of(u, 2 * _taken(ordinary)), of(w, toxic > 0), of(w, ordinary > 0), of(w, 1)]
                yield from _deal(batch.column("batch")[i].as_py(), vocabulary, np.stack(counts), of_words)

    def sum_up(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(5)
        for batch in source:
            for parts in batch.column(0):
                for p in parts.as_py():
                    x = _read(p["counts"], p["width"]).reshape(8, -1)
                    x = x[4:7, x[7] > 0]
                    sums += [*x.sum(axis=1), _taken(x[0]).sum(), _taken(x[1]).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=["a", "b", "c", "d", "e"])

    dealt = "batch binary, bucket int, width int, counts binary, keys binary"
    content = ("batch", "sizes", "vocabulary", "width", "places")
    for_pairs = map_batches(batches.join(marked, "batch", "left").select(*content, "marks"), deal_pairs, dealt)
    pairs = _answers(for_pairs, 2, buckets)
    for_words = map_batches(batches.join(pairs, "batch").join(marked, "batch", "left").select(*content, "marks", "parts"), deal_words, dealt)
    vocabulary_counts = _answers(for_words, 7, buckets)
    sums = map_batches(vocabulary_counts.select("parts"), sum_up, "a double, b double, c double, d double, e double")
    totals = np.array([x or 0.0 for x in sums.agg(*[F.sum(c) for c in "abcde"]).first()])

    def rate(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i, vocabulary, places, sizes in _contents(batch):
                x = np.zeros((len(sizes), 6))
                if len(places):
                    keys, u, w, which = _bigrams(vocabulary, places, sizes)
                    word = _gathered(vocabulary, batch.column("words")[i], 7, of_words)
                    before = np.stack([word[0], word[1], word[2] / 2, word[3] / 2])
                    ratios = log_ratios(_gathered(keys, batch.column("parts")[i], 2, of_pairs), before[:, u], word[4:7][:, w], totals)
                    x = np.hstack([_compared(r[which], sizes) for r in ratios])
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, batch.column("digests")[i].values, *[pa.array(c) for c in x.T]], names=["doc_id", "digest", *COMPARISONS])

    whole = batches.join(pairs, "batch", "left").join(vocabulary_counts.withColumnRenamed("parts", "words"), "batch", "left")
    rated = cut(map_batches(whole, rate, "doc_id long, digest binary, " + ", ".join(f"{c} double" for c in COMPARISONS)))
    release(batches, marked, pairs, vocabulary_counts)
    return rated


@dataclass
class Model:
    """The comparisons of the fitted table's rows (with doc_id and digest), and the regression on them."""

    compared: DataFrame
    weights: np.ndarray
    intercept: float

    def scores(self) -> Column:
        at = F.lit(self.intercept)
        for w, c in zip(self.weights.tolist(), COMPARISONS):
            at = at + F.lit(w) * F.col(c)
        return 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(700.0)), F.lit(-700.0))))


def fit(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS, batch_words: int = BATCH_WORDS) -> Model:
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold("labelled") != 2)
    # Folds 0 and 1 make the class counts, fold 3 the calibration, fold 2 is never looked at.
    compared = compare(docs, known.where(fold("labelled") < 2), batch_words)
    tuned = compared.join(known.where(fold("labelled") == 3).hint("merge"), F.col("doc_id") == F.col("labelled"))
    sample = tuned.orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest").limit(calibration_rows).collect()
    x = np.array([[r[c] for c in COMPARISONS] for r in sample], dtype=np.float64).reshape(-1, len(COMPARISONS))
    return Model(compared, *logistic(x, np.array([float(r.toxic) for r in sample])))


def score(model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the comparisons, for each row of the fitted table; no shuffle."""
    scored = model.compared.withColumn("score", model.scores())
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *COMPARISONS)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, the fitted table, all columns as they are, whose text scores below the threshold."""
    dropped = cut(model.compared.where(model.scores() >= threshold).select(F.col("digest").alias("dropped_digest")).distinct())
    rows = docs.select(whole_row(docs).alias("row"))
    own = digest_of(F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")))
    return unfolded(rows.join(dropped, own == F.col("dropped_digest"), "left_anti"), "row", docs.columns, {})


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(fit(docs, labels), threshold)


def op6(spark, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
