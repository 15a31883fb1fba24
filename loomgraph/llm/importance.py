"""Importance resampling towards a target, over hashed n-grams, by external sort-count.

A pass over the documents writes, for each batch, a packed uint16 stream of the buckets of its
features in document order, with each document's number of features, from which its offset in the
stream follows. The stream is also sorted and run-length encoded at once; Spark adds up the runs of
all batches, so counting never holds more than a batch and one row a bucket and task. The target's
counts are made alike. The gains of the buckets, a table of fixed size, then go to the tasks, which
read the streams again, look the gains up and add them by document with ``np.add.reduceat``. Texts
are read once. Scores are Gumbel-perturbed weights; documents are put in order of score by range,
and ranks follow from the ranges' sizes, so no task holds the draw.

A feature is a run of 1 to 3 words joined by one space; its bucket is its bytes' CRC-32 modulo
``BUCKETS``. CRC-32 is linear, so a run's value comes from its words' values by table look-ups,
over whole arrays.

Defined results: a null or empty text has no features and weight 0; repeated rows are documents of
their own, ties of (score, doc_id) among them go by their place in the streams; a row without a doc_id has no
score, is not drawn and not counted for the draw; an empty table gives an empty result, an empty
target gains from smoothing alone; a text of any length is cut into spans for the arrays only, its runs
go across them; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, map_batches, read_table, release, shuffle_partitions, text_of
from loomgraph.llm.tokens import list_of, pieces

BUCKETS, RUN_WORDS, FEWEST_WORDS, DRAWN_PERCENT, SEED = 10_000, 3, 20, 5, 42
SPAN = 1 << 21
#: Bytes whose effect on a CRC is tabulated by length; longer words take the tables of powers of two.
_SHORT = 32
_FULL = np.uint32(0xFFFFFFFF)
#: Bytes of words: digits, letters, and all of non-ASCII characters.
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _crc_table() -> np.ndarray:
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & 1, (at >> 1) ^ np.uint32(0xEDB88320), at >> 1)
    return at


_BYTE = _crc_table()


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map that ``table`` gives for each of the four bytes of a value."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of appending 0, 1, ... zero bytes to what a CRC was taken of, and of appending 2**k of them."""
    own = np.arange(256, dtype=np.uint32)
    tables = [np.stack([own << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_SHORT):
        tables.append(_BYTE[tables[-1] & 255] ^ (tables[-1] >> 8))
    powers = [tables[1]]
    for _ in range(40):
        powers.append(_applied(powers[-1], powers[-1]))
    return np.stack(tables), powers


_SHIFTS, _POWERS = _shift_tables()


def joined_crc(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, from theirs and the length of the second."""
    short = np.minimum(right_length, _SHORT)
    out = _SHIFTS[short, 0, left & 255] ^ _SHIFTS[short, 1, (left >> 8) & 255] ^ _SHIFTS[short, 2, (left >> 16) & 255] ^ _SHIFTS[short, 3, left >> 24]
    long = np.flatnonzero(right_length > _SHORT)
    if len(long):
        rest = right_length[long] - _SHORT
        for bit in range(int(rest.max()).bit_length()):
            on = long[(rest >> bit) & 1 == 1]
            out[on] = _applied(_POWERS[bit], out[on])
    return out ^ right


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words a byte at a time; of the few long ones one by one."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    crc = np.full(len(at), _FULL, dtype=np.uint32)
    for p in range(min(_SHORT, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -p, side="left"))
        crc[:n] = _BYTE[(crc[:n] ^ data[at[:n] + p]) & 255] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = crc ^ _FULL
    for i in np.flatnonzero(lengths > _SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[data]
    fresh, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte starts a word whatever ends the text before
    fresh[heads] = inside[1:-1][heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[1:-1][tails]
    return np.flatnonzero(fresh), np.flatnonzero(last) + 1


def _runs(data: np.ndarray, offsets: np.ndarray, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, features per text, words per text); the first ``carried`` words only stand before later ones."""
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    starts, ends = _word_bounds(data, offsets)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    n = len(starts)
    place = np.arange(n) - np.repeat(first[:-1], n_words)
    own, length = word_crcs(data, starts, ends), ends - starts
    crc = np.zeros((n, RUN_WORDS), dtype=np.uint32)
    there = np.zeros((n, RUN_WORDS), dtype=bool)
    if n:
        run = own
        for k in range(RUN_WORDS):
            # Column k is the run of k + 1 words that ends here; ``run`` starts k words earlier.
            crc[k:, k], there[:, k] = run, place >= k
            if k + 1 < RUN_WORDS and n > k + 1:
                open_ = run[:-1] ^ _FULL
                spaced = (_BYTE[(open_ ^ np.uint32(32)) & 255] ^ (open_ >> 8)) ^ _FULL
                run = joined_crc(spaced, own[k + 1 :], length[k + 1 :])
            elif k + 1 < RUN_WORDS:
                break
    there[:carried] = False
    per_word = there.sum(axis=1)
    upto = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(per_word, out=upto[1:])
    return (crc[there] % np.uint32(BUCKETS)).astype("<u2"), np.diff(upto[first]), n_words - (carried if len(n_words) else 0)


def bucket_stream(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of some texts in order, and each text's numbers of features and of words."""
    if len(offsets) != 2 or len(data) <= span:
        return _runs(data, offsets)
    # One long text: spans end between words, and take the words before them along.
    parts, features, words_in_all, at, fresh, carried = [], 0, 0, 0, 0, 0
    while fresh < len(data):
        to = min(len(data), fresh + span)
        while to < len(data):
            gap = np.flatnonzero(~_IN_WORD[data[to : to + span]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(len(data), to + span)
        piece = data[at:to]
        stream, n_features, n_words = _runs(piece, np.array([0, len(piece)]), carried)
        parts.append(stream)
        features, words_in_all = features + int(n_features[0]), words_in_all + int(n_words[0])
        starts, _ = _word_bounds(piece, np.array([0, len(piece)]))
        carried = min(RUN_WORDS - 1, len(starts))
        at, fresh = at + int(starts[-carried]) if carried else to, to
    return np.concatenate(parts), np.array([features]), np.array([words_in_all])


def sorted_counts(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort and run-length encode: the buckets that occur, and how often."""
    ordered = np.sort(stream, kind="stable")
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
    return ordered[heads], np.diff(np.r_[heads, len(ordered)])


_STREAM = "batch string, doc_ids array<long>, n_words array<long>, n_features array<long>, stream binary, buckets array<int>, counts array<long>"


def streams(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """The bucket streams of ``docs``, one row a batch, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in pieces(batch.column(1), SPAN):
                stream, features, n_words = bucket_stream(data, offsets)
                buckets, counts = sorted_counts(stream)
                one = lambda x, kind: list_of(x, np.array([len(x)]), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().hex]), pa.array([ids[a:b].to_pylist()], type=pa.list_(pa.int64())), one(n_words, pa.int64()), one(features, pa.int64()),
                        pa.array([stream.tobytes()], type=pa.binary()), one(buckets.astype(np.int32), pa.int32()), one(counts.astype(np.int64), pa.int64()),
                    ],
                    names=[c.split()[0] for c in _STREAM.split(", ")],
                )

    key = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    return cut(map_batches(docs.select(key.alias("doc_id"), text_of(text).alias("text")), run, _STREAM))


def bucket_counts(written: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all streams: the batches' runs, added up by bucket."""
    runs = written.select(F.explode(F.arrays_zip("buckets", "counts")).alias("run")).select("run.buckets", "run.counts")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in runs.groupBy("buckets").agg(F.sum("counts").alias("n")).collect():
        out[r.buckets] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths of a natural log."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def summed_by_document(stream: np.ndarray, n_features: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The gains of each document's run of the stream, added up; 0 where it has no features."""
    out = np.zeros(len(n_features), dtype=np.int64)
    filled = np.flatnonzero(n_features)
    if len(filled):
        starts = np.cumsum(n_features) - n_features
        out[filled] = np.add.reduceat(gains[stream], starts[filled])
    return out


def weights(written: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, batch, place, n_words, n_features, weight), one row a document, from the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_words, features = (batch.column(c)[k].values for c in (1, 2, 3))
                stream = np.frombuffer(batch.column(4)[k].as_buffer(), dtype="<u2")
                own = summed_by_document(stream, features.to_numpy(), gains)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array([batch.column(0)[k].as_py()] * n), pa.array(np.arange(n), type=pa.int32()), n_words, features, pa.array(own)], names=["doc_id", "batch", "place", "n_words", "n_features", "weight"])

    return map_batches(written.select("batch", "doc_ids", "n_words", "n_features", "stream"), run, "doc_id long, batch string, place int, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The perturbation of a document, in thousandths, from a hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = DRAWN_PERCENT) -> DataFrame:
    """``scored`` with rank: of the rows marked ``fit``, the highest scores of so many in a hundred, ties to smaller doc_id.

    Rows are dealt by ranges of the order and written with their place in their range; a row's rank is
    that place after the sizes of the ranges before it.
    """
    order = [F.col("fit").desc(), F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("batch"), F.col("place")]
    dealt = scored.repartitionByRange(shuffle_partitions(scored.sparkSession), *order).sortWithinPartitions(*order)
    # Numbers by partition in the upper bits and by row below.
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("size"), F.count_if("fit").alias("fit_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row a range, so as few as there are partitions.
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.floor(F.sum("fit_size").over(everything) * percent / F.lit(100)).alias("drawn"))
    rank = F.col("start") + within + 1
    return dealt.join(F.broadcast(starts), part == F.col("part")).withColumn("rank", F.when(F.col("fit") & (rank <= F.col("drawn")), rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, fewest_words: int = FEWEST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of ``docs``; rank is null where not drawn."""
    wanted = streams(target, None)
    gained = bucket_counts(wanted)
    release(wanted)
    written = streams(docs)
    weighed = weights(written, gains_of(bucket_counts(written), gained))
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    fit = F.col("doc_id").isNotNull() & (F.col("n_words") >= fewest_words)
    out = ranked(weighed.withColumns({"score": score, "fit": fit}), percent)
    release(written)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13(spark, sf_dir: str) -> DataFrame:
    drawn = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
