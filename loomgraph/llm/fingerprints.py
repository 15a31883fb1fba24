"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

The shingles (five words) of a text are hashed once. The top bits of a hash choose one of ``BINS``
bins, the least hash of a bin stands for it. An empty bin takes the value of the bin that its own
universal hash sequence reaches first among the filled ones, the same sequence in every text, which
keeps collisions unbiased. Of each bin the low ``BITS`` bits are stored; the share of equal
positions is corrected for chance agreement, (m - 2**-b) / (1 - 2**-b), to estimate likeness.

Defined results: a text of fewer than five words has one shingle, all its words; a text without
words gets a fingerprint of its own that equals no other with words but by chance; null is empty;
equal texts have equal fingerprints; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, map_batches, read_table, shuffle_partitions, text_of
from loomgraph.llm.tokens import mix, pieces, shingles, words

BINS, BITS, SHINGLE = 256, 8, 5
_probes: dict[tuple[int, int], np.ndarray] = {}


def probe(bins: int, attempt: int) -> np.ndarray:
    """The bin that each empty bin tries at this attempt."""
    if (bins, attempt) not in _probes:
        at = np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((attempt + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
        _probes[bins, attempt] = (mix(mix(at)) % np.uint64(bins)).astype(np.int64)
    return _probes[bins, attempt]


def signatures(sets: list[np.ndarray], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """A row of ``bins`` values of ``bits`` (at most 8) bits for each set of shingle hashes."""
    shift = np.uint64(64 - int(np.log2(bins)))
    values = np.full((len(sets), bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    filled = np.zeros((len(sets), bins), dtype=bool)
    for k, s in enumerate(sets):
        if len(s):
            s = np.sort(s)
            bin_of = (s >> shift).astype(np.int64)
            first = np.flatnonzero(np.diff(bin_of, prepend=-1))
            values[k, bin_of[first]] = s[first]
            filled[k, bin_of[first]] = True
    out = values.copy()
    some = filled.any(axis=1)
    row, bin_of = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(row):
        target = probe(bins, attempt)[bin_of]
        hit = filled[row, target]
        out[row[hit], bin_of[hit]] = values[row[hit], target[hit]]
        row, bin_of = row[~hit], bin_of[~hit]
        attempt += 1
    low = mix(out) & np.uint64((1 << bits) - 1)
    return np.where(some[:, None], low, np.uint64(0)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated share of common shingles of each pair of rows, between 0 and 1."""
    chance = 2.0**-bits
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0.0, 1.0)


def packed(signature: np.ndarray, bits: int = BITS) -> bytes:
    if bits == 8:
        return signature.tobytes()
    planes = np.unpackbits(signature[:, None], axis=1)[:, 8 - bits :]
    return np.packbits(planes.ravel()).tobytes()


def unpacked(data: bytes, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(data, dtype=np.uint8)
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8))[: bins * bits].reshape(bins, bits)
    return np.packbits(np.pad(planes, ((0, 0), (8 - bits, 0))), axis=1).ravel()


def signatures_of(texts: pa.Array, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> np.ndarray:
    out = [signatures(shingles(words(data, offsets), k), bins, bits) for _, _, data, offsets in pieces(texts)]
    return np.concatenate(out) if out else np.zeros((0, bins), dtype=np.uint8)


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) with the packed low bits as binary; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = signatures_of(batch.column(1), bins, bits, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(r, bits) for r in rows], type=pa.binary())], names=["doc_id", "fingerprint"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, fingerprint binary")


def similarity(left: pa.Array | list[bytes], right: pa.Array | list[bytes], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Likeness of packed fingerprints, pair by pair."""
    pairs = [(unpacked(bytes(a), bins, bits), unpacked(bytes(b), bins, bits)) for a, b in zip(left, right)]
    return np.array([likeness(a, b, bits) for a, b in pairs])


_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, place int, text string, text_hash long"


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judge(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    """Result rows of documents with their next ones' texts; each following text but the last is the next of ``texts``."""
    edits = [_edited(a, b) for a, b in zip(texts, following)]
    chain, changed = (signatures_of(pa.array(x, type=pa.string())) for x in ([*texts, following[-1]], edits))
    own, after = chain[:-1], chain[1:]
    near_edited, near_next = likeness(own, changed), likeness(own, after)
    return [(i, len(t), hashlib.sha256(e.encode()).digest(), packed(a), packed(c), float(x), float(y)) for i, t, e, a, c, x, y in zip(ids, texts, edits, own, changed, near_edited, near_next)]


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edits, made from the next document in descending doc_id.

    Documents are dealt by range of doc_id, so each meets its next in the same sorted partition.
    A partition's first and last row also come back with their texts; these few, two a partition,
    are joined to each other across partitions. Ties of doc_id go by the hash of the text; null
    ids come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        first = True
        for batch in batches:
            part, ids, texts, hashes = (batch.column(k).to_pylist() for k in range(4))
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size + len(texts[to]) < 1 << 21):
                    size += len(texts[to])
                    to += 1
                i, t, h = ids[at:to], texts[at:to], hashes[at:to]
                if first:
                    yield _emit([(i[0], None, None, None, None, None, None, 2 * part[0], t[0], h[0])])
                    first = False
                if held:
                    i, t, h = [held[0], *i], [held[1], *t], [held[2], *h]
                held = (i[-1], t[-1], h[-1], part[0])
                if len(i) > 1:
                    yield _emit([(*r, -1, None, None) for r in _judge(i[:-1], t[:-1], t[1:])])
                at = to
        if held:
            yield _emit([(held[0], None, None, None, None, None, None, 2 * held[3] + 1, held[1], held[2])])

    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc()]
    dealt = d.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    done = cut(map_batches(dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text", "text_hash"), run, _RESULT))
    # Heads (even places) and tails (odd), in order: a tail's next is the head after it, the last tail's the very first head.
    # Only places are put in order in one task, two a partition; the texts meet by an equal join.
    ends = done.where("place >= 0").select("place", "doc_id", "text")
    ring = Window.orderBy("place")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = ends.select("place").withColumn("head", F.coalesce(F.lead("place").over(ring), F.first("place").over(whole))).where("place % 2 = 1")
    heads = ends.select(F.col("place").alias("head"), F.col("text").alias("following"))
    open_rows = ends.join(order, "place").join(heads, "head").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(k).to_pylist() for k in range(3))
            for i, t, f in zip(ids, texts, following):
                yield _emit([(*r, -1, None, None) for r in _judge([i], [t], [f])])

    rest = map_batches(open_rows, finish, _RESULT)
    text = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return done.where("place < 0").unionByName(rest).drop("place", "text", "text_hash").withColumns(text)


def op9(spark, sf_dir: str) -> DataFrame:
    return with_edits(read_table(spark, sf_dir, "documents"))
