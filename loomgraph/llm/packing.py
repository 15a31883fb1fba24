"""Best-fit packing of token pieces into fixed-length sequences, by exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` counts) reaches the driver. There, from
the longest length down, combinations of one, then two, then three available lengths that fill
the gap exactly are looked up, by the complement of the length in an index of lengths, of sums of
two and of sums of three, and consumed as often as the counts allow; what none completes is packed best-fit, longest first.
The result is a plan of sequence patterns with multiplicities. Pieces are numbered within their length in parallel and
find their place in the plan by that number.

Defined results: a null or empty text is one piece that holds the end id alone; longer texts are
cut into full pieces and a last shorter one; repeated rows are packed as often as they occur; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, map_batches, read_table

CACHE_WORDS = 1_000_000
#: ASCII marks after letters are tokens apart whatever stands around, so words and marks are known by themselves and met again more often.
#: Only after letters that composing and lower-casing leave a single letter: others may end in a mark, which a stop joins.
_LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_encoders: dict[str, Callable[[str], bytes]] = {}


def word_encoder(path: str, cache_words: int = CACHE_WORDS) -> Callable[[str], bytes]:
    """Ids of a text as little-endian 32-bit bytes, the same as encoding the whole text.

    The tokenizer drops white space and merges nothing across it, so what stands between blanks
    is encoded once and kept, as long as the cache has room. What is not known yet is put together of its letters,
    small where the tokenizer makes them so, and the marks after them; of these only new ones are encoded.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    mark, between = min(special.items(), default=(-1, ""))
    known: dict[str, bytes] = {"": b""}
    lowers, letters_marks = "Lowercase" in str(tokenizer.normalizer), _LETTERS_MARKS.fullmatch

    def many(new: list[str]) -> list[bytes]:
        """Ids of each part; parts without special tokens are encoded in one text, a special token between."""
        if mark < 0 or any(between in x for x in new):
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(new, add_special_tokens=False)]
        ids = np.asarray(tokenizer.encode_batch_fast([between.join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts, data = (4 * np.flatnonzero(ids == mark)).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(x + 4 for x in cuts)], [*cuts, len(data)])]

    def encode(text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        made: dict[str, tuple[str, str]] = {}
        new: dict[str, None] = {}
        for x in dict.fromkeys(parts):
            if x not in known:
                found = letters_marks(x)
                made[x] = word, marks = (found[1].lower() if lowers else found[1], found[2]) if found else (x, "")
                if word not in known:
                    new[word] = None
                if marks not in known:
                    new[marks] = None
        ids = dict(zip(new, many(list(new)))) if new else {}
        if len(known) + len(ids) <= cache_words:
            known.update(ids)
            ids = {}
        own = {x: (ids[w] if w in ids else known[w]) + (ids[m] if m in ids else known[m]) for x, (w, m) in made.items()}
        # What is put together takes at most half the room; it is cheap to make again.
        if len(known) + len(own) <= cache_words // 2:
            known.update(own)
            return b"".join(map(known.__getitem__, parts))
        return b"".join([own[x] if x in own else known[x] for x in parts])

    _encoders[path] = encode
    return encode


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1, cache_words: int = CACHE_WORDS, keep_encoder: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian 32-bit).

    Workers keep the tokenizer and its cache from one task to the next unless ``keep_encoder`` is false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = word_encoder(path, cache_words), np.uint32(end_id).tobytes()
        try:
            for batch in batches:
                rows: list[tuple] = []
                held = 0
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, part))
                    held += len(ids)
                    if held > 1 << 23:
                        yield _piece_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _piece_batch(rows)
        finally:
            if not keep_encoder:
                _encoders.pop(path, None)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, piece int, start long, length long, ids binary")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (multiplicity, lengths) that together use each length as often as counted.

    Filling every gap exactly from the start can use up the short lengths that the last gaps
    need. So plans that hold back different shares of each length for the best-fit residue are
    made, and the one of fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, keep, parts) for keep, parts in ((0.0, 3), (0.5, 3), (0.0, 2), (0.5, 2), (0.0, 1))]
    return min(plans, key=lambda plan: sum(n for n, _ in plan))


def _plan(counts: dict[int, int], capacity: int, keep: float, most_parts: int) -> list[tuple[int, list[int]]]:
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] += n
    held = np.ceil(have * keep).astype(np.int64) if keep else np.zeros_like(have)
    plan: list[tuple[int, list[int]]] = []

    def times(parts: list[int], free: np.ndarray) -> int:
        return min(int(free[x]) // parts.count(x) for x in set(parts))

    def pair(total: int, own: list[int], free: np.ndarray) -> list[int] | None:
        """Two free lengths of that sum, the most uneven first."""
        if total < 2:
            return None
        a = np.arange(total - 1, (total - 1) // 2, -1)
        for x in a[(free[a] > 0) & (free[total - a] > 0)].tolist():
            if times([*own, x, total - x], free) > 0:
                return [x, total - x]
        return None

    def exact(gap: int, own: list[int], parts: int, free: np.ndarray, index: list[np.ndarray]) -> list[int] | None:
        if parts == 1:
            return [gap] if free[gap] > 0 and times([*own, gap], free) > 0 else None
        if parts == 2:
            return pair(gap, own, free) if index[0][gap] else None
        if not index[1][gap]:
            return None
        x = np.arange(gap - 1, 0, -1)
        for x in x[(free[x] > 0) & index[0][gap - x]].tolist():
            if times([*own, x], free) > 0 and (two := pair(gap - x, [*own, x], free)):
                return [x, *two]
        index[1][gap] = False  # what is used up does not come back
        return None

    full = int(have[capacity])
    if full:
        plan.append((full, [capacity]))
        have[capacity] = 0
    for parts in range(1, most_parts + 1):
        free = np.maximum(have - held, 0) if parts > 1 else have.copy()
        index = _sums(free, parts)
        for length in range(capacity - 1, 0, -1):
            while free[length] and (found := exact(capacity - length, [length], parts, free, index)):
                n = times([length, *found], free)
                plan.append((n, [length, *found]))
                for x in (length, *found):
                    free[x] -= n
                    have[x] -= n
    return plan + _best_fit(have, capacity)


def _sums(free: np.ndarray, parts: int) -> list[np.ndarray]:
    """Which totals are sums of two, and of three, free lengths. Lengths only run out, so the index may say too much, never too little."""
    if parts < 2:
        return []
    bits = sum(1 << x for x in np.flatnonzero(free).tolist())
    out, sums = [], bits
    for _ in range(parts - 1):
        more = 0
        for x in np.flatnonzero(free).tolist():
            more |= sums << x
        sums = more & ((1 << len(free)) - 1)
        out.append(np.array([sums >> t & 1 for t in range(len(free))], dtype=bool))
    return out


def _best_fit(have: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Longest first, each length to the open sequences with the smallest gap that holds it; alike sequences are kept as one."""
    open_at: dict[int, list[tuple[int, list[int]]]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, n: int, parts: list[int]) -> None:
        open_at.setdefault(gap, []).append((n, parts))
        gaps[gap] = True

    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                whole, rest = divmod(left, capacity // length)
                if whole:
                    put(capacity - length * (capacity // length), whole, [length] * (capacity // length))
                if rest:
                    put(capacity - length * rest, 1, [length] * rest)
                break
            gap = int(fits[0]) + length
            n, parts = open_at[gap].pop()
            used = min(n, left)
            if n > used:
                open_at[gap].append((n - used, parts))
            gaps[gap] = bool(open_at[gap])
            put(gap - length, used, [*parts, length])
            left -= used
    return [x for at in sorted(open_at) for x in open_at[at]]


def plan_ranges(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, sequence_id of from, offset): pieces of a length numbered from..to-1 take consecutive sequences."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, parts in plan:
        offset = 0
        for x in parts:
            at = used.get(x, 0)
            out.append((x, at, at + n, sequence, offset))
            used[x] = at + n
            offset += x
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int, rows_a_bucket: int = 100_000) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...) with sequence_id and offset.

    Pieces are numbered within (length, bucket) and shifted by the counts of earlier buckets, so
    a length that most pieces share is spread over many tasks. The plan's size depends on
    ``capacity`` alone, which bounds what is broadcast.
    """
    spark = pieces.sparkSession
    buckets = max(64, pieces.count() // rows_a_bucket)
    own = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by_bucket = own.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = spark.createDataFrame(plan_ranges(plan_patterns(histogram, capacity)), "length long, lo long, hi long, sequence_lo long, offset long")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(by_bucket.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    numbered = own.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    placed = numbered.join(shifts, ["length", "bucket"]).withColumn("number", F.col("shift") + F.col("rank") - 1)
    inside = (placed["length"] == ranges["length"]) & (placed["number"] >= ranges["lo"]) & (placed["number"] < ranges["hi"])
    kept = [placed[c] for c in pieces.columns]
    return placed.join(F.broadcast(ranges), inside).select(*kept, (F.col("sequence_lo") + F.col("number") - F.col("lo")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, cache_words: int = CACHE_WORDS, keep_encoder: bool = True) -> DataFrame:
    """Documents' pieces with their places; the pieces are written once and packed from there."""
    return pack(cut(piece_digests(token_pieces(docs, path, capacity, cache_words=cache_words, keep_encoder=keep_encoder))), capacity)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)

