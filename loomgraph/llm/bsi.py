"""Exact top-k by inner product over a bit-sliced index.

The index holds, per block of rows and dimension, one bitmap for each bit of the quantised values
(shifted to be non-negative), and the row ids in order. A query's integer weights select slices;
slices of equal weight are added by carry-save adders, bitmaps at a time, into the bit-sliced sum
of every row in the block (a negative weight uses the complement). The top rows are then picked
from the most significant slice downward, and rows that tie at the boundary by smaller id. Blocks
and query chunks are dealt out in a grid; each block gives at most k rows a query, which are
merged.

Values are quantised as floor(scale * x); a block has as many slices as its own values need. Scores
are 64-bit where all products surely fit and 38-digit decimals elsewhere, so they are exact up to
components of 2**60 after quantising, at which greater ones are held (no product of such fits a
decimal). Defined results: vectors that are null or hold a null, NaN or infinite component are
neither queries nor candidates; a shorter vector counts as padded with zeros; rows with a query's
own id are not its candidates; query rows of one id and several vectors are answered each, those
alike in both once; repeated candidate rows are candidates of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read_table

BLOCK_ROWS, CHUNK_QUERIES, LIMIT = 1 << 14, 1024, 1 << 60


def quantised(vector: str, scale: int) -> Column:
    """The integer components, null where the vector takes no part."""
    x = lambda v: v.cast("double")
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    # A whole double at the limit is exact, so holding there needs no integers.
    whole = F.transform(vector, lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(x(v) * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))
    return F.when(fine, whole)


def build_block(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Rows in id order, the shift, the number of bits, and slices (dimension, bit, 64-row words)."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = int(values.min(initial=0))
    shifted = (values - low).astype(np.uint64)
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    rows = -(-max(1, len(ids)) // 64) * 64
    slices = np.zeros((values.shape[1], bits, rows // 64), dtype=np.uint64)
    for b in range(bits):
        plane = np.zeros((values.shape[1], rows), dtype=bool)
        plane[:, : len(ids)] = ((shifted >> np.uint64(b)) & np.uint64(1)).T.astype(bool)
        slices[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return ids, low, bits, slices


def weighted_sum(slices: np.ndarray, low: int, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bit slices (least significant first) of each row's sum, and what to add to it for the true value."""
    bits = slices.shape[1]
    columns: dict[int, list[np.ndarray]] = {}
    shift = 0
    for sign in (1, -1):
        own = np.flatnonzero(weights * sign > 0)
        size = np.abs(weights[own])
        # value = low + s with s from the slices; for a negative weight -s = s' - (2**bits - 1) with the complement s'.
        total = sum(size.tolist())
        shift += sign * total * low - (total * ((1 << bits) - 1) if sign < 0 else 0)
        for j in range(int(size.max(initial=0)).bit_length()):
            dims = own[(size >> j) & 1 == 1]
            if len(dims):
                for b in range(bits):
                    plane = slices[dims, b]
                    columns.setdefault(j + b, []).append(plane if sign > 0 else ~plane)
    out: list[np.ndarray] = []
    weight = 0
    pending = {w: np.concatenate(parts) for w, parts in columns.items()}
    while pending:
        stack = pending.pop(weight, None)
        if stack is None:
            out.append(np.zeros(slices.shape[2], dtype=np.uint64))
            weight += 1
            continue
        carries = [pending.pop(weight + 1)] if weight + 1 in pending else []
        while len(stack) > 1:
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
                continue
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            stack = np.concatenate([half ^ c, stack[3 * third :]]) if len(stack) > 3 * third else half ^ c
        if carries:
            pending[weight + 1] = np.concatenate(carries) if len(carries) > 1 else carries[0]
        out.append(stack[0])
        weight += 1
    return out, shift


def top_rows(slices: list[np.ndarray], present: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of ``present`` (a bitmap) with the greatest sums; ties at the boundary by lower index."""
    count = lambda m: int(np.bitwise_count(m).sum())
    sure, open_ = np.zeros_like(present), present
    n_sure = 0
    for plane in reversed(slices):
        hit = open_ & plane
        n = count(hit)
        if n_sure + n > k:
            open_ = hit
        else:
            sure, n_sure, open_ = sure | hit, n_sure + n, open_ & ~plane
            if n_sure == k:
                break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if n_sure < k:
        ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
        chosen = np.concatenate([chosen, ties[: k - n_sure]])
    return np.sort(chosen)


def sums_of(slices: list[np.ndarray], shift: int, rows: np.ndarray, wide: bool) -> np.ndarray:
    """The sums of some rows, as Python integers where 64 bits may not do."""
    total = np.full(len(rows), shift, dtype=object if wide else np.int64)
    for w, plane in enumerate(slices):
        bit = (plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        total += bit.astype(object) * (1 << w) if wide else bit.astype(np.int64) << w
    return total


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix, short ones padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def build_index(vectors: DataFrame, dims: int, blocks: int) -> DataFrame:
    """(block, ids, low, bits, slices): one row a block; ``vectors`` has vec_id and values."""

    def build(table: pa.Table) -> pa.Table:
        ids, low, bits, slices = build_block(np.asarray(table.column("vec_id"), dtype=np.int64), _matrix(table.column("values"), dims))
        return pa.table({"block": table.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "low": [low], "bits": pa.array([bits], pa.int32()), "slices": pa.array([slices.tobytes()], pa.binary())})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "values"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, "block int, ids binary, low long, bits int, slices binary")


def _extent(vectors: DataFrame) -> tuple[int, int, int]:
    """Rows, greatest number of components, greatest magnitude."""
    peak = F.array_max(F.transform("values", lambda v: F.abs(v)))
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("values")).alias("d"), F.max(peak).alias("m")).first()
    return r.n, r.d or 0, r.m or 0


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: both inputs have vec_id and ``values`` (array<long>)."""
    (n, width, peak), (asked, asked_width, asked_peak) = _extent(vectors), _extent(queries)
    dims, blocks, chunks = max(width, asked_width, 1), max(1, -(-n // block_rows)), max(1, -(-asked // CHUNK_QUERIES))
    wide = dims * peak * asked_peak >= 1 << 62
    kind = pa.decimal128(38, 0) if wide else pa.int64()
    index = cut(build_index(vectors, dims, blocks))
    one_each = queries.select(F.col("vec_id").alias("query_id"), "values").distinct().withColumn("vector", F.xxhash64("values"))
    grid = one_each.withColumn("chunk", F.pmod(F.xxhash64("query_id", "vector"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids = np.frombuffer(right.column("ids")[0].as_buffer(), dtype=np.int64)
            bits, low = right.column("bits")[0].as_py(), right.column("low")[0].as_py()
            slices = np.frombuffer(right.column("slices")[0].as_buffer(), dtype=np.uint64).reshape(dims, bits, -1)
            everyone = np.packbits(np.arange(slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
            for query, vector, weights in zip(left.column("query_id").to_pylist(), left.column("vector").to_pylist(), _matrix(left.column("values"), dims)):
                present = everyone
                own = np.arange(*np.searchsorted(ids, [query, query + 1]))
                if len(own):
                    present = everyone.copy()
                    np.bitwise_and.at(present, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
                sums, shift = weighted_sum(slices, low, weights)
                rows = top_rows(sums, present, k)
                found.append((np.full(len(rows), query), np.full(len(rows), vector), ids[rows], sums_of(sums, shift, rows, wide)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        score = pa.array([Decimal(x) for x in columns[3].tolist()], kind) if wide else pa.array(columns[3], kind)
        return pa.table(dict(zip(("query_id", "vector", "vec_id", "score"), (*(pa.array(c, pa.int64()) for c in columns[:3]), score))))

    shape = f"query_id long, vector long, vec_id long, score {'decimal(38,0)' if wide else 'long'}"
    hits = grid.groupBy("block", "chunk").cogroup(tiles.groupBy("block", "chunk")).applyInArrow(search, shape)
    best = Window.partitionBy("query_id", "vector").orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's score is a long: one beyond its range is given as the nearest long, its rank is exact."""
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", 64).alias("values")).where("values is not null and vec_id is not null")
    found = top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)
    held = F.least(F.greatest("score", F.lit(-(1 << 63) + 1)), F.lit((1 << 63) - 1)).cast("long")
    return found.withColumn("score", held) if found.schema["score"].dataType.typeName() == "decimal" else found


ORACLE = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
