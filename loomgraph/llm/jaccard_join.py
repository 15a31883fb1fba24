"""Exact Jaccard self-join of documents' shingle sets, by filters of several global token orders.

1. Documents are reduced to distinct shingle sets, each named by a 128-bit digest of its tokens;
   documents with the same set are linked without comparison.
2. The document frequency of every token is counted exactly but for the folding of hashes to 24
   bits within a bucket. Tokens travel as packed arrays, one per batch of documents and bucket,
   and come back as one byte a token, so the corpus's tokens are shuffled once.
3. Three global orders rank tokens by rising frequency and break ties by three different hashes.
   A set's prefix under an order is its first n - ceil(t * n) + 1 tokens; sets as similar as t share
   a prefix token under each order. Tokens that occur in one document only are not listed.
4. Within the list of a token under the first order each set is paired with a pivot, the set with
   the greatest share of tokens that occur elsewhere, as the source of many edited copies has. A
   pair must have sizes, and numbers of later tokens that occur elsewhere, that allow the similarity, and
   meet in the prefixes of the second and third order as well; what is left is verified on whole
   sets. In lists that still hold several components the next pivots are taken outside the last
   pivot's component, for ``ROUNDS`` rounds. All pairs across components that then remain in a list
   are formed last and filtered and verified in the same way. Long lists are split by the second
   order's prefix tokens, which two similar sets also share. So no link between components is
   missed and a group of copies costs work in proportion to its size.

Only connectivity is returned, links within a component need not all be named.

Defined results: fewer words than a shingle make one token, no words (or null) an empty set that
links with nothing; repeated rows and null doc_ids are documents (a component's id is its least
non-null doc_id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, cut_bucketed, map_batches, read_table, release, shuffle_partitions
from loomgraph.llm.components import components
from loomgraph.llm.tokens import list_of, mix, pieces, shingles, words

BATCH_TOKENS, BUCKET_TOKENS, LONG_LIST, ROUNDS = 1 << 17, 1 << 19, 4096, 4
_SEEDS = (np.uint64(0), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """A row per batch: batch id, and doc_ids, set digests, sizes, and all tokens (sorted in each set) packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            held = 0
            for at, _, data, offsets in pieces(batch.column(1)):
                for i, s in enumerate(shingles(words(data, offsets, lower=True), k)):
                    s = np.unique(s)
                    rows.append((ids[at + i], hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), s))
                    held += len(s)
                    if held >= BATCH_TOKENS:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "batch binary, doc_ids array<long>, sets array<binary>, sizes array<long>, tokens binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    tokens = np.concatenate([r[3] for r in rows])
    uid = uuid.uuid4().bytes  # equal batches stay apart; the table is written before it is used, so ids last
    columns = [pa.array([uid], pa.binary()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.binary())), pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), pa.array([tokens.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "doc_ids", "sets", "sizes", "tokens"])


def _by_bucket(tokens: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts tokens by bucket (their top bits), the sorted tokens and the buckets' bounds."""
    t = np.frombuffer(tokens, dtype=np.uint64)
    order = np.argsort(t, kind="stable")
    t = t[order]
    bucket = (t >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(t), np.int64)
    return order, t, np.searchsorted(bucket, np.arange((1 << bits) + 1))


def frequency_codes(sets: DataFrame, bits: int) -> DataFrame:
    """(batch, bucket, codes): a byte for each token of the batch's bucket, rising with its document frequency."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, t, bounds = _by_bucket(tokens.as_buffer(), bits)
                low = ((t << np.uint64(bits)) >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * len(full), pa.binary()), pa.array(full.astype(np.int32)), pa.array([low[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary())],
                    names=["batch", "bucket", "tokens"],
                )

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(-1, 3) for x in table.column("tokens")]
        flat = np.pad(np.concatenate(parts), ((0, 0), (0, 1))).view("<u4").ravel()
        order = np.argsort(flat, kind="stable")
        edges = np.flatnonzero(np.diff(flat[order], prepend=flat[order[0]] + np.uint32(1)))
        edges[0] = 0
        runs = np.diff(np.append(edges, len(flat)))
        codes = np.empty(len(flat), dtype=np.uint8)
        codes[order] = np.repeat(np.minimum(255, np.round(5 * np.log2(runs))).astype(np.uint8), runs)
        ends = np.cumsum([0, *map(len, parts)])
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "codes": pa.array([codes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    dealt = map_batches(sets.select("batch", "tokens"), deal, "batch binary, bucket int, tokens binary")
    return dealt.groupBy("bucket").applyInArrow(count, "batch binary, bucket int, codes binary")


def _prefixes(sets: DataFrame, gathered: DataFrame, bits: int, percent: int) -> DataFrame:
    """A row per document with a listed prefix token: set, size, p1, p2, p3 (arrays of tokens); ``gathered`` has each batch's codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sizes, tokens, parts in zip(*(batch.column(c) for c in ("sets", "sizes", "tokens", "parts"))):
                keys, sizes = keys.as_py(), sizes.as_py()
                order, t, _ = _by_bucket(tokens.as_buffer(), bits)
                in_order = np.frombuffer(b"".join(p["codes"].as_py() for p in parts), dtype=np.uint8)
                code, raw = np.empty(len(t), np.uint8), np.empty(len(t), np.uint64)
                code[order], raw[order] = in_order, t
                ends = np.cumsum([0, *sizes])
                out: list[tuple] = []
                for key, n, a, b in zip(keys, sizes, ends[:-1], ends[1:]):
                    if not n or not code[a:b].any():
                        continue
                    own, rank = raw[a:b], code[a:b]
                    shared = int((rank > 0).sum())
                    if shared * 100 < percent * n:
                        continue  # too few tokens occur elsewhere to be similar to any other set
                    lists = []
                    for seed in _SEEDS:
                        first = np.lexsort((mix(own ^ seed) if seed else own, rank))[: prefix_length(n, percent)]
                        lists.append(own[first[rank[first] > 0]].view(np.int64))
                    if all(map(len, lists)):
                        out.append((key, n, shared, own.view(np.int64), *lists))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())] + [list_of(np.concatenate([r[c] for r in out]), np.array([len(r[c]) for r in out]), pa.int64()) for c in (3, 4, 5, 6)],
                        names=["key", "size", "shared", "tokens", "p1", "p2", "p3"],
                    )

    joined = sets.join(gathered, "batch").select("sets", "sizes", "tokens", "parts")
    return map_batches(joined, run, "key binary, size long, shared long, tokens array<long>, p1 array<long>, p2 array<long>, p3 array<long>")


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether sizes and the tokens that can be common allow the similarity; ``a`` and ``b`` are suffixes of columns."""
    most = F.least(F.col(f"after{a}"), F.col(f"after{b}"))
    sizes = F.col(f"size{a}"), F.col(f"size{b}")
    return (most * 100 >= (sizes[0] + sizes[1] - most) * percent) & (F.least(*sizes) * 100 >= F.greatest(*sizes) * percent)


def _verify(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose prefixes meet under orders two and three and whose sets are similar."""
    side = lambda x, *columns: members.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    met = pairs.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b").where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b")
    whole = met.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - common
    return whole.where(common * 100 >= union * percent).select("a", "b")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between distinct sets that connect every two sets of the similarity, directly or over others."""
    total = sets.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / BUCKET_TOKENS)))))
    # The codes are written by themselves, so the shuffle of all tokens is gone before sets are grouped.
    per_batch = frequency_codes(sets, bits).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "codes"))).alias("parts"))
    codes = cut_bucketed(per_batch, shuffle_partitions(sets.sparkSession), "batch")
    found = _prefixes(sets, codes, bits, percent)
    # Copies have one set; the first of each is kept, so a group of copies has one row a token.
    members = cut(found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("size", "shared", "tokens", "p1", "p2", "p3")]))
    release(codes)
    # ``after``: tokens of the set from this one on that occur elsewhere. It bounds the overlap of a pair in its first common
    # list, where no earlier token is common; a pair may fail the bound in later lists, which lose nothing.
    rows = members.select("key", "size", (F.col("shared") / F.col("size")).alias("share"), "shared", F.posexplode("p1").alias("place", "token"))
    rows = rows.select("key", "size", "share", (F.col("shared") - F.col("place")).alias("after"), "token")
    lists = cut(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    open_rows = cut(rows.join(lists, "token").withColumn("root", F.col("key")))
    release(lists)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    best = F.max(F.struct("share", "key", "size", "after", "root")).alias("pivot")
    found_links: DataFrame | None = None
    tried: DataFrame | None = None
    outside = open_rows
    for _ in range(ROUNDS):
        pivots = cut(outside.groupBy("token").agg(best).select("token", *[F.col(f"pivot.{c}").alias(f"{c}2") for c in ("key", "size", "after", "root")]))
        pairs = open_rows.join(pivots, "token").where((F.col("root") != F.col("root2")) & _fits("", "2", percent)).select(*ordered("key", "key2")).distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = cut(_verify(pairs, members, percent))
        found_links = fresh if found_links is None else found_links.unionByName(fresh)
        roots = components(found_links)
        labelled = open_rows.drop("root").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
        labelled = cut(labelled)
        before = open_rows
        mixed = cut(labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token"))
        open_rows = cut(labelled.join(mixed, "token", "left_semi"))
        release(before, labelled, mixed)
        if not open_rows.limit(1).count():
            return found_links
        # The next pivot comes from outside the component that the last one is in by now.
        seats = cut(pivots.select(F.col("token").alias("t2"), F.col("key2").alias("k2")).join(open_rows, (F.col("t2") == F.col("token")) & (F.col("k2") == F.col("key"))).select("token", F.col("root").alias("seat")))
        release(pivots)
        outside = open_rows.join(seats, "token").where(F.col("root") != F.col("seat"))
    short = open_rows.where(F.col("n") <= LONG_LIST).withColumn("second", F.lit(0).cast("long"))
    long = open_rows.where(F.col("n") > LONG_LIST).join(members.select("key", "p2"), "key").withColumn("second", F.explode("p2"))
    spread = cut(short.unionByName(long.drop("p2")))
    release(open_rows)
    # Again only lists of several components go on; pairs are formed across components.
    still = cut(spread.groupBy("token", "second").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token", "second"))
    left = cut(spread.join(still, ["token", "second"], "left_semi").select("token", "second", "key", "size", "after", "root"))
    release(spread, still)
    right = left.select("token", "second", *[F.col(c).alias(f"{c}2") for c in ("key", "size", "after", "root")])
    across = left.join(right, ["token", "second"]).where((F.col("key") < F.col("key2")) & (F.col("root") != F.col("root2")) & _fits("", "2", percent))
    last = across.select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return found_links.unionByName(_verify(last, members, percent))


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    sets = cut_bucketed(_sets(docs, k), shuffle_partitions(spark), "batch")
    found = cut(links(sets, percent))
    roots = components(found)
    release(found)
    per_doc = sets.select(F.explode(F.arrays_zip("doc_ids", "sets", "sizes")).alias("d")).select(F.col("d.doc_ids").alias("doc_id"), F.col("d.sets").alias("key"), F.col("d.sizes").alias("n_shingles"))
    least = per_doc.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = cut(least.join(roots, least["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    ids = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(classes.join(ids, "root").select(F.col("key").alias("key2"), "component_id"))
    release(classes, ids)
    out = per_doc.join(named, (per_doc["key"] == named["key2"]) & (per_doc["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5(spark, sf_dir: str) -> DataFrame:
    return similarity_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)
