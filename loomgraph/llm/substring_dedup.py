"""Exact removal of repeated word windows by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it
has the same words as a window that starts anywhere else.

1. Distinct texts are named by a digest; copies of a text are counted, not compared: a text that
   occurs twice repeats all its windows.
2. Suffixes are dealt by prefixes of variable length. The first ones are ``PREFIX`` words, taken at
   anchors: the least prefix hash among the starts inside a window, which equal windows have at
   the same place. A prefix that occurs once in the corpus has no repeat and is dropped at once.
3. Prefixes that occur at most ``GROUP`` times go, with the words around, to groups that fit in
   memory, several prefixes a group. A group builds its suffix tree level by level: the words' ranks,
   then the ranks of runs of 2, 4, 8, ... words up to ``window``, compared as whole words. A node
   of that depth with two suffixes or more is a repeat; each member's starts are reported.
4. More frequent prefixes are lengthened to the whole window, so that a common line or phrase is
   split by what stands around it; such windows are counted by a 128-bit hash with partial sums,
   once for each distinct run of windows, and counts of two or more are joined back.

Defined results: null or empty texts have no words and an empty kept text; texts shorter than the
window keep all; repeated rows are repeats of each other; an empty table gives an empty result;
other columns are ignored. Words are compared as they stand, the kept ones are joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, cut_bucketed, map_batches, read_table, release, shuffle_partitions, text_of
from loomgraph.llm.tokens import grams, list_of, pieces, words

PREFIX, GROUP, GROUP_ROWS = 8, 1000, 4000


def anchors(prefix_hashes: np.ndarray, n_words: int, window: int, prefix: int = PREFIX) -> np.ndarray:
    """For each window start, the place of the least prefix hash (the first of equals) within the window."""
    starts, span = n_words - window + 1, window - prefix + 1
    # Running minima over blocks of the span, forward and backward: two looks give any window's minimum.
    n = len(prefix_hashes)
    # The place is in the low half of a pair comparison: equal hashes keep the first.
    order = np.empty(n, dtype=np.int64)
    order[np.lexsort((np.arange(n), prefix_hashes))] = np.arange(n)
    padded = np.full(-(-n // span) * span, n, dtype=np.int64)
    padded[:n] = order
    blocks = padded.reshape(-1, span)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(backward[:starts], forward[span - 1 : span - 1 + starts])
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return place[low]


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """key, text, n_words, sha (of all words joined), pos and hash of anchors, for distinct texts with copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(1)):
                w = words(data, offsets)
                prefix = grams(w.hashes, PREFIX)
                counts = np.diff(w.first)
                pos, hashes = [], []
                for a, n in zip(w.first[:-1].tolist(), counts.tolist()):
                    own = prefix[a : a + max(0, n - PREFIX + 1)]
                    p = np.unique(anchors(own, n, window)) if n >= window else np.zeros(0, np.int64)
                    pos.append(p)
                    hashes.append(own[p])
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                lengths = np.array([len(p) for p in pos])
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(counts, pa.int64()), pa.array(sha), list_of(np.concatenate(pos), lengths, pa.int32()), list_of(np.concatenate(hashes).view(np.int64), lengths, pa.int64())],
                    names=["key", "text", "copies", "n_words", "sha", "pos", "hash"],
                )

    keyed = docs.select(F.unhex(F.md5(text_of().cast("binary"))).alias("key"), text_of().alias("text"))
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return map_batches(distinct.select("key", "text", "copies"), run, "key binary, text string, copies long, n_words long, sha string, pos array<int>, hash array<long>")


_SEGMENT = "prefix long, key binary, anchor int, first int, n int, words string, h1 array<long>, h2 array<long>"


def _segments(texts: DataFrame, window: int, most: int) -> DataFrame:
    """For each listed anchor the windows it is least in: words around it, or, for a frequent prefix, window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2)
            for at, _, data, offsets in pieces(batch.column(1)):
                w = words(data, offsets)
                prefix = grams(w.hashes, PREFIX)
                raw = data.tobytes()
                out: list[tuple] = []
                for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    key = batch.column(0)[at + k].as_py()
                    of_start = anchors(prefix[a : b - PREFIX + 1], b - a, window)
                    bounds = np.flatnonzero(np.diff(of_start, prepend=-1, append=-1))
                    runs = {int(of_start[x]): (int(x), int(y)) for x, y in zip(bounds[:-1], bounds[1:])}
                    h1 = h2 = None
                    for one in listed[at + k].as_py():
                        x, y = runs[one["pos"]]
                        if one["n"] <= most:
                            text = b" ".join(raw[w.starts[a + x] : w.ends[a + y + window - 2]].split()).decode()
                            out.append((one["hash"], key, one["pos"], x, y - x, text, None, None))
                            continue
                        if h1 is None:
                            h1, h2 = grams(w.hashes[a:b], window, 1).view(np.int64), grams(w.hashes[a:b], window, 2).view(np.int64)
                        out.append((one["hash"], key, one["pos"], x, y - x, None, h1[x:y].tolist(), h2[x:y].tolist()))
                if out:
                    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], type=t) for c, t in enumerate(kinds)], names=[x.split()[0] for x in _SEGMENT.split(", ")])

    return map_batches(texts, run, _SEGMENT)


def subtree_repeats(segments: list[str], counts: list[int], window: int) -> list[list[int]]:
    """For each segment the windows (0 for its first) whose words are also a window elsewhere in the group.

    Ranks of runs double in length level by level, as the nodes of a suffix tree at those depths;
    the last level joins two overlapping runs to the window's depth.
    """
    split = [s.split(" ") for s in segments]
    lengths = np.array([len(s) for s in split])
    first = np.cumsum([0, *lengths[:-1]])
    known: dict[str, int] = {}
    rank = np.array([known.setdefault(word, len(known)) for s in split for word in s], dtype=np.int64)
    depth = 1
    while depth * 2 <= window:
        rank = _joined(rank, depth)
        depth *= 2
    if depth < window:
        rank = _joined(rank, window - depth)
    starts = np.concatenate([np.arange(f, f + c) for f, c in zip(first, counts)])
    node = rank[starts]
    _, inverse, size = np.unique(node, return_inverse=True, return_counts=True)
    deep = size[inverse] > 1
    ends = np.cumsum([0, *counts])
    return [np.flatnonzero(deep[a:b]).tolist() for a, b in zip(ends[:-1], ends[1:])]


def _joined(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of two runs, the second ``shift`` words on; runs over the end of the group get ranks of no use."""
    later = np.zeros_like(rank)
    later[: len(rank) - shift] = rank[shift:] + 1
    return np.unique(rank * (int(later.max()) + 1) + later, return_inverse=True)[1]


def _trees(table: pa.Table, window: int) -> pa.Table:
    """One group: the trees of its prefixes."""
    rows = table.to_pydict()
    found = subtree_repeats(rows["words"], rows["n"], window)
    kept = [k for k, x in enumerate(found) if x]
    starts = [[rows["first"][k] + x for x in found[k]] for k in kept]
    return pa.table({"key": pa.array([rows["key"][k] for k in kept], pa.binary()), "starts": pa.array(starts, pa.list_(pa.int32()))})


def repeated_starts(scanned: DataFrame, window: int, most: int = GROUP) -> DataFrame:
    """(key, starts): the repeated windows' starts of each distinct text that occurs once."""
    spark = scanned.sparkSession
    prefixes = scanned.select(F.explode("hash").alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    prefixes = cut(prefixes)
    listed = scanned.select("key", F.explode(F.arrays_zip("pos", "hash")).alias("a")).select("key", F.col("a.pos").alias("pos"), F.col("a.hash").alias("prefix"))
    met = listed.join(prefixes, "prefix").groupBy("key").agg(F.collect_list(F.struct("pos", F.col("prefix").alias("hash"), "n")).alias("listed"))
    segments = cut(_segments(scanned.select("key", "text").join(met, "key").select("key", "text", "listed"), window, most))
    n = segments.where("words is not null").count()
    groups = max(shuffle_partitions(spark), n // GROUP_ROWS)
    small = segments.where("words is not null").select(F.pmod(F.xxhash64("prefix"), F.lit(groups)).alias("group"), "key", "first", "n", "words")
    by_tree = small.groupBy("group").applyInArrow(lambda t: _trees(t, window), "key binary, starts array<int>")
    by_hash = _lengthened(segments.where("words is null").select("key", "first", "n", "h1", "h2", F.xxhash64("h1").alias("r1"), F.xxhash64("h2").alias("r2")))
    return by_tree.unionByName(by_hash).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _lengthened(runs: DataFrame) -> DataFrame:
    """(key, starts) for frequent prefixes, lengthened to whole windows.

    A run is the windows of one anchor. Runs alike are first put together, with their number: all
    windows of a run that occurs twice repeat. Only distinct runs are taken apart into windows.
    """
    distinct = cut(runs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2")))
    windows = distinct.select("r1", "r2", "copies", F.posexplode(F.arrays_zip("h1", "h2")).alias("k", "h")).select("r1", "r2", "copies", "k", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    deep = cut(windows.groupBy("h1", "h2").agg(F.sum("copies").alias("total")).where("total > 1").select("h1", "h2"))
    some = windows.where("copies = 1").join(deep, ["h1", "h2"]).groupBy("r1", "r2").agg(F.collect_list("k").alias("at"))
    whole = distinct.where("copies > 1").select("r1", "r2", F.sequence(F.lit(0), F.col("n") - 1).alias("at"))
    hits = cut(some.unionByName(whole))
    met = runs.select("key", "first", "r1", "r2").join(hits, ["r1", "r2"])
    return met.select("key", F.transform("at", lambda k: F.col("first") + k).alias("starts"))


def _kept(texts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts_, starts = batch.column(0), batch.column(1), batch.column(2)
            removed, kept = [], []
            for text, own in zip(texts_, starts):
                parts = text.as_buffer().to_pybytes().split()
                change = np.zeros(len(parts) + 1, dtype=np.int32)
                at = np.unique(np.asarray(own.values, dtype=np.int64))
                change[at] += 1
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([p for p, g in zip(parts, gone.tolist()) if not g]).decode())
            yield pa.RecordBatch.from_arrays([keys, pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_removed", "kept"])

    return map_batches(texts, run, "key binary, n_removed long, kept string")


def dedup_texts(docs: DataFrame, window: int = 50, keep_text: bool = True, most: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): documents without repeated windows' words."""
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    scanned = cut_bucketed(_scan(docs, window), buckets, "key")
    single = scanned.where(F.col("copies") == 1)
    # Texts that occur more than once serve as places to repeat, yet all their own windows are repeats.
    starts = cut(repeated_starts(scanned.where(F.col("n_words") >= window), window, most))
    changed = _kept(single.select("key", "text").join(starts, "key").select("key", "text", "starts"), window)
    if not keep_text:
        changed = changed.select("key", "n_removed", F.sha2(F.col("kept"), 256).alias("new_sha"))
    changed = cut(changed)
    release(starts)
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    merged = scanned.select("key", "copies", "n_words", "sha", *(["text"] if keep_text else [])).join(changed, "key", "left")
    none = F.sha2(F.lit(""), 256)
    removed = F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    columns = [F.col("key").alias("key2"), "n_words", removed.alias("n_removed")]
    if keep_text:
        plain = F.array_join(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")), " ")
        kept = F.when(all_gone, F.lit("")).otherwise(F.coalesce("kept", plain))
        columns += [F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept")]
    else:
        columns += [F.when(all_gone, none).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256")]
    by_text = merged.select(*columns)
    if not keep_text:
        written, by_text = changed, cut(by_text)
        release(written, scanned)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text_of().cast("binary"))).alias("key"))
    return ids.join(by_text, ids["key"] == by_text["key2"]).drop("key", "key2")


def op8(spark, sf_dir: str) -> DataFrame:
    return dedup_texts(read_table(spark, sf_dir, "documents"), window=35, keep_text=False)
