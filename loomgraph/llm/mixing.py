"""Mixing of sources to target weights, over fixed-length blocks.

The words of a source, in the order of (bucket, doc_id), form one stream cut into blocks of
``BLOCK`` words, or of 1/``FEWEST`` of the source where that is less. A source's target gives the
number of blocks it wants. Output shards have ``SLOTS_A_SHARD`` slots each; how many of a shard's
slots a source gets is a multinomial draw by the wanted numbers, conditioned on all sources getting
exactly what they want over all shards: every wanted block of every source goes to the slot that a
pseudorandom permutation of all slots gives it. An unconditioned draw would miss the target of a
source that wants n blocks by about sqrt(n), a third of it at n = 8. A source's wanted blocks are
mapped through a pseudorandom permutation of its block indices and joined with the blocks by index.
A second pass over the blocks starts only when all were taken once, and at most two passes are made,
so no document is taken more than twice. The permutations are swap-or-not networks, which work for
any number of blocks.

Targets: sources ranked by code point (null last) weigh 5, 2, 1, 5, 2, 1, ... and share 150 % of
all words; a source stops at twice its own words and the excess is reshared by weight.

Everything is DataFrame functions in 64-bit integer arithmetic; a rerun gives the same rows.
Defined results: null or empty texts have size 0 and take nothing; repeated rows are documents of
their own; rows without doc_id are dealt by their text and come first in their bucket; an empty
table gives an empty result; other columns of the input are ignored, ``mixed_texts`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, cut, read_table, shuffle_partitions, text_of, unfolded, whole_row

BLOCK, FEWEST, SLOTS_A_SHARD, ROUNDS = 128, 64, 1024, 12
MODULUS = 2_147_483_647
BUCKETS, ROWS_A_BUCKET = 256, 100_000
WEIGHTS = (5, 2, 1)
PASSES = 2
#: Wanted blocks that one row holds before they are told apart.
CHUNK = 1 << 14


def _salt(salt: Column | int) -> Column:
    salt = salt if isinstance(salt, Column) else F.lit(salt).cast("long")
    return (salt % MODULUS * F.lit(69_621) + F.lit(12_345)) % MODULUS


def _salted(value: Column, salt: Column) -> Column:
    """A pseudorandom number below MODULUS from two steps of 31-bit arithmetic, the same in any engine."""
    once = (value % MODULUS * F.lit(48_271) + salt) % MODULUS
    return (once.bitwiseXOR(F.shiftright(once, 15)) * F.lit(1_597_334_677) + F.lit(715_225_739)) % MODULUS


def round_keys(n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """What ``seed`` gives each round of a permutation of 0..n-1: a mirror point and a salt."""

    def one(r: Column) -> Column:
        at = seed % MODULUS + r * F.lit(7_919)
        point = (_salted(at, _salt(17)) * MODULUS + _salted(at, _salt(29))) % n
        return F.struct(point.alias("point"), _salt(seed % MODULUS + r * F.lit(104_729)).alias("salt"))

    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long")), one)


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """The image of ``index`` under the permutation of 0..n-1 of these round keys."""

    def step(x: Column, k: Column) -> Column:
        mirror = (k["point"] - x + n) % n
        return F.when(F.shiftright(_salted(F.greatest(x, mirror), k["salt"]), 11).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(keys, index.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150) -> DataFrame:
    """From (source, source_size) also rank (from 0), weight and target; the number of sources bounds the work."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    # A source is full at a water level of 2 * size / weight: those below the level are full, the rest share by weight.
    by_ratio = Window.orderBy(F.col("ratio"), F.col("rank"))
    upto, everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = ranked.withColumn("ratio", F.lit(PASSES) * F.col("source_size") / F.col("weight"))
    w = w.withColumns({"full": F.sum("source_size").over(upto) * PASSES, "all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "past": F.sum("weight").over(upto)})
    w = w.withColumn("rest", F.col("all_size") * share_percent / F.lit(100.0) - (F.col("full") - PASSES * F.col("source_size")))
    w = w.withColumn("open_weight", F.col("all_weight") - F.col("past") + F.col("weight"))
    w = w.withColumn("level", F.col("rest") / F.col("open_weight"))
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    w = w.withColumn("water", level)
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.floor(F.col("source_size") / FEWEST)))
    return w.select("source", "source_size", block.alias("block"), F.col("rank").cast("long").alias("rank"), "weight", F.least(F.col("source_size") * F.lit(float(PASSES)), F.coalesce(F.col("weight") * F.col("water"), F.col("source_size") * F.lit(float(PASSES)))).alias("target"))


def layout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with size, source rank and start in their source's stream; sources with sizes and targets."""
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_of()).alias("text_hash")))
    n = sized.count()
    buckets = max(BUCKETS, n // ROWS_A_BUCKET)
    salted = sized.withColumn("bucket", F.pmod(F.coalesce("doc_id", "text_hash"), F.lit(buckets)))
    per_bucket = salted.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = cut(targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(per_bucket.withColumn("base", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = salted.withColumn("shift", F.coalesce(F.sum("size").over(within), F.lit(0)))
    right = bases.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base")
    placed = placed.join(right, placed["source"].eqNullSafe(right["s2"]) & (placed["bucket"] == right["b2"]))
    placed = placed.select("doc_id", "source", "text_hash", "size", (F.col("base") + F.col("shift")).alias("start"))
    return placed, sources


def draw_slots(sources: DataFrame, slots_a_shard: int = SLOTS_A_SHARD) -> DataFrame:
    """The mix itself: (rank, shard, slot, pass, block_index), one row per block taken."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    s = sources.where(F.col("target") > 0).select("rank", "source_size", "target", "block", F.ceil(F.col("source_size") / F.col("block")).alias("blocks"))
    # Whole passes take every word; the rest is rounded to blocks.
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(PASSES))
    want = whole * F.col("blocks") + F.round((F.col("target") - whole * F.col("source_size")) / F.col("block")).cast("long")
    s = s.withColumn("want", F.greatest(F.lit(1), F.least(want, F.col("blocks") * PASSES)))
    s = s.withColumns({"all_want": F.sum("want").over(everything), "low": F.coalesce(F.sum("want").over(before), F.lit(0))})
    # Few rows become many here, so they are dealt to a set number of tasks that no adaptive step merges.
    s = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("want") - 1) / CHUNK)))).repartition(shuffle_partitions(s.sparkSession), "rank", "chunk")
    s = s.withColumn("slot_keys", round_keys(F.col("all_want"), F.lit(29).cast("long")))
    seed = F.col("rank") % MODULUS * F.lit(1_000_003) + 1
    s = s.withColumn("pass_keys", F.array(*[round_keys(F.col("blocks"), seed + p) for p in range(PASSES)]))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("want") - F.col("chunk") * CHUNK) - 1)))
    s = s.withColumn("n", F.col("chunk") * CHUNK + F.col("k")).withColumn("pass", F.floor(F.col("n") / F.col("blocks")))
    s = s.withColumn("place", permuted(F.col("low") + F.col("n"), F.col("all_want"), F.col("slot_keys")))
    block_index = permuted(F.col("n") % F.col("blocks"), F.col("blocks"), F.element_at("pass_keys", F.col("pass").cast("int") + 1))
    return s.select("rank", F.floor(F.col("place") / slots_a_shard).alias("shard"), (F.col("place") % slots_a_shard).alias("slot"), "pass", block_index.alias("block_index"))


def doc_blocks(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """(rank, block_index, start, lo, hi): words lo..hi-1 of the document at ``start`` are in that block."""
    d = placed.where(F.col("size") > 0)
    ranks = sources.select(F.col("source").alias("s2"), "rank", "block")
    d = d.join(F.broadcast(ranks), d["source"].eqNullSafe(ranks["s2"])) if _few(sources) else d.join(ranks, d["source"].eqNullSafe(ranks["s2"]))
    block = F.col("block")
    d = d.withColumn("block_index", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("block_index") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block_index") + 1) * block - F.col("start"), F.col("size"))
    return d.select("rank", "block_index", "start", lo.alias("lo"), hi.alias("hi"))


def _few(sources: DataFrame, most: int = 50_000) -> bool:
    """Whether the sources are few enough to broadcast."""
    return sources.limit(most + 1).count() <= most


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with place, sources, taken runs): a run is (rank, start, pass, shard, slot, lo, hi)."""
    placed, sources = layout(docs)
    placed = cut(placed)
    slots = draw_slots(sources)
    return placed, sources, slots.join(doc_blocks(placed, sources).hint("merge"), ["rank", "block_index"])


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken per document, and the output shards that its taken words are drawn for: how many, and the first."""
    placed, sources, runs = mix(docs)
    by_shard = runs.groupBy("rank", "start", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("words"))
    taken = by_shard.groupBy("rank", "start").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n_shards"), F.min("shard").alias("first_shard"))
    few = _few(sources)
    named = sources.select(F.col("source").alias("s2"), "source_size", "rank", "target")
    p = placed.join(F.broadcast(named) if few else named, placed["source"].eqNullSafe(named["s2"]))
    p = p.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    out = p.join(taken.withColumnRenamed("rank", "r2").withColumnRenamed("start", "key2"), (F.col("rank") == F.col("r2")) & (F.col("key") == F.col("key2")), "left")
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"), F.coalesce("n_shards", F.lit(0).cast("long")).alias("n_shards"), "first_shard")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and pass, holding the words taken, in order.

    A document taken whole keeps its text as it is; of others the taken words are joined by one
    space. Columns are those of ``docs``. Rows lie by output shard, and in a shard by slot: each where the
    first slot drawn for its words puts it.
    """
    placed, sources, runs = mix(docs)
    ordered = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    per_pass = runs.groupBy("rank", "start", "pass").agg(ordered.alias("parts"), F.min(F.struct("shard", "slot")).alias("seat"))
    named = sources.select(F.col("source").alias("s2"), "rank")
    p = placed.where("size > 0").join(F.broadcast(named) if _few(sources) else named, placed["source"].eqNullSafe(named["s2"]))
    # Repeated rows of one document share a key; one of them meets the places of all.
    parts_of = lambda *c: F.md5(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("?")) for x in c]).cast("binary"))
    taken = p.join(per_pass, ["rank", "start"]).select(parts_of(F.col("doc_id"), F.col("source"), F.col("text_hash")).alias("key"), F.col("size").alias("words_in_all"), "parts", "seat")
    own = docs.select(parts_of(F.col("doc_id").cast("long"), F.col("source"), F.xxhash64(text_of())).alias("key2"), whole_row(docs).alias("row"))
    one_each = own.groupBy("key2").agg(F.first("row").alias("row"))
    joined = one_each.join(taken, F.col("key2") == F.col("key")).select("row", "words_in_all", "parts", "seat")
    text = F.col("row").getField("text")
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"]) == F.col("words_in_all")
    cutouts = F.array_join(F.flatten(F.transform("parts", lambda x: F.slice("all_words", (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), " ")
    joined = joined.withColumn("whole", whole).withColumn("all_words", F.when(~F.col("whole"), F.regexp_extract_all(text, F.lit(f"({WORD})"))))
    mixed = joined.select("row", "seat", F.when(F.col("whole"), text).otherwise(cutouts).alias("mixed"))
    mixed = mixed.repartition(shuffle_partitions(docs.sparkSession), F.col("seat.shard")).sortWithinPartitions("seat")
    return unfolded(mixed, "row", docs.columns, {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")})


def op10(spark, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_shards", "first_shard")
