"""A document pipeline of five stages, each written as Parquet and read again by the next.

toxicity drops documents scored at or over the threshold; the n-gram Jaccard join keeps the
document of each component whose doc_id is least (one of the rows, where that doc_id and text are repeated);
personal data are replaced in place; the mix takes words by source; the last stage packs the
mixed texts into sequences. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read_table, recorded, release, text_of, unfolded, whole_row
from loomgraph.llm.jaccard_join import similarity_components
from loomgraph.llm.mixing import mixed_texts
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.pii import redact
from loomgraph.llm.toxicity import fit, keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic, each row judged by its text."""
    # Other stages' workers stay beside this one's, so its batches are smaller than where it stands alone.
    return keep_clean(docs, fit(docs, read_table(spark, sf_dir, "labels"), batch_words=3 << 17))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), that of the least doc_id.

    Of repeated rows with one doc_id and text one stays; of one doc_id on texts that are alike, one text. Rows without a doc_id are told apart by
    their text and come after those with one (doc_ids below 2**62 are taken for granted).
    """
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64(text_of()), F.lit(1 << 61))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), text_of().alias("text"), whole_row(docs).alias("row"))
    # A doc_id that stands on several texts gives each a key of its own, above those of rows without a doc_id; all others are their doc_id.
    text_hash = F.xxhash64("text")
    shared = cut(rows.groupBy("doc_id").agg(F.min(text_hash).alias("low"), F.max(text_hash).alias("high")).where("low <> high").select(F.col("doc_id").alias("shared_id")))
    own_key = F.lit((1 << 62) + (1 << 61)) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    rows = rows.join(shared, F.col("doc_id") == F.col("shared_id"), "left").withColumn("row_key", F.when(F.col("shared_id").isNull(), F.col("doc_id")).otherwise(own_key))
    classes = similarity_components(rows.select(F.col("row_key").alias("doc_id"), "text"), k=5, percent=80)
    named = rows.where("shared_id is not null").select(F.col("row_key").alias("doc_id"), F.col("shared_id").alias("named_id")).distinct()
    ordered = F.struct(F.coalesce("named_id", "doc_id"), F.col("doc_id").alias("row_key"))
    first = classes.join(named, "doc_id", "left").groupBy("component_id").agg(F.min(ordered).alias("first")).select("first.row_key")
    # Rows travel once, without their texts beside them: repeated ones have one key, so they meet where the key is joined.
    kept = rows.select("row_key", F.md5(F.col("text").cast("binary")).alias("same_text"), "row").join(first, "row_key", "left_semi")
    return unfolded(kept.groupBy("row_key", "same_text").agg(F.first("row").alias("row")), "row", docs.columns, {})


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers outlive the stage, so the encoder keeps fewer words than where packing stands alone, and goes with its task.
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, cache_words=200_000, keep_encoder=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage's result is read from; it is written before the next stage starts, and they go then.
_left: dict[str, list[DataFrame]] = {}


def _tidy(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _left.pop(app, [])
        if left:
            still_read = docs.inputFiles()  # of a caller who did not write the result in between
            release(*[t for t in left if not any(t._loomgraph_cut[0].split("://")[-1].lstrip("/") in f for f in still_read)])  # type: ignore[attr-defined]
        with recorded() as tables:
            out = stage(spark, docs, sf_dir)
        _left[app] = tables
        return out

    return run_stage


STAGES = [(name, _tidy(stage)) for name, stage in (("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("PII", redact_pii), ("source mixing", mix_sources), ("best-fit packing", pack))]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    release(*_left.pop(spark.sparkContext.applicationId, []))
    return docs
