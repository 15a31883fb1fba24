"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, a permutation given by an
offset and a skip. Shards take turns claiming their next free slot until the table is full, a
shard of weight w having w turns a round. A row's key is hashed to a slot; the broadcast table
gives its shard in constant time. Removing a shard moves few rows beside its own.

The table depends on the parameters alone, never on the data, so its size bounds the broadcast.
The slot is the first 60 bits of an MD5 of the key's text, modulo the table's size, so that any engine can place a row.
Defined results: rows with a null key go by the hash of an empty text and share a slot; repeated rows go
to the same shard; an empty table stays empty; input columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import read_table

SLOTS = 65_537  # a prime
SHARDS = 128


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot; ``shards`` gives names and whole weights."""
    if not is_prime(slots) or not shards or min(shards.values()) < 1 or sum(shards.values()) > slots:
        raise ValueError("slots must be a prime not below the sum of weights, all at least 1")
    order = sorted(shards)
    nexts = {name: preference(name, slots) for name in order}
    at = {name: nexts[name][0] for name in order}
    table: list[str | None] = [None] * slots
    filled = 0
    while True:
        for name in order:
            for _ in range(shards[name]):
                slot = at[name]
                while table[slot] is not None:
                    slot = (slot + nexts[name][1]) % slots
                table[slot] = name
                at[name] = (slot + nexts[name][1]) % slots
                filled += 1
                if filled == slots:
                    return table  # type: ignore[return-value]


def place(rows: DataFrame, keys: list[str], shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``."""
    table = rows.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard string")
    clean = rows.drop("slot", "shard")
    # Each key is marked with a sign that a null has not, so null and empty differ.
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{k}`").cast("string")), F.lit("")) for k in keys])
    placed = clean.withColumn("slot", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots)
    return placed.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in clean.columns], "slot", "shard")


def shard_names(n: int = SHARDS) -> dict[str, int]:
    return {f"shard-{i:05d}": 1 for i in range(n)}


def op2(spark, sf_dir: str) -> DataFrame:
    """Shard of each document by its id, with the bytes it brings to that shard."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(docs, ["doc_id"], shard_names())


def oracle() -> str:
    """The SQL of ``op2``, the table written out as shard numbers."""
    numbers = ",".join(str(int(name.rpartition("-")[2])) for name in lookup_table(shard_names()))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce('=' || doc_id, '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents),
t AS (SELECT [{numbers}] AS numbers)
SELECT doc_id, n_bytes, slot, 'shard-' || lpad(CAST(numbers[slot + 1] AS VARCHAR), 5, '0') AS shard FROM d, t
"""
