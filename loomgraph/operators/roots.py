"""Which symbols and files orient a reader: bands, ranks, a file universe, diversification, the snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.graph import CALLABLES, display_name, import_like, indexable, node_rank
from loomgraph.functions.paths import file_role, helper_like, path_rank, role_rank, subsystem_key
from loomgraph.operators.grounding import degree_tier
from loomgraph.operators.relational import call_degrees, file_snapshot, member_counts, root_symbols
from loomgraph.sources.star_schema import Graph

LAST_LINE = 2147483647
#: Folders of tooling, and the sizes of a snapshot by budget as (roots, files).
TOOLING = ("scripts", "tools", "tooling", "ci", ".github", "xtask")
BUDGETS = {"strict": (8, 12), "balanced": (16, 24), "max": (40, 60)}


def _evidence() -> Column:
    own = F.coalesce(F.col("role").isin("source", "entrypoint"), F.lit(False)) & F.col("kind").isin(*CALLABLES) & ~import_like(F.col("serialized_name"))
    return F.when(own & (F.col("callers") == 0) & (F.col("callees") >= 2), 2).when(own & F.element_at(F.split("serialized_name", "::|\\."), -1).eqNullSafe("main"), 1).otherwise(0)


def architecture_band(role: Column, path: Column, rank: Column, evidence: Column) -> Column:
    """0 proven entries, 1 to 3 production by its place, 4 the rest, 5 what is named like an import."""
    tooling = F.arrays_overlap(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), F.array(*[F.lit(t) for t in TOOLING]))
    place = F.when(tooling, 3).when(rank <= 1, 1).when(rank == 2, 2).otherwise(3)
    return F.when(import_like(F.col("serialized_name")), 5).when((role == "entrypoint") & (evidence > 0), 0).when(role.isin("source", "entrypoint"), place).otherwise(4)


def root_keys(g: Graph) -> DataFrame:
    """Every root symbol with the keys that sort roots, in their order, and its file's path, role and subsystem."""
    f = g.file.select(F.col("id").alias("file_id"), "path", "language", file_role().alias("role"))
    r = root_symbols(g).where(indexable()).join(f, "file_id", "left").join(call_degrees(g), "id", "left").join(member_counts(g), "id", "left").na.fill(0, ["callers", "callees", "members"])
    role, path = F.col("role"), F.col("path")
    r = r.withColumn("entry", _evidence()).withColumn("place", path_rank(role, path))
    return r.select(
        "id", "kind", display_name().alias("name"), "path", "role", subsystem_key(F.coalesce("language", F.lit("unknown")), path).alias("subsystem"), architecture_band(role, path, F.col("place"), F.col("entry")).alias("band"), "entry",
        F.coalesce(role_rank(role), F.lit(1)).alias("role_rank"), helper_like(display_name(), path).alias("helper"), degree_tier(F.col("callers")).alias("in_tier"), degree_tier(F.col("callees")).alias("out_tier"), "members", "place",
        node_rank().alias("rank"), F.coalesce("start_line", F.lit(LAST_LINE)).alias("line"),
    )


ROOT_ORDER = ["band", "-entry", "role_rank", "helper", "-in_tier", "-out_tier", "-members", "place", "rank", "line", "path", "name", "id"]


def root_order() -> list[Column]:
    return [F.desc(k[1:]) if k.startswith("-") else F.asc_nulls_first(k) for k in ROOT_ORDER]


def sorted_roots(g: Graph, limit: int) -> DataFrame:
    return root_keys(g).orderBy(*root_order()).limit(limit)


def diversified(items: list[dict], pinned: str = "pinned", surface: str = "subsystem", name: str = "name") -> list[dict]:
    """A permutation of a short sorted list: pinned ones, then those of a new surface and name, then of a new name, then the rest."""
    surfaces = {x[surface] for x in items if x[pinned]}
    names = {x[name] for x in items if x[pinned]}
    groups: list[list[dict]] = [[x for x in items if x[pinned]], [], [], []]
    waiting = []
    for x in items:
        if x[pinned]:
            continue
        if x[surface] in surfaces or x[name] in names:
            waiting.append(x)
            continue
        surfaces.add(x[surface])
        names.add(x[name])
        groups[1].append(x)
    for x in waiting:
        groups[3 if x[name] in names else 2].append(x)
        names.add(x[name])
    return [x for own in groups for x in own]


def diversified_roots(roots: DataFrame, limit: int = 300) -> DataFrame:
    """``roots`` in their order, at most ``limit`` of them, diversified; ``position`` counts from 0. The list is short by its limit, one task orders it."""
    shape = "id long, name string, subsystem string, band int, position int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.to_dict("records")]
        rows = diversified([r | {"pinned": r["band"] == 0} for r in sorted(rows, key=lambda r: r["ord"])])
        yield pd.DataFrame([(r["id"], r["name"], r["subsystem"], r["band"], i) for i, r in enumerate(rows)], columns=["id", "name", "subsystem", "band", "position"])

    top = roots.orderBy(*root_order()).limit(limit)
    numbered = top.withColumn("ord", F.row_number().over(Window.orderBy(*root_order()))).select("id", "name", "subsystem", F.col("band").cast("int").alias("band"), "ord")
    return numbered.coalesce(1).mapInPandas(run, shape)


def file_universe(g: Graph, entries: int = 24, quota: int = 2, others: int = 24) -> DataFrame:
    """(file_id, path, why): entry files by depth and path, and of each subsystem at most ``quota`` files, in turns."""
    f = file_snapshot(g).join(g.file.select(F.col("id").alias("file_id"), "language"), "file_id").withColumn("subsystem", subsystem_key(F.col("language"), F.col("path")))
    depth = F.size(F.split("path", "/"))
    first = f.where("role = 'entrypoint'").orderBy(depth, "path", "file_id").limit(entries).select("file_id", "path", F.lit("entry").alias("why"))
    slot = F.row_number().over(Window.partitionBy("subsystem").orderBy("best_rank", F.desc("symbol_count"), "path"))
    rest = f.withColumn("slot", slot).where(F.col("slot") <= quota).join(first.select("file_id"), "file_id", "left_anti").orderBy("slot", "subsystem").limit(others)
    return first.unionByName(rest.select("file_id", "path", F.lit("subsystem").alias("why")))


def unique_records(records: DataFrame) -> DataFrame:
    """One of each (kind, name, path), the first in the order of roots."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "name", "path").orderBy(*root_order()))).where("_n = 1").drop("_n")


def orientation_confidence(roots: DataFrame) -> DataFrame:
    """(confidence, entries, production): strong with proven entries, partial with production roots, weak otherwise."""
    c = roots.agg(F.sum((F.col("entry") > 0).cast("long")).alias("entries"), F.sum((F.col("band") <= 2).cast("long")).alias("production")).na.fill(0)
    return c.select(F.when(F.col("entries") > 0, "strong").when(F.col("production") > 0, "partial").otherwise("weak").alias("confidence"), "entries", "production")


def snapshot(g: Graph, budget: str = "balanced") -> DataFrame:
    """(section, position, name, path): a budget's roots and files, the first of one order for every budget."""
    roots, files = BUDGETS[budget]
    keys = unique_records(root_keys(g))
    top = keys.orderBy(*root_order()).limit(roots)
    r = top.select(F.lit("root").alias("section"), F.row_number().over(Window.orderBy(*root_order())).alias("position"), "name", "path")
    f = file_snapshot(g).orderBy("best_rank", F.desc("symbol_count"), "path").limit(files)
    f = f.select(F.lit("file").alias("section"), F.row_number().over(Window.orderBy("best_rank", F.desc("symbol_count"), "path")).alias("position"), F.lit(None).cast("string").alias("name"), "path")
    return r.unionByName(f)
