"""Projections, joins, aggregations, ranks and reports over node and edge frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.graph import CALLABLES, display_name, edge_weight, effective, entry_like, ignored_resolution, indexable, node_rank
from loomgraph.functions.paths import file_role
from loomgraph.sources.star_schema import Graph


def neutralised(edges: DataFrame) -> DataFrame:
    """Edges with ``src`` and ``dst``; a call resolved too unsurely loses its resolution first.

    A stored graph knows which calls those are (``ignored``); what changes resolutions drops that column.
    """
    e = edges
    if "ignored" not in e.columns:
        e = e if "target_name" in e.columns else e.withColumn("target_name", F.lit(None).cast("string"))
        e = e.withColumn("ignored", ignored_resolution())
    e = e.withColumns({c: F.when(~F.col("ignored"), F.col(c)) for c in ("resolved_target", "confidence", "certainty")}).drop("ignored")
    return e.withColumns({"src": effective("source"), "dst": effective("target")})


def unmarked(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c != "ignored"]


def degree_map(edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming) over effective endpoints; a self edge counts on both sides."""
    ends = neutralised(edges).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("outgoing"), F.sum(1 - F.col("e.o")).alias("incoming"))


def _with_degrees(g: Graph) -> DataFrame:
    d = g.node.where("kind <> 'FILE'").join(degree_map(g.edge), "id")
    return d.select("id", "kind", display_name().alias("name"), "outgoing", "incoming", (F.col("outgoing") + F.col("incoming")).alias("total"))


def hotspots(g: Graph, limit: int = 50) -> DataFrame:
    return _with_degrees(g).orderBy(F.desc("total"), F.desc("outgoing"), "name", "id").limit(limit)


def entry_points(g: Graph, limit: int = 50) -> DataFrame:
    """Nodes that lead out and are led to by nothing, or are named like an entry; callable hotspots where there is none."""
    d = _with_degrees(g)
    found = d.where((F.col("outgoing") > 0) & ((F.col("incoming") == 0) | entry_like(F.col("name")))).orderBy(F.desc("outgoing"), "incoming", "name", "id").limit(limit)
    if not found.isEmpty():
        return found
    return d.where(F.col("kind").isin(*CALLABLES)).orderBy(F.desc("total"), F.desc("outgoing"), "name", "id").limit(limit)


def bridges(g: Graph, limit: int = 50) -> DataFrame:
    d = _with_degrees(g).where("incoming > 0 and outgoing > 0").withColumn("narrow", F.least("incoming", "outgoing"))
    return d.orderBy(F.desc("narrow"), F.desc("total"), "name", "id").limit(limit)


def children(g: Graph, parent: int) -> DataFrame:
    e = g.edge.where((F.col("kind") == "MEMBER") & (F.col("source") == parent)).select(F.col("target").alias("id"))
    return g.node.join(e, "id").select("id", "kind", "serialized_name")


def child_presence(g: Graph, nodes: DataFrame) -> DataFrame:
    """Those of ``nodes`` (id) that have a child."""
    parents = g.edge.where("kind = 'MEMBER'").select(F.col("source").alias("id"))
    return nodes.select("id").distinct().join(parents, "id", "left_semi")


def root_symbols(g: Graph) -> DataFrame:
    members = g.edge.where("kind = 'MEMBER'").select(F.col("target").alias("id"))
    return g.node.where("kind <> 'FILE'").join(members, "id", "left_anti")


def root_candidates(g: Graph, limit: int, offset: int = 0) -> DataFrame:
    r = root_symbols(g).where(indexable()).select("id", "kind", display_name().alias("name"), "start_line", node_rank().alias("rank"))
    return r.orderBy("rank", F.coalesce("start_line", F.lit(2147483647)), "name", "id").offset(offset).limit(limit)


def member_counts(g: Graph) -> DataFrame:
    return g.edge.where("kind = 'MEMBER'").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("members"))


def neighborhood(g: Graph, centre: int) -> DataFrame:
    """Edges at the centre in either direction, by effective endpoints."""
    e = neutralised(g.edge).where((F.col("src") == centre) | (F.col("dst") == centre))
    return e.select("id", "kind", "src", "dst")


def direct_references(g: Graph, target: int, kinds: list[str]) -> DataFrame:
    e = neutralised(g.edge).where((F.col("dst") == target) & (F.col("src") != F.col("dst")) & F.col("kind").isin(kinds))
    return e.select("id", "kind", "src")


def edge_digest(g: Graph) -> DataFrame:
    """(id, kind, n): edges at each node by kind, a self edge once."""
    e = neutralised(g.edge).select("kind", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    return e.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))


def edge_digest_strings(g: Graph, most: int = 3) -> DataFrame:
    """(id, digest): each node's ``most`` commonest edge kinds as ``KIND=n``, count descending, then kind."""
    by = Window.partitionBy("id").orderBy(F.desc("n"), "kind")
    top = edge_digest(g).withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat_ws("=", "kind", F.col("n").cast("string")).alias("text"))))
    return top.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), ", ").alias("digest"))


def nodes_by_kinds(g: Graph, kinds: list[str], after: int, limit: int) -> DataFrame:
    """A page of nodes of some kinds: the ``limit`` least ids above ``after``."""
    page = g.node.where(F.col("kind").isin(kinds) & (F.col("id") > after))
    return page.select("id", "kind", "serialized_name").orderBy("id").limit(limit)


#: Targets that are resolved elsewhere, by the start of their canonical id.
SPECIAL = ("tauri:command:", "openapi:endpoint:", "route_endpoint:", "payload:collection:")


def edge_worklist(g: Graph, kind: str = "CALL", special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """Edges of a kind still to resolve, by id; a call also needs neither confidence nor certainty. Special targets are left out."""
    e = g.edge.where((F.col("kind") == kind) & F.col("resolved_target").isNull())
    if kind == "CALL":
        e = e.where("confidence is null and certainty is null")
    starts = F.lit(False)
    for s in special:
        starts = starts | F.col("canonical_id").startswith(s)
    apart = g.node.where(starts).select(F.col("id").alias("target"))
    return e.join(apart, "target", "left_anti").select("id", "source", "target").orderBy("id")


def symbol_references(g: Graph, most: int = 32) -> DataFrame:
    """(dst, id, src): at most ``most`` incoming references a symbol, membership apart, by edge id."""
    e = neutralised(g.edge).where("kind not in ('MEMBER', 'UNKNOWN')").select("dst", "id", "src")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("id"))).where(F.col("place") <= most).drop("place")


def typed_adjacency(g: Graph, most: int = 32) -> DataFrame:
    """(node_id, neighbour, direction, kind, ordinal): at most ``most`` references a symbol, told at both ends, in edge order."""
    known = g.node.select("id")
    e = neutralised(g.edge).where("kind not in ('MEMBER', 'UNKNOWN')").select("dst", "id", "src", "kind")
    e = e.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    refs = e.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("id"))).where(F.col("place") <= most)
    both = refs.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbour"), F.lit("incoming").alias("direction"), "kind", "id").unionByName(refs.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour"), F.lit("outgoing").alias("direction"), "kind", "id"))
    return both.withColumn("ordinal", F.row_number().over(Window.partitionBy("node_id").orderBy("id", "direction"))).drop("id")


def incoming_weight(g: Graph) -> DataFrame:
    """(id, weight): the summed kind weights of the edges that lead to each node."""
    e = neutralised(g.edge).select(F.col("dst").alias("id"), edge_weight().alias("w")).where("w > 0")
    return e.groupBy("id").agg(F.round(F.sum(F.col("w").cast("decimal(10,2)")).cast("double"), 2).alias("weight"))


def call_degrees(g: Graph) -> DataFrame:
    """(id, callers, callees): distinct partners by certain calls; callers in test files do not count."""
    tests = g.file.where(file_role().isin("test", "benchmark")).select(F.col("id").alias("file_id"))
    in_tests = g.node.join(F.broadcast(tests) if _small(tests) else tests, "file_id", "left_semi").select(F.col("id").alias("src"), F.lit(True).alias("test"))
    e = neutralised(g.edge).where("kind = 'CALL' and confidence >= 0.85 and src <> dst").select("src", "dst").distinct().join(in_tests, "src", "left")
    both = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("c"), F.lit(1).alias("e")), F.struct(F.col("dst").alias("id"), F.when(F.col("test"), 0).otherwise(1).alias("c"), F.lit(0).alias("e")))).alias("x"))
    return both.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.c").alias("callers"), F.sum("x.e").alias("callees"))


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def file_snapshot(g: Graph) -> DataFrame:
    """(file_id, path, role, symbol_count, best_rank) for every file and every FILE node without one, 255 where it has no symbol."""
    own = g.node.where(indexable()).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min(node_rank()).alias("r"))
    f = g.file.select(F.col("id").alias("file_id"), "path")
    lost = g.node.where("kind = 'FILE'").select(F.col("id").alias("file_id"), F.col("serialized_name").alias("path")).join(f, "file_id", "left_anti")
    both = f.unionByName(lost).withColumn("role", file_role())
    return both.join(own, "file_id", "left").select("file_id", "path", "role", F.coalesce("n", F.lit(0)).alias("symbol_count"), F.coalesce("r", F.lit(255)).alias("best_rank"))


def ranked_files(g: Graph, limit: int = 20) -> DataFrame:
    return file_snapshot(g).orderBy("best_rank", F.desc("symbol_count"), "path").limit(limit)


def top_symbols(g: Graph, n: int) -> DataFrame:
    """(file_id, id, row_num) of each file's first ``n`` symbols by rank, line and name."""
    by = Window.partitionBy("file_id").orderBy("rank", F.coalesce("start_line", F.lit(2147483647)), "name", "id")
    s = g.node.where(indexable()).select("file_id", "id", "start_line", node_rank().alias("rank"), display_name().alias("name"))
    return s.withColumn("row_num", F.row_number().over(by)).where(F.col("row_num") <= n).select("file_id", "id", "rank", "row_num")


def histogram(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("what"), "label", "n")


def coverage_buckets(g: Graph, most: int = 8) -> DataFrame:
    """Omitted files by first path segment; the largest stay, the rest fold into ``other``."""
    omitted = file_snapshot(g).join(g.file.where("not indexed").select(F.col("id").alias("file_id")), "file_id")
    label = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("(root)")
    b = omitted.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("files"), F.sum("symbol_count").alias("symbols"))
    ranked = b.withColumn("r", F.row_number().over(Window.orderBy(F.desc("files"), F.desc("symbols"), "label")))
    return ranked.groupBy(F.when(F.col("r") < most, F.col("label")).otherwise("other").alias("label")).agg(F.sum("files").alias("files"), F.sum("symbols").alias("symbols"))


def global_unique(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``names`` (name) resolved to a node where exactly one has that name; ambiguity gives no row."""
    only = nodes.groupBy(F.col("serialized_name").alias("name")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("node_id")).where("c = 1").drop("c")
    return names.join(only, "name")


def nodes_at_line(g: Graph, path: str, line: int) -> DataFrame:
    """Nodes with an occurrence in the file whose lines hold ``line``; one row for each occurrence."""
    f = g.file.where(F.col("path") == path).select(F.col("id").alias("file_id"))
    o = g.occurrence.where(F.lit(line).between(F.col("line"), F.col("end_line"))).join(f, "file_id", "left_semi").select(F.col("element_id").alias("id"))
    return g.node.join(o, "id").select("id", "kind", "serialized_name")
