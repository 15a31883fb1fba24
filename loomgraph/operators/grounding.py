"""Counts, neighbourhoods and evidence that orient a reader in a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.graph import CALLABLES, display_certainty, display_name, import_like, indexable, node_rank
from loomgraph.functions.paths import file_role
from loomgraph.operators.relational import degree_map, neutralised
from loomgraph.operators.traverse import impact
from loomgraph.sources.star_schema import Graph

_LAST_LINE = 2147483647


def store_counts(g: Graph) -> DataFrame:
    """(what, n) for nodes, edges, files, errors and fatal errors; nothing but five numbers leaves the scans."""
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    parts = [count(g.node, "node"), count(g.edge, "edge"), count(g.file, "file")]
    if g.error is not None:
        parts += [count(g.error, "error"), count(g.error.where("fatal"), "fatal_error")]
    return reduce(DataFrame.unionByName, parts)


def effective_file_count(g: Graph) -> DataFrame:
    """(n): distinct ids of file rows and FILE nodes."""
    ids = g.file.select("id").unionByName(g.node.where("kind = 'FILE'").select("id"))
    return ids.distinct().agg(F.count(F.lit(1)).alias("n"))


def edges_for_nodes(g: Graph, nodes: DataFrame) -> DataFrame:
    """Edges with any raw or resolved endpoint in ``nodes`` (id), each once: a pass over the ends, not an OR join."""
    ends = g.edge.select("id", F.explode(F.array_distinct(F.array("source", "target", "resolved_source", "resolved_target"))).alias("end"))
    touched = ends.where("end is not null").join(nodes.select(F.col("id").alias("end")), "end", "left_semi").select("id").distinct()
    return g.edge.join(touched, "id", "left_semi").select("id", "kind", "source", "target")


def incoming_edges(g: Graph, node: int, kinds: list[str] | None = None) -> DataFrame:
    e = neutralised(g.edge).where(F.col("dst") == node)
    return (e.where(F.col("kind").isin(kinds)) if kinds else e).select("id", "kind", "src")


def first_occurrence(g: Graph) -> DataFrame:
    """(element_id, file_id, line) of each element's first occurrence in the order of insertion."""
    return g.occurrence.groupBy("element_id").agg(F.min(F.struct("seq", "file_id", "line")).alias("o")).select("element_id", "o.file_id", "o.line")


def top_root_symbols(g: Graph, n: int) -> DataFrame:
    """(file_id, id, row_num): those of each file's first ``n`` symbols that are nobody's members."""
    by = Window.partitionBy("file_id").orderBy("rank", F.coalesce("start_line", F.lit(_LAST_LINE)), "name", "id")
    s = g.node.where(indexable()).select("file_id", "id", "start_line", node_rank().alias("rank"), display_name().alias("name"))
    top = s.withColumn("row_num", F.row_number().over(by)).where(F.col("row_num") <= n)
    members = g.edge.where("kind = 'MEMBER'").select(F.col("target").alias("id"))
    return top.join(members, "id", "left_anti").select("file_id", "id", "row_num")


def degree_tier(n: Column) -> Column:
    """0 for none, 1 to 2, 3 to 8, 9 and more."""
    return F.when(n <= 0, 0).when(n <= 2, 1).when(n <= 8, 2).otherwise(3)


def entry_evidence(g: Graph) -> DataFrame:
    """(id, evidence, in_tier, out_tier) of callables: ``main``, ``topological_root`` in sources, else ``none``; what is named like an import has none."""
    d = g.node.where(F.col("kind").isin(*CALLABLES) & ~import_like(F.col("serialized_name"))).join(degree_map(g.edge), "id", "left").na.fill(0, ["incoming", "outgoing"])
    f = g.file.select(F.col("id").alias("file_id"), file_role().isin("source", "entrypoint").alias("production"))
    own = F.coalesce("production", F.lit(False))
    evidence = F.when(own & (F.col("serialized_name") == "main"), "main").when(own & (F.col("incoming") == 0) & (F.col("outgoing") >= 2), "topological_root").otherwise("none")
    return d.join(f, "file_id", "left").select("id", evidence.alias("evidence"), degree_tier(F.col("incoming")).alias("in_tier"), degree_tier(F.col("outgoing")).alias("out_tier"))


def balanced_neighbours(g: Graph, most: int = 8) -> DataFrame:
    """(id, other, kind, direction, edge_id): at most ``most`` neighbours a node, by edge id.

    The first certain call of each direction has a place, so a crowd of other edges cannot hide it.
    """
    e = neutralised(g.edge).where("src <> dst").select(F.col("id").alias("edge_id"), "kind", (display_certainty() == "certain").alias("sure"), "src", "dst")
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction")))
    both = e.select("edge_id", "kind", "sure", F.explode(ends).alias("x")).select("edge_id", "kind", "sure", "x.*")
    one = both.groupBy("id", "other", "kind", "direction").agg(F.min(F.struct("edge_id", "sure")).alias("f")).select("id", "other", "kind", "direction", "f.*")
    call = (F.col("kind") == "CALL") & F.coalesce("sure", F.lit(False))
    first = F.row_number().over(Window.partitionBy("id", "direction", call).orderBy("edge_id", "other", "kind"))
    marked = one.withColumn("reserved", (call & (first == 1)).cast("int"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("reserved"), "edge_id", "direction", "other", "kind"))
    return marked.withColumn("place", place).where(F.col("place") <= most).select("id", "other", "kind", "direction", "edge_id")


def affected(g: Graph, changed: DataFrame, depth: int) -> DataFrame:
    """(id, name, path, distance, test) of what a change of ``changed`` (id) may reach; files themselves apart."""
    f = g.file.select(F.col("id").alias("file_id"), "path", file_role().isin("test", "benchmark").alias("test"))
    reach = impact(g.edge, changed, depth).withColumnRenamed("depth", "distance")
    return g.node.where("kind <> 'FILE'").join(reach, "id").join(f, "file_id", "left").select("id", display_name().alias("name"), "path", "distance", "test")


def affected_tests(rows: DataFrame) -> DataFrame:
    """(path, symbols, distance): test files among ``affected`` rows with their least distance."""
    return rows.where("test").groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.min("distance").alias("distance"))


def affected_totals(rows: DataFrame) -> DataFrame:
    direct = (F.col("distance") == 0).cast("long")
    return rows.agg(F.coalesce(F.sum(direct), F.lit(0)).alias("direct"), F.coalesce(F.sum(1 - direct), F.lit(0)).alias("propagated"))


def affected_listing(rows: DataFrame, like: str = "", limit: int = 200) -> DataFrame:
    """Rows whose name or path holds ``like``, nearest first; ids break ties as text."""
    wanted = F.lower("name").contains(like.lower()) | F.lower(F.coalesce("path", F.lit(""))).contains(like.lower())
    return rows.where(wanted).orderBy("distance", F.asc_nulls_first("path"), "name", F.col("id").cast("string")).limit(limit).select("id", "name", "path", "distance")


def canonical_fold(g: Graph) -> DataFrame:
    """(src, dst, kind, n, certainty, first_id): parallel edges as one, with the weakest certainty of them."""
    strength = F.when(F.col("c") == "certain", 3).when(F.col("c") == "probable", 2).when(F.col("c") == "uncertain", 1).otherwise(0)
    e = neutralised(g.edge).withColumn("c", display_certainty()).select("src", "dst", "kind", "id", "c", strength.alias("s"))
    folded = e.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"), F.min_by("c", "s").alias("certainty"), F.min("id").alias("first_id"))
    return folded


#: The family of an edge kind; all others are references.
FAMILIES = {"MEMBER": "ownership", "INHERITANCE": "hierarchy", "OVERRIDE": "hierarchy", "CALL": "flow", "MACRO_USAGE": "flow", "IMPORT": "dependency", "INCLUDE": "dependency"}


def family_fold(g: Graph) -> DataFrame:
    """(src, dst, family, route, n, kinds, certainty): edges between two nodes of one family as one; a pair linked both ways is a two-way route."""
    family = reduce(lambda w, k: w.when(F.col("kind") == k, FAMILIES[k]), FAMILIES, F).otherwise("reference")  # type: ignore[arg-type]
    folded = canonical_fold(g).withColumn("family", family)
    strength = F.when(F.col("certainty") == "certain", 3).when(F.col("certainty") == "probable", 2).when(F.col("certainty") == "uncertain", 1).otherwise(0)
    one = folded.groupBy("src", "dst", "family").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min_by("certainty", strength).alias("certainty"))
    back = one.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "family", F.lit(True).alias("back"))
    return one.join(back, ["src", "dst", "family"], "left").select("src", "dst", "family", F.when(F.col("src") == F.col("dst"), "self").when(F.col("back"), "both").otherwise("direct").alias("route"), "n", "kinds", "certainty")


def signed_depth(g: Graph, reach: DataFrame, centre: int) -> DataFrame:
    """(id, depth) of ``reach`` (id, depth); negative where more edges lead to the centre than from it, membership apart."""
    e = neutralised(g.edge).where("kind <> 'MEMBER' and src <> dst").where((F.col("src") == centre) | (F.col("dst") == centre))
    out = F.col("src") == centre
    bias = e.select(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("id"), F.when(out, 1).otherwise(-1).alias("b")).groupBy("id").agg(F.sum("b").alias("bias"))
    base = F.when(F.col("id") == centre, 0).otherwise(F.greatest(F.lit(1), F.col("depth")))
    return reach.join(bias, "id", "left").select("id", F.when(F.col("bias") < 0, -base).otherwise(base).alias("depth"))
