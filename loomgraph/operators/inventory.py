"""Lookups, listings, maintenance and digests over the stored relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.graph import CALLABLES, DATA, MODULES, STRUCTURAL, TYPES, certainty_of, common_call, indexable
from loomgraph.functions.paths import component_key, file_role, in_production
from loomgraph.operators.relational import neutralised
from loomgraph.sources.star_schema import Graph
from loomgraph.sources.store import TASK_ROWS, tasks_for, written


def nodes_by_ids(g: Graph, ids: DataFrame) -> DataFrame:
    """The nodes of ``ids`` (id), each once however often it is asked for."""
    return g.node.join(ids.select("id"), "id", "left_semi")


def files_by_paths(g: Graph, paths: DataFrame) -> DataFrame:
    """(id, path, role) of the files at ``paths`` (path)."""
    return g.file.join(paths.select("path"), "path", "left_semi").select("id", "path", file_role().alias("role"))


def errors(g: Graph, fatal_only: bool = False, indexed_only: bool = False) -> DataFrame:
    """Errors; optionally only fatal ones, and only those of files that are indexed."""
    e = g.error
    assert e is not None
    if fatal_only:
        e = e.where("fatal")
    return e.join(g.file.where("indexed").select(F.col("id").alias("file_id")), "file_id", "left_semi") if indexed_only else e


def indexed_files(g: Graph, contains: str = "", language: str | None = None, role: str | None = None, limit: int = 100) -> DataFrame:
    """(path, language, role, matched, truncated): the first files by path that pass all filters, and how many do."""
    f = g.file.where("indexed").withColumn("role", file_role())
    wanted = F.col("path").contains(contains)
    if language:
        wanted = wanted & (F.col("language") == language)
    if role:
        wanted = wanted & (F.col("role") == role)
    hits = f.where(wanted)
    total = hits.agg(F.count(F.lit(1)).alias("matched"))
    return hits.orderBy("path").limit(limit).select("path", "language", "role").join(F.broadcast(total)).withColumn("truncated", F.col("matched") > limit)


def language_summary(g: Graph) -> DataFrame:
    """(language, files, indexed, incomplete) of all files."""
    count = lambda c: F.sum(c.cast("long"))
    return g.file.groupBy("language").agg(F.count(F.lit(1)).alias("files"), count(F.col("indexed")).alias("indexed"), count(F.col("indexed") & ~F.col("complete")).alias("incomplete"))


def present_kinds(g: Graph) -> DataFrame:
    """(what, kind): the kinds that nodes and edges have."""
    kinds = lambda df, what: df.select(F.lit(what).alias("what"), "kind").distinct()
    return kinds(g.node, "node").unionByName(kinds(g.edge, "edge"))


def edges_by_source(g: Graph, node: int, kind: str) -> DataFrame:
    """Raw edges of a kind that start at the node, by the resolved source where there is one."""
    return g.edge.where((F.coalesce("resolved_source", "source") == node) & (F.col("kind") == kind)).select("id", "source", "target", "resolved_target")


def incoming_in_scope(g: Graph, node: int, kinds: list[str] | None = None, tests: bool = False, utility: bool = False) -> DataFrame:
    """Edges that lead to the node, after the same filters as a trail's: utility calls, callers in tests, kinds."""
    e = neutralised(g.edge)
    if not utility:
        e = e.where((F.col("kind") != "CALL") | ~common_call(F.coalesce("target_name", F.lit(""))))
    if not tests:
        e = e.where(in_production(F.col("caller_path")))
    if kinds:
        e = e.where(F.col("kind").isin(kinds))
    return e.where(F.col("dst") == node).select("id", "kind", "src")


def excluded_by_size(files: DataFrame, most: int) -> DataFrame:
    """(path, size, reason) of the files over ``most`` bytes, which are listed and not read."""
    return files.where(F.col("size") > most).select("path", "size", F.lit("oversize").alias("reason"))


def bounded_listing(files: DataFrame, most: int) -> DataFrame | None:
    """The distinct paths in order, or None where there are more than ``most``; never a part of them."""
    paths = files.select("path").distinct()
    return None if paths.limit(most + 1).count() > most else paths.orderBy("path")


def upsert_nodes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Last write wins for each id, on every column; ``seq`` (bigger is later) decides, then the batch, then the row's content."""
    columns = [c for c in current.columns if c != "seq"]
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    # A maximum is combined before the shuffle, so an id written very often is no hot group.
    last = both.groupBy("id").agg(F.max(F.struct("seq", "_new", *[c for c in columns if c != "id"])).alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in columns if c != "id"], F.col("r.seq").alias("seq"))


def upgraded_kinds(observed: DataFrame) -> DataFrame:
    """(id, kind) from observations (id, kind, seq): the first known kind; UNKNOWN only where there is no other."""
    return observed.groupBy("id").agg(F.min(F.struct((F.col("kind") == "UNKNOWN").alias("u"), "seq", "kind")).alias("k")).select("id", "k.kind")


def insert_occurrences(current: DataFrame, batch: DataFrame) -> DataFrame:
    """All occurrences, each span of an element in a file once, the earliest."""
    span = ["element_id", "file_id", "line", "end_line"]
    return current.unionByName(batch).groupBy(*span).agg(F.min("seq").alias("seq"))


def component_reports(g: Graph) -> DataFrame:
    """(component, files, symbols, callables, types): what each component of the tree holds."""
    f = g.file.select(F.col("id").alias("file_id"), component_key(F.col("path")).alias("component"))
    n = g.node.where(indexable()).select("file_id", "kind")
    files = f.groupBy("component").agg(F.count(F.lit(1)).alias("files"))
    count = lambda kinds: F.sum(F.col("kind").isin(*kinds).cast("long"))
    own = n.join(f, "file_id").groupBy("component").agg(F.count(F.lit(1)).alias("symbols"), count(CALLABLES).alias("callables"), count(TYPES).alias("types"))
    return files.join(own, "component", "left").na.fill(0, ["symbols", "callables", "types"])


def centrality(g: Graph) -> DataFrame:
    """(id, children, related, score, central) over edges that are sure enough; a node is central with 12 children and related nodes and a score of 24."""
    label = F.coalesce("certainty", certainty_of(), F.when(F.col("kind").isin(*STRUCTURAL), "certain"), F.lit("certain"))
    e = neutralised(g.edge).where((label != "uncertain") & (F.col("kind") != "UNKNOWN") & (F.col("src") != F.col("dst")))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), (F.col("kind") == "MEMBER").alias("child")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("child")))).alias("x")).select("x.*")
    pairs = ends.groupBy("id", "other").agg(F.max("child").alias("child"), F.count(F.lit(1)).alias("n"))
    c = pairs.groupBy("id").agg(F.sum(F.col("child").cast("long")).alias("children"), F.sum((~F.col("child")).cast("long")).alias("related"), F.sum("n").alias("edges"))
    c = c.withColumn("score", F.col("children") + F.col("related") + F.col("edges"))
    return c.select("id", "children", "related", "score", ((F.col("children") + F.col("related") >= 12) & (F.col("score") >= 24)).alias("central"))


def anchor_reasons(g: Graph) -> DataFrame:
    """(id, reason): why a symbol is worth a vector of its own; symbols outside production that are not central have none."""
    f = g.file.select(F.col("id").alias("file_id"), file_role().alias("role"))
    n = g.node.where(indexable()).join(f, "file_id", "left").join(centrality(g).select("id", "central"), "id", "left")
    primary, central = F.coalesce(F.col("role").isin("source", "entrypoint"), F.lit(True)), F.coalesce("central", F.lit(False))
    public = F.col("kind").isin(*TYPES, *CALLABLES) & ~F.col("serialized_name").startswith("_")
    reason = F.when(F.col("role") == "docs", "unstructured_doc").when(primary & (F.col("role") == "entrypoint") & F.col("kind").isin(*CALLABLES), "entrypoint").when(central, "central").when(primary & public, "public_api").when(primary & ~F.col("kind").isin(*DATA, *MODULES), "flow_neighbor")
    return n.select("id", reason.alias("reason")).where("reason is not null")


def framed(*columns: str) -> Column:
    """The columns' values one after the other, each after its length, so that no two rows run together; null is -1."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-1:")).otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.concat(*[part(c) for c in columns])


def digest_by(df: DataFrame, group: str, key: str, *columns: str) -> DataFrame:
    """(group, n, digest): a SHA-256 of each group's rows in the order of ``key``, whatever order they come in.

    Rows are hashed where they are and 64 characters a row are collected for each group; a group of
    any size is first folded by buckets of its keys.
    """
    row = df.select(F.col(group).alias("group"), F.col(key).alias("key"), F.sha2(framed(key, *columns), 256).alias("h"))
    bucket = F.floor(F.col("key") / 1_000).alias("bucket")
    ordered = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda x: x["h"]), "")
    folded = row.groupBy("group", bucket).agg(F.count(F.lit(1)).alias("n"), F.sha2(ordered("key"), 256).alias("h"))
    return folded.groupBy("group").agg(F.sum("n").alias("n"), F.sha2(ordered("bucket"), 256).alias("digest"))


#: Pairs that one tile of occurrences and spans gives, about, and the most spans in one; distinct ranges up to which their tiles' numbers are broadcast.
LANE_PAIRS, LANE_SPANS, SENT = 4_000_000, 16_384, 100_000
_RANGE = ["file_id", "line", "end_line"]


def _covering(occurrences: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_id, line, end_line, o, s, e): the distinct ranges of ``o`` occurrences with the distinct spans that hold them.

    The join is of distinct ranges, by file and by the block of lines that an occurrence starts in; a span is listed
    under each block it covers, so not all of a file's ranges are paired.
    """
    width = 64
    block = lambda line: F.floor(line / width)
    s = spans.select("file_id", F.col("start_line").alias("s"), F.col("end_line").alias("e")).distinct()
    s = s.withColumn("block", F.explode(F.sequence(block(F.col("s")), block(F.col("e")))))
    o = occurrences.groupBy(*_RANGE).agg(F.count(F.lit(1)).alias("o")).withColumn("block", block(F.col("line")))
    return o.join(s, ["file_id", "block"]).where("line >= s and end_line <= e").drop("block")


def _tiles(occurrences: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Occurrences (range, chunk, lane, seq) and lists of spans (range, chunk, lane, ids) whose pairs are the results, and how many tasks share them.

    A range's spans are cut into chunks and its occurrences into lanes. A lane has at least as many occurrences as a chunk has spans, so
    what is repeated, a list for each lane and an occurrence for each chunk, is never more than the occurrences or a small part of the pairs.
    """
    own = spans.select("file_id", "node_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    holding = written(_covering(occurrences, spans).join(own, ["file_id", "s", "e"]).select(*_RANGE, "o", "node_id"))
    n = F.least(F.col("n"), F.lit(LANE_SPANS))
    fit = F.least(F.lit(TASK_ROWS), F.greatest(n, F.ceil(F.lit(LANE_PAIRS) / n)))
    counted = holding.groupBy(*_RANGE, "o").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(counted.select(*_RANGE, "o", F.ceil(F.col("n") / LANE_SPANS).alias("chunks"), F.ceil(F.col("o") / fit).alias("lanes")))
    ranges, rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("o") * F.col("chunks")), F.lit(0))).first()
    sizes = sizes.drop("o")
    sizes = F.broadcast(sizes) if ranges <= SENT else sizes
    numbers = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most) - 1))
    dealt = occurrences.select(*_RANGE, "seq").join(sizes, _RANGE).select(*_RANGE, numbers("chunks").alias("chunk"), F.pmod(F.xxhash64("seq"), F.col("lanes")).alias("lane"), "seq")
    lists = holding.drop("o").join(sizes, _RANGE).withColumn("chunk", F.pmod(F.xxhash64("node_id"), F.col("chunks")))
    # Bare values would lose nulls.
    lists = lists.groupBy(*_RANGE, "chunk", "lanes").agg(F.collect_list(F.struct("node_id")).alias("ids")).select(*_RANGE, "chunk", numbers("lanes").alias("lane"), F.transform("ids", lambda x: x["node_id"]).alias("ids"))
    return dealt, lists, tasks_for(occurrences.sparkSession, rows)


def range_contained(occurrences: DataFrame, spans: DataFrame) -> DataFrame:
    """(node_id, seq): occurrences inside a callable's lines of the same file.

    Which ranges lie in which spans is found among the distinct ones; the occurrences of a range then meet lists of its spans, tile by tile,
    and pairs are formed only as they are read. A range that is met very often is many tasks' work.
    """
    dealt, lists, tasks = _tiles(occurrences, spans)
    tile = [*_RANGE, "chunk", "lane"]
    return dealt.repartition(tasks, *tile).join(lists.repartition(tasks, *tile).hint("merge"), tile).select(F.explode("ids").alias("node_id"), "seq")


def range_covered(occurrences: DataFrame, spans: DataFrame) -> DataFrame:
    """(seq) of the occurrences that ``range_contained`` pairs with any span, without forming the pairs."""
    return occurrences.join(_covering(occurrences, spans).select(*_RANGE), _RANGE, "left_semi").select("seq")


def without_callers(g: Graph, callers: DataFrame) -> Graph:
    """The graph without the calls and usages of ``callers`` (node_id, file_id, start_line, end_line) and the occurrences in their lines."""
    own = callers.select(F.col("node_id").alias("source"))
    gone = g.edge.where("kind in ('CALL', 'USAGE')").join(own, "source", "left_semi").select("id")
    inside = range_covered(g.occurrence, callers).distinct()
    return Graph(g.node, g.edge.join(gone, "id", "left_anti").select(*g.edge.columns), g.occurrence.join(inside, "seq", "left_anti").select(*g.occurrence.columns), g.file, g.error)


def callers_of_files(g: Graph, files: DataFrame) -> DataFrame:
    """(file_id): other files with an edge into one of ``files`` (file_id), which a deletion leaves to be repaired."""
    dead = g.node.join(files.select("file_id").distinct(), "file_id", "left_semi").select(F.col("id").alias("dst"))
    touched = neutralised(g.edge).join(dead, "dst", "left_semi").select("file_id").where("file_id is not null").distinct()
    return touched.join(files.select("file_id").distinct(), "file_id", "left_anti")


def file_modes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, mode, changed) of each file by its callables' states (file_id, symbol_key, signature_hash, body_hash, start_line).

    A file without old states is inserted; one without new ones, or of whose symbols the set or a signature
    changed, is replaced; one of changed bodies gets a delta; one of moved lines alone is repositioned.
    """
    cols = ("signature_hash", "body_hash", "start_line")
    o = old.select("file_id", "symbol_key", *[F.col(c).alias(f"{c}_o") for c in cols], F.lit(1).alias("was"))
    n = new.select("file_id", "symbol_key", *[F.col(c).alias(f"{c}_n") for c in cols], F.lit(1).alias("now"))
    differs = lambda c: ~F.col(f"{c}_o").eqNullSafe(F.col(f"{c}_n"))
    kept = F.col("was").isNotNull() & F.col("now").isNotNull()
    flags = {"was": F.col("was").isNotNull(), "now": F.col("now").isNotNull(), "other": ~kept | differs("signature_hash"), "body": kept & differs("body_hash"), "moved": kept & differs("start_line")}
    per = o.join(n, ["file_id", "symbol_key"], "full").groupBy("file_id").agg(*[F.max(c).alias(k) for k, c in flags.items()], F.sum((kept & differs("body_hash")).cast("long")).alias("changed"))
    mode = F.when(~F.col("was"), "insert_fresh").when(~F.col("now") | F.col("other"), "full_replace").when(F.col("body"), "delta").when(F.col("moved"), "reposition").otherwise("no_changes")
    return per.select("file_id", mode.alias("mode"), "changed")


def rebind(bookmarks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(bookmark, node_id, how): where the symbol of a bookmark is now.

    Both frames have canonical_id, file_id, qualified_name, kind and signature; ``bookmarks`` also
    bookmark, ``anchors`` node_id. By canonical id, else by file, name and kind, else moved (the name elsewhere with
    the same signature), else renamed (the signature in the same file); each only where exactly one node fits.
    """

    def single(*keys: str) -> DataFrame:
        known = anchors.where(" and ".join(f"{k} is not null" for k in keys))
        return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("node_id").alias("hit"))

    ways = [("canonical", ["canonical_id"]), ("same_place", ["file_id", "qualified_name", "kind"]), ("moved", ["qualified_name", "signature"]), ("renamed", ["file_id", "signature"])]
    found, orphan = bookmarks, F.lit("missing")
    for how, keys in ways:
        found = found.join(single(*keys).select(*keys, F.when(F.col("c") == 1, F.col("hit")).alias(f"hit_{how}"), (F.col("c") > 1).alias(f"many_{how}")), keys, "left")
    for how, _ in reversed(ways):
        orphan = F.when(F.coalesce(f"many_{how}", F.lit(False)), "ambiguous").otherwise(orphan)
    hits = [F.col(f"hit_{how}") for how, _ in ways]
    how = F.lit(None).cast("string")
    for name, _ in reversed(ways):
        how = F.when(F.col(f"hit_{name}").isNotNull(), name).otherwise(how)
    return found.select("bookmark", F.coalesce(*hits).alias("node_id"), F.coalesce(how, orphan).alias("how"))


def snippet(lines_of: DataFrame, line: int, context: int = 4) -> DataFrame:
    """(path, first_line, text): the lines around ``line`` of each text (path, text); at most 50 on each side and 64 KiB."""
    around = max(0, min(context, 50))
    first = max(1, line - around)
    parts = F.slice(F.split("text", "\n"), first, line + around - first + 1)
    text = F.array_join(parts, "\n")
    most = 64 * 1024
    cutoff = F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most // 4), F.lit("\n... [truncated]"))).otherwise(text)
    return lines_of.where(F.size(F.split("text", "\n")) >= line).select("path", F.lit(first).alias("first_line"), cutoff.alias("text"))


def first_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each of ``keys``, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
