"""Lookups, maintenance, digests and orientation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import component_key, extension, path_rank, repo_relative, file_role, route_languages, structural_depth, subsystem_key, test_or_bench
from loomgraph.operators import inventory as i
from loomgraph.operators import roots as ro
from loomgraph.plans.fragments import BAND, BENCH_PATH, CALL_DEGREES, CERTAINTY, COMMON, EFFECTIVE, IMPORT_LIKE, INDEXABLE, RANK, ROLE, SNAPSHOT, TEST_PATH, TIER
from loomgraph.sources.star_schema import BASE, Graph, load_graph, table


def _g(f):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: f(load_graph(spark, sf_dir))


_SEGMENTS = "list_filter(string_split(lower({0}), '/'), lambda x: x <> '')"
_FOLDERS = f"{_SEGMENTS}[1:greatest(len({_SEGMENTS}) - 1, 0)]"
_BELOW = f"(coalesce(list_position(list_reverse(list_transform({_FOLDERS}, lambda x: x IN ('src','lib','app','cmd','source'))), true), 0) - 1)"


def _path_rank(path: str) -> str:
    below, folders = _BELOW.format(path), _FOLDERS.format(path)
    return f"CASE WHEN {ROLE.replace('path', path) if path != 'path' else ROLE} = 'entrypoint' THEN 0 WHEN {path} IS NULL THEN 3 WHEN {below} >= 0 THEN CASE WHEN {below} <= 1 THEN 1 ELSE 2 END WHEN len({folders}) = 0 THEN 1 ELSE 3 END"


def _subsystem(language: str, path: str) -> str:
    s = _SEGMENTS.format(path)
    last = f"(len({s}) - list_position(list_reverse({s}), 'src') + 1)"
    return f"""{language} || ':' || CASE WHEN {path} IS NULL THEN 'unknown' WHEN regexp_matches(lower({path}), '(^|/)crates/[^/]+') THEN regexp_extract(lower({path}), '(?:^|/)(crates/[^/]+)', 1)
  WHEN regexp_matches(lower({path}), '(^|/)plugins/[^/]+') THEN regexp_extract(lower({path}), '(?:^|/)(plugins/[^/]+)', 1) WHEN list_contains({s}, 'src-tauri') THEN 'src-tauri'
  WHEN list_contains({s}, 'src') THEN array_to_string({s}[1:{last} + CASE WHEN {last} < len({s}) AND NOT contains({s}[{last} + 1], '.') THEN 1 ELSE 0 END], '/') WHEN len({s}) = 0 THEN 'root' ELSE {s}[1] END"""


_COMPONENT = r"CASE WHEN regexp_extract(lower(path), '(?:^|/)crates/([^/]+)/', 1) <> '' THEN 'crate:' || regexp_extract(lower(path), '(?:^|/)crates/([^/]+)/', 1) WHEN regexp_extract(lower(path), '(?:^|/)src/([^/]+)/', 1) <> '' THEN 'module:' || regexp_extract(lower(path), '(?:^|/)src/([^/]+)/', 1) ELSE 'dir:' || CASE WHEN regexp_extract(lower(path), '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(lower(path), '^(.*)/[^/]*$', 1) END END"
_EVIDENCE = f"CASE WHEN coalesce(role IN ('source','entrypoint'), false) AND kind = 'METHOD' AND coalesce(callers, 0) = 0 AND coalesce(callees, 0) >= 2 THEN 2 WHEN coalesce(role IN ('source','entrypoint'), false) AND kind = 'METHOD' AND serialized_name = 'main' THEN 1 ELSE 0 END"
_ROLE_RANK = "coalesce(list_position(['entrypoint','source','test','docs','benchmark','generated','vendor'], role) - 1, 1)"
_ROOTS = f"""{EFFECTIVE}, {CALL_DEGREES},
mc AS (SELECT source AS id, count(*) AS members FROM edge WHERE kind = 'MEMBER' GROUP BY source),
fr AS (SELECT id AS file_id, path, language, {ROLE} AS role, {_path_rank('path')} AS place, {_subsystem('language', 'path')} AS subsystem FROM file),
r0 AS (SELECT n.*, fr.path, fr.role, coalesce(fr.place, 3) AS place, coalesce(fr.subsystem, 'unknown:unknown') AS subsystem, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(members, 0) AS members
  FROM node n LEFT JOIN fr USING (file_id) LEFT JOIN cd USING (id) LEFT JOIN mc USING (id) WHERE {INDEXABLE.replace('kind', 'n.kind')} AND n.id NOT IN (SELECT target FROM edge WHERE kind = 'MEMBER')),
r1 AS (SELECT *, {_EVIDENCE} AS entry, {_ROLE_RANK} AS role_rank, {RANK} AS rank, len(list_intersect(regexp_split_to_array(lower(concat_ws(' ', qualified_name, path)), '[^a-z0-9]+'), ['helper','helpers','mock','mocks','fake','fixture','fixtures'])) > 0 AS helper, {TIER.format('callers')} AS in_tier, {TIER.format('callees')} AS out_tier FROM r0),
roots AS (SELECT id, kind, qualified_name AS name, path, role, subsystem, CASE WHEN {IMPORT_LIKE} THEN 5 WHEN role = 'entrypoint' AND entry > 0 THEN 0 WHEN role IN ('source','entrypoint') THEN CASE WHEN len(list_intersect(string_split(lower(coalesce(path, '')), '/'), ['scripts','tools','tooling','ci','.github','xtask'])) > 0 THEN 3 WHEN place <= 1 THEN 1 WHEN place = 2 THEN 2 ELSE 3 END ELSE 4 END AS band, entry, role_rank, helper, in_tier, out_tier, members, place, rank, start_line AS line FROM r1)"""
ROOTS_SQL = _ROOTS
_ROOT_ORDER = "band, entry DESC, role_rank, helper, in_tier DESC, out_tier DESC, members DESC, place, rank, line, path NULLS FIRST, name, id"
_UNIQUE = f"uniq AS (SELECT * FROM roots QUALIFY row_number() OVER (PARTITION BY kind, name, path ORDER BY {_ROOT_ORDER}) = 1)"


def _paths(g: Graph) -> DataFrame:
    f = route_languages(g.file.select("id", "path", F.col("language").alias("stated")).withColumn("path", F.col("path")))
    p = F.col("path")
    far = F.concat(F.lit("C:\\work\\Repos\\me\\"), F.regexp_replace(p, "/", "\\\\"))
    return f.select("id", repo_relative(far).alias("relative"), test_or_bench(p).alias("test"), extension(p).alias("extension"), "language", "tier", component_key(p).alias("component"), subsystem_key(F.col("stated"), p).alias("subsystem"), structural_depth(p).alias("depth"), path_rank(file_role(p), p).alias("place"))


def _upsert(g: Graph) -> DataFrame:
    s = g.node.where("kind = 'STRUCT'").select("id", "serialized_name", "start_line")
    return i.upsert_nodes(s.withColumn("seq", F.col("id") % 10), s.where("id % 2 = 0").withColumn("serialized_name", F.concat("serialized_name", F.lit("!"))).withColumn("seq", F.col("id") % 7))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return i.upgraded_kinds(e.select(F.col("user_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "UNKNOWN").otherwise(F.upper("event_type")).alias("kind"), F.col("event_id").alias("seq")))


def _repair(g: Graph) -> DataFrame:
    left = i.without_callers(g, g.node.where("kind = 'METHOD' and id % 100 = 2").select(F.col("id").alias("node_id"), "file_id", "start_line", "end_line"))
    return left.edge.groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(left.occurrence.agg(F.count(F.lit(1)).alias("n")).select(F.lit("occurrence").alias("what"), "n"))


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    f, k = F.col("o_custkey") % 25, F.col("o_orderkey")
    s = o.select(f.alias("file_id"), k.cast("string").alias("symbol_key"), F.col("o_orderstatus").alias("signature_hash"), F.col("o_orderpriority").alias("body_hash"), (k % 983).alias("start_line"), k.alias("k"))
    new = s.where("file_id % 5 <> 1").withColumns({"signature_hash": F.when((F.col("file_id") % 5 == 2) & (F.col("k") % 100 == 0), "changed").otherwise(F.col("signature_hash")), "body_hash": F.when((F.col("file_id") % 10 == 3) & (F.col("k") % 7 == 0), "changed").otherwise(F.col("body_hash")), "start_line": F.when(F.col("file_id") % 10 == 4, F.col("start_line") + 1).otherwise(F.col("start_line"))})
    return i.file_modes(s.where("file_id % 5 <> 0"), new)


def _rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    here = s.select(k.alias("node_id"), F.concat(F.lit("c:"), k).alias("canonical_id"), F.col("s_nationkey").alias("file_id"), F.concat(F.lit("n"), k % 40).alias("qualified_name"), F.lit("STRUCT").alias("kind"), F.concat(F.lit("s"), k % 60).alias("signature"))
    old = here.withColumnRenamed("node_id", "bookmark")
    b = F.col("bookmark")
    old = old.withColumns({"canonical_id": F.when(b % 5 == 0, F.col("canonical_id")), "file_id": F.when(b % 5 == 2, -1).otherwise(F.col("file_id")), "qualified_name": F.when(b % 5 >= 3, "new").otherwise(F.col("qualified_name"))})
    return i.rebind(old, here)


_STATES = "s AS (SELECT o_custkey % 25 AS file_id, CAST(o_orderkey AS VARCHAR) AS symbol_key, o_orderstatus AS sig, o_orderpriority AS body, o_orderkey % 983 AS line, o_orderkey AS k FROM orders)"
_DIGEST = "sha256(string_agg(h, '' ORDER BY {0}))"

ALL = {
    "nodes_by_ids": (_g(lambda g: i.nodes_by_ids(g, g.node.where("kind = 'STRUCT'").select((F.col("id") - F.col("id") % 3).alias("id"))).select("id", "kind", "serialized_name")), "WITH GRAPH SELECT id, kind, serialized_name FROM node WHERE id IN (SELECT id - id % 3 FROM node WHERE kind = 'STRUCT')"),
    "all_edges": (_g(lambda g: g.edge.select("id", "kind", "source", "target", "resolved_target", "confidence", "certainty")), "WITH GRAPH SELECT id, kind, source, target, resolved_target, confidence, certainty FROM edge"),
    "edge_context": (_g(lambda g: g.edge.select("id", "target_name", "caller_path")), "WITH GRAPH SELECT id, target_name, caller_path FROM edge"),
    "files_by_paths": (_g(lambda g: i.files_by_paths(g, g.file.where("id % 3 = 0").select("path"))), f"WITH GRAPH SELECT id, path, {ROLE} AS role FROM file WHERE id % 3 = 0"),
    "errors_filtered": (_g(lambda g: i.errors(g, True, True).select("id", "file_id", "message", "step")), "WITH GRAPH SELECT id, file_id, message, step FROM error WHERE fatal AND file_id IN (SELECT id FROM file WHERE indexed)"),
    "indexed_files": (_g(lambda g: i.indexed_files(g, "a", "rust", None, 5)), f"WITH GRAPH, h AS (SELECT path, language, {ROLE} AS role FROM file WHERE indexed AND contains(path, 'a') AND language = 'rust') SELECT *, (SELECT count(*) FROM h) AS matched, (SELECT count(*) FROM h) > 5 AS truncated FROM h ORDER BY path LIMIT 5"),
    "language_summary": (_g(i.language_summary), "WITH GRAPH SELECT language, count(*) AS files, count(*) FILTER (indexed) AS indexed, count(*) FILTER (indexed AND NOT complete) AS incomplete FROM file GROUP BY language"),
    "present_kinds": (_g(i.present_kinds), "WITH GRAPH SELECT DISTINCT 'node' AS what, kind FROM node UNION ALL SELECT DISTINCT 'edge', kind FROM edge"),
    "edges_by_source": (_g(lambda g: i.edges_by_source(g, 3 * BASE + 1, "CALL")), "WITH GRAPH SELECT id, source, target, resolved_target FROM edge WHERE source = 30000000001 AND kind = 'CALL'"),
    "incoming_in_scope": (_g(lambda g: i.incoming_in_scope(g, 6 * BASE + 7, ["USAGE"])), f"WITH GRAPH, {EFFECTIVE} SELECT id, kind, src FROM eff WHERE dst = 60000000007 AND kind = 'USAGE' AND NOT coalesce({TEST_PATH.format('caller_path')} OR {BENCH_PATH.format('caller_path')}, false)"),
    "utility_calls": (_g(lambda g: i.neutralised(g.edge).where((F.col("kind") == "CALL") & i.common_call(F.col("target_name"))).select("id", "src", "dst")), f"WITH GRAPH, {EFFECTIVE} SELECT id, src, dst FROM eff WHERE kind = 'CALL' AND target_name IN ({COMMON})"),
    "path_properties": (_g(_paths), f"WITH GRAPH SELECT id, lower(path) AS relative, {TEST_PATH.format('path')} OR {BENCH_PATH.format('path')} AS test, regexp_extract(lower(path), '[^/]\\.([^./]+)$', 1) AS extension, CASE regexp_extract(lower(path), '[^/]\\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' END AS language, CASE WHEN lower(path) LIKE '%.md' THEN 'structural' ELSE 'parsed' END AS tier, {_COMPONENT} AS component, {_subsystem('language', 'path')} AS subsystem, CASE WHEN {_BELOW.format('path')} >= 0 THEN {_BELOW.format('path')} ELSE len({_FOLDERS.format('path')}) END AS depth, {_path_rank('path')} AS place FROM file"),
    "excluded_by_size": (_g(lambda g: i.excluded_by_size(g.file, 12_000)), "WITH GRAPH SELECT path, size, 'oversize' AS reason FROM file WHERE size > 12000"),
    "node_upsert": (_g(_upsert), "WITH GRAPH, s AS (SELECT id, serialized_name, start_line FROM node WHERE kind = 'STRUCT'), u AS (SELECT *, id % 10 AS seq, 0 AS batch FROM s UNION ALL SELECT id, serialized_name || '!', start_line, id % 7, 1 FROM s WHERE id % 2 = 0) SELECT id, serialized_name, start_line, seq FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, batch DESC) = 1"),
    "upgraded_kinds": (_kinds, "WITH o AS (SELECT user_id AS id, CASE WHEN event_id % 3 = 0 THEN 'UNKNOWN' ELSE upper(event_type) END AS kind, event_id AS seq FROM events) SELECT id, kind FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind = 'UNKNOWN', seq) = 1"),
    "insert_occurrences": (_g(lambda g: i.insert_occurrences(g.occurrence.where("seq % 2 = 0"), g.occurrence)), "WITH GRAPH SELECT element_id, file_id, line, end_line, min(seq) AS seq FROM occurrence GROUP BY ALL"),
    "component_reports": (_g(i.component_reports), f"WITH GRAPH, f AS (SELECT id AS file_id, {_COMPONENT} AS component FROM file), s AS (SELECT component, count(*) AS symbols, count(*) FILTER (kind = 'METHOD') AS callables, count(*) FILTER (kind IN ('CLASS','STRUCT')) AS types FROM node JOIN f USING (file_id) WHERE {INDEXABLE} GROUP BY 1) SELECT f.component, count(*) AS files, coalesce(any_value(symbols), 0) AS symbols, coalesce(any_value(callables), 0) AS callables, coalesce(any_value(types), 0) AS types FROM f LEFT JOIN s USING (component) GROUP BY 1"),
    "centrality": (_g(i.centrality), f"WITH GRAPH, {EFFECTIVE}, e AS (SELECT src, dst, kind FROM eff WHERE src <> dst AND coalesce(certainty, {BAND}, 'certain') <> 'uncertain'), b AS (SELECT src AS id, dst AS other, kind = 'MEMBER' AS child FROM e UNION ALL SELECT dst, src, false FROM e), p AS (SELECT id, other, bool_or(child) AS child, count(*) AS n FROM b GROUP BY ALL), c AS (SELECT id, count(*) FILTER (child) AS children, count(*) FILTER (NOT child) AS related, count(*) + CAST(sum(n) AS BIGINT) AS score FROM p GROUP BY id) SELECT *, children + related >= 12 AND score >= 24 AS central FROM c"),
    "content_digest": (_g(lambda g: i.digest_by(g.node, "file_id", "id", "kind", "serialized_name")), f"WITH GRAPH, r AS (SELECT file_id AS g, id AS k, sha256(strlen(CAST(id AS VARCHAR)) || ':' || id || strlen(kind) || ':' || kind || strlen(serialized_name) || ':' || serialized_name) AS h FROM node), b AS (SELECT g, k // 1000 AS k, count(*) AS n, {_DIGEST.format('k')} AS h FROM r GROUP BY g, k // 1000) SELECT g AS \"group\", CAST(sum(n) AS BIGINT) AS n, {_DIGEST.format('k')} AS digest FROM b GROUP BY g"),
    "range_containment": (_g(lambda g: i.range_contained(g.occurrence, g.node.where("kind = 'METHOD'").select("file_id", F.col("id").alias("node_id"), "start_line", "end_line"))), "WITH GRAPH SELECT n.id AS node_id, o.seq FROM occurrence o JOIN node n ON n.kind = 'METHOD' AND n.file_id = o.file_id AND o.line >= n.start_line AND o.end_line <= n.end_line"),
    "caller_repair": (_g(_repair), "WITH GRAPH, c AS (SELECT * FROM node WHERE kind = 'METHOD' AND id % 100 = 2) SELECT kind AS what, count(*) AS n FROM edge WHERE NOT (kind IN ('CALL','USAGE') AND source IN (SELECT id FROM c)) GROUP BY kind UNION ALL SELECT 'occurrence', count(*) FROM occurrence o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file_id = o.file_id AND o.line >= c.start_line AND o.end_line <= c.end_line)"),
    "deletion_callers": (_g(lambda g: i.callers_of_files(g, g.file.where("id % 4 = 1").select(F.col("id").alias("file_id")))), f"WITH GRAPH, {EFFECTIVE}, d AS (SELECT id FROM file WHERE id % 4 = 1) SELECT DISTINCT file_id FROM eff WHERE dst IN (SELECT id FROM node WHERE file_id IN (FROM d)) AND file_id NOT IN (FROM d)"),
    "incremental_modes": (_modes, f"WITH {_STATES}, o AS (SELECT * FROM s WHERE file_id % 5 <> 0), n AS (SELECT file_id, symbol_key, CASE WHEN file_id % 5 = 2 AND k % 100 = 0 THEN 'changed' ELSE sig END AS sig, CASE WHEN file_id % 10 = 3 AND k % 7 = 0 THEN 'changed' ELSE body END AS body, CASE WHEN file_id % 10 = 4 THEN line + 1 ELSE line END AS line FROM s WHERE file_id % 5 <> 1), j AS (SELECT file_id, o.symbol_key IS NOT NULL AS was, n.symbol_key IS NOT NULL AS now, o.symbol_key IS NULL OR n.symbol_key IS NULL OR o.sig <> n.sig AS other, coalesce(o.body <> n.body, false) AS body, coalesce(o.line <> n.line, false) AS moved FROM o FULL JOIN n USING (file_id, symbol_key)) SELECT file_id, CASE WHEN NOT bool_or(was) THEN 'insert_fresh' WHEN NOT bool_or(now) OR bool_or(other) THEN 'full_replace' WHEN bool_or(body) THEN 'delta' WHEN bool_or(moved) THEN 'reposition' ELSE 'no_changes' END AS mode, count(*) FILTER (body) AS changed FROM j GROUP BY file_id"),
    "annotation_rebind": (_rebind, "WITH h AS (SELECT s_suppkey AS id, 'c:' || s_suppkey AS c, s_nationkey AS f, 'n' || (s_suppkey % 40) AS q, 's' || (s_suppkey % 60) AS sig FROM supplier), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN c END AS c, CASE WHEN id % 5 = 2 THEN -1 ELSE f END AS f, CASE WHEN id % 5 >= 3 THEN 'new' ELSE q END AS q, sig FROM h), m AS (SELECT b.id, (SELECT count(*) FROM h WHERE h.c = b.c) AS n1, (SELECT min(id) FROM h WHERE h.c = b.c) AS h1, (SELECT count(*) FROM h WHERE h.f = b.f AND h.q = b.q) AS n2, (SELECT min(id) FROM h WHERE h.f = b.f AND h.q = b.q) AS h2, (SELECT count(*) FROM h WHERE h.q = b.q AND h.sig = b.sig) AS n3, (SELECT min(id) FROM h WHERE h.q = b.q AND h.sig = b.sig) AS h3, (SELECT count(*) FROM h WHERE h.f = b.f AND h.sig = b.sig) AS n4, (SELECT min(id) FROM h WHERE h.f = b.f AND h.sig = b.sig) AS h4 FROM b) SELECT id AS bookmark, CASE WHEN n1 = 1 THEN h1 WHEN n2 = 1 THEN h2 WHEN n3 = 1 THEN h3 WHEN n4 = 1 THEN h4 END AS node_id, CASE WHEN n1 = 1 THEN 'canonical' WHEN n2 = 1 THEN 'same_place' WHEN n3 = 1 THEN 'moved' WHEN n4 = 1 THEN 'renamed' WHEN greatest(n1, n2, n3, n4) > 1 THEN 'ambiguous' ELSE 'missing' END AS how FROM m"),
    "snippets": (lambda s, d: i.snippet(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text")), 3, 1), "WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT path, array_to_string(l[2:4], chr(10)) AS text FROM t WHERE len(l) >= 3) SELECT path, 2 AS first_line, CASE WHEN strlen(text) > 65536 THEN substr(text, 1, 16384) || chr(10) || '... [truncated]' ELSE text END AS text FROM x"),
    "sorted_roots": (_g(lambda g: ro.sorted_roots(g, 60).select("id", "band", "entry", "role_rank", "helper", "in_tier", "out_tier", "members", "place", "rank", "subsystem")), f"WITH GRAPH, {_ROOTS} SELECT id, band, entry, role_rank, helper, in_tier, out_tier, members, place, rank, subsystem FROM roots ORDER BY {_ROOT_ORDER} LIMIT 60"),
    "band_histogram": (_g(lambda g: ro.root_keys(g).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("entry").alias("entries"))), f"WITH GRAPH, {_ROOTS} SELECT band, count(*) AS n, CAST(sum(entry) AS BIGINT) AS entries FROM roots GROUP BY band"),
    "diversified_roots": (_g(lambda g: ro.diversified_roots(ro.root_keys(g))), None),
    "file_universe": (_g(lambda g: ro.file_universe(g, 2, 2, 12)), f"WITH GRAPH, {SNAPSHOT}, f AS (SELECT snap.*, {_subsystem('language', 'snap.path')} AS subsystem FROM snap JOIN file ON file.id = snap.file_id), e AS (SELECT file_id, path FROM f WHERE role = 'entrypoint' ORDER BY len(string_split(path, '/')), path, file_id LIMIT 2), q AS (SELECT *, row_number() OVER (PARTITION BY subsystem ORDER BY best_rank, symbol_count DESC, path) AS slot FROM f), o AS (SELECT file_id, path FROM q WHERE slot <= 2 AND file_id NOT IN (SELECT file_id FROM e) ORDER BY slot, subsystem LIMIT 12) SELECT *, 'entry' AS why FROM e UNION ALL SELECT *, 'subsystem' FROM o"),
    "unique_records": (_g(lambda g: ro.unique_records(ro.root_keys(g)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))), f"WITH GRAPH, {_ROOTS}, {_UNIQUE} SELECT kind, count(*) AS n, min(id) AS first FROM uniq GROUP BY kind"),
    "orientation": (_g(lambda g: ro.orientation_confidence(ro.root_keys(g))), f"WITH GRAPH, {_ROOTS}, c AS (SELECT count(*) FILTER (entry > 0) AS entries, count(*) FILTER (band <= 2) AS production FROM roots) SELECT CASE WHEN entries > 0 THEN 'strong' WHEN production > 0 THEN 'partial' ELSE 'weak' END AS confidence, entries, production FROM c"),
    "grounding_snapshot": (_g(lambda g: ro.snapshot(g, "strict")), f"WITH GRAPH, {_ROOTS}, {_UNIQUE}, {SNAPSHOT}, fs AS (SELECT 'file' AS section, row_number() OVER (ORDER BY best_rank, symbol_count DESC, path) AS position, CAST(NULL AS VARCHAR) AS name, path FROM snap QUALIFY position <= 12) SELECT 'root' AS section, row_number() OVER (ORDER BY {_ROOT_ORDER}) AS position, name, path FROM uniq QUALIFY position <= 8 UNION ALL SELECT * FROM fs"),
}
_ANCHOR_CENTRAL = ALL["centrality"][1].replace("WITH GRAPH, ", "").replace("SELECT *, children", "cen AS (SELECT *, children") + ")"
_ANCHOR_CENTRAL = _ANCHOR_CENTRAL.replace("GROUP BY id) cen AS", "GROUP BY id), cen AS")
ALL["anchor_reasons"] = (_g(i.anchor_reasons), f"WITH GRAPH, {_ANCHOR_CENTRAL}, x AS (SELECT n.id, n.kind, n.serialized_name, {ROLE} AS role0, f.path, coalesce(central, false) AS central FROM node n LEFT JOIN file f ON f.id = n.file_id LEFT JOIN cen ON cen.id = n.id WHERE {INDEXABLE.replace('kind', 'n.kind')}), y AS (SELECT *, CASE WHEN path IS NULL THEN NULL ELSE role0 END AS role FROM x), z AS (SELECT id, CASE WHEN role = 'docs' THEN 'unstructured_doc' WHEN role = 'entrypoint' AND kind = 'METHOD' THEN 'entrypoint' WHEN central THEN 'central' WHEN coalesce(role IN ('source','entrypoint'), true) AND kind IN ('CLASS','STRUCT','METHOD') AND NOT starts_with(serialized_name, '_') THEN 'public_api' WHEN coalesce(role IN ('source','entrypoint'), true) AND kind NOT IN ('FIELD','MODULE','NAMESPACE') THEN 'flow_neighbor' END AS reason FROM y) SELECT * FROM z WHERE reason IS NOT NULL")
__all__ = ["ALL", "CERTAINTY"]
