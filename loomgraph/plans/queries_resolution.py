"""Edge resolution, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import resolution as x
from loomgraph.operators import resolution_pass as rp
from loomgraph.operators import traverse as w
from loomgraph.plans.fragments import BAND, COMMON, EFFECTIVE
from loomgraph.sources.star_schema import Graph, load_graph


def _g(f):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: f(load_graph(spark, sf_dir))


def _module(g: Graph) -> DataFrame:
    return g.file.select(F.col("id").alias("file_id"), F.regexp_extract("path", "^(.*)/", 1).alias("module"))


def _calls(g: Graph) -> DataFrame:
    """Usages as calls of what is named by their number, a third of them with the owner of their source."""
    k = F.col("id")
    name = F.when(k % 5 == 0, "RUN").when(k % 5 == 1, "len").when(k % 5 == 2, F.concat(F.lit("order_"), (k % 700).cast("string"))).when(k % 5 == 3, "x::Push").otherwise("nobody")
    owner = F.when(k % 3 == 0, F.concat(F.lit("Customer#"), F.lpad((k % 149).cast("string"), 9, "0")))
    e = g.edge.where("kind = 'USAGE' and id % 11 < 3").select(F.col("id").alias("edge_id"), name.alias("name"), "file_id", owner.alias("owner"))
    return e.join(_module(g), "file_id", "left")


def _candidates(g: Graph) -> DataFrame:
    return x.owner_members(g).join(_module(g), "file_id", "left")


_MODULE = "regexp_extract(path, '^(.*)/', 1)"
_TAIL = "lower(regexp_replace({0}, '^.*(::|\\.)', ''))"
_CAND = f"own AS (SELECT target AS node_id, count(DISTINCT source) AS c, min(source) AS o FROM edge WHERE kind = 'MEMBER' GROUP BY target), c AS (SELECT n.id AS node_id, n.serialized_name AS name, n.file_id, {_MODULE} AS module, o.serialized_name AS owner, {_TAIL.format('n.serialized_name')} AS tail FROM node n LEFT JOIN file f ON f.id = n.file_id LEFT JOIN own ON own.node_id = n.id AND own.c = 1 LEFT JOIN node o ON o.id = own.o WHERE n.kind = 'METHOD')"
_REQ = f"q0 AS (SELECT e.id AS edge_id, CASE e.id % 5 WHEN 0 THEN 'RUN' WHEN 1 THEN 'len' WHEN 2 THEN 'order_' || (e.id % 700) WHEN 3 THEN 'x::Push' ELSE 'nobody' END AS name, e.file_id, {_MODULE} AS module, CASE WHEN e.id % 3 = 0 THEN 'Customer#' || lpad(CAST(e.id % 149 AS VARCHAR), 9, '0') END AS owner FROM edge e LEFT JOIN file f ON f.id = e.file_id WHERE kind = 'USAGE' AND e.id % 11 < 3), q AS (SELECT *, {_TAIL.format('name')} AS tail FROM q0)"
_WAYS = """w1 AS (SELECT file_id, name, min(node_id) AS n1 FROM c WHERE file_id IS NOT NULL GROUP BY ALL), w2 AS (SELECT file_id, tail, min(node_id) AS n2 FROM c WHERE file_id IS NOT NULL GROUP BY ALL),
w3 AS (SELECT module, name, min(node_id) AS n3 FROM c WHERE module IS NOT NULL GROUP BY ALL), w4 AS (SELECT module, tail, min(node_id) AS n4 FROM c WHERE module IS NOT NULL GROUP BY ALL),
w5 AS (SELECT owner, tail, min(node_id) AS n5 FROM c WHERE owner IS NOT NULL GROUP BY ALL HAVING count(DISTINCT node_id) = 1), w6 AS (SELECT name, min(node_id) AS n6 FROM c GROUP BY ALL HAVING count(DISTINCT node_id) = 1)"""
_PICK = f"""j AS (SELECT q.edge_id, q.name, n1, n2, n3, n4, n5, CASE WHEN q.owner IS NULL THEN n6 END AS n6 FROM q LEFT JOIN w1 USING (file_id, name) LEFT JOIN w2 ON w2.file_id = q.file_id AND w2.tail = q.tail LEFT JOIN w3 ON w3.module = q.module AND w3.name = q.name LEFT JOIN w4 ON w4.module = q.module AND w4.tail = q.tail LEFT JOIN w5 ON w5.owner = q.owner AND w5.tail = q.tail LEFT JOIN w6 ON w6.name = q.name),
picked AS (SELECT edge_id, name, coalesce(n1, n2, n3, n4, n5, n6) AS node_id, CASE WHEN coalesce(n1, n2) IS NOT NULL THEN 0.95 WHEN coalesce(n3, n4) IS NOT NULL THEN 0.80 WHEN n5 IS NOT NULL THEN 0.95 ELSE 0.62 END AS confidence, CASE WHEN coalesce(n1, n2) IS NOT NULL THEN 'same_file' WHEN coalesce(n3, n4) IS NOT NULL THEN 'same_module' WHEN n5 IS NOT NULL THEN 'owner_member' ELSE 'global_unique' END AS strategy FROM j),
found AS (SELECT edge_id, node_id, CAST(confidence AS DOUBLE) AS confidence, strategy FROM picked WHERE node_id IS NOT NULL AND (name NOT IN ({COMMON}) OR confidence >= 0.85))"""


def _imports(g: Graph) -> DataFrame:
    """Each file asks for the next but one: by a relative name, a scoped name, a dotted name, by its own ending."""
    f = g.file.select(F.col("id").alias("edge_id"), "path")
    stem = F.regexp_replace("path", r"\.[a-z]+$", "")
    ending = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    language = F.when(ending == "py", "python").when(ending == "rs", "rust").otherwise("typescript")
    name = F.when(ending == "py", F.regexp_replace(stem, "/", ".")).when(ending == "rs", F.regexp_replace(F.regexp_replace(stem, "^src/", "crate::"), "/", "::")).otherwise(F.concat(F.lit("./"), F.regexp_extract(stem, "([^/]*)$", 1)))
    return x.import_files(f.select("edge_id", name.alias("name"), F.regexp_extract("path", "^(.*)/", 1).alias("folder"), language.alias("language")), g.file)


def _import_requests(g: Graph) -> DataFrame:
    k = F.col("id")
    e = g.edge.where("kind = 'TYPE_USAGE' and id % 7 < 3")
    name = F.when(k % 4 == 0, "run").when(k % 4 == 1, F.concat(F.lit("order_"), (k % 900).cast("string"))).when(k % 4 == 2, F.concat(F.lit("m::ORDER_"), (k % 900).cast("string"))).otherwise("main")
    return e.select(k.alias("edge_id"), name.alias("name"), "file_id", F.when(k % 5 == 0, F.lit(70_000_000_000) + k % 25).alias("relative")).join(_module(g), "file_id", "left")


_IMPORT = f"""q0 AS (SELECT e.id AS edge_id, CASE e.id % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'order_' || (e.id % 900) WHEN 2 THEN 'm::ORDER_' || (e.id % 900) ELSE 'main' END AS name, e.file_id, {_MODULE} AS module, CASE WHEN e.id % 5 = 0 THEN 70000000000 + e.id % 25 END AS relative FROM edge e LEFT JOIN file f ON f.id = e.file_id WHERE kind = 'TYPE_USAGE' AND e.id % 7 < 3), q AS (SELECT *, {_TAIL.format('name')} AS tail FROM q0), {_CAND}, {_WAYS},
w7 AS (SELECT tail, min(node_id) AS n7 FROM c GROUP BY ALL),
j AS (SELECT edge_id, w2.n2 AS r1, w1.n1 AS r2, CASE WHEN relative IS NULL THEN w3.n3 END AS r3, CASE WHEN relative IS NULL THEN w6.n6 END AS r4, CASE WHEN relative IS NULL THEN w7.n7 END AS r5 FROM q LEFT JOIN w2 ON w2.file_id = q.relative AND w2.tail = q.tail LEFT JOIN w1 ON w1.file_id = q.file_id AND w1.name = q.name LEFT JOIN w3 ON w3.module = q.module AND w3.name = q.name LEFT JOIN w6 ON w6.name = q.name LEFT JOIN w7 ON w7.tail = q.tail)
SELECT edge_id, coalesce(r1, r2, r3, r4, r5) AS node_id, CAST(CASE WHEN r1 IS NOT NULL THEN 0.85 WHEN r2 IS NOT NULL THEN 0.90 WHEN r3 IS NOT NULL THEN 0.75 WHEN r4 IS NOT NULL THEN 0.55 ELSE 0.35 END AS DOUBLE) AS confidence, CASE WHEN r1 IS NOT NULL THEN 'relative' WHEN r2 IS NOT NULL THEN 'same_file' WHEN r3 IS NOT NULL THEN 'same_module' WHEN r4 IS NOT NULL THEN 'global' ELSE 'fuzzy' END AS strategy FROM j WHERE coalesce(r1, r2, r3, r4, r5) IS NOT NULL"""


def _semantic(g: Graph) -> DataFrame:
    family = lambda f: (f % 2).alias("family")
    c = g.node.where("kind = 'METHOD'").select(F.col("id").alias("node_id"), x.tail(F.col("serialized_name")).alias("tail"), family(F.col("file_id")), "file_id")
    q = _calls(g).where("file_id is not null").select("edge_id", x.tail(F.col("name")).alias("tail"), family(F.col("file_id")), "file_id")
    return x.semantic_fallback(q, c)


def _css(g: Graph) -> DataFrame:
    parts = w.components(g.edge.where("kind = 'IMPORT'").select(F.col("source").alias("a"), F.col("target").alias("b")))
    part = lambda f: (F.lit(20_000_000_000) + f - F.lit(70_000_000_000)).alias("part")
    held = lambda kind, name, n: g.node.where(F.col("kind") == kind).select(F.col("id").alias(name), F.concat(F.lit("c"), F.col("id") % n).alias("name"), part(F.col("file_id")))
    return x.component_references(held("CLASS", "edge_id", 60), held("STRUCT", "node_id", 60), parts)


def _changed(g: Graph) -> DataFrame:
    odd = F.concat(F.lit(".\\"), F.regexp_replace(F.upper("path"), "/", "\\\\"))
    return x.changed_files(g.file.where("id % 3 = 1").select(odd.alias("path")), g.file)


def _pass(g: Graph) -> DataFrame:
    return x.resolve_calls(g).edge.where("kind = 'CALL'").select("id", "resolved_target", "confidence")


_STALE = f"st AS (SELECT id, file_id, target_name, CASE WHEN NOT gone THEN resolved_target END AS resolved_target, CASE WHEN NOT gone THEN confidence END AS confidence, CASE WHEN NOT gone THEN certainty END AS certainty FROM (SELECT *, coalesce(confidence < 0.55, false) OR (resolved_target IS NOT NULL AND lower(target_name) IN ({COMMON}) AND coalesce(certainty, {BAND}, '') <> 'certain') AS gone FROM edge WHERE kind = 'CALL'))"

def _whole(g: Graph) -> tuple[Graph, rp.Known]:
    """The graph with an override to look for at each method of a class and an import at each class, and what else its calls are known by."""
    e, k = g.edge, F.col("id")
    none = F.lit(None)
    rest = [none.cast(t).alias(c) for c, t in (("resolved_source", "long"), ("resolved_target", "long"), ("confidence", "double"), ("certainty", "string"))]
    over = e.where("kind = 'MEMBER' and id > 140000000000 and id < 150000000000").select((k + 30_000_000_000).alias("id"), F.lit("OVERRIDE").alias("kind"), F.col("target").alias("source"), "target", *rest, "file_id", "line", "target_name", "caller_path")
    c = F.col("id") - 30_000_000_000
    name = F.when(c % 3 == 0, F.concat(F.lit("order_"), (c * 4).cast("string"))).when(c % 3 == 1, "run").otherwise(F.concat(F.lit("m::ORDER_"), c.cast("string")))
    asks = g.node.where("kind = 'CLASS'").select((k + 150_000_000_000).alias("id"), F.lit("IMPORT").alias("kind"), k.alias("source"), k.alias("target"), *rest, "file_id", F.lit(1).cast("long").alias("line"), name.alias("target_name"), none.cast("string").alias("caller_path"))
    whole = e.drop("ignored").unionByName(over).unionByName(asks)
    calls = e.where("kind = 'CALL'")
    named = g.node.select(k.alias("source"), F.col("serialized_name").alias("class_name"))
    receivers = calls.join(named, "source").select(k.alias("edge_id"), F.when(k % 4 == 0, F.col("class_name")).alias("owner"), (k % 9 == 0).alias("member_call"))
    base = F.lit(50_000_000_000) + k % 700
    likely = calls.where("id % 6 = 1").select(k.alias("edge_id"), base.alias("node_id"), F.when(k % 18 == 1, 0.9).otherwise(0.7).alias("confidence")).unionByName(calls.where("id % 12 = 1").select(k.alias("edge_id"), (base + 1).alias("node_id"), F.lit(0.7).alias("confidence")))
    return Graph(g.node, whole, g.occurrence, g.file, g.error), rp.Known(receivers, g.node.where("kind = 'METHOD' and id % 13 = 0").select(k.alias("node_id")), likely)


def _whole_updates(g: Graph) -> DataFrame:
    return rp.resolve(*_whole(g)).updates.select("edge_id", "kind", "node_id", "confidence", "certainty", "strategy", F.concat_ws(",", F.transform("candidates", lambda x: x.cast("string"))).alias("candidates"))


_WHOLE = rf"""{_STALE}, {_CAND}, {_WAYS},
cf AS (SELECT c.*, regexp_extract(path, '^([^/]*)/', 1) AS root FROM c LEFT JOIN file f ON f.id = c.file_id),
wf AS (SELECT module, owner, tail, min(node_id) AS nf FROM cf WHERE module IS NOT NULL AND owner IS NOT NULL GROUP BY ALL HAVING count(DISTINCT node_id) = 1), wr AS (SELECT root, owner, tail, min(node_id) AS nr FROM cf WHERE root IS NOT NULL AND owner IS NOT NULL GROUP BY ALL HAVING count(DISTINCT node_id) = 1),
q AS (SELECT st.id AS edge_id, e0.target, st.target_name AS name, st.file_id, {_MODULE} AS module, regexp_extract(path, '^([^/]*)/', 1) AS root, CASE WHEN st.id % 4 = 0 THEN s.serialized_name END AS owner, st.id % 9 = 0 AND st.id % 4 <> 0 AS blocked, {_TAIL.format('st.target_name')} AS tail
  FROM st JOIN edge e0 ON e0.id = st.id LEFT JOIN file f ON f.id = st.file_id JOIN node s ON s.id = e0.source WHERE st.resolved_target IS NULL AND st.confidence IS NULL AND st.certainty IS NULL),
sem AS (SELECT id AS edge_id, 50000000000 + id % 700 AS node_id, CASE WHEN id % 18 = 1 THEN 0.9e0 ELSE 0.7e0 END AS conf FROM edge WHERE kind = 'CALL' AND id % 6 = 1 UNION ALL SELECT id, 50000000001 + id % 700, 0.7e0 FROM edge WHERE kind = 'CALL' AND id % 12 = 1),
sl AS (SELECT edge_id, list(node_id ORDER BY conf DESC, node_id) AS likely, CASE WHEN count(*) FILTER (WHERE conf = top) = 1 THEN min(node_id) FILTER (WHERE conf = top) END AS ns, max(conf) AS sc FROM (SELECT *, max(conf) OVER (PARTITION BY edge_id) AS top FROM sem) GROUP BY edge_id),
j AS (SELECT q.*, CASE WHEN q.target % 13 = 0 AND q.target > 50000000000 AND q.target < 60000000000 THEN q.target END AS nb, n1, n2, n3, n4, nf, nr, CASE WHEN q.owner IS NULL THEN n6 END AS n6, ns, sc, coalesce(likely, []) AS likely, q.name IN ({COMMON}) AS common
  FROM q LEFT JOIN w1 ON w1.file_id = q.file_id AND w1.name = q.name LEFT JOIN w2 ON w2.file_id = q.file_id AND w2.tail = q.tail LEFT JOIN w3 ON w3.module = q.module AND w3.name = q.name LEFT JOIN w4 ON w4.module = q.module AND w4.tail = q.tail LEFT JOIN wf ON wf.module = q.module AND wf.owner = q.owner AND wf.tail = q.tail
  LEFT JOIN wr ON wr.root = q.root AND wr.owner = q.owner AND wr.tail = q.tail LEFT JOIN w6 ON w6.name = q.name LEFT JOIN sl ON sl.edge_id = q.edge_id),
k AS (SELECT *, CASE WHEN nb IS NOT NULL THEN 1 WHEN n1 IS NOT NULL THEN 2 WHEN n2 IS NOT NULL THEN 3 WHEN n3 IS NOT NULL AND NOT common THEN 4 WHEN n4 IS NOT NULL AND NOT common THEN 5 WHEN nf IS NOT NULL THEN 6 WHEN nr IS NOT NULL THEN 7 WHEN n6 IS NOT NULL THEN 8 WHEN ns IS NOT NULL AND owner IS NULL AND (NOT common OR sc >= 0.85) THEN 9 END AS s, list_filter(list_concat(likely, [nb, n1, n2, n3, n4, nf, nr, n6]), lambda x: x IS NOT NULL) AS l FROM j),
cc AS (SELECT *, CASE s WHEN 9 THEN sc ELSE [0.95e0, 0.95e0, 0.95e0, 0.8e0, 0.8e0, 0.8e0, 0.95e0, 0.62e0][s] END AS conf FROM k),
calls AS (SELECT edge_id, 'CALL' AS kind, CASE WHEN ok THEN [nb, n1, n2, n3, n4, nf, nr, n6, ns][s] END AS node_id, CASE WHEN ok THEN conf END AS confidence, CASE WHEN ok THEN ['import_binding', 'same_file', 'same_file', 'same_module', 'same_module', 'folder_owner', 'root_owner', 'global_unique', 'semantic'][s] END AS strategy,
  CASE WHEN blocked THEN '' ELSE array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') END AS candidates FROM (SELECT *, NOT blocked AND (NOT common OR coalesce(conf >= 0.85, false)) AS ok FROM cc)),
nm AS (SELECT n.id AS node_id, serialized_name AS name, n.file_id, {_MODULE} AS module, {_TAIL.format('serialized_name')} AS tail FROM node n LEFT JOIN file f ON f.id = n.file_id WHERE kind NOT IN ('FILE', 'MODULE', 'CLASS')),
iq AS (SELECT 150000000000 + n.id AS edge_id, CASE (n.id - 30000000000) % 3 WHEN 0 THEN 'order_' || (n.id - 30000000000) * 4 WHEN 1 THEN 'run' ELSE 'm::ORDER_' || (n.id - 30000000000) END AS name, n.file_id, {_MODULE} AS module FROM node n LEFT JOIN file f ON f.id = n.file_id WHERE kind = 'CLASS'),
ij AS (SELECT edge_id, a.n AS i1, b.n AS i2, d.n AS i3, t.n AS i4 FROM (SELECT *, {_TAIL.format('name')} AS tail FROM iq) iq LEFT JOIN (SELECT file_id, name, min(node_id) AS n FROM nm GROUP BY ALL) a ON a.file_id = iq.file_id AND a.name = iq.name LEFT JOIN (SELECT module, name, min(node_id) AS n FROM nm WHERE module IS NOT NULL GROUP BY ALL) b ON b.module = iq.module AND b.name = iq.name
  LEFT JOIN (SELECT name, min(node_id) AS n FROM nm GROUP BY ALL HAVING count(DISTINCT node_id) = 1) d ON d.name = iq.name LEFT JOIN (SELECT tail, min(node_id) AS n FROM nm GROUP BY ALL) t ON t.tail = iq.tail),
inh AS (SELECT source AS s, target AS t FROM edge WHERE kind = 'INHERITANCE'), anc AS (SELECT s AS type, t AS ancestor FROM inh UNION SELECT anc.type, inh.t FROM anc JOIN inh ON inh.s = anc.ancestor),
mo AS (SELECT n.id, e.source AS owner, regexp_replace(n.serialized_name, '^.*(::|\.)', '') AS short FROM node n JOIN edge e ON e.target = n.id AND e.kind = 'MEMBER' WHERE n.kind = 'METHOD'),
ov AS (SELECT mo.id AS method, count(DISTINCT o2.owner) AS c, min(o2.id) AS overridden FROM mo JOIN anc ON anc.type = mo.owner AND anc.type <> anc.ancestor JOIN mo o2 ON o2.owner = anc.ancestor AND o2.short = mo.short GROUP BY mo.id),
every AS (SELECT * FROM calls UNION ALL SELECT edge_id, 'IMPORT', coalesce(i1, i2, i3, i4), CASE WHEN i1 IS NOT NULL THEN 0.90e0 WHEN i2 IS NOT NULL THEN 0.75e0 WHEN i3 IS NOT NULL THEN 0.55e0 ELSE 0.35e0 END, CASE WHEN i1 IS NOT NULL THEN 'same_file' WHEN i2 IS NOT NULL THEN 'same_module' WHEN i3 IS NOT NULL THEN 'global' ELSE 'fuzzy' END, CAST(coalesce(i1, i2, i3, i4) AS VARCHAR) FROM ij WHERE coalesce(i1, i2, i3, i4) IS NOT NULL
  UNION ALL SELECT e.id + 30000000000, 'OVERRIDE', overridden, 0.95e0, 'ancestor', CAST(overridden AS VARCHAR) FROM edge e JOIN ov ON ov.method = e.target AND ov.c = 1 WHERE e.kind = 'MEMBER' AND e.id > 140000000000 AND e.id < 150000000000)
SELECT edge_id, kind, node_id, confidence, {BAND} AS certainty, strategy, candidates FROM every"""

ALL = {
    "resolution_updates": (_g(_whole_updates), f"WITH RECURSIVE GRAPH, {_WHOLE}"),
    "call_cascade": (_g(lambda g: x.call_cascade(_calls(g), _candidates(g))), f"WITH GRAPH, {_CAND}, {_REQ}, {_WAYS}, {_PICK} SELECT * FROM found"),
    "owner_members": (_g(lambda g: x.owner_members(g)), f"WITH GRAPH, {_CAND} SELECT node_id, name, file_id, owner FROM c"),
    "import_files": (_g(_imports), "WITH GRAPH SELECT id AS edge_id, id AS file_id, path FROM file WHERE NOT path LIKE '%.md'"),
    "import_cascade": (_g(lambda g: x.import_cascade(_import_requests(g), _candidates(g))), f"WITH GRAPH, {_IMPORT}"),
    "semantic_fallback": (_g(_semantic), f"WITH GRAPH, {_CAND}, {_REQ}, k AS (SELECT *, row_number() OVER (PARTITION BY tail, file_id ORDER BY node_id) AS r1, row_number() OVER (PARTITION BY tail, file_id % 2 ORDER BY node_id) AS r2 FROM c), near AS (SELECT q.edge_id, k.node_id, CAST(0.95 AS DOUBLE) AS confidence FROM q JOIN k ON k.file_id = q.file_id AND k.tail = q.tail AND r1 <= 3) SELECT * FROM near UNION ALL SELECT q.edge_id, k.node_id, CAST(0.62 AS DOUBLE) FROM q JOIN k ON k.file_id % 2 = q.file_id % 2 AND k.tail = q.tail AND r2 <= 3 WHERE q.edge_id NOT IN (SELECT edge_id FROM near)"),
    "ancestor_pairs": (_g(lambda g: x.ancestors(g.edge.where("kind = 'INHERITANCE'").select(F.col("source").alias("child"), F.col("target").alias("parent")))), "WITH RECURSIVE GRAPH, inh AS (SELECT source AS s, target AS t FROM edge WHERE kind = 'INHERITANCE'), anc AS (SELECT s AS type, t AS ancestor FROM inh UNION SELECT anc.type, inh.t FROM anc JOIN inh ON inh.s = anc.ancestor) SELECT * FROM anc WHERE type <> ancestor"),
    "override_targets": (_g(x.overrides), "WITH RECURSIVE GRAPH, inh AS (SELECT source AS s, target AS t FROM edge WHERE kind = 'INHERITANCE'), anc AS (SELECT s AS type, t AS ancestor FROM inh UNION SELECT anc.type, inh.t FROM anc JOIN inh ON inh.s = anc.ancestor), own AS (SELECT n.id, e.source AS owner, regexp_replace(n.serialized_name, '^.*(::|\\.)', '') AS short FROM node n JOIN edge e ON e.target = n.id AND e.kind = 'MEMBER' WHERE n.kind = 'METHOD'), h AS (SELECT own.id AS method, count(DISTINCT o2.owner) AS c, min(o2.id) AS overridden FROM own JOIN anc ON anc.type = own.owner AND anc.type <> anc.ancestor JOIN own o2 ON o2.owner = anc.ancestor AND o2.short = own.short GROUP BY own.id) SELECT method, overridden FROM h WHERE c = 1"),
    "component_references": (_g(_css), "WITH GRAPH, root AS (SELECT source AS part, target AS root FROM edge WHERE kind = 'IMPORT'), d AS (SELECT root, 'c' || (id % 60) AS name, min(id) AS node_id FROM node JOIN root ON part = file_id - 50000000000 WHERE kind = 'STRUCT' GROUP BY ALL HAVING count(*) = 1) SELECT n.id AS edge_id, node_id FROM node n JOIN root ON part = n.file_id - 50000000000 JOIN d ON d.root = root.root AND d.name = 'c' || (n.id % 60) WHERE n.kind = 'CLASS'"),
    "changed_files": (_g(_changed), "WITH GRAPH SELECT '.' || chr(92) || replace(upper(path), '/', chr(92)) AS path, id AS file_id FROM file WHERE id % 3 = 1"),
    "edges_in_scope": (_g(lambda g: x.in_scope(g.edge, g.node, g.file.where("id % 6 = 2").select(F.col("id").alias("file_id"))).select("id", "kind")), "WITH GRAPH SELECT id, kind FROM edge WHERE source IN (SELECT id FROM node WHERE file_id IN (SELECT id FROM file WHERE id % 6 = 2))"),
    "updates_applied": (_g(lambda g: x.apply_updates(g.edge, x.call_cascade(_calls(g), _candidates(g)).select("edge_id", "node_id", "confidence")).where("kind = 'USAGE'").select("id", "resolved_target", "confidence")), f"WITH GRAPH, {_CAND}, {_REQ}, {_WAYS}, {_PICK} SELECT id, coalesce(node_id, resolved_target) AS resolved_target, coalesce(found.confidence, edge.confidence) AS confidence FROM edge LEFT JOIN found ON edge_id = id WHERE kind = 'USAGE'"),
    "resolution_pass": (_g(_pass), f"WITH GRAPH, {_STALE}, {_CAND}, q AS (SELECT st.id AS edge_id, target_name AS name, file_id, {_MODULE} AS module, CAST(NULL AS VARCHAR) AS owner, {_TAIL.format('target_name')} AS tail FROM st LEFT JOIN file f ON f.id = st.file_id WHERE resolved_target IS NULL AND confidence IS NULL AND certainty IS NULL), {_WAYS}, {_PICK} SELECT st.id, coalesce(node_id, resolved_target) AS resolved_target, coalesce(found.confidence, st.confidence) AS confidence FROM st LEFT JOIN found ON edge_id = st.id"),
}
__all__ = ["ALL", "EFFECTIVE"]
