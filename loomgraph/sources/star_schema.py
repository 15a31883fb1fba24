"""The code graph's relations built from star-schema tables, stored once a session.

Every operator takes generic frames; this adapter gives them something to run on. Ids are an
offset per kind plus the row's key. The same rules as SQL common table expressions are in
``GRAPH_SQL``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.graph import ignored_resolution
from loomgraph.sources.store import kept, stored, tasks_for

BASE = 10_000_000_000


@dataclass
class Graph:
    """node(id, kind, serialized_name, qualified_name, canonical_id, start_line, end_line, file_id);
    edge(id, kind, source, target, resolved_source, resolved_target, confidence, certainty, file_id,
    line, target_name, caller_path; ignored where stored); occurrence(element_id, file_id, line, end_line, seq);
    file(id, path, language, indexed, complete, size); error(id, file_id, message, fatal, step)."""

    node: DataFrame
    edge: DataFrame
    occurrence: DataFrame
    file: DataFrame
    error: DataFrame | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: int, key: str | Column) -> Column:
    return (F.lit(kind * BASE) + (F.col(key) if isinstance(key, str) else key)).cast("long")


def _node(df: DataFrame, kind: int, label: str, key: str | Column, name: Column, line: Column, file_id: Column) -> DataFrame:
    qualified = F.concat(F.lit(f"{label.lower()}::"), name)
    return df.select(_id(kind, key).alias("id"), F.lit(label).alias("kind"), name.alias("serialized_name"), qualified.alias("qualified_name"), F.concat(F.lit(f"{label.lower()}:"), _id(kind, key).cast("string")).alias("canonical_id"), line.cast("long").alias("start_line"), (line + 3).cast("long").alias("end_line"), file_id.cast("long").alias("file_id"))


def _edge(df: DataFrame, edge_id: Column, kind: str, source: Column, target: Column, file_id: Column, resolved: Column | None = None, confidence: Column | None = None, certainty: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        edge_id.cast("long").alias("id"), F.lit(kind).alias("kind"), source.cast("long").alias("source"), target.cast("long").alias("target"),
        (none if resolved is None else resolved).cast("long").alias("resolved_target"), (none if confidence is None else confidence).cast("double").alias("confidence"),
        (none if certainty is None else certainty).cast("string").alias("certainty"), file_id.cast("long").alias("file_id"),
    )


def with_context(edges: DataFrame, nodes: DataFrame, files: DataFrame, tasks: int) -> DataFrame:
    """Edges with the name of their raw target, which must exist, and the path of their file, if any.

    Both sides are dealt by target over ``tasks`` tasks, so neither join nor sort of one task grows with the graph.
    """
    names = nodes.select(F.col("id").alias("target"), F.col("serialized_name").alias("target_name"))
    named = edges.repartition(tasks, "target").join(names.repartition(tasks, "target"), "target")
    return named.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("caller_path")), "file_id", "left")


def _build(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, its tables written. Lines are shuffled once, for edges and occurrences both."""
    t = lambda name: table(spark, sf_dir, name)
    region, nation, customer, supplier, orders, part, line = map(t, ("region", "nation", "customer", "supplier", "orders", "part", "lineitem"))
    file_of = lambda key: _id(7, key)
    key = F.col("o_orderkey")
    method = F.when(key % 50 == 0, "len").when(key % 50 == 1, "push").when(key % 200 == 2, "main").when(key % 50 == 3, "flush_errors").when(key % 50 == 4, "run").otherwise(F.concat(F.lit("order_"), key.cast("string")))
    module = F.when(F.col("r_regionkey") % 5 == 1, F.concat(F.lit("./"), F.lower("r_name"))).otherwise(F.col("r_name"))
    k = F.col("n_nationkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/core/", "tests/", "vendor/", "docs/", "crates/store/src/", "benches/", "target/", "src/")]), (k % 8 + 1).cast("int"))
    ending = F.element_at(F.array(*[F.lit(x) for x in (".rs", ".py", ".ts", ".md", ".rs")]), (k % 5 + 1).cast("int"))
    path = F.when(k == 7, "src/main.rs").when(k == 15, "src/index.ts").otherwise(F.concat(folder, F.regexp_replace(F.lower("n_name"), " ", "_"), ending))
    files = nation.select(
        file_of("n_nationkey").alias("id"), path.alias("path"), F.when(k % 2 == 0, "rust").otherwise("python").alias("language"), (k % 7 != 6).alias("indexed"), (k % 6 != 5).alias("complete"),
        (k * 1000 + 500).cast("long").alias("size"),
    )
    nodes = [
        _node(region, 1, "MODULE", "r_regionkey", module, F.lit(1), file_of("r_regionkey")),
        _node(nation, 2, "NAMESPACE", "n_nationkey", F.col("n_name"), F.lit(1), file_of("n_nationkey")),
        _node(customer, 3, "CLASS", "c_custkey", F.col("c_name"), F.col("c_custkey") % 997 + 2, file_of("c_nationkey")),
        _node(supplier, 4, "STRUCT", "s_suppkey", F.col("s_name"), F.col("s_suppkey") % 991 + 2, file_of("s_nationkey")),
        _node(orders, 5, "METHOD", "o_orderkey", method, key % 983 + 2, file_of(F.col("o_custkey") % 25)),
        _node(part, 6, "FIELD", "p_partkey", F.col("p_name"), F.col("p_partkey") % 977 + 2, file_of(F.col("p_partkey") % 25)),
        _node(nation.select("n_nationkey", path.alias("path")), 7, "FILE", "n_nationkey", F.col("path"), F.lit(1), file_of("n_nationkey")),
        _node(region, 7, "FILE", F.col("r_regionkey") + 100, F.concat(F.lit("lost/"), F.lower("r_name")), F.lit(1), file_of(F.col("r_regionkey") + 100)),
    ]
    priority = F.substring("o_orderpriority", 1, 1)
    confidence = F.when(priority == "1", 0.95).when(priority == "2", 0.80).when(priority == "3", 0.62).when(priority == "4", 0.35)
    resolved = F.when(confidence.isNotNull() | (key % 2 == 0), _id(5, key - key % 3))
    certainty = F.when(key % 17 == 0, "certain").when(key % 19 == 0, "uncertain")
    member = lambda n, child: F.lit(n * BASE) + child
    supplies = line.select("l_partkey", "l_suppkey").distinct()
    # Counts of whole tables come from the files' footers.
    n_line, n_orders, n_customer, n_part = (df.count() for df in (line, orders, customer, part))
    # Line numbers repeat within an order; one line of each number stands for a usage.
    line = line.repartition(tasks_for(spark, n_line), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")])
    number = F.col("l_linenumber").cast("long")
    line = stored(line.select(_id(6, "l_partkey").alias("element_id"), file_of(F.col("l_suppkey") % 25).alias("file_id"), number.alias("line"), (number + F.col("l_orderkey") % 4).alias("end_line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_orderkey", "l_returnflag"), "file_id", "line")
    cust = F.col("c_custkey")
    edges = [
        _edge(nation, member(11, k), "MEMBER", _id(1, "n_regionkey"), _id(2, "n_nationkey"), file_of("n_nationkey")),
        _edge(customer.where("c_custkey % 4 <> 0"), member(12, cust), "MEMBER", _id(2, "c_nationkey"), _id(3, "c_custkey"), file_of("c_nationkey")),
        _edge(supplier, member(13, F.col("s_suppkey")), "MEMBER", _id(2, "s_nationkey"), _id(4, "s_suppkey"), file_of("s_nationkey")),
        _edge(orders.where("o_orderkey % 3 = 0"), member(14, key), "MEMBER", _id(3, "o_custkey"), _id(5, "o_orderkey"), file_of(F.col("o_custkey") % 25)),
        _edge(customer.where("c_custkey > 1"), member(15, cust), "INHERITANCE", _id(3, "c_custkey"), _id(3, F.floor((cust + 1) / 2)), file_of("c_nationkey")),
        _edge(nation, member(16, k), "IMPORT", _id(2, "n_nationkey"), _id(1, (k + 1) % 5), file_of("n_nationkey")),
        _edge(orders, F.lit(20 * BASE) + key, "CALL", _id(3, "o_custkey"), _id(5, "o_orderkey"), file_of(F.col("o_custkey") % 25), resolved, confidence, certainty),
        _edge(line, F.lit(30 * BASE) + F.col("seq"), "USAGE", _id(5, "l_orderkey"), F.col("element_id"), F.col("file_id"), F.when(F.col("l_returnflag") == "N", F.col("element_id"))),
        _edge(supplies, F.lit(40 * BASE) + F.col("l_partkey") * 10_000 + F.col("l_suppkey"), "TYPE_USAGE", _id(6, "l_partkey"), _id(4, "l_suppkey"), file_of(F.col("l_partkey") % 25)),
    ]
    occurrence = line.select("element_id", "file_id", "line", "end_line", "seq")
    error = t("events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 60 != 0, file_of(F.col("user_id") % 25)).cast("long").alias("file_id"), F.col("event_type").alias("message"),
        (F.col("event_id") % 100 == 0).alias("fatal"), F.when(F.col("event_id") % 40 == 0, "parse").otherwise("resolve").alias("step"),
    )
    node = stored(reduce(DataFrame.unionByName, nodes).repartition(tasks_for(spark, n_orders + n_customer + n_part), "id"), "kind", "id")
    edge = with_context(reduce(DataFrame.unionByName, edges), node, files, tasks_for(spark, n_line + 2 * (n_orders + n_customer)))
    edge = edge.withColumns({"resolved_source": F.lit(None).cast("long"), "line": (F.col("id") % 89 + 1).cast("long"), "ignored": ignored_resolution()})
    return Graph(node, stored(edge, "kind", "source"), occurrence, files, error)


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder of tables, as an index keeps it: written on first use in an application, sorted by kind and source."""

    def build() -> Graph:
        g = _build(spark, sf_dir)
        g.edge._loomgraph_adjacency = f"adjacency:{sf_dir}"  # type: ignore[attr-defined]  # these edges, not frames made of them
        return g

    return kept(spark, f"graph:{sf_dir}", build)


GRAPH_SQL = """
file AS (
  SELECT 70000000000 + n_nationkey AS id, CASE WHEN n_nationkey = 7 THEN 'src/main.rs' WHEN n_nationkey = 15 THEN 'src/index.ts' ELSE ['src/core/','tests/','vendor/','docs/','crates/store/src/','benches/','target/','src/'][n_nationkey % 8 + 1] || replace(lower(n_name), ' ', '_') || ['.rs','.py','.ts','.md','.rs'][n_nationkey % 5 + 1] END AS path,
    CASE WHEN n_nationkey % 2 = 0 THEN 'rust' ELSE 'python' END AS language, n_nationkey % 7 <> 6 AS indexed, n_nationkey % 6 <> 5 AS complete, CAST(n_nationkey * 1000 + 500 AS BIGINT) AS size FROM nation),
line AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL),
node0 AS (
  SELECT 10000000000 + r_regionkey AS id, 'MODULE' AS kind, CASE WHEN r_regionkey % 5 = 1 THEN './' || lower(r_name) ELSE r_name END AS serialized_name, CAST(1 AS BIGINT) AS start_line, 70000000000 + r_regionkey AS file_id FROM region
  UNION ALL SELECT 20000000000 + n_nationkey, 'NAMESPACE', n_name, 1, 70000000000 + n_nationkey FROM nation
  UNION ALL SELECT 30000000000 + c_custkey, 'CLASS', c_name, c_custkey % 997 + 2, 70000000000 + c_nationkey FROM customer
  UNION ALL SELECT 40000000000 + s_suppkey, 'STRUCT', s_name, s_suppkey % 991 + 2, 70000000000 + s_nationkey FROM supplier
  UNION ALL SELECT 50000000000 + o_orderkey, 'METHOD', CASE WHEN o_orderkey % 50 = 0 THEN 'len' WHEN o_orderkey % 50 = 1 THEN 'push' WHEN o_orderkey % 200 = 2 THEN 'main' WHEN o_orderkey % 50 = 3 THEN 'flush_errors' WHEN o_orderkey % 50 = 4 THEN 'run' ELSE 'order_' || o_orderkey END, o_orderkey % 983 + 2, 70000000000 + o_custkey % 25 FROM orders
  UNION ALL SELECT 60000000000 + p_partkey, 'FIELD', p_name, p_partkey % 977 + 2, 70000000000 + p_partkey % 25 FROM part
  UNION ALL SELECT id, 'FILE', path, 1, id FROM file
  UNION ALL SELECT 70000000100 + r_regionkey, 'FILE', 'lost/' || lower(r_name), 1, 70000000100 + r_regionkey FROM region),
node AS (SELECT id, kind, serialized_name, lower(kind) || '::' || serialized_name AS qualified_name, lower(kind) || ':' || id AS canonical_id, start_line, start_line + 3 AS end_line, file_id FROM node0),
call_edge AS (
  SELECT o_orderkey AS k, o_custkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.95 WHEN '2' THEN 0.80 WHEN '3' THEN 0.62 WHEN '4' THEN 0.35 END AS c FROM orders),
edge0 AS (
  SELECT 110000000000 + n_nationkey AS id, 'MEMBER' AS kind, 10000000000 + n_regionkey AS source, 20000000000 + n_nationkey AS target, CAST(NULL AS BIGINT) AS resolved_target, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS certainty, 70000000000 + n_nationkey AS file_id FROM nation
  UNION ALL SELECT 120000000000 + c_custkey, 'MEMBER', 20000000000 + c_nationkey, 30000000000 + c_custkey, NULL, NULL, NULL, 70000000000 + c_nationkey FROM customer WHERE c_custkey % 4 <> 0
  UNION ALL SELECT 130000000000 + s_suppkey, 'MEMBER', 20000000000 + s_nationkey, 40000000000 + s_suppkey, NULL, NULL, NULL, 70000000000 + s_nationkey FROM supplier
  UNION ALL SELECT 140000000000 + o_orderkey, 'MEMBER', 30000000000 + o_custkey, 50000000000 + o_orderkey, NULL, NULL, NULL, 70000000000 + o_custkey % 25 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 150000000000 + c_custkey, 'INHERITANCE', 30000000000 + c_custkey, 30000000000 + (c_custkey + 1) // 2, NULL, NULL, NULL, 70000000000 + c_nationkey FROM customer WHERE c_custkey > 1
  UNION ALL SELECT 160000000000 + n_nationkey, 'IMPORT', 20000000000 + n_nationkey, 10000000000 + (n_nationkey + 1) % 5, NULL, NULL, NULL, 70000000000 + n_nationkey FROM nation
  UNION ALL SELECT 200000000000 + k, 'CALL', 30000000000 + o_custkey, 50000000000 + k, CASE WHEN c IS NOT NULL OR k % 2 = 0 THEN 50000000000 + k - k % 3 END, c, CASE WHEN k % 17 = 0 THEN 'certain' WHEN k % 19 = 0 THEN 'uncertain' END, 70000000000 + o_custkey % 25 FROM call_edge
  UNION ALL SELECT 300000000000 + l_orderkey * 10 + l_linenumber, 'USAGE', 50000000000 + l_orderkey, 60000000000 + l_partkey, CASE WHEN l_returnflag = 'N' THEN 60000000000 + l_partkey END, NULL, NULL, 70000000000 + l_suppkey % 25 FROM line
  UNION ALL SELECT DISTINCT 400000000000 + l_partkey * 10000 + l_suppkey, 'TYPE_USAGE', 60000000000 + l_partkey, 40000000000 + l_suppkey, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), 70000000000 + l_partkey % 25 FROM lineitem),
edge AS (
  SELECT e.*, e.id % 89 + 1 AS line, t.serialized_name AS target_name, f.path AS caller_path FROM edge0 e JOIN node t ON t.id = e.target LEFT JOIN file f ON f.id = e.file_id),
occurrence AS (
  SELECT 60000000000 + l_partkey AS element_id, 70000000000 + l_suppkey % 25 AS file_id, CAST(l_linenumber AS BIGINT) AS line, l_linenumber + l_orderkey % 4 AS end_line, l_orderkey * 10 + l_linenumber AS seq FROM line),
error AS (
  SELECT event_id AS id, CASE WHEN event_id % 60 <> 0 THEN 70000000000 + user_id % 25 END AS file_id, event_type AS message, event_id % 100 = 0 AS fatal, CASE WHEN event_id % 40 = 0 THEN 'parse' ELSE 'resolve' END AS step FROM events)
"""
