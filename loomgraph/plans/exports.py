"""Graphs as text: JSON rows, DOT and Mermaid lines, a Markdown report. Lines are made where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.graph import display_name
from loomgraph.operators.relational import bridges, entry_points, hotspots, neutralised
from loomgraph.sources.star_schema import Graph


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def json_rows(g: Graph) -> DataFrame:
    """(line): every node and edge as one JSON object."""
    node = F.to_json(F.struct(F.lit("node").alias("type"), "id", "kind", display_name().alias("name")))
    edge = F.to_json(F.struct(F.lit("edge").alias("type"), "id", "kind", "src", "dst"))
    return g.node.select(node.alias("line")).unionByName(neutralised(g.edge).select(edge.alias("line")))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(id, line) of DOT for edges (id, kind, src, dst); a caller sets them between ``digraph {`` and ``}``."""
    return edges.select("id", F.concat(_quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [label="), _quoted(F.col("kind")), F.lit("];")).alias("line"))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line) of a Mermaid flowchart: nodes (id, name), then edges (id, kind, src, dst)."""
    name = F.regexp_replace("name", '"', "#quot;")
    n = nodes.select(F.struct(F.lit(0).alias("part"), F.col("id").alias("id")).alias("ord"), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit('["'), name, F.lit('"]')).alias("line"))
    e = edges.select(F.struct(F.lit(1).alias("part"), F.col("id").alias("id")).alias("ord"), F.concat(F.lit("n"), F.col("src").cast("string"), F.lit(" -->|"), "kind", F.lit("| n"), F.col("dst").cast("string")).alias("line"))
    return n.unionByName(e).select("ord.part", "ord.id", "line")


def mermaid_sequence(steps: DataFrame) -> DataFrame:
    """(ord, line) of a Mermaid sequence of steps (ord, source, target, kind)."""
    clean = lambda c: F.regexp_replace(c, r"[^\w.]", "_")
    return steps.select("ord", F.concat(clean("source"), F.lit("->>"), clean("target"), F.lit(": "), "kind").alias("line"))


def mermaid_gantt(stages: DataFrame) -> DataFrame:
    """(ord, line) of a Mermaid gantt of stages (ord, name, start_ms, length_ms)."""
    return stages.select("ord", F.concat(F.regexp_replace("name", "[:;#]", " "), F.lit(" :"), F.lit("s"), F.col("ord").cast("string"), F.lit(", "), F.col("start_ms").cast("string"), F.lit(", "), F.col("length_ms").cast("string"), F.lit("ms")).alias("line"))


def markdown_report(g: Graph, limit: int = 10) -> str:
    """Hotspots, entry points and bridges as a Markdown text; the lists are short by ``limit``."""
    out = ["# Graph report"]
    for title, rows in (("Hotspots", hotspots(g, limit)), ("Entry points", entry_points(g, limit)), ("Bridges", bridges(g, limit))):
        out += ["", f"## {title}", "", "| name | kind | in | out |", "| --- | --- | --- | --- |"]
        out += [f"| {r['name'].replace('|', chr(92) + '|')} | {r['kind']} | {r['incoming']} | {r['outgoing']} |" for r in rows.collect()]
    return "\n".join(out) + "\n"
