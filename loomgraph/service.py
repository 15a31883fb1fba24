"""The engine's public calls over a stored graph: one method a tool, each a frame or a short answer.

Defaults and bounds are those that callers of the tools rely on; a bound beyond its range is held in it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.graph import display_name, indexable
from loomgraph.functions.paths import file_role, test_or_bench
from loomgraph.operators import grounding, inventory, ranks, relational, roots, search, traverse
from loomgraph.operators.adjacency import adjacency_of
from loomgraph.operators.shortest import Ways, ways
from loomgraph.plans import exports, planner
from loomgraph.plans.query_language import execute
from loomgraph.sources.star_schema import Graph

#: Defaults and bounds of walks as (depth, greatest depth, nodes, most nodes).
NEAR, SUBGRAPH, PATH = (1, 3, 50, 120), (2, 3, 80, 120), (6, 10, 80, 200)
MAX_EDGES, IMPACT_NODES, IMPACT_ROWS, OCCURRENCES = 2000, 200, 100, 50


def held(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


@dataclass
class Hits:
    """Rows of an answered query, kept for the next who asks the same of the same index."""

    most: int = 64
    kept: OrderedDict[str, list] = field(default_factory=OrderedDict)

    def get(self, key: str, make) -> list:  # noqa: ANN001
        if key not in self.kept:
            self.kept[key] = make()
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]


@dataclass
class Service:
    graph: Graph
    index: search.Index | Callable[[], search.Index] | None = None
    vectors: DataFrame | None = None
    texts: DataFrame | None = None
    generation: str = "live"
    answers: Hits = field(default_factory=Hits)

    @property
    def spark(self) -> SparkSession:
        return self.graph.node.sparkSession

    def _id(self, symbol: str | int) -> int | None:
        """The node that a name or id stands for, the best target where several have the name."""
        if isinstance(symbol, int):
            return symbol
        row = ranks.resolve_target(symbol, self._named(), shown=1).first()
        return row["id"] if row else None

    def _named(self) -> DataFrame:
        f = self.graph.file.select(F.col("id").alias("file_id"), "path")
        n = self.graph.node.where(indexable()).join(f, "file_id", "left")
        return n.select("id", F.col("serialized_name").alias("name"), "path", "kind", F.col("start_line").alias("line"))

    # Orientation

    def status(self) -> DataFrame:
        return grounding.store_counts(self.graph)

    def ground(self, budget: str = "balanced") -> DataFrame:
        return roots.snapshot(self.graph, budget)

    def report(self, limit: int = 10) -> str:
        return exports.markdown_report(self.graph, limit)

    def files(self, contains: str = "", language: str | None = None, role: str | None = None, limit: int = 100) -> DataFrame:
        return inventory.indexed_files(self.graph, contains, language, role, limit)

    # Symbols

    def symbol(self, name: str, limit: int = 10) -> DataFrame:
        return ranks.browse_rank(name, self._named().where(ranks.squeezed(F.col("name")).contains(ranks.squeezed(F.lit(name)))), limit)

    def get_node(self, symbol: str | int) -> DataFrame:
        return self.graph.node.where(F.col("id") == F.lit(self._id(symbol)))

    def definition(self, symbol: str | int) -> DataFrame:
        f = self.graph.file.select(F.col("id").alias("file_id"), "path")
        return self.get_node(symbol).join(f, "file_id", "left").select("id", "kind", display_name().alias("name"), "path", "start_line", "end_line")

    def references(self, symbol: str | int, most: int = 100) -> DataFrame:
        """Edges that lead to the symbol, those of the first ``most`` nodes by their first edge."""
        return direct_references(self.graph, self._id(symbol), most)

    def symbols(self, path: str, limit: int = 100) -> DataFrame:
        n = self._named().where(F.col("path") == path)
        return n.orderBy("line", "name", "id").limit(limit).select("id", "name", "kind", "line")

    def children(self, symbol: str | int) -> DataFrame:
        return relational.children(self.graph, self._id(symbol))

    def snippet(self, path: str, line: int, context: int = 4) -> DataFrame:
        assert self.texts is not None, "the service holds no texts"
        return inventory.snippet(self.texts.where(F.col("path") == path), line, context)

    # Walks

    def trail(self, symbol: str | int, depth: int = 2, direction: str = "both", max_nodes: int = 500, kinds: list[str] | None = None, node_kinds: list[str] | None = None, tests: bool = False, utility: bool = False, sure: bool = False) -> traverse.Trail:
        """A walk without noise; ``sure`` also hides what is no more than a guess."""
        t = traverse.budgeted_trail(self.graph, -1 if (n := self._id(symbol)) is None else n, depth, direction, held(max_nodes, 10, 100_000), kinds, node_kinds, tests, utility)
        t = traverse.without_noise(t)
        return traverse.without_speculation(t) if sure else t

    def _near(self, symbol: str | int, direction: str, depth: int, nodes: int, kinds: list[str] | None, bounds: tuple[int, int, int, int] = NEAR) -> traverse.Trail:
        return self.trail(symbol, held(depth, 1, bounds[1]), direction, held(nodes, 10, bounds[3]), kinds)

    def callers(self, symbol: str | int, depth: int = NEAR[0], nodes: int = NEAR[2]) -> traverse.Trail:
        return self._near(symbol, "incoming", depth, nodes, ["CALL"])

    def callees(self, symbol: str | int, depth: int = NEAR[0], nodes: int = NEAR[2]) -> traverse.Trail:
        return self._near(symbol, "outgoing", depth, nodes, ["CALL"])

    def neighbors(self, symbol: str | int, depth: int = NEAR[0], nodes: int = NEAR[2]) -> traverse.Trail:
        return self._near(symbol, "both", depth, nodes, None)

    def query_subgraph(self, symbol: str | int, depth: int = SUBGRAPH[0], nodes: int = SUBGRAPH[2], kinds: list[str] | None = None) -> traverse.Trail:
        return self._near(symbol, "both", depth, nodes, kinds, SUBGRAPH)

    def shortest_path(self, source: str | int, target: str | int, depth: int = PATH[0], max_nodes: int = 500, kinds: list[str] | None = None, tests: bool = True, utility: bool = True) -> Ways:
        """One shortest path, and the nodes and edges on ways of at most ``depth`` steps, as many as asked for."""
        a, b = self._id(source), self._id(target)
        return ways(self.graph, -1 if a is None else a, -1 if b is None else b, held(depth, 1, PATH[1]), held(max_nodes, 10, 100_000), kinds, None, tests, utility)

    def trace(self, symbol: str | int, depth: int = 2) -> DataFrame:
        """The story of a walk: its steps by what they tell."""
        return traverse.story(self.trail(symbol, depth).edges)

    def neighborhood(self, symbol: str | int, most: int = 400) -> DataFrame:
        return owner_context(self.graph, self._id(symbol), held(most, 1, MAX_EDGES))

    # Change

    def affected(self, paths: DataFrame, depth: int = 2, like: str = "") -> DataFrame:
        from loomgraph.operators.resolution import changed_files

        files = changed_files(paths, self.graph.file).select("file_id")
        changed = self.graph.node.join(files, "file_id", "left_semi").select("id")
        return grounding.affected_listing(grounding.affected(self.graph, changed, held(depth, 1, 8)), like)

    def workflow(self, symbol: str | int, depth: int = 2, tests: bool = False) -> dict[str, DataFrame]:
        """What depends on a symbol, what a change of its file may affect, and where it occurs; in test-map mode with tests."""
        node = -1 if (n := self._id(symbol)) is None else n
        t = self.trail(node, held(depth, 1, 8), "incoming", held(IMPACT_NODES, 1, 200), tests=tests, sure=True)
        own = self.graph.node.where(F.col("id") == node).select("file_id")
        changed = self.graph.node.join(own, "file_id", "left_semi").select("id")
        reach = grounding.affected(self.graph, changed, held(depth, 1, 8))
        return {"dependents": t.nodes, "affected": (reach.where("test") if tests else reach).orderBy("distance", "id").limit(IMPACT_ROWS), "occurrences": self.graph.occurrence.where(F.col("element_id") == node).orderBy("seq").limit(OCCURRENCES)}

    # Search

    def search(self, query: str, limit: int = 10, vector: list[float] | None = None) -> list:
        """Ranked hits that pass the query's filters, with how well their name answers it; the same query of one generation is answered once."""
        assert self.index is not None and self.vectors is not None, "the service holds no index"
        limit = held(limit, 1, 50)
        intent = planner.parse_intent(query)
        key = hashlib.sha256(repr((self.generation, query, limit, vector)).encode()).hexdigest()

        def rows() -> list:
            index = self.index() if callable(self.index) else self.index
            hits = search.search(search.Corpus(index, self.graph, self.vectors), intent.text, vector, 4 * limit)  # type: ignore[arg-type]
            hits = hits.withColumn("name", F.coalesce("symbol", "path")).where(search.passes(intent)).withColumn("id", F.col("node_id"))
            unique = ranks.unique_inexact(intent.text, hits.withColumn("position", F.col("place")))
            return unique.orderBy("place").limit(limit).withColumn("quality", search.match_quality(intent.text, F.col("name"))).select("place", "node_id", "path", "name", "kind", "score", "quality").collect()

        return self.answers.get(key, rows)

    def search_plan(self, query: str, limit: int = 10) -> dict[str, list]:
        """Subqueries of a question (at most 8), each one's hits, and which of their symbols share a file."""
        features = planner.classify(query)
        parts = list(dict.fromkeys([query, *features.exact_symbols, *features.paths, *features.concepts]))[:9]
        found = {p: self.search(p, limit) for p in parts}
        seeds = list(dict.fromkeys((r["node_id"], r["path"]) for rows in found.values() for r in rows if r["node_id"] is not None))[:32]
        places: dict[str, list[int]] = {}
        for node, path in seeds:
            places.setdefault(path, []).append(node)
        return {"subqueries": parts[1:], "hits": [r for rows in found.values() for r in rows], "bridges": [(path, ids) for path, ids in sorted(places.items()) if len(ids) > 1]}

    def bridges(self, pairs: list[tuple[int, int]], most: int = 80) -> list[tuple[int, int, str, int]]:
        """(source, target, evidence, nodes): a sure way between the nodes of each pair, or a file that both are in."""
        file_of = {r["id"]: r["file_id"] for r in self.graph.node.where(F.col("id").isin([n for p in pairs for n in p])).select("id", "file_id").collect()}
        out = []
        for a, b in pairs:
            way = traverse.path_subgraph(self.graph.edge.where(~traverse.speculative()), a, b, 0).where("depth is not null")
            n = held(way.count(), 0, most)
            if n > 1:
                out.append((a, b, "graph_path", n))
            elif file_of.get(a) is not None and file_of.get(a) == file_of.get(b):
                out.append((a, b, "shared_file", 2))
        return out

    def query(self, text: str) -> DataFrame:
        return execute(self.graph, text)

    def context(self, symbol: str | int) -> dict[str, DataFrame]:
        return {"definition": self.definition(symbol), "children": self.children(symbol), "neighborhood": self.neighborhood(symbol)}

    def packet(self, question: str, limit: int = 10, max_bytes: int = 16_000) -> dict[str, object]:
        """The class of a question, its terms, and the citations that answer it, within a number of bytes."""
        cites = self.spark.createDataFrame(
            [(r["node_id"], r["name"], r["path"], r["kind"], float(r["score"]), r["node_id"] is not None, r["node_id"] is not None) for q in packet_queries(question) for r in self.search(q, limit)] or [],
            "id long, name string, path string, kind string, score double, indexed boolean, resolvable boolean",
        )
        one = cites.dropDuplicates(["id", "path", "name"]).withColumn("score", ranks.citation_score()).withColumn("protected", F.lit(False))
        kept = ranks.capped(one.select("id", "name", "path", "score", "protected"), limit, limit)
        lines = kept.orderBy(F.desc("score"), "path", "name").withColumn("text", F.concat_ws(" ", "name", "path")).collect()
        out, size = [], 0
        for r in lines:
            size += len(r["text"].encode())
            if size > max_bytes:
                break
            out.append((r["name"], r["path"], r["score"]))
        task = self.spark.range(1).select(ranks.task_class(F.lit(question)).alias("t")).first()["t"]
        return {"class": task, "terms": packet_terms(question), "citations": out}


def packet_terms(question: str, most: int = 12) -> list[str]:
    """Quoted spans of a question, then symbols it spells out, then its further concepts."""
    import re

    f = planner.classify(question)
    quoted = [b for _, b in re.findall(r"([`\"'])([^`\"']+)\1", question)]
    return list(dict.fromkeys([*quoted, *f.exact_symbols, *f.roles, *f.structures, *f.concepts]))[:most]


def packet_queries(question: str, most: int = 6) -> list[str]:
    """The question itself, the paths and symbols it names, and its terms: what a packet searches for."""
    f = planner.classify(question)
    return list(dict.fromkeys([question, *f.paths, *f.exact_symbols, *packet_terms(question)]))[:most]


def direct_references(g: Graph, node: int | None, most: int, kinds: list[str] | None = None, tests: bool = True) -> DataFrame:
    """(id, kind, src) of edges to a node from others, those of the first ``most`` sources by their first edge."""
    e = adjacency_of(g.edge).steps("incoming", kinds, tests).at([-1 if node is None else node]).where("next <> at")
    few = e.groupBy("next").agg(F.min("id").alias("first")).orderBy("first").limit(most).select("next")
    return e.join(few, "next", "left_semi").select("id", "kind", "src")


def owner_context(g: Graph, node: int | None, most: int) -> DataFrame:
    """(id, kind, src, dst): the edges at a node; for one that is a member also where its owners inherit and override. The first by id."""
    e = relational.neutralised(g.edge).select("id", "kind", "src", "dst")
    own = e.where((F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node)))
    owners = e.where((F.col("kind") == "MEMBER") & (F.col("dst") == F.lit(node))).select(F.col("src").alias("owner"))
    ties = e.where("kind in ('INHERITANCE', 'OVERRIDE')")
    of_owner = ties.join(owners, F.col("src") == F.col("owner"), "left_semi").unionByName(ties.join(owners, F.col("dst") == F.col("owner"), "left_semi"))
    return own.unionByName(of_owner).dropDuplicates(["id"]).orderBy("id").limit(most)


def test_map(g: Graph) -> DataFrame:
    """(path, tests): for each file of the sources how many test files lead to it by an edge."""
    f = g.file.select(F.col("id").alias("file_id"), "path")
    at = g.node.join(f, "file_id").select("id", "path")
    e = relational.neutralised(g.edge).select("src", "dst")
    by = e.join(at.where(test_or_bench(F.col("path"))).select(F.col("id").alias("src"), F.col("path").alias("test")), "src")
    to = by.join(at.where(file_role(F.col("path")).isin("source", "entrypoint")).select(F.col("id").alias("dst"), "path"), "dst")
    return to.groupBy("path").agg(F.count_distinct("test").alias("tests"))
