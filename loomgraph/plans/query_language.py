"""The piped graph-query language: ``trail(symbol: 'X', depth: 2) | filter(kind: method) | limit(5)``.

Operations: trail, symbol, search, filter, limit. Errors name what is wrong and its offset.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.graph import display_name
from loomgraph.operators.traverse import budgeted_trail
from loomgraph.sources.star_schema import Graph

ARGUMENTS = {"trail": {"symbol", "depth", "direction"}, "symbol": {"query"}, "search": {"query"}, "filter": {"kind", "file", "depth"}, "limit": {"n", "count"}}
#: Nodes that a trail in a query visits at most, and the argument that may stand without a name.
MOST_NODES = 120
FIRST = {"trail": "symbol", "symbol": "query", "search": "query", "limit": "n"}
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][\w-]*)|(\d+)|([(),:|]))")


class QueryError(ValueError):
    def __init__(self, message: str, offset: int) -> None:
        super().__init__(f"{message} at {offset}")
        self.message, self.offset = message, offset

    def shown(self, text: str) -> str:
        """The query, a caret below the place, and what is wrong there."""
        return f"{text}\n{' ' * self.offset}^ {self.message}"


@dataclass
class Operation:
    name: str
    arguments: dict[str, str | int] = field(default_factory=dict)


def parse(text: str) -> list[Operation]:
    tokens: list[tuple[str, str | int, int]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("Unexpected character", at + len(text[at:]) - len(text[at:].lstrip()))
        quoted, name, number, mark = m.groups()
        start = m.start(m.lastindex or 0)
        tokens.append(("value", re.sub(r"\\(.)", r"\1", quoted[1:-1]), start) if quoted else ("name", name, start) if name else ("value", int(number), start) if number else (mark, mark, start))
        at = m.end()
    out: list[Operation] = []
    k = 0

    def need(kind: str, message: str) -> tuple[str, str | int, int]:
        nonlocal k
        if k >= len(tokens):
            raise QueryError(message, len(text))
        if tokens[k][0] != kind:
            raise QueryError(message, tokens[k][2])
        k += 1
        return tokens[k - 1]

    while True:
        _, name, offset = need("name", "Expected an operation")
        if name not in ARGUMENTS:
            raise QueryError(f"Unknown operation `{name}`", offset)
        op = Operation(str(name))
        need("(", "Expected `(`")
        first = True
        while True:
            if k >= len(tokens):
                raise QueryError("Unclosed `(`", len(text))
            if tokens[k][0] == ")":
                k += 1
                break
            if not first:
                need(",", "Expected `,`")
            first = False
            plain = k < len(tokens) and name in FIRST and not op.arguments and tokens[k][0] in ("value", "name") and (k + 1 == len(tokens) or tokens[k + 1][0] != ":")
            if plain:
                op.arguments[FIRST[str(name)]] = tokens[k][1]
                k += 1
                continue
            _, key, where = need("name", "Expected an argument name")
            if key not in ARGUMENTS[str(name)]:
                raise QueryError(f"Unknown `{key}` argument", where)
            need(":", "Expected `:`")
            if k >= len(tokens):
                raise QueryError("Expected a value", len(text))
            if tokens[k][0] not in ("value", "name"):
                raise QueryError("Expected a value", tokens[k][2])
            op.arguments[str(key)] = tokens[k][1]
            k += 1
        out.append(op)
        if k == len(tokens):
            return out
        need("|", "Expected `|`")


def execute(g: Graph, text: str) -> DataFrame:
    """(id, kind, name, depth) of a query; rows are ordered by depth, then id, before a limit. A trail stays in production code."""
    files = g.file.select(F.col("id").alias("file_id"), "path")
    nodes = g.node.select("id", "kind", "serialized_name", display_name().alias("name"), "file_id")
    rows: DataFrame | None = None
    for op in parse(text):
        a = op.arguments
        if op.name in ("symbol", "search"):
            wanted = str(a.get("query", ""))
            hit = F.col("serialized_name") == wanted if op.name == "symbol" else F.lower("name").contains(wanted.lower())
            rows = nodes.where(hit).withColumn("depth", F.lit(0))
        elif op.name == "trail":
            start = nodes.where(F.col("serialized_name") == str(a.get("symbol", ""))).agg(F.min("id")).first()[0]
            reach = budgeted_trail(g, -1 if start is None else start, int(a.get("depth", 2)), str(a.get("direction", "both")).lower(), MOST_NODES, tests=False)
            rows = nodes.join(reach.nodes.select("id", "depth"), "id")
        elif rows is None:
            raise QueryError(f"`{op.name}` needs rows before it", 0)
        elif op.name == "filter":
            if "kind" in a:
                rows = rows.where(F.lower("kind") == str(a["kind"]).lower())
            if "depth" in a:
                rows = rows.where(F.coalesce("depth", F.lit(0)) <= int(a["depth"]))
            if "file" in a:
                rows = rows.join(files.where(F.col("path").contains(str(a["file"]))), "file_id", "left_semi")
        else:
            rows = rows.orderBy("depth", "id").limit(int(a.get("n", a.get("count", 0))))
    assert rows is not None
    return rows.select("id", "kind", "name", "depth")
