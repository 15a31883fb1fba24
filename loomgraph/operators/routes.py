"""Routes of web frameworks, by what their receivers are bound to at that line.

A small scanner turns each source into events: imports, assignments, mounts and routes, at module scope and
outside of strings and comments over several lines. What a name stands for at a line is its last binding before, a window over the events
of its file and name; so a name that is bound anew, or to something else, no longer declares what it did before. A
receiver's prefix is put before its routes, and before that those of the receivers it is mounted under, join by join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.store import written, written_rows

#: What constructs a receiver, and the methods that declare a route.
RECEIVERS = {"fastapi.FastAPI": "fastapi", "fastapi.APIRouter": "fastapi", "express": "express", "express.Router": "express", "fastify": "fastify"}
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
#: Mounts that are followed upwards.
MOST_MOUNTS = 8
_SHAPE = "path string, line int, event string, name string, target string, member string, literal string, handler string"
_S = r"(?:\"([^\"\\]*)\"|'([^'\\]*)'|`([^`\\$]*)`)"
_PY_FROM, _PY_IMPORT = re.compile(r"from\s+(fastapi)\s+import\s+\(?([^)#]*)\)?"), re.compile(r"import\s+(fastapi)(?:\s+as\s+(\w+))?\s*(?:#.*)?$")
_JS_REQUIRE, _JS_IMPORT = re.compile(r"(?:const|let|var)\s+(?:(\w+)|\{([^}]*)\})\s*=\s*require\(\s*[\"'](express|fastify)[\"']\s*\)"), re.compile(r"import\s+(?:(?:\*\s+as\s+)?(\w+))?\s*,?\s*(?:\{([^}]*)\})?\s*from\s*[\"'](express|fastify)[\"']")
_ASSIGN = re.compile(r"(?:(?:export\s+)?(?:const|let|var)\s+)?(\w+)(?:\s*:\s*[\w.]+)?\s*=(?!=)\s*(?:(\w+)(?:\.(\w+))?\s*\(([^\n]*))?")
_PREFIX = re.compile(r"prefix\s*[=:]\s*" + _S)
_MOUNT_PY, _MOUNT_USE, _MOUNT_REGISTER = re.compile(r"(\w+)\.include_router\(\s*(\w+)\s*(.*)"), re.compile(r"(\w+)\.use\(\s*" + _S + r"\s*,\s*(\w+)\s*\)"), re.compile(r"(\w+)\.register\(\s*(\w+)\s*(.*)")
_ROUTE = re.compile(r"(@?)(\w+)\.(" + "|".join(METHODS) + r")\(\s*" + _S + r"\s*(?:,\s*([A-Za-z_][\w.]*)(?=\s*[,)]))?")


def _literal(*groups: str | None) -> str | None:
    return next((g for g in groups if g is not None), None)


def _members(text: str) -> Iterator[tuple[str, str]]:
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        own = re.split(r"\s+as\s+|\s*:\s*", part)
        yield own[-1], own[0]


def _statements(text: str, python: bool) -> Iterator[tuple[int, str]]:
    """Lines at module scope that are neither in a comment nor in a string over several lines."""
    marks = re.compile(r'"""|\'\'\'') if python else re.compile(r"/\*|`")
    inside = ""
    for n, line in enumerate(text.splitlines(), 1):
        at, whole = 0, not inside
        while True:
            if inside:
                end = line.find(inside, at)
                if end < 0:
                    break
                at, inside = end + len(inside), ""
            found = marks.search(line, at)
            if not found:
                break
            inside, at = ("*/" if found[0] == "/*" else found[0]), found.end()
        if whole and line[:1].strip() and not line.startswith(("#", "//")):
            yield n, line


def events_of(text: str, python: bool) -> Iterator[tuple]:
    """(line, event, name, target, member, literal, handler) of a source."""
    for n, line in _statements(text, python):
        if python and (m := _PY_FROM.match(line)):
            yield from ((n, "import", alias, f"{m[1]}.{member}", None, None, None) for alias, member in _members(m[2]))
        elif python and (m := _PY_IMPORT.match(line)):
            yield n, "import", m[2] or m[1], m[1], None, None, None
        elif not python and ((m := _JS_REQUIRE.match(line)) or (m := _JS_IMPORT.match(line))):
            if m[1]:
                yield n, "import", m[1], m[3], None, None, None
            yield from ((n, "import", alias, f"{m[3]}.{member}", None, None, None) for alias, member in _members(m[2]))
        elif m := _ASSIGN.match(line):
            prefix = _PREFIX.search(m[4] or "")
            yield n, "assign", m[1], m[2], m[3], _literal(*prefix.groups()) if prefix else None, None
        elif python and (m := _MOUNT_PY.match(line)):
            prefix = _PREFIX.search(m[3])
            yield n, "mount", m[1], m[2], None, _literal(*prefix.groups()) if prefix else None, None
        elif not python and (m := _MOUNT_USE.match(line)):
            yield n, "mount", m[1], m[5], None, _literal(m[2], m[3], m[4]), None
        elif not python and (m := _MOUNT_REGISTER.match(line)):
            prefix = _PREFIX.search(m[3])
            yield n, "mount", m[1], m[2], None, _literal(*prefix.groups()) if prefix else None, None
        elif (m := _ROUTE.match(line)) and bool(m[1]) == python:
            yield n, "route", m[2], None, m[3].upper(), _literal(m[4], m[5], m[6]), m[7]


def events(sources: DataFrame) -> DataFrame:
    """The events of sources (path, text), by the ending of their path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *e) for path, text in zip(b["path"], b["text"]) for e in events_of(text or "", path.endswith(".py"))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SHAPE.split(", ")])

    known = sources.where(F.col("path").rlike(r"\.(py|[cm]?[jt]sx?)$"))
    return known.select("path", "text").mapInPandas(run, _SHAPE)


def as_of(uses: DataFrame, bindings: DataFrame, value: str, strictly: bool = True) -> DataFrame:
    """``uses`` (path, line, name, ...) with the ``value`` of their name's last binding before, null where there is none."""
    left = uses.select(F.struct(*uses.columns).alias("use"), "path", "line", "name", F.lit(None).alias(value), F.lit(0 if strictly else 2).alias("turn"))
    right = bindings.select(F.lit(None).alias("use"), "path", "line", "name", F.struct(value).alias(value), F.lit(1).alias("turn"))
    before = Window.partitionBy("path", "name").orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, -1)
    both = left.unionByName(right).withColumn("seen", F.last(value, ignorenulls=True).over(before))
    return both.where("use is not null").select("use.*", F.col("seen").getField(value).alias(value))


def _owned(uses: DataFrame, owners: DataFrame) -> DataFrame:
    """Uses with the receiver that their name stands for, as (owner, framework)."""
    found = as_of(uses, owners.select("path", "line", "name", F.struct(F.col("line").alias("owner"), "framework").alias("receiver")), "receiver")
    return found.select("*", "receiver.owner", "receiver.framework").drop("receiver").where("framework is not null")


def routes(sources: DataFrame) -> DataFrame:
    """(path, line, framework, method, route, handler): a row for each way that a route can be reached."""
    e = written(events(sources))
    imports = e.where("event in ('import', 'assign')").select("path", "line", "name", F.when(F.col("event") == "import", F.col("target")).alias("stands"))
    made = e.where("event = 'assign'").select("path", "line", F.coalesce("target", F.lit("")).alias("name"), F.col("name").alias("own"), "member", "literal")
    made = as_of(made, imports, "stands")
    built = F.when(F.col("member").isNull(), F.col("stands")).otherwise(F.concat("stands", F.lit("."), "member"))
    framework: Column = reduce(lambda w, k: w.when(built == k, RECEIVERS[k]), RECEIVERS, F)  # type: ignore[arg-type,assignment]
    # Every binding counts, also one to something else: it ends what the name stood for.
    owners = made.select("path", "line", F.col("own").alias("name"), framework.alias("framework"), F.coalesce("literal", F.lit("")).alias("prefix"))
    other = e.where("event = 'import'").select("path", "line", "name", F.lit(None).cast("string").alias("framework"), F.lit("").alias("prefix"))
    owners = written(owners.unionByName(other))
    receivers = owners.where("framework is not null")
    mounts = e.where("event = 'mount'").select("path", "line", "name", "target", F.coalesce("literal", F.lit("")).alias("literal"))
    mounts = _owned(mounts, owners).select("path", "line", F.col("target").alias("name"), "literal", F.col("owner").alias("parent"))
    mounts = written(_owned(mounts, owners).select("path", "parent", F.col("owner").alias("child"), "literal").where("parent <> child"))
    own = receivers.select("path", F.col("line").alias("owner"), "prefix")
    roots = own.join(mounts.select("path", F.col("child").alias("owner")), ["path", "owner"], "left_anti")
    placed = level = roots.select("path", "owner", F.col("prefix").alias("full"))
    for _ in range(MOST_MOUNTS):
        below = level.join(mounts.withColumnRenamed("parent", "owner"), ["path", "owner"]).select("path", F.col("child").alias("owner"), F.concat("full", "literal").alias("base"))
        level, n = written_rows(below.join(own, ["path", "owner"]).select("path", "owner", F.concat("base", "prefix").alias("full")))
        if not n:
            break
        placed = placed.unionByName(level)
    declared = _owned(e.where("event = 'route'").select("path", "line", "name", F.col("member").alias("method"), "literal", "handler"), owners)
    return declared.join(placed, ["path", "owner"]).select("path", "line", "framework", "method", F.concat("full", "literal").alias("route"), "handler")
