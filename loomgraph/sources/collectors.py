"""Anchors in structural sources: headings, keys, tables, selectors, services, jobs, routes.

A collector is a plain function from a text to units (kind, role, name, line, parent); files are
spread over tasks and read one at a time, so memory holds one text. What a format's own parser
refuses gives one unit of role ``malformed`` and nothing else.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.markup import Lines

Unit = tuple[str, str, str, int, str | None]
_BLANKS = re.compile(r"\s*")
SHAPE = "path string, ordinal int, kind string, role string, name string, line int, parent string"
#: Elements that divide a page.
REGIONS = ("header", "nav", "main", "section", "article", "aside", "footer", "form", "dialog", "template")


def _lines(text: str) -> Iterator[tuple[int, str]]:
    return enumerate(text.splitlines(), 1)


def _unquoted(s: str) -> str:
    s = s.strip()
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def markdown(text: str) -> list[Unit]:
    """Headings, labels of fences, link references; nothing inside an open fence."""
    out: list[Unit] = []
    fence = ""
    for n, line in _lines(text):
        bare = line.strip()
        mark = re.match(r"(`{3,}|~{3,})\s*([^`\s]*)", bare)
        if fence:
            fence = "" if re.fullmatch(re.escape(fence[0]) + "{%d,}" % len(fence), bare) else fence
        elif mark:
            fence = mark[1]
            if mark[2]:
                out.append(("ANNOTATION", "fence", mark[2], n, None))
        elif heading := re.match(r"#{1,6}\s+(.*?)\s*#*$", bare):
            out.append(("MODULE", "heading", heading[1], n, None))
        elif reference := re.match(r"\[([^\]]+)\]:\s*\S", bare):
            out.append(("ANNOTATION", "reference", reference[1], n, None))
    return out


def yaml(text: str) -> list[Unit]:
    """Mapping keys; block scalars and comments are passed over."""
    out: list[Unit] = []
    scalar: int | None = None
    for n, line in _lines(text):
        code = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        depth = _indent(line)
        if scalar is not None:
            if not code.strip() or depth > scalar:
                continue
            scalar = None
        bare = code.strip()
        if not bare or bare.startswith(("---", "...")):
            continue
        if re.search(r":\s*[|>][+\-0-9]*$", bare):
            scalar = depth
        key = re.match(r"""(?:- )*((?:"[^"]*"|'[^']*'|[^:"'{\[]+?))\s*:(?:\s|$)""", bare)
        if key and key[1] != "<<" and _unquoted(key[1]):
            out.append(("ANNOTATION", "mapping-key", _unquoted(key[1]), n, None))
    return out


def toml(text: str) -> list[Unit]:
    """Tables and keys of a text that parses."""
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return [("UNKNOWN", "malformed", str(e)[:200], 1, None)]
    out: list[Unit] = []
    table, quote = None, ""
    for n, line in _lines(text):
        if quote:
            quote = "" if quote in line else quote
            continue
        bare = line.strip()
        if header := re.match(r"\[\[?\s*([^\]]+?)\s*\]\]?", bare):
            table = _unquoted(header[1])
            out.append(("MODULE", "table", table, n, None))
        elif key := re.match(r"""((?:"[^"]*"|'[^']*'|[\w.\-]+)(?:\s*\.\s*[\w\-]+)*)\s*=""", bare):
            out.append(("ANNOTATION", "key", _unquoted(key[1]), n, table))
        for q in ('"""', "'''"):
            if bare.count(q) == 1:
                quote = q
    return out


def json_keys(text: str) -> list[Unit]:
    """Keys of one or more whole JSON values, in their order."""
    decoder, at = json.JSONDecoder(), 0
    try:
        while at < len(text):
            at = _BLANKS.match(text, at).end()  # type: ignore[union-attr]
            if at < len(text):
                _, at = decoder.raw_decode(text, at)
        if not text.strip():
            raise ValueError("no value")
    except ValueError as e:
        return [("UNKNOWN", "malformed", str(e)[:200], 1, None)]
    found, lines = re.finditer(r'"((?:[^"\\]|\\.)*)"(\s*:)?', text), Lines(text)
    return [("ANNOTATION", "key", m[1], lines.at(m.start())[0], None) for m in found if m[2]]


def shell(text: str) -> list[Unit]:
    """Functions, aliases and sourced files; here documents, comments and strings over lines are passed over."""
    out: list[Unit] = []
    ends: list[tuple[str, bool]] = []
    for n, line in _lines(text):
        if ends:
            word, tabs = ends[0]
            if (line.lstrip("\t") if tabs else line).rstrip() == word:
                ends.pop(0)
            continue
        code = re.sub(r"(^|\s)#.*$", "", line)
        ends += [(m[2], m[1] == "-") for m in re.finditer(r"<<(-?)\s*[\"']?(\w+)[\"']?", code)]
        bare = code.strip()
        if m := re.match(r"(?:function\s+([\w:\-]+)|([\w:\-]+)\s*\(\s*\))", bare):
            out.append(("FUNCTION", "function", m[1] or m[2], n, None))
        elif m := re.match(r"alias\s+([\w\-]+)=", bare):
            out.append(("ANNOTATION", "alias", m[1], n, None))
        elif m := re.match(r"(?:source|\.)\s+(\S+)", bare):
            out.append(("MODULE", "source", _unquoted(m[1]), n, None))
    return out


def powershell(text: str) -> list[Unit]:
    """Functions, classes and imported modules outside comments."""
    out: list[Unit] = []
    text = re.sub(r"<#.*?#>", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    for n, line in _lines(text):
        bare = re.sub(r"(^|\s)#.*$", "", line).strip()
        if m := re.match(r"(function|filter|class)\s+([\w:\-]+)", bare, re.I):
            out.append(("CLASS" if m[1].lower() == "class" else "FUNCTION", m[1].lower(), m[2], n, None))
        elif m := re.match(r"Import-Module\s+(\S+)", bare, re.I):
            out.append(("MODULE", "import", _unquoted(m[1]), n, None))
    return out


def html(text: str) -> list[Unit]:
    """Regions; ids, each once, and classes, under the nearest region at or above; scripts and styles."""
    out: list[Unit] = []
    region: str | None = None
    seen: set[str] = set()
    for n, line in _lines(text):
        if m := re.search(rf"<({'|'.join(REGIONS)})\b", line, re.I):
            region = f"{m[1].lower()}:{n}"
            out.append(("MODULE", "region", region, n, None))
        for m in re.finditer(r"""\sid\s*=\s*["']([^"']+)["']""", line):
            if m[1] not in seen:
                seen.add(m[1])
                out.append(("CONSTANT", "id", m[1], n, region))
        for m in re.finditer(r"""\sclass\s*=\s*["']([^"']+)["']""", line):
            out += [("CONSTANT", "class", c, n, region) for c in m[1].split()]
        for m in re.finditer(r"""<(script|link)\b[^>]*?\s(?:src|href)\s*=\s*["']([^"']+)["']""", line, re.I):
            out.append(("MODULE", m[1].lower(), m[2], n, region))
    return out


def css(text: str) -> list[Unit]:
    """Imports, selectors' classes and ids, custom properties with their uses, keyframes; comments are blanked in place."""
    text = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out: list[Unit] = []
    lines = Lines(text)
    line_of = lambda at: lines.at(at)[0]
    for m in re.finditer(r"""@import\s+(?:url\()?["']?([^"')\s;]+)|@keyframes\s+([\w\-]+)|(--[\w\-]+)\s*:|var\(\s*(--[\w\-]+)|([^{};@]+)\{""", text):
        n = line_of(m.start())
        if m[1]:
            out.append(("MODULE", "import", m[1], n, None))
        elif m[2]:
            out.append(("CONSTANT", "keyframes", m[2], n, None))
        elif m[3] or m[4]:
            out.append(("CONSTANT", "property" if m[3] else "property-use", m[3] or m[4], n, None))
        else:
            start = m.start(5) + len(m[5]) - len(m[5].lstrip())
            out += [("CONSTANT", "class" if s[0] == "." else "id", s[1:], line_of(start), None) for s in re.findall(r"[.#][A-Za-z_][\w\-]*", m[5])]
    return out


def sql(text: str) -> list[Unit]:
    """Schemas, tables, their columns, foreign keys to tables of the same text (declared before or after), indexes, views."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    name = r"((?:[\w]+|\"[^\"]+\"|`[^`]+`)(?:\.(?:[\w]+|\"[^\"]+\"|`[^`]+`))?)"
    clean = lambda s: re.sub(r"[\"`]", "", s)
    lines = Lines(text)
    line_of = lambda at: lines.at(at)[0]
    tables = {clean(m[1]).lower() for m in re.finditer(rf"create\s+(?:temp\w*\s+)?table\s+(?:if\s+not\s+exists\s+)?{name}", text, re.I)}
    out: list[Unit] = []
    for m in re.finditer(rf"create\s+(?:or\s+replace\s+)?(?:unique\s+)?(?:temp\w*\s+)?(schema|table|view|index)\s+(?:if\s+not\s+exists\s+)?{name}(?:\s+on\s+{name})?", text, re.I):
        what, own = m[1].lower(), clean(m[2])
        kind = {"schema": "NAMESPACE", "table": "CLASS", "view": "CLASS", "index": "ANNOTATION"}[what]
        out.append((kind, what, own, line_of(m.start()), clean(m[3]) if m[3] else None))
        if what != "table" or "(" not in text[m.end() :]:
            continue
        at = text.index("(", m.end())
        depth, start, end = 0, at + 1, at
        parts: list[tuple[int, str]] = []
        for end in range(at, len(text)):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if depth == 0 or (depth == 1 and text[end] == ","):
                parts.append((start, text[start:end]))
                start = end + 1
            if depth == 0:
                break
        for where, part in parts:
            head = re.match(r"\s*[\"`]?(\w+)", part)
            if head and head[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key"):
                out.append(("FIELD", "column", head[1], line_of(where + head.start(1)), own))
            for key in re.finditer(rf"references\s+{name}", part, re.I):
                if clean(key[1]).lower() in tables:
                    out.append(("ANNOTATION", "foreign-key", clean(key[1]), line_of(where + key.start()), own))
    return out


def _section(text: str, name: str) -> Iterator[tuple[int, int, str]]:
    """(line, depth, bare text) of what stands below a top-level key."""
    inside = False
    for n, line in _lines(text):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if _indent(line) == 0:
            inside = bare.rstrip() == f"{name}:"
        elif inside:
            yield n, _indent(line), bare


def compose(text: str) -> list[Unit]:
    """Services of a compose file with their images and ports; a text without services has none."""
    out: list[Unit] = []
    depth, service = None, None
    for n, at, bare in _section(text, "services"):
        depth = at if depth is None else depth
        if at == depth and bare.endswith(":"):
            service = _unquoted(bare[:-1])
            out.append(("MODULE", "service", service, n, None))
        elif service and (m := re.match(r"(image|build|container_name)\s*:\s*(\S+)", bare)):
            out.append(("ANNOTATION", m[1], _unquoted(m[2]), n, service))
    return out


def workflow(text: str) -> list[Unit]:
    """The workflow's name, its jobs, and the named or used steps of each."""
    out: list[Unit] = []
    if m := re.search(r"^name\s*:\s*(.+)$", text, re.M):
        out.append(("MODULE", "workflow", _unquoted(m[1]), text.count("\n", 0, m.start()) + 1, None))
    depth, job = None, None
    for n, at, bare in _section(text, "jobs"):
        depth = at if depth is None else depth
        if at == depth and bare.endswith(":"):
            job = bare[:-1]
            out.append(("FUNCTION", "job", job, n, None))
        elif job and (m := re.match(r"-\s+(name|uses)\s*:\s*(.+)$", bare)):
            out.append(("ANNOTATION", "step", _unquoted(m[2]), n, job))
    return out


def cargo(text: str) -> list[Unit]:
    """Package, dependencies by table, features and workspace members."""
    try:
        whole = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return [("UNKNOWN", "malformed", str(e)[:200], 1, None)]
    package = whole.get("package", {}).get("name")
    found = [("PACKAGE", "package", package, None)] if package else []
    found += [("MODULE", "workspace-member", m, None) for m in whole.get("workspace", {}).get("members", [])]
    found += [("ANNOTATION", table, d, package) for table in ("dependencies", "dev-dependencies", "build-dependencies") for d in whole.get(table, {})]
    found += [("ANNOTATION", "feature", f, package) for f in whole.get("features", {})]
    return [(k, r, v, next((n for n, line in _lines(text) if v in line), 1), p) for k, r, v, p in found]


#: How routes are written, by framework, as (language ending, pattern with method and path).
ROUTES = {"fastapi": (r"\.py$", r"@\w+\.(get|post|put|patch|delete)\(\s*[\"']([^\"']+)"), "express": (r"\.[jt]sx?$", r"\b(?:app|router)\.(get|post|put|patch|delete|all)\(\s*[\"'`]([^\"'`]+)"), "fastify": (r"\.[jt]sx?$", r"\bfastify\.(get|post|put|patch|delete)\(\s*[\"'`]([^\"'`]+)")}


def routes(text: str, path: str) -> list[Unit]:
    """(method and path) of the routes that a source declares, each with its framework as parent."""
    out: list[Unit] = []
    for n, line in _lines(text):
        for framework, (ending, pattern) in ROUTES.items():
            if re.search(ending, path) and (m := re.search(pattern, line)):
                out.append(("ANNOTATION", "route", f"{m[1].upper()} {m[2]}", n, framework))
    return out


COLLECTORS: dict[str, Callable[[str], list[Unit]]] = {"markdown": markdown, "yaml": yaml, "toml": toml, "json": json_keys, "shell": shell, "bash": shell, "powershell": powershell, "html": html, "css": css, "sql": sql}
#: Files told by name before their ending.
NAMED = ((r"(^|/)(docker-)?compose[^/]*\.ya?ml$", compose), (r"(^|/)\.github/workflows/[^/]+\.ya?ml$", workflow), (r"(^|/)Cargo\.toml$", cargo))


def units_of(path: str, language: str | None, text: str) -> list[Unit]:
    for pattern, own in NAMED:
        if re.search(pattern, path):
            return own(text)
    found = COLLECTORS[language](text) if language in COLLECTORS else []
    return found + routes(text, path)


def collect(sources: DataFrame) -> DataFrame:
    """Units of sources (path, language, text), numbered in each by their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, k, *u) for path, language, text in zip(b["path"], b["language"], b["text"]) for k, u in enumerate(units_of(path, language, text or ""), 1)]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "kind", "role", "name", "line", "parent"])

    return sources.select("path", "language", "text").mapInPandas(run, SHAPE)


def discover(spark: SparkSession, folder: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """(path, size, text) of the files below a folder, sorted; texts over the size are listed without being read into a column."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    text = F.decode("content", "UTF-8")
    if most_bytes is not None:
        text = F.when(F.col("length") <= most_bytes, text)
    return files.select("path", F.col("length").alias("size"), text.alias("text")).orderBy("path")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, standard, includes, defines) of a compile_commands.json, by whole arguments or a command line."""
    shape = "directory string, file string, command string, arguments array<string>"
    c = spark.read.schema(shape).json(path, multiLine=True)
    words = F.coalesce("arguments", F.split("command", r"\s+"))
    joined = F.array_join(words, " ")
    pick = lambda flag: F.regexp_extract_all(joined, F.lit(rf"(?:^|\s)-{flag}\s?(\S+)"), F.lit(1))
    return c.select("file", F.regexp_extract(joined, r"-std=(\S+)", 1).alias("standard"), pick("I").alias("includes"), pick("D").alias("defines"))
