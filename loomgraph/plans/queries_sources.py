"""Structural collectors on sources made from the tables, so that SQL knows what they must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import route_languages
from loomgraph.operators import routes as ro
from loomgraph.sources import collectors as c
from loomgraph.sources import markup as m
from loomgraph.sources.star_schema import table

NUMBER, NAME = "{k}", "{n}"
#: ending of the path: (text with the nation's number and name, expected units as (kind, role, name, line, parent)).
SOURCES = {
    "notes.md": ("intro\n# Nation {k} #\n```rust\n# hidden\n```\ntext\n## {n}\n[ref{k}]: http://x", [("MODULE", "heading", "Nation {k}", 2, None), ("ANNOTATION", "fence", "rust", 3, None), ("MODULE", "heading", "{n}", 7, None), ("ANNOTATION", "reference", "ref{k}", 8, None)]),
    "conf.yml": ("# c\nname: {n}\nitems:\n  - id: {k}\n    run: |\n      not: key\n  - 'quoted key': 1\nurl: http://a:80", [("ANNOTATION", "mapping-key", "name", 2, None), ("ANNOTATION", "mapping-key", "items", 3, None), ("ANNOTATION", "mapping-key", "id", 4, None), ("ANNOTATION", "mapping-key", "run", 5, None), ("ANNOTATION", "mapping-key", "quoted key", 7, None), ("ANNOTATION", "mapping-key", "url", 8, None)]),
    "conf.toml": ('top{k} = 1\n[table.{n}]\nkey = """\n[not]\nx = 1\n"""\n"other" = 2', [("ANNOTATION", "key", "top{k}", 1, None), ("MODULE", "table", "table.{n}", 2, None), ("ANNOTATION", "key", "key", 3, "table.{n}"), ("ANNOTATION", "key", "other", 7, "table.{n}")]),
    "bad.toml": ("a = = {k}", [("UNKNOWN", "malformed", "Invalid value (at line 1, column 5)", 1, None)]),
    "data.json": ('{"a{k}": [1, {"b": "c:"}],\n "{n}": null}', [("ANNOTATION", "key", "a{k}", 1, None), ("ANNOTATION", "key", "b", 1, None), ("ANNOTATION", "key", "{n}", 2, None)]),
    "run.sh": ("# f() {\nfunction f{k} {\n  cat <<EOF\ng() {\nEOF\n}\nh{k}() { :; }\nalias ll='ls'\nsource ./lib{k}.sh", [("FUNCTION", "function", "f{k}", 2, None), ("FUNCTION", "function", "h{k}", 7, None), ("ANNOTATION", "alias", "ll", 8, None), ("MODULE", "source", "./lib{k}.sh", 9, None)]),
    "run.ps1": ("<#\nfunction Hidden {}\n#>\nfunction Get-{n} {\n}\nclass C{k} {}\nImport-Module Az.{k}", [("FUNCTION", "function", "Get-{n}", 4, None), ("CLASS", "class", "C{k}", 6, None), ("MODULE", "import", "Az.{k}", 7, None)]),
    "page.html": ("<html>\n<p id='top{k}'>\n<main>\n<div id=\"a\" class=\"x y{k}\">\n<p id=\"a\">\n<script src=\"{n}.js\"></script>", [("CONSTANT", "id", "top{k}", 2, None), ("MODULE", "region", "main:3", 3, None), ("CONSTANT", "id", "a", 4, "main:3"), ("CONSTANT", "class", "x", 4, "main:3"), ("CONSTANT", "class", "y{k}", 4, "main:3"), ("MODULE", "script", "{n}.js", 6, "main:3")]),
    "style.css": ("@import 'base{k}.css';\n/* .gone {\n} */\n.a{k} #b {\n --c{k}: 1;\n color: var(--c{k});\n}\n@keyframes spin{k} {", [("MODULE", "import", "base{k}.css", 1, None), ("CONSTANT", "class", "a{k}", 4, None), ("CONSTANT", "id", "b", 4, None), ("CONSTANT", "property", "--c{k}", 5, None), ("CONSTANT", "property-use", "--c{k}", 6, None), ("CONSTANT", "keyframes", "spin{k}", 8, None)]),
    "ddl.sql": ("CREATE SCHEMA s{k};\nCREATE TABLE a{k} (id INT, -- note\n b_id INT REFERENCES b{k}(id),\n c INT REFERENCES gone(id));\nCREATE TABLE b{k} (id INT, PRIMARY KEY (id));\nCREATE INDEX i{k} ON a{k} (id);", [("NAMESPACE", "schema", "s{k}", 1, None), ("CLASS", "table", "a{k}", 2, None), ("FIELD", "column", "id", 2, "a{k}"), ("FIELD", "column", "b_id", 3, "a{k}"), ("ANNOTATION", "foreign-key", "b{k}", 3, "a{k}"), ("FIELD", "column", "c", 4, "a{k}"), ("CLASS", "table", "b{k}", 5, None), ("FIELD", "column", "id", 5, "b{k}"), ("ANNOTATION", "index", "i{k}", 6, "a{k}")]),
    "docker-compose.yml": ("version: '3'\nservices:\n  web{k}:\n    image: nginx:{k}\n    ports:\n      - 80\n  db:\n    build: .\nvolumes:\n  web{k}:", [("MODULE", "service", "web{k}", 3, None), ("ANNOTATION", "image", "nginx:{k}", 4, "web{k}"), ("MODULE", "service", "db", 7, None), ("ANNOTATION", "build", ".", 8, "db")]),
    ".github/workflows/ci.yml": ("name: Build {k}\non: push\njobs:\n  build{k}:\n    steps:\n      - uses: actions/checkout\n      - name: Test {n}\n  lint:\n    steps: []", [("MODULE", "workflow", "Build {k}", 1, None), ("FUNCTION", "job", "build{k}", 4, None), ("ANNOTATION", "step", "actions/checkout", 6, "build{k}"), ("ANNOTATION", "step", "Test {n}", 7, "build{k}"), ("FUNCTION", "job", "lint", 8, None)]),
    "Cargo.toml": ('[package]\nname = "crate{k}"\n[dependencies]\nserde = "1"\n[dev-dependencies]\nquick = "2"\n[features]\nfast{k} = []', [("PACKAGE", "package", "crate{k}", 2, None), ("ANNOTATION", "dependencies", "serde", 4, "crate{k}"), ("ANNOTATION", "dev-dependencies", "quick", 6, "crate{k}"), ("ANNOTATION", "feature", "fast{k}", 8, "crate{k}")]),
    "api.py": ("@app.get('/items/{k}')\ndef f(): ...\n@router.post(\"/{n}\")", [("ANNOTATION", "route", "GET /items/{k}", 1, "fastapi"), ("ANNOTATION", "route", "POST /{n}", 3, "fastapi")]),
    "api.ts": ("app.get('/a{k}', f);\nfastify.put(`/b`, g);", [("ANNOTATION", "route", "GET /a{k}", 1, "express"), ("ANNOTATION", "route", "PUT /b", 2, "fastify")]),
}


def _filled(text: str) -> Column:
    out = F.lit(text)
    return F.replace(F.replace(out, F.lit(NUMBER), F.col("n_nationkey").cast("string")), F.lit(NAME), F.col("n_name"))


def sources(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    text, _ = SOURCES[ending]
    made = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/" + ending)).alias("path"), _filled(text).alias("text"))
    return route_languages(made)


def _quoted(text: str) -> str:
    made = "'" + text.replace("'", "''") + "'"
    return f"replace(replace({made}, '{{k}}', CAST(n_nationkey AS VARCHAR)), '{{n}}', n_name)"


def _expected(ending: str) -> str:
    rows = [f"SELECT 'n' || n_nationkey || '/{ending}' AS path, {k} AS ordinal, '{kind}' AS kind, '{role}' AS role, {_quoted(name)} AS name, {line} AS line, {_quoted(parent) if parent else 'CAST(NULL AS VARCHAR)'} AS parent FROM nation" for k, (kind, role, name, line, parent) in enumerate(SOURCES[ending][1], 1)]
    return " UNION ALL ".join(rows)


def _query(ending: str):  # noqa: ANN202
    return lambda spark, sf_dir: c.collect(sources(spark, sf_dir, ending))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are, with attributes on their scripts, and with tags over lines and in other case."""
    html, k = F.coalesce("html", F.lit("")), F.col("page_id") % 3
    marked = F.replace(html, F.lit("<script>"), F.lit(_MARKED))
    broken = F.replace(F.replace(html, F.lit("<script>"), F.lit("<SCRIPT\n async>")), F.lit("</script>"), F.lit("</Script >"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(k == 1, marked).when(k == 2, broken).otherwise(html).alias("text"))


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, k = F.coalesce("html", F.lit("")), F.col("page_id") % 3
    inline = F.replace(html, F.lit("<h1>"), F.lit(_INLINE))
    fenced = F.concat(F.lit("---\nconst id = "), F.col("page_id").cast("string"), F.lit(";\n---\n"), html)
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(F.lit("vue"), F.lit("svelte"), F.lit("astro")), (k + 1).cast("int")).alias("dialect"), F.when(k == 1, inline).when(k == 2, fenced).otherwise(html).alias("text"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = m.page_units(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), "|")
    return u.groupBy("page_id", "role").agg(F.count(F.lit(1)).alias("n"), F.md5(names.cast("binary")).alias("names"))


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<p>x</p>\n<script>let a = "), F.col("n_nationkey").cast("string"), F.lit(";\n</script>\ny"))
    return m.scripts_of_pages(table(spark, sf_dir, "nation").select("n_nationkey", page.alias("text")), "n_nationkey").select("n_nationkey", F.col("script").alias("text"))


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source a customer, with a line an order: routes, receivers bound anew or to something else, and mounts."""
    o, key, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string"), F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kinds = lambda *rows: F.element_at(F.array(*rows), (F.col("o_orderkey") % 5 + 1).cast("int"))
    python = kinds(text('@r.get("/o', key, '")'), text('r = APIRouter(tags=["x"], prefix="/n', key, '")'), text("r = other(", key, ")"), text('app.include_router(r, prefix="/api', key, '")'), text("@app.post('/a", key, "')"))
    script = kinds(text('r.get("/o', key, '", h', key, ");"), F.lit("r = express.Router();"), text("r = other(", key, ");"), text('app.use("/api', key, '", r);'), text("app.post('/a", key, "', h", key, ");"))
    lines = o.groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.when(k % 2 == 1, python).otherwise(script).alias("line")))).alias("rows"))
    head = F.when(F.col("k") % 2 == 1, text('"""\n@app.get("/no")\n"""\nfrom fastapi import APIRouter, FastAPI\napp = FastAPI()\nr = APIRouter(prefix="/c', F.col("k").cast("string"), '")\n')).otherwise('/*\napp.get("/no", h);\n*/\nconst express = require("express");\nconst app = express();\nlet r = express.Router();\n')
    return lines.select(F.concat(F.lit("c"), F.col("k").cast("string"), F.when(F.col("k") % 2 == 1, ".py").otherwise(".js")).alias("path"), F.concat(head, F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("text"))


_MARKED, _INLINE = "<script type=\"module\" data-x='a>b' lang=\"ts\">", "<h1>{title + \"}\"}{#if x}"
_BLANK = r"regexp_replace({0}, '[^\n\r]', ' ', 'g')"
_IN = lambda text: "'" + text.replace("'", "''") + "'"
#: Each page's text, what opens and closes its script, and where.
_PAGES = rf"""p AS (
  SELECT page_id, page_id % 3 AS k, CASE page_id % 3 WHEN 1 THEN replace(html, '<script>', {_IN(_MARKED)}) WHEN 2 THEN replace(replace(html, '<script>', '<SCRIPT' || chr(10) || ' async>'), '</script>', '</Script >') ELSE html END AS text,
    CASE page_id % 3 WHEN 1 THEN {_IN(_MARKED)} WHEN 2 THEN '<SCRIPT' || chr(10) || ' async>' ELSE '<script>' END AS opening, CASE page_id % 3 WHEN 2 THEN '</Script >' ELSE '</script>' END AS closing FROM pages WHERE html IS NOT NULL),
a AS (SELECT *, strpos(text, opening) - 1 + length(opening) AS start, strpos(text, '<style>') + 6 AS style_start, strpos(text, closing) - 1 AS stop, strpos(text, '</style>') - 1 AS style_stop FROM p)"""

ALL = {f"collect_{ending.replace('.github/workflows/', 'workflow_').replace('-', '_').replace('.', '_').lower()}": (_query(ending), _expected(ending)) for ending in SOURCES}
ALL["blanked_regions"] = (_blanked, "SELECT n_nationkey, repeat(' ', 8) || chr(10) || repeat(' ', 8) || 'let a = ' || n_nationkey || ';' || chr(10) || repeat(' ', 9) || chr(10) || ' ' AS text FROM nation")
ALL |= {
    "page_regions": (lambda s, d: m.embedded_regions(_pages(s, d), "page_id"), rf"""WITH {_PAGES}
SELECT page_id, CAST(1 AS INTEGER) AS ordinal, 'style' AS kind, CAST(style_start AS INTEGER) AS start, CAST(1 AS INTEGER) AS line, CAST(style_start + 1 AS INTEGER) AS col, CAST(NULL AS VARCHAR) AS language, text[style_start + 1:style_stop] AS content FROM a
UNION ALL SELECT page_id, 2, 'script', start, CASE WHEN k = 2 THEN 2 ELSE 1 END, CASE WHEN k = 2 THEN 8 ELSE start + 1 END, CASE WHEN k = 1 THEN 'ts' END, text[start + 1:stop] FROM a"""),
    "page_scripts": (lambda s, d: m.scripts_of_pages(_pages(s, d), "page_id").select("page_id", F.length("script").alias("n_chars"), F.regexp_count("script", F.lit("\n")).alias("breaks"), F.md5(F.col("script").cast("binary")).alias("script")), rf"""WITH {_PAGES}
SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS breaks, md5({_BLANK.format('text[:start]')} || text[start + 1:stop] || {_BLANK.format('text[stop + 1:]')}) AS script FROM a"""),
    "template_scripts": (lambda s, d: m.scripts_of_templates(_templates(s, d), "page_id").select("page_id", "language", "styles", F.md5(F.col("script").cast("binary")).alias("script")), rf"""WITH t AS (
  SELECT page_id, page_id % 3 AS k, CASE page_id % 3 WHEN 1 THEN replace(html, '<h1>', {_IN(_INLINE)}) WHEN 2 THEN '---' || chr(10) || 'const id = ' || page_id || ';' || chr(10) || '---' || chr(10) || html ELSE html END AS text FROM pages WHERE html IS NOT NULL),
a AS (SELECT *, strpos(text, '<script>') + 7 AS start, strpos(text, '</script>') - 1 AS stop, strpos(text, '{{title') - 1 AS inline_start, strpos(text, ';' || chr(10) || '---') AS head_stop FROM t)
SELECT page_id, CASE WHEN k = 2 THEN 'typescript' ELSE 'javascript' END AS language, CAST(1 AS INTEGER) AS styles, md5(CASE k
  WHEN 1 THEN {_BLANK.format('text[:start]')} || text[start + 1:stop] || {_BLANK.format('text[stop + 1:inline_start]')} || text[inline_start + 1:inline_start + 13] || {_BLANK.format('text[inline_start + 14:]')}
  WHEN 2 THEN '   ' || chr(10) || text[5:head_stop] || {_BLANK.format('text[head_stop + 1:start]')} || text[start + 1:stop] || {_BLANK.format('text[stop + 1:]')}
  ELSE {_BLANK.format('text[:start]')} || text[start + 1:stop] || {_BLANK.format('text[stop + 1:]')} END) AS script FROM a"""),
    "app_routes": (lambda s, d: ro.routes(_apps(s, d)), """WITH l AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderkey % 5 AS t, 6 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line FROM orders),
b AS (SELECT DISTINCT k, 6 AS line, CASE WHEN k % 2 = 1 THEN '/c' || k ELSE '' END AS prefix, true AS good FROM l UNION ALL SELECT k, line, CASE WHEN k % 2 = 1 THEN '/n' || o ELSE '' END, true FROM l WHERE t = 1 UNION ALL SELECT k, line, NULL, false FROM l WHERE t = 2),
u AS (SELECT l.*, b.line AS owner, b.prefix, b.good FROM l ASOF JOIN b ON l.k = b.k AND l.line > b.line WHERE t IN (0, 3)),
m AS (SELECT k, owner, '/api' || o AS base FROM u WHERE t = 3 AND good)
SELECT 'c' || k || CASE WHEN k % 2 = 1 THEN '.py' ELSE '.js' END AS path, CAST(line AS INTEGER) AS line, CASE WHEN k % 2 = 1 THEN 'fastapi' ELSE 'express' END AS framework, 'POST' AS method, '/a' || o AS route, CASE WHEN k % 2 = 0 THEN 'h' || o END AS handler FROM l WHERE t = 4
UNION ALL SELECT 'c' || u.k || CASE WHEN u.k % 2 = 1 THEN '.py' ELSE '.js' END, line, CASE WHEN u.k % 2 = 1 THEN 'fastapi' ELSE 'express' END, 'GET', coalesce(base, '') || prefix || '/o' || o, CASE WHEN u.k % 2 = 0 THEN 'h' || o END FROM u LEFT JOIN m ON m.k = u.k AND m.owner = u.owner WHERE t = 0 AND good"""),
    "page_units": (_units, r"""WITH t AS (SELECT page_id, regexp_replace(html, '<script>.*?</script>', '', 'gs') AS h FROM pages WHERE html IS NOT NULL),
u AS (SELECT page_id, 'a' AS role, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(h, '<a href="([^"]*)"', 1) AS l FROM t)
  UNION ALL SELECT page_id, 'class', unnest(l), generate_subscripts(l, 1) FROM (SELECT page_id, regexp_extract_all(h, '<[^>]* class="([^"]*)"', 1) AS l FROM t) 
  UNION ALL SELECT page_id, 'region', 'region:' || i, i FROM (SELECT page_id, unnest(string_split(h, chr(10))) AS line, generate_subscripts(string_split(h, chr(10)), 1) AS i FROM t) WHERE regexp_matches(line, '<(main|body|section|article|template|div)[ >]'))
SELECT page_id, role, count(*) AS n, md5(string_agg(name, '|' ORDER BY i)) AS names FROM u GROUP BY page_id, role"""),
}
