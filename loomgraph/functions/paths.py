"""Column expressions over file paths: roles, scopes, languages, subsystems, structural position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The markers of each role, in the order in which roles are asked.
VENDOR = ("/node_modules/", "/vendor/", "/third_party/", "/third-party/", "/external/")
GENERATED = ("/target/", "/dist/", "/build/", "/generated/", "/schema/typescript/", ".generated.")
TEST = ("/tests/", "/test/", "/spec/", "/fixtures/", "/__tests__/", "/__test__/", "-test-client/", "_test_client/", ".test.", ".spec.")
DOCS = ("/docs/", "/doc/")
BENCHMARK = ("/benchmarks/", "/benchmark/", "/benches/", "/bench/")
DOC_NAMES = ("readme.md", "changelog.md")
ENTRY_NAMES = ("main.rs", "lib.rs", "mod.rs", "main.ts", "main.tsx", "main.js", "main.jsx", "index.ts", "index.tsx", "index.js", "index.jsx")
TEST_ENDING = r"_tests?\.(rs|py|ts|tsx)$"
ROLES = ("entrypoint", "source", "test", "docs", "benchmark", "generated", "vendor")
SOURCE_ROOTS = ("src", "lib", "app", "cmd", "source")
#: Languages by extension, with the tier of what is read from them.
PARSED = {"python": "py pyi", "java": "java", "rust": "rs", "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "cpp": "cpp cc cxx hpp hh hxx", "c": "c h", "go": "go", "ruby": "rb", "php": "php", "csharp": "cs", "kotlin": "kt kts", "swift": "swift", "dart": "dart", "bash": "sh bash"}
STRUCTURAL = {"html": "html htm", "css": "css", "sql": "sql", "markdown": "md markdown mdx", "yaml": "yml yaml", "toml": "toml", "json": "json", "shell": "zsh ksh command", "powershell": "ps1 psm1"}
#: Extensions that ride along with a language, and the language reported for them, if their own.
COMPANIONS = {"vue": "vue", "svelte": "svelte", "astro": "astro", "cshtml": None, "lua": None, "scss": None, "sass": None, "less": None}


def repo_relative(path: Column) -> Column:
    """The path with ``/``, in lower case, cut to what follows the clone's folder below the last ``repos/``."""
    p = F.lower(F.translate(path, "\\", "/"))
    return F.regexp_replace(p, r"^.*repos/[^/]*/", "")


def _marked(path: Column) -> Column:
    return F.concat(F.lit("/"), repo_relative(path))


def _any(p: Column, markers: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [p.contains(m) for m in markers])


def _name(path: Column) -> Column:
    return F.element_at(F.split(_marked(path), "/"), -1)


def is_test(path: Column) -> Column:
    return _any(_marked(path), TEST) | _name(path).rlike(TEST_ENDING)


def is_benchmark(path: Column) -> Column:
    return _any(_marked(path), BENCHMARK)


def test_or_bench(path: Column) -> Column:
    """Whether the markers of tests or benchmarks are there, whatever role comes first."""
    return is_test(path) | is_benchmark(path)


def in_production(path: Column) -> Column:
    """The caller scope without tests and benchmarks; an unknown path is kept."""
    return F.coalesce(~test_or_bench(path), F.lit(True))


def file_role(path: str | Column = "path") -> Column:
    p = F.col(path) if isinstance(path, str) else path
    m, name = _marked(p), _name(p)
    return (
        F.when(_any(m, VENDOR), "vendor").when(_any(m, GENERATED) | name.endswith(".g.cs"), "generated").when(is_test(p), "test").when(_any(m, DOCS) | name.isin(*DOC_NAMES), "docs")
        .when(is_benchmark(p), "benchmark").when(name.isin(*ENTRY_NAMES), "entrypoint").otherwise("source")
    )


def role_rank(role: Column) -> Column:
    """The role's place among roles, production first."""
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), role) - 1


def languages(spark: SparkSession) -> DataFrame:
    """(extension, language, tier): a small fixed table, broadcast by its users."""
    rows = [(e, name, tier) for tier, table in (("parsed", PARSED), ("structural", STRUCTURAL)) for name, own in table.items() for e in own.split()]
    return spark.createDataFrame(rows + [(e, name, "companion") for e, name in COMPANIONS.items()], "extension string, language string, tier string")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def route_languages(paths: DataFrame) -> DataFrame:
    """``paths`` (path) with ``language`` and ``tier`` by extension, whatever its case; null where none is known."""
    known = F.broadcast(languages(paths.sparkSession).withColumnRenamed("extension", "_extension"))
    return paths.join(known, extension(F.col("path")) == F.col("_extension"), "left").drop("_extension")


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda s: s != "")


def _folders(path: Column) -> Column:
    s = _segments(path)
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def _below_root(path: Column) -> Column:
    """Folders between the innermost source root and the file, -1 where there is no such root."""
    inner = F.transform(F.reverse(_folders(path)), lambda s: s.isin(*SOURCE_ROOTS))
    return (F.array_position(inner, True) - 1).cast("int")


def structural_depth(path: Column) -> Column:
    """Folders between the innermost source root and the file; without one, all its folders."""
    return F.when(_below_root(path) >= 0, _below_root(path)).otherwise(F.size(_folders(path)))


def path_rank(role: Column, path: Column) -> Column:
    """0 an entry point, 1 at or one below a source root (or a bare file), 2 further below one, 3 elsewhere."""
    below, folders = _below_root(path), _folders(path)
    under = F.when(below <= 1, 1).otherwise(2)
    return F.when(role == "entrypoint", 0).when(path.isNull(), 3).when(below >= 0, under).when(F.size(folders) == 0, 1).otherwise(3)


def subsystem_key(language: Column, path: Column) -> Column:
    """The language and the part of the tree that a file belongs to: a crate, a plugin, a source tree's child, or the top folder."""
    s = _segments(path)
    joined = F.array_join(s, "/")
    named = lambda word: F.regexp_extract(joined, rf"(?:^|/)({word}/[^/]+)", 1)
    # The last ``src``; its child belongs to the key unless it is a file.
    last = (F.size(s) - F.array_position(F.reverse(s), "src") + 1).cast("int")
    child = F.get(s, last)
    below = F.when(child.isNotNull() & ~child.contains("."), 1).otherwise(0)
    key = F.when(path.isNull(), "unknown").when(named("crates") != "", named("crates")).when(named("plugins") != "", named("plugins")).when(F.array_contains(s, "src-tauri"), "src-tauri")
    key = key.when(F.array_contains(s, "src"), F.array_join(F.slice(s, F.lit(1), last + below), "/")).when(F.size(s) == 0, "root").otherwise(F.get(s, F.lit(0)))
    return F.concat(language, F.lit(":"), key)


def component_key(path: Column) -> Column:
    """crate:, module: or dir: key of the component that a file's report goes to."""
    p = repo_relative(path)
    crate = F.regexp_extract(p, r"(?:^|/)crates/([^/]+)/", 1)
    module = F.regexp_extract(p, r"(?:^|/)src/([^/]+)/", 1)
    folder = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(crate != "", F.concat(F.lit("crate:"), crate)).when(module != "", F.concat(F.lit("module:"), module)).otherwise(F.concat(F.lit("dir:"), F.when(folder == "", ".").otherwise(folder)))


def helper_like(name: Column, path: Column) -> Column:
    """Whether name or path has a word for helpers, mocks or fixtures."""
    words = F.split(F.lower(F.concat_ws(" ", name, path)), "[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("helper", "helpers", "mock", "mocks", "fake", "fixture", "fixtures")]))
