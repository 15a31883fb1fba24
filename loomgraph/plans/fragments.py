"""SQL that the registered queries' SQL is put together from."""

from __future__ import annotations

from loomgraph.functions.graph import COMMON_CALLS

COMMON = ", ".join(f"'{n}'" for n in COMMON_CALLS)
BAND = "CASE WHEN confidence >= 0.85 THEN 'certain' WHEN confidence >= 0.55 THEN 'probable' WHEN confidence IS NOT NULL THEN 'uncertain' END"
_SURE = f"coalesce(certainty, {BAND})"
_IGNORED = f"coalesce(kind = 'CALL' AND resolved_target IS NOT NULL AND NOT regexp_matches(target_name, 'seed_symbol_table|flush_projection_batch|flush_errors') AND ({_SURE} = 'uncertain' OR (target_name IN ({COMMON}) AND {_SURE} <> 'certain')), false)"
EFFECTIVE = f"""
eff AS MATERIALIZED (
  SELECT id, kind, source, target, source AS src, coalesce(CASE WHEN NOT ign THEN resolved_target END, target) AS dst, CASE WHEN NOT ign THEN confidence END AS confidence, CASE WHEN NOT ign THEN certainty END AS certainty, target_name, caller_path, file_id
  FROM (SELECT *, {_IGNORED} AS ign FROM edge))"""
DEGREES = EFFECTIVE + """,
degree AS (SELECT id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(1 - o) AS BIGINT) AS incoming FROM (SELECT src AS id, 1 AS o FROM eff UNION ALL SELECT dst, 0 FROM eff) GROUP BY id),
deg AS (
  SELECT n.id, n.kind, coalesce(n.qualified_name, n.serialized_name) AS name, outgoing, incoming, outgoing + incoming AS total FROM degree JOIN node n USING (id) WHERE n.kind <> 'FILE')"""
IMPORT_LIKE = """(kind IN ('MODULE','NAMESPACE','PACKAGE') AND (regexp_matches(serialized_name, '^["''<]') OR starts_with(serialized_name, './') OR starts_with(serialized_name, '../') OR contains(serialized_name, '/')))"""
RANK = f"""CASE WHEN {IMPORT_LIKE} THEN 5
  WHEN kind IN ('CLASS','STRUCT') THEN 0 WHEN kind = 'METHOD' THEN 1 WHEN kind IN ('MODULE','NAMESPACE') THEN 2 WHEN kind = 'FIELD' THEN 3 ELSE 4 END"""
INDEXABLE = "kind NOT IN ('FILE', 'UNKNOWN', 'BUILTIN_TYPE')"
TEST_PATH = r"regexp_matches('/' || lower({0}), '/(tests|test|spec|fixtures|__tests__|__test__)/|-test-client/|_test_client/|\.(test|spec)\.|_tests?\.(rs|py|ts|tsx)$')"
BENCH_PATH = "regexp_matches('/' || lower({0}), '/(benchmarks|benchmark|benches|bench)/')"


def role(path: str = "path") -> str:
    p = f"'/' || lower({path})"
    return rf"""CASE WHEN regexp_matches({p}, '/(node_modules|vendor|third_party|third-party|external)/') THEN 'vendor'
  WHEN regexp_matches({p}, '/(target|dist|build|generated)/|/schema/typescript/|\.generated\.|\.g\.cs$') THEN 'generated' WHEN {TEST_PATH.format(path)} THEN 'test'
  WHEN regexp_matches({p}, '/docs?/|/(readme|changelog)\.md$') THEN 'docs' WHEN {BENCH_PATH.format(path)} THEN 'benchmark' WHEN regexp_matches({p}, '/((main|lib|mod)\.rs|(main|index)\.(ts|tsx|js|jsx))$') THEN 'entrypoint' ELSE 'source' END"""


ROLE = role()
SNAPSHOT = f"""
files AS (SELECT id AS file_id, path FROM file UNION ALL SELECT id, serialized_name FROM node WHERE kind = 'FILE' AND id NOT IN (SELECT id FROM file)),
snap AS (
  SELECT f.file_id, path, {ROLE} AS role, count(n.id) AS symbol_count, coalesce(min(n.rank), 255) AS best_rank
  FROM files f LEFT JOIN (SELECT id, file_id, {RANK} AS rank FROM node WHERE {INDEXABLE}) n ON n.file_id = f.file_id GROUP BY f.file_id, path)"""
CERTAINTY = f"coalesce(certainty, {BAND}, CASE WHEN kind IN ('MEMBER','INHERITANCE','OVERRIDE','TYPE_ARGUMENT','TEMPLATE','INCLUDE','IMPORT') THEN 'certain' END)"
TIER = "CASE WHEN coalesce({0}, 0) = 0 THEN 0 WHEN {0} <= 2 THEN 1 WHEN {0} <= 8 THEN 2 ELSE 3 END"
OUT, IN = "SELECT src AS a, dst AS b FROM eff", "SELECT dst AS a, src AS b FROM eff"
CALL_DEGREES = f"""calls AS (SELECT DISTINCT src, dst FROM eff WHERE kind = 'CALL' AND confidence >= 0.85 AND src <> dst),
hidden AS (SELECT n.id FROM node n JOIN file f ON f.id = n.file_id WHERE {ROLE} IN ('test', 'benchmark')),
cd AS (SELECT id, CAST(sum(c) AS BIGINT) AS callers, CAST(sum(e) AS BIGINT) AS callees FROM (SELECT src AS id, 0 AS c, 1 AS e FROM calls UNION ALL SELECT dst, CASE WHEN src IN (SELECT id FROM hidden) THEN 0 ELSE 1 END, 0 FROM calls) GROUP BY id)"""


def bfs(start: str, steps: str, depth: int, name: str = "") -> str:
    """Levels of a walk as tables ``name``s0, ``name``s1, ... of (id, depth)."""
    levels = [f"{name}l0 AS (SELECT {start} AS id, 0 AS depth)", f"{name}s0 AS (SELECT * FROM {name}l0)", f"{name}step AS ({steps})"]
    for k in range(1, depth + 1):
        levels.append(f"{name}l{k} AS (SELECT DISTINCT b AS id, {k} AS depth FROM {name}l{k - 1} JOIN {name}step ON a = {name}l{k - 1}.id WHERE b NOT IN (SELECT id FROM {name}s{k - 1}))")
        levels.append(f"{name}s{k} AS (SELECT * FROM {name}s{k - 1} UNION ALL SELECT * FROM {name}l{k})")
    return ",\n".join(levels)
