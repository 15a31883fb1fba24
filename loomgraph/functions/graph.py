"""Column expressions of the graph model: endpoints, certainty, ranks, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence thresholds, kinds by group, and edge kinds that need no confidence.
CERTAIN, PROBABLE = 0.85, 0.55
TYPES = ("CLASS", "STRUCT", "INTERFACE", "ENUM", "UNION", "TYPEDEF")
CALLABLES = ("FUNCTION", "METHOD", "MACRO")
MODULES = ("MODULE", "NAMESPACE", "PACKAGE")
DATA = ("FIELD", "VARIABLE", "GLOBAL_VARIABLE", "CONSTANT", "ENUM_CONSTANT")
NOT_INDEXED = ("FILE", "UNKNOWN", "BUILTIN_TYPE")
STRUCTURAL = ("MEMBER", "INHERITANCE", "OVERRIDE", "TYPE_ARGUMENT", "TEMPLATE", "INCLUDE", "IMPORT")

#: How much an edge of each kind carries in graph ranking.
EDGE_WEIGHTS = {"CALL": 1.0, "OVERRIDE": 0.95, "INHERITANCE": 0.9, "ANNOTATION": 0.85, "TYPE_USAGE": 0.8, "USAGE": 0.75, "TYPE_ARGUMENT": 0.7, "TEMPLATE": 0.7, "MACRO_USAGE": 0.65, "IMPORT": 0.6, "INCLUDE": 0.6}
#: Unqualified call names too common to trust, and helper names that are always trusted.
COMMON_CALLS = ("add", "all", "any", "append", "clear", "collect", "contains", "dedup", "extend", "filter", "insert", "into_iter", "iter", "iter_mut", "len", "map", "pop", "push", "remove", "retain", "sort", "sort_by", "sort_by_key", "truncate")
HELPER_CALLS = ("seed_symbol_table", "flush_projection_batch", "flush_errors")


def edge_weight(kind: str = "kind") -> Column:
    """The weight of the edge's kind, 0 for membership and kinds not named."""
    weight = F.lit(0.0)
    for k, w in EDGE_WEIGHTS.items():
        weight = F.when(F.col(kind) == k, w).otherwise(weight)
    return weight


def effective(end: str) -> Column:
    """The resolved endpoint (``source`` or ``target``), else the raw one."""
    return F.coalesce(F.col(f"resolved_{end}"), F.col(end))


def certainty_of(confidence: str = "confidence") -> Column:
    c = F.col(confidence)
    return F.when(c >= CERTAIN, "certain").when(c >= PROBABLE, "probable").when(c.isNotNull(), "uncertain")


def display_certainty() -> Column:
    return F.coalesce(F.col("certainty"), certainty_of(), F.when(F.col("kind").isin(*STRUCTURAL), "certain"))


def indexable(kind: str = "kind") -> Column:
    return ~F.col(kind).isin(*NOT_INDEXED)


def display_name() -> Column:
    return F.coalesce("qualified_name", "serialized_name")


def import_like(name: Column) -> Column:
    return F.col("kind").isin(*MODULES) & (name.rlike("^[\"'<]") | name.startswith("./") | name.startswith("../") | name.contains("/"))


def node_rank() -> Column:
    name = F.col("serialized_name")
    k = F.col("kind")
    return F.when(import_like(name), 5).when(k.isin(*TYPES), 0).when(k.isin(*CALLABLES), 1).when(k.isin(*MODULES), 2).when(k.isin(*DATA), 3).otherwise(4)


def common_call(name: Column) -> Column:
    """Whether an unqualified call name says little about its target."""
    return ~name.contains("::") & ~name.contains(".") & name.isin(*COMMON_CALLS)


def ignored_resolution() -> Column:
    """Whether a resolved call (target_name, certainty, confidence) is too unsure to follow.

    A call without any certainty is followed; a helper's always is.
    """
    name = F.coalesce("target_name", F.lit(""))
    helper = F.lit(False)
    for h in HELPER_CALLS:
        helper = helper | name.contains(h)
    c = F.coalesce("certainty", certainty_of())
    unsure = F.coalesce((c == "uncertain") | (common_call(name) & (c != "certain")), F.lit(False))
    return (F.col("kind") == "CALL") & F.col("resolved_target").isNotNull() & ~helper & unsure


def entry_like(name: Column) -> Column:
    low = F.lower(name)
    marked = low.contains("run") | low.contains("start") | low.contains("serve") | low.contains("index")
    return F.col("kind").isin("FUNCTION", "METHOD", "MODULE") & ((name == "main") | name.endswith("::main") | name.endswith(".main") | marked)
