"""Evidence of packets: what supports their answers, what is missing, and whether an answer stands.

All packets are compiled at once, from frames that name their packet. Support comes from four families: cited symbols with the
source read for them, typed edges, and complete searches that found nothing. Claims that a packet must prove are covered by
edges or not; what could still close a gap is offered as one bounded second round. Each packet gets one
disposition: ``unavailable`` (what it stands on cannot be trusted), ``drill_once`` (gaps that the offered options may close),
``not_established``, or ``supported``.

Frames: packets(packet, question, fresh, error, pinned, drilled, truncated, ambiguous); citations(packet, ord, node_id, name, path, line, eligible);
ranges(packet, id, node_id, path, start_line, end_line, snippet); edges(packet, ord, id, kind, source, target); searches(packet, ord, query, completion,
resolved, candidates, blocking); claims(packet, ord, id, kind, material, bound, status, edge_kind, edge_proofs, node_id, path, probe_path, reason);
coverage(packet, path, status, reason); probes(packet, ord, path).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge kinds that support by themselves, edge kinds whose lack can be closed, and options of a second round.
TYPED = ("CALL", "INHERITANCE", "IMPORT", "TYPE_USAGE", "USAGE")
CLOSABLE = ("CALL", "INHERITANCE")
OPTIONS = 8


@dataclass
class Evidence:
    packets: DataFrame
    citations: DataFrame
    ranges: DataFrame
    edges: DataFrame
    searches: DataFrame
    claims: DataFrame
    coverage: DataFrame
    probes: DataFrame


_SUPPORT = ("packet", "id", "kind", "summary", "path", "node_id", "start_line", "end_line", "snippet", "edge_kind", "source", "target", "query")


def support_units(e: Evidence, upto: str = _SUPPORT[-1], tasks: int | None = None) -> DataFrame:
    """(packet, place, id, kind, summary, ...): each packet's support, one unit an id, in order.

    A cited symbol comes with the ranges read for it that hold text; then edges of typed kinds; then
    completed searches without a hit. What the families need is shuffled once, by packet, over ``tasks`` tasks if told; columns
    behind ``upto`` are left out and not shuffled.
    """
    rest = [c for c in _SUPPORT[: _SUPPORT.index(upto) + 1] if c not in ("packet", "id")]
    shapes = {"family": "int", "ord": "long", "start_line": "long", "end_line": "long"}
    columns = ("family", "node_id", "ord", "id", "name", "target", "kind", "path", "start_line", "end_line", "snippet")

    def part(df: DataFrame, family: int, **own: str) -> DataFrame:
        found = {"family": F.lit(family), **{c: F.col(own.get(c, c)) for c in columns if own.get(c, c) in df.columns}}
        return df.select("packet", *[found.get(c, F.lit(None)).cast(shapes.get(c, "string")).alias(c) for c in columns])

    rows = reduce(DataFrame.unionByName, (
        part(e.citations.where("eligible"), 0, start_line="line"), part(e.ranges.where("snippet <> '' and packet is not null and node_id is not null"), 1),
        part(e.edges.where(F.col("kind").isin(*TYPED)), 2, name="source"), part(e.searches.where("completion = 'completed' and resolved = 0 and candidates = 0"), 3, name="query"),
    ))
    rows = rows.repartition(tasks, "packet") if tasks else rows.repartition("packet")
    family = F.col("family")
    cite = F.struct("ord", "name", "path", "start_line")
    rows = rows.withColumn("cited", F.min(F.when(family == 0, cite)).over(Window.partitionBy("packet", "node_id")))
    rows = rows.where(F.when(family == 0, cite.eqNullSafe(F.col("cited"))).when(family == 1, F.col("cited").isNotNull()).otherwise(True))
    of = lambda *values: F.when(family == 0, values[0]).when(family == 1, values[1]).when(family == 2, values[2]).otherwise(values[3])
    at, line = F.concat("name", F.lit(" at "), "path"), F.col("start_line").cast("string")
    symbol = F.when(F.col("path").isNull(), F.col("name")).when(line.isNull(), at).otherwise(F.concat(at, F.lit(":"), line))
    told = F.concat(F.lit("source for "), "node_id", F.lit(" at "), "path", F.lit(":"), line, F.lit("-"), F.col("end_line").cast("string"))
    none = F.lit(None).cast("string")
    units = rows.select(
        "packet", F.struct(of(*map(F.lit, (0, 0, 1, 2))).cast("long").alias("o0"), F.when(family == 1, F.col("cited.ord")).otherwise(F.col("ord")).alias("o1"), (family == 1).cast("long").alias("o2"), F.when(family == 1, F.col("id")).otherwise("").alias("o3")).alias("order"),
        of(F.concat(F.lit("symbol:"), "node_id"), F.col("id"), F.concat(F.lit("edge:"), "id"), F.concat(F.lit("negative:"), "name")).alias("id"), of(*map(F.lit, ("symbol_location", "source_range", "typed_graph_edge", "complete_query_negative"))).alias("kind"),
        of(symbol, told, F.concat(F.lit("`"), "name", F.lit("` "), "kind", F.lit(" `"), "target", F.lit("`")), F.concat(F.lit("searched `"), "name", F.lit("`, zero hits"))).alias("summary"), "path", "node_id", "start_line", "end_line", "snippet",
        F.when(family == 2, F.col("kind")).alias("edge_kind"), F.when(family == 2, F.col("name")).alias("source"), "target", F.when(family == 3, F.col("name")).otherwise(none).alias("query"),
    )
    first = units.groupBy("packet", "id").agg(F.min(F.struct("order", *rest)).alias("u"))
    place = F.row_number().over(Window.partitionBy("packet").orderBy("u.order", "id"))
    return first.select("packet", place.alias("place"), "id", *[f"u.{c}" for c in rest])


def blocking() -> Column:
    """Whether a claim must be proven: a material one, unless it is only a name that the question seems to hold."""
    return F.col("material") & ((F.col("kind") != "exact_probe") | F.col("bound"))


def unmet_claims(e: Evidence) -> DataFrame:
    return e.claims.where(blocking() & (F.col("status") != "proven"))


def drill_options(e: Evidence, most: int = OPTIONS) -> DataFrame:
    """(packet, place, option, target, gap): what a second round may read, ask or look for, at most ``most`` a packet.

    In order: searches lost to a deadline, named paths that nothing cites, then for each unproven claim its
    missing edge, its symbol or path, and its probed path, then paths that the question names. An option is offered once, for its first gap.
    """
    cited = e.citations.where("eligible and path is not null").select("packet", F.col("path").alias("target")).distinct()
    lost = e.searches.join(e.packets.where("truncated").select("packet"), "packet").where(F.col("ord") < most)
    option = lambda df, rank, sub, kind, target, gap: df.select("packet", F.struct(F.lit(rank).alias("rank"), F.col("ord").cast("long").alias("ord"), F.lit(sub).alias("sub")).alias("order"), F.lit(kind).alias("option"), target.cast("string").alias("target"), gap.alias("gap"))
    gap = lambda name, c="id": F.concat(F.lit(f"{name}:"), F.col(c))
    unmet = unmet_claims(e)
    named_schema = F.coalesce(F.col("reason").startswith("named_sql_table_carriers_missing:"), F.lit(False))
    no_edge = unmet.where(F.col("edge_kind").isin(*CLOSABLE) & (F.coalesce("edge_proofs", F.lit(0)) == 0) & F.col("node_id").isNotNull())
    open_ = unmet.where(~named_schema)
    words = e.packets.select("packet", F.posexplode(F.split("question", r"[\s`\"',;()]")).alias("ord", "word"))
    words = words.select("packet", "ord", F.regexp_replace("word", r"^[^A-Za-z0-9/\\._-]+|[^A-Za-z0-9/\\._-]+$", "").alias("word")).where("contains(word, '/') and contains(word, '.')")
    read, omitted = "bounded_source_read", "omitted_mandatory_support"
    paths = [
        option(e.probes, 1, 0, read, F.col("path"), gap("named-path", "path")),
        option(open_.where("node_id is null and path is not null"), 2, 1, read, F.col("path"), gap("omitted-material-path")),
        option(unmet.where("kind = 'exact_probe' and path is null and probe_path is not null"), 2, 2, read, F.col("probe_path"), gap("omitted-path", "probe_path")),
        option(words, 3, 0, read, F.col("word"), gap("named-path", "word")),
    ]
    other = [
        option(lost, 0, 0, "deadline_lost_candidate", F.col("query"), gap("deadline-lost", "query")),
        option(no_edge, 2, 0, omitted, F.col("node_id"), gap("omitted-edge")),
        option(open_.where("node_id is not null"), 2, 1, omitted, F.col("node_id"), gap("omitted-material")),
    ]
    known = reduce(DataFrame.unionByName, paths).join(cited, ["packet", "target"], "left_anti")
    every = reduce(DataFrame.unionByName, [known, *other])
    first = every.groupBy("packet", "option", "target").agg(F.min(F.struct("order", "gap")).alias("o"))
    place = F.row_number().over(Window.partitionBy("packet").orderBy("o.order", "option", "target"))
    return first.select("packet", place.alias("place"), "option", "target", "o.gap").where(F.col("place") <= most)


def dispositions(e: Evidence, support: DataFrame, options: DataFrame) -> DataFrame:
    """(packet, disposition, reason, support, options, unmet): one row a packet; the first reason that holds decides.

    A file that was read in part blocks unless a range of it was read again from source.
    """
    some = lambda df: df.select("packet").distinct()
    verified = e.ranges.where("snippet <> ''").select("packet", "path").distinct()
    partial = (F.col("status") == "incomplete") & F.coalesce(F.col("reason") == "parser_partial", F.lit(False))
    uncovered = e.coverage.where("status <> 'complete'")
    uncovered = uncovered.where(~partial).select("packet", "path").unionByName(uncovered.where(partial).select("packet", "path").join(verified, ["packet", "path"], "left_anti"))
    flags = {"uncovered": some(uncovered), "dead": some(e.searches.where("completion = 'cancelled' and blocking > 0"))}
    counts = {
        "support": support.groupBy("packet").agg(F.count(F.lit(1)).alias("count"), F.max(F.col("kind") != "complete_query_negative").alias("positive")),
        "options": options.groupBy("packet").count(), "unmet": unmet_claims(e).groupBy("packet").count(),
    }
    p = e.packets
    for name, df in flags.items():
        p = p.join(df.withColumn(name, F.lit(True)), "packet", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    for name, df in counts.items():
        p = p.join(df.withColumnRenamed("count", name), "packet", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    p = p.withColumns({"positive": F.coalesce("positive", F.lit(False)), "unproven": F.col("unmet") > 0})
    has = F.col("options") > 0
    order = (
        (~F.col("pinned"), "unavailable", "pinned generation is no longer current"), (F.col("ambiguous").isNotNull(), "not_established", "a probe needs a choice"), (~F.col("fresh"), "unavailable", "freshness is not established"),
        (F.col("uncovered"), "unavailable", "source coverage is not established"), (F.col("dead"), "unavailable", "a required search did not complete"), (F.col("error"), "unavailable", "retrieval failed"),
        (F.col("drilled") & (F.col("unproven") | has), "not_established", "the second round left claims open"), (F.col("drilled") & F.col("positive"), "supported", "supported"), (F.col("drilled"), "not_established", "the second round added no support"),
        (has, "drill_once", "missing evidence may be closed"), (F.col("unproven"), "not_established", "claims are unproven"), (F.col("positive"), "supported", "supported"),
    )
    pick = lambda i: reduce(lambda w, o: w.when(o[0], o[i]), order, F)  # type: ignore[arg-type]
    return p.select("packet", pick(1).otherwise("not_established").alias("disposition"), pick(2).otherwise("searches found nothing").alias("reason"), "support", "options", "unmet")
