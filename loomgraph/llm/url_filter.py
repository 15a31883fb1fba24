"""URL filters: rules first, then a path-template tree per host with smoothed labelled purity.

Rules give a verdict to a host, its subdomains and the paths that start with the rule's; the
longest rule wins. The pages that rules judge are the labels from which templates learn for the
rest:

1. Path segments that vary by nature (holding digits, long hexadecimal runs, percent codes) become
   wildcards that keep a file ending; pages are counted by (host, generalised path), with labels.
2. Level by level below each host, a node whose children are many and mostly rare is variable: its
   rare children become a wildcard.
3. Sibling branches are merged where statistics cannot tell them apart. Branches labelled often
   enough form a pool with those of the same majority whose share of blocked pages is within two
   standard errors of the pool's. A branch with too few labels joins the pool whose pages are spread
   alike over the paths below, by a chi-square of homogeneity within two standard deviations of its
   mean, if at least two labelled branches agree in that pool; of two such pools the nearer, of
   equals the allowed one.
4. A template is rejected if its smoothed purity, (blocked + ALPHA * prior) / (labelled + ALPHA),
   reaches ``REJECT``; the prior is the share of blocked pages among all labelled ones, one half at
   most, so a template without labels is kept.

Pages are pre-aggregated before the tree is built, so a host with a third of all pages is as many
rows as it has generalised paths.

Defined results: a null url or one without ``://`` has an empty host and path, which no rule fits;
segments beyond ``DEPTH`` are told apart but not merged; repeated rows count as often as they occur; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read_table, release

DEPTH, MANY, RARE, EVIDENCE, ALPHA, REJECT = 8, 20, 3.0, 5, 5.0, 0.7
#: The contract's rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """(rule, verdict) of the longest fitting rule, ties by text; null if none fits."""
    table = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.when(F.size(fits) > 0, F.element_at(F.transform(fits, lambda r: F.struct(F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))), 1))


def generalised(path: Column) -> Column:
    """The path's segments, variable ones as ``*``; those beyond ``DEPTH`` as one."""
    ending = lambda s: F.regexp_extract(s, r"(\.[A-Za-z]{1,5})?$", 0)
    one = lambda s: F.when(s.rlike(r"[0-9]|%[0-9A-Fa-f]{2}|^[a-f]{12,}$"), F.concat(F.lit("*"), ending(s))).otherwise(s)
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), one)
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.array_join(F.slice(parts, DEPTH + 1, F.size(parts)), "/")))).otherwise(parts)


_NODE = ["host", "template"]


def _homes(nodes: DataFrame, children: DataFrame, pools: DataFrame) -> DataFrame:
    """(host, template, segment, home): the pool that a branch without a majority resembles."""
    below = nodes.where("segment is not null").groupBy(*_NODE, "segment", "rest").agg(F.sum("n").alias("a"))
    known = children.select(*_NODE, "segment", "majority", "rare")
    profile = below.join(known, [*_NODE, "segment"]).where("not rare")
    pooled = profile.where("majority is not null").groupBy(*_NODE, "majority", "rest").agg(F.sum("a").alias("b"))
    sizes = pooled.groupBy(*_NODE, "majority").agg(F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("kinds_b"))
    unsure = profile.where("majority is null").drop("majority")
    own = unsure.groupBy(*_NODE, "segment").agg(F.sum("a").alias("all_a"), F.count(F.lit(1)).alias("kinds_a"))
    to_judge = own.join(pools.join(sizes, [*_NODE, "majority"]).select(*_NODE, "majority", "all_b", "kinds_b"), _NODE)
    ratio = F.sqrt(F.col("all_b") / F.col("all_a"))
    met = unsure.select(*_NODE, "segment", "rest", "a").join(pooled, [*_NODE, "rest"]).join(to_judge.select(*_NODE, "segment", "majority", "all_a", "all_b"), [*_NODE, "segment", "majority"])
    term = F.pow(ratio * F.col("a") - F.col("b") / ratio, 2) / (F.col("a") + F.col("b"))
    common = met.groupBy(*_NODE, "segment", "majority").agg(F.sum(term).alias("x"), F.sum("a").alias("met_a"), F.sum("b").alias("met_b"), F.count(F.lit(1)).alias("kinds"))
    j = to_judge.join(common, [*_NODE, "segment", "majority"], "left").na.fill(0, ["x", "met_a", "met_b", "kinds"])
    # Paths on one side only need no rows: what they add to the chi-square is known from the totals.
    x = F.col("x") + F.col("all_b") / F.col("all_a") * (F.col("all_a") - F.col("met_a")) + F.col("all_a") / F.col("all_b") * (F.col("all_b") - F.col("met_b"))
    freedom = F.col("kinds_a") + F.col("kinds_b") - F.col("kinds") - 1
    j = j.withColumn("far", F.round((x - freedom) / F.sqrt(2 * F.greatest(freedom, F.lit(1))), 9)).where("far <= 2")
    return j.groupBy(*_NODE, "segment").agg(F.min(F.struct("far", "majority"))["majority"].alias("home"))


def templates(counted: DataFrame) -> DataFrame:
    """(host, shape, template) for rows (host, shape, parts, n, blocked, labelled) of distinct generalised paths."""
    nodes = counted.withColumn("template", F.lit(""))
    deepest = counted.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(min(DEPTH, deepest)):
        tail = F.array_join(F.slice("parts", level + 2, F.greatest(F.size("parts") - level - 1, F.lit(0))), "/")
        nodes = nodes.withColumn("segment", F.when(F.size("parts") > level, F.element_at("parts", level + 1))).withColumn("rest", F.when(F.size("parts") > level, tail))
        children = nodes.where("segment is not null").groupBy(*_NODE, "segment").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
        parents = children.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
        variable = (F.col("m") >= MANY) & (F.col("total") < RARE * F.col("m"))
        children = children.join(parents.select(*_NODE, variable.alias("variable")), _NODE).withColumn("rare", F.col("variable") & (F.col("n") <= RARE))
        majority = F.when((F.col("labelled") >= EVIDENCE) & ~F.col("rare"), F.when(F.col("blocked") * 2 >= F.col("labelled"), "blocked").otherwise("allowed"))
        children = cut(children.withColumn("majority", majority))
        pools = cut(children.where("majority is not null").groupBy(*_NODE, "majority").agg(F.sum("blocked").alias("pool_blocked"), F.sum("labelled").alias("pool_labelled"), F.count(F.lit(1)).alias("branches")).where("branches > 1"))
        share = F.col("pool_blocked") / F.col("pool_labelled")
        alike = F.abs(F.try_divide("blocked", "labelled") - share) <= 2 * F.sqrt(F.try_divide(share * (1 - share), F.col("labelled"))) + F.lit(1e-9)
        judged = children.join(pools, [*_NODE, "majority"], "left").join(_homes(nodes, children, pools), [*_NODE, "segment"], "left")
        pool = F.when(F.coalesce(alike, F.lit(False)), F.col("majority")).otherwise(F.col("home"))
        name = F.when(F.col("rare"), F.lit("*")).when(pool.isNotNull(), F.concat(F.lit("{"), pool, F.lit("}"))).otherwise(F.col("segment"))
        names = judged.select(*_NODE, "segment", name.alias("name"))
        renamed = nodes.join(names, [*_NODE, "segment"], "left").withColumn("template", F.when(F.col("name").isNotNull(), F.concat_ws("/", "template", "name")).otherwise(F.col("template"))).drop("name", "segment", "rest")
        before, nodes = nodes, cut(renamed)
        release(children, pools, before)
    # What is deeper than the tree stays apart in its template.
    return nodes.withColumn("template", F.when(F.size("parts") > DEPTH, F.concat_ws("/", "template", F.element_at("parts", -1))).otherwise(F.col("template")))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, learn: Column | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, the method's own verdict, template and purity of each page.

    ``learn``, over page_id and url, may keep the labels of some pages from the tree, to be judged against them.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    p = p.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("parts", generalised(F.col("path"))).withColumn("shape", F.array_join("parts", "/"))
    told = F.when(F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)), F.col("hit.verdict"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counted = cut(p.groupBy("host", "shape", "parts").agg(F.count(F.lit(1)).alias("n"), count(told == "block").alias("blocked"), count(told.isNotNull()).alias("labelled")))
    base = counted.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = min(0.5, (base.b or 0) / base.l) if base.l else 0.0
    shaped = cut(templates(counted))
    purity = cut(shaped.groupBy("host", "template").agg(((F.sum("blocked") + ALPHA * prior) / (F.sum("labelled") + ALPHA)).alias("purity")))
    verdicts = cut(shaped.join(purity, ["host", "template"]).select(F.col("host").alias("h2"), F.col("shape").alias("s2"), "template", "purity"))
    release(counted, shaped, purity)
    out = p.join(verdicts, (p["host"] == F.col("h2")) & (p["shape"] == F.col("s2")))
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), method).alias("verdict"), method.alias("method"), "template", "purity")


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
