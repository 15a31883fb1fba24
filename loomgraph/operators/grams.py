"""Text and names found through stored postings: trigrams of texts, and a dictionary of names.

A text is looked up by what must be in it: every trigram of a string. The rarest few trigrams of each string are read
from the postings, which are sorted by trigram; the texts that hold them are candidates, are fetched by key
and verified. Names are a dictionary of distinct names with the set of their characters; those that hold all of a
query's are scored as subsequences, once for all that differ only in characters that the query lacks; the best are looked up among who bears them.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranks import leading, terminal, text_hits
from loomgraph.sources.store import Slotted, by_slots, written, written_rows

#: Trigrams read for a string, the rarest first.
READ = 3
#: Ends a text, so that its last one or two characters start a trigram too.
_END = "\x00\x00"


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text and its end, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.concat(text, F.lit(_END)), F.lit("(?s)(?=(...))"), 1))


@dataclass
class GramIndex:
    """texts(seq, path, text) by slots of seq; postings(gram, in_path, seq) sorted by gram; counts(gram, in_path, n)."""

    texts: Slotted
    postings: DataFrame
    counts: DataFrame


def _clean_path() -> Column:
    return F.lower(F.translate("path", "\\", "/"))


def build_grams(texts: DataFrame, slot_rows: int = 5_000) -> GramIndex:
    """The index of texts (path, text, seq)."""
    own, rows = written_rows(texts.select("seq", "path", "text"))
    both = own.select("seq", F.explode(F.array(F.struct(F.lit(False).alias("in_path"), trigrams(F.lower("text")).alias("grams")), F.struct(F.lit(True).alias("in_path"), trigrams(_clean_path()).alias("grams")))).alias("s"))
    each = written(both.select("seq", "s.in_path", F.explode("s.grams").alias("gram")))
    # Equal trigrams are split by text, so a common one is many tasks' work.
    postings = written(each.repartitionByRange("gram", "seq").sortWithinPartitions("gram", "seq"))
    counts = written(postings.groupBy("gram", "in_path").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("gram"))
    return GramIndex(by_slots(own, "seq", rows, slot_rows), postings, counts)


def _grams_of(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def candidates(index: GramIndex, query: str, terms: list[str]) -> tuple[DataFrame, int]:
    """(seq) of the texts that may hold the query, or enough of the terms in text and path; written, with their number."""
    wanted = list(dict.fromkeys([query, *terms]))
    grams = {w: _grams_of(w) for w in wanted if len(w) >= 3}
    asked = sorted({g for own in grams.values() for g in own})
    # A row a trigram of the query.
    n = {(r.gram, r.in_path): r.n for r in index.counts.where(F.col("gram").isin(asked)).collect()} if asked else {}
    chosen = {(w, p): sorted(own, key=lambda g: (n.get((g, p), 0), g))[:READ] for w, own in grams.items() for p in (False, True)}
    read = sorted({g for own in chosen.values() for g in own})
    short = [w for w in wanted if 0 < len(w) < 3]
    here = reduce(Column.__or__, [F.col("gram").startswith(w) for w in short], F.col("gram").isin(read))
    hit = index.postings.where(here)
    held = []
    for k, w in enumerate(wanted):
        for p in (False, True):
            mine = F.col("in_path") == p
            if w in short:
                held.append(F.max((mine & F.col("gram").startswith(w)).cast("int")).alias(f"w{k}_{int(p)}"))
            elif w in grams:
                own = chosen[w, p]
                held.append((F.sum((mine & F.col("gram").isin(own)).cast("int")) == len(own)).cast("int").alias(f"w{k}_{int(p)}"))
            else:
                held.append(F.lit(1).alias(f"w{k}_{int(p)}"))  # an empty string is in every text
    found = hit.groupBy("seq").agg(*held)
    of = lambda word, p: F.col(f"w{wanted.index(word)}_{p}")
    either = reduce(Column.__add__, [F.greatest(of(t, 0), of(t, 1)) for t in terms], F.lit(0))
    in_path = reduce(Column.__add__, [of(t, 1) for t in terms], F.lit(0))
    needed = min(3, len(terms))
    enough = either >= F.when(in_path > 0, min(2, needed)).otherwise(needed)
    return written_rows(found.where((of(query, 0) == 1) | enough).select("seq"))


def indexed_text_hits(index: GramIndex, query: str, terms: list[str], limit: int) -> DataFrame:
    """As ``text_hits`` over all texts, of which only candidates are read; a query and terms without a character read all."""
    q, low = query.strip().lower(), [t.lower() for t in terms]
    if not q or not all(low) or not low:
        return text_hits(index.texts.rows, query, terms, limit)
    found, n = candidates(index, q, low)
    return text_hits(index.texts.beside(found, n, "seq").select("path", "text", "seq"), query, terms, limit)


# Names


def characters(text: Column) -> Column:
    """The set of a text's characters as bits: letters and digits have their own, the rest share by code."""
    codes = F.transform(F.array_distinct(F.split(F.lower(text), "")), lambda c: F.when(c == "", 0).otherwise(F.pow(F.lit(2.0), F.ascii(c) % 63).cast("long")))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@dataclass
class NameIndex:
    """names(name, characters), distinct; holders(name, id) sorted by name."""

    names: DataFrame
    holders: DataFrame


def build_names(nodes: DataFrame) -> NameIndex:
    """The dictionary of nodes (id, name)."""
    holders = written(nodes.where("name is not null").select("name", "id").repartitionByRange("name", "id").sortWithinPartitions("name", "id"))
    return NameIndex(written(holders.select("name").distinct().withColumn("characters", characters(F.col("name")))), holders)


#: Points of a matched character, of gaps, and of where in a name a match stands.
MATCH, GAP_START, GAP_EXTENSION, CONSECUTIVE, FIRST = 16, 3, 1, 4, 2
AFTER_BLANK, AFTER_DELIMITER, AFTER_OTHER, CAMEL = 10, 9, 8, 5
_BLANK, _DELIMITER, _OTHER, _LOWER, _UPPER, _DIGIT = range(6)
_NONE = -(1 << 20)


def _class(c: Column) -> Column:
    kinds = ((r"\s", _BLANK), ("[/,:;|]", _DELIMITER), (r"\p{N}", _DIGIT), (r"\p{Lu}", _UPPER), (r"\p{L}", _LOWER))
    return reduce(lambda w, k: w.when(c.rlike(f"^{k[0]}$"), k[1]), kinds, F).otherwise(_OTHER)  # type: ignore[arg-type]


def _place_bonus(before: Column, own: Column) -> Column:
    """What a match at a character is worth by its class and that of the one before."""
    starts = F.when(before == _BLANK, AFTER_BLANK).when(before == _DELIMITER, AFTER_DELIMITER).when(before == _OTHER, AFTER_OTHER)
    camel = ((before == _LOWER) & (own == _UPPER)) | ((before != _DIGIT) & (own == _DIGIT))
    return F.when((own > _OTHER) & (before <= _OTHER), starts).when(camel, CAMEL).when(own == _OTHER, AFTER_OTHER).when(own == _BLANK, AFTER_BLANK).otherwise(0)


def subsequence_score(name: Column, query: str) -> Column:
    """The best score of ``query`` as a subsequence of ``name``, without regard to case; null where it is none.

    A fold over the name's characters, each classed once, before it. For each character of the query it keeps the best score with
    that character matched just now, and with it matched earlier. A match earns its points and what its
    place is worth (the first of the query twice); one that follows a match at once at least what the run's
    best start was worth. A gap between matches costs for its start and for each further character.
    """
    q = list(query.lower())
    # What a step reads many times is a field here: an expression would be evaluated at each place that it stands in.
    chars = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.struct(F.lower(c).alias("low"), _class(c).cast("int").alias("own")))
    start = F.struct(F.lit(_BLANK).alias("before"), F.lit(_NONE).alias("best"), F.array_repeat(F.struct(F.lit(_NONE).alias("now"), F.lit(0).alias("run"), F.lit(_NONE).alias("then")), len(q)).alias("at"))
    wanted = F.array(*[F.lit(c) for c in q])

    def step(acc: Column, c: Column) -> Column:
        own = c["own"]
        place = _place_bonus(acc["before"], own)

        def one(x: Column, j: Column) -> Column:
            hit = c["low"] == F.get(wanted, j)
            # Of the character before in the query.
            last = F.get(acc["at"], j - 1)
            run = F.when((place >= AFTER_OTHER) & (place > last["run"]), place).otherwise(last["run"])
            joined = last["now"] + F.greatest(place, run, F.lit(CONSECUTIVE))
            apart = last["then"] + place
            score = F.when(j == 0, MATCH + place * FIRST).otherwise(MATCH + F.greatest(joined, apart))
            fresh = F.when(hit, F.greatest(score, F.lit(_NONE))).otherwise(_NONE)
            kept_run = F.when((j > 0) & (joined >= apart), run).otherwise(place)
            return F.struct(fresh.cast("int").alias("now"), F.when(hit, kept_run).otherwise(0).cast("int").alias("run"), F.greatest(x["now"] - GAP_START, x["then"] - GAP_EXTENSION, F.lit(_NONE)).cast("int").alias("then"))

        at = F.transform(acc["at"], one)
        return F.struct(own.alias("before"), F.greatest(acc["best"], F.get(at, F.lit(len(q) - 1))["now"]).alias("best"), at.alias("at"))

    return F.aggregate(chars, start, step, lambda acc: F.when(acc["best"] > 0, acc["best"]))


def _may_hold(name: Column, query: str) -> Column:
    """Whether the query's ASCII characters stand in the name in their order, a test that few names need be scored after; other characters may lower differently within a word."""
    asked = [f"\\{c}" if c in "\\%_" else c for c in query.lower() if c.isascii()]
    return F.lower(name).like(f"%{'%'.join(asked)}%")


def _shape(name: Column, query: str) -> Column:
    """The name with its ASCII digits, small and capital letters that the query lacks as one of each kind: it scores as the name does, and many names share it."""
    own = set(query.lower())
    kinds = [[c for c in kind if c.lower() not in own] for kind in (string.digits, string.ascii_lowercase, string.ascii_uppercase)]
    return F.translate(name, "".join(c for kind in kinds for c in kind), "".join(kind[0] * len(kind) for kind in kinds if kind))


def fuzzy_symbols(index: NameIndex, query: str, limit: int = 200) -> DataFrame:
    """(id, name, score) of the names that hold the query as a subsequence, those equal to it or ending or beginning in it first."""
    q = query.strip()
    if not q:
        return index.holders.limit(0).select("id", "name", F.lit(0).alias("score"))
    mask = index.holders.sparkSession.range(1).select(characters(F.lit(q)).alias("m")).first()["m"]
    low = q.lower()
    exact = F.struct((F.lower("name") == low).alias("display"), (F.lower(terminal(F.col("name"))) == low).alias("terminal"), (F.lower(leading(F.col("name"))) == low).alias("leading"))
    may = (F.col("characters").bitwiseAND(F.lit(mask)) == mask) & _may_hold(F.col("name"), q)
    held = index.names.where(may).select("name", _shape(F.col("name"), q).alias("shape"))
    # Exploded, a score is computed once; a filter on it would compute it beside the projection.
    shapes = held.select("shape").distinct().select("shape", F.explode(F.array_compact(F.array(subsequence_score(F.col("shape"), q)))).alias("score"))
    scored = held.join(shapes, "shape").select("name", "score", exact.alias("exact"))
    # Each name has a bearer, so as many names as rows are asked for hold them all.
    order = [F.desc("exact"), F.desc("score"), F.col("name")]
    best = scored.orderBy(*order).limit(limit).collect()
    top = index.holders.sparkSession.createDataFrame([(r.name, r.score, i) for i, r in enumerate(best)], "top string, score int, place int")
    bearers = index.holders.where(F.col("name").isin([r.name for r in best])) if best else index.holders.limit(0)
    return bearers.join(F.broadcast(top), F.col("name") == F.col("top")).orderBy("place", "id").limit(limit).select("id", "name", "score")
