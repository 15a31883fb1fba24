"""Personal data: high-recall candidate spans, boosted trees, calibrated thresholds; DataFrame functions only.

1. Base spans of four kinds (email, ip, card, phone) are found by fixed patterns and checks; they
   are always kept.
2. Generators with much looser patterns propose further, overlapping spans of the same kinds:
   spelt-out addresses, other separators, numbers without a plus or of other lengths.
3. Each candidate is described by its format (digit count, separators, checksum, part sizes) and
   the characters next to it, all in a few values. What the trees learn is held back from them: a
   telling word before the candidate. Base spans show how often such a word precedes true spans of
   a kind, candidates of the other kinds how often it precedes anything, so the share of telling
   words of a description gives the number of true spans in it, whether or not a base pattern
   matches them. Counts of descriptions cover all documents and are few whatever the input; on them
   the driver fits boosted trees of depth two for logistic loss, written here.
4. The trees become column expressions. A threshold per kind is calibrated on the candidates that
   could be added, the least score from which on at least ``PRECISION`` of them are true by the
   same evidence; candidates beyond it are added where they meet no base span and no better one.
   A kind whose base spans are fewer than ``EVIDENCE``, or whose telling words are no more frequent
   before them than elsewhere by ``CONTRAST``, gives no evidence and adds none.

Defined results: null and empty texts have no spans (digest of an empty string); positions are
code points, ends exclusive; repeated rows are documents of their own; an empty table gives an
empty result; other columns are ignored here and kept by ``redact``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read_table, text_of, unfolded, whole_row

KINDS = ("email", "ip", "card", "phone")
PRECISION, ROUNDS, RATE, PRIOR = 0.9, 16, 0.4, 2.0
EVIDENCE, CONTRAST = 20, 0.2
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that no start within a run is tried twice.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[.,:][0-9]{1,3}){3,5}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,22}+",
    "phone": r"\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,17}+",
}
#: Words before a candidate that tell its kind.
CUES = {"email": r"mail|contact|write|schreib", "ip": r"\bip\b|host|server|addr", "card": r"card|visa|master|carte|karte|tarjeta|credit", "phone": r"phone|tel|call|fax|mobil|whatsapp"}
FEATURES = ("kind", "digits", "separated", "checksum", "parts", "plus", "left", "right")
#: What some loose pattern needs to match.
TRIGGER = r"[0-9@]|\[at\]|\(at\)"


def sums_before(values: Column, chunk: int = 256) -> Column:
    """Exclusive prefix sums of an array, in chunks so that long arrays don't cost their square."""

    def short(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")))["out"]

    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / chunk), F.lit(0)).cast("int")), lambda c: F.slice(values, c * chunk + 1, chunk))
    return F.flatten(F.zip_with(chunks, short(F.transform(chunks, total)), lambda own, base: F.transform(short(own), lambda p: p + base)))


def spans_of(text: Column, pattern: str) -> Column:
    """All leftmost matches, in order: array of (found, start, end) in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sized = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(m.alias("found"), F.length(m).cast("long").alias("m"), F.length(g).cast("long").alias("g")))
    with_base = F.zip_with(sized, sums_before(F.transform(sized, lambda x: x["m"] + x["g"])), lambda x, p: F.struct(x["found"].alias("found"), (p + x["g"]).alias("start"), (p + x["g"] + x["m"]).alias("end")))
    empty = F.array().cast("array<struct<found:string,start:bigint,end:bigint>>")
    return F.when(F.size(found) > 0, with_base).otherwise(empty)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _parts_fit(found: Column) -> Column:
    """Whether every number of it is at most 255."""
    return F.forall(F.split(found, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def base_valid(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    return {
        "email": F.lit(True),
        "ip": _parts_fit(found),
        "card": F.when(n.between(16, 19), _luhn(_digits(found))).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
    }[kind]


def _described(text: Column, kind: str, x: Column) -> Column:
    """Kind, place, features and telling words (a bit for each kind's) of a candidate; every feature has few values."""
    found, start, end = x["found"], x["start"], x["end"]
    digits = _digits(found)
    n = F.length(digits)
    bucket = F.when(n == 0, 0).when(n < 7, 1).when(n < 8, 2).when(n <= 11, 3).when(n <= 12, 4).when(n <= 15, 5).when(n <= 19, 6).otherwise(7)
    before = F.lower(F.substring(text, F.greatest(start - 24, F.lit(0)).cast("int") + 1, F.least(start, F.lit(24)).cast("int")))
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\s,;:()\[\]]"), 1).when(c.rlike("^[A-Za-z0-9]"), 2).otherwise(3)
    last = F.when(start > 0, F.substring(text, start.cast("int"), F.lit(1))).otherwise(F.lit(""))
    after = F.substring(text, end.cast("int") + 1, F.lit(1))
    separated = {"email": F.when(found.rlike(r"^[^\x20\[(]+@[^\x20\[(]+\.[^\x20\[(]+$"), 0).when(found.rlike(r"@.*(\.|dot)"), 1).when(found.rlike("@"), 2).otherwise(3), "ip": F.when(found.rlike(r"^[0-9]+(\.[0-9]+){3}$"), 0).otherwise(1)}.get(kind, F.when(found.rlike("^[+0-9]*$"), 0).when(found.rlike(r"[./]"), 2).otherwise(1))
    return F.struct(
        F.lit(kind).alias("kind_name"), start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), bucket.alias("digits"), separated.alias("separated"),
        F.when(n.between(12, 23), _luhn(digits)).otherwise(F.lit(False)).cast("int").alias("checksum"), F.when(F.lit(kind == "ip"), _parts_fit(found)).otherwise(F.lit(False)).cast("int").alias("parts"),
        F.startswith(found, F.lit("+")).cast("int").alias("plus"), reduce(Column.__add__, [before.rlike(CUES[k]).cast("int") * (1 << b) for b, k in enumerate(KINDS)]).alias("cues"), side(last).alias("left"), side(after).alias("right"),
    )


def _with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``base`` (kind_name, start, end) and ``candidates``; texts that no pattern can match are passed by."""
    d = docs.withColumn("scanned", F.when(text.rlike(TRIGGER), text))
    seen, t = F.col("scanned").isNotNull(), F.col("scanned")
    for kind in KINDS:
        d = d.withColumn(f"all_{kind}", F.when(seen, spans_of(t, BASE[kind]))).withColumn(f"loose_{kind}", F.when(seen, spans_of(t, LOOSE[kind])))
    def good(kind: str) -> Column:
        kept = F.filter(f"all_{kind}", lambda x: base_valid(kind, x["found"]))
        return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind_name"), x["start"].alias("start"), x["end"].alias("end")))

    def loose(kind: str) -> Column:
        return F.transform(f"loose_{kind}", lambda x: _described(t, kind, x))

    d = d.withColumn("base", F.when(seen, F.concat(*map(good, KINDS))))
    d = d.withColumn("candidates", F.when(seen, F.concat(*map(loose, KINDS))))
    return d.drop("scanned", *[f"{p}_{k}" for p in ("all", "loose") for k in KINDS])


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


Tree = tuple[str, int, tuple[tuple[str, int, float, float], tuple[str, int, float, float]]]


def fit_trees(rows: list[tuple[dict[str, int], float, float]]) -> tuple[float, list[Tree]]:
    """Boosted trees of depth two on (features, confirmed, others): start value and trees.

    A tree is a test (feature, value: equal goes right, else left) with a test and two values on each side.
    """
    yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
    start = math.log((yes + 1) / (no + 1))
    scores = [start] * len(rows)
    trees: list[Tree] = []
    tests = sorted({(f, v) for r in rows for f, v in r[0].items()})
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        slopes = [y * (1 - q) - n * q for (_, y, n), q in zip(rows, p)]
        bends = [(y + n) * q * (1 - q) for (_, y, n), q in zip(rows, p)]

        def split(own: list[int]) -> tuple[float, str, int, float, float]:
            g, h = sum(slopes[i] for i in own), sum(bends[i] for i in own)
            best = (-1.0, *(tests[0] if tests else ("kind", -1)), RATE * g / (h + PRIOR), RATE * g / (h + PRIOR))
            for f, v in tests:
                gr, hr = sum(slopes[i] for i in own if rows[i][0][f] == v), sum(bends[i] for i in own if rows[i][0][f] == v)
                gain = gr * gr / (hr + PRIOR) + (g - gr) ** 2 / (h - hr + PRIOR) - g * g / (h + PRIOR)
                if gain > best[0] + 1e-12:
                    best = (gain, f, v, RATE * (g - gr) / (h - hr + PRIOR), RATE * gr / (hr + PRIOR))
            return best

        _, f, v, _, _ = split(list(range(len(rows))))
        sides = [[i for i, r in enumerate(rows) if (r[0][f] == v) == right] for right in (False, True)]
        leaves = [split(own)[1:] for own in sides]
        trees.append((f, v, (leaves[0], leaves[1])))
        for own, (g, w, low, high) in zip(sides, leaves):
            for i in own:
                scores[i] += high if rows[i][0][g] == w else low
    return start, trees


def score_of(features: dict[str, int], model: tuple[float, list[Tree]]) -> float:
    total = model[0]
    for f, v, leaves in model[1]:
        g, w, low, high = leaves[features[f] == v]
        total += high if features[g] == w else low
    return total


def score_column(x: Column, model: tuple[float, list[Tree]]) -> Column:
    leaf = lambda t: F.when(x[t[0]] == t[1], F.lit(t[3])).otherwise(F.lit(t[2]))
    return reduce(Column.__add__, [F.when(x[f] == v, leaf(right)).otherwise(leaf(left)) for f, v, (left, right) in model[1]], F.lit(model[0]))


def calibrate(rows: list[tuple[dict[str, int], float, float]], model: tuple[float, list[Tree]], precision: float = PRECISION) -> dict[int, float]:
    """Per kind the least score from which on the candidates are true at that rate; infinite if there is none.

    Both all candidates from the score on (one failure is assumed beside those seen) and, going
    down, those of each score by themselves must reach the rate.
    """
    out = {}
    for kind in range(len(KINDS)):
        counts: dict[float, list[float]] = {}
        for features, yes, no in rows:
            if features["kind"] == kind:
                own = counts.setdefault(score_of(features, model), [0.0, 0.0])
                own[0], own[1] = own[0] + yes, own[1] + no
        out[kind], yes, no = math.inf, 0.0, 1.0
        for score in sorted(counts, reverse=True):
            y, n = counts[score]
            yes, no = yes + y, no + n
            if y < precision * (y + n):
                break
            if yes >= precision * (yes + no):
                out[kind] = score
    return out


def cue_rates(found: list[Row]) -> dict[int, tuple[float, float]]:
    """Per kind with evidence, how often its telling words precede its base spans and candidates of other kinds."""
    out = {}
    for kind in range(len(KINDS)):
        share = lambda rows: (sum(r["n"] for r in rows if r["cues"] >> kind & 1), sum(r["n"] for r in rows))  # noqa: B023, E731
        true, n_true = share([r for r in found if r["kind"] == kind and r["confirmed"]])
        other, n_other = share([r for r in found if r["kind"] != kind])
        # One word beside those seen is assumed elsewhere.
        rates = true / max(n_true, 1), (other + 1) / (n_other + 1)
        if n_true >= EVIDENCE and rates[0] - rates[1] >= CONTRAST:
            out[kind] = rates
    return out


def expected(found: list[Row], rates: dict[int, tuple[float, float]]) -> list[tuple[dict[str, int], float, float]]:
    """(features, true ones, others) of each description, by its share of telling words; none are true where there is no evidence but base spans."""
    groups: dict[tuple[int, ...], list[float]] = {}
    for r in found:
        own = groups.setdefault(tuple(int(r[f]) for f in FEATURES), [0.0, 0.0, 0.0])
        own[0] += r["n"]
        own[1] += r["n"] if r["cues"] >> r["kind"] & 1 else 0
        own[2] += r["n"] if r["confirmed"] else 0
    out = []
    for values, (n, cued, confirmed) in sorted(groups.items()):
        high, low = rates.get(values[0], (None, None))
        yes = confirmed if high is None else min(n, max(0.0, (cued - low * n) / (high - low)))
        out.append((dict(zip(FEATURES, values)), yes, n - yes))
    return out


def train(spanned: DataFrame) -> tuple[tuple[float, list[Tree]], dict[int, float]]:
    """Trees and thresholds from the counts of all candidates' descriptions; the number of descriptions is bounded."""
    c = spanned.where(F.size("candidates") > 0).select("base", F.explode("candidates").alias("c"))
    confirmed = F.exists("base", lambda b: (b["kind_name"] == F.col("c.kind_name")) & (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")))
    described = [F.col(f"c.{f}").alias(f) for f in (*FEATURES, "cues")]
    found = c.groupBy(*described, confirmed.alias("confirmed"), F.exists("base", lambda b: _meets(b, F.col("c"))).alias("met")).agg(F.count(F.lit(1)).alias("n")).collect()
    rates = cue_rates(found)
    model = fit_trees(expected(found, rates))
    thresholds = calibrate(expected([r for r in found if not r["met"]], rates), model)
    return model, {kind: t if kind in rates else math.inf for kind, t in thresholds.items()}


def _all_spans(model: tuple[float, list[Tree]], thresholds: dict[int, float]) -> Column:
    """Base spans and added ones, by kind as listed, then start."""
    plain = lambda x, score: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))
    scored = F.transform("candidates", lambda x: plain(x, score_column(x, model)))
    over = lambda x: reduce(Column.__or__, [(x["kind"] == k) & (x["score"] >= F.lit(t)) for k, t in thresholds.items() if t < math.inf], F.lit(False))
    fresh = F.filter(scored, lambda x: over(x) & ~F.exists("base", lambda b: _meets(b, x)))
    # Of overlapping candidates the best stays: higher score, then earlier, then longer.
    best = F.filter(fresh, lambda x: ~F.exists(fresh, lambda y: _meets(x, y) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & ((y["end"] > x["end"]) | ((y["end"] == x["end"]) & (y["kind"] < x["kind"])))))))))
    index = lambda b: reduce(lambda w, k: w.when(b["kind_name"] == k, KINDS.index(k)), KINDS, F)
    base = F.transform("base", lambda b: F.struct(index(b).alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    added = F.transform(best, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.array_sort(F.concat(base, added))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ","), F.lit(""))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): ``spans`` an array of (kind index, start, end), ``base`` likewise by name."""
    spanned = cut(_with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), text_of()).drop("text"))
    model, thresholds = train(spanned)
    return spanned.select("doc_id", "base", _all_spans(model, thresholds).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, as [EMAIL]; overlapping spans become one of the first's kind.

    The rows are written once beside their spans, so the patterns run once.
    """
    text = F.col("row").getField("text").cast("string")
    spanned = cut(_with_spans(docs.select(whole_row(docs).alias("row")), F.coalesce(text, F.lit(""))))
    model, thresholds = train(spanned)
    d = spanned.withColumn("spans", _all_spans(model, thresholds))
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.element_at(names, s["kind"] + 1))
        apart = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts"))
        return F.when(s["start"] >= acc["at"], apart).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    walked = F.aggregate("marks", begin, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    d = d.withColumn("marks", by_place).withColumn("clean", F.when(F.size("marks") > 0, walked).otherwise(text))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("marks") > 0, F.length("clean").cast("long")).otherwise(F.col("row").getField("n_chars"))
    return unfolded(d, "row", docs.columns, changed)


def op7(spark, sf_dir: str) -> DataFrame:
    found = find(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda b: b["kind_name"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    index = lambda b: reduce(lambda w, k: w.when(b["kind_name"] == k, KINDS.index(k)), KINDS, F)
    base = F.transform("base", lambda b: F.struct(index(b).alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
