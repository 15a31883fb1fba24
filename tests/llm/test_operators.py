"""Each operator against brute force on a small table with nulls, copies, ties, empty and long texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import bsi, fingerprints, jaccard_join, mixing, packing, pii, sharding, substring_dedup, toxicity, url_filter

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, key string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def texts():
    word = lambda i: f"w{i * 7919 % 997}"
    base = " ".join(word(i) for i in range(120))
    edited = base.replace(word(60), "other", 1)
    phrase = " ".join(f"p{i}" for i in range(40))
    pii_text = "Mail a.b@c.example.com, host 10.0.0.1 or 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 123-4567."
    return [base, base, edited, base.upper(), "", None, "one", "one two three", f"x {phrase} y", f"z\n{phrase}\tq", pii_text, "ünï cödé " * 50, " ".join(word(i) for i in range(3000, 9000)), "   ", f"{phrase} {phrase}"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k == 3 else "en", None if k % 5 == 4 else f"s{k % 3}", None, "clash") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0]], SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def split(t):
    return (t or "").encode().split()


def test_jaccard_join(docs, empty):
    for k, percent in ((4, 85), (5, 80)):
        sets = {}
        for i, t in enumerate(texts()):
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        root = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        found = jaccard_join.similarity_components(docs, k, percent).collect()
        assert len(found) == 16 and all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id]) for r in found)
    assert jaccard_join.similarity_components(empty, 4, 85).count() == 0


@pytest.mark.parametrize("most", [1000, 2, 0])
def test_substring_dedup(docs, empty, most):
    rows = [*enumerate(texts()), (0, texts()[0])]
    counts = Counter(tuple(w[j : j + 10]) for _, t in rows for w in [split(t)] for j in range(len(w) - 9))
    expected = {}
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - 9):
            if counts[tuple(w[j : j + 10])] > 1:
                gone[j : j + 10] = [True] * 10
        expected[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    found = substring_dedup.dedup_texts(docs, 10, False, most).collect()
    assert len(found) == 16 and all((r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id] for r in found)
    assert substring_dedup.dedup_texts(empty, 10, False).count() == 0
    kept = {r.doc_id: (r.kept, r.kept_sha256) for r in substring_dedup.dedup_texts(docs, 10, True).collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == h == expected[i][2] for i, (t, h) in kept.items())


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    found = packing.pack_documents(docs, TOKENIZER, 512).collect()
    expected = set()
    for i, t in enumerate(texts()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected |= {(i, p, at, len(ids[at : at + 512]), zlib.crc32(np.asarray(ids[at : at + 512], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 512))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == expected
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 512
    assert len(places) <= -(-sum(r.length for r in found) // 512) + 1
    assert packing.pack_documents(empty, TOKENIZER, 512).count() == 0


def test_plans_use_every_length_once():
    for counts in ({5: 3, 95: 2, 50: 5, 33: 9, 100: 2}, {}, {60: 7}, {1: 1000}):
        plan = packing.plan_patterns(counts, 100)
        used = Counter()
        for n, parts in plan:
            assert sum(parts) <= 100
            used.update({x: n * c for x, c in Counter(parts).items()})
        assert used == Counter(counts)


def test_fingerprints(docs, empty, spark):
    found = fingerprints.with_edits(docs).collect()
    assert len(found) == 16
    order = sorted([*enumerate(texts()), (0, texts()[0])], key=lambda r: -r[0])
    after = {i: order[(k + 1) % 16][1] or "" for k, (i, _) in enumerate(order)}
    for r in found:
        t = texts()[r.doc_id] or ""
        half = len(t) // 2
        edits = {hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest() for n in (after[r.doc_id], t if r.doc_id == 0 else after[r.doc_id])}
        assert r.n_chars == len(t) and r.edited_sha256 in edits and 0 <= r.near_edited <= 1
    by = defaultdict(set)
    for r in found:
        by[texts()[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.with_edits(empty).count() == 0


def test_fingerprint_likeness_is_near_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0, 500, 900):
        a, b = pool[:1000], np.concatenate([pool[:share], pool[1000 : 2000 - share]])
        s = fingerprints.signatures([a, b])
        assert abs(fingerprints.likeness(s[0], s[1]) - share / (2000 - share)) < 0.1
    one = fingerprints.signatures([pool[:1]], 64, 4)[0]
    assert (fingerprints.unpacked(fingerprints.packed(one, 4), 64, 4) == one).all()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_pii(spark, docs, empty):
    odd = ["é a@b.c_d@e.f x@y @z.w", "1.2.3.4.5.6.7.8 1.2.3 001.2.3.4", "12 34-56 4111-1111-1111-1111 " + "9" * 500, "+12345678 +1 +1234567890123456 +(1)", "7 " * 600]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id > 4"))
    by_id = dict(enumerate(texts())) | dict(enumerate(odd))
    for r in pii.find(table).collect():
        expected = list(base_spans(by_id[r.doc_id] or ""))
        assert [f"{b.kind_name}:{b.start}:{b.end}" for b in r.base or []] == expected
        assert {f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.spans or []} >= set(expected)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[10] == "Mail [EMAIL], host [IP] or 300.1.1.1, card [CARD], call [PHONE]." and clean[0] == texts()[0] and clean[5] is None
    assert pii.redact(docs).columns == docs.columns and pii.find(empty).count() == 0


def test_mixing(docs, empty):
    found = mixing.mix_documents(docs).collect()
    assert sorted(found) == sorted(mixing.mix_documents(docs).collect()) and len(found) == 16
    sizes = {i: len(split(t)) for i, t in enumerate(texts())}
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * sum(r.size for r in found)) < 1e-6
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns and sum(len(split(r.text)) for r in mixed.collect()) == sum(r.taken for r in found)
    assert mixing.mix_documents(empty).count() == 0


def test_the_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        image = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(n).cast("long"), F.lit(5).cast("long"))).alias("x")).collect()
        assert sorted(r.x for r in image) == list(range(n))


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [[float(x) for x in rng.normal(size=6)] for _ in range(300)]
    vectors[50], vectors[7], vectors[8], vectors[9] = vectors[40], None, [float("nan")] * 6, [None, *vectors[1][1:]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, values string")
    q = df.select("vec_id", bsi.quantised("embedding", 64).alias("values")).where("values is not null")
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in enumerate(vectors) if i not in (7, 8, 9)}
    found = defaultdict(list)
    for r in sorted(bsi.top_k(q, q.where("vec_id % 20 = 0"), 20, block_rows=64).collect()):
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i in range(0, 300, 20):
        best = sorted((-int(whole[i] @ v), j) for j, v in whole.items() if j != i)[:20]
        assert found[i] == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert bsi.top_k(q.limit(0), q.limit(0), 20).count() == 0


def test_sharding(spark, docs, empty):
    table = sharding.lookup_table({f"s{i}": 1 for i in range(7)}, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table({f"s{i}": 1 for i in range(6)}, 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != "s6") < 0.2 * 1009
    rows = sharding.place(docs.withColumnRenamed("key", "slot"), ["doc_id"], {"a": 1, "b": 2}, 1009).collect()
    assert len(rows) == 16 and len({r.shard for r in rows if r.doc_id == 0}) == 1
    assert sharding.place(empty, ["doc_id"], {"a": 1}, 1009).count() == 0


def test_url_filter(spark):
    urls = ["http://A.example.COM/en/1?x", "https://www.example.com/en/2", "http://x.net/es/3", "http://x.net/de/3#t", "ftp://h?q", None, "no host", "http://notcom/en/", "http://example.com/en", "http://fr.net/fr/9.html"]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert found == {
        0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 2: ("x.net", "/es/3", "net/es/", "block"), 3: ("x.net", "/de/3", None, "allow"),
        4: ("h", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("notcom", "/en/", None, "allow"), 8: ("example.com", "/en", "com/", "allow"), 9: ("fr.net", "/fr/9.html", "net/fr/", "block"),
    }
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_toxicity(spark, docs, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, bad = scored.score.rank(), scored.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / bad.sum() / (~bad).sum()
    assert auc > 0.95 and scored[~bad].predicted.mean() < 0.02 and scored[bad].predicted.mean() > 0.8
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 16 and {r.predicted for r in none} == {0}
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0 and toxicity.keep_clean(docs, toxicity.fit(docs, labels.limit(0))).count() == 16
