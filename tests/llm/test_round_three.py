"""Exponion clusters, language models over segmentations, resampling; exact ids, drawn shards and near copies under repeated ids."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import exponion, importance, language_id, mixing, packing
from loomgraph.llm.queries import QUERIES
from loomgraph.llm.tokens import buffers

SF = "/root/testdata/sf0.01"


# Exponion clusters


def plain_clusters(rows, k, rounds, seed=2, scale=256):
    """Every vector against every centroid, in whole numbers without a bound."""
    most = exponion.limit(len(rows[0][1]))
    kept = [(i, [max(-most, min(most, math.floor(scale * x))) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    centroids = [list(v) for _, _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                members = [v for (_, v), (_, c) in zip(kept, own) if c == j]
                if members:
                    centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted((i, j, d) for (i, _), (d, j) in zip(kept, own)), centroids


def clustered(spark, rows, k, rounds=3, **more):
    found = exponion.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=len(rows[0][1]), k=k, rounds=rounds, **more)
    return sorted(tuple(r) for r in found.vectors.collect()), found


def test_clusters_equal_brute_force_with_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    grid = [(i, [float(x) / 256 for x in rng.integers(-3, 4, 3)]) for i in range(300)]  # few places, so distances tie all over
    rows = grid + grid[:50] + [(1000 + i, grid[0][1]) for i in range(80)]
    for k in (1, 2, 7, 40):
        got, found = clustered(spark, rows, k, block_rows=64)
        want, centroids = plain_clusters(rows, k, 3)
        assert got == want and found.centroids.tolist() == centroids, k


def test_balls_leave_most_centroids_unread(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (c + 0.05 * rng.standard_normal(4)).tolist()) for i, c in enumerate(rng.standard_normal((40, 4)).repeat(50, axis=0))]
    got, found = clustered(spark, rows, 40, 4)
    assert got == plain_clusters(rows, 40, 4)[0]
    assert found.scanned[0] == 2000 * 40 and all(n < 2000 * 12 for n in found.scanned[1:])


def test_wide_values_are_held_and_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(2**23), 2**23, 6)]) for i in range(60)] + [(90, [1e30] * 6), (91, [-1e30] * 6), (92, [1e30, -1e30] * 3)]
    assert clustered(spark, rows, 5)[0] == plain_clusters(rows, 5, 3)[0]


def test_cluster_rows_that_take_no_part(spark):
    fine = [(i, [i / 8.0, -i / 4.0]) for i in range(12)]
    rows = [(None, [0.3, 0.1]), *fine, (50, None), (51, [1.0]), (52, [1.0, None]), (53, [float("nan"), 0.0]), (54, [float("inf"), 0.0]), (55, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    found = exponion.cluster_vectors(df, dims=2, k=40, rounds=2)
    got = exponion.with_inertia(found).collect()
    assert len(got) == 13
    assert len(found.centroids) == 12 and {r.inertia for r in got} == {sum(r.distance for r in got)}
    none = exponion.with_inertia(exponion.cluster_vectors(df.where("vec_id > 49"), dims=2))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        exponion.cluster_vectors(df, k=exponion.MOST_CENTROIDS + 1)


# Language models


def cuttings(word, number, longest, unknown):
    """All ways to cut ``word`` into numbered pieces."""
    if not word:
        return [[]]
    out = []
    for m in range(1, min(len(word), longest) + 1):
        piece = number.get(word[:m], unknown if m == 1 else None)
        if piece is not None:
            out += [[piece, *rest] for rest in cuttings(word[m:], number, longest, unknown)]
    return out


def test_forward_pass_sums_all_segmentations():
    rnd = random.Random(2)
    pieces = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(40)} | {"▁", "▁a", "▁ab"} - {"c"})
    pieces = [p for p in pieces if p != "c"]  # a character that the vocabulary lacks
    vocabulary, number = language_id.Vocabulary(pieces), {p: i for i, p in enumerate(pieces)}
    rng = np.random.default_rng(1)
    probability = np.vstack([rng.random((len(pieces), 3)), np.full((1, 3), 1e-8), np.zeros((1, 3))])
    for n in (1, 2, 5, 9):
        words = ["▁" + "".join(rnd.choice("abcd") for _ in range(n - 1)) for _ in range(7)]
        numbers = vocabulary.substrings(words)
        logs, shares = language_id.forward(numbers, probability.__getitem__, shares=True)
        times = language_id.expected(shares)
        for i, word in enumerate(words):
            ways = cuttings(word, number, vocabulary.longest, len(pieces))
            for lang in range(3):
                assert math.isclose(logs[i, lang], math.log(sum(math.prod(probability[p, lang] for p in way) for way in ways)), abs_tol=1e-9)
            likely = [math.prod(probability[p, 0] for p in way) for way in ways]
            want, got = np.zeros(len(pieces) + 1), np.zeros(len(pieces) + 1)
            for way, p in zip(ways, likely):
                np.add.at(want, way, p / sum(likely))
            np.add.at(got, numbers[i][numbers[i] >= 0], times[i][numbers[i] >= 0])
            assert np.allclose(got, want)
    long = "▁" + "abdc" * 5000
    logs, _ = language_id.forward(vocabulary.substrings([long]), probability.__getitem__)
    assert np.isfinite(logs).all()


def test_a_round_of_fitting_raises_the_likelihood(spark):
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    docs = spark.createDataFrame([("x", "ab abab ba a"), ("x", "abba"), ("y", "b bb aab"), ("y", None), (None, "bbbb")], "lang string, text string")
    words = {"x": ["ab", "abab", "ba", "a", "abba"], "y": ["b", "bb", "aab"]}
    before = None
    for rounds in (0, 1, 2, 3):
        model = language_id.fit(docs, pieces, rounds)
        assert model.languages == ["x", "y"] and np.allclose(np.exp(model.priors), [2 / 3, 1 / 3])
        assert np.allclose(model.probabilities[:-1].sum(axis=0), 1)
        own = sum(model.word_scores(words[lang])[:, i].sum() for i, lang in enumerate(model.languages))
        assert before is None or own > before - 1e-6 or rounds == 1
        before = own


def test_language_query_on_held_out_rows(spark):
    rows = QUERIES["op12_language_id"](spark, SF).collect()
    known = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(rows) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and known[r.doc_id][0] and re.search(r"[^\W\d_]", known[r.doc_id][1] or "")]
    assert len(judged) > 150 and sum(r.lang_pred == known[r.doc_id][0] for r in judged) >= 0.97 * len(judged)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    learned = [(i, t, lang, "c") for i, (t, lang) in enumerate([("the house of the man", "en"), ("das Haus ist sehr schön", "de")] * 20)]
    odd = [(100, None, "en", "c"), (101, "", None, "c"), (102, "123 --- !!", "de", "c"), (None, "the house", "de", "c"), (104, "DAS HAUS " * 5000, None, "c"), (105, "x" * 200_000, None, "c"), (106, "schön", None, "c"), (1, "das Haus ist", "de", "c")]
    docs = spark.createDataFrame(learned + odd, "doc_id long, text string, lang string, score string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in language_id.identify(docs, path).collect() if r.doc_id is None or r.doc_id >= 100}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert (got[None].lang_pred, got[None].held_out) == ("en", False) and got[104].lang_pred == "de" and got[106].lang_pred == "de"
    assert got[105].lang_pred in ("de", "en")
    assert language_id.identify(docs.limit(0), path).count() == 0
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), path)
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


# Resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def noisy_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abZ9 é.,-\n漢") for _ in range(rnd.randint(0, 200))) for _ in range(n)] + ["", None, "x" * 500 + " " + "y" * 70 + " z", "a", "é" * 40 + "," + "b"]


def test_streams_hold_every_feature():
    texts = noisy_texts(200)
    stream, n_features, n_words = importance.bucket_stream(*buffers(pa.array(texts)))
    at = 0
    for text, n, w in zip(texts, n_features, n_words):
        words, runs = features(text)
        assert (len(words), len(runs)) == (w, n)
        assert Counter(stream[at : at + n].tolist()) == Counter(zlib.crc32(x.encode()) % 10_000 for x in runs)
        at += n
    buckets, counts = importance.sorted_counts(stream)
    assert dict(zip(buckets.tolist(), counts.tolist())) == Counter(stream.tolist())
    whole = " ".join(t or "" for t in texts)
    for span in (1, 10, 97, 5000):
        parts, n, w = importance.bucket_stream(*buffers(pa.array([whole])), span)
        assert (w[0], n[0]) == (len(features(whole)[0]), len(features(whole)[1]))
        assert Counter(parts.tolist()) == Counter(zlib.crc32(x.encode()) % 10_000 for x in features(whole)[1])


def plain_draw(rows, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (S + 10_000) / ((s[k] + 1) * (T + 10_000))))
    out = []
    for i, text in rows:
        words, runs = features(text)
        weight = sum(gain(bucket(f)) for f in runs)
        h = i is not None and int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(runs), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((x for x in out if x[5] >= 20 and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for rank, x in enumerate(fit[: 5 * len(fit) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_resampling_of_odd_and_repeated_rows(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [rows[3]] * 100 + [(None, rows[5][1]), (None, None), (2000, None), (2001, ""), (2002, "long WORDS " * 30_000)]
    target = ["ax by cz " * 5, None, ""]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, rank string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(docs, wanted).select("doc_id", "n_features", "weight", "score", "rank")
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == plain_draw(rows, target)
    assert importance.resample(docs.limit(0), wanted).count() == 0
    assert sorted((tuple(r) for r in importance.resample(docs, wanted.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain_draw(rows, [])


# What earlier rounds had wrong


def test_encoding_by_words_equals_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, whole = packing.word_encoder(path), Tokenizer.from_file(path)
    rnd = random.Random(8)
    letters = "aZİıßéÉñǅŉΣςﬁªᾳक़́̇漢ऩ1_"
    texts = ["foo İ, bar", "İ. x", "क़, a", "é, a", "ŉ. b"]
    texts += ["".join(rnd.choice(letters + " \n.,,. '") for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]
    texts += ["".join(rnd.choice([chr(rnd.randint(33, 0x2FFF)), " ", ".", ",", "a"]) for _ in range(12)) for _ in range(5_000)]
    for text, own in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == own.ids, text


def test_mixed_texts_lie_by_their_drawn_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing.draw_slots, "__defaults__", (8,))
    rows = [(i, " ".join([f"w{i}"] * (20 + i % 50)), f"s{i % 3}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, sources, runs = mixing.mix(docs)
    starts = {(r["rank"], r.start): r.doc_id for r in placed.where("size > 0").join(sources.select(F.col("source").alias("s2"), "rank"), F.col("source") == F.col("s2")).collect()}
    drawn = runs.collect()
    seat, shards = {}, {}
    for r in drawn:
        doc = starts[r["rank"], r.start]
        seat[doc, r["pass"]] = min(seat.get((doc, r["pass"]), (1 << 40, 0)), (r.shard, r.slot))
        shards.setdefault(doc, set()).add(r.shard)
    mixed = mixing.mixed_texts(docs).withColumn("part", F.spark_partition_id()).collect()
    seats = Counter((doc, s) for (doc, _), s in seat.items())
    assert len(mixed) == sum(seats.values())
    by_part = {}
    for r in mixed:
        by_part.setdefault(r.part, []).append(r.doc_id)
    for docs_there in by_part.values():
        options = [{s for (d, s) in seats if d == doc} for doc in docs_there]
        low = (-1, -1)
        for own in options:  # each row's seat is at or after the one before it
            low = min(s for s in own if s >= low)
    firsts = {doc: min(s) for doc, s in shards.items()}
    found = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    assert all((found[d].n_shards, found[d].first_shard) == (len(shards.get(d, ())), firsts.get(d)) for d in found)
    assert len({s for own in shards.values() for s in own}) > 5 and any(f for f in firsts.values())


def test_near_copies_under_repeated_ids(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randint(0, 500)}" for _ in range(60)) for _ in range(3)]
    near = texts[2] + " more"
    rows = [(5, texts[0]), (5, near), (3, texts[2]), (5, texts[0]), (9, texts[0] + " more"), (7, texts[1])]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(5, texts[0]), (3, texts[2]), (7, texts[1])])


def test_words_are_encoded_apart_from_their_marks(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    asked = []

    class Asked:
        def __getattr__(self, name):
            return getattr(whole, name)

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **more)

    monkeypatch.setattr("tokenizers.Tokenizer", SimpleNamespace(from_file=lambda p: Asked()))
    rnd = random.Random(4)
    bits = [*"aBÀéßıİſ12.,!'#|<>\n\t ", "é", "̸", " ", "'s", "'LL", "<|startoftext|>", "<|startoftext", "Straße", "don't", ". ", ", "]
    for room in (10_000, 40, 0):
        monkeypatch.setattr(packing, "_encoders", {})
        encode = packing.word_encoder(path, room)
        for text in ("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(600)):
            assert np.frombuffer(encode(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(packing, "_encoders", {})
    asked.clear()
    encode = packing.word_encoder(path)
    for text in ("Word word, WORD.", "word### word!?\nwOrd."):
        encode(text)
    assert sorted(x for text in asked for x in text.split("<|startoftext|>")) == ["!?", "###", ",", ".", "word"]
