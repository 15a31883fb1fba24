"""The bigram models of toxicity against brute force, over small batches and buckets."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import toxicity
from loomgraph.llm.tokens import buffers, words


D = toxicity.DISCOUNTS


def brute(texts, labels):
    """For each text the six comparisons, from counts in dictionaries."""
    pairs = lambda t: list(zip([None, *t.split()], t.split()))
    count = [Counter(p for t, y in zip(texts, labels) if y == c for p in set(pairs(t))) for c in (1, 0)]
    after, mass, types = ([defaultdict(float), defaultdict(float)] for _ in range(3))
    for c in (0, 1):
        for (u, w), n in count[c].items():
            after[c][u] += n
            mass[c][u] += D[min(n, 3)]
            types[c][w] += 1
    shared = Counter(w for _, w in {p for t in texts for p in pairs(t)})

    def low(c, w):
        total = max(1, sum(types[c].values()))
        spare = max(1, sum(D[min(int(n), 3)] for n in types[c].values()))
        return max(types[c][w] - D[min(int(types[c][w]), 3)], 0) / total + spare / total * shared[w] / sum(shared.values())

    def high(c, u, w):
        if not after[c][u]:
            return low(c, w)
        n = count[c][u, w]
        return max(n - D[min(n, 3)], 0) / after[c][u] + mass[c][u] / after[c][u] * low(c, w)

    out = []
    for t in texts:
        own = []
        for p in ([math.log(high(0, u, w) / high(1, u, w)) for u, w in pairs(t)], [math.log(low(0, w) / low(1, w)) for _, w in pairs(t)]):
            p = np.array(p)
            own += [p.mean(), math.log(np.exp(p).mean()), math.log(np.exp(2 * p).mean()) / 2] if len(p) else [0.0] * 3
        out.append(own)
    return np.array(out)


def compared(spark, texts, labels, **sizes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if y is not None], "labelled long, toxic int")
    rows = toxicity.compare(docs, known, **sizes).orderBy("doc_id").collect()
    return np.array([[r[c] for c in toxicity.COMPARISONS] for r in rows])


@pytest.mark.parametrize("sizes", [{}, {"batch_words": 50, "bucket_keys": 16}])
def test_models_are_kneser_ney_bigrams(spark, sizes):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghij"))
    texts = [" ".join(letters[np.minimum(rng.geometric(0.3, n), 10) - 1]) for n in rng.integers(0, 30, 60)]
    labels = [None if i % 3 == 2 else int(i % 6 == 0) for i in range(60)]
    assert np.allclose(compared(spark, texts, labels, **sizes), brute(texts, labels), atol=1e-9)


def test_a_phrase_of_ordinary_words_can_be_toxic(spark):
    texts = ["do that now"] * 6 + ["that do now"] * 6 + ["do that", "that do"]
    x = compared(spark, texts, [1] * 6 + [0] * 6 + [None] * 2)
    assert x[12, 0] > 0.5 and x[13, 0] < -0.5


def test_words_of_one_old_bucket_stay_apart(spark):
    """Two words whose hashes agree in their first 21 bits, the one toxic, the other never labelled."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    at = {}
    hashes = words(*buffers(pa.array([name(i) for i in range(20_000)]))).hashes
    for i, h in enumerate(hashes.tolist()):
        if h >> 43 in at:
            break
        at[h >> 43] = i
    bad, rare = name(at[h >> 43]), name(i)
    texts = [f"{x} {bad} {y}" for x in "pqrs" for y in "xyz"] + [f"{x} fine {y}" for x in "pqrs" for y in "xyz"] + [f"p {bad} x", f"p {rare} x"]
    x = compared(spark, texts, [1] * 12 + [0] * 12 + [None] * 2)
    assert x[24, 3] > x[25, 3] + 0.2


def test_dealt_keys_are_gone_when_answers_are_gathered(spark, monkeypatch):
    plans, plain = [], toxicity.cut_bucketed

    def noted(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *more)

    monkeypatch.setattr(toxicity, "cut_bucketed", noted)
    docs = spark.createDataFrame([(i, f"a b c{i % 7}") for i in range(60)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "labelled long, toxic int")
    assert toxicity.compare(docs, known, batch_words=40, bucket_keys=8).count() == 60
    # The shuffle files of an execution stay until its end: what deals keys out and what gathers answers are two.
    assert len(plans) == 4 and not any("FlatMapGroupsInArrow" in p for p in plans)
