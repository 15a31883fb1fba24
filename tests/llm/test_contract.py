"""The registered queries with their own parameters over whole tables, against SQL or brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import fingerprints
from loomgraph.llm.queries import ORACLE_SQL, QUERIES

from test_operators import base_spans

SF = "/root/testdata/sf0.001"


def value(v):
    return str(round(float(v), 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def table():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def texts(table):
    return dict(table.sql("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, table, name):
    expected = table.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(map(value, r)) for r in df.select(*columns).collect()) == sorted(tuple(value(r[i]) for i in at) for r in expected.fetchall())


def test_packing(spark, table):
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for i, t in texts(table).items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        expected |= {(i, p, at, len(ids[at : at + 4096]), zlib.crc32(np.asarray(ids[at : at + 4096], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 4096
    assert len(held) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_fingerprints(spark, table):
    rows = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, SF).collect()}
    t = texts(table)
    order = sorted(t, reverse=True)
    assert set(rows) == set(t)
    share = lambda a, b: max(0.0, (np.mean(np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8)) - 2**-8) / (1 - 2**-8))
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(t[i]) // 2
        edited = t[i][: len(t[i]) - half] + t[after][:half]
        r = rows[i]
        assert r.n_chars == len(t[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(share(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(share(r.fingerprint, rows[after].fingerprint))
        assert rows[i].fingerprint == rows[i].fingerprint and len(r.fingerprint) == 2 * fingerprints.BINS
    by = defaultdict(set)
    for i, r in rows.items():
        by[t[i]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_personal_data(spark, table):
    t = texts(table)
    kinds = ("email", "ip", "card", "phone")
    for r in QUERIES["op7_pii"](spark, SF).collect():
        spans = list(base_spans(t[r.doc_id]))
        by = {k: [s for s in spans if s.startswith(k)] for k in kinds}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(by[k]) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(s for k in kinds for s in by[k]).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_url_rules(spark, table):
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    rows = {r.page_id: r for r in QUERIES["op3_url_template_filter"](spark, SF).collect()}
    for i, url in table.sql("select page_id, url from pages").fetchall():
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = rows.pop(i)
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None) and r.verdict in ("allow", "block")
        assert not fits or r.verdict == max(fits)[2]
    assert not rows


def test_toxicity_columns(spark, table):
    rows = QUERIES["op6_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts(table))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
