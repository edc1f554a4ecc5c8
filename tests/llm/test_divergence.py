"""The audit against a plain count in Python, and its query against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from turnstone.llm import catalog, divergence

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value string, rank string"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    for lang in docs.keys() | {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        total = sum(own.values(), Counter())
        p = {s: {t: share(c[t], sum(c[x] for x in kept), len(kept)) for t in kept} for s, c in own.items()}
        q = {t: share(total[t], sum(total[x] for x in kept), len(kept)) for t in kept}
        for s in own:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit(spark, rows):
    df = spark.createDataFrame([(k, *r, 1, "t", "v", "r") for k, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df).collect())


@pytest.fixture
def small(monkeypatch):
    """Small blocks, chunks and slabs, so that few rows make many tiles."""
    for name, value in {"LEAST_DOCS": 2, "TOP": 5, "GROUPS": 3, "CHUNK": 4, "SLAB": 2, "HELD": 20, "PIECE": 8}.items():
        monkeypatch.setattr(divergence, name, value)


def test_many_tiles(spark, small):
    rng = random.Random(3)
    words = ["a", "B", "Über", "éa", "zz", "Zz", "x1y", "人", "😀b", "q", "w", "e", "r", "t", "y"]
    rows = [(" ".join(rng.choices(words, [2.0**-k for k in range(len(words))], k=rng.randint(0, 12))), rng.choice(["en", "de"]), f"s{rng.randint(0, 11)}") for _ in range(150)]
    assert audit(spark, rows) == brute(rows, 2, 5)


def test_cases(spark, small):
    rows = [(None, None, None), ("a b", "en", None), ("a b", "en", None), ("", "en", "x"), ("a " * 5000 + "b", "en", "y"), ("only once", "fr", "u"), ("other", "fr", "v"), ("A\x00b c", "en", "z"), ("...", "es", "k")]
    assert audit(spark, rows) == brute(rows, 2, 5)
    assert audit(spark, []) == []


def test_shares_are_exact_beyond_64_bits_of_the_product():
    n, d = np.array([[0, 7, 10**13]]), np.array([9 * 10**15])
    assert divergence._shares(n, d).tolist() == [[1 + 10**9 * (int(x) + 5) // int(d[0]) for x in n[0]]]


def test_pieces_of_a_long_text_split_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    text = "Abc dé f " * 50 + "x" * 40
    assert [w for part in divergence.terms(text) for w in part] == text.lower().encode().split()


def test_query_against_sql(spark):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = duckdb.execute(catalog.oracle_sql()["op13_divergence"])
    names = [c[0] for c in want.description]
    rows = sorted(tuple(r[c] for c in names) for r in catalog.op13_divergence(spark, SF).collect())
    assert rows == sorted(want.fetchall()) and {r[2] for r in rows} == {"pair", "term"}
