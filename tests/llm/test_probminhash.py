import random

import numpy as np

from turnstone.llm import probminhash as p
from turnstone.llm.shingles import components, more_links


def exact(s, v, t, w):
    a, b = dict(zip(s.tolist(), v.tolist())), dict(zip(t.tolist(), w.tolist()))
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def corpus(seed, n_base=30):
    rnd = random.Random(seed)
    out = []
    for _ in range(n_base):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(6, 150))] * rnd.choice([1, 1, 2])
        out.append(" ".join(words))
        for _ in range(rnd.randint(0, 6)):
            copy = words[:]
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 99)}"
            out.append(" ".join(copy))
    rnd.shuffle(out)
    return out


def test_estimate_and_exact_similarity():
    texts = corpus(1)
    docs = [p.weighted(t) for t in texts]
    sig = p.signatures(docs, 2000)
    for i in range(0, len(texts), 3):
        for j in range(i):
            x = p.probability_jaccard(*docs[i], *docs[j])
            assert abs(x - exact(*docs[i], *docs[j])) < 1e-9
            assert abs((sig[i] == sig[j]).mean() - x) < 0.06


def test_similarities_of_a_block():
    docs = [p.weighted(t) for t in corpus(4, 12)]
    got = p.similarities(*zip(*docs))
    for i in range(len(docs)):
        for j in range(i):
            assert abs(got[i, j] - p.probability_jaccard(*docs[i], *docs[j])) < 1e-4
    none = p.similarities([d[0][:0] for d in docs], [d[1][:0] for d in docs])
    assert none.shape == (len(docs), len(docs)) and not none.any()


def test_open_buckets_are_compared_in_full(spark):
    """A star whose hub no bucket shows: every pair in one bucket across components is found."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(40):
        copy = base[:]
        for _ in range(k // 4):
            copy[rnd.randrange(120)] = f"x{rnd.randint(0, 9999)}"
        texts.append(" ".join(copy * (1 + 7 * (k % 5 == 0))))
    texts = list(dict.fromkeys(texts))
    docs = [p.weighted(t) for t in texts]
    keys = [bytes([k]) for k in range(len(texts))]
    sets = p._sets(spark.createDataFrame(list(zip(keys, texts)), "key binary, text string"), 125)
    open_ = spark.createDataFrame([(b, k, k) for b in (1, 2) for k in keys], "band long, key binary, label binary")
    p.BLOCK, old = 7, p.BLOCK
    try:
        got = {(r.a[0], r.b[0]) for r in p._across(open_, sets, 0.8, 125).collect()}
    finally:
        p.BLOCK = old
    assert got == {(i, j) for j in range(len(texts)) for i in range(j) if p.probability_jaccard(*docs[i], *docs[j]) >= 0.8}


def brute(texts, threshold=0.8):
    docs = [p.weighted(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or p.probability_jaccard(*docs[i], *docs[j]) >= threshold:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_against_brute_force(spark):
    texts = corpus(2) + ["", None, "a b", "a b", "a b c", "lone " * 30000, "lone " * 30001]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, label int")
    want = brute(texts)
    rows = p.classes(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))
    assert all(r.class_size == want.count(r.class_id) for r in rows)
    kept = p.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "same text here again now then"), (None, "same text here again now then"), (4, "other words stand in this text"), (4, "other words stand in this text"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, p.keep_one(df).collect())) == sorted(map(str, df.distinct().collect()))
    assert p.keep_one(df.limit(0)).count() == 0 and p.classes(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in edges], "a binary, b binary")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {int.from_bytes(r.key): int.from_bytes(r.label) for r in components(df).collect()}
    assert got == {x: find(x) for x in list(parent)}
    two = more_links(components(df.limit(90)), df.subtract(df.limit(90)))
    assert {int.from_bytes(r.key): int.from_bytes(r.label) for r in two.collect()} == {x: find(x) for x in list(parent) if parent[x] != x or x in got}


def test_recall_of_planted_near_copies(spark):
    """Pairs of a text and one edited copy, of all similarities from the threshold on: at least 0.9 are found (0.99995 by the formula)."""
    rnd = random.Random(21)
    texts, pairs = [], []
    while len(pairs) < 300:
        words = [f"w{rnd.randint(0, 30000)}" for _ in range(rnd.randint(30, 200))] + ["again and again"] * rnd.choice([0, 0, 3])
        copy = words[:]
        for _ in range(rnd.randint(1, max(1, len(words) // 40))):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.choice([0, 1, 1])] = rnd.choice([[], [f"x{rnd.randint(0, 9999)}"]])
        a, b = " ".join(words), " ".join(copy)
        x = p.probability_jaccard(*p.weighted(a), *p.weighted(b))
        if a != b and 0.8 <= x <= 0.95:
            pairs.append((len(texts), len(texts) + 1))
            texts += [a, b]
    got = {r.doc_id: r.class_id for r in p.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert len(set(got.values())) >= len(pairs)


def test_members_that_cannot_be_near_go(spark):
    """A near family in one component, outliers of it and unrelated texts in the same buckets: only what can have a near text of another label stays, and no near pair is lost."""
    rnd = random.Random(22)
    base = [f"w{k}" for k in range(200)]

    def edited(n):
        out = base[:]
        for _ in range(n):
            out[rnd.randrange(200)] = f"x{rnd.randint(0, 99999)}"
        return out

    words = [edited(rnd.choice([1, 2])) for _ in range(30)] + [edited(9) for _ in range(30)] + [[f"y{rnd.randint(0, 99999)}" for _ in range(100)] for _ in range(20)] + [edited(1) * 2 for _ in range(10)] + [base[:170] for _ in range(1)]
    texts = [" ".join(w) for w in words]
    docs = [p.weighted(t) for t in texts]
    keys = [bytes([k]) for k in range(len(texts))]
    label = lambda k: 0 if k < 30 else k
    sets = p._sets(spark.createDataFrame(list(zip(keys, texts)), "key binary, text string"), 125)
    open_ = p.stored(spark.createDataFrame([(b, k, bytes([label(k[0])])) for b in (1, 2) for k in keys], "band long, key binary, label binary"))
    left = p._reachable(open_, p.stored(sets), 0.8).collect()
    stay = {r.key[0] for r in left}
    near = {x for i in range(len(texts)) for j in range(i) if label(i) != label(j) and p.probability_jaccard(*docs[i], *docs[j]) >= 0.8 for x in (i, j)}
    assert near <= stay and not stay & set(range(60, 80)) and len(stay) < 50
