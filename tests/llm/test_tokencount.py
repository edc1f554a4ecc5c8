import random

import public_tokenizers

from turnstone.llm import tokencount as tc


def greedy(word, first, inner):
    """Longest match first, by trying every length."""
    n, at, own = 0, 0, set(first)
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return -1
        n, at, own = n + 1, end, set(inner)
    return n


def test_automaton_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        some = lambda k: {"".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(k)}
        first, inner = some(rnd.randint(1, 12)), some(rnd.randint(1, 12))
        a = tc.Automaton(first, inner)
        for _ in range(60):
            w = "".join(rnd.choices("abcd" if rnd.random() < 0.1 else "abc", k=rnd.randint(1, 12)))
            assert a.count(w) == greedy(w, first, inner), (w, first, inner)


def test_table(spark):
    first, inner = tc.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(1, None), (2, ""), (3, "The cat  sat\non the\x0bmat"), (3, "The cat  sat\non the\x0bmat"), (None, "日本語 ☃ x"), (5, "z" * 20000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_words int")
    got = sorted(map(str, tc.token_counts(df, first, inner).collect()))
    want, own = [], (set(first), set(inner))
    for i, t in rows:
        ns = [greedy(tc.MARK + w.decode(), *own) if len(w) < 1000 else None for w in (t or "").encode().split()]
        if None in ns:
            ns = [tc.Automaton(first, inner).count(tc.MARK + t)]
        want.append(f"Row(doc_id={i}, n_words={len(ns)}, n_tokens={sum(max(n, 1) for n in ns)}, n_unknown={sum(n < 0 for n in ns)})")
    assert got == sorted(want)
    assert tc.token_counts(df.limit(0), first, inner).count() == 0
