import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from turnstone.llm import mixing as m

WEIGHTS = {"a": {"x": 3, "y": 1}, "b": {"p": 2.5, "q": 0}}
LEVELS = lambda: {k: F.col(k) for k in "abc"}


def fill(children, budget):
    """children: name -> (weight, supply). Shares what is left over again and again."""
    got, open_ = dict.fromkeys(children, 0.0), {k for k, (w, s) in children.items() if w > 0 and s > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if got[k] + budget * children[k][0] / total >= children[k][1] - 1e-12}
        if not full:
            for k in open_:
                got[k] += budget * children[k][0] / total
            return got
        spent = 0.0
        for k in full:
            spent += children[k][1] - got[k]
            got[k] = children[k][1]
        budget, open_ = budget - spent, open_ - full
        base = {k: got[k] for k in open_}
        assert all(v == 0 for v in base.values())
    return got


def brute(rows, share, seed, epochs):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = defaultdict(int)
    for r in rows:
        leaves[r[2:5]] += n(r[1])
    budget = {(): sum(leaves.values()) * share}
    for k, level in enumerate("abc"):
        below = {}
        for parent, b in budget.items():
            kids = {x[: k + 1] for x in leaves if x[:k] == parent}
            w = lambda x: WEIGHTS.get(level, {}).get(x[-1], 1.0)
            below |= fill({x: (w(x), epochs * sum(t for y, t in leaves.items() if y[: k + 1] == x)) for x in kids}, b)
        budget = below
    out = []
    for leaf, t in leaves.items():
        q = int(budget[leaf] + 1e-6)
        whole, left = divmod(q, t) if t else (0, 0)
        own = [r for r in rows if r[2:5] == leaf]
        out += [(r[0], e) for r in own for e in range(whole)]
        before = 0
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{seed}:{whole}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0)):
            if before < left:
                out.append((r[0], whole))
            before += n(r[1])
    return sorted(map(str, out))


def test_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(k, "w " * rnd.randint(1, 30), rnd.choice("xyz"), rnd.choices(["p", "q", "r", None], [6, 2, 1, 1])[0], rnd.choice("stu")) for k in range(300)]
    rows += [(1000, None, "x", "p", "s"), (1001, "", "x", "p", "s"), (None, "lone words", None, None, None), (1002, "long " * 3000, "y", "p", "t")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, a string, b string, c string, epoch int, budget string")
    for share, epochs in ((0.3, 1), (1.0, 2), (5.0, 2)):
        out = m.mix(df, LEVELS(), WEIGHTS, share, seed=9, max_epochs=epochs).select("row.doc_id", F.col("epoch")).collect()
        assert sorted(str((r.doc_id, r.epoch)) for r in out) == brute(rows, share, 9, epochs)


def test_rows_whole_and_empty(spark):
    rows = [(1, "a b", "x", "p", "s"), (1, "a b", "x", "p", "s"), (2, None, "x", "p", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c string")
    out = m.mix(df, LEVELS(), {}, 1.0, max_epochs=1)
    assert out.select("row.*").columns == df.columns and sorted(r.doc_id for r in out.select("row.*").collect())[:2] == [1, 1]
    assert m.mix(df.limit(0), LEVELS(), {}, 1.0).count() == 0
    assert m.mix(df.filter("text is null"), LEVELS(), {}, 1.0).count() == 0


def test_the_sql_has_the_same_words(spark):
    import duckdb
    import pyarrow as pa

    from turnstone.llm import catalog

    texts = ["a b", "a\x0bb", "a\x0cb", "a\rb", "a\x1cb", "a\x85b", "a\u00a0b", "a-b c", None, "", "\t\n a  b\r\n"]
    rows = [{"doc_id": k, "text": t, "lang": "en", "source": f"s{k % 3}", "n_chars": 1} for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rows))
    cur = con.execute(catalog.oracle_sql()["op4_mixing"])
    names = [c[0] for c in cur.description]
    want = sorted(str(tuple(r[names.index(c)] for c in ("doc_id", "epoch", "n_tokens"))) for r in cur.fetchall())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = m.mix(df, catalog.mix_levels(), catalog.MIX_WEIGHTS, catalog.MIX_SHARE, catalog.MIX_SEED, catalog.MIX_EPOCHS).select(F.col("row.doc_id").alias("doc_id"), "epoch", "n_tokens")
    assert sorted(str(tuple(r)) for r in out.collect()) == want
