import random
import re

import numpy as np

from turnstone.llm import qualityrules as q

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in again for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_counts_against_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        line = lambda: " ".join(rnd.choices(["a", "b", "é#", "ünd", " x", "|", "c d"], k=rnd.randint(0, 12)))
        lines = [line() for _ in range(3)]
        text = rnd.choice(["\n", "\n\n", "\r\n", "\x0b\n "]).join(rnd.choices(lines, k=rnd.randint(0, 7)))
        assert q.measure(text)[0] == brute(text), repr(text)


def path(tree, x, node=0, depth=0):
    feature, split, left, length = tree
    return length[node] if feature[node] < 0 else path(tree, x, left[node] + (x[feature[node]] >= split[node]), depth + 1)


def test_forest_scores():
    rng = np.random.default_rng(1)
    rows = np.r_[np.zeros((500, 3)), rng.uniform(0.5, 1, (20, 3))]
    f = q.Forest(tuple(q.grow(rng.permutation(rows)[:256], np.ones(3), rng) for _ in range(30)), 256)
    s = f.scores(rows)
    want = [2 ** (-np.mean([path(t, x) for t in f.trees]) / float(q.expected(256))) for x in rows]
    assert np.allclose(s, want) and s[500:].min() > s[:500].max()


def test_query_keeps_good_rows_and_drops_bad(spark):
    from turnstone.llm.catalog import op3_qualityrules

    out = op3_qualityrules(spark, SF)
    assert out.columns[:8] == ["doc_id", *q.COUNTS, "base_failed", "kept"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows[:150]:
        assert [r[c] for c in q.COUNTS] == brute(texts[r.doc_id][:]) and r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    open_ = [r for r in rows if not r.base_failed and r.doc_id in labels]
    good, bad = ([r for r in open_ if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(r.kept for r in good) / len(good) > 0.99 and sum(r.kept for r in bad) / len(bad) < 0.1
    assert not any(r.kept for r in rows if r.base_failed)


def test_threshold():
    def of(rows):
        return q.threshold(*(np.array([r[k] for r in rows for _ in range(r[2])]) for k in (0, 1)))

    assert 0.6 <= of([(0.4, 1, 900), (0.5, 1, 96), (0.6, 1, 4), (0.5, 0, 10), (0.7, 0, 90)]) < 0.7
    assert of([(0.4, 1, 1000), (0.8, 1, 5), (0.4, 0, 99), (0.8, 0, 1)]) == 1.0  # as often good as bad
    assert of([(0.4, 1, 10)]) == 1.0 and of([(0.4, 0, 10), (0.5, 0, 1)]) == 1.0 and q.threshold(np.zeros(0), np.zeros(0)) == 1.0
    assert 0.5 < of([(0.5, 1, 1000), (0.5, 0, 5), (0.8, 0, 5)]) < 0.8  # rows at the threshold stay
    assert of([(0.5, 1, 10), (0.5, 0, 10)]) == 1.0


def test_a_score_at_the_threshold_is_kept():
    rng = np.random.default_rng(2)
    rows = rng.uniform(size=(300, len(q.RATIOS)))
    forest = q.Forest(tuple(q.grow(rows[:128], np.ones(len(q.RATIOS)), rng) for _ in range(20)), 128)
    scores = forest.scores(rows)
    judge = q.Judge(forest, float(np.sort(scores)[-10]), (1.0,) * len(q.RATIOS))
    assert (judge.over(rows) > 0).sum() == (scores > np.sort(scores)[-10]).sum() < 10 and (judge.over(rows) == 0).any()


def test_separations():
    x = np.array([[0, 1, 5], [0, 2, 5], [1, 1, 5], [1, 2, 5]], float)
    assert q.separations(x, np.array([1, 1, 0, 0])).tolist() == [1.0, 0.0, 0.0]
    assert q.separations(x[:, 1:], np.array([1, 1, 0, 0])).tolist() == q.separations(x[:2, 1:], np.array([1, 1])).tolist() == [1.0, 1.0]


def test_verdicts_come_from_the_forest_and_hold_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    stats = q.statistics(docs).cache()
    model = q.fit(stats, labels)
    every = q.judge(stats, model).join(stats.select("doc_id", "ratios"), "doc_id").filter("not base_failed").collect()
    quality, seen = {r.doc_id: r.quality for r in labels.collect()}, {r.doc_id for r in q.calibrating(labels).collect()}
    unseen = [r for r in every if r.doc_id in quality and r.doc_id not in seen]
    good, bad = ([r for r in unseen if quality[r.doc_id] == y] for y in (1, 0))
    assert len(good) > 1000 and len(bad) > 100
    assert sum(not r.kept for r in good) <= 0.01 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    x, kept = np.array([r.ratios for r in every]), np.array([r.kept for r in every])
    assert np.array_equal(model.over(x) <= 0, kept) and all(r.kept == (r.score <= 0) for r in every) and 0.03 < (~kept).mean() < 0.2
    # all rejections are the one forest's, and no cut through a single statistic gives its verdicts: it splits on several
    splits = np.bincount(np.concatenate([f[f >= 0] for f, *_ in model.forest.trees]), minlength=len(q.RATIOS))
    assert (splits > 0.05 * splits.sum()).sum() >= 4
    for k in range(len(q.RATIOS)):
        cuts = [x[:, k] > t for t in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 201)))]
        assert max(max((c == ~kept).mean(), (c == kept).mean()) for c in cuts) < 0.998
    # what other statistics say changes verdicts of rows that are alike in the most telling one
    plain = x[:, 0] == 0
    assert (~kept & plain).sum() >= 10
    stats.unpersist()


def test_cases(spark):
    good = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one"
    rows = [(1, None, 1), (2, "", 1), (3, good, None), (3, good, None), (None, good, 4), (5, "x " * 200_000, 1), (6, "few words", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    stats = q.statistics(docs)
    forest = q.fit(stats, labels)
    assert sorted(str(r.doc_id) for r in q.judge(stats, forest).filter("kept").collect()) == ["3", "3", "None"]
    kept = q.keep(docs, forest)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("text like 'one two%'").collect()))
    empty = q.fit(stats.limit(0), labels.limit(0))
    assert q.keep(docs.limit(0), empty).count() == 0 and q.judge(stats, empty).filter("kept").count() == 3


def test_every_document_and_label_counts(spark):
    """The extremes that trees are drawn from are those of all rows, each row is in one tree at least, and the last label changes the threshold's counts."""
    rng = np.random.default_rng(7)
    n = 40_000  # more than TREES * ROWS
    x = rng.uniform(0, 1, (n, len(q.RATIOS)))
    rows = spark.createDataFrame([(k, *[100, 1, 1, 0, 0], r) for k, r in enumerate(x.tolist())], "doc_id long, " + ", ".join(f"{c} long" for c in q.COUNTS) + ", ratios array<double>").cache()
    dealt = rows.select("ratios", (rows.doc_id % q.TREES).alias("h"))
    growing = q.Growing(q.TREES, np.ones(len(q.RATIOS)), rng, q.ROWS)
    for turn in range(2):
        found = q._ranges(dealt, growing)
        assert sum(c for c, _, _ in found.values()) == n
        tree = np.arange(n) % q.TREES
        node = growing.places(x, tree)
        for (t, at), (c, low, high) in found.items():
            own = x[(tree == t) & (node == at)]
            assert c == len(own) and np.array_equal(low, own.min(0)) and np.array_equal(high, own.max(0))
        growing.turn(found)
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(n)], "doc_id long, label int")
    told = rows.join(labels, "doc_id").select("ratios", "label")
    tallies = q._tallies(told, q._steps, len(q.RATIOS))
    assert all(good.sum() == n - n // 10 and bad.sum() == n // 10 and (np.diff(at) > 0).all() for at, good, bad in tallies)
    exact = q.separations(x, (np.arange(n) % 10 > 0).astype(int))
    assert np.allclose([q._apart(*c[1:]) for c in tallies], exact, atol=0.01)
    model = q.fit(rows, labels, "label")
    assert all(len(f) <= 2 * q.ROWS for f, *_ in model.forest.trees)
    # one more document, far off in one statistic, is a row of one tree and widens its splits
    odd = rows.limit(1).selectExpr("-1L AS doc_id", *q.COUNTS, "transform(ratios, x -> 1000D) AS ratios")
    splits = np.array([s.max() for _, s, *_ in q.fit(rows.union(odd), labels, "label").forest.trees])
    assert (splits > 1).sum() == 1 and max(s.max() for _, s, *_ in model.forest.trees) <= 1
    rows.unpersist()
