import random
import zlib

from pyspark.sql import functions as F

from turnstone.llm import compression as c

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    from turnstone.llm.catalog import op9_compression

    out = op9_compression(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97


def test_cases(spark):
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choices(["alpha", "beta", "gamma"] if k % 2 else ["#$%", "&&&", "***"], k=40)), 0.5) for k in range(80)]
    rows += [(200, None, 1.0), (201, "", 1.0), (None, "alpha beta", 1.0), (5, "alpha", 2.0), (5, "alpha", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (61, None), (62, 7)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in c.score(docs, c.fit(docs, labels, F.lit(True))).collect()}
    assert c.score(docs, c.fit(docs, labels, F.lit(True))).count() == len(rows)
    assert out[71] > 0.5 > out[70] and out[200] == out[201] and 0 <= out[200] <= 1
    none = c.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in c.score(docs, none).collect()} == {0.5}
    assert c.score(docs.limit(0), none).count() == 0


def test_scores_against_the_formula(spark):
    """Every score from the two dictionaries by the zstandard library alone, texts of any length."""
    import math

    import zstandard

    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "über"] if k % 2 else ["#$%", "&&&", "***", "buy now"], k=rnd.randint(1, 60)))) for k in range(120)]
    rows += [(200, "alpha beta " * 100_000), (201, "#$% " * 200_000), (202, None), (203, ""), (204, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = c.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int"), F.lit(True))
    size = lambda raw, d: len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw))
    got = {r.doc_id: r.score for r in c.score(docs, model).collect()}
    for k, text in rows:
        raw = (text or "").encode()
        a, b = (size(raw, model.good), size(raw, model.bad)) if raw else (1, 1)
        assert abs(got[k] - 1 / (1 + math.exp(-(model.slope * (b - a) / max(a, b) + model.offset)))) < 1e-9, k
    assert got[15] > 0.5 > got[14]
