import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from turnstone.llm import repair

JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, end_id=2):
    t = Tokenizer.from_file(JSON)
    docs = [(i, t.encode(x or "", add_special_tokens=False).ids + [end_id]) for i, x in rows]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, np.array(d[1], "<u2").tobytes()))
    out, at = [], 0
    for i, ids in docs:
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_grammar_round_trip_and_random_access():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        docs = [(k, (rnd.integers(0, 6, rnd.integers(1, 40)) if k % 3 else np.zeros(rnd.integers(1, 90))).astype("<u2").tobytes()) for k in range(n)]
        row = dict(zip([f.split()[0] for f in repair.SCHEMA.split(", ")], repair.block(0, 0, docs)))
        assert [(i, x.astype("<u2").tobytes()) for i, _, x in repair.documents_of(row)] == docs
        assert [x.astype("<u2").tobytes() for _, _, x in repair.documents_of(row, [n - 1, 0])] == [docs[n - 1][1], docs[0][1]]
    assert len(row["symbols"]) // 3 < sum(len(x) // 2 for _, x in docs) / 3 and len(row["rules"])


def test_files(spark):
    rnd = random.Random(2)
    words = ["the", " cat", " sät", "\n", " 12", "!", "<|endoftext|>", "  "]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, "", "".join(rnd.choices(words, k=rnd.randint(1, 300)))])) for _ in range(200)]
    rows += [(7, "same"), (7, "same"), (99, "long " * 20000)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, start int")
    got = [tuple(r) for r in repair.round_trip(df, JSON).orderBy("start").collect()]
    assert got == brute(rows)
    ids = repair.round_trip(df, JSON, digest=False).orderBy("start").collect()
    assert [zlib.crc32(r.ids) for r in ids] == [x[3] for x in got]


def test_segments_against_the_library():
    rnd, t, enc = random.Random(5), Tokenizer.from_file(JSON), repair.Encoder(JSON)
    alphabet = ["a", "the", "'s", "'", "1", "\u00e9", "\u4f60", "!", ".", " ", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\u3000", "<|endoftext|>", "<|endof", "\U0001f600"]
    texts = ["".join(rnd.choices(alphabet[: rnd.choice([10, 20, 23])], k=rnd.randint(0, 40))) for _ in range(4000)] + ["a <|endoftext|> b", "", " ", "\n", " a", "a "]
    want = [np.array(x.ids, "<u2").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert enc.ids(texts) == want and enc.ids(texts) == want  # the second time from what is remembered
    assert np.frombuffer(enc.ids(["a <|endoftext|> b"])[0], "<u2").tolist() == [64, 220, 50256, 275]


def test_hot_ids_and_shards(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, 5, 5, k]), "".join(rnd.choices("abcd ", k=rnd.randint(0, 30)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    repair.write(df, JSON, 2, path := repair.shared_dir(spark), shards=8)
    got = [tuple(r) for r in repair.read(spark, path, True).orderBy("start").collect()]
    assert got == brute(rows)
    assert spark.read.parquet(path).select("shard").distinct().count() > 8  # rows of one id and rows without are in several shards


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repair.round_trip(df, JSON).count() == 0


def test_grammar_goes_on_until_no_pair_is_frequent():
    one = np.random.default_rng(1).integers(0, 60000, 300)
    ids, ends = np.tile(one, 1000), np.arange(1, 1001) * 300
    seq, own_ends, rules = repair.grammar(ids, ends)
    assert len(seq) == 1000 and own_ends.tolist() == list(range(1, 1001))
    assert (repair.expand(seq, *repair.expansions(rules)) == ids).all()
