import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken

from turnstone.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PAT = regex.compile(public_tokenizers.PATTERN)


def test_stitched_pieces_are_those_of_the_whole_text():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "b", " ", " ", "\n", "'", "'re", "'s", "1", "!", "é", "  ", "ll"]) for _ in range(rnd.randint(0, 60)))
        size, overlap = rnd.randint(1, 12), rnd.randint(1, 9)
        cs = bpe.chunks(text, size, overlap)
        parts = [(c, bpe.boundaries(PAT, c, i + 1 == len(cs))) for i, c in enumerate(cs)]
        assert [p for x in bpe.stitch(PAT, parts, size) for p in x] == PAT.findall(text)


def test_fast_form_of_the_pattern():
    rnd, find = random.Random(2), bpe.pretokens(public_tokenizers.PATTERN)
    assert public_tokenizers.PATTERN == bpe.KNOWN
    for _ in range(3000):
        text = "".join(chr(rnd.choice([rnd.randrange(256), rnd.randrange(32, 127), 32, 39, rnd.randrange(0x3000)])) for _ in range(30))
        assert find(text) == PAT.findall(text)


def test_round_trip_and_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "Grüße, it's 12  apples\n\n <|endoftext|>", "x"), (None, "no id", None),
        (4, "word " * 3000, "x"), (4, "word " * 3000, "x"), (5, "a" * 5000, "x"), (6, " " * 700 + "é'll" * 400, "x"), (1, "again", "y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = bpe.encode(df, RANKS, public_tokenizers.PATTERN, size=256, overlap=32)
    made = bpe.decode(ids, RANKS)
    got = sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in made.collect())
    assert got == sorted((str(i), tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    out = {r.doc_id: r for r in bpe.digests(ids, RANKS).collect()}
    assert out[2].n_tokens == 0 and out[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[3].decoded_sha256 == hashlib.sha256(rows[2][1].encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
