"""Word shingles as 64-bit hashes, and connected components of links."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Words of a shingle.
WIDTH = 5
_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Of the words [^\\x20\\x09-\\x0D]+, the same in every process."""
    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _read(aligned: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first lowest. aligned: all bytes, eight a number."""
    k, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
    return (aligned[k] >> shift) | ((aligned[k + 1] << np.uint64(1)) << (np.uint64(63) - shift))


def hashes_at(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """As word_hashes, of the words of size (1 or more) bytes at these places of raw: XXH3's short forms on whole arrays, the library for words of over 16 bytes."""
    u = np.uint64
    padded = np.zeros((len(raw) + 31) // 8 * 8, np.uint8)
    padded[: len(raw)] = raw
    aligned, out = padded.view("<u8"), np.empty(len(at), u)

    def of(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.flatnonzero(chosen)
        return k, at[k], size[k]

    with np.errstate(over="ignore"):
        k, i, n = of(size <= 3)
        byte = lambda j: raw[j].astype(u)
        h = ((byte(i) << u(16)) | (byte(i + (n >> 1)) << u(24)) | byte(i + n - 1) | (n.astype(u) << u(8))) ^ u(0x87275A9B)
        h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
        out[k] = h ^ (h >> u(32))

        k, i, n = of((size > 3) & (size <= 8))
        h = (((_read(aligned, i) << u(32)) + (_read(aligned, i + n - 4) & u(0xFFFFFFFF)))) ^ u(0xC73AB174C5ECD5A2)
        h ^= ((h << u(49)) | (h >> u(15))) ^ ((h << u(24)) | (h >> u(40)))
        h *= u(0x9FB21C651E98DF25)
        h = (h ^ ((h >> u(35)) + n.astype(u))) * u(0x9FB21C651E98DF25)
        out[k] = h ^ (h >> u(28))

        k, i, n = of((size > 8) & (size <= 16))
        a, b = _read(aligned, i) ^ u(0x6782737BEA4239B9), _read(aligned, i + n - 8) ^ u(0xAF56BC3B0996523A)
        a0, a1, b0, b1 = a & u(0xFFFFFFFF), a >> u(32), b & u(0xFFFFFFFF), b >> u(32)
        cross = ((a0 * b0) >> u(32)) + ((a1 * b0) & u(0xFFFFFFFF)) + a0 * b1
        high = ((a1 * b0) >> u(32)) + (cross >> u(32)) + a1 * b1
        h = n.astype(u) + a.byteswap() + b + ((a * b) ^ high)
        h = (h ^ (h >> u(37))) * u(0x165667919E3779F9)
        out[k] = h ^ (h >> u(32))

    k, i, n = of(size > 16)
    out[k] = np.fromiter((xxhash.xxh3_64_intdigest(raw[x : x + y].tobytes()) for x, y in zip(i.tolist(), n.tolist())), u, len(k))
    return out


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One for each place where a shingle starts; a shorter text is one shingle; none without words."""
    n = len(words) - WIDTH + 1
    if not len(words):
        return words
    if n < 1:
        return mix64(np.array([(words * _WEIGHTS[: len(words)]).sum()], np.uint64), len(words))
    out = words[:n] * _WEIGHTS[0]
    for j in range(1, WIDTH):
        out += words[j : j + n] * _WEIGHTS[j]
    return mix64(out)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns key, label: the least key that each linked key is connected with.

    Each turn points every key to its least neighbour's least neighbour and
    contracts the links to what they point to; so links vanish in a few turns,
    each of which is written to the shared folder.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    labels = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("key"), F.least("u", "low").alias("label"))
        roots = near.select(F.col("key").alias("label"), F.col("label").alias("root"))
        turn = stored(near.join(roots, "label").select("key", F.col("root").alias("label")))
        end = lambda c: turn.select(F.col("key").alias(c), F.col("label").alias(f"{c}_to"))  # noqa: B023, E731
        left = stored(edges.join(end("u"), "u").join(end("v"), "v").filter("u_to <> v_to").select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct())
        labels = turn if labels is None else stored(_through(labels, turn))
        discard(edges, sweep=False)
        if left.isEmpty():
            discard(left, sweep=False)
            return labels
        edges = left


def _through(labels: DataFrame, turn: DataFrame) -> DataFrame:
    """key, label with each label replaced by what turn (key, label) points it to."""
    to = turn.select(F.col("key").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("key", F.coalesce("to", "label").alias("label"))


def more_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of labels with further links: only these are followed."""
    end = lambda c: labels.select(F.col("key").alias(c), F.col("label").alias(f"{c}_to"))
    ends = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    turn = components(ends.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")))
    new = links.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(labels, "key", "left_anti").select("key", F.col("key").alias("label"))
    return stored(_through(labels.unionByName(new), turn))
