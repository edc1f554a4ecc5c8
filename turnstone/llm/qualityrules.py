"""Quality rules, and an isolation forest over their statistics.

Words are ``[^\\x20\\x09-\\x0D]+``. Two plain rules reject a document: under 20
words, or more than 30 % of them in 8-word windows that the text repeats. What
passes is judged by one isolation forest over all statistics: its trees of random splits are grown on all documents,
and a document that few splits isolate is anomalous. A split's statistic is drawn
with a chance in proportion to how far labelled good and bad rows lie apart in it (the largest difference of their distribution
functions), so that what sets a good document apart for another reason counts little; without labelled rows all have the same chance.
The threshold comes from labelled rows, too: it tells them apart best while it loses at most LOSS of the good ones (label 1), catches at least
LEAST of the bad ones, and LIFT times as large a share of them as of the good ones; a forest that can't rejects nothing. A document is kept if it isn't over the threshold.

All documents that pass the plain rules grow the trees, and none is drawn. Up to TREES * ROWS of them stand in one order, of which each tree takes the next ROWS, round and round.
More are dealt out over the trees, each to one, which grow a level a turn, all at once: the tasks find how many rows each open place has and between which values they lie, the
driver draws the splits. Such a tree has log2(ROWS) levels, and a share of its rows counts as that share of ROWS, so that neither it nor scores grow with the table.
Weights and threshold are found from all labelled rows of the half whose hash of the id is even, counted by value: statistics to 1/256 of their size, scores to three places. The other half is
held out, so that it can measure them.

Defined cases: a null or empty text has no words and is rejected; equal rows
are judged alike and each kept or not; a score equal to the threshold is kept; without good and bad labelled rows the forest
rejects nothing; empty tables give empty tables; `keep` returns every column as
it was, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_and_text, slices, small_batches

MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
TREES, ROWS, LOSS, LIFT, LEAST = 64, 256, 0.005, 10, 0.01
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Counts of a text, and the statistics that the forest splits on.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Symbols a character; words with a symbol, a word; repeated lines a line; A-Z a character; digits a character; ! a word; words equal to the one before, a word; characters a word.
RATIOS = ["symbols", "symbol_words", "dup_lines", "upper", "digits", "shouts", "stutter", "word_length"]
_WEIGHTS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Equal for equal words of one call; differ between processes."""
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (w ^ (w >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def repeated_words(w: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    n = len(w) - WINDOW + 1
    if n < 2:
        return 0
    h = w[:n] * _WEIGHTS[0]
    for j in range(1, WINDOW):
        h += w[j : j + n] * _WEIGHTS[j]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    cover = np.zeros(len(w) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def measure(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of a text."""
    raw = text.encode()
    words = raw.split()  # of bytes: at the six ASCII spaces only
    n, w = len(words), word_hashes(words)
    bare = raw.translate(None, SPACES)
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    digits = len(bare) - len(bare.translate(None, b"0123456789"))
    upper = len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    chars = len(text) - sum(map(text.count, SPACES.decode()))
    with_symbol = sum(len(x.translate(None, SYMBOLS)) < len(x) for x in words) if symbols else 0
    per, size = max(n, 1), max(chars, 1)
    shares = symbols / size, with_symbol / per, dup / max(len(lines), 1), upper / size, digits / size, raw.count(b"!") / per, int(np.count_nonzero(w[1:] == w[:-1])) / per, chars / per
    return [n, chars, symbols, dup, repeated_words(w)], list(shares)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, ratios (array of RATIOS) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [measure(t) for t in b.column(1).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in zip(*(m[0] for m in made))]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["doc_id", *COUNTS, "ratios"])

    return key_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", ratios array<double>")


def base_failed(n_words, n_repeat_words):
    """The plain rules, over columns or numbers."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of a failed search among n rows; of parts of rows by interpolation."""
    n = np.asarray(n, float)
    whole = lambda n: np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))
    low = np.floor(n)
    return whole(low) + (n - low) * (whole(low + 1) - whole(low))


@dataclass(frozen=True)
class Forest:
    """Each tree in arrays: feature (-1: a leaf), split value, left child (right is the next), path length at a leaf."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that fewer splits isolate."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, split, left, length in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = left[at] + (x[inner, f[inner]] >= split[at])
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(float(expected(self.rows)), 1e-9))


def grow(rows: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree; weights: of the statistics, how often a split is on each."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    feature, split, left, length = [-1], [0.0], [0], [0.0]
    todo = [(0, rows, 0)]
    while todo:
        node, own, depth = todo.pop()
        low, high = own.min(0), own.max(0)
        open_ = np.flatnonzero((high > low) & (weights > 0))
        if depth >= limit or len(own) <= 1 or not len(open_):
            length[node] = depth + float(expected(len(own)))
            continue
        f = int(rng.choice(open_, p=weights[open_] / weights[open_].sum()))
        at = rng.uniform(low[f], high[f])
        at = at if at > low[f] else high[f]
        feature[node], split[node], left[node] = f, at, len(feature)
        for part in (own[own[:, f] < at], own[own[:, f] >= at]):
            feature.append(-1), split.append(0.0), left.append(0), length.append(0.0)
            todo.append((len(feature) - 1, part, depth + 1))
    return np.array(feature), np.array(split), np.array(left), np.array(length)


class Growing:
    """Trees of many rows that grow a level a turn, their nodes in arrays of trees x nodes; open: the tree and node of those that aren't split yet."""

    def __init__(self, trees: int, weights: np.ndarray, rng: np.random.Generator, rows: int):
        """rows: as how many the rows of a tree count, if it has more."""
        self.weights, self.rng, self.rows = weights, rng, rows
        self.feature, self.split = np.full((trees, 1), -1), np.zeros((trees, 1))
        self.left, self.length = np.zeros((trees, 1), np.int64), np.zeros((trees, 1))
        self.used, self.depth, self.total, self.open = np.ones(trees, np.int64), 0, np.zeros(trees, np.int64), {(k, 0) for k in range(trees)}

    def places(self, x: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """The node of each row of x in its tree."""
        return _places(self.feature, self.split, self.left, x, tree)

    def turn(self, ranges: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Splits the open nodes. ranges: number, least and greatest values of the rows of each that has some."""
        if not self.depth:
            for (tree, _), (n, _, _) in ranges.items():
                self.total[tree] = n
        most = np.minimum(self.total, self.rows)
        made = set()
        self._widen(2 * len(ranges))
        for tree, node in sorted(self.open & ranges.keys()):
            n, low, high = ranges[tree, node]
            counts = n * most[tree] / self.total[tree]
            free = np.flatnonzero((high > low) & (self.weights > 0))
            if self.depth >= np.ceil(np.log2(max(most[tree], 2))) or counts <= 1 or not len(free):
                self.length[tree, node] = self.depth + float(expected(counts))
                continue
            f = int(self.rng.choice(free, p=self.weights[free] / self.weights[free].sum()))
            at = self.rng.uniform(low[f], high[f])
            k = int(self.used[tree])
            self.feature[tree, node], self.split[tree, node], self.left[tree, node] = f, at if at > low[f] else high[f], k
            self.used[tree] = k + 2
            made |= {(tree, k), (tree, k + 1)}
        self.open, self.depth = made, self.depth + 1

    def _widen(self, most: int) -> None:
        more = max(0, int(self.used.max()) + most - self.feature.shape[1])
        self.feature = np.pad(self.feature, ((0, 0), (0, more)), constant_values=-1)
        self.split, self.left, self.length = (np.pad(x, ((0, 0), (0, more))) for x in (self.split, self.left, self.length))

    def trees(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]:
        return tuple((self.feature[k, :n], self.split[k, :n], self.left[k, :n], self.length[k, :n]) for k, n in enumerate(self.used.tolist()))


def _places(feature: np.ndarray, split: np.ndarray, left: np.ndarray, x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while True:
        f = feature[tree, node]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node
        t, at = tree[inner], node[inner]
        node[inner] = left[t, at] + (x[inner, f[inner]] >= split[t, at])


def spread(x: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys in ascending order, and number, least and greatest values of the rows of each."""
    by = np.argsort(key, kind="stable")
    keys, first, n = np.unique(key[by], return_index=True, return_counts=True)
    return keys, n, np.minimum.reduceat(x[by], first), np.maximum.reduceat(x[by], first)


def _ranges(dealt: DataFrame, growing: Growing) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """Of all rows (ratios, h: the tree): number, least and greatest values in the open nodes."""
    wide, names = len(RATIOS), ["tree", "node", "n", *(f"{end}{k}" for end in ("low", "high") for k in range(len(RATIOS)))]
    feature, split, left = growing.feature, growing.split, growing.left
    open_ = np.zeros(feature.shape, bool)
    open_[tuple(zip(*growing.open))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, low, high = np.zeros(open_.size, np.int64), np.full((open_.size, wide), np.inf), np.full((open_.size, wide), -np.inf)
        for b in batches:
            x, tree = _matrix(b), b.column("h").to_numpy()
            node = _places(feature, split, left, x, tree)
            some = open_[tree, node]
            if some.any():
                keys, n, least, most = spread(x[some], tree[some] * open_.shape[1] + node[some])
                number[keys] += n
                low[keys], high[keys] = np.minimum(low[keys], least), np.maximum(high[keys], most)
        have = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (have // open_.shape[1], have % open_.shape[1], number[have], *low[have].T, *high[have].T)], names)

    kinds = ", ".join(f"{c} {'long' if k < 3 else 'double'}" for k, c in enumerate(names))
    ends = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in names[3:]]
    found = dealt.mapInArrow(run, kinds).groupBy("tree", "node").agg(F.sum("n").alias("n"), *ends).collect()
    return {(r.tree, r.node): (r.n, np.array(r[3 : 3 + wide]), np.array(r[3 + wide :])) for r in found}


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("ratios").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(RATIOS))


@dataclass(frozen=True)
class Judge:
    """The forest, its threshold, and the weights of RATIOS that it was grown with."""

    forest: Forest
    threshold: float
    weights: tuple[float, ...]

    def over(self, x: np.ndarray) -> np.ndarray:
        """By how much each row's score is over the threshold; above 0 it is rejected."""
        return self.forest.scores(x) - self.threshold


def separations(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each column the largest difference between the distribution functions of its good (1) and bad (0) rows; 1 for all where either is missing or nothing tells them apart."""
    return _weights([_apart(*_counted(x[:, k], labels)[1:]) for k in range(x.shape[1])])


def _counted(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values in ascending order, and how many good and bad rows have each."""
    at, which = np.unique(x, return_inverse=True)
    return at, np.bincount(which[labels == 1], minlength=len(at)), np.bincount(which[labels == 0], minlength=len(at))


def _apart(good: np.ndarray, bad: np.ndarray) -> float:
    """The largest difference of the distribution functions; 1 where either is missing."""
    return float(np.abs(np.cumsum(good) / good.sum() - np.cumsum(bad) / bad.sum()).max()) if good.sum() and bad.sum() else 1.0


def _weights(apart: list[float]) -> np.ndarray:
    return np.array(apart) if any(apart) else np.ones(len(apart))


def threshold(scores: np.ndarray, labels: np.ndarray, loss: float = LOSS, lift: float = LIFT, least: float = LEAST) -> float:
    """The cut between scores of labelled rows (1 good, 0 bad) that tells them apart best, of those that lose at most the share loss of the good ones,
    catch at least the share least of the bad ones and lift times as large a share of them as of the good ones; 1, which no score is over, if there is none."""
    return cut(*_counted(scores, labels), loss, lift, least)


def cut(at: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float = LOSS, lift: float = LIFT, least: float = LEAST) -> float:
    """threshold() by the scores in ascending order and how many good and bad rows have each."""
    if not good.sum() or not bad.sum():
        return 1.0
    lost, caught = ((n.sum() - np.cumsum(n)) / n.sum() for n in (good, bad))
    net = np.where((lost <= loss + 1e-12) & (caught >= least) & (caught >= lift * lost), caught - lost, 0.0)[:-1]
    if not len(net) or net.max() <= 0:
        return 1.0
    k = int(net.argmax())
    return float((at[k] + at[k + 1]) / 2)


def _steps(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of x (0 or more), equal where x differs by less than 1/256 of its size."""
    return (x + 0.0).view(np.int64) >> 44


def _tallies(told: DataFrame, of, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of n columns of whole numbers that of() makes of the ratios of a batch: the numbers in ascending order, and how many good and bad rows have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, label = of(_matrix(b)), b.column("label").to_numpy()
            for k in range(n):
                at, good, bad = _counted(made[:, k], label)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(good), pa.array(bad)], ["k", "at", "good", "bad"])

    rows = told.mapInArrow(run, "k long, at long, good long, bad long").groupBy("k", "at").agg(F.sum("good"), F.sum("bad")).collect()
    found = np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, 4)
    return [tuple(found[found[:, 0] == k, 1:].T) for k in range(n)]


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", trees: int = TREES, rows: int = ROWS, loss: float = LOSS, seed: int = 3) -> Judge:
    """stats: what statistics() returns, best stored, as each level of the trees reads it; labels: doc_id and label_col."""
    passed = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    n = passed.count()
    if not n:
        return Judge(Forest((), 0), 1.0, (1.0,) * len(RATIOS))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    told = passed.join(calibrating(known), "doc_id").select("ratios", "label")
    weights = _weights([_apart(*c[1:]) for c in _tallies(told, _steps, len(RATIOS))])
    rng, hashed = np.random.default_rng(seed), F.xxhash64(F.lit(seed), "doc_id", *COUNTS)
    if n <= trees * rows:
        every = rng.permutation(np.array([r.ratios for r in passed.select("ratios", hashed.alias("h")).orderBy("h", "ratios").collect()]))
        size = min(rows, n)
        forest = Forest(tuple(grow(every[(np.arange(size) + k * size) % n], weights, rng) for k in range(trees)), size)
    else:
        dealt, growing = passed.select("ratios", F.pmod(hashed, F.lit(trees)).alias("h")), Growing(trees, weights, rng, rows)
        while growing.open:
            growing.turn(_ranges(dealt, growing))
        forest = Forest(growing.trees(), rows)
    at, good, bad = _tallies(told, lambda x: (forest.scores(x) * 1000).round().astype(np.int64)[:, None], 1)[0]
    return Judge(forest, cut(at / 1000, good, bad, loss), tuple(weights.tolist()))


def calibrating(rows: DataFrame) -> DataFrame:
    """The half of labelled rows (doc_id) that weights and threshold are found from; the other one is held out to measure them."""
    return rows.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(True)))


def scored(stats: DataFrame, judge: Judge, more: list[str] | None = None) -> DataFrame:
    """stats with over (see Judge); more: further columns to carry."""
    names = ["doc_id", *COUNTS, *(more or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(judge.over(_matrix(b)))], [*names, "over"])

    return stats.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "".join(f"{c} int, " for c in more or []) + "over double")


def judge(stats: DataFrame, model: Judge) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, score: by how much it is over the threshold."""
    out = scored(stats, model).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("over") <= 0)).select("doc_id", *COUNTS, "base_failed", "kept", F.col("over").alias("score"))


def measured(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of docs), and doc_id, COUNTS, ratios as statistics() has them: each text is read once. For kept()."""
    small_batches(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [measure(t) for t in b.column(2).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in zip(*(m[0] for m in made))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["row", "doc_id", *COUNTS, "ratios"])

    return packed.mapInArrow(run, T.StructType([*packed.select("row", "doc_id").schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("ratios", T.ArrayType(T.DoubleType()))]))


def kept(rows: DataFrame, model: Judge) -> DataFrame:
    """Of measured() rows those that the rules and the forest keep, with the columns that they came with."""
    open_ = rows.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("row", "ratios")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(model.over(_matrix(b)) <= 0))], ["row"])

    return open_.mapInArrow(run, open_.select("row").schema).select("row.*")


def keep(docs: DataFrame, model: Judge, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules and the forest keep, with all their columns."""
    return kept(measured(docs, None, text_col), model)
