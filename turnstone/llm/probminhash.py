"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is its shingles of five words, weighted by how often they occur.
Each shingle is a Poisson process of that rate whose arrivals fall on random
registers of a signature; a register keeps the shingle that arrives first.
Once every register is taken, arrivals later than the latest kept one
can't matter and the process ends. Two signatures agree in a register with
the probability Jaccard of the documents, sum over common shingles d of
1 / sum over all e of max(v_e / v_d, w_e / w_d), which for sets is the usual one.
Documents that agree in a whole band are candidates; a link is a pair whose
exact probability Jaccard is at least the threshold; classes are the connected
components of links.

Equal texts are one node, so copies are never compared. No bucket is expanded into
pairs: its members are compared with one hub, that whose buckets are largest in sum, each
member with the TOP hubs it meets most; then with the member of most links.
Of buckets that still hold members of several components, those members go that no
member of another component can be near to: too few of their shingles recur in texts of other
components of open buckets, or none of the sizes in their bucket fits. That is done until hardly any goes. What is left
is compared in full, in blocks of BLOCK members, two blocks a task, of which only near pairs leave. So
every pair that shares a bucket is connected, can't be near or was compared.

Size: 25 band rows a document, grouped with partial sums; buckets are joined by
key, so Spark splits hot ones; shingle sets are kept for documents that share a
bucket only.

Defined cases: a null text equals an empty one; texts without words are near
no other text; texts under five words are one shingle; null ids come after all others when a
class is named by its least id; equal rows share a class; empty tables give empty tables;
columns other than id and text are not read, and `keep_one` returns all columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few, key_and_text, slices, stored
from .shingles import components, mix64, more_links, shingle_hashes, text_key, word_hashes

THRESHOLD, BANDS, ROWS = 0.8, 25, 5
#: Hubs that a document is compared with at first; deviations of the estimate that the last step allows.
TOP, SIGMAS = 3, 4.0
#: Members of a block when a bucket is compared in full.
BLOCK = 256


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text)), return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """A row of m registers for each document: the shingle that arrived first; 0 where there are no shingles."""
    n = len(docs)
    element = np.concatenate([s for s, _ in docs]) if n else np.empty(0, np.uint64)
    rate = np.concatenate([w for _, w in docs]).astype(float) if n else np.empty(0)
    doc = np.repeat(np.arange(n), [len(s) for s, _ in docs])
    first, held = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    at, r = np.zeros(len(element)), 0
    while len(element):
        z = mix64(element, 2 * r + 1)
        at = at - np.log(((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        register = doc * m + (mix64(element, 2 * r + 2) % np.uint64(m)).astype(np.int64)
        wins = np.flatnonzero(at < first[register])
        order = wins[np.argsort(-at[wins], kind="stable")]  # the earliest is written last
        first[register[order]], held[register[order]] = at[order], element[order]
        latest = first.reshape(n, m).max(1)
        live = at < latest[doc]
        element, rate, doc, at, r = element[live], rate[live], doc[live], at[live], r + 1
    return held.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit value for each band of each signature."""
    out = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        out = mix64(out ^ sig[:, j : bands * rows : rows], j + 1)
    return mix64(out + np.arange(bands, dtype=np.uint64), 99)


def probability_jaccard(s: np.ndarray, v: np.ndarray, t: np.ndarray, w: np.ndarray) -> float:
    """Of two sets of distinct ascending elements s and t with weights v and w."""
    if not len(s) or not len(t):
        return 0.0
    both, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    if (v == 1).all() and (w == 1).all():
        return len(both) / (len(s) + len(t) - len(both))
    a, b = np.delete(v, i), np.delete(w, j)
    pairs = np.concatenate([np.stack([v[i], w[j]], 1), np.stack([a, np.zeros_like(a)], 1), np.stack([np.zeros_like(b), b], 1)])
    kinds, counts = np.unique(pairs, axis=0, return_counts=True)  # few: by weights, not by elements
    common = np.flatnonzero((kinds > 0).all(1))
    return float(sum(counts[k] / (counts * np.maximum(kinds[:, 0] / kinds[k, 0], kinds[:, 1] / kinds[k, 1])).sum() for k in common))


def _bands(keyed: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1.0):
            docs = [weighted(t) for t in b.column(1).to_pylist()]
            some = [k for k, d in enumerate(docs) if len(d[0])]
            if some:
                values = band_hashes(signatures([docs[k] for k in some], bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.ListArray.from_arrays(np.arange(0, len(some) * bands + 1, bands, dtype=np.int32), pa.array(values.ravel().view(np.int64)))], ["key", "bands"])

    return keyed.select("key", "text").mapInArrow(run, "key binary, bands array<long>")


def _sets(keyed: DataFrame, m: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1.0):
            docs = [weighted(t) for t in b.column(1).to_pylist()]
            sig = (signatures(docs, m) & np.uint64(0x7FFF)).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s, _ in docs], pa.binary()), pa.array([b"" if (w == 1).all() else w.astype("<u4").tobytes() for _, w in docs], pa.binary()), pa.array([int(w.sum()) for _, w in docs], pa.int64()), pa.ListArray.from_arrays(np.arange(0, len(docs) * m + 1, m, dtype=np.int32), pa.array(sig.ravel()))], ["key", "set", "weights", "total", "sig"])

    return keyed.select("key", "text").mapInArrow(run, "key binary, set binary, weights binary, total long, sig array<short>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs: a, b. Returns those linked, with similarity."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("set").alias(f"s{x}"), F.col("weights").alias(f"w{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda s, w: (np.frombuffer(s, np.uint64), np.frombuffer(w, "<u4").astype(np.int64) if w else np.ones(len(s) // 8, np.int64))
        for b in slices(batches):
            x = [probability_jaccard(*load(r["sa"], r["wa"]), *load(r["sb"], r["wb"])) for r in b.to_pylist()]
            keep = pa.array([v >= threshold for v in x])
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(x, pa.float64()).filter(keep)], ["a", "b", "similarity"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary, similarity double")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(keyed: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """keyed: key, text. Returns links (a, b, similarity) that connect all near texts, and the labels of their components."""
    every = stored(_bands(keyed, bands, rows).select(F.explode("bands").alias("band"), "key").distinct())
    shared = every.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    sized = stored(every.join(shared, "band"))
    # what a group of near copies was made from is in the largest bucket of most bands: it makes the best hub
    weight = sized.groupBy("key").agg(F.sum("size").alias("weight"))
    members = stored(sized.join(weight, "key").select("band", "key", "weight"))
    discard(every, sized)
    wanted = members.select("key").distinct()
    sets = stored(_sets(keyed.join(few(stored(wanted)), "key", "left_semi").dropDuplicates(["key"]), bands * rows))

    # members with the hub of their bucket that they meet most often
    hubs = members.groupBy("band").agg(F.max(F.struct("weight", F.xxhash64("key").alias("h"), F.col("key").alias("hub"))).alias("top")).select("band", "top.hub")
    met = members.join(hubs, "band").filter("key <> hub").groupBy("key", "hub").count()
    best = Window.partitionBy("key").orderBy(F.desc("count"), "hub")
    tested = stored(met.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= TOP).select(*_ordered("key", "hub")).distinct())
    found = stored(_verified(tested, sets, threshold))
    labels = components(found)

    # buckets that hold several components: members with the one of most links
    open_ = _open(members, labels)
    degree = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    ranked = open_.join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", "key", "label")).alias("top")).select("band", F.col("top.key").alias("hub"), F.col("top.label").alias("hub_label"))
    met = open_.join(hubs, "band").filter("label <> hub_label").groupBy("key", "hub").count()
    met = met.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= TOP)
    more = stored(met.select(*_ordered("key", "hub")).distinct().join(tested, ["a", "b"], "left_anti"))
    second = stored(_verified(more, sets, threshold))
    discard(open_, sweep=False)
    labels = more_links(labels, second)

    # what is left: pairs across components that can be near, block against block
    open_ = _reachable(_open(members, labels), sets, threshold)
    rest = stored(_across(open_, sets, threshold, bands * rows).join(tested.unionByName(more), ["a", "b"], "left_anti"))
    third = stored(_verified(rest, sets, threshold))
    out = stored(found.unionByName(second).unionByName(third))
    labels = more_links(labels, third)
    discard(members, sets, tested, found, open_, more, second, rest, third)
    return out, labels


#: Members of open buckets are looked at again while at least this share of them goes.
FALL = 0.05


def _reachable(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """open_ (band, key, label) without the members that none of another label in their bucket can be near to.

    If shingles of total weight shares x and y are common to two texts, their probability Jaccard is at most 1 / (1/x + 1/y - 1): each term is at most
    1 / (1/p + (1 - y)/q), which is concave and homogeneous in the shares p and q of a shingle. For texts of distinct shingles that is common / (all - common), so that
    the sizes tell how much must be common. No more can be common than what recurs under other labels.
    """
    most, tiny = 1 + 1 / threshold, 1e-9

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1.0):
            made = [np.frombuffer(x, np.int64) for x in b.column("set").to_pylist()]
            own = pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made]))
            weight = np.concatenate([np.frombuffer(w, "<u4").astype(np.int32) if w else np.ones(len(x), np.int32) for w, x in zip(b.column("weights").to_pylist(), made)])
            yield pa.RecordBatch.from_arrays([b.column("key").take(own), b.column("label").take(own), pa.array(np.concatenate(made)), pa.array(weight)], ["key", "label", "shingle", "weight"])

    while True:
        before = open_.count()
        if not before:
            return open_
        each = stored(open_.select("key", "label").distinct().join(sets.select("key", "set", "weights"), "key").mapInArrow(cut, "key binary, label binary, shingle long, weight int"))
        recur = each.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("shingle")
        common = each.join(recur, "shingle", "left_semi").groupBy("key").agg(F.sum("weight").alias("common"))
        share = sets.join(common, "key").select("key", (F.octet_length("weights") == 0).alias("plain"), F.col("total").alias("size"), (F.col("common") / F.col("total")).alias("share"))
        share = stored(share.filter(F.col("share") >= threshold - tiny))
        members = stored(open_.join(share, "key"))
        buckets = members.groupBy("band").agg(F.min(F.when(F.col("plain"), F.col("size"))).alias("least"), F.max(F.when(~F.col("plain"), F.col("share"))).alias("odd"), F.max("share").alias("any"))
        fits = lambda other: F.coalesce(1 / F.col("share") + 1 / F.col(other) <= most + tiny, F.lit(False))
        plain = F.coalesce(F.col("least") <= F.col("size") * (most * F.col("share") - 1) + 1e-6, F.lit(False)) | fits("odd")
        kept = stored(members.join(buckets, "band").filter(F.when(F.col("plain"), plain).otherwise(fits("any"))).select("band", "key", "label"))
        several = kept.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
        left = stored(kept.join(several, "band"))
        discard(open_, each, share, members, kept, sweep=False)
        if left.count() > (1 - FALL) * before:
            return left
        open_ = left


#: Weight up to which documents of a block are compared all at once.
LEVELS = 5


def similarities(docs: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Probability Jaccard of all pairs, from how many elements have each pair of weights, of which there should be few."""
    weight = np.concatenate(counts)
    levels = np.unique(weight)
    ids, place = np.unique(np.concatenate(docs), return_inverse=True)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    order = np.argsort(place, kind="stable")
    row, place, weight = row[order], place[order], weight[order]
    heavy = np.zeros(len(ids), bool)
    heavy[place[weight > 1]] = True
    plain = ~heavy[place]
    n = len(docs)
    both = np.zeros((n, n), np.float32)
    for k in range(0, len(ids), 4096):  # elements that weigh 1 wherever they are, a part at a time
        lo, hi = np.searchsorted(place, [k, k + 4096])
        use = np.flatnonzero(plain[lo:hi]) + lo
        part = np.zeros((n, 4096), np.float32)
        part[row[use], place[use] - k] = 1
        both += part @ part.T
    size = np.bincount(row[plain], minlength=n).astype(np.float32)
    column = np.cumsum(heavy) - 1
    levels = np.unique(np.r_[1, levels])
    met = {(a, b): np.zeros((n, n), np.float32) for a in (0, *levels) for b in (0, *levels) if a or b}
    row, column, weight = row[~plain], column[place[~plain]], weight[~plain]
    for k in range(0, int(heavy.sum()), 1024):  # the others, a part at a time
        lo, hi = np.searchsorted(column, [k, k + 1024])
        dense = np.zeros((n, 1024), np.int64)
        dense[row[lo:hi], column[lo:hi] - k] = weight[lo:hi]
        own = {a: (dense == a).astype(np.float32) for a in (0, *levels)}
        for a, b in met:
            met[a, b] += own[a] @ own[b].T
    met[1, 1] += both
    met[1, 0] += size[:, None] - both
    met[0, 1] += size[None] - both
    out = np.zeros((n, n))
    for a in levels:
        for b in levels:
            if met[a, b].any():
                out += met[a, b] / np.maximum(sum(m * max(x / a, y / b) for (x, y), m in met.items()), 1e-9)
    return out


def _across(open_: DataFrame, sets: DataFrame, threshold: float, m: int) -> DataFrame:
    """a, b: pairs of different components in one bucket that may be near. A bucket is split into blocks of about BLOCK members; a task sees two blocks and returns only what it finds."""
    least = int(m * threshold - SIGMAS * (m * threshold * (1 - threshold)) ** 0.5)
    sized = open_.join(open_.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "band")
    own = F.pmod(F.xxhash64(F.lit(5), "key"), F.col("blocks"))
    dealt = sized.withColumn("own", own).select("band", "key", "label", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("band", "key", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    dealt = dealt.join(sets.select("key", "set", "weights", "sig"), "key")

    def near(table: pa.Table) -> pa.Table:
        keys, labels = (table.column(c).to_pylist() for c in ("key", "label"))
        docs = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        counts = [np.frombuffer(w, "<u4").astype(np.int64) if w else np.ones(len(d), np.int64) for w, d in zip(table.column("weights").to_pylist(), docs)]
        left, right = (np.array(table.column(c).to_pylist(), bool) for c in ("left", "right"))
        name = np.unique(np.array([hash(x) for x in labels]), return_inverse=True)[1]
        allowed = (name[:, None] != name[None]) & left[:, None] & right[None]
        odd = np.array([c.max() > LEVELS for c in counts])
        hit = similarities([d[:0] if o else d for d, o in zip(docs, odd)], [c[:0] if o else c for c, o in zip(counts, odd)]) >= threshold - 1e-4
        if odd.any():  # each of these alone, with those whose signatures come near
            sig = np.array(table.column("sig").to_pylist(), np.int16)
            for x in np.flatnonzero(odd):
                for y in np.flatnonzero(((sig == sig[x]).sum(1) >= least) & (allowed[x] | allowed[:, x])):
                    hit[x, y] = hit[y, x] = probability_jaccard(docs[x], counts[x], docs[y], counts[y]) >= threshold
        hit &= allowed
        pairs = {(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in zip(*np.nonzero(hit))}
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return dealt.groupBy("band", "i", "j").applyInArrow(near, "a binary, b binary").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, key, label of the members of buckets with several components."""
    own = stored(members.join(labels, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label")))
    several = own.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    out = stored(own.join(several, "band"))
    discard(own, sweep=False)
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (of its text), class_id (the least doc_id of its class), class_size, n_links (of its text in the links found, which aren't all its near texts) of each row."""
    keyed = key_and_text(docs, id_col, text_col).withColumn("key", text_key(F.col("text")))
    found, labels = links(keyed, threshold, bands, rows)
    slim = keyed.select("doc_id", "key")
    degree = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    texts = slim.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = texts.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_text = named.join(sizes, "label").select("key", "label", "class_id", "class_size").join(degree, "key", "left")
    return slim.join(by_text, "key").select("doc_id", "key", "label", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least id, with all columns of docs."""
    made = stored(classes(docs, threshold, id_col, text_col))
    # the copies that go: texts of larger classes other than the winner's, or rows of the winner's text with other ids
    winner = made.filter("class_size > 1").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("w"), F.count("*").alias("n"))
    equal = made.filter("class_size > 1").join(winner, "label").filter((F.col("key") == F.col("w.key")) & F.col("doc_id").eqNullSafe(F.col("w.doc_id"))).groupBy("label").agg(F.count("*").alias("copies"))
    winner = winner.join(equal, "label").select("label", F.col("w.key").alias("win_key"), F.col("w.doc_id").alias("win_id"), "copies")
    fate = made.filter("class_size > 1").select("key", "label").distinct().join(winner, "label").select(F.col("key").alias("_key"), (F.col("key") == F.col("win_key")).alias("_wins"), F.col("win_id").alias("_id"), F.col("copies").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(id_col).cast("long").alias("_doc"))
    judged = rows.join(few(stored(fate)), "_key", "left").filter(F.col("_wins").isNull() | (F.col("_wins") & F.col("_doc").eqNullSafe(F.col("_id"))))
    single = judged.filter(F.coalesce("_copies", F.lit(1)) == 1).select("row.*")
    repeated = judged.filter("_copies > 1").dropDuplicates(["_key"]).select("row.*")
    return single.unionByName(repeated)
