"""Quality scores from the sizes that two zstandard dictionaries compress a text to.

One dictionary is made of good labelled text, the other of bad. Text like the
good compresses better with the first, so the difference of both sizes over the
larger, x = (bad - good) / max, tells the kinds apart; a logistic curve
fitted on other labelled rows turns x into the chance of label 1.

Bounds: labels are learned from at most SAMPLE rows of each label, those with the
smallest hashes of their ids. A dictionary is trained on at most PIECES pieces of PIECE
bytes, taken from whole texts of every second of these rows; the
curve is fitted on the others, each label weighted by how many rows it stands
for, from counts by x rounded to three places. The sample's ids are broadcast, so no text
is dealt out, and rows are scored where they are read.

Defined cases: a null or empty text has x = 0; labels other than 0 and 1 and
null ids teach nothing; if one label has no rows, every score is 0.5; equal
rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_and_text, slices, stored

DICTIONARY, LEVEL, PIECE, PIECES, SAMPLE = 112_640, 3, 1000, 4000, 4000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = LEVEL


def differences(model: Model):
    """texts -> x of each."""
    good, bad = (zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))

    def of(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            raw = t.encode()
            a, b = (len(good.compress(raw)), len(bad.compress(raw))) if raw else (1, 1)
            out.append((b - a) / max(a, b))
        return out

    return of


def dictionary(pieces: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: the pieces are the dictionary
        return b"".join(pieces)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve through n rows at each x with label y; a slight penalty keeps separable rows finite."""
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        grad = design.T @ (n * (y - p)) - ridge @ w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 8.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def drawn(rows: DataFrame, counts: dict[int, int], sample: int) -> DataFrame:
    """At most sample rows of each label y. Hashes over a bound are dropped first, so that no task sends a whole sample to the driver."""
    out = None
    for y, n in counts.items():
        bound = min(1 << 30, int((1 << 30) * (sample + 6 * sample**0.5 + 50) / max(n, 1)))
        own = rows.filter((F.col("y") == y) & (F.pmod(F.col("h"), F.lit(1 << 30)) < bound)).orderBy("h", "doc_id").limit(sample)
        out = own if out is None else out.unionByName(own)
    return out


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", size: int = DICTIONARY, pieces: int = PIECES, piece: int = PIECE, sample: int = SAMPLE) -> Model:
    """may_learn: over the column doc_id, whether a row's label may be used."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & may_learn & F.col("doc_id").isNotNull())
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model(b"", b"", 0.0, 0.0)
    chosen = F.broadcast(drawn(known.withColumn("h", F.xxhash64(F.lit(41), "doc_id")), counts, sample))
    rows = stored(key_and_text(docs, id_col, text_col).join(chosen, "doc_id").withColumn("odd", F.pmod(F.xxhash64("doc_id"), F.lit(2))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            y, out = [], []
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = t.encode()
                own = [raw[k : k + piece] for k in range(0, len(raw), piece)]
                y += [label] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.binary())], ["y", "piece"])

    parts = rows.filter("odd = 0").select("text", "y").mapInArrow(cut, "y int, piece binary").withColumn("h", F.xxhash64("piece"))
    made = []
    for label in (1, 0):
        own = [bytes(r.piece) for r in parts.filter(F.col("y") == label).orderBy("h", "piece").limit(pieces).collect()]
        if not own:
            return Model(b"", b"", 0.0, 0.0)
        made.append(own)
    least = min(sum(map(len, own)) for own in made)  # as much text of either kind
    equal = [own[: max(1, int(np.searchsorted(np.cumsum([len(p) for p in own]), least)) + 1)] for own in made]
    model = Model(dictionary(equal[0], size), dictionary(equal[1], size), 0.0, 0.0)
    of = _scorer(rows.filter("odd = 1").select(F.col("y").cast("long").alias("doc_id"), "text"), model, raw=True)
    found = of.groupBy(F.round("score", 3).alias("x"), F.col("doc_id").alias("y")).count().collect()
    seen = {y: sum(r["count"] for r in found if r.y == y) for y in (0, 1)}
    if not all(seen.values()):
        return model
    total = sum(seen.values()) / sum(counts.values())
    slope, offset = logistic(*(np.array(v, float) for v in zip(*((r.x, r.y, r["count"] * total * counts[r.y] / seen[r.y]) for r in found))))
    return Model(model.good, model.bad, slope, offset)


def _scorer(keyed: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = differences(model) if model.good else lambda texts: [0.0] * len(texts)
        for b in slices(batches):
            x = of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x if raw else [1 / (1 + math.exp(-max(-35.0, min(35.0, model.slope * v + model.offset)))) for v in x], pa.float64())], ["doc_id", "score"])

    return keyed.mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of each row."""
    return _scorer(key_and_text(docs, id_col, text_col), model)
