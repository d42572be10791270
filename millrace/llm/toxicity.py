"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 5 characters of a lower-cased text, hashed to 2**BITS cells. A cell's ratio
is the log of how much more often documents of the toxic class have it; cells that fewer than MIN_DOCUMENTS documents
of the sample have, or whose ratio is below MIN_RATIO either way, are left out. A text's vector holds the ratios of
its cells, scaled to length 1, and logistic regression weighs them.

The classifier is fitted on about TRAIN_ROWS labelled rows, chosen by the hash of their ids: the bound is this
parameter. Cells are counted on the executors, in arrays of fixed size; the fit itself sees the few hundred kept cells
of each row of the sample. Scores cover every row and whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import slices
from millrace.llm.common import written

BITS = 18
SIZES = (3, 4, 5)
MIN_DOCUMENTS = 5
MIN_RATIO = 0.5
TRAIN_ROWS = 6000
STEPS, RATE, PENALTY = 60, 0.1, 0.1
THRESHOLD = 0.3
SLICES = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def cells(texts: list[str], active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of the distinct cells of each text, sorted; of active cells only, if given."""
    padded = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, padded), np.int64, len(padded))
    text = np.repeat(np.arange(len(texts)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(chars))
    state, found = np.full(len(chars), MIX), []
    for n in range(1, SIZES[-1] + 1):
        state = (state[: len(chars) - n + 1] ^ chars[n - 1:]) * MIX
        state ^= state >> np.uint64(29)
        if n in SIZES:
            cell = (state >> np.uint64(64 - BITS)).astype(np.int64)
            own = left[: len(cell)] >= n
            own = own if active is None else own & active[cell]
            found.append(text[: len(cell)][own] << BITS | cell[own])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        text, cell = cells(texts, self.ratio != 0)
        value = self.ratio[cell]
        length = np.sqrt(np.bincount(text, value * value, len(texts)))
        z = np.bincount(text, value * self.weight[cell], len(texts)) / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def ratios(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """counts: documents of class 0 and 1 that have each cell; sizes: documents of each class."""
    rate = (counts + 1) / (sizes[:, None] + 2)
    out = np.log(rate[1]) - np.log(rate[0])
    out[(counts.sum(0) < MIN_DOCUMENTS) | (np.abs(out) < MIN_RATIO)] = 0
    return out


def fit(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over (label, kept cells) rows; returns weights by cell and the bias."""
    used = np.flatnonzero(ratio)
    place = np.zeros(len(ratio), np.int64)
    place[used] = np.arange(len(used))
    label = np.array([y for y, _ in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(c) for _, c in rows])
    cell = place[np.concatenate([c for _, c in rows])] if rows else np.zeros(0, np.int64)
    value = ratio[used][cell]
    value = value / np.sqrt(np.bincount(row, value * value, len(rows)))[row]
    w = np.zeros(len(used) + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = np.bincount(row, value * w[cell], len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
        slope = np.append(np.bincount(cell, value * error[row], len(used)) + PENALTY * w[:-1], error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        w -= RATE * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros(len(ratio))
    weight[used] = w[:-1]
    return weight, float(w[-1])


def held_out(id_col: str = "doc_id"):
    """True for ids whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Null labels and ids are not learned from; null texts are empty ones. Without labels of both classes every score is the share of 1s."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, F.col(label_col).cast("int").alias("label"))
    share = int(min(1.0, train_rows / max(1, known.count())) * (1 << 20))
    chosen = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share
    texts = docs.where(chosen & ~held_out(id_col)).select(id_col, F.col(text_col).alias("text"))
    sample = written(texts.join(known.where(chosen), id_col).select("label", "text"), "labelled")
    width = (1 << BITS) // SLICES

    def count(found):
        totals, sizes = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in found:
            label = (np.asarray(batch.column(0)) > 0).astype(int)
            sizes += np.bincount(label, minlength=2)
            for a, part in slices(batch.column(1)):
                text, cell = cells(part)
                for y in (0, 1):
                    totals[y] += np.bincount(cell[label[a: a + len(part)][text] == y], minlength=1 << BITS)
        parts = totals.reshape(2, SLICES, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([parts[:, s].tobytes() for s in range(SLICES)]), pa.array([sizes.tobytes()] * SLICES)], names=["slice", "counts", "sizes"])

    def add(t: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(b, np.int64) for b in t.column(c).to_pylist()).tobytes() for c in ("counts", "sizes")]
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array(sums[:1]), "sizes": pa.array(sums[1:])})

    kind = "slice int, counts binary, sizes binary"
    summed = sample.mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).orderBy("slice").collect()
    sizes = np.frombuffer(summed[0]["sizes"], np.int64).astype(float) if summed else np.zeros(2)
    if not sizes.all():
        share_of_ones = min(max(sizes[1] / max(1, sizes.sum()), 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), float(np.log(share_of_ones / (1 - share_of_ones))))
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64).reshape(2, width) for r in summed], axis=1)
    ratio = ratios(counts, sizes)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def kept(found):
        active = shared.value != 0
        for batch in found:
            for a, part in slices(batch.column(1)):
                text, cell = cells(part, active)
                split = np.split(cell.astype(np.int32), np.searchsorted(text, np.arange(1, len(part))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array([s.tobytes() for s in split], pa.binary())], names=["label", "cells"])

    rows = [(int(r["label"] > 0), np.frombuffer(r["cells"], np.int32)) for r in sample.mapInArrow(kept, "label int, cells binary").collect()]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    return Model(ratio, *fit(rows, ratio))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1), predicted. Null and empty texts have no cells but their padding
    and get the score that the bias gives; long texts are read whole; repeated rows score alike; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(found):
        for batch in found:
            for a, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(shared.value.scores(texts))], names=out.names)

    return docs.select(id_col, text_col).mapInArrow(run, out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold. Null and empty texts have one score, long texts
    are read whole, repeated rows go or stay together, a score that equals the threshold goes, an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(found):
        for batch in found:
            for a, texts in slices(batch.column(batch.schema.get_field_index(text_col))):
                yield batch.slice(a, len(texts)).filter(pa.array(shared.value.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
