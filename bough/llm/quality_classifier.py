"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Features are the distinct unigrams and bigrams of a text's tokens (runs of word
characters, lower-cased, and runs of punctuation; a token that repeats the one before
it is the token "repeat"), hashed to 2 ** 18 places. Two models are trained, for the
labels quality and toxic, with per-coordinate FTRL-proximal updates. A score is a
sparse dot product with the weights. A document is kept unless P(quality) is under
0.5 or P(toxic) over 0.5.

Training reads ``sample`` labelled documents (6000 by default), those of least hashed
doc_id; scoring reads all documents, whole.

Edge cases: labels without doc_id, quality or toxic are passed over; of several labels
of a document the worst counts (least quality, greatest toxic). A document whose rows
repeat is trained on once a row. Null and empty texts have no features and get the
models' biases. Without labels both probabilities are 0.5 and all is kept. Every row,
also one without doc_id, gets a score; further columns aren't read. No rows give no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.llm import text as T

BITS = 18
_REPEAT = np.uint64(0x243F6A8885A308D3)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every distinct feature of a row, sorted."""
    row, h = T.words(column, classes=T.TOKENS)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])
    h = np.where(same, _REPEAT, h)
    at, two = T.grams(row, h, 2)
    place = np.concatenate([h, two]) >> np.uint64(64 - BITS)
    key = np.unique((np.concatenate([row, row[at]]).astype(np.uint64) << np.uint64(BITS)) | place)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal with binary features; place 2 ** BITS is the bias."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << BITS)
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n).astype(np.float32)


def train(examples: list[tuple[np.ndarray, int, int]], epochs: int = 3) -> np.ndarray:
    """(2, 2 ** BITS + 1) weights of quality and toxic from (places, quality, toxic)."""
    models = Ftrl(), Ftrl()
    dice = np.random.default_rng(1)
    for _ in range(epochs):
        for i in dice.permutation(len(examples)):
            places, *labels = examples[i]
            for model, label in zip(models, labels, strict=True):
                model.update(places, label)
    return np.stack([m.weights() for m in models])


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[np.ndarray, int, int]]:
    """The training examples, in an order of their own."""
    known = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & labels["toxic"].isNotNull())
    known = known.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"]).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``sample`` small rows

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        row, place = features(part.column("text"))
        offs = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(place.astype(np.int32)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), part.column("toxic"), lists], ["doc_id", "quality", "toxic", "places"])

    got = rows.mapInArrow(T.in_slices(run), "doc_id long, quality int, toxic int, places array<int>").toArrow()
    out = [(p, q, t, d) for d, q, t, p in zip(got["doc_id"].to_pylist(), got["quality"].to_pylist(), got["toxic"].to_pylist(), (np.array(x.values) for x in got["places"]), strict=True)]
    out.sort(key=lambda x: (x[3], len(x[0]), x[0].tobytes()))
    return [(p, q, t) for p, q, t, _ in out]


def score(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """(doc_id, quality, toxic, keep) for every row of docs."""
    weights = docs.sparkSession.sparkContext.broadcast(train(sampled(docs, labels, sample)))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        w = weights.value
        row, place = features(part.column("text"))
        n = part.num_rows
        p = [1 / (1 + np.exp(-np.clip(np.bincount(row, x[place], n) + x[-1], -35, 35))) for x in w]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p[0]), pa.array(p[1]), pa.array((p[0] >= 0.5) & (p[1] <= 0.5))], ["doc_id", "quality", "toxic", "keep"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"]).alias("text")).mapInArrow(T.in_slices(run), "doc_id long, quality double, toxic double, keep boolean")
