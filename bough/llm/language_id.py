"""Language ID: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of ``WINDOW`` bytes, from the first to the
last; in each window one network reads forwards, another backwards, and a softmax
over both states gives every byte a probability for each language. A document's
probability for a language is the mean over all its bytes; the greatest is its
label. The network is trained in numpy by backpropagation through time, with Adam,
on random windows of ``sample`` labelled documents (1500 by default, of each language
as many, those of least hash); labelling reads every byte of every document.

Edge cases: languages are the distinct non-null values of lang in all rows that have a text. A null
or empty text has no bytes, so its label and probabilities are null. Labels say
nothing about rows whose lang is null; such rows are labelled like others. Without
labelled rows all labels are null. Rows that repeat get equal results; further
columns aren't read. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bough.llm import text as T

WINDOW, HIDDEN = 96, 12
_LOT = 1024
Parameters = dict[str, np.ndarray]


def start(classes: int, hidden: int = HIDDEN, seed: int = 3) -> Parameters:
    dice = np.random.default_rng(seed)
    p: Parameters = {}
    for d in "fb":
        p[f"x{d}"] = dice.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        p[f"u{d}"] = dice.normal(0, 0.4 / np.sqrt(hidden) * 2, (hidden, 3 * hidden)).astype(np.float32)
        p[f"w{d}"] = dice.normal(0, 0.3, (hidden, classes)).astype(np.float32)
    p["c"] = np.zeros(classes, np.float32)
    return p


def _read(p: Parameters, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, n, hidden) of one direction over x (T, n) bytes; a masked step leaves the state as it is at 0."""
    steps, n = x.shape
    k = p["uf"].shape[0]
    states = np.empty((steps, n, k), np.float32)
    h = np.zeros((n, k), np.float32)
    table, u = p[f"x{d}"], p[f"u{d}"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = table[x[t]]
        r = h @ u
        gate = np.tanh((a[:, : 2 * k] + r[:, : 2 * k]) * np.float32(0.5))
        gate *= np.float32(0.5)
        gate += np.float32(0.5)
        new = np.tanh(a[:, 2 * k :] + gate[:, k:] * r[:, 2 * k :])
        before, h = h, new + gate[:, :k] * (h - new)
        if mask is not None:
            h *= mask[t][:, None]
        states[t] = h
        if keep is not None:
            keep.append((t, before, gate, new, r[:, 2 * k :]))
    return states


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def positions(p: Parameters, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """(T, n, classes): each byte's probabilities."""
    return _softmax(_read(p, "f", x, mask) @ p["wf"] + _read(p, "b", x, mask) @ p["wb"] + p["c"])


def gradients(p: Parameters, x: np.ndarray, label: np.ndarray) -> tuple[float, Parameters]:
    """Mean cross-entropy over all positions of full windows, and its gradients, by backpropagation through time."""
    steps, n = x.shape
    k = p["uf"].shape[0]
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: _read(p, d, x, None, kept[d]) for d in "fb"}
    prob = _softmax(states["f"] @ p["wf"] + states["b"] @ p["wb"] + p["c"])
    loss = float(-np.log(prob[:, np.arange(n), label] + 1e-9).mean())
    prob[:, np.arange(n), label] -= 1
    prob /= steps * n
    g: Parameters = {"c": prob.sum(axis=(0, 1))}
    for d in "fb":
        g[f"w{d}"] = states[d].reshape(-1, k).T @ prob.reshape(-1, prob.shape[2])
        dx, du = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"])
        out = prob @ p[f"w{d}"].T
        carry = np.zeros((n, k), np.float32)
        for t, before, gate, new, r in reversed(kept[d]):
            dh = out[t] + carry
            z, s = gate[:, :k], gate[:, k:]
            dz = dh * (before - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            ds = dn * r * s * (1 - s)
            da = np.concatenate([dz, ds, dn], axis=1)
            dr = np.concatenate([dz, ds, dn * s], axis=1)
            np.add.at(dx, x[t], da)
            du += before.T @ dr
            carry = dh * z + dr @ p[f"u{d}"].T
        g[f"x{d}"], g[f"u{d}"] = dx, du
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, classes: int, steps: int = 200, lot: int = 96, rate: float = 0.02, seed: int = 5) -> Parameters:
    """Fit to texts of at least WINDOW bytes; shorter ones are repeated to that length."""
    p = start(classes)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    dice = np.random.default_rng(seed)
    texts = [t if len(t) >= WINDOW else t * (WINDOW // len(t) + 1) for t in texts]
    by = [np.flatnonzero(labels == c) for c in range(classes)]
    for i in range(1, steps + 1):
        pick = np.array([dice.choice(by[c]) for c in dice.integers(0, classes, lot)])
        at = [dice.integers(0, len(texts[k]) - WINDOW + 1) for k in pick]
        x = np.stack([np.frombuffer(texts[k], np.uint8, WINDOW, int(a)) for k, a in zip(pick, at, strict=True)], axis=1)
        _, g = gradients(p, x, labels[pick])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            now = rate * min(1.0, 3 * (1 - i / (steps + 1)))
            p[k] = (p[k] - now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
    return p


def pooled(p: Parameters, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, classes): sums of the positions' probabilities, and how many positions have each label."""
    offs, raw = T.buffers(column)
    size = np.diff(offs)
    classes = len(p["c"])
    total, labelled = np.zeros((len(size), classes)), np.zeros((len(size), classes), np.int64)
    per = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), per)
    begin = offs[:-1][row] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    end = np.minimum(begin + WINDOW, offs[1:][row])
    # windows of a length together, so that only few steps are masked
    order = np.argsort(end - begin, kind="stable")
    steps = np.arange(WINDOW)
    for i in range(0, len(order), _LOT):
        now = order[i : i + _LOT]
        most = int((end - begin)[now].max())
        at = begin[now][None, :] + steps[:most, None]
        full = int((end - begin)[now].min()) == most
        mask = None if full else (at < end[now][None, :]).astype(np.float32)
        prob = positions(p, raw[np.minimum(at, len(raw) - 1)], mask)
        if mask is not None:
            prob *= mask[:, :, None]
        hot = prob.argmax(axis=2)
        sums = prob.sum(axis=0)
        for c in range(classes):
            total[:, c] += np.bincount(row[now], sums[:, c], len(size))
            mine = (hot == c) if mask is None else (hot == c) & (mask > 0)
            labelled[:, c] += np.bincount(row[now], mine.sum(axis=0), len(size)).astype(np.int64)
    return total, labelled


def fitted(docs: DataFrame, sample: int, steps: int) -> tuple[list[str], Parameters | None]:
    """The languages and the network, from as many labelled rows of each language, of least hash; rows that repeat count once."""
    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & (F.length(docs["text"]) > 0)).select(F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("k"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    names = sorted(r[0] for r in known.select("lang").distinct().collect())  # a row a language
    if not names:
        return [], None
    # which ones is settled on the hashes alone, so that no task gathers texts
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    cuts = known.select("k", "lang").withColumn("n", place).where(F.col("n") <= -(-sample // len(names))).groupBy("lang").agg(F.max("k").alias("cut"))
    chosen = known.join(F.broadcast(cuts), "lang").where("k <= cut").dropDuplicates(["lang", "k"]).select("k", "lang", "text")
    got = chosen.toArrow().sort_by([("k", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    labels = np.array([names.index(x) for x in got["lang"].to_pylist()])
    return names, train([x.encode() for x in got["text"].to_pylist()], labels, len(names), steps)


def identify(docs: DataFrame, sample: int = 1500, steps: int = 200) -> DataFrame:
    """(doc_id, language, probability, positions) for every row; positions maps each language to the number of bytes labelled with it."""
    names, network = fitted(docs, sample, steps)
    network = docs.sparkSession.sparkContext.broadcast(network)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        if not names:
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.map_(pa.string(), pa.int64()))], ["doc_id", "language", "probability", "positions"])
        total, labelled = pooled(network.value, part.column("text"))
        count = labelled.sum(axis=1)
        none = count == 0
        best = total.argmax(axis=1)
        top = np.divide(total[np.arange(n), best], count, out=np.zeros(n), where=~none)
        maps = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), pa.array(names * n, pa.string()), pa.array(labelled.ravel()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(names, object)[best], pa.string(), mask=none), pa.array(top, mask=none), maps], ["doc_id", "language", "probability", "positions"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(T.in_slices(run, most=1 << 20), "doc_id long, language string, probability double, positions map<string,bigint>")
