"""Quality classifier: a factorisation machine over hashed words, structure and length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import as_bytes, fold, rows_of, text_rows

# Labelled rows that the model is fitted on, at most; and rows it needs to be fitted at all.
TRAIN_ROWS = 10_000
BUCKETS, FACTORS = 1 << 16, 8
_MASK = BUCKETS - 1
_SIGNS = (b"#*$%&|<>", b"!", b".,;:?", b"0123456789", bytes(range(65, 91)), b"\n")
_DENSE = len(_SIGNS) + 5
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): structure first, then one per distinct hashed word, of unit length together.

    Structure: shares of symbol classes and capitals, of different words and of repeated
    lines, word length, and the length of the text as metadata.
    """
    text = raw or b""
    parts = text.lower().split()
    n, size = max(1, len(parts)), max(1, len(text))
    different = set(parts)
    lines = text.split(b"\n")
    dense = [8.0 * (len(text) - len(text.translate(None, signs))) / size for signs in _SIGNS]
    dense += [len(different) / n, 1.0 - len(set(lines)) / len(lines), sum(map(len, different)) / max(1, len(different)) / 10.0,
              np.log1p(size) / 10.0, 1.0 if parts else 0.0]
    hashed = np.fromiter((zlib.crc32(w) & _MASK for w in different), np.int32, len(different))
    indices = np.concatenate([np.arange(_DENSE, dtype=np.int32), hashed + _DENSE])
    values = np.concatenate([np.array(dense, np.float32),
                             np.full(len(hashed), 1.0 / np.sqrt(max(1, len(hashed))), np.float32)])
    return indices, values


@dataclass
class Machine:
    """w0, w (features) and v (features x factors)."""
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One margin per row, in time linear in its features."""
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *[len(i) for i, _ in rows[:-1]]])
        at, x = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        vx = self.factors[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(texts), 256):
            margin = self.margins([features(t) for t in texts[i:i + 256]]).astype(np.float64)
            out.append(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))
        return np.concatenate(out)


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 640, batch: int = 128,
                rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over shuffled mini-batches; the same rows give the same machine.

    Any number of rows takes the same number of steps, so fewer rows are seen more often.
    """
    rng = np.random.default_rng(seed)
    size = BUCKETS + _DENSE
    share = np.clip(labels.mean(), 0.01, 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32),
                rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1e-2
    per_epoch = -(-len(rows) // batch)
    for _ in range(-(-steps // per_epoch)):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), batch):
            chosen = order[low:low + batch]
            some = [rows[i] for i in chosen]
            lengths = [len(i) for i, _ in some]
            starts = np.cumsum([0, *lengths[:-1]])
            at, x = np.concatenate([i for i, _ in some]), np.concatenate([v for _, v in some])
            vx = m.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            squares = np.add.reduceat(vx * vx, starts, axis=0)
            margin = m.bias + np.add.reduceat(m.linear[at] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)
            error = ((1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(some)).astype(np.float32)
            per = np.repeat(error, lengths)
            used, back = np.unique(at, return_inverse=True)
            grad_w = np.bincount(back, per * x, len(used)).astype(np.float32) + decay * m.linear[used]
            each = (per * x)[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
            grad_v = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(FACTORS)], axis=1).astype(np.float32)
            grad_v += decay * m.factors[used]
            seen_w[used] += grad_w * grad_w
            seen_v[used] += grad_v * grad_v
            seen_b += float(error.sum()) ** 2
            m.linear[used] -= rate * grad_w / np.sqrt(seen_w[used])
            m.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            m.bias -= rate * float(error.sum()) / np.sqrt(seen_b)
    return m


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on labelled rows of (doc_id, text) with (doc_id, quality).

    Rows whose fold is 0 are held out. Of the others, the train_rows with the least hash
    of the id are taken; that many feature lists, and nothing else, reach the driver. An
    id with several labels counts as its smallest one, one with several texts as the one
    whose feature list sorts first; null labels are left out. Without
    rows the machine gives 0.5 for all.
    """
    chosen = (labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("_label"))
              .filter("doc_id IS NOT NULL AND _label IS NOT NULL").filter(fold(F.col("doc_id")) != 0)
              .groupBy("doc_id").agg(F.min("_label").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    # At most train_rows pairs of numbers: small enough to broadcast at any size.
    texts = docs.select(F.col("doc_id").cast("bigint"), as_bytes()).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for ids, raws, marks in text_rows(batches):
            made = [features(r) for r in raws]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "label": pa.array(marks, pa.int32()),
                "indices": pa.array([i.tobytes() for i, _ in made], pa.binary()),
                "x": pa.array([v.tobytes() for _, v in made], pa.binary())})

    # One list per id, so that no repeated id takes the place of another one.
    got = texts.select("doc_id", "text", "_label").mapInArrow(run, "doc_id bigint, label int, indices binary, x binary") \
        .groupBy("doc_id", "label").agg(F.min(F.struct("indices", "x")).alias("_first")) \
        .select("doc_id", "label", "_first.indices", "_first.x").orderBy("doc_id").collect()
    if not got:
        return Machine(0.0, np.zeros(BUCKETS + _DENSE, np.float32), np.zeros((BUCKETS + _DENSE, FACTORS), np.float32))
    rows = [(np.frombuffer(r["indices"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got]
    return fit_machine(rows, np.array([r["label"] for r in got], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text; predicted is 1 from the threshold on.

    A null text is empty; an empty one is scored by its structure. Repeated ids and null
    ids keep a row each; other columns are ignored; an empty table gives no rows. The
    machine has a fixed size and is broadcast; nothing is shuffled.
    """
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for ids, raws, held in text_rows(batches):
            scores = machine.value.scores(raws)
            yield rows_of({"doc_id": ids, "held_out": held, "score": scores,
                           "predicted": (scores >= threshold).astype(np.int32)}, _SCHEMA)

    return docs.select(F.col("doc_id").cast("bigint"), as_bytes(), (fold(F.col("doc_id")) == 0).alias("held_out")) \
        .mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def good_quality(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3) -> Column:
    """A condition on the text: true if its score reaches the threshold."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in texts:
            yield pd.Series(machine.value.scores(list(raw)) >= threshold, dtype="bool")

    return good(as_bytes(text))
