"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected several times, each time to a few dimensions, shifted and numbered
along a Hilbert curve. Spark deals every curve out by ranges of its key; a query looks
through the ranges beside its own key on every curve, and what it finds there is merged
and ranked by the exact distance. How wide the window of keys is follows from the measured
recall of some queries against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blogindex.llm.common import drop_stored, stored

# Curves, dimensions of each and bits of a dimension.
CURVES, DIMENSIONS, BITS = 8, 4, 10
# Vectors the projections and the key ranges are fitted on, and numbers in them, at most.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 21
# Queries whose true neighbours fix the width of the window, and the share of these it must hold.
TRIED, RECALL = 64, 0.96
# Rows of one range that a task compares at once; ranges of a curve at most, and rows they hold at least.
ROWS, RANGES, LEAST = 16_384, 1 << 13, 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along a Hilbert curve of each row of cell numbers (below 2**bits).

    Gray-codes the bits of all dimensions level by level from the top, turning the lower
    bits of each level into the frame of the cell they lie in.
    """
    x = [c.astype(np.uint64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = (key << np.uint64(1)) | (((v ^ turn) >> np.uint64(level)) & np.uint64(1))
    return key


@dataclass
class Curves:
    """Projections, cells and key ranges; of a size that the sample bounds."""
    middle: np.ndarray
    projections: np.ndarray
    quantiles: np.ndarray
    shifts: np.ndarray
    keys: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int, seed: int) -> Curves:
        """Random turns of the sample's main directions; the cells of a dimension hold equally many of it."""
        draw = np.random.default_rng(seed)
        middle = sample.mean(axis=0)
        width = sample.shape[1]
        main = np.linalg.svd(sample - middle, full_matrices=False)[2][:32]
        m = min(DIMENSIONS, len(main))
        turns = [np.linalg.qr(draw.normal(size=(len(main), len(main))))[0][:, :m] for _ in range(curves)]
        projections = np.stack([main.T @ t for t in turns])
        assert projections.shape == (curves, width, m)
        points = np.linspace(0, 1, 257)
        quantiles = np.stack([np.quantile((sample - middle) @ p, points, axis=0).T for p in projections])
        made = cls(middle, projections, quantiles, draw.random((curves, m)), np.zeros((curves, 0), np.uint64))
        made.keys = np.sort(np.stack(made.keys_of(sample)), axis=1)
        return made

    def keys_of(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Each vector's key on every curve."""
        out = []
        for projection, quantiles, shift in zip(self.projections, self.quantiles, self.shifts):
            flat = (vectors - self.middle) @ projection
            at = np.stack([np.interp(flat[:, j], q, np.linspace(0, 1, len(q))) for j, q in enumerate(quantiles)], axis=1)
            cells = np.minimum((at + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, BITS))
        return out

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(curves, vectors): the share of the sample whose key is smaller."""
        size = self.keys.shape[1]
        return np.stack([np.searchsorted(own, k) / size for own, k in zip(self.keys, self.keys_of(vectors))])


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def commonest_length(rows: DataFrame, vector: str) -> int | None:
    """The length most vectors have (ties: the longest)."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None


def usable_vectors(rows: DataFrame, key: str, vector: str, zero: bool = False) -> DataFrame:
    """(id, v) of the rows whose vector is there, not empty and without null or non-finite entries.

    Vectors of other lengths than the commonest are left out, and zero vectors, unless zero.
    """
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    if not zero:
        fine &= F.exists(v, lambda x: x != 0)
    rows = rows.filter(fine).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
    return rows.filter(F.size("v") == (commonest_length(rows, "v") or 0))


def _closest(queries: np.ndarray, rows: np.ndarray, k: int, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of every pair that may be among a query's k nearest.

    worst is each query's k-th squared distance so far. A fast product picks the pairs, with
    a margin above its rounding error; their distances are then worked out plainly.
    """
    q2, r2 = (queries ** 2).sum(axis=1), (rows ** 2).sum(axis=1)
    rough = q2[:, None] + r2[None, :] - 2 * queries @ rows.T
    error = 1e-13 * (q2 + r2.max()) + 1e-300
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(queries), np.inf)
    i, j = np.nonzero(rough <= (np.minimum(limit + error, worst) + error)[:, None])
    out = np.empty(len(i))
    for low in range(0, len(i), 100_000):
        part = slice(low, low + 100_000)
        out[part] = ((queries[i[part]] - rows[j[part]]) ** 2).sum(axis=1)
    return i, j, out


class _Nearest:
    """The k nearest rows so far of a block of queries, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for low in range(0, len(self.ids), 512):
            part = slice(low, min(low + 512, len(self.ids)))
            i, j, score = _closest(self.queries[part], rows, self.k, self.score[part, -1])
            if not len(i):
                continue
            count = part.stop - low
            who = np.concatenate([i, np.repeat(np.arange(count), self.k)])
            score = np.concatenate([score, self.score[part].ravel()])
            found = np.concatenate([ids[j], self.found[part].ravel()])
            order = np.lexsort((found, score, who))
            who, score, found = who[order], score[order], found[order]
            at = np.arange(len(who)) - np.searchsorted(who, who)
            keep = at < self.k
            self.score[low + who[keep], at[keep]] = score[keep]
            self.found[low + who[keep], at[keep]] = found[keep]

    def rows(self) -> pa.RecordBatch:
        there = np.isfinite(self.score)
        return pa.RecordBatch.from_pydict({
            "asked": pa.array(np.repeat(self.ids, self.k)[there.ravel()]), "near": pa.array(self.found[there]),
            "score": pa.array(np.sqrt(self.score[there]))})


def _window(classes: DataFrame, curves, tried: np.ndarray, k: int, recall: float) -> float:
    """The distance of key places that holds so large a share of the true neighbours of the tried queries.

    The true neighbours come from all vectors; each task keeps its k nearest.
    """
    def run(batches):
        fitted = curves.value
        mine = fitted.places(tried)
        best = [(np.zeros(0), np.zeros(0)) for _ in tried]
        for batch in batches:
            rows = matrix(batch.column(1))
            if not len(rows):
                continue
            places = fitted.places(rows)
            worst = np.array([b[0][k - 1] if len(b[0]) >= k else np.inf for b in best])
            i, j, score = _closest(tried, rows, k + 1, worst)
            apart = np.abs(places[:, j] - mine[:, i]).min(axis=0)
            for q in range(len(tried)):
                own = (i == q) & (score > 0)
                score_, apart_ = np.concatenate([best[q][0], score[own]]), np.concatenate([best[q][1], apart[own]])
                order = np.argsort(score_, kind="stable")[:k]
                best[q] = (score_[order], apart_[order])
        yield pa.RecordBatch.from_pydict({
            "q": pa.array(np.repeat(np.arange(len(tried), dtype=np.int32), [len(b[0]) for b in best])),
            "score": pa.array(np.concatenate([b[0] for b in best])), "apart": pa.array(np.concatenate([b[1] for b in best]))})

    found = classes.select("rep", "v").mapInArrow(run, "q int, score double, apart double")
    near = Window.partitionBy("q").orderBy("score", "apart")
    apart = [r["apart"] for r in found.withColumn("at", F.row_number().over(near)).filter(F.col("at") <= k).select("apart").collect()]
    return float(np.quantile(apart, recall)) if apart else 1.0


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    size = raw.shape[1] * raw.itemsize
    starts = np.arange(len(raw) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(starts), pa.py_buffer(raw)])


_PLACED = pa.schema([("curve", pa.int32()), ("range", pa.int32()), ("part", pa.int32()), ("asks", pa.bool_()),
                     ("rep", pa.int64()), ("v", pa.binary())])
_PLACED_DDL = "curve int, range int, part int, asks boolean, rep bigint, v binary"


def _placed(classes: DataFrame, curves, window: float, counts: np.ndarray, kind: str, least: int) -> DataFrame:
    """Every vector in its range of every curve, and every query in each range of its window.

    A window that holds fewer than least rows is widened to the next ranges. A range of more
    than ROWS rows is cut into parts, all of which see the queries.
    """
    def run(batches):
        fitted = curves.value
        total = counts.shape[1]
        parts = np.maximum(1, -(-counts // ROWS))
        sums = np.concatenate([np.zeros((len(counts), 1), np.int64), counts.cumsum(axis=1)], axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column(0).to_numpy()
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            rows = matrix(batch.column(1))
            raw = rows.astype(kind)
            mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for curve, place in enumerate(fitted.places(rows)):
                own = np.minimum((place * total).astype(np.int64), total - 1)
                part = (mixed % parts[curve, own].astype(np.uint64)).astype(np.int32)
                for low in range(0, len(rep), 2000):
                    s = slice(low, low + 2000)
                    count = len(rep[s])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(count, curve, np.int32)), pa.array(own[s].astype(np.int32)), pa.array(part[s]),
                        pa.array(np.zeros(count, bool)), pa.array(rep[s]), _binary(raw[s])], schema=_PLACED)
                who = np.flatnonzero(asks)
                first = np.maximum(((place[who] - window) * total).astype(np.int64), 0)
                last = np.minimum(((place[who] + window) * total).astype(np.int64), total - 1)
                first, last = np.minimum(first, own[who]), np.maximum(last, own[who])
                while True:
                    few = (sums[curve, last + 1] - sums[curve, first] < least) & ((first > 0) | (last < total - 1))
                    if not few.any():
                        break
                    first[few], last[few] = np.maximum(first[few] - 1, 0), np.minimum(last[few] + 1, total - 1)
                size = last - first + 1
                who = np.repeat(who, size)
                at = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                size = parts[curve, at]
                who, where = np.repeat(who, size), np.repeat(at, size)
                part = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
                for low in range(0, len(who), 2000):
                    s = slice(low, low + 2000)
                    count = len(who[s])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(count, curve, np.int32)), pa.array(where[s].astype(np.int32)), pa.array(part[s].astype(np.int32)),
                        pa.array(np.ones(count, bool)), pa.array(rep[who[s]]), _binary(raw[who[s]])], schema=_PLACED)

    return classes.select("rep", "v", "asks").mapInArrow(run, _PLACED_DDL)


def _range_counts(classes: DataFrame, curves, ranges: int, n_curves: int) -> np.ndarray:
    """(curves, ranges): the vectors in each range; counted in the tasks."""
    def run(batches):
        counts = np.zeros((n_curves, ranges), np.int64)
        for batch in batches:
            if batch.num_rows:
                for curve, place in enumerate(curves.value.places(matrix(batch.column(0)))):
                    counts[curve] += np.bincount(np.minimum((place * ranges).astype(np.int64), ranges - 1), minlength=ranges)
        curve, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"curve": pa.array(curve, pa.int32()), "at": pa.array(at, pa.int32()), "n": pa.array(counts[curve, at])})

    out = np.zeros((n_curves, ranges), np.int64)
    for r in classes.select("v").mapInArrow(run, "curve int, at int, n bigint").groupBy("curve", "at").agg(F.sum("n").alias("n")).collect():
        out[r["curve"], r["at"]] = r["n"]
    return out


def _compared(sorted_rows: Iterator[pa.RecordBatch], kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """(asked, near, score): the k nearest of each query in each range.

    Rows come sorted by (curve, range, part), the queries of a part first. Vectors pass by
    in batches, so only the queries of one part are held.
    """
    now, asked, queries, best = None, [], [], None
    for batch in sorted_rows:
        if not batch.num_rows:
            continue
        curve, range_, part, asks, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        rows = np.frombuffer(b"".join(batch.column(5).to_pylist()), kind).reshape(len(rep), -1).astype(np.float64)
        new = np.r_[True, (curve[1:] != curve[:-1]) | (range_[1:] != range_[:-1]) | (part[1:] != part[:-1])]
        starts = np.r_[np.flatnonzero(new), len(rep)]
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
            here = (curve[low], range_[low], part[low])
            if here != now:
                if best is not None:
                    yield best.rows()
                now, asked, queries, best = here, [], [], None
            own = asks[low:high]
            if own.any():
                asked.append(rep[low:high][own])
                queries.append(rows[low:high][own])
            if not own.all() and asked:
                if best is None:
                    best = _Nearest(np.concatenate(asked), np.concatenate(queries), k)
                best.add(rep[low:high][~own], rows[low:high][~own])
    if best is not None:
        yield best.rows()


def nearest_neighbours(rows: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding",
                       recall: float = RECALL, curves: int = CURVES, seed: int = 13) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by Euclidean distance, of every row whose id `every` divides.

    A query is compared with all other rows; ties go to the smaller id. Equal vectors are one
    point of the index, so copies never crowd a window, and each stands for its k + 1 smallest
    ids. Rows without an id, or whose vector is null, empty, zero, or holds null or non-finite
    entries, take no part, nor do vectors of another length than the commonest. An id that
    occurs with several vectors counts with the smallest of them; repeated rows count once.
    Fewer than k candidates give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    usable = usable_vectors(rows, key, vector).filter("id IS NOT NULL")
    single = stored(usable.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    copies = Window.partitionBy("v").orderBy("id")
    classes = single.withColumn("_at", F.row_number().over(copies)).filter(F.col("_at") <= k + 1) \
        .groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(classes, "classes")
    queries = stored(single.filter(F.col("id") % every == 0).join(classes.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep"), "queries")
    classes_asked = classes.join(queries.select("rep").distinct().withColumn("asks", F.lit(True)), "rep", "left") \
        .select("rep", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
    points = stored(classes_asked, "points")
    total = points.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    kind = "float32" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "float64"
    share = int(min(1.0, SAMPLE / total) * (1 << 20)) + 1
    width = commonest_length(points, "v")
    sample = points.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share).select("rep", "v") \
        .limit(max(TRIED, min(SAMPLE, SAMPLE_NUMBERS // width))).collect()
    sample = np.array([r["v"] for r in sorted(sample)], np.float64) if sample else matrix(pa.array([r["v"] for r in points.limit(1).collect()]))
    fitted = spark.sparkContext.broadcast(Curves.fit(sample, curves, seed))
    window = max(_window(points, fitted, sample[:TRIED], k, recall), 4 * (k + 1) / total)
    ranges = int(max(1, min(np.ceil(2 / window), total // LEAST, RANGES)))
    counts = _range_counts(points, fitted, ranges, curves)
    placed = _placed(points, fitted, window, counts, kind, k + 1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = placed.repartitionByRange(tasks, "curve", "range", "part").sortWithinPartitions("curve", "range", "part", F.desc("asks"))
    pairs = placed.mapInArrow(lambda batches: _compared(batches, kind, k + 1), "asked bigint, near bigint, score double")
    by_score = Window.partitionBy("asked").orderBy("score", "near")
    # The same pair may come from several ranges: equal rows share their rank.
    merged = stored(pairs.withColumn("_at", F.dense_rank().over(by_score)).filter(F.col("_at") <= k + 1).drop("_at").distinct(), "merged")
    drop_stored(single)
    hits = merged.join(classes.select(F.col("rep").alias("near"), "ids"), "near").select("asked", "score", F.explode("ids").alias("vec_id")) \
        .join(queries.withColumnRenamed("rep", "asked"), "asked").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
