"""Exact Jaccard join of word n-gram sets, up to connected components.

Sets of equal content are one class. Classes meet in tiles: one tile per shingle that is
among the rarest of each, and in it only sizes within the threshold. A bitmap of hashed
shingles per class bounds the overlap of a candidate from above; what passes is decided
by the exact sizes of intersection and union. Inside a tile pairs are told apart one by
one, but what leaves it is a spanning forest of what belongs together, so the rows made
never outnumber the rows of the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import as_bytes, coded_words, drop_stored, rows_of, stored, text_rows
from blogindex.llm.graph import components

# Buckets of the frequency sketch; shared shingles that a candidate needs; rows of a tile
# that one task compares with each other; uses of a shingle beyond which its rows are salted.
BUCKETS, SHARED, TILE, HOT = 1 << 20, 4, 4096, 20_000
# Bits for each shingle in the bitmaps that groups are compared by; rows of a tile that is
# worked on together with others; rows and shingles of a part of a group, by bitmaps and exactly.
WIDE, SMALL = 8, 32
PARTS = {False: (16_384, 16_000_000), True: (8192, 4_000_000)}
# Ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Likeness:
    """Sets of n-word shingles link when 100 * intersection >= percent * union."""
    n: int = 5
    percent: int = 80

    def least(self, size: Column) -> Column:
        """Shingles that a set shares with any set it links to, at least."""
        return F.ceil(size * self.percent / 100).cast("int")


class Shingler:
    """Sorted distinct 64-bit hashes of each text's shingles."""

    def __init__(self, n: int):
        self.n = n
        self.factors = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2 ** 64 | 1 for i in range(1, n + 1)], np.uint64)

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        mixed, sizes = self.all(texts)
        ends = np.cumsum(sizes)
        first = np.ones(len(mixed), bool)
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
            one = mixed[low:high]
            one.sort()
            np.not_equal(one[1:], one[:-1], out=first[low + 1:high])
        left = np.r_[0, np.cumsum(first)][np.r_[0, ends]].tolist()
        mixed = mixed[first]
        # Copies, so that a set that is kept does not keep those of all texts.
        return [mixed[low:high].copy() for low, high in zip(left[:-1], left[1:])]

    def all(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, sizes): those of every place of every text, one text after another, and how many each text has.

        The places of all texts are mixed together. A distinct word of the texts is hashed once; none is kept, so a worker
        holds the words of few texts.
        """
        distinct, numbers, ends = coded_words(texts)
        h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[numbers]
        words = np.diff(ends, prepend=0)
        sizes = np.where(words > 0, words - np.minimum(self.n, words) + 1, 0)
        # Runs that cross the end of a text are mixed as well and left out.
        every = self._mixed(h, self.n)
        if not len(every):
            every = np.zeros(1, np.uint64)
        at = np.arange(sizes.sum()) + np.repeat(ends - words - np.cumsum(sizes) + sizes, sizes)
        out = every[np.minimum(at, len(every) - 1)]
        # A text of fewer words than n is one run of them all.
        places = np.cumsum(sizes) - sizes
        for text in np.flatnonzero((words > 0) & (words < self.n)).tolist():
            out[places[text]] = self._mixed(h[ends[text] - words[text]:ends[text]], int(words[text]))[0]
        return out, sizes

    def _mixed(self, h: np.ndarray, width: int) -> np.ndarray:
        """A hash of each run of so many words."""
        rows = max(0, len(h) - width + 1)
        mixed = np.full(rows, width, np.uint64)
        for i in range(width):
            x = h[i:i + rows] * self.factors[i]
            x ^= x >> np.uint64(31)
            mixed += x
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        return mixed


def frequent_buckets(docs: DataFrame, n: int) -> np.ndarray:
    """Weight of each hash bucket: how often its shingles occur, where that is often; a text counts each of its places.

    A task reports the buckets that hold clearly more than its average. The weights only
    order shingles; any order gives the same links. The array has a fixed size.
    """
    def run(batches):
        make, counts, some, held = Shingler(n), np.zeros(BUCKETS, np.int64), [], 0
        for texts, in text_rows(batches, 100):
            some.append(make.all(texts)[0] & np.uint64(BUCKETS - 1))
            held += len(some[-1])
            if held > 1_000_000:
                counts += np.bincount(np.concatenate(some).astype(np.int64), minlength=BUCKETS)
                some, held = [], 0
        if some:
            counts += np.bincount(np.concatenate(some).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts > 1 + counts.mean() + 2.5 * np.sqrt(counts.mean()))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "times": pa.array(counts[at], pa.int64())})

    often = docs.select(as_bytes()).mapInArrow(run, "bucket int, times bigint") \
        .groupBy("bucket").agg(F.sum("times").alias("times")).toPandas()
    weight = np.zeros(BUCKETS, np.int64)
    weight[often["bucket"].to_numpy()] = often["times"].to_numpy()
    return weight


def bitmap(hashes: np.ndarray, share: int = 1, most: int = 17) -> bytes:
    """A bit per hash, in a power of two of bits, at least share for each hash and 1 << most in all."""
    bits = 1 << max(6, min(most, int(share * len(hashes) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap brought down to so many bytes, by halves laid over each other."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > size:
        out = out[:len(out) // 2] | out[len(out) // 2:]
    return out


def may_link(sizes: np.ndarray, bits: list[bytes], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """False for the pairs (a, b) of rows that the bits of only one bitmap rule out.

    Each such bit is a shingle that the other set lacks, so the intersection is at most a
    set's size less their number.
    """
    width = min(map(len, bits))
    maps = np.stack([folded(x, width) for x in bits]).view(np.uint64)
    out = np.empty(len(a), bool)
    for low in range(0, len(a), 20_000):
        i, j = a[low:low + 20_000], b[low:low + 20_000]
        x, y = maps[i], maps[j]
        most = np.minimum(sizes[i] - np.bitwise_count(x & ~y).sum(axis=1), sizes[j] - np.bitwise_count(y & ~x).sum(axis=1))
        out[low:low + 20_000] = 100 * most >= percent * (sizes[i] + sizes[j] - most)
    return out


_SET_DDL = "doc_id bigint, size int, key binary, prefix array<bigint>, salts array<int>, bits binary"
_SET = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("key", pa.binary()), ("prefix", pa.list_(pa.int64())),
                  ("salts", pa.list_(pa.int32())), ("bits", pa.binary())])


def shingle_sets(docs: DataFrame, like: Likeness, weight: np.ndarray) -> DataFrame:
    """One row per document: size, a key of the content, the rarest shingles in order, the bitmap.

    salts tells into how many parts the rows of each rare shingle are dealt, by the sketch;
    null where all are one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        make, weight = Shingler(like.n), shared.value
        for ids, texts in text_rows(batches, 100):
            sets = make(texts)
            prefixes, salts = [], []
            for s in sets:
                least = -(-len(s) * like.percent // 100)
                times = weight[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((s, times))[:len(s) - least + SHARED]
                prefixes.append(s[order].view(np.int64))
                parts = -(-times[order] // HOT)
                salts.append(np.maximum(parts, 1).astype(np.int32) if (parts > 1).any() else None)
            yield rows_of({
                "doc_id": ids, "size": [len(s) for s in sets],
                "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "prefix": prefixes, "salts": salts, "bits": [bitmap(s) if len(s) else None for s in sets]}, _SET)

    return docs.select(F.col("doc_id").cast("bigint"), as_bytes()).mapInArrow(run, _SET_DDL)


_META = pa.schema([("token", pa.int64()), ("size", pa.int32()), ("id", pa.int64()), ("low", pa.bool_()),
                   ("other", pa.int64()), ("other_size", pa.int32())])
_META_DDL = "token bigint, size int, id bigint, low boolean, other bigint, other_size int"


def _neighbours(sorted_rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of tiles with company, and for each one or two partners to try first.

    Rows come sorted by (token, salt, size, id). A row's partners are the last row before it
    in its tile that may be the smaller side, and the row of the smallest id, as copies often
    come after what they were made of. Only the rows that a later one may refer to are
    carried over to the next batch. A row of a salted tile, one of salt 0 or more, always has
    company: that of the other salts.
    """
    kept = None

    def work(token, size, id_, low, salt, ghosts, final):
        n = len(token)
        new = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
        run = np.cumsum(new)
        alone = new & np.r_[new[1:], True] & (salt < 0)
        at = np.arange(n)
        last = np.maximum.accumulate(np.where(low, at, -1))
        before = np.r_[-1, last[:-1]]
        before[(before >= 0) & (run[np.maximum(before, 0)] != run)] = -1
        by_id = np.lexsort((id_, run))
        oldest = by_id[np.flatnonzero(new)][run - 1]
        hold = np.zeros(n, bool)
        if not final:  # what the next batch may refer to, and the last row, which may have company yet
            hold[-1] = True
            for p in (last[-1], oldest[-1]):
                if 0 <= p < n and run[p] == run[-1]:
                    hold[p] = True
        emit = ~alone & ~ghosts
        if not final:
            emit[-1] = False
        held_back = np.zeros(n, bool)
        if not final:
            held_back[-1] = not ghosts[-1]
        live = np.flatnonzero(emit)
        out = [(token[live], size[live], id_[live], low[live], None, None)]
        for partner in (before, np.where((oldest == before) | (oldest == at), -1, oldest)):
            some = live[partner[live] >= 0]
            small, large = np.minimum(some, partner[some]), np.maximum(some, partner[some])
            fits = 100 * size[small].astype(np.int64) >= percent * size[large].astype(np.int64)
            small, large = small[fits], large[fits]
            out.append((token[large], size[large], id_[large], low[large], id_[small], size[small]))
        rest = np.flatnonzero(hold)
        return out, (token[rest], size[rest], id_[rest], low[rest], salt[rest], ~held_back[rest])

    def batches(out):
        for token, size, id_, low, other, other_size in out:
            if len(token):
                yield rows_of({
                    "token": token, "size": size, "id": id_, "low": low,
                    "other": pa.nulls(len(token), pa.int64()) if other is None else other,
                    "other_size": pa.nulls(len(token), pa.int32()) if other is None else other_size}, _META)

    for batch in sorted_rows:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        ghosts = np.zeros(len(columns[0]), bool)
        if kept is not None:
            columns = [np.concatenate(pair) for pair in zip(kept[:5], columns)]
            ghosts = np.concatenate([kept[5], ghosts])
        out, kept = work(*columns, ghosts, False)
        yield from batches(out)
    if kept is not None:
        yield from batches(work(*kept[:5], kept[5], True)[0])


class _Forest:
    """Sets that grow together: which of few numbered things are joined so far."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def joined(self) -> np.ndarray:
        """The set of each thing, as the number of one of its things."""
        while True:
            new = self.up[self.up]
            if (new == self.up).all():
                return new
            self.up = new

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Joins all pairs; the places of those that joined two sets."""
        once = np.unique(a * len(self.up) + b, return_index=True)[1]
        up, out = self.up.tolist(), []
        for at, x, y in zip(once.tolist(), a[once].tolist(), b[once].tolist()):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append(at)
        self.up = np.array(up)
        return out


def _in_tiles(sorted_rows: Iterator[pa.RecordBatch], key: int, work) -> Iterator[pa.RecordBatch]:
    """work(starts, columns) on whole tiles: runs of rows with equal values in the first key columns.

    starts are the places where tiles begin, and the end.
    """
    kept: list[np.ndarray] | None = None

    def runs(columns):
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:key]], axis=0)]
        yield from work(np.r_[np.flatnonzero(new), len(new)], columns[key:])

    for batch in sorted_rows:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate(pair) for pair in zip(kept, columns)]
        open_ = np.flatnonzero(np.any([c != c[-1] for c in columns[:key]], axis=0))
        cut = open_[-1] + 1 if len(open_) else 0
        if cut:
            yield from runs([c[:cut] for c in columns])
        kept = [c[cut:] for c in columns]
    if kept is not None:
        yield from runs(kept)


def _bands(size: np.ndarray, component: np.ndarray, fits, percent: int):
    """(i, j) places, in blocks, of the pairs of rows in order of size that may link by their sizes.

    Pairs of one component are left out, as are those that fits, given a block of rows,
    denies. Components that are joined meanwhile count as one: the caller sends them in.
    """
    for b0 in range(0, len(size), 128):
        b = slice(b0, min(b0 + 128, len(size)))
        start = int(np.searchsorted(size, -(-int(size[b0]) * percent // 100)))
        for a0 in range(start, b.stop, 4096):
            a = slice(a0, min(a0 + 4096, b.stop))
            joined = component()
            ok = joined[a][:, None] != joined[b][None, :]
            ok &= 100 * size[a].astype(np.int64)[:, None] >= percent * size[b].astype(np.int64)[None, :]
            ok &= np.arange(a.start, a.stop)[:, None] < np.arange(b.start, b.stop)[None, :]
            if fits is not None:
                ok &= fits(a, b)
            i, j = np.nonzero(ok)
            if len(i):
                yield i + a.start, j + b.start


def _by_bitmaps(size, bits, i, j, percent):
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    return may_link(size[used].astype(np.int64), [bits[u] for u in used], at[:len(i)], at[len(i):], percent)


def _small_tiles(starts, size, low, major, first, component, bits, percent):
    """(i, j) rows of the pairs that bitmaps cannot keep apart, of all tiles of at most SMALL rows together."""
    count = np.diff(starts)
    small = np.flatnonzero((count <= SMALL) & (count > 1))
    tile = np.repeat(np.arange(len(count)), count)
    rows = np.flatnonzero(np.isin(tile, small))
    left, right = [], []
    for d in range(1, int(count[small].max(initial=1))):
        i = rows[rows + d < len(tile)]
        j = i + d
        fits = (tile[i] == tile[j]) & (component[i] != component[j]) & low[i] & (first[i] | major[i] | major[j])
        fits &= 100 * size[i].astype(np.int64) >= percent * size[j].astype(np.int64)
        left.append(i[fits])
        right.append(j[fits])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    # The narrower bitmap of a pair decides how wide both are: pairs of one width go together.
    held = np.zeros(len(tile), np.int64)
    used = np.unique(np.concatenate([i, j]))
    held[used] = [len(bits[u]) for u in used]
    width = np.minimum(held[i], held[j])
    may = np.zeros(len(i), bool)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        may[some] = _by_bitmaps(size, bits, i[some], j[some], percent)
    return tile, i[may], j[may]


def _maybe(sorted_rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): components that the bitmaps of a tile cannot keep apart, as a forest.

    Rows: token, part, size, id, low, major, first, component, bits, sorted by (token, part,
    size, id). The rows of the tile's main component lie in one part each, the others in
    all; pairs of the others count in the first part only.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def large(size, low, major, first, component, bits):
        names, number = np.unique(component, return_inverse=True)
        forest = _Forest(len(names))

        def fits(a, b):
            ok = np.broadcast_to(low[a][:, None], (a.stop - a.start, b.stop - b.start))
            return ok if first[0] else ok & (major[a][:, None] | major[b][None, :])

        for i, j in _bands(size, lambda: forest.joined()[number], fits, percent):
            may = _by_bitmaps(size, bits, i, j, percent)
            a, b = number[i[may]], number[j[may]]
            for k in forest.join(a, b):
                yield names[a[k]], names[b[k]]

    def work(starts, columns):
        size, _, low, major, first, component, bits = columns
        tile, i, j = _small_tiles(starts, size, low, major, first, component, bits, percent)
        # One forest for all: a component is another thing in every tile.
        things = np.stack([np.concatenate([tile[i], tile[j]]), np.concatenate([component[i], component[j]])], axis=1)
        number = np.unique(things, axis=0, return_inverse=True)[1].reshape(-1) if len(i) else np.zeros(0, np.int64)
        kept = _Forest(int(number.max(initial=-1)) + 1).join(number[:len(i)], number[len(i):]) if len(i) else []
        out = [(component[i[k]], component[j[k]]) for k in kept]
        for t in np.flatnonzero(np.diff(starts) > SMALL).tolist():
            s, e = starts[t], starts[t + 1]
            if (component[s:e] != component[s]).any():
                out.extend(large(*(c[s:e] for c in (size, low, major, first, component, bits))))
        if out:
            yield rows_of({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema)

    yield from _in_tiles(sorted_rows, 2, work)


def overlap(hashes: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the pairs (i, j) of sets link, by the exact sizes of intersection and union."""
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]]), len(i)]
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        one = np.frombuffer(hashes[i[order[s]]], np.uint64)
        for low in range(s, e, 512):
            some = order[low:min(low + 512, e)]
            others = [np.frombuffer(hashes[k], np.uint64) for k in j[some]]
            sizes = np.array([len(x) for x in others])
            flat = np.concatenate(others)
            held = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            both = np.add.reduceat(held, np.cumsum(sizes) - sizes, dtype=np.int64)
            out[some] = 100 * both >= percent * (len(one) + sizes - both)
    return out


def _decided(sorted_rows: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): links between components, as a forest of each group.

    Rows: group, cell, part, size, id, component, bits[, hashes], sorted by (group, cell,
    size, id). A cell holds at most two parts of a large group, and pairs come from different
    ones. If not exact, pairs that the bitmaps allow count as links, and a and b are the
    components themselves.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tile(part, size, id_, component, bits, hashes=None):
        names, number = np.unique(component, return_inverse=True)
        if len(names) == 1:
            return
        across = (part != part[0]).any()
        forest, out = _Forest(len(names)), []

        def fits(a, b):
            return part[a][:, None] != part[b][None, :]

        for i, j in _bands(size, lambda: forest.joined()[number], fits if across else None, percent):
            # Pairs of sets that an earlier one of the block has joined need no look.
            for low in range(0, len(i), 20_000):
                a, b = i[low:low + 20_000], j[low:low + 20_000]
                joined = forest.joined()[number]
                apart = joined[a] != joined[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                may = _by_bitmaps(size, bits, a, b, percent)
                a, b = a[may], b[may]
                if exact and len(a):
                    linked = overlap(hashes, a, b, percent)
                    a, b = a[linked], b[linked]
                ends = (id_[a], id_[b]) if exact else (component[a], component[b])
                out += [(ends[0][k], ends[1][k]) for k in forest.join(number[a], number[b])]
        if out:
            yield rows_of({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema)

    def work(starts, columns):
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield from tile(*(c[s:e] for c in columns))

    yield from _in_tiles(sorted_rows, 2, work)


def _enough(pairs: DataFrame, like: Likeness) -> DataFrame:
    """(a, b, size_a, size_b) of the pairs found in enough tiles.

    Linked sets share SHARED of their rarest shingles, or all they must share if that is less.
    """
    must = F.ceil((F.col("size_a") + F.col("size_b")) * like.percent / (100 + like.percent))
    return pairs.groupBy("a", "b").agg(
        F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.count("*").alias("_n")) \
        .filter(F.col("_n") >= F.least(F.lit(SHARED), must)).drop("_n")


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the stored ids (id), which are broadcast if they are few enough."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, df[key] == ids["id"], "left_semi")


def set_hashes(ids: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """(id, bits, hashes) of the documents with the stored ids: the sorted shingle hashes, and WIDE bits for each."""
    def hashes(batches):
        make = Shingler(like.n)
        for ids, texts in text_rows(batches, 100):
            sets = make(texts)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "bits": pa.array([bitmap(s, WIDE, 20) for s in sets], pa.binary()),
                "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})

    texts = with_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes()), ids, "doc_id")
    return texts.mapInArrow(hashes, "id bigint, bits binary, hashes binary")


def _once(rows: DataFrame) -> DataFrame:
    """One row per id: repeated rows of an id have the same text."""
    return rows.groupBy("id").agg(*[F.first(c).alias(c) for c in rows.columns if c != "id"])


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """(a, b) of the pairs that link: by the bitmaps of sets, then by exact overlap."""
    @F.pandas_udf("boolean")
    def by_bits(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
        first, second = np.array([0]), np.array([1])
        return pd.Series([may_link(np.array(x[:2]), list(x[2:]), first, second, like.percent)[0]
                          for x in zip(size_a, size_b, a, b)], dtype="bool")

    @F.pandas_udf("boolean")
    def by_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        first, second = np.array([0]), np.array([1])
        return pd.Series([overlap([x, y], first, second, like.percent)[0] for x, y in zip(a, b)], dtype="bool")

    maps = sets.select("id", "bits")
    pairs = pairs.join(maps.withColumnsRenamed({"id": "a", "bits": "bits_a"}), "a") \
        .join(maps.withColumnsRenamed({"id": "b", "bits": "bits_b"}), "b") \
        .filter(by_bits("bits_a", "bits_b", "size_a", "size_b"))
    near = stored(pairs.select("a", "b"), "candidates")
    ids = stored(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    whole = stored(_once(set_hashes(ids, docs, like).drop("bits")), "hashes")
    found = near.join(whole.withColumnsRenamed({"id": "a", "hashes": "_a"}), "a") \
        .join(whole.withColumnsRenamed({"id": "b", "hashes": "_b"}), "b").filter(by_overlap("_a", "_b")).select("a", "b")
    found = stored(found, "linked")
    drop_stored(near, ids, whole)
    return found


def _cells(parts: Column, part: Column) -> Column:
    """The cells of a row: one per pair of its part with any part."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda j: (
        F.least(part, j) * parts + F.greatest(part, j)).cast("int"))


def crossing_links(live: DataFrame, known: DataFrame, classes: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): links that connect the components of live (token, size, id, low, component) as all links do.

    Tiles first tell which components their bitmaps cannot keep apart. What hangs together
    by that is a group; wider bitmaps cut it down, and the sets of what is left, mostly few,
    are compared exactly. Of a large
    tile the rows of the main component are dealt out, and the others go to every part.
    """
    p = like.percent
    mixed = live.groupBy("token").agg(F.count("*").alias("_n"), F.min("component").alias("_c"), F.max("component").alias("_d")) \
        .filter("_c <> _d").select("token", F.ceil(F.col("_n") / TILE).cast("int").alias("_parts"))
    mixed = stored(mixed, "mixed")
    main = live.join(mixed.filter("_parts > 1"), "token", "left_semi").groupBy("token", "component").agg(F.count("*").alias("_k")) \
        .groupBy("token").agg(F.max_by("component", "_k").alias("_main"))
    major = F.coalesce(F.col("component") == F.col("_main"), F.lit(False))
    own = F.pmod(F.xxhash64("id"), "_parts").cast("int")
    rows = live.join(mixed, "token").join(main, "token", "left").withColumn("major", major).withColumn("part", F.explode(
        F.when(F.col("major"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1)))) \
        .join(classes.select("id", "bits"), "id") \
        .select("token", "part", "size", "id", "low", "major", (F.col("part") == 0).alias("first"), "component", "bits")
    maybe = rows.repartition("token", "part").sortWithinPartitions("token", "part", "size", "id").mapInArrow(
        lambda batches: _maybe(batches, p), "a bigint, b bigint")
    maybe = stored(maybe.distinct(), "maybe")
    parted = classes.select("id", "size").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Wider bitmaps first: far fewer sets have to be compared exactly.
    near = stored(_within_groups(maybe, parted, docs, like, exact=False).distinct(), "near")
    found = stored(_within_groups(near, parted, docs, like, exact=True), "crossing")
    drop_stored(mixed, maybe, near)
    return found


def _within_groups(maybe: DataFrame, parted: DataFrame, docs: DataFrame, like: Likeness, exact: bool) -> DataFrame:
    """Links between the components of each group, that is of what the pairs of components in maybe hang together.

    parted names the component of every class (id, size, component).
    """
    groups = components(maybe).select(F.col("component").alias("group"), F.col("id").alias("component"))
    members = stored(parted.join(groups, "component").select("group", "id", "size", "component"), "members")
    ids = stored(members.select("id").distinct(), "ids")
    sets = _once(set_hashes(ids, docs, like).select("id", "bits", *(["hashes"] if exact else [])))
    rows_, shingles = PARTS[exact]
    sizes = members.groupBy("group").agg(F.ceil(F.greatest(
        F.count("*") / rows_, F.sum(F.col("size").cast("bigint")) / shingles)).cast("int").alias("_parts"))
    rows = members.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("id"), "_parts").cast("int")) \
        .withColumn("cell", F.explode(_cells(F.col("_parts"), F.col("part")))).drop("_parts") \
        .join(sets, "id").select("group", "cell", "part", "size", "id", "component", *sets.columns[1:])
    percent = like.percent
    return rows.repartition("group", "cell").sortWithinPartitions("group", "cell", "size", "id").mapInArrow(
        lambda batches: _decided(batches, percent, exact), "a bigint, b bigint")


def link_classes(classes: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): links that connect the classes (id, size, prefix, bits) as all links do.

    Two passes over the tiles. The first tries one or two partners per row, which joins
    most of what belongs together; there the rows of a hot token are dealt out by salt, as
    it need not find every link. The second compares the rows of a tile that are not in one
    component yet, so a large group of near copies is never compared pair by pair, and no
    link between two components is missed.
    """
    p, q = like.percent, 100 + like.percent
    # A set's lowest shingles, enough to meet any set of at least its own size.
    low = F.col("size") - F.ceil(2 * p * F.col("size") / q) + SHARED
    parts = F.get("salts", F.col("_at"))
    rows = classes.select("id", "size", "salts", low.alias("_low"), F.posexplode_outer("prefix").alias("_at", "token")) \
        .filter("token IS NOT NULL").select(
            "token", "size", "id", (F.col("_at") < F.col("_low")).alias("low"),
            F.when(parts > 1, F.pmod(F.xxhash64("id", "token"), parts)).otherwise(-1).cast("int").alias("salt"))
    tiles = stored(rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "id").mapInArrow(
        lambda batches: _neighbours(batches, p), _META_DDL), "tiles")
    tried = tiles.filter("other IS NOT NULL").select(
        F.col("other").alias("a"), F.col("id").alias("b"), F.col("other_size").alias("size_a"), F.col("size").alias("size_b"))
    first = linked(_enough(tried, like), classes, docs, like)
    known = stored(components(first), "components")
    live = tiles.filter("other IS NULL").join(known, "id", "left").select(
        "token", "size", "id", "low", F.coalesce("component", "id").alias("component"))
    live = stored(live, "live")
    drop_stored(tiles)
    second = crossing_links(live, known, classes, docs, like)
    drop_stored(live, known)
    return first.unionAll(second)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are lower-cased (A to Z). A document's set is its distinct n-word shingles; with
    fewer words, the whole sequence. component_id is the smallest doc_id reachable by
    links, its own included. A text without words (or null) has an empty set and is linked
    with nothing. Rows of equal text and id keep a row each. A null doc_id is linked with
    nothing and has no component. Other columns are ignored; an empty table gives no rows.
    """
    like = Likeness(n, percent)
    given = docs.select("doc_id", "text")
    usable = given.filter("doc_id IS NOT NULL")
    sets = stored(shingle_sets(given, like, frequent_buckets(usable, n)), "sets")
    classes = stored(sets.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("prefix").alias("prefix"),
        F.first("salts").alias("salts"), F.first("bits").alias("bits")), "classes")
    found = components(link_classes(classes.drop("key"), usable, like))
    named = classes.select("key", "id").join(found, "id", "left").select(
        "key", F.coalesce("component", "id").alias("component_id"))
    members = sets.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"), "size")
    return members.join(named, "key", "left").select(
        "doc_id", F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def component_sql(n: int, percent: int) -> str:
    """The same for DuckDB, by a join on shared shingles."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b
      WHERE 100 * i >= {percent} * (x.n + y.n - i)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(r.m) AS component_id
FROM r LEFT JOIN c USING (doc_id) GROUP BY r.doc_id
"""
