"""The queries beside each page, and the covers of their words there, over Arrow batches of pages.

A page comes as one row with its lists of positions, each position a long number of place and
weight. All queries are worked on together for many pages at once, so that a pair of query and
page is a few numbers until its rank is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Cells of the table that tells which lexemes a page holds; rows, pages and occurrences that are worked on at once.
CELLS, ROWS, PAGES, OCCURRENCES = 4_000_000, 50_000, 1000, 100_000


@dataclass(frozen=True)
class Queries:
    """Queries by number: ends of their terms, the terms in order of slot, and their rarest and second rarest term.

    A query of one term is its own second. by_rarest are the query numbers in order of the rarest term, and ends_rarest
    where those of each term end.
    """
    ends: np.ndarray
    terms: np.ndarray
    rarest: np.ndarray
    second: np.ndarray
    by_rarest: np.ndarray
    ends_rarest: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, terms: np.ndarray, order: np.ndarray, lexemes: int) -> Queries:
        """sizes of the queries, their terms, and the place of each by rarity, from 1 on."""
        number = np.repeat(np.arange(len(sizes)), sizes)
        rarest, second = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for at, out in ((1, rarest), (2, second)):
            out[number[order == at]] = terms[order == at]
        second = np.where(sizes == 1, rarest, second)
        return Queries(np.cumsum(sizes), terms, rarest, second, np.argsort(rarest, kind="stable"),
                       np.cumsum(np.bincount(rarest, minlength=lexemes)))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _whole_pages(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of equal keys, which come one after another, in one batch, together with those of other keys."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            whole = pa.concat_batches(kept)
            same = pc.equal(whole.column(key), whole.column(key)[rows - 1])
            cut = rows - int(pc.sum(same).as_py())
            if cut:
                yield whole.slice(0, cut)
            kept, rows = [whole.slice(cut)], rows - cut
    if rows:
        yield pa.concat_batches(kept)


def matched(batches: Iterator[pa.RecordBatch], key: str, queries: Queries, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pages with the queries they hold.

    Rows in order of (key, _no): a page, with _no -1, and its postings with the number of their lexeme and positions.
    _lists are the positions of each distinct lexeme; for each query held, _found, _n and _times are its number, its number of
    terms and how often its hits count, and _at says for each of its terms which list is its, or -1. A lexeme that a page
    holds several times, as pages of one key do, counts its rarest one as often; so does a page that comes several times.
    """
    lexemes = len(queries.ends_rarest)
    starts = queries.ends_rarest - np.bincount(queries.rarest, minlength=lexemes)
    sizes = np.diff(queries.ends, prepend=0)
    step = max(1, min(PAGES, CELLS // max(1, lexemes)))
    for whole in _whole_pages(batches, key):
        ids, number = whole.column(key).dictionary_encode().indices, _numbers(whole.column("_no")).astype(np.int64)
        run = np.cumsum(np.diff(ids.to_numpy(), prepend=-1) != 0) - 1
        # Pages without a row of their own, or without a posting, match nothing.
        rows = np.bincount(run[number < 0], minlength=run[-1] + 1)
        pages = np.flatnonzero((rows > 0) & (np.bincount(run[number >= 0], minlength=len(rows)) > 0))
        begin = np.searchsorted(run, pages)
        for low in range(0, len(pages), step):
            some = pages[low:low + step]
            count = len(some)
            at = _spans(begin[low:low + step] + rows[some], np.searchsorted(run, some, "right") - begin[low:low + step] - rows[some])
            positions = whole.column("positions").take(pa.array(at))
            # One list per page and lexeme.
            cell = np.searchsorted(some, run[at]) * lexemes + number[at]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            copies, cell = np.diff(np.r_[first, len(cell)]), cell[first]
            lengths = np.r_[0, np.cumsum(_numbers(positions.value_lengths()))][np.r_[first, len(at)]]
            page, lexeme = cell // lexemes, cell % lexemes
            per_page = np.bincount(page, minlength=count)
            table = np.full(count * lexemes, -1, np.int32)
            table[cell] = np.arange(len(cell)) - (np.cumsum(per_page) - per_page)[page]
            # Candidates: the queries whose rarest lexeme the page holds, and the second rarest.
            many = (queries.ends_rarest - starts)[lexeme]
            query = queries.by_rarest[_spans(starts[lexeme], many)]
            on, times = np.repeat(page, many), np.repeat(copies, many)
            likely = np.flatnonzero((times > 1) | (table[on * lexemes + queries.second[query]] >= 0))
            query, on, times = query[likely], on[likely], times[likely]
            n = sizes[query]
            places = table[np.repeat(on * lexemes, n) + queries.terms[_spans(queries.ends[query] - n, n)]]
            others = np.bincount(np.repeat(np.arange(len(n)), n), places >= 0, len(n)).astype(np.int64) - 1
            good = (n == 1) | (times * others == n - 1)
            places, query, on, times, n = places[np.repeat(good, n)], query[good], on[good], times[good], n[good]
            found = np.bincount(on, minlength=count)
            times = np.where(n == 1, times, 1) * rows[some][on]
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), positions.flatten())
            own = whole.take(pa.array(begin[low:low + step]))
            given = {c: own.column(c) for c in own.schema.names} | {
                "_lists": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_page)], pa.int32()), lists),
                "_found": _lists(query.astype(np.int32), found), "_n": _lists(n.astype(np.int32), found),
                "_times": _lists(times.astype(np.int32), found),
                "_at": _lists(places, np.bincount(on, n, count).astype(np.int64))}
            yield pa.RecordBatch.from_arrays([given[f.name].cast(f.type) for f in schema], schema=schema)


def _covers(pair: np.ndarray, pos: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, first): occurrences that end a span with all n slots of their pair, and the one where it begins."""
    if n == 2:
        end = np.flatnonzero((slot[1:] != slot[:-1]) & (pair[1:] == pair[:-1])) + 1
        return end, end - 1
    at = np.arange(len(pair))
    begin = np.maximum.accumulate(np.where(np.r_[True, pair[1:] != pair[:-1]], at, 0))
    first = at.copy()
    for s in range(n):
        np.minimum(first, np.maximum.accumulate(np.where(slot == s, at, -1)), out=first)
    end = np.flatnonzero(first >= begin)
    return end, first[end]


def _sorted(pair: np.ndarray, packed: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, place, slot, weight) in this order; a packed position is its place, then three bits of weight."""
    place, weight = packed >> 3, packed & 7
    bits = [int(x.max()).bit_length() for x in (pair, place, slot)]
    if sum(bits) + 3 > 63 or packed.min() < 0:
        order = np.lexsort((weight, slot, place, pair))
        return pair[order], place[order], slot[order], weight[order]
    key = np.sort((((pair << bits[1]) | place) << (bits[2] + 3)) | (slot << 3) | weight)
    return (key >> sum(bits[1:]) + 3, (key >> (bits[2] + 3)) & ((1 << bits[1]) - 1),
            (key >> 3) & ((1 << bits[2]) - 1), key & 7)


def cover_ranks(lists: pa.ListArray, at: np.ndarray, n: np.ndarray, times: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The rank of each pair: of n[i] terms, whose lists at names, -1 for none, each taken times[i] times.

    cost is twice the reciprocal of a weight, by its number. A cover is the span from the earliest of the last places of
    all terms, and a new one if it begins behind the one before.
    """
    lengths, flat = _numbers(lists.value_lengths()).astype(np.int64), _numbers(lists.flatten())
    starts = np.cumsum(lengths) - lengths
    ends, out = np.cumsum(n), np.zeros(len(n))
    held = np.where(at >= 0, lengths[at] if len(lengths) else 0, 0)
    of_pair = np.repeat(np.arange(len(n)), n)
    occurrences = np.bincount(of_pair, held, len(n)).astype(np.int64) * times
    by_size = np.argsort(n, kind="stable")
    done, in_order = np.cumsum(occurrences[by_size]), n[by_size]
    low = 0
    while low < len(n):
        # Pairs of one size, of about so many occurrences.
        size = in_order[low]
        high = max(low + 1, min(int(np.searchsorted(in_order, size, "right")),
                                int(np.searchsorted(done, (done[low - 1] if low else 0) + OCCURRENCES, "right"))))
        some, low = by_size[low:high], high
        terms = _spans(ends[some] - size, np.full(len(some), size))
        again = np.repeat(times[some], size)
        terms, slot = np.repeat(terms, again), np.repeat(np.tile(np.arange(size), len(some)), again)
        pair, many = np.repeat(np.repeat(np.arange(len(some)), size), again), held[terms]
        packed = flat[_spans(np.where(many > 0, starts[at[terms]], 0), many)]
        pair = np.repeat(pair, many)
        if not len(pair):
            continue
        if size == 1:
            out[some] = np.bincount(pair, 2.0 / cost[packed & 7], len(some))
            continue
        pair, pos, slot, weight = _sorted(pair, packed, np.repeat(slot, many))
        end, first = _covers(pair, pos, slot, size)
        # Spans begin ever later, so those that begin at one place lie together, and the first of them counts.
        new = pos[first] > 0
        new[1:] &= (pos[first][1:] != pos[first][:-1]) | (pair[first][1:] != pair[first][:-1])
        end, first = end[new], first[new]
        spent = np.r_[0.0, np.cumsum(cost[weight])]
        k = (end - first + 1).astype(np.float64)
        noise = (pos[end] - pos[first]) - (k - 1)
        noise = np.where(noise < 0, np.floor((k - 1) / 2), noise)
        out[some] = np.bincount(pair[end], k / ((spent[end + 1] - spent[first]) / 2.0) / (1.0 + noise), len(some))
    return out


def _among_best(query: np.ndarray, rank: np.ndarray, best: int, least: np.ndarray) -> np.ndarray:
    """Places of the rows that may be among the best of their query.

    least holds for each query a rank that so many rows reach; it is raised here. Ranks that are
    equal to nine places are ties and stay.
    """
    order = np.lexsort((-rank, query))
    run = query[order]
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][:len(run)])
    full = begin[np.diff(np.r_[begin, len(run)]) >= best]
    least[run[full]] = np.maximum(least[run[full]], rank[order[full + best - 1]])
    return np.flatnonzero(~(rank < least[query] - 2e-9))


def ranked(batches: Iterator[pa.RecordBatch], costs: list[int], best: int | None, queries: int, schema: pa.Schema
           ) -> Iterator[pa.RecordBatch]:
    """A row for each query of each page, with its rank, from rows of matched().

    With best, rows that cannot be among so many best ones of their query are left out, as far as the rows of the task tell.
    """
    cost, least = np.array([np.nan, *costs]), np.full(queries, -np.inf)
    for whole in batches:
        for low in range(0, whole.num_rows, PAGES):
            batch = whole.slice(low, PAGES)
            lists = batch.column("_lists")
            n, query, times = (_numbers(batch.column(c).flatten()).astype(np.int64) for c in ("_n", "_found", "_times"))
            page = np.repeat(np.arange(batch.num_rows), _numbers(batch.column("_found").value_lengths()))
            held = _numbers(lists.value_lengths()).astype(np.int64)
            at = _numbers(batch.column("_at").flatten()).astype(np.int64)
            at = np.where(at >= 0, at + np.repeat((np.cumsum(held) - held)[page], n), -1)
            rank = cover_ranks(lists.flatten(), at, n, times, cost)
            if best is not None:
                kept = _among_best(query, rank, best, least)
                page, query, rank = page[kept], query[kept], rank[kept]
            rows = batch.select([c for c in batch.schema.names if c in schema.names]).take(pa.array(page))
            given = {c: rows.column(c) for c in rows.schema.names} | {
                "_q": pa.array(query, pa.int32()), "rank": pa.array(rank, mask=np.isnan(rank))}
            yield pa.RecordBatch.from_arrays([given[f.name].cast(f.type) for f in schema], schema=schema)
