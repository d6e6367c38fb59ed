"""Spelling variants: words one edit apart, found over an index of variable-length grams.

A dictionary of grams is grown from a sample of the words: a gram that occurs often is
replaced by its extensions. Every word falls into one gram per position. An edit changes
only the grams that lie over it, so a word's shortest lists, as many of them as the edit
can affect and one more, hold every word that is near it: only those lists are merged.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import drop_stored, stored, text_rows

# Shortest and longest gram; letters of a word that is sent along with its grams (a longer
# one is sent as a digest).
QMIN, QMAX, LONG = 2, 4, 64
# Words the dictionary is grown from at most; uses of a gram in 100,000 words beyond which it
# is extended; rows of a list that one task holds at once.
SAMPLE, OFTEN, LIST = 100_000, 20, 20_000
_HELD = 300_000
_PAIRS = 500_000
_START, _END = 1, 2
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
# U+00C0 to U+00FF are the byte 0xC3 and one of 0x80 to 0xBF.
_BLANKED = bytes(b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))
_NO_OTHER_LEAD = bytes(b for b in range(256) if b < 0xC2 or b == 0xC3)


def letter_runs(text: bytes | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 text; A-Z lower-cased."""
    if not text:
        return []
    text = text.lower()
    if text.translate(None, _NO_OTHER_LEAD):  # other letters, whose second bytes look alike
        return _RUN.findall(text)
    return text.translate(_BLANKED).split()


def _without(word: bytes, at: int) -> bytes:
    letters = word.decode()
    at %= len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def word_counts(docs: DataFrame, one_in: int | None = None, min_letters: int = 5, min_uses: int = 3) -> DataFrame:
    """(word, n): the letter runs of all texts that are long and frequent enough.

    With one_in, a letter is first deleted from the runs whose crc32 together with the doc_id
    (a null one is empty) is divisible by it. Counts are summed per task before the shuffle.
    """
    def run(batches):
        counts: Counter = Counter()

        def rows():
            kept = [(w, n) for w, n in counts.items() if n and len(w) >= min_letters]
            counts.clear()
            return pa.RecordBatch.from_pydict({
                "word": pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

        for ids, texts in text_rows(batches, 100):
            for doc_id, text in zip(ids, texts):
                found = letter_runs(text)
                counts.update(found)
                if one_in:
                    start = zlib.crc32(f"{doc_id or ''}:".encode())
                    hit = [w for w in set(found) if not zlib.crc32(w, start) % one_in]
                    times = Counter(found) if len(hit) > 20 else None
                    for w in hit:
                        n = times[w] if times else found.count(w)
                        counts[w] -= n
                        counts[_without(w, zlib.crc32(w, start))] += n
                if len(counts) > _HELD:
                    yield rows()
        yield rows()

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary"))
    return parts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")) \
        .filter((F.col("n") >= min_uses) & (F.char_length("word") >= min_letters))


class GramDictionary:
    """Variable-length grams: from each position the shortest that is not a frequent one.

    Which gram starts at a position depends on its own letters only, so an edit elsewhere
    leaves it as it is. A word is led by a start sign and followed by end signs.
    """

    def __init__(self, words: list[str], often: int):
        counts: dict[int, np.ndarray] = {}
        self.often = np.zeros(0, np.uint32)
        codes = {size: [] for size in range(QMIN, QMAX + 1)}
        for signs, length in _matrices([w.encode("latin-1") for w in words]):
            held = np.arange(signs.shape[1] - QMAX + 1)[None, :] <= length[:, None]
            for size in codes:
                codes[size].append(_codes(signs, size)[held])
        often_ = []
        for size, found in codes.items():
            grams, times = np.unique(np.concatenate(found or [np.zeros(0, np.uint32)]), return_counts=True)
            counts[size] = (grams, times)
            if size < QMAX:
                often_.append(grams[times > often])
        self.often = np.sort(np.concatenate(often_))
        grams = np.concatenate([g for g, _ in counts.values()])
        order = np.argsort(grams)
        self.grams, self.times = grams[order], np.concatenate([t for _, t in counts.values()])[order].astype(np.int32)
        used = np.isin(self.grams & 0xFFFFFF, self.often) | np.isin(self.grams & 0xFFFF, self.often) | (self.grams < 1 << 16)
        self.grams, self.times = self.grams[used], self.times[used]

    def grams_of(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, size) at every position of padded words."""
        gram = _codes(signs, QMIN)
        size = np.full(gram.shape, QMIN, np.int16)
        for longer in range(QMIN + 1, QMAX + 1):
            grow = (size == longer - 1) & _among(gram, self.often)
            gram = np.where(grow, _codes(signs, longer), gram)
            size[grow] = longer
        return gram, size

    def uses(self, gram: np.ndarray) -> np.ndarray:
        """How often each gram occurs in the sample."""
        if not len(self.grams):
            return np.zeros(gram.shape, np.int32)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return np.where(self.grams[at] == gram, self.times[at], 0)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(values.shape, bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _codes(signs: np.ndarray, size: int) -> np.ndarray:
    """The grams of one size at every position, as numbers; grams of other sizes have other numbers."""
    width = signs.shape[1] - QMAX + 1
    out = np.zeros((len(signs), width), np.uint32)
    for i in range(size):
        out |= signs[:, i:i + width].astype(np.uint32) << np.uint32(8 * i)
    return out


def _matrices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Padded words as rows of signs, few enough at a time, and their lengths; words are in order of length."""
    low = 0
    while low < len(words):
        high, width = low, 0
        while high < len(words) and (high == low or (high - low + 1) * max(width, len(words[high])) < 2_000_000):
            width = max(width, len(words[high]))
            high += 1
        some = words[low:high]
        signs = np.full((len(some), width + 1 + QMAX - 1), _END, np.uint8)
        signs[:, 0] = _START
        length = np.array([len(w) for w in some])
        flat = np.frombuffer(b"".join(some), np.uint8)
        row = np.repeat(np.arange(len(some)), length)
        signs[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + 1] = flat
        yield signs, length
        low = high


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _side_hashes(signs: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what stands before each position, and of what stands from it on, as 32-bit numbers."""
    rows, width = signs.shape
    before = np.zeros((rows, width + 1), np.uint64)
    after = np.zeros((rows, width + 1), np.uint64)
    for p in range(width):
        before[:, p + 1] = (before[:, p] ^ signs[:, p]) * _FACTOR + np.uint64(1)
    for p in range(width - 1, -1, -1):
        real = p <= length
        after[:, p] = np.where(real, (after[:, p + 1] ^ signs[:, p]) * _FACTOR + np.uint64(1), after[:, p + 1])
    return (before >> np.uint64(32)).astype(np.uint32), (after >> np.uint64(32)).astype(np.uint32)


def _probes(dictionary: GramDictionary, gram: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The grams by which a word looks for others: its rarest that no single edit can all affect.

    Two grams that do not overlap are such a choice: an edit lies over at most one of them.
    """
    rows, width = gram.shape
    place = np.arange(width)[None, :]
    there = place <= length[:, None]
    end = np.minimum(place + size, length[:, None] + 1)
    # At either end of a word nothing beside the gram narrows its list down.
    cost = dictionary.uses(gram).astype(np.int64) * np.where((place == 0) | (place + size > length[:, None]), 4, 1) + 1
    cost = np.where(there, cost, 1 << 40)
    best_from = np.full((rows, width + 1), 1 << 40, np.int64)
    best_at = np.zeros((rows, width + 1), np.int64)
    for p in range(width - 1, -1, -1):
        better = cost[:, p] < best_from[:, p + 1]
        best_from[:, p] = np.where(better, cost[:, p], best_from[:, p + 1])
        best_at[:, p] = np.where(better, p, best_at[:, p + 1])
    row = np.arange(rows)
    total = cost + np.take_along_axis(best_from, np.minimum(end, width), axis=1)
    first = total.argmin(axis=1)
    second = best_at[row, np.minimum(end, width)[row, first]]
    out = np.zeros((rows, width), bool)
    out[row, first] = out[row, second] = True
    return out


_POSTING = pa.schema([("gram", pa.int64()), ("cell", pa.int32()), ("side", pa.int8()), ("probe", pa.bool_()),
                      ("left", pa.int64()), ("right", pa.int64()), ("word", pa.binary()), ("letters", pa.int32()), ("n", pa.int64())])
_POSTING_DDL = "gram bigint, cell int, side tinyint, probe boolean, left bigint, right bigint, word binary, letters int, n bigint"
_LEFT, _RIGHT = 1, 2


def _postings(words: DataFrame, dictionary, hot: dict[int, int]) -> DataFrame:
    """One row per gram of each word.

    side says whether what stands to the left, to the right or either may be unchanged. A
    list of hot (gram: parts) is cut into cells by the unchanged side and the length; a probe
    goes to the cells of its own length and of one more.
    """
    hot_grams = np.array(sorted(hot), np.int64)
    hot_parts = np.array([hot[g] for g in sorted(hot)] or [0], np.int64)

    def rows_of(signs, length, names, times):
        book = dictionary.value
        gram, size = book.grams_of(signs)
        before, after = _side_hashes(signs, length)
        probe = _probes(book, gram, size, length)
        row, at = np.nonzero(np.arange(gram.shape[1])[None, :] <= length[:, None])
        g, end = gram[row, at].astype(np.int64), at + size[row, at]
        # Nothing can change to the right of an end sign, nor to the left of the start sign.
        side = np.where(end > length[row] + 1, 0, _LEFT) | np.where(at == 0, 0, _RIGHT)
        end = np.minimum(end, length[row] + 1)
        cols = [g, side, probe[row, at], before[row, at].astype(np.int64), after[row, end].astype(np.int64), row]
        keep = side > 0  # a gram that is the whole word has nothing beside it that could differ
        cols = [c[keep] for c in cols]
        g, side, probe_, left, right, row = cols
        parts = np.ones(len(g), np.int64)
        if len(hot_grams):
            place = np.minimum(np.searchsorted(hot_grams, g), len(hot_grams) - 1)
            parts = np.where(hot_grams[place] == g, hot_parts[place], 1)
        out = []
        calm = np.flatnonzero(parts == 1)
        out.append((calm, np.zeros(len(calm), np.int64), side[calm], probe_[calm]))
        busy = np.flatnonzero(parts > 1)
        for one, base, sign in ((_LEFT, left, 1), (_RIGHT, right, -1)):
            some = busy[(side[busy] & one) > 0]
            for more in (0, 1):
                if more:
                    some = some[probe_[some]]
                cell = ((base[some] * 31 + length[row[some]] + more) * 0x9E3779B1 >> 7) % parts[some]
                out.append((some, sign * (1 + cell), np.full(len(some), one), np.full(len(some), bool(more)) | (probe_[some] if not more else False)))
        pick = np.concatenate([o[0] for o in out])
        return pa.RecordBatch.from_arrays([
            pa.array(g[pick]), pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)),
            pa.array(np.concatenate([o[2] for o in out]).astype(np.int8)), pa.array(np.concatenate([o[3] for o in out]).astype(bool)),
            pa.array(left[pick]), pa.array(right[pick]), names.take(pa.array(row[pick])),
            pa.array(length[row[pick]].astype(np.int32)), pa.array(times[row[pick]])], schema=_POSTING)

    def run(batches):
        for batch in batches:
            text = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            order = sorted(range(len(text)), key=lambda i: len(text[i]))
            times = batch.column(1).to_numpy(zero_copy_only=False)[order]
            text, low = [text[i] for i in order], 0
            for signs, length in _matrices(text):
                some = text[low:low + len(length)]
                names = pa.array([w if len(w) <= LONG else _digest(w) for w in some], pa.binary())
                yield rows_of(signs, length, names, times[low:low + len(length)])
                low += len(length)

    return words.select("word", "n").mapInArrow(run, _POSTING_DDL)


def _digest(word: bytes) -> bytes:
    """What stands for a long word: a zero byte, which no word has, and a digest."""
    return b"\0" + xxhash.xxh3_128_digest(word)


def one_edit(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """Whether the rows of b are those of a with one letter replaced, or one more; zero-padded."""
    differ = a != b
    width = a.shape[1]
    replaced = (len_a == len_b) & (differ.sum(axis=1) == 1)
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shifted = np.zeros_like(b)
    shifted[:, :-1] = b[:, 1:]
    late = a != shifted
    last = np.where(late.any(axis=1), width - 1 - late[:, ::-1].argmax(axis=1), -1)
    return replaced | ((len_a + 1 == len_b) & (last < first))


def _merged(sorted_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, sure): near words of each list, a the shorter or, of equal length, the smaller.

    Rows come sorted by (gram, cell). Inside a list only words meet that agree beside the
    gram on one side and differ by at most one letter in length; the whole words decide.
    Long words are reported unchecked.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("sure", pa.bool_())])

    def keys(group, side, base, letters):
        x = group.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + base.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(29))) * _FACTOR + letters.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(side)
        return x ^ (x >> np.uint64(32))

    def lists(t: pa.Table):
        gram, cell, side, probe, left, right, letters = (
            t.column(c).to_numpy() for c in ("gram", "cell", "side", "probe", "left", "right", "letters"))
        group = np.cumsum(np.r_[True, (gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1])])
        word = t.column("word").combine_chunks()
        lengths = np.diff(np.frombuffer(word.buffers()[1], np.int32, len(word) + 1, word.offset * 4))
        whole = letters <= LONG
        width = int(letters[whole].max(initial=0)) + 1
        signs = np.zeros((len(word), width), np.uint8)
        flat = np.frombuffer(word.buffers()[2] or b"", np.uint8)
        start = np.frombuffer(word.buffers()[1], np.int32, len(word) + 1, word.offset * 4)[:-1]
        row = np.repeat(np.arange(len(word)), np.where(whole, lengths, 0))
        at = np.arange(len(row)) - np.repeat(np.cumsum(np.where(whole, lengths, 0)) - np.where(whole, lengths, 0), np.where(whole, lengths, 0))
        signs[row, at] = flat[start[row] + at]
        n = t.column("n").to_numpy()
        for one, base in ((_LEFT, left), (_RIGHT, right)):
            listed = np.flatnonzero((side & one) > 0)
            held = keys(group[listed], one, base[listed], letters[listed])
            order = np.argsort(held, kind="stable")
            held, listed = held[order], listed[order]
            asking = np.flatnonzero(((side & one) > 0) & probe)
            for more in (0, 1):
                wanted = keys(group[asking], one, base[asking], letters[asking] + more)
                low, high = np.searchsorted(held, wanted), np.searchsorted(held, wanted, side="right")
                yield from pairs(asking, listed, low, high, signs, letters, n, word)

    def pairs(asking, listed, low, high, signs, letters, n, word):
        size = high - low
        ends = np.cumsum(size)
        begin = 0
        while begin < len(asking):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
            for cut in range(0, int(size[begin]) if stop == begin + 1 else 1, _PAIRS):
                if stop == begin + 1:  # one probe whose list may be longer than a block
                    b = listed[low[begin] + cut:min(high[begin], low[begin] + cut + _PAIRS)]
                    a = np.full(len(b), asking[begin])
                else:
                    count = size[begin:stop]
                    a = np.repeat(asking[begin:stop], count)
                    b = listed[np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[begin:stop], count)]
                yield from checked(a, b, signs, letters, n, word)
            begin = stop

    def checked(a, b, signs, letters, n, word):
        apart = a != b
        a, b = a[apart], b[apart]
        long = letters[b] > LONG
        x, y = a[~long], b[~long]
        near = one_edit(signs[x], signs[y], letters[x], letters[y])
        x, y = x[near], y[near]
        differ = signs[x] != signs[y]
        at = differ.argmax(axis=1)
        row = np.arange(len(x))
        keep = (letters[x] < letters[y]) | (signs[x][row, at] < signs[y][row, at]) if len(x) else np.zeros(0, bool)
        for i, j, sure in ((x[keep], y[keep], True), (a[long], b[long], False)):
            if len(i):
                yield pa.RecordBatch.from_arrays([word.take(pa.array(i)), word.take(pa.array(j)), pa.array(n[i]), pa.array(n[j]),
                                                  pa.array(np.full(len(i), sure))], schema=schema)

    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in sorted_rows:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        if held < 100_000:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        gram, cell = t.column("gram").to_numpy(), t.column("cell").to_numpy()
        closed = np.flatnonzero((gram != gram[-1]) | (cell != cell[-1]))
        cut = int(closed[-1]) + 1 if len(closed) else 0
        if cut:
            yield from lists(t.slice(0, cut).combine_chunks())
        rest = pa.Table.from_batches(t.slice(cut).to_batches()).combine_chunks()
        kept, held = rest.to_batches(), rest.num_rows if cut else 0
    if kept:
        yield from lists(pa.Table.from_batches(kept).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n, other_n): both directions of every pair of words that one edit turns into each other.

    words is a stored table (word, n) of distinct words of at least QMAX letters up to U+00FF.
    """
    spark = words.sparkSession
    total = words.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sample = words.filter((F.char_length("word") <= LONG)
                          & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("word").limit(SAMPLE)
    chosen = sorted((r["word"] for r in sample.collect()), key=len)
    often = max(1, round(OFTEN * len(chosen) / max(total, 1))) if total > SAMPLE else OFTEN
    dictionary = spark.sparkContext.broadcast(GramDictionary(chosen, often))
    sizes = _postings(words, dictionary, {}).groupBy("gram").agg(F.count("*").alias("n"))
    hot = {r["gram"]: -(-r["n"] // LIST) for r in sizes.filter(F.col("n") > LIST).collect()}
    lists = _postings(words, dictionary, hot).repartition("gram", "cell").sortWithinPartitions("gram", "cell")
    found = stored(lists.mapInArrow(_merged, "a binary, b binary, n_a bigint, n_b bigint, sure boolean").distinct(), "near")
    latin = [F.decode(c, "ISO-8859-1").alias(c) for c in ("a", "b")]
    sure = found.filter("sure").select(*latin, "n_a", "n_b")

    @F.pandas_udf("binary")
    def digest(word: pd.Series) -> pd.Series:
        return word.map(lambda w: _digest(w.encode("latin-1")))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = (np.frombuffer(w.encode("latin-1").ljust(max(len(a), len(b)) + 1, b"\0"), np.uint8) for w, a, b in ((x, x, y), (y, x, y)))
            sizes = np.array([np.count_nonzero(x)]), np.array([np.count_nonzero(y)])
            out.append(bool(one_edit(x[None], y[None], *sizes)[0]))
        return pd.Series(out, dtype="bool")

    named = words.filter(F.char_length("word") > LONG).select(digest("word").alias("_d"), "word", "n")
    by_digest = found.filter("NOT sure").select("a", "b") \
        .join(named.withColumnsRenamed({"_d": "b", "word": "_y", "n": "n_b"}), "b") \
        .join(named.withColumnsRenamed({"_d": "a", "word": "_x", "n": "n_a"}).unionByName(
            # a word of LONG letters may be near one of LONG + 1
            words.filter(F.char_length("word") == LONG).select(F.encode("word", "ISO-8859-1").alias("a"), F.col("word").alias("_x"), F.col("n").alias("n_a"))), "a")
    longer = by_digest.filter(near("_x", "_y") & ((F.char_length("_x") < F.char_length("_y")) | (F.col("_x") < F.col("_y")))) \
        .select(F.col("_x").alias("a"), F.col("_y").alias("b"), "n_a", "n_b")
    pairs = sure.unionByName(longer)
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_a").alias("n"), F.col("n_b").alias("other_n")).unionAll(
        pairs.select("b", "a", "n_b", "n_a"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that following the forms (word, form) leads to.

    A form occurs at least twice as often as its word, so a path is no longer than the
    logarithm of the largest count, and each round doubles the steps followed.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = stored(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                         F.col("_next").isNotNull().alias("_moved")), "roots")
        moved = new.filter("_moved").limit(1).count()
        drop_stored(now)
        now = new.drop("_moved")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, one_in: int | None = None, min_letters: int = 5, min_uses: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts.

    A word's form is the near word of largest n (ties: first in code-point order) if that is
    at least twice the word's own n. root is the end of the path of forms. A null or empty
    text has no words; a null doc_id counts as an empty id; repeated rows count each time; a
    word without near words has n_near 0 and is its own root. Words may be of any length.
    Other columns are ignored; an empty table gives no rows.
    """
    if min_letters < QMAX:
        raise ValueError(f"words of fewer than {QMAX} letters may have no two grams apart from each other")
    words = stored(word_counts(docs, one_in, min_letters, min_uses), "words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("n"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("_best"))
    fits = -F.col("_best.less") >= 2 * F.col("n")
    found = stored(best.select("word", "n_near", F.when(fits, F.col("_best.form")).alias("form"),
                               F.when(fits, -F.col("_best.less")).alias("form_n")), "forms")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
