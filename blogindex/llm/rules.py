"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import as_bytes, rows_of, text_rows

# Rows on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000
# Signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS = b"0123456789"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def count_of(text: bytes, signs: bytes) -> int:
    return len(text) - len(text.translate(None, signs))


class Text:
    """A text with its counts, each made when it is first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.raw.translate(None, _BLANKS).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return count_of(self.raw, SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that the text has twice or more."""
        windows = list(zip(self.words, self.words[1:], self.words[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        covered = bytearray(len(self.words))
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered[i:i + 3] = b"\1\1\1"
        return sum(covered)

    @property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < 50 or 100 * self.n_repeat_words > 50 * n


# name -> true if the text is rejected. Every test is of whole numbers, so it has no
# rounding; a text without words passes all but is rejected before.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > len(t.words),
    "exclamations": lambda t: 5 * t.raw.count(b"!") > len(t.words),
    "short_words": lambda t: t.word_chars < 2 * len(t.words),
    "long_words": lambda t: t.word_chars > 15 * len(t.words),
    "capitals": lambda t: 2 * count_of(t.raw, _UPPER) > count_of(t.raw, _UPPER + _LOWER),
    "digits": lambda t: 5 * count_of(t.raw, _DIGITS) > t.word_chars,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 6 * len(t.lines),
    "few_different_words": lambda t: 20 * len(set(t.words)) < min(len(t.words), 400),
}


def estimate_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, those with most rejections per nanosecond first.

    All rules run on each text of a sample of about so many rows, chosen by a hash of the
    id, each on a fresh text; ties go to the name that sorts first.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint"), as_bytes())
    share = sample_rows / max(1, docs.select("doc_id").count())

    def run(batches):
        for _, texts in text_rows(batches):
            cost, hits = Counter(), Counter()
            for raw in texts:
                for name, rejects in RULES.items():
                    text = Text(raw)
                    begun = time.perf_counter_ns()
                    hits[name] += rejects(text)
                    cost[name] += time.perf_counter_ns() - begun
            yield pa.RecordBatch.from_pylist([{"name": n, "cost": cost[n], "hits": hits[n]} for n in RULES])

    chosen = keyed.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(share * 1e6))
    seen = chosen.mapInArrow(run, "name string, cost bigint, hits bigint").groupBy("name") \
        .agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits")).collect()
    worth = {r["name"]: r["hits"] / max(1, r["cost"]) for r in seen}
    return sorted(RULES, key=lambda n: (-worth.get(n, 0.0), n))


def verdict(text: Text, order: list[str]) -> bool:
    """Whether the text is kept; stops at the first rule that rejects it."""
    return not (text.base_failed or any(RULES[name](text) for name in order))


def kept_by_rules(docs: DataFrame, text: str = "text") -> Column:
    """A condition on the text: true if the base checks and all rules keep it."""
    order = estimate_rules(docs)

    @F.pandas_udf("boolean")
    def keeps(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in texts:
            yield pd.Series([verdict(Text(r), order) for r in raw], dtype="bool")

    return keeps(as_bytes(text))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    A null or empty text has no words, so it fails the base checks and is not kept. Rows
    are judged one by one: repeated ids and null ids keep a row each; other columns are
    ignored; an empty table gives no rows. The order of the rules has no effect on the
    verdict, only on its cost. Nothing is shuffled.
    """
    order = estimate_rules(docs)

    def run(batches):
        for ids, raws in text_rows(batches):
            texts = [Text(r) for r in raws]
            yield rows_of({
                "doc_id": ids, "n_words": [len(t.words) for t in texts], "word_chars": [t.word_chars for t in texts],
                "n_symbols": [t.n_symbols for t in texts], "n_dup_lines": [t.n_dup_lines for t in texts],
                "n_repeat_words": [t.n_repeat_words for t in texts], "base_failed": [t.base_failed for t in texts],
                "kept": [verdict(t, order) for t in texts]}, _SCHEMA)

    return docs.select(F.col("doc_id").cast("bigint"), as_bytes()).mapInArrow(
        run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean")


# kept is false where base_failed is, else by the rules above.
QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        len(ls) AS n_lines, len(list_distinct(ws)) AS n_different,
        length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper_letters,
        length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS letters,
        length(regexp_replace(text, '[^!]+', '', 'g')) AS exclamations,
        length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits FROM w),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
b AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
        n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
      FROM c LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 5 * exclamations > n_words OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 2 * upper_letters > letters OR 5 * digits > word_chars
    OR 10 * n_dup_lines > 6 * n_lines OR 20 * n_different < least(n_words, 400)) AS kept
FROM b
"""
