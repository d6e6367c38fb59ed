"""Packing documents into training windows by best-fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import as_bytes, rows_of, stored, text_rows
from blogindex.llm.tokens import word_encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECE_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_documents(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of each document and its rest."""
    def run(batches):
        encoder, end = word_encoder(path), np.array([end_id], "<u4").tobytes()
        for ids, texts in text_rows(batches):
            out: list[tuple] = []
            for doc_id, raw in zip(ids, encoder.encode_all(texts)):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, window):
                    piece = raw[4 * start:4 * (start + window)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            yield rows_of(dict(zip(PIECE.names, zip(*out))) if out else dict.fromkeys(PIECE.names, []), PIECE)

    return docs.select(F.col("doc_id").cast("bigint"), as_bytes()).mapInArrow(run, _PIECE_DDL)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the tightest one that fits.

    A leaf stands for one remaining capacity and counts its windows; an inner node holds
    the count of its leaves, so the search for the first non-empty leaf from a capacity on
    takes steps as the logarithm of the window size.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) taken out, of the least capacity that holds the need."""
        node, count = need + self.size, self.count
        while not count[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece; pieces of 1 to window tokens."""
    open_, numbers, offsets = OpenWindows(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_.tightest(need)
        if found is None:
            capacity, number = window, used
            used += 1
        else:
            capacity, number = found
        numbers[i], offsets[i] = number, window - capacity
        if capacity > need:
            open_.push(capacity - need, number)
    return numbers, offsets


def pack(pieces: DataFrame, window: int, part_rows: int = 8192) -> DataFrame:
    """The pieces with sequence_id and offset.

    Pieces are dealt by hash into parts of about part_rows, and each part is packed by
    itself; a part leaves a few windows open at its end, so the padding does not depend on
    the size of the corpus. Only numbers are shuffled. Sequence ids are unique.
    """
    parts = max(1, -(-pieces.count() // part_rows))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        number, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"] = number * parts + rows["_part"].to_numpy()
        rows["offset"] = offset
        return rows.drop(columns="_part")

    return dealt.groupBy("_part").applyInPandas(run, f"{_PIECE_DDL}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Input: (doc_id, text, ...); other columns are ignored. A null text is empty and gives
    the end id alone; a null doc_id is kept as null. Repeated rows are packed each for
    itself. A text of any length becomes full windows and a rest. An empty table gives
    no rows.
    """
    return pack(stored(cut_documents(docs, path, window, end_id), "pieces"), window)
