"""Token ids as patched frame-of-reference blocks in segment files.

A segment holds the ids of consecutive documents:
  magic 'PFR1'; counts of documents, ids and blocks (u32, u64, u32)
  document ids (i64 each) and lengths (u32 each)
  byte offset of each block behind this index (u32 each)
  blocks of 512 ids (the last may be shorter): least id (u32), width (u8), exceptions (u16),
  the low bits of each id less the least one, then positions (u16) and high bits (u32) of
  the exceptions.
The width of a block is the one that holds a given share of its ids; larger ones are exceptions.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blogindex.llm.common import as_bytes, block_starts, in_blocks, rows_of, sums_before, text_rows
from blogindex.llm.tokens import word_encoder
from blogindex.session import new_work_dir

MAGIC, BLOCK = b"PFR1", 512
_HEAD, _BLOCK_HEAD = struct.Struct("<4sIQI"), struct.Struct("<IBH")
# A segment is closed when it holds so many ids.
SEGMENT_IDS = 1_000_000
_SEGMENT = pa.schema([("block", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                      ("data", pa.binary())])
_DOC = pa.schema([("block", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()),
                  ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each unsigned 32-bit number."""
    if not values.size or values.max() < len(_BITS):
        return _BITS[values]
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode_ids(ids: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, bytes]:
    """(byte offset of each block, the blocks)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint32), b""
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    grid = padded.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    rest = grid - least[:, None]
    need = _bits(rest)
    width = np.partition(need, int(share * (BLOCK - 1)), axis=1)[:, int(share * (BLOCK - 1))]
    over = need > width[:, None]
    over.reshape(-1)[n:] = False
    payload: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for some in np.array_split(at, -(-len(at) // 512)):
            raw, size = _pack(rest[some], w).tobytes(), BLOCK * w // 8
            for k, i in enumerate(some.tolist()):
                payload[i] = raw[k * size:(k + 1) * size]
    rows, cols = np.nonzero(over)
    high = (rest[rows, cols] >> width[rows].astype(np.uint32)).astype("<u4")
    bounds = np.searchsorted(rows, np.arange(blocks + 1))
    out, starts, at = [], np.empty(blocks, np.uint32), 0
    for i in range(blocks):
        low, top = bounds[i], bounds[i + 1]
        data = b"".join((_BLOCK_HEAD.pack(int(least[i]), int(width[i]), int(top - low)), payload[i],
                         cols[low:top].astype("<u2").tobytes(), high[low:top].tobytes()))
        starts[i] = at
        at += len(data)
        out.append(data)
    return starts, b"".join(out)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of rows of numbers, least bit first; 64 numbers take width words of 64 bits."""
    groups = values.reshape(-1, 64).T.astype(np.uint64) & np.uint64((1 << width) - 1)
    out = np.zeros((width, groups.shape[1]), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= groups[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= groups[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8", copy=False)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers from their packed words."""
    groups = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, groups.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[i] = groups[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= groups[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return out.T.reshape(-1, BLOCK)


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at the given bytes, a row of 512 each; those behind the last one are filler."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(_BLOCK_HEAD.size)]
    least = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0].astype(np.uint64)
    width, count = heads[:, 4].astype(np.int64), np.ascontiguousarray(heads[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    body = starts + _BLOCK_HEAD.size
    values = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for some in np.array_split(at, -(-len(at) // 512)) if w else ():
            packed = raw[body[some][:, None] + np.arange(BLOCK * w // 8)]
            values[some] = _unpack(packed.view("<u8"), w)
    # Exceptions: behind the low bits, all positions of a block, then all its high bits.
    row = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (body + BLOCK * width // 8)[row]
    cols = np.ascontiguousarray(raw[(place + 2 * nth)[:, None] + np.arange(2)]).view("<u2")[:, 0]
    high = np.ascontiguousarray(raw[(place + 2 * count[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    values[row, cols] += high.astype(np.uint64) << width[row].astype(np.uint64)
    return values + least[:, None]


def write_segment(doc_ids: list[int | None], raw: list[bytes]) -> bytes:
    """The bytes of a segment from each document's little-endian ids. A null id becomes the least number."""
    ids = np.frombuffer(b"".join(raw), "<u4")
    starts, blocks = encode_ids(ids)
    names = np.array([np.iinfo(np.int64).min if d is None else d for d in doc_ids], "<i8")
    lengths = np.array([len(r) // 4 for r in raw], "<u4")
    return b"".join((_HEAD.pack(MAGIC, len(raw), len(ids), len(starts)), names.tobytes(), lengths.tobytes(),
                     starts.astype("<u4").tobytes(), blocks))


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a segment."""
    magic, docs, n, blocks = _HEAD.unpack_from(data, 0)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size
    names = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    starts = np.frombuffer(data, "<u4", blocks, at + 12 * docs)
    base = at + 12 * docs + 4 * blocks
    ids = decode_blocks(data, base + starts.astype(np.int64)).reshape(-1) if blocks else np.zeros(0, np.uint64)
    return names, lengths, ids[:n].astype("<u4")


def write_tokens(docs: DataFrame, root: str, path: str, end_id: int = 1, block_rows: int = 4096) -> None:
    """Encode each document, append the end id, and write segments in ascending doc_id order.

    Blocks of documents are cut by doc_id before the texts move, so each text is shuffled
    once and encoded once. The segments are rows of a Parquet table: any store that Spark
    writes can hold them, and a repeated task leaves no second copy.
    """
    starts = block_starts(docs, "doc_id", block_rows)
    blocks = in_blocks(docs.select(F.col("doc_id").cast("bigint"), as_bytes()), "doc_id", starts)

    def run(batches):
        encoder, end = word_encoder(path), np.array([end_id], "<u4").tobytes()
        now, segment, size, names, raw = None, 0, 0, [], []

        def close():
            return rows_of({"block": [now], "segment": [segment], "n_docs": [len(raw)], "n_ids": [size // 4],
                            "data": [write_segment(names, raw)]}, _SEGMENT)

        for ids, texts, numbers, _ in text_rows(batches):
            for doc_id, data, block in zip(ids, encoder.encode_all(texts), numbers):
                if raw and (block != now or size >= 4 * SEGMENT_IDS):
                    yield close()
                    segment, size, names, raw = (segment + 1 if block == now else 0), 0, [], []
                now = block
                names.append(doc_id)
                raw.append(data + end)
                size += len(data) + len(end)
        if raw:
            yield close()

    blocks.mapInArrow(run, "block int, segment int, n_docs bigint, n_ids bigint, data binary") \
        .write.parquet(root)


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the segments under root."""
    segments = spark.read.schema("block int, segment int, n_docs bigint, n_ids bigint, data binary").parquet(root)
    before = sums_before(segments.select("block", "segment", "n_ids"), ["block", "segment"], "n_ids", "_before")

    def run(batches):
        for batch in batches:
            for block, segment, data in zip(*(c.to_pylist() for c in batch.columns)):
                names, lengths, ids = read_segment(data)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield rows_of({
                    "block": np.full(len(names), block), "segment": np.full(len(names), segment),
                    "doc_id": pa.array(names, mask=names == np.iinfo(np.int64).min), "inside": ends - lengths,
                    "n_tokens": lengths, "ids_crc32": crc}, _DOC)

    found = segments.select("block", "segment", "data").mapInArrow(
        run, "block int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(before.select("block", "segment", "_before"), ["block", "segment"]).select(
        "doc_id", (F.col("_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the documents' token files to the shared work folder and read them back.

    A null text is empty: one end id. A null doc_id sorts first. Repeated ids keep a row
    each. Other columns are ignored; an empty table gives no rows.
    """
    root = new_work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, root, path, end_id)
    return read_tokens(docs.sparkSession, root)
