"""Document fingerprints by consistent weighted sampling.

Each sample draws, for every word of a text, r and c from gamma(2, 1) and b from [0, 1),
all from a hash of word and sample number. With weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1); the word of the least a, together with its t, is the sample.
Two texts agree in a sample with the probability of their generalised Jaccard similarity,
the sum of the smaller weights over the sum of the larger ones. Weights are word counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import as_bytes, block_starts, in_blocks, rows_of, text_rows, words

SAMPLES = 64
# Documents, and bytes of text, that are fingerprinted together.
_PORTION, _PORTION_BYTES, _ROWS = 512, 4_000_000, 4096
_EMPTY = 0xFFFF
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _two_uniforms(bits: np.ndarray) -> np.ndarray:
    """The product of two uniform numbers in (0, 1), one from each half."""
    high = (bits >> np.uint64(32)).astype(np.float64) + 0.5
    low = (bits & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5
    return high * low * 2.0 ** -64


def draws(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One unsigned number per (word, weight) and sample: ln a in the high 48 bits, the sample's name in 16.

    ln a lies within (-128, 128) for any weight below e**50. It is held in steps of
    2**-40, so the least number of a text is the sample of the least a.
    """
    number = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seed = _mix(hashes[:, None] ^ number[None, :])
    r = -np.log(_two_uniforms(_mix(seed + np.uint64(1))))
    log_c = np.log(-np.log(_two_uniforms(_mix(seed + np.uint64(2)))))
    third = _mix(seed + np.uint64(3))
    b = (third >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    t = np.floor(np.log(weights)[:, None] / r + b)
    log_a = log_c - r * (t - b + 1.0)
    name = _mix(third ^ t.astype(np.int64).astype(np.uint64)) >> np.uint64(48)
    name = np.minimum(name, np.uint64(_EMPTY - 1))
    return (np.clip((log_a + 128.0) * 2.0 ** 40, 0, 2.0 ** 48 - 1).astype(np.uint64) << np.uint64(16)) | name


def fingerprints(bags: list[Counter], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per bag of words; a bag without words has all ones."""
    pairs: dict[tuple[bytes, int], int] = {}
    terms = [[pairs.setdefault(p, len(pairs)) for p in bag.items()] for bag in bags]
    out = np.full((len(bags), samples), _EMPTY, dtype=np.uint16)
    if not pairs:
        return out
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w, _ in pairs), np.uint64, len(pairs))
    weights = np.fromiter((n for _, n in pairs), np.float64, len(pairs))
    known = np.empty((len(pairs), samples), np.uint64)
    for i in range(0, len(pairs), 4096):
        known[i:i + 4096] = draws(hashes[i:i + 4096], weights[i:i + 4096], samples)
    for i, at in enumerate(terms):
        if at:
            least = known[at[:_ROWS]].min(axis=0)
            for j in range(_ROWS, len(at), _ROWS):
                least = np.minimum(least, known[at[j:j + _ROWS]].min(axis=0))
            out[i] = least & np.uint64(0xFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: estimates the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def edited_text(text: str, after: str) -> str:
    """The text with its last half, rounded down, replaced by as many first letters of the other, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _bag(text: str) -> Counter:
    return Counter(words(text.encode()))


def _portion(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all but the last text, which only follows."""
    edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
    prints = fingerprints([_bag(t) for t in texts] + [_bag(t) for t in edited])
    own, other = prints[:len(texts)], prints[len(texts):]
    digits = [row.astype(">u2").tobytes().hex() for row in prints]
    return rows_of({
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": digits[:len(edited)], "edited_fingerprint": digits[len(texts):],
        "near_edited": likeness(own[:-1], other), "near_next": likeness(own[:-1], own[1:])}, _SCHEMA)


def _block_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Portions of (doc_id, text, block, borrowed) rows in order; each block ends with a borrowed row."""
    ids: list = []
    texts: list[str] = []
    now, first, size, done = None, "", 0, False

    def rest():
        # Only a table without any id has a block without a borrowed row: it starts over.
        if ids and not done:
            yield _portion([*ids, None], [*texts, first])

    for doc_id, raw, block, borrowed in rows:
        text = (raw or b"").decode("utf-8", "replace")
        if block != now:
            yield from rest()
            ids, texts, now, first, size, done = [], [], block, text, 0, False
        if done:
            continue
        ids.append(doc_id)
        texts.append(text)
        size += len(raw or b"")
        done = borrowed
        if len(ids) > 1 and (done or len(ids) > _PORTION or size > _PORTION_BYTES):
            yield _portion(ids, texts)
            ids, texts, size = ids[-1:], texts[-1:], len(raw or b"")
    yield from rest()


def fingerprint_documents(docs: DataFrame, block_rows: int = 4096) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one of the next larger doc_id, and the first one after the
    last. A null text is empty; a text without words has a fingerprint of only 'f' and is
    like nothing but such texts. Rows without doc_id come before all others. Repeated ids
    follow each other. Other columns are ignored; an empty table gives no rows. Texts are
    shuffled once, into blocks of consecutive ids, each of which borrows its successor's
    first row; a block is worked through in portions.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint"), as_bytes())
    blocks = in_blocks(keyed, "doc_id", block_starts(docs, "doc_id", block_rows), and_next=True)

    def run(batches):
        yield from _block_rows(row for some in text_rows(batches) for row in zip(*some))

    return blocks.mapInArrow(run, _DDL)
