"""SentencePiece merge-type encoding by backtracking, and decoding.

Merging picks, again and again, the adjacent pair whose concatenation is the best-scored
piece. Its result is the one sequence of pieces in which each two neighbours, joined and
merged again, come out as the same two pieces. So an encoder may walk forward over the
longest matches, test each new piece against the one before it, and step back where none
fits.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import as_bytes, rows_of, text_rows

SPACE = "▁"
# Entries per worker of each memory; all are dropped when there are more, which costs time only.
CACHED_CHUNKS, CACHED_PAIRS = 600_000, 2_000_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


class PieceModel:
    """Pieces of a model file, with the automaton of those that merging can make."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.unknown = model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.letters = set().union(*self.ids) if self.ids else set()
        self.decoded = self._decoded(plain, size)
        # A blank only begins a piece, so no merge crosses from a letter to a blank.
        self.splits_at_blanks = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _decoded(self, plain: list[int], size: int) -> list[bytes]:
        out = [b""] * size
        for i in plain:
            out[i] = self.pieces[i].replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            out[i] = bytes([byte])
        return out

    def merge(self, text: str) -> list[str]:
        """Pieces by merging: the best-scored adjacent pair first, of equal ones the leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, joined and merged again, are the same two."""
        key = left << 20 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > CACHED_PAIRS:
                self.fits.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.fits[key] = self.merge(a + b) == [a, b]
        return found

    def _run(self, text: str) -> list[int]:
        """Ids of a run of known letters."""
        n = len(text)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.automaton.iter(text):
            matches[end - length + 1].append((length, i))
        for found in matches:
            found.reverse()  # the automaton gives a start's matches from short to long
        failed = 0  # bit p: no encoding of the rest from p on fits what can stand before it
        out: list[int] = []
        tries: list[int] = []  # which of its start's matches each piece is
        starts: list[int] = []
        at, rank = 0, 0
        while at < n:
            options = matches[at]
            while rank < len(options):
                length, i = options[rank]
                if not failed >> (at + length) & 1 and (not out or self.compatible(out[-1], i)):
                    break
                rank += 1
            if rank < len(options):
                out.append(i)
                tries.append(rank)
                starts.append(at)
                at, rank = at + length, 0
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                out.pop()
                at, rank = starts.pop(), tries.pop() + 1
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of text in which blanks are written as the space sign; unknown letters become bytes."""
        out: list[int] = []
        run = 0
        for i, letter in enumerate(chunk):
            if letter not in self.letters:
                if run < i:
                    out += self._run(chunk[run:i])
                out += [self.byte_ids.get(b, self.unknown) for b in letter.encode()]
                run = i + 1
        return out + self._run(chunk[run:]) if run < len(chunk) else out


class PieceCodec:
    """Encodes and decodes whole texts, remembering chunks between blanks and line ends."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        if not self.model.splits_at_blanks:
            raise ValueError("a piece holds a blank behind a letter: texts of this model have no safe cuts")
        # A sign that no piece holds is encoded by itself, so a text may be cut around it.
        line = b"\n|" if "\n" not in self.model.letters else b""
        self.cut = re.compile(line + b" *[^ \n]+| +" if line else b" *[^ ]+| +").findall
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}

    def chunk_ids(self, chunk: bytes) -> bytes:
        found = self.ids.get(chunk)
        if found is None:
            if len(self.ids) > CACHED_CHUNKS:
                self.ids.clear()
            text = chunk.decode("utf-8", "replace").replace(" ", SPACE)
            found = self.ids[chunk] = b",".join([b"%d" % i for i in self.model.encode_chunk(text)])
        return found

    def encode(self, text: bytes | None) -> list[bytes]:
        """The ids of each chunk, in decimals with commas."""
        if not text:
            return []
        ids = self.ids
        chunks = self.cut(b" " + text.replace(SPACE.encode(), b" "))
        try:
            return [ids[c] for c in chunks]
        except KeyError:
            return [self.chunk_ids(c) for c in chunks]

    def _text_of(self, ids: bytes) -> bytes:
        if len(self.texts) > CACHED_CHUNKS:
            self.texts.clear()
        found = self.texts[ids] = b"".join([self.model.decoded[int(i)] for i in ids.split(b",")])
        return found

    def decode(self, chunks: list[bytes]) -> bytes:
        """The text of the ids; the blank that encoding puts before a text is dropped."""
        texts = self.texts
        try:
            whole = b"".join([texts[c] for c in chunks])
        except KeyError:
            whole = b"".join([texts[c] if c in texts else self._text_of(c) for c in chunks])
        return whole[1:] if whole[:1] == b" " else whole


@functools.lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    """One per Python worker."""
    return PieceCodec(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded again.

    A null text is empty and has no ids. Every row keeps a row of its own, repeated ids and
    a null doc_id too; other columns are ignored; an empty table gives no rows. Nothing is
    shuffled, and the memory of a task does not depend on its rows.
    """
    def run(batches):
        codec = piece_codec(path)
        for names, texts in text_rows(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in texts:
                chunks = codec.encode(text)
                ids = b",".join(chunks)
                counts.append(ids.count(b",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(chunks)).hexdigest())
            yield rows_of({"doc_id": names, "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}, _SCHEMA)

    return docs.select(F.col("doc_id").cast("bigint"), as_bytes()).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
