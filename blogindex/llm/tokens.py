"""Token ids of whole texts by a public tokenizer that lower-cases and drops white space.

Such a tokenizer gives a text the ids of its words one after another, so every distinct
word is encoded once and a text is a join of known pieces.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa

from blogindex.llm.common import coded_words

# Words and runs of a generation kept per worker. Two generations are held; when the younger
# is full, the older is dropped, so words in use stay.
CACHED_WORDS, CACHED_RUNS = 160_000, 80_000
_GROUP = 400
# A run of precomposed Latin letters, then ASCII signs that start no contraction and no
# special token: the tokenizer cuts between the two and lower-cases the first.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([-.,;:!?%&*$#|()\"/]*)")
_SIGNS = b"-.,;:!?%&*$#|()\"/"


def _visible_bytes() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit numbers.

    Words of Latin letters and signs go to the model in these two runs. The others are
    encoded as texts of many words with a special token between them. Only the six ASCII
    blanks separate words, which every such tokenizer drops.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark, self.mark_id = min(
            ((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()), key=lambda x: x[1])
        self.visible = _visible_bytes()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {b"": b""}
        self.older_runs: dict[bytes, bytes] = {}

    def _run(self, run: bytes) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self.older_runs.get(run)
            if found is None:
                shown = run.decode() if run.isascii() else run.decode("latin-1").translate(self.visible)
                found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.runs[run] = found
        return found

    def _learn(self, new: list[bytes]) -> None:
        known, rest, runs = self.known, [], self.runs
        for w in new:
            letters = w.rstrip(_SIGNS)
            if letters.isalpha():  # ASCII letters only
                run = letters.lower()
                found = runs.get(run) or self._run(run)
                if len(letters) < len(w):
                    signs = w[len(letters):]
                    found += runs.get(signs) or self._run(signs)
                known[w] = found
                continue
            text = w.decode("utf-8", "replace")
            plain = _PLAIN.fullmatch(text)
            if plain:
                known[w] = self._run(plain[1].lower().encode()) + self._run(plain[2].encode())
            elif self.mark in text:
                known[w] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                rest.append((w, text))
        groups = [rest[i:i + _GROUP] for i in range(0, len(rest), _GROUP)]
        texts = [f" {self.mark} ".join(t for _, t in g) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            raw = ids.tobytes()
            lows = [0, *((cuts + 1) * 4).tolist()]
            highs = [*(cuts * 4).tolist(), len(raw)]
            for (word, _), low, high in zip(group, lows, highs, strict=True):
                known[word] = raw[low:high]

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text; a distinct word of them is looked up once, and new ones are learned together."""
        distinct, numbers, ends = coded_words(texts, lower=False)
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        if len(self.runs) > CACHED_RUNS:
            self.runs, self.older_runs = {b"": b""}, self.runs
        known, older = self.known, self.older
        new = [w for w in distinct if w not in known]
        if new:
            known.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in older]
            if new:
                self._learn(new)
        joined = pa.array([known[w] for w in distinct], pa.large_binary()).take(pa.array(numbers))
        _, starts, data = joined.buffers()
        at = np.frombuffer(starts, np.int64)[ends].tolist() if len(numbers) else [0] * len(ends)
        raw = data.to_pybytes() if data else b""
        return [raw[low:high] for low, high in zip([0, *at], at)]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)
