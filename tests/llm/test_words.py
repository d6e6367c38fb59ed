"""Words of many texts at once, and what the operators do for each distinct one."""

import random

import numpy as np
import public_tokenizers

from blogindex.llm import hmm, jaccard, tokens
from blogindex.llm.common import coded_words, words


def test_coded_words_are_the_words():
    rng = random.Random(3)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else bytes(rng.choices(b" \t\n\x0b\x0c\r\x1c\x85\xa0\xffaAbB\xc3\xa9.", k=rng.randrange(14)))
                 for _ in range(rng.randrange(6))]
        for lower in (True, False):
            distinct, numbers, ends = coded_words(texts, lower)
            assert len(set(distinct)) == len(distinct) and len(ends) == len(texts)
            assert [[distinct[i] for i in numbers[a:b]] for a, b in zip([0, *ends], ends)] == [words(t, lower) for t in texts]


def test_a_repeated_word_is_looked_up_once():
    looked = []

    class Known(dict):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokens.WordEncoder(path)
    encoder.known = Known()
    texts = [b"Two words, " * 500, None, b"", b" \n", b"two more words"] * 20
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    want = [library.encode((t or b"").decode(), add_special_tokens=False).ids for t in texts]
    got = encoder.encode_all(texts)
    assert [[int.from_bytes(g[i:i + 4], "little") for i in range(0, len(g), 4)] for g in got] == want
    assert len(looked) <= 5


def test_words_of_a_chunk_are_told_once(spark):
    """Texts of together 72,000 words are one chunk, and their numbers need four bytes each."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(600)) + " w0x0") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1)
    chunks = {r["kind"]: r for r in hmm.chunked(docs, 5, 1).collect()}
    assert hmm.chunked(docs, 5, 1).count() == 2 and len(chunks) == 2
    learned = chunks["words"]["words"]
    assert len(learned) == 72_001 and set(chunks["texts"]["lengths"]) == {602}
    tokens_ = np.frombuffer(chunks["texts"]["tokens"], np.uint32)
    ends = np.cumsum(chunks["texts"]["lengths"])
    assert [bytes(learned[t]).decode() for t in tokens_[ends[4]:ends[5]]] == [*rows[5][1].split(), " "]


def test_shingles_keep_no_words(monkeypatch):
    """A distinct word of the texts is hashed once, and the worker holds none of them afterwards."""
    hashed = []
    real = jaccard.xxhash.xxh64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh64_intdigest", lambda w: (hashed.append(w), real(w))[1])
    make = jaccard.Shingler(3)
    texts = [b"a b c d a b c", None, b"A B C D", b"c", b" a  b ", b"x y"]
    sets = make(texts)
    assert [len(s) for s in sets] == [5 - 1, 0, 2, 1, 1, 1]
    assert set(sets[2].tolist()) < set(sets[0].tolist())
    assert sorted(hashed) == [b"a", b"b", b"c", b"d", b"x", b"y"]
    assert not any(isinstance(v, dict) and v for v in vars(make).values())
