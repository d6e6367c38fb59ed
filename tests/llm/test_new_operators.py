"""Whitening, nearest neighbours and spelling variants against plain loops, numpy and awkward tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from blogindex.llm import curves, qd, variants, whitening
from tests.conftest import DATA

VECTORS = "vec_id bigint, embedding array<float>, label int, v string, id string, rank int, component string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, "z") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def awkward_vectors(spark):
    """Null, empty, short, zero, non-finite vectors, a null id, equal vectors, a repeated row, one id with two vectors."""
    draw = np.random.default_rng(3)
    fine = [(i * 10, draw.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    bad = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [0.0] * 4), (5, [1.0, None, 1.0, 1.0]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0]),
           (None, [1.0, 1.0, 1.0, 1.0])]
    same = [(1000 + i, [0.5, 0.25, 0.125, 1.0]) for i in range(30)]
    again = [fine[3], fine[3], (0, [9.0, 9.0, 9.0, 9.0])]
    return _vectors(spark, fine + bad + same + again), fine, same


# ---- bidiagonal qd

def _matrices():
    draw = np.random.default_rng(1)
    left, right = (np.linalg.qr(draw.normal(size=(30, 30)))[0] for _ in range(2))
    yield "normal", draw.normal(size=(40, 40))
    yield "nearly equal", np.linalg.qr(draw.normal(size=(50_000, 24)), mode="r")
    yield "equal", np.eye(12)
    yield "repeated", left @ np.diag([5.0] * 10 + [2.0] * 10 + [1.0] * 10) @ right
    yield "close", left @ np.diag(np.r_[5 + 1e-12 * np.arange(10), 2 + 1e-7 * np.arange(10), np.ones(10)]) @ right
    yield "graded", left @ np.diag(10.0 ** -np.arange(30)) @ right
    yield "rank", draw.normal(size=(30, 6)) @ draw.normal(size=(6, 30))
    yield "zero", np.zeros((4, 4))
    yield "one", np.array([[3.0]])


@pytest.mark.parametrize("name,matrix", list(_matrices()), ids=[n for n, _ in _matrices()])
def test_singular_values_and_vectors(name, matrix):
    squares, v = qd.right_singular(matrix)
    want = np.linalg.svd(matrix, compute_uv=False)
    top = max(want.max(), 1e-300)
    assert np.abs(np.sqrt(squares) - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-11
    assert np.abs(matrix.T @ matrix @ v - v * squares).max() <= 1e-12 * top * top


def test_small_singular_values_are_accurate():
    # A bidiagonal of entries of any size determines its values to full relative precision.
    d, e = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(1, 23, 2.0)
    found = np.sqrt(qd.dqds((d ** 2).tolist(), (e ** 2).tolist()))
    product = np.prod(found)
    assert abs(product / np.prod(d) - 1) < 1e-12  # the determinant


# ---- whitening

def _naive_whitening(x, k):
    n = len(x)
    c = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return c @ vectors[:, :k] / np.sqrt(values[:k]), values / values.sum()


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    got = whitening.whiten(table).toPandas().sort_values(["vec_id", "component"])
    want, shares = _naive_whitening(x.astype(float) - 1_000_000, 32)
    white = got.whitened.to_numpy().reshape(n, 32)
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-8
    assert (got.deviation.to_numpy().reshape(n, 32) == ((n * x - sums) ** 2).sum(axis=1)[:, None]).all()
    assert np.allclose(got.explained.to_numpy()[:32], shares[:32], rtol=1e-9)
    assert got.n.eq(n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_merges_many_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(300)]
    few = whitening.whiten(_vectors(spark, rows).repartition(13), 6).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * np.array([np.float32(v) for _, v in rows], float))
    want = _naive_whitening(x, 6)[0]
    white = few.whitened.to_numpy().reshape(300, 6)
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9


def test_whitening_awkward(spark, awkward_vectors):
    table, fine, same = awkward_vectors
    got = whitening.whiten(table, 3).collect()
    # Zero vectors and rows without an id are vectors; repeated rows count each time.
    usable = len(fine) + len(same) + 3 + 2
    assert len(got) == 3 * usable and {r.n for r in got} == {usable}
    assert sum(r.vec_id is None for r in got) == 3 and {r.component for r in got} == {1, 2, 3}
    assert whitening.whiten(_vectors(spark, []), 3).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0])]), 3).count() == 0  # no spread
    line = whitening.whiten(_vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert len(line) == 9 and abs(line[0].explained - 1) < 1e-12  # one direction only
    # Too large for 64 bits: the deviation is null, the rest is there.
    far = whitening.whiten(_vectors(spark, [(i, [float(i) * 1e12, 1.0]) for i in range(8)])).collect()
    assert any(r.deviation is None for r in far) and all(abs(r.whitened) < 3 for r in far)


# ---- nearest neighbours

def test_hilbert_curve_visits_neighbouring_cells():
    for m, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m, indexing="ij"), axis=-1).reshape(-1, m)
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def _exact(rows, k, every):
    """The k nearest of every query, ties to the smaller id."""
    out = {}
    for q, a in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(a, float) - np.array(b, float)) ** 2).sum())), i) for i, b in rows if i != q)
            out[q] = near[:k]
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = _exact(rows, 10, 100)
    got = curves.nearest_neighbours(table).collect()
    assert len(got) == 10 * len(want)
    assert sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got) >= 0.9 * len(got)
    by_id = dict(rows)
    assert all(abs(r.score - float(np.sqrt(((np.array(by_id[r.query_id]) - np.array(by_id[r.vec_id])) ** 2).sum()))) < 1e-12 for r in got)


@pytest.mark.parametrize("least,rows_at_once", [(512, 16_384), (8, 16)])
def test_neighbours_awkward(spark, awkward_vectors, monkeypatch, least, rows_at_once):
    monkeypatch.setattr(curves, "LEAST", least)
    monkeypatch.setattr(curves, "ROWS", rows_at_once)  # ranges cut into parts
    table, fine, same = awkward_vectors
    got = {}
    for r in curves.nearest_neighbours(table, every=10, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    # An id with two vectors counts with the smaller one.
    rows = [(i, [9.0] * 4 if i == 0 and [9.0] * 4 < v else v) for i, v in fine] + same
    want = _exact(rows, 10, 10)
    assert set(got) == set(want)
    found = sum(len(set(v) & {(s, i) for s, i in want[q]}) for q, v in got.items())
    assert all(len(v) == 10 for v in got.values()) and found >= 0.9 * 10 * len(want)
    # Thirty equal vectors: the ten smallest other ids, whatever the windows are.
    assert [i for _, i in got[1010]] == [i for i, _ in same if i != 1010][:10]
    few = _vectors(spark, [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [(r.query_id, r.rank, r.vec_id) for r in curves.nearest_neighbours(few).orderBy("rank").collect()] == [(100, 1, 2), (100, 2, 1)]
    assert curves.nearest_neighbours(_vectors(spark, [])).count() == 0
    assert curves.nearest_neighbours(_vectors(spark, [(100, [1.0])])).count() == 0


# ---- spelling variants

def _letters(text):
    out, run = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or 0xC0 <= ord(c) <= 0xFF:
            run += c
        else:
            out += [run] if run else []
            run = ""
    return out + ([run] if run else [])


def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _naive_variants(rows, one_in, letters=5, uses=3):
    counts = Counter()
    for i, text in rows:
        for w in _letters(text):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= uses}
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and _one_apart(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def _variants(table, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(table, **options).collect()}


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = _naive_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 97)
    assert _variants(docs, one_in=97) == want and len(want) > 1000


@pytest.mark.parametrize("sample,list_rows,often", [(100_000, 20_000, 20), (40, 8, 2), (1, 3, 1)])
def test_variants_of_random_words(spark, monkeypatch, sample, list_rows, often):
    # Dense words over few letters, small lists and a dictionary of a poor sample: no near word is lost.
    monkeypatch.setattr(variants, "SAMPLE", sample)
    monkeypatch.setattr(variants, "LIST", list_rows)
    monkeypatch.setattr(variants, "OFTEN", often)
    rng = random.Random(sample)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.choice([4, 5, 5, 6, 7, 9, 12]))) for _ in range(500)]
    words += [w[:i] + rng.choice("abÿ") + w[i + d:] for w in words for i, d in [(rng.randrange(len(w) + 1), rng.choice([0, 1]))]]
    long = "ab" * 40
    words += [long, long[:-1], "b" + long, long[:31] + "é" + long[32:], "a" * 64, "a" * 65, "a" * 63, "a" * 66]
    rows = [(i, " ".join(words[i::50] * rng.choice([1, 2, 3])) + (" " + long) * 3) for i in range(50)] * 2
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (4, 5):
        assert _variants(table, min_letters=least) == _naive_variants(rows, None, least)


def test_variants_awkward(spark):
    odd = "Straße Straßen straße, STRASSE strassé naïve-naïve naıve œuvre ×÷× cafés \U0001f600abcde cafés abcde abcde abcdf"
    rows = [(1, odd), (1, odd), (None, odd), (None, None), (2, ""), (3, " \n\t"), (4, "aaaaa " * 3 + "aaaab " * 6 + "aaabb " * 20), (5, "x" * 30_000 + " " + "x" * 30_001),
            (5, "x" * 30_000 + " " + "x" * 30_001), (5, ("x" * 30_000 + " ") * 3 + "x" * 30_001)]
    schema = "doc_id bigint, text string, word string, n string, form int, cell int, gram string"
    table = spark.createDataFrame([(i, t, "w", "n", 1, 2, "g") for i, t in rows], schema)
    for one_in in (None, 2, 97):
        assert _variants(table, one_in=one_in) == _naive_variants(rows, one_in)
    assert _variants(table)["aaaaa"][:2] == ("aaaab", "aaabb")
    assert variants.spelling_variants(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(table, min_letters=3)


def test_plain_ascii_words_need_no_pattern(monkeypatch):
    """Letters with signs behind them are cut without decoding; the ids are those of the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from blogindex.llm import tokens
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = [b"Word", b"word,", b"a.b", b"...", b"x", b"(x)", "Stra\u00dfe.".encode(), b"don't", b"7th", b"end?!", b"\xff", b"END"]
    seen, real = [], tokens._PLAIN

    class Pattern:
        def fullmatch(self, text):
            seen.append(text)
            return real.fullmatch(text)

    monkeypatch.setattr(tokens, "_PLAIN", Pattern())
    encoder = tokens.WordEncoder(path)
    texts = [None, b"", b" ".join(plain), b" ".join(plain[::-1]) + b"\n"]
    library = Tokenizer.from_file(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [
            library.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
    assert not {"Word", "word,", "x", "end?!", "END"} & set(seen) and "7th" in seen


def test_bits_of_small_and_large_numbers():
    from blogindex.llm import pfor
    values = np.array([0, 1, 2, 3, 255, 256, 65_535, 65_536, 2**32 - 1], np.uint32)
    want = [int(v).bit_length() for v in values]
    assert pfor._bits(values).tolist() == want and pfor._bits(values[:7]).tolist() == want[:7]
    assert pfor._bits(values[:7]).dtype == np.uint8 and not pfor._bits(values[:0]).size


def test_chunks_step_together(monkeypatch):
    """Small chunks are joined up to a bound, in order, and give the probabilities of each alone."""
    from blogindex.llm import hmm
    rows = [(i, [n] * 3) for i, n in enumerate((2, 4, 1, 50, 3, 1))]
    monkeypatch.setattr(hmm, "TOGETHER", 18)
    assert [[r[0] for r in run] for run in hmm._together(iter(rows), 1)] == [[0, 1], [2, 3], [4, 5]]
    rng = np.random.default_rng(3)
    model = hmm.first_model(np.full(20, 0.05), 4)
    parts = [(rng.integers(0, 20, sum(n)), np.array(n)) for _, n in rows]
    joined = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    assert np.allclose(hmm.log_likelihood(model, *joined), np.concatenate([hmm.log_likelihood(model, *p) for p in parts]), rtol=1e-12)
