"""The corpus operators against plain loops and the tokenizer libraries, on small and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from blogindex.llm import (common, fingerprints, graph, hmm, jaccard, licenses, packing, pfor, pieces, quality, rules,
                           sharding)
from tests.conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard int, block int, token string"
PLAIN = "the quick brown fox jumps over the lazy dog and runs away from all the people of the old town "


def _awkward_rows():
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "Same text here, twice. " * 4, "Same text here, twice. " * 4, PLAIN * 3, long,
             "Ünïcode ▁ 日本語 😀 <|endoftext|> don't", "a\nb\na\nb\n", "x" * 5000]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "x") for i, t in _awkward_rows()], SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


def _tokens(text):
    return (text or "").encode().lower().split()


# ---- language model

def _naive_counts(rows):
    count = Counter()
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1:
            count.update([*_tokens(text), b" "])
    return count


def _check_base(out, rows):
    count = _naive_counts(rows)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for doc_id, text in rows:
        line = [*_tokens(text), b" "]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in line)
        want[doc_id, len(line), sum(w in count for w in line), n, round(base, 5)] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out)


def test_hidden_markov_scores(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    out = hmm.language_scores(docs).collect()
    _check_base(out, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hidden_markov_awkward(awkward, nothing):
    _check_base(hmm.language_scores(awkward, rounds=1).collect(), _awkward_rows())
    assert hmm.language_scores(nothing, rounds=1).count() == 0


def test_forward_and_counts_equal_all_paths():
    from itertools import product
    m = hmm.Model(np.array([.3, .7]), np.array([[.6, .4], [.2, .8]]), np.array([[.5, .1], [.3, .2], [.2, .7]]))
    sequences = [[0, 1, 2, 2], [1], [2, 0, 1]]
    flat, lengths = np.concatenate(sequences), np.array([4, 1, 3])
    moves = np.zeros((2, 2))
    for s, got in zip(sequences, hmm.log_likelihood(m, flat, lengths)):
        paths = {z: m.start[z[0]] * m.emit[s[0], z[0]] * np.prod(
            [m.move[z[i - 1], z[i]] * m.emit[s[i], z[i]] for i in range(1, len(s))]) for z in product(range(2), repeat=len(s))}
        assert got == pytest.approx(math.log10(sum(paths.values())), abs=1e-12)
        for z, p in paths.items():
            for i in range(1, len(s)):
                moves[z[i - 1], z[i]] += p / sum(paths.values())
    assert np.allclose(hmm.expected_counts(m, flat, lengths)[1], moves)


# ---- quality rules and classifier

def _naive_rules(text):
    ws = (text or "").encode().split()
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(ws), sum(len(w.decode()) for w in ws), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def test_quality_rules_awkward(awkward, nothing):
    got = Counter(tuple(r)[:-1] for r in rules.quality_rules(awkward).collect())
    assert got == Counter((i, *_naive_rules(t)) for i, t in _awkward_rows())
    assert rules.quality_rules(nothing).count() == 0


def test_rule_order_has_no_effect_on_the_verdict(rows):
    names = list(rules.RULES)
    for _, text in rows[:60]:
        verdicts = {rules.verdict(rules.Text(text.encode()), random.sample(names, len(names))) for _ in range(4)}
        assert len(verdicts) == 1


def test_rules_are_ordered_by_rejections_per_cost(spark):
    table = spark.createDataFrame([(i, "#### $$ " * 40) for i in range(50)], "doc_id bigint, text string")
    order = rules.estimate_rules(table)
    assert sorted(order) == sorted(rules.RULES) and order.index("symbols") < order.index("long_words")


def test_quality_held_out_accuracy(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    clean = [r for r in out if r.quality == 1]
    assert len(out) > 40 and all(r.predicted == 1 for r in clean)
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_factor_machine_equals_pairwise_sum():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 8)).astype(np.float32))
    at, x = np.array([1, 4, 9, 4]), np.array([.5, 1, 2, .25], np.float32)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert m.margins([(at, x)])[0] == pytest.approx(0.3 + m.linear[at] @ x + pairs, rel=1e-4)


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(i * 7, i % 2) for i in range(11)] + [(7, None), (None, 1)], "doc_id bigint, quality int")
    out = quality.quality_scores(awkward, labels).collect()
    assert len(out) == len(_awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality.quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}


def test_repeated_ids_displace_no_training_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:8]
    one_each = [(i, f"{'good' if k % 2 else 'bad'} words of text {i}") for k, i in enumerate(ids)]
    once = spark.createDataFrame(one_each, "doc_id bigint, text string")
    often = spark.createDataFrame(one_each[:1] * 50 + one_each, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id bigint, quality int")
    a, b = (quality.train(docs, labels, len(ids)) for docs in (once, often))
    assert a.bias == b.bias and np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)


# ---- licences

def test_licences_awkward(spark, awkward, nothing):
    notice = "Released under the MIT License."
    files = spark.createDataFrame(
        [(1, "a/LICENSE", notice), (2, "a/b/c/x.py", "code"), (3, "a/b/y.py", "Licensed under CC BY-NC 4.0.\ncode"),
         (4, "z.py", "code"), (5, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (6, None, None),
         (7, "a/z.py", "")], "doc_id int, path string, text string")
    got = {r.doc_id: (r.licence, r.origin, r.inherited_from) for r in licenses.scan_licences(files).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("CC-BY-NC-4.0", "notice", None),
                   4: (None, "none", None), 5: ("Apache-2.0", "file", None), 6: (None, "none", None), 7: ("MIT", "inherited", "a")}
    assert licenses.scan_licences(licenses.document_files(awkward)).count() == len(_awkward_rows())
    # Rows without an id, and other texts under one id, are files of their own; equal rows are one file.
    mixed = spark.createDataFrame(
        [(None, notice, "en", "web"), (None, "no licence at all " * 40, "en", "web"), (3, notice, "en", "web"), (3, "words " * 90, "en", "web"),
         (3, "words " * 90, "en", "web"), (None, None, None, None), (64, "code", "en", "web")], "doc_id bigint, text string, lang string, source string")
    got = sorted(map(str, ((r.doc_id, r.path, r.licence, r.origin, r.similarity) for r in licenses.scan_licences(licenses.document_files(mixed)).collect())))
    assert got == sorted(map(str, [
        (None, "web/en/.txt", "MIT", "notice", 1.0), (None, "web/en/.txt", None, "none", None), (3, "web/en/0/LICENSE-3.txt", "MIT", "file", 1.0),
        (3, "web/en/0/3.txt", "MIT", "inherited", 1.0), (3, "web/en/0/3.txt", "MIT", "inherited", 1.0), (None, ".txt", None, "none", None),
        (64, "web/en/1/64.txt", None, "none", None)]))
    assert licenses.scan_licences(licenses.document_files(nothing)).count() == 0


def _naive_cosine(text, texts, template):
    """TF-IDF cosine of a text to a template, with document frequencies of all words."""
    held = [set(re.findall("[a-z0-9]+", t.lower())) for t in texts]
    a, b = (Counter(re.findall("[a-z0-9]+", t.lower())) for t in (text, template))
    idf = {t: math.log((len(texts) + 1) / (sum(t in h for h in held) + 1)) + 1 for t in {*a, *b}}
    a, b = ({t: k * idf[t] for t, k in bag.items()} for bag in (a, b))
    return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


@pytest.mark.parametrize("n", [40, 4000])
def test_licences_weigh_every_word(spark, n):
    # Other words of the line are in most files, so they weigh little at any number of files.
    template = dict(licenses.TEMPLATES)["MIT"]
    notice = f"and {template} with the code"
    texts = [notice if i % 20 == 0 else f"and with the code number{i}" for i in range(n)]
    files = spark.createDataFrame([(i, f"f{i}.py", t) for i, t in enumerate(texts)], "doc_id int, path string, text string")
    got = {r.doc_id: r for r in licenses.scan_licences(files).collect()}
    want = _naive_cosine(notice, texts, template)
    assert want > 0.6
    for i in range(n):
        assert got[i].licence == ("MIT" if i % 20 == 0 else None)
    assert got[0].similarity >= round(want, 6) - 1e-6


def test_licences_inside_long_lines(spark):
    names = dict(licenses.TEMPLATES)
    other = [f"word{i}" for i in range(300)]
    wrapped = names["GPL-3.0"].replace(" ", "\n")
    texts = [" ".join([*other[:150], names["Apache-2.0"], *other[150:]]), " ".join(other[:200]) + "\n" + wrapped + "\n" + other[0],
             " ".join(other), names["MPL-2.0"].replace("Public License,", "Public\nLicense,\n")]
    files = spark.createDataFrame([(i, f"f{i}.py", t) for i, t in enumerate(texts)], "doc_id int, path string, text string")
    got = {r.doc_id: (r.licence, r.similarity) for r in licenses.scan_licences(files).collect()}
    assert got == {0: ("Apache-2.0", 1.0), 1: ("GPL-3.0", 1.0), 2: (None, None), 3: ("MPL-2.0", 1.0)}


def test_licences_same_as_sql(spark):
    notice = dict(licenses.TEMPLATES)["MIT"]
    rows = [(i, [f"and {notice} in the line {i}", f"some text of {i}\nthe mit licensed the use of 2 licenses under version 2",
                 notice, None, f"{'of the source code ' * i} by {i}"][i % 5], "en", "web", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = licenses.scan_licences(licenses.document_files(docs)).select("doc_id", "path", "licence", "similarity", "origin", "inherited_from")
    duck = duckdb.connect()
    documents = docs.toPandas()
    duck.register("documents", documents)
    want = duck.execute(licenses.licence_scan_sql()).fetchall()
    def key(r):
        return (r[0], r[1], r[2], None if r[3] is None else round(r[3], 5), r[4], r[5])
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))


def test_licences_of_documents_inherit_from_all_levels(spark):
    long = "\n".join(["Permission is hereby granted to use it."] * 60)
    texts = {16: ("web", "Released under the MIT License.\n" + long), 17: ("web", "Licensed under CC BY-SA 4.0.\n" + long),
             67: ("web", "Licensed under the Apache License, Version 2.0.\n" + long), 68: ("web", "code"), 130: ("web", "code"),
             300: ("news", "code"), 31: ("news", "Released under the MIT License.")}
    rows = [(i, t, "fr" if i == 130 else "en", s, 0) for i, (s, t) in texts.items()] + [(200, "code", "en", "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.path, r.licence, r.origin, r.inherited_from)
           for r in licenses.scan_licences(licenses.document_files(docs)).collect()}
    assert got == {
        16: ("web/LICENSE-16.txt", "MIT", "file", None), 17: ("web/en/LICENSE-17.txt", "CC-BY-SA-4.0", "file", None),
        67: ("web/en/1/LICENSE-67.txt", "Apache-2.0", "file", None), 68: ("web/en/1/68.txt", "Apache-2.0", "inherited", "web/en/1"),
        200: ("web/en/3/200.txt", "CC-BY-SA-4.0", "inherited", "web/en"), 130: ("web/fr/2/130.txt", "MIT", "inherited", "web"),
        300: ("news/en/4/300.txt", None, "none", None), 31: ("news/en/0/31.txt", "MIT", "notice", None)}


# ---- Jaccard join

def _naive_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        ws = _tokens(t)
        if i is not None:
            sets[i] = {tuple(ws[k:k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_components_of_random_copies(spark, n, percent):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 30, 60]))]
        for copy in range(rng.choice([1, 2, 14])):
            text = list(text)
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    old = jaccard.TILE, jaccard.HOT, jaccard.SMALL, jaccard.PARTS
    # Small tiles: large ones are cut into parts, frequent shingles salted, groups dealt out.
    jaccard.TILE, jaccard.HOT, jaccard.SMALL, jaccard.PARTS = 6, 3, 4, {False: (7, 10_000), True: (3, 200)}
    try:
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table, n, percent).collect()}
    finally:
        jaccard.TILE, jaccard.HOT, jaccard.SMALL, jaccard.PARTS = old
    assert got == _naive_components(rows, n, percent)


def test_jaccard_awkward(awkward, nothing):
    want = _naive_components(_awkward_rows(), 4, 85)
    got = jaccard.jaccard_components(awkward, 4, 85).collect()
    assert len(got) == len(_awkward_rows())
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard.jaccard_components(nothing, 4, 85).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# ---- fingerprints

def _generalised(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_collisions_estimate_generalised_jaccard(rows):
    bags = [fingerprints._bag(t) for _, t in rows]
    prints = fingerprints.fingerprints(bags, 256)
    pairs = [(i, j) for i in range(0, 60) for j in range(i + 1, 60)]
    errors = [float((prints[i] == prints[j]).mean()) - _generalised(bags[i], bags[j]) for i, j in pairs]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def _check_prints(out, rows):
    for x, (i, (doc_id, text)) in zip(out, enumerate(rows)):
        edited = fingerprints.edited_text(text, rows[(i + 1) % len(rows)][1])
        assert (x.doc_id, x.n_chars) == (doc_id, len(text))
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = (fingerprints.fingerprints([fingerprints._bag(t)])[0].astype(">u2").tobytes().hex() for t in (text, edited))
        assert (x.fingerprint, x.edited_fingerprint) == (own, other)
        assert x.near_next == np.mean([own[k:k + 4] == out[(i + 1) % len(out)].fingerprint[k:k + 4] for k in range(0, len(own), 4)])


@pytest.mark.parametrize("block_rows", [17, 4096])
def test_fingerprints_follow_the_next_document(docs, rows, block_rows):
    out = sorted(fingerprints.fingerprint_documents(docs, block_rows).collect(), key=lambda r: r.doc_id)
    _check_prints(out, rows)


def test_fingerprints_awkward(awkward, nothing):
    out = fingerprints.fingerprint_documents(awkward, 4).collect()
    assert len(out) == len(_awkward_rows())
    unique = [(i, t or "") for i, t in sorted({(i, t) for i, t in _awkward_rows() if i is not None}, key=lambda x: x[0])]
    table = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    _check_prints(sorted(fingerprints.fingerprint_documents(table, 4).collect(), key=lambda r: r.doc_id), unique)
    assert fingerprints.fingerprint_documents(nothing).count() == 0
    assert fingerprints.fingerprint_documents(awkward.filter("doc_id IS NULL")).count() == 2


# ---- shards

def _naive_best_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        fits = sorted((r, b) for b, r in enumerate(free) if r >= s)
        if fits:
            b = fits[0][1]
        else:
            b = len(free)
            free.append(max(capacity, s))
        free[b] -= s
        out.append(b)
    return out


def test_best_fit_by_tree_equals_search():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 90) for _ in range(rng.randint(0, 120))), reverse=True)
        capacity = rng.randint(40, 200)
        assert sharding.best_fit_decreasing(sizes, capacity) == _naive_best_fit(sizes, capacity)


def _check_shards(out, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("items,folder", [(1000, "0.1"), (8192, "0.01")])
def test_shards_have_near_equal_sizes(spark, items, folder):
    docs = spark.read.parquet(f"{DATA.replace('0.001', folder)}/documents.parquet")
    old, sharding.PART_ITEMS = sharding.PART_ITEMS, items
    try:
        out = sharding.shard_documents(docs, 10, slot_rows=30).collect()
    finally:
        sharding.PART_ITEMS = old
    _check_shards(out, [(r.doc_id, r.text) for r in docs.collect()], 10)
    sizes, groups = Counter(), defaultdict(set)
    for r in out:
        sizes[r.shard] += r.size
        groups[r.text_crc32].add(r.shard)
    assert max(sizes.values()) <= 1.03 * min(sizes.values())
    assert all(len(s) == 1 for s in groups.values())


def test_oversized_group_is_cut_and_awkward_rows(spark, awkward, nothing):
    rows = [(i, "same " * 20) for i in range(400)] + [(1000 + i, f"text {i} " * 9) for i in range(300)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    _check_shards(out, rows, 8)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.2 * min(sizes.values())
    _check_shards(sharding.shard_documents(awkward, 40).collect(), _awkward_rows(), 40)
    assert sharding.shard_documents(nothing, 40).count() == 0


# ---- pieces

@pytest.fixture(scope="module")
def sp():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def _same_pieces(codec, sp, text):
    chunks = codec.encode(text.encode())
    ids = [int(i) for i in b",".join(chunks).split(b",")] if chunks else []
    return ids == sp.encode(text) and codec.decode(chunks).decode() == sp.decode(ids)


def test_pieces_equal_the_library_on_random_texts(sp):
    codec, rng = pieces.piece_codec(PIECE), random.Random(5)
    letters = [*"abcXYZ éÉñ .,!'<|>0123\n\t▁ 日😀ﬁ\x00\x7f", "  ", "the", "ing", "<s>", "</s>", "<0x0A>", "aaaa", "tion", "   ", "ers"]
    for _ in range(4000):
        assert _same_pieces(codec, sp, "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))))
    for _ in range(4000):
        some = "etaoinshrdlu"[:rng.choice([2, 5, 12])]
        assert _same_pieces(codec, sp, "".join(rng.choice(some) for _ in range(rng.randint(0, 40))))
    assert _same_pieces(codec, sp, "a" * 50_000 + "the" * 5000)


def _check_pieces(out, rows, sp):
    want = Counter()
    for i, t in rows:
        ids = sp.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in out) == want


def test_piece_query_rows(docs, rows, awkward, nothing, sp):
    _check_pieces(pieces.encode_decode(docs, PIECE).collect(), rows, sp)
    _check_pieces(pieces.encode_decode(awkward, PIECE).collect(), _awkward_rows(), sp)
    assert pieces.encode_decode(nothing, PIECE).count() == 0


# ---- packing and token files

@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORD)
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")


def _check_packing(out, rows, encode, window):
    pieces_of, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces_of[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append(r)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == [sum(x.length for x in w[:k]) for k in range(len(w))]
        assert sum(r.length for r in w) <= window
    want = Counter()
    for i, t in rows:
        ids = encode(t)
        for s in range(0, len(ids), window):
            want[i, s, len(ids[s:s + window]), zlib.crc32(ids[s:s + window].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    return sum(window - sum(r.length for r in w) for w in windows.values()) / max(1, sum(r.length for r in out))


def test_packing(docs, rows, awkward, nothing, encode):
    assert _check_packing(packing.pack_documents(docs, WORD).collect(), rows, encode, 2048) < 0.05
    _check_packing(packing.pack_documents(awkward, WORD, 256).collect(), _awkward_rows(), encode, 256)
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_segment_tree_finds_the_tightest_window():
    rng = random.Random(4)
    lengths = np.array([rng.randint(1, 100) for _ in range(500)])
    number, offset = packing.best_fit_decreasing(lengths, 100)
    order = np.argsort(-lengths, kind="stable")
    # Windows of equal room are interchangeable: only the amounts of room are compared.
    free, left = [], []
    for i in order:
        fits = sorted(r for r in free if r >= lengths[i])
        room = fits[0] if fits else 100
        if fits:
            free.remove(room)
        free.append(room - lengths[i])
    for w in range(number.max() + 1):
        left.append(100 - lengths[number == w].sum())
    assert sorted(left) == sorted(free)


@pytest.mark.parametrize("ids", [[], [5], [7] * 512, list(range(1000)), [1, 2 ** 32 - 1] * 300, [40_000] * 600 + [0]])
def test_token_blocks_round_trip(ids):
    want = np.array(ids, np.uint32)
    names, lengths, got = pfor.read_segment(pfor.write_segment([3, None], [want.astype("<u4").tobytes(), b""]))
    assert list(lengths) == [len(ids), 0] and (got == want).all() and names[0] == 3


def test_token_files(docs, rows, awkward, nothing, encode):
    at = 0
    for r, (i, t) in zip(sorted(pfor.token_round_trip(docs, WORD).collect(), key=lambda r: r.doc_id), rows):
        ids = encode(t)
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = pfor.token_round_trip(awkward, WORD).collect()
    want = Counter((i, len(encode(t)), zlib.crc32(encode(t).tobytes())) for i, t in _awkward_rows())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.start for r in got) == [0, *np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()]
    assert pfor.token_round_trip(nothing, WORD).count() == 0


def test_sums_before(spark):
    rows = [(b, s, (7 * b + s) % 11) for b in range(0, 3000, 7) for s in range(2)]
    out = common.sums_before(spark.createDataFrame(rows, "b int, s int, v bigint"), ["b", "s"], "v", "before").collect()
    total, want = 0, {}
    for b, s, v in rows:
        want[b, s] = total
        total += v
    assert {(r.b, r.s): r.before for r in out} == want


# ---- pipeline

def test_pipeline_stages_by_loops(spark, docs, rows, encode):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    one = corpus_pipeline.classify(spark, docs, DATA)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == good
    left = [(i, t) for i, t in rows if i in good and rules.verdict(rules.Text(t.encode()), list(rules.RULES))]
    two = corpus_pipeline.filter_rules(spark, one, DATA)
    assert sorted(r.doc_id for r in two.collect()) == [i for i, _ in left]
    groups = _naive_components(left, 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    three = corpus_pipeline.drop_near_duplicates(spark, two, DATA)
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == [i for i, _ in left]
    _check_packing(corpus_pipeline.run(spark, DATA).collect(), left, encode, 2048)


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.select(*corpus_pipeline.COLUMNS), DATA).count() >= 0
        assert stage(spark, nothing.select(*corpus_pipeline.COLUMNS), DATA).count() == 0


def test_queries_are_registered():
    from blogindex.llm import queries
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")]
    assert numbers == list(range(1, 11)) and queries.QUERIES["pipeline"] is corpus_pipeline.run
