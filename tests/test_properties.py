"""Random cases against plain sequential loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from blogindex.functions import text as tx
from blogindex.functions import urls
from blogindex.operators import features, ingest, search, stats


def test_upsert_equals_sequential(spark):
    rng = random.Random(1)
    rows, stored = [], []
    for case in range(60):
        known = {f"{case}:{u}": rng.choice("abc") for u in range(3) if rng.random() < 0.5}
        stored += list(known.items())
        rows += [(seq, f"{case}:{rng.randrange(3)}", rng.choice("abc")) for seq in
                 rng.sample(range(100), rng.randrange(1, 15))]
    state, want = dict(stored), {}
    for seq, url, content in sorted(rows, key=lambda r: r[0]):
        before = state.get(url)
        want[seq, url] = "inserted" if before is None else "skipped" if before == content else "updated"
        state[url] = content
    pages = spark.createDataFrame(rows, "seq BIGINT, url_hash STRING, content_hash STRING")
    current = spark.createDataFrame(stored, "url_hash STRING, content_hash STRING")
    for span in (7, 1000):
        got = {(r["seq"], r["url_hash"]): r["status"] for r in ingest.upsert_status(pages, current, span).collect()}
        assert got == want


def _scan(occurrences, n):
    """Covers by brute force: every end, then the latest start per lexeme."""
    weights = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
    if n == 1:
        return sum(weights[w] for _, _, w in occurrences)
    total, last_start = 0.0, -1
    for q, _, _ in occurrences:
        starts = [max((p for p, s, _ in occurrences if s == k and p <= q), default=None) for k in range(n)]
        if None in starts or min(starts) <= last_start:
            continue
        p = last_start = min(starts)
        inside = [w for pos, _, w in occurrences if p <= pos <= q]
        k = len(inside)
        total += k / sum(1 / weights[w] for w in inside) / (1 + (q - p) - (k - 1))
    return total


def test_cover_density_equals_scan(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for case in range(300):
        n = rng.randrange(1, 5)
        positions = sorted(rng.sample(range(1, 60), rng.randrange(n, 20)))
        slots = [*range(n), *[rng.randrange(n) for _ in positions[n:]]]
        rng.shuffle(slots)
        occurrences = [(p, s, rng.choice("ABCD")) for p, s in zip(positions, slots)]
        want[case] = _scan(occurrences, n)
        hits = [(s, [(p, w) for p, t, w in occurrences if t == s]) for s in range(n)]
        rng.shuffle(hits)
        rows.append((case, "x", n, hits))
    df = spark.createDataFrame(rows, "query_id INT, id STRING, n INT, hits ARRAY<STRUCT<slot: INT, positions: ARRAY<STRUCT<pos: INT, w: STRING>>>>")
    got = {r["query_id"]: r["rank"] for r in search.rank(df).collect()}
    assert all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_running_mean_equals_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for day in range(25):
        date = dt.date(2024, 1, 1) + dt.timedelta(days=day)
        xs = [None if rng.random() < 0.1 else rng.choice([rng.randrange(0, 10**6), 1234, 1235]) for _ in range(rng.randrange(1, 400))]
        if day % 5 == 0:
            xs = [xs[0]] + [1001] * 300
        mean = xs[0]
        for x in xs[1:]:
            if x is not None:
                mean = ((mean or 0) + x + 1) // 2
        want[date] = mean
        rows += [(date, i, x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "date DATE, batch BIGINT, x BIGINT") \
        .select("date", "batch", (F.col("x") / 100).cast("decimal(10,2)").alias("ms"))
    for span in (3, 70, 100_000):
        got = {r["date"]: None if r["mean"] is None else int(r["mean"] * 100) for r in stats.running_mean(df, span=span).collect()}
        assert got == want
    # Continued from a stored state: the same as one run over all.
    first = stats.running_mean(df.filter("batch < 90"))
    got = {r["date"]: None if r["mean"] is None else int(r["mean"] * 100)
           for r in stats.running_mean(df.filter("batch >= 90"), start=first).collect()}
    assert got == want


def test_running_totals(spark):
    rows = [(i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "batch BIGINT, x BIGINT")
    got = [r["x"] for r in stats.running_totals(df, "batch", ["x"], span=13).orderBy("batch").collect()]
    total, want = 0, []
    for _, x in rows:
        total += x
        want.append(total)
    assert got == want


def test_snippet_equals_loop(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é \n\t") for _ in range(rng.randrange(0, 120))) for _ in range(300)]

    def loop(text, limit=40):
        text = text.strip()
        if len(text) <= limit:
            return text
        out = ""
        for word in text.split():
            if len(out) + len(word) + 1 > limit:
                break
            out += word + " "
        return out.strip() + "..."

    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", tx.snippet(F.col("t"), 40).alias("s"))
    got = {r["i"]: r["s"] for r in df.collect()}
    assert got == {i: loop(t) for i, t in enumerate(texts)}


def test_host_suffixes(spark):
    hosts = ["a", "a.b", "a.b.c", "w.x.y.z"]
    df = spark.createDataFrame([(h,) for h in hosts], "h STRING").select("h", urls.host_suffixes(F.col("h")).alias("s"))
    for row in df.collect():
        labels = row["h"].split(".")
        assert row["s"] == [row["h"]] + [".".join(labels[i:]) for i in range(1, len(labels) - 1)]


def test_mined_vocabulary_is_that_of_all_terms(spark, monkeypatch):
    """Level by level gives the same terms and counts as counting every n-gram, with far fewer rows."""
    rng = random.Random(5)
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}xy" for i in range(150)]
    rows = [(i, rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "k INT, tokens ARRAY<STRING>").cache()
    counted = []
    real = features._counted
    monkeypatch.setattr(features, "_counted", lambda d, k, g: (counted.append(d.select(F.sum(F.size(g))).first()[0]), real(d, k, g))[1])
    n = features.document_count(docs)
    every = features.term_counts(docs, "k", stop_words=words[:2])
    for low, size, min_df, max_df in ((1, 40, 2, 0.9), (1, 40, 2, 0.2), (2, 30, 3, 0.9), (1, 100_000, 2, 0.9), (1, 5, 1, 0.5)):
        counts = every.filter(F.size(F.split("term", " ")) >= low)
        want = features.select_vocabulary(counts, n, min_df, max_df, size)
        got = features.mine_vocabulary(docs, "k", n, low, 3, words[:2], min_df, max_df, size)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
        if size == 40:
            assert sum(counted) < 0.5 * every.agg(F.sum("tf")).first()[0]
        counted.clear()
    monkeypatch.setattr(features, "_LISTED", 3)  # too many terms to list: nothing is pruned, the result is the same
    got = features.mine_vocabulary(docs, "k", n, size=40)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in features.select_vocabulary(
        features.term_counts(docs, "k"), n, size=40).collect()]


def test_terms_are_counted_without_a_sort(spark):
    """Documents and occurrences of each term, also of empty and repeated documents; no list is sorted in its row."""
    rng = random.Random(8)
    rows = [(i % 7, rng.choices("abcdef", k=rng.randrange(0, 9))) for i in range(60)] + [(None, ["a", "a"]), (1, None)]
    docs = spark.createDataFrame(rows, "k INT, tokens ARRAY<STRING>")
    got = features._counted(docs, "k", F.col("tokens"))
    lists = [r or [] for _, r in rows]
    assert {tuple(r) for r in got.collect()} == {
        (t, sum(t in r for r in lists), sum(r.count(t) for r in lists)) for t in "abcdef"}
    assert "sort_array" not in got._jdf.queryExecution().toString()


def test_ngrams_of_a_long_text(spark):
    """Linear in the words: 20,000 of them with a stop-word filter take seconds."""
    rows = spark.createDataFrame([(1, [f"word{i % 977}" for i in range(20_000)])], "k INT, tokens ARRAY<STRING>")
    terms = features.with_ngrams(rows, ["word1", "word5"]).select(F.size("terms")).first()[0]
    kept = 20_000 - sum(i % 977 in (1, 5) for i in range(20_000))
    assert terms == 3 * kept - 3
