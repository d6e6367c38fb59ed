"""Queries are matched and ranked beside whole pages: the same rows as pair by pair."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blogindex.operators import covers, search
from blogindex.plans import catalog
from tests.test_match import _fold, _rows, _tables
from tests.test_plans import plan

COSTS = {"A": 2, "B": 5, "C": 10, "D": 20}


@pytest.mark.parametrize("shared", [False, True])
def test_pages_rank_as_pairs(spark, shared, monkeypatch):
    """Also where pages share a key, or come twice; in parts of any size."""
    postings, parsed, pages = _tables(spark, shared)
    want = _rows(search.rank(search.match(postings, parsed, "id", pages)).withColumn("rank", F.round("rank", 9)))
    for rows, some in ((50_000, 100_000), (1, 1)):
        monkeypatch.setattr(covers, "ROWS", rows)
        monkeypatch.setattr(covers, "OCCURRENCES", some)
        by_page = search.match(postings, parsed, "id", pages, by_page=True)
        assert by_page.pages.count() <= pages.select("id").distinct().count()
        got = search.rank(by_page).withColumn("rank", F.round("rank", 9))
        assert want and _rows(got) == want


def test_no_query_is_known(spark):
    postings, _, pages = _tables(spark, False)
    parsed = search.parse_queries(spark.createDataFrame([(1, "nowhere")], "query_id BIGINT, q STRING"))
    assert search.rank(search.match(postings, parsed, "id", pages, by_page=True)).count() == 0


def test_covers_equal_a_scan():
    """Of one to six lexemes, shared places and places that fill a number; a lexeme without a list is no cover."""
    rng = random.Random(3)
    lists, at, n, want = [], [], [], []
    for case in range(600):
        size = rng.randrange(1, 7)
        places = rng.choice([range(1, 12), range(1, 200), range(2_147_483_600, 2_147_483_647)])
        hits = [(s, [(p, rng.choice("ABCD")) for p in sorted(rng.choices(places, k=rng.randrange(1, 9)))]) for s in range(size)]
        gone = size > 1 and case % 10 == 0
        for s, positions in hits:
            at.append(-1 if gone and s == 0 else len(lists))
            lists.append([p << 3 | "ABCD".index(w) + 1 for p, w in positions])
        n.append(size)
        occurrences = [(p, s, w) for s, ps in hits for p, w in ps]
        want.append(0.0 if gone else _fold(occurrences) if size == 2 else sum(2 / COSTS[w] for _, _, w in sorted(occurrences))
                    if size == 1 else _scan(occurrences, size))
    got = covers.cover_ranks(pa.array(lists, pa.list_(pa.int64())), np.array(at), np.array(n), np.ones(len(n), np.int64),
                             np.array([np.nan, *COSTS.values()]))
    assert got == pytest.approx(want, rel=1e-12)


def _scan(occurrences, n):
    """Every span that ends at an occurrence and begins at the earliest of the last places of all lexemes."""
    ordered, start, total = sorted(occurrences, key=lambda o: (o[0], o[1], COSTS[o[2]])), 0, 0.0
    for i in range(len(ordered)):
        last = {s: j for j, (_, s, _) in enumerate(ordered[:i + 1])}
        if len(last) < n:
            continue
        first = min(last.values())
        if ordered[first][0] > start:
            start, k = ordered[first][0], i - first + 1
            noise = ordered[i][0] - start - (k - 1)
            total += k / (sum(COSTS[w] for _, _, w in ordered[first:i + 1]) / 2) / (1 + ((k - 1) // 2 if noise < 0 else noise))
    return total


def test_best_keeps_all_that_may_win():
    """Ties stay, and a rank that so many rows of an earlier part reach rules out what is below."""
    least = np.full(2, -np.inf)
    query, rank = np.array([0, 0, 0, 0, 1]), np.array([3.0, 2.0, 2.0 - 1e-9, 1.0, 0.5])
    assert covers._among_best(query, rank, 2, least).tolist() == [0, 1, 2, 4]
    assert covers._among_best(np.array([0, 1, 0]), np.array([1.9, 0.1, 2.5]), 2, least).tolist() == [1, 2]


def test_best_gives_the_same_first_rows(spark):
    postings, parsed, pages = _tables(spark, False)
    found = search.match(postings, parsed, "id", pages, by_page=True)
    every, some = (search.rank(found, best=b).groupBy("query_id").agg(F.slice(F.sort_array(
        F.collect_list(F.round("rank", 9)), asc=False), 1, 3).alias("top")) for b in (None, 3))
    assert sorted(map(repr, every.collect())) == sorted(map(repr, some.collect()))


def test_pairs_are_not_folded_one_by_one(spark):
    text = plan(catalog.QUERIES["rank"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in text and "aggregate(" not in text


def test_only_the_pages_of_winners_are_cut_to_snippets(spark):
    """The filter on the winners' ids lies below the projection that works on the texts."""
    text = plan(catalog.QUERIES["search_ranked"](spark, "/root/testdata/sf0.001"))
    tree = text[:text.index("(1) ")]
    assert tree.index("LeftSemi") > tree.index("Project", tree.index("Join"))


def test_winners_are_ranked_once(spark):
    """The filter and the join that read them share the shuffle before the window."""
    found = catalog.QUERIES["search_ranked"](spark, "/root/testdata/sf0.001")
    assert found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text[:text.index("Initial Plan")].count("MapInArrow") == 2
