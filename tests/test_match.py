"""Queries are matched beside each page, and by shuffles when they have very many terms: the same rows."""

import random
import re

from pyspark.sql import functions as F

from blogindex.operators import search
from blogindex.plans import catalog
from tests.test_plans import plan

POSTINGS = "lexeme STRING, id STRING, positions ARRAY<STRUCT<pos: INT, w: STRING>>"


def _tables(spark, shared):
    """Postings, queries, and pages; some pages occur twice if shared."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    postings = []
    for page in range(60):
        for _ in range(2 if shared and page % 4 == 0 else 1):
            for word in rng.sample(words[:10], rng.randrange(1, 8)):
                places = sorted(rng.sample(range(1, 40), rng.randrange(1, 4)))
                postings.append((word, f"p{page}", [(p, rng.choice("ABCD")) for p in places]))
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i in range(80)]
    pages = [(f"p{p}", f"u{p}") for p in range(50) for _ in range(2 if shared and p % 6 == 0 else 1)]
    return (spark.createDataFrame(postings, POSTINGS).cache(), search.parse_queries(
        spark.createDataFrame([*queries, (None, "w1 w2")], "query_id BIGINT, q STRING")).cache(),
        spark.createDataFrame(pages, "id STRING, url STRING").cache())


def _rows(df):
    hits = [F.sort_array("hits").alias("hits")] if "hits" in df.columns else []
    return sorted(map(repr, df.filter("query_id IS NOT NULL").select(*[c for c in df.columns if c != "hits"], *hits).collect()))


def test_few_and_many_terms_match_the_same_pages(spark, monkeypatch):
    for shared in (False, True):
        postings, parsed, pages = _tables(spark, shared)
        ways = [lambda: search.match_pages(postings, parsed), lambda: search.match_pages(postings, parsed, "id", pages),
                lambda: search.match(postings, parsed), lambda: search.match(postings, parsed, "id", pages),
                lambda: search.rank(search.match(postings, parsed, "id", pages)).withColumn("rank", F.round("rank", 9))]
        few = [_rows(way()) for way in ways]
        with monkeypatch.context() as m:
            m.setattr(search, "_BROADCAST_TERMS", 0)
            assert few == [_rows(way()) for way in ways]
        assert all(few)


def test_pairs_of_query_and_page_are_not_shuffled(spark):
    postings, parsed, pages = _tables(spark, False)
    for found in (search.match(postings, parsed, "id", pages), search.match_pages(postings, parsed, "id", pages)):
        assert not re.search(r"hashpartitioning\(query_id#\d+L, id#|hashpartitioning\(lexeme#\d+, id#", plan(found))


def test_addresses_reach_the_pairs_without_a_shuffle(spark):
    """The outermost join of match and rank sends the queries to the pages; the addresses are there already."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        for name in ("match", "rank"):
            assert re.search(r"\w+Join", plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")))[0] == "BroadcastHashJoin"
    finally:
        spark.conf.set(key, before)


def test_positions_move_as_numbers(spark):
    """To their page; there they are pairs of position and letter again, large ones and other letters too."""
    postings, parsed, pages = _tables(spark, False)
    assert "shiftleft" in plan(search.match(postings, parsed, "id", pages))
    places = [(1, "A"), (7, "D"), (2_147_483_647, "B"), (2_147_483_646, "C"), (9, None)]
    rows = spark.createDataFrame([(places,), ([],), (None,)], "p ARRAY<STRUCT<pos: INT, w: STRING>>")
    got = rows.select("p", search._unpacked(search._packed(F.col("p"))).alias("q")).collect()
    assert len(got) == 3 and all(r["p"] == r["q"] for r in got)


def _fold(occurrences):
    """The covers of two lexemes, keeping the last place of each."""
    costs, last, spent, start, total = {"A": 2, "B": 5, "C": 10, "D": 20}, {}, 0, 0, 0.0
    for i, (pos, slot, w) in enumerate(sorted(occurrences, key=lambda o: (o[0], o[1], costs[o[2]]))):
        last[slot] = (pos, i, spent)
        spent += costs[w]
        first = min(last.values())
        if len(last) == 2 and first[0] > start:
            k, start = i + 1 - first[1], first[0]
            noise = pos - first[0] - (k - 1)
            total += k / ((spent - first[2]) / 2) / (1 + ((k - 1) // 2 if noise < 0 else noise))
    return total


def test_two_lexemes_rank_as_any_number(spark):
    """Also where positions are shared, as those pressed together are, and where they are large."""
    rng = random.Random(9)
    rows, want = [], {}
    for case in range(300):
        places = rng.choice([range(1, 12), range(1, 200), range(2_147_483_600, 2_147_483_647)])
        hits = [(s, [(p, rng.choice("ABCD")) for p in sorted(rng.choices(places, k=rng.randrange(1, 12)))]) for s in (0, 1)]
        want[case] = _fold([(p, s, w) for s, ps in hits for p, w in ps])
        rows.append((case, "x", 2, hits))
    df = spark.createDataFrame(rows, "query_id INT, id STRING, n INT, hits ARRAY<STRUCT<slot: INT, positions: ARRAY<STRUCT<pos: INT, w: STRING>>>>")
    assert {r["query_id"]: r["rank"] for r in search.rank(df).collect()} == want
    assert "array_sort" not in plan(search.rank(df))
