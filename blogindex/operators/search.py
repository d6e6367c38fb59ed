"""Ranked search for batches of queries over postings and pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from blogindex.functions import text as tx
from blogindex.operators import covers
from blogindex.operators.index import WEIGHTS, analyze

# Result rows that are sent to the wide columns; more meet them by a shuffle.
_BROADCAST_WINNERS = 100_000
# Query terms that are sent to the pages; more meet them by shuffles.
_BROADCAST_TERMS = 200_000
# Twice the reciprocal of each field weight is a whole number, so its sums are exact.
_TWICE_INVERSE = {letter: round(2 / weight) for letter, weight in WEIGHTS.items()}


def _order() -> list[Column]:
    """Best first; sums of the same covers in another order differ in the last digits, and such ranks are equal."""
    return [F.desc(F.round("rank", 9)), F.desc("created_at"), F.asc("url")]


def parse_queries(queries: DataFrame, config: str = "simple", stop_words: list[str] | None = None
                  ) -> DataFrame:
    """(query_id, lexeme, slot, n): distinct lexemes of each query, numbered, and their count.

    A query of only stop words has no row and so matches nothing.
    """
    terms = analyze(queries, "query_id", F.col("q"), config, stop_words) \
        .groupBy("query_id").agg(F.array_sort(F.collect_set("lexeme")).alias("_t"))
    return terms.select("query_id", F.size("_t").alias("n"),
                        F.posexplode("_t").alias("slot", "lexeme")) \
        .select("query_id", "lexeme", "slot", "n")


def lookup(postings: DataFrame, parsed: DataFrame, max_terms: int = 2000) -> DataFrame:
    """Postings of the query lexemes; a small term list becomes a scan filter.

    The list is read with a limit. Longer lists are left to the join alone.
    """
    terms = [r["lexeme"] for r in parsed.select("lexeme").distinct().limit(max_terms + 1).collect()]
    return postings.filter(F.col("lexeme").isin(terms)) if len(terms) <= max_terms else postings


def _ordered(postings: DataFrame, parsed: DataFrame, lexemes: DataFrame) -> DataFrame:
    """The terms of the queries whose lexemes all occur, with _at, their number from the rarest on."""
    often = postings.select("lexeme").join(lexemes, "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("_df"))
    query = Window.partitionBy("query_id")
    return parsed.join(often, "lexeme").withColumns({
        "_at": F.row_number().over(query.orderBy("_df", "slot")), "_known": F.count("*").over(query)}).filter("_known = n")


def _by_rarest(postings: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """(query_id, key, n): the pages of each query's rarest lexeme, looked up in the lists of its others."""
    narrow, ordered = postings.select("lexeme", key), _ordered(postings, parsed, parsed.select("lexeme").distinct())
    rarest = narrow.join(ordered.filter("_at = 1").select("query_id", "lexeme", "n"), "lexeme").select("query_id", key, "n")
    others = rarest.join(ordered.filter("_at > 1").select("query_id", "lexeme"), "query_id")
    held = others.join(narrow, ["lexeme", key], "left_semi").groupBy("query_id", key) \
        .agg(F.first("n").alias("n"), F.count("*").alias("_found")).filter("_found = n - 1").drop("_found")
    return rarest.filter("n = 1").unionByName(held)


def _few(parsed: DataFrame) -> bool:
    """Whether the queries can be sent to the pages; they are read with a limit."""
    return parsed.select("lexeme").limit(_BROADCAST_TERMS + 1).count() <= _BROADCAST_TERMS


def _by_page(postings: DataFrame, parsed: DataFrame, key: str, extra: list[str],
             only: Callable[[DataFrame], DataFrame] = lambda pages: pages) -> DataFrame:
    """Each query beside each page that holds all its lexemes: (query_id, n, _terms, key, _held, _words, _twice, _copies, ...).

    Only the postings of query lexemes move, once, to their page; _held is the page's list of
    (lexeme, extra). The queries are sent to the pages: a page meets those whose rarest lexeme it
    holds, so no pair of query and page is shuffled. The hash of the second rarest lexeme
    rules out most queries before the page's list is copied; all lexemes are then compared.
    A key that several pages share (_twice) counts the pages of the rarest lexeme in _copies.
    """
    lexemes = F.broadcast(parsed.select("lexeme").distinct())
    terms = _ordered(postings, parsed.filter("query_id IS NOT NULL"), lexemes).groupBy("query_id", "n").agg(
        F.array_sort(F.collect_list(F.struct("_at", "lexeme", "slot"))).alias("_terms")).select(
        "query_id", "n", "_terms", F.col("_terms")[0]["lexeme"].alias("_rarest"),
        F.xxhash64(F.element_at("_terms", F.least("n", F.lit(2)))["lexeme"]).alias("_second"))
    held = only(postings.join(lexemes, "lexeme", "left_semi").groupBy(key)
                .agg(F.collect_list(F.struct("lexeme", *extra)).alias("_held")))
    kept, words = [*held.columns, "_words"], F.col("_words")
    own = held.withColumn("_words", F.col("_held")["lexeme"]).withColumns({
        "_hashes": F.transform(words, lambda w: F.xxhash64(w)), "_twice": F.size(F.array_distinct(words)) < F.size(words)})
    met = own.select(*kept, "_hashes", "_twice", F.explode(F.array_distinct(words)).alias("_lexeme")).join(
        F.broadcast(terms), (F.col("_lexeme") == F.col("_rarest")) & (F.col("_twice") | F.array_contains("_hashes", F.col("_second"))))
    copies = F.when(F.col("_twice"), F.size(F.filter(words, lambda w: w == F.col("_rarest")))).otherwise(1)
    found = F.size(F.filter(F.slice("_terms", 2, F.col("n")), lambda t: F.array_contains(words, t["lexeme"])))
    return met.select("query_id", "n", "_terms", *kept, "_twice", copies.alias("_copies")) \
        .filter((F.col("n") == 1) | (F.col("_copies") * found == F.col("n") - 1))


def match_pages(postings: DataFrame, parsed: DataFrame, key: str = "id", pages: DataFrame | None = None) -> DataFrame:
    """(query_id, key, n): pages that hold every lexeme of the query; no position is read.

    Only pages that are also in pages count if it is given. A query with a lexeme that no page
    holds is out at once. As long as the queries have few terms they are sent to the pages; more
    meet the pages of their rarest lexeme by shuffles.
    """
    def only(df: DataFrame) -> DataFrame:
        return df if pages is None else df.join(pages, key, "left_semi")

    if not _few(parsed):
        return only(_by_rarest(postings, parsed, key)).select("query_id", key, "n")
    each = F.array_repeat("n", F.when(F.col("n") == 1, F.col("_copies")).otherwise(1))
    return _by_page(postings, parsed, key, [], only).select("query_id", key, F.explode(each).alias("n"))


def with_positions(matches: DataFrame, postings: DataFrame, parsed: DataFrame, key: str = "id") -> DataFrame:
    """The matches with hits: one (slot, positions) per lexeme of the query."""
    others = [c for c in matches.columns if c not in ("query_id", key)]
    wanted = matches.join(parsed.select("query_id", "lexeme", "slot"), "query_id")
    return wanted.join(postings.select("lexeme", key, "positions"), ["lexeme", key]).groupBy("query_id", key).agg(
        *[F.first(c).alias(c) for c in others], F.collect_list(F.struct("slot", "positions")).alias("hits"))


def _packed(positions: Column) -> Column:
    """Each (pos, w) as one long number; a struct with a string takes many times as many bytes where it moves."""
    letters = F.array(*[F.lit(w) for w in WEIGHTS])
    return F.transform(positions, lambda p: F.shiftleft(p["pos"].cast("bigint"), 3).bitwiseOR(
        F.coalesce(F.array_position(letters, p["w"]), F.lit(0))))


def _unpacked(positions: Column) -> Column:
    letters = F.array(*[F.lit(w) for w in WEIGHTS])
    return F.transform(positions, lambda p: F.struct(
        F.shiftright(p, 3).cast("int").alias("pos"), F.get(letters, p.bitwiseAND(7).cast("int") - 1).alias("w")))


@dataclass(frozen=True)
class PageMatches:
    """The pages (key, pages' columns, _lists, _found, _n, _times, _at) with the numbers of the queries
    they hold, as covers.matched gives them, and the queries (_q, query_id). A page is one row."""
    pages: DataFrame
    queries: DataFrame
    key: str
    added: list[str]


def _match_by_page(postings: DataFrame, parsed: DataFrame, key: str, pages: DataFrame) -> PageMatches:
    """The queries, at most _BROADCAST_TERMS terms, come to the driver and go to the tasks; only the postings of
    their lexemes move, with numbers instead of words."""
    spark = postings.sparkSession
    known = _ordered(postings, parsed.filter("query_id IS NOT NULL"), F.broadcast(parsed.select("lexeme").distinct())) \
        .groupBy("query_id", "n").agg(F.array_sort(F.collect_list(F.struct("slot", "_at", "lexeme"))).alias("_terms")) \
        .select("query_id", "n", F.col("_terms")["_at"].alias("_at"), F.col("_terms")["lexeme"].alias("lexeme")).toArrow()
    flat = pc.list_flatten(known["lexeme"]).combine_chunks().dictionary_encode()
    lexemes, terms = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    compiled = spark.sparkContext.broadcast(covers.Queries.of(
        known["n"].to_numpy().astype(np.int64), terms, pc.list_flatten(known["_at"]).to_numpy(), len(lexemes)))
    numbers = spark.createDataFrame(pa.table({"lexeme": lexemes.cast(pa.string()), "_no": pa.array(range(len(lexemes)), pa.int32())}))
    names = spark.createDataFrame(pa.table({"_q": pa.array(range(known.num_rows), pa.int32()), "query_id": known["query_id"]}))
    added = [c for c in pages.columns if c != key]
    held = postings.join(F.broadcast(numbers), "lexeme").select(key, "_no", _packed(F.col("positions")).alias("positions"))
    rows = held.unionByName(pages.withColumn("_no", F.lit(-1)), allowMissingColumns=True).filter(F.col(key).isNotNull()) \
        .repartition(key).sortWithinPartitions(key, "_no")
    out = StructType([rows.schema[c] for c in (key, *added)])
    for c, kind in (("_lists", ArrayType(LongType())), *[(c, IntegerType()) for c in ("_found", "_n", "_times", "_at")]):
        out = out.add(c, ArrayType(kind))
    arrow = to_arrow_schema(out)
    found = rows.mapInArrow(lambda batches: covers.matched(batches, key, compiled.value, arrow), out)
    return PageMatches(found, names, key, added)


def match(postings: DataFrame, parsed: DataFrame, key: str = "id", pages: DataFrame | None = None,
          by_page: bool = False) -> DataFrame | PageMatches:
    """(query_id, key, n, hits): pages that hold every lexeme of the query.

    Only pages that are also in pages count if it is given, and its columns are added. hits is
    one (slot, positions) per lexeme, so a row is bounded by the query's lexemes. Positions
    move to their page as numbers. by_page, for rank, gives the same matches of the given pages as
    a row per page, as long as the queries have few terms.
    """
    few = _few(parsed)
    if few and by_page and pages is not None:
        return _match_by_page(postings, parsed, key, pages)
    if not few:
        found = _by_rarest(postings, parsed, key)
        return with_positions(found if pages is None else found.join(pages, key), postings, parsed, key)
    added = [] if pages is None else [c for c in pages.columns if c != key]

    def only(df: DataFrame) -> DataFrame:
        df = df.withColumn("_held", F.transform("_held", lambda h: F.struct(
            h["lexeme"].alias("lexeme"), _unpacked(h["positions"]).alias("positions"))))
        if pages is None:
            return df.withColumn("_rows", F.lit(1))
        return df.join(pages.groupBy(key).agg(*[F.first(c).alias(c) for c in added], F.count("*").cast("int").alias("_rows")), key)

    packed = postings.withColumn("positions", _packed(F.col("positions")))
    both, held = _by_page(packed, parsed, key, ["positions"], only), F.col("_held")

    def place(slot: Column, positions: Column) -> Column:
        return F.struct(slot.alias("slot"), positions.alias("positions"))

    one = F.transform("_terms", lambda t: place(t["slot"], F.get(held, F.array_position("_words", t["lexeme"]).cast("int") - 1)["positions"]))
    several = F.flatten(F.transform("_terms", lambda t: F.transform(
        F.filter(held, lambda h: h["lexeme"] == t["lexeme"]), lambda h: place(t["slot"], h["positions"]))))
    times = F.col("_rows") * F.when(F.col("n") == 1, F.col("_copies")).otherwise(1)
    hits = F.when(F.col("_twice") | (times > 1), F.flatten(F.array_repeat(several, times))).otherwise(one)
    return both.select("query_id", key, "n", *added, hits.alias("hits"))


def _occurrences(hits: Column) -> Column:
    """All hits in order of (position, slot, cost), packed into long numbers of 31, 27 and 5 bits."""
    def cost(w: Column) -> Column:
        out = F.lit(None).cast("int")
        for letter, value in reversed(_TWICE_INVERSE.items()):
            out = F.when(w == letter, value).otherwise(out)
        return out

    # Numbers are sorted by their natural order; array_sort and structs are compared by expressions.
    return F.sort_array(F.flatten(F.transform(hits, lambda h: F.transform(h["positions"], lambda p: F.shiftleft(
        p["pos"].cast("bigint"), 32).bitwiseOR(h["slot"].cast("bigint") * 32 + cost(p["w"]))))))


def _pos(o: Column) -> Column:
    return F.shiftright(o, 32).cast("int")


def _slot(o: Column) -> Column:
    return F.shiftright(o.bitwiseAND(0xFFFFFFFF), 5).cast("int")


def _cost(o: Column) -> Column:
    return o.bitwiseAND(31).cast("int")


def _two_lexemes(occurrences: Column) -> Column:
    """The sum over covers of two lexemes: neighbours of different slots, unless a cover began at that position."""
    def state(before: Column, start: Column, total: Column) -> Column:
        return F.struct(before.alias("before"), start.alias("start"), total.alias("total"))

    def step(s: Column, o: Column) -> Column:
        before = s["before"]
        noise = F.greatest(_pos(o) - _pos(before) - 1, F.lit(0)).cast("double")
        score = F.lit(2.0) / ((_cost(before) + _cost(o)) / 2.0) / (1.0 + noise)
        new = (_slot(o.bitwiseXOR(before)) != 0) & (_pos(before) > s["start"])
        return F.when(new, state(o, _pos(before), s["total"] + score)).otherwise(state(o, s["start"], s["total"]))

    return F.aggregate(occurrences, state(F.lit(None).cast("bigint"), F.lit(0), F.lit(0.0).cast("double")),
                       step, lambda s: s["total"])


def cover_density(hits: Column, n: Column) -> Column:
    """Sum over covers, the minimal spans with every lexeme, of weight by density.

    One pass over the occurrences in order. For each lexeme the last place is kept with
    the running count and cost before it; the earliest of these starts the span that ends
    here, and it is a new cover if it starts later than the one before. Of one and two lexemes
    the same sums need no such list.
    """
    place = "struct<pos:int,seen:int,spent:int>"
    state = F.struct(
        F.array_repeat(F.lit(None).cast(place), n).alias("last"),
        F.lit(0).alias("seen"), F.lit(0).alias("spent"), F.lit(0).alias("start"),
        F.lit(0.0).cast("double").alias("total"))

    def step(s: Column, o: Column) -> Column:
        here = F.struct(_pos(o).alias("pos"), s["seen"].alias("seen"), s["spent"].alias("spent"))
        last = F.transform(s["last"], lambda p, i: F.when(i == _slot(o), here).otherwise(p))
        moved = F.struct(last.alias("last"), (s["seen"] + 1).alias("seen"),
                         (s["spent"] + _cost(o)).alias("spent"), s["start"].alias("start"),
                         s["total"].alias("total"), _pos(o).alias("end"))
        return F.transform(F.array(moved), close)[0]

    def close(m: Column) -> Column:
        full = ~F.exists(m["last"], lambda p: p.isNull())
        first = F.array_min(m["last"])
        new = full & (first["pos"] > m["start"])
        k = (m["seen"] - first["seen"]).cast("double")
        noise = (m["end"] - first["pos"]).cast("double") - (k - 1)
        noise = F.when(noise < 0, F.floor((k - 1) / 2).cast("double")).otherwise(noise)
        score = k / ((m["spent"] - first["spent"]) / 2.0) / (1.0 + noise)
        return F.struct(
            m["last"].alias("last"), m["seen"].alias("seen"), m["spent"].alias("spent"),
            F.when(new, first["pos"]).otherwise(m["start"]).alias("start"),
            F.when(new, m["total"] + score).otherwise(m["total"]).alias("total"))

    folded = F.aggregate(_occurrences(hits), state, step, lambda s: s["total"])
    single = F.aggregate(_occurrences(hits), F.lit(0.0).cast("double"),
                         lambda a, o: a + 2.0 / _cost(o))
    return F.when(n == 1, single).when(n == 2, _two_lexemes(_occurrences(hits))).otherwise(folded)


def rank(matches: DataFrame | PageMatches, key: str = "id", best: int | None = None) -> DataFrame:
    """The matches with their rank in place of n and hits.

    With best, matches by page that cannot be among so many best ones of their query may be left out.
    """
    if isinstance(matches, PageMatches):
        out = StructType([matches.pages.schema[c] for c in (matches.key, *matches.added)]).add("_q", IntegerType()).add("rank", DoubleType())
        arrow, costs, queries = to_arrow_schema(out), list(_TWICE_INVERSE.values()), matches.queries.count()
        ranks = matches.pages.mapInArrow(lambda batches: covers.ranked(batches, costs, best, queries, arrow), out)
        return ranks.join(F.broadcast(matches.queries), "_q").select("query_id", matches.key, *matches.added, "rank")
    others = [c for c in matches.columns if c not in ("query_id", key, "n", "hits")]
    return matches.select("query_id", key, *others,
                          cover_density(F.col("hits"), F.col("n")).alias("rank"))


def _page_filter(df: DataFrame, domain: str | None, min_words: int | None) -> DataFrame:
    """Filters an empty domain and a zero word count switch off."""
    if domain:
        df = df.filter(F.col("domain") == domain)
    if min_words:
        df = df.filter(F.col("word_count") >= min_words)
    return df


def ranked_hits(postings: DataFrame, pages: DataFrame, queries: DataFrame, config: str = "simple",
                domain: str | None = None, min_words: int | None = None,
                stop_words: list[str] | None = None, best: int | None = None) -> DataFrame:
    """(query_id, id, url, created_at, rank) of all hits that pass the filters; with best, at least of so many best of each query."""
    narrow = _page_filter(pages, domain, min_words).select("id", "url", "created_at")
    parsed = parse_queries(queries, config, stop_words)
    return rank(match(postings, parsed, "id", narrow, by_page=True), best=best)


def search_totals(postings: DataFrame, pages: DataFrame, queries: DataFrame, config: str = "simple",
                  domain: str | None = None, min_words: int | None = None,
                  stop_words: list[str] | None = None) -> DataFrame:
    """(query_id, total) of every query, 0 without hits; needs no rank."""
    narrow = _page_filter(pages, domain, min_words).select("id")
    parsed = parse_queries(queries, config, stop_words)
    found = match_pages(postings, parsed, "id", narrow) \
        .groupBy("query_id").agg(F.count("*").alias("total"))
    return queries.select("query_id").join(found, "query_id", "left") \
        .select("query_id", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


def search(postings: DataFrame, pages: DataFrame, queries: DataFrame, page: int = 1,
           per_page: int = 10, domain: str | None = None, min_words: int | None = None,
           config: str = "simple", stop_words: list[str] | None = None,
           texts: DataFrame | None = None) -> DataFrame:
    """One page of results per query, with position and snippet.

    Only the winners, at most per_page per query, meet the wide columns, of texts if it is
    given, else of the pages; as long as they are few they are broadcast to them. The
    ranking window keeps its top rows per map task before the shuffle, so a query that
    hits a large part of the corpus sends few rows.
    """
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page starts at 1, per_page lies in 1..100")
    first = (page - 1) * per_page
    hits = ranked_hits(postings, pages, queries, config, domain, min_words, stop_words, first + per_page)
    order = Window.partitionBy("query_id").orderBy(*_order())
    winners = (hits.withColumn("position", F.row_number().over(order))
               .filter((F.col("position") <= first + per_page) & (F.col("position") > first))
               .select("query_id", "position", "id", "rank"))
    wide = pages if texts is None else texts
    few = queries.count() * per_page <= _BROADCAST_WINNERS
    if few:
        # The ids go below what is worked out of the texts: that is done for the pages of winners only. The rank, never
        # negative, is asked for so that both uses of the winners have the same columns and share one shuffle.
        wide = wide.filter(F.col("id").isin(F.broadcast(winners.filter(F.coalesce("rank", F.lit(0.0)) >= 0).select("id"))))
    # A page is cut to its snippet once, however many queries it wins.
    wide = wide.select("id", "url", "title", "description", tx.snippet(F.col("content")).alias("content_summary"),
                       "domain", "word_count", "created_at")
    return wide.join(F.broadcast(winners) if few else winners, "id").select(
        "query_id", "position", "id", "url", "title", "description",
        "content_summary", "domain", "word_count", "created_at", "rank")


def search_pages(postings: DataFrame, pages: DataFrame, query: str, limit: int = 20, offset: int = 0,
                 config: str = "simple") -> DataFrame:
    """The operators' own search of one text, by position: adds the author, has no snippet."""
    queries = pages.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("q"))
    top = ranked_hits(postings, pages, queries, config, best=offset + limit).orderBy(*_order()).offset(offset).limit(limit)
    # Only the rows of one page are numbered: the limit comes first.
    top = top.select((F.row_number().over(Window.orderBy(*_order())) + offset).alias("position"), "id", "rank")
    return pages.select("id", "url", "title", "description", "author", "domain", "word_count",
                        "created_at").join(top, "id").orderBy("position")


def paging(totals: DataFrame, page: int, per_page: int) -> DataFrame:
    """The totals with page, per_page, has_next and has_prev."""
    return totals.withColumns({
        "page": F.lit(page), "per_page": F.lit(per_page),
        "has_next": F.lit((page - 1) * per_page + per_page) < F.col("total"),
        "has_prev": F.lit(page > 1)})


def search_results(pages: DataFrame) -> DataFrame:
    """All pages unranked: the rank against an empty query is 0."""
    return pages.select("id", "url", "title", "description", "author", "domain", "word_count",
                        "created_at", "indexed_at", F.lit(0.0).alias("rank"))
