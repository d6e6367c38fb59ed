"""Projections of search results for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.functions import urls


def _filled(name: str, other: Column) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), other)


def result_cards(results: DataFrame, *keep: str) -> DataFrame:
    """Domain, title, description, UTC date and rounded score of each result."""
    return results.select(
        *keep, "url", _filled("domain", urls.hostname(F.col("url"))).alias("domain"),
        _filled("title", F.lit("Untitled")).alias("title"),
        _filled("description", F.col("content_summary")).alias("description"),
        F.date_from_unix_date(F.floor(F.col("created_at") / 86400).cast("int")).alias("created"),
        "word_count", F.round("rank", 3).alias("score"))


def shown_range(df: DataFrame) -> DataFrame:
    """First and last result number of a page (total, page, per_page)."""
    return df.withColumns({
        "shown_from": ((F.col("page") - 1) * F.col("per_page") + 1).cast("bigint"),
        "shown_to": F.least(F.col("page") * F.col("per_page"), F.col("total")).cast("bigint")})


def page_window(df: DataFrame) -> DataFrame:
    """Page buttons for (total, page, per_page); none when one page holds all.

    first and last are set where a button for that page stands outside the window,
    gap_before and gap_after where a mark stands between it and the window.
    """
    many = F.col("total") > F.col("per_page")
    pages = F.ceil(F.col("total") / F.col("per_page")).cast("bigint")
    low = F.greatest(F.lit(1), F.col("page") - 2).cast("bigint")
    high = F.least(pages, F.col("page") + 2).cast("bigint")
    numbers = F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)"))
    out = {
        "pages": pages, "window": F.array_join(numbers.cast("array<string>"), " "),
        "first": low > 1, "gap_before": low > 2,
        "last": high < pages, "gap_after": high < pages - 1,
    }
    return df.withColumns({k: F.when(many, v) for k, v in out.items()})


def terminal_listing(results: DataFrame) -> DataFrame:
    """Text form of the operators' search, in order of its position."""
    short = F.when(F.length("description") > 100, F.concat(F.left("description", F.lit(100)), F.lit("...")))
    return results.select(
        "position", _filled("title", F.lit("No title")).alias("title"), "url", "domain",
        _filled("author", F.lit("Unknown")).alias("author"), "word_count",
        F.format_string("%.4f", F.col("rank")).alias("rank"),
        F.nullif(F.coalesce(short, F.col("description")), F.lit("")).alias("description")).orderBy("position")
