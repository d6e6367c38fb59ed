"""Where a scored page goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.functions import urls
from blogindex.operators.frontier import expand_links

BLACKLIST, INDEX, FOLLOW = "blacklist", "index", "follow"


def route_of(p_not: Column, threshold: float) -> Column:
    """Rejection is tested first, so a low threshold also takes pages fit for the index."""
    return F.when(p_not >= threshold, BLACKLIST).when(p_not <= 0.5, INDEX).otherwise(FOLLOW)


def route(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("route", route_of(F.col("p_not"), threshold))


def blacklist_domains(routed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(domain): authorities of rejected pages, with those already known."""
    new = routed.filter(F.col("route") == BLACKLIST).select(urls.netloc(F.col("location")).alias("domain"))
    return (new if known is None else new.union(known.select("domain"))).distinct()


def index_pages(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route") == INDEX)


def route_outlinks(routed: DataFrame, *keep: str) -> DataFrame:
    """Links of pages that are indexed or followed."""
    return expand_links(routed.filter(F.col("route") != BLACKLIST), *keep)


def route_counts(routed: DataFrame) -> DataFrame:
    """(route, percent, pages): pages per route and whole percent of p_not."""
    percent = F.floor(F.col("p_not") * 100).cast("bigint")
    return routed.groupBy("route", percent.alias("percent")).agg(F.count("*").alias("pages"))
