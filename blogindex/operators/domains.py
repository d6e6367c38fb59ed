"""Domain filters over URL columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blogindex.functions import urls


def blocked_hosts(df: DataFrame, domains: DataFrame, url_col: str) -> DataFrame:
    """(host): lower-cased hosts that are listed, or whose parent of two or more labels is.

    Works on the distinct hosts, so a host with many rows is matched once.
    """
    hosts = df.select(F.lower(urls.hostname(F.col(url_col))).alias("host")) \
        .filter("host <> ''").distinct()
    return (hosts.select("host", F.explode(urls.host_suffixes(F.col("host"))).alias("domain"))
            .join(domains.select(F.lower("domain").alias("domain")).distinct(),
                  "domain", "left_semi")
            .select("host").distinct())


def block_domains(df: DataFrame, domains: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose host the static list does not block; rows without a host pass."""
    key = F.lower(urls.hostname(F.col(url_col)))
    return (df.withColumn("_host", key)
            .join(blocked_hosts(df, domains, url_col).withColumnRenamed("host", "_host"),
                  "_host", "left_anti")
            .drop("_host"))


def _set_key(df: DataFrame, key: str):
    """How a dynamic blacklist entry compares: as written, or as a bare lower-case host."""
    entry = F.col("domain")
    if key == "exact":
        return df.select(entry.alias("_host")).distinct()
    if key == "hostname":
        return df.select(F.lower(urls.hostname(F.concat(F.lit("//"), entry))).alias("_host")).distinct()
    raise ValueError(f"unknown blacklist key: {key}")


def blacklist_key(url_col: str, key: str):
    host = urls.hostname(F.col(url_col))
    return F.lower(host) if key == "hostname" else host


def drop_blacklisted(df: DataFrame, blacklist: DataFrame | None, url_col: str = "url",
                     key: str = "exact") -> DataFrame:
    """Rows whose host is not in the dynamic set; without a set all rows pass."""
    if blacklist is None:
        return df
    return (df.withColumn("_host", blacklist_key(url_col, key))
            .join(_set_key(blacklist, key), "_host", "left_anti").drop("_host"))


def blacklist_entries(blacklist: DataFrame, key: str = "exact") -> DataFrame:
    return _set_key(blacklist, key)
