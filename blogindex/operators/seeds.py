"""Seed repair: fallback addresses per seed and the first one that works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blogindex.functions import urls


def seed_candidates(df: DataFrame, col: str = "seed") -> DataFrame:
    """(seed, ord, candidate): addresses to try for a seed, in order, each once."""
    seed = F.col(col)
    full = F.when(seed.contains("://"), seed).otherwise(F.concat(F.lit("http://"), seed))
    host = F.lower(urls.hostname(full))
    path = F.regexp_extract(full, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, ";[^/]*$", "")
    labels = F.split(host, r"\.")
    parent = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), "."))
    secure = F.lower(full).startswith("https://")
    parts = df.select(seed.alias("seed"), host.alias("host"), path.alias("path"),
                      parent.alias("parent"), secure.alias("secure"))

    def of(scheme):
        return [
            F.when(~F.col("path").isin("", "/"), F.concat(scheme, "host", "path")),
            F.concat(scheme, "host"),
            F.concat(scheme, "parent"),
        ]

    first = F.when(F.col("secure"), "https://").otherwise("http://")
    second = F.when(F.col("secure"), "http://").otherwise("https://")
    tried = F.filter(F.array(*of(first), *of(second)), lambda u: u.isNotNull())
    return (parts.filter(F.col("host") != "")
            .select("seed", F.posexplode(tried).alias("ord", "candidate")))


def resolve_seeds(candidates: DataFrame, fetch_status: DataFrame) -> DataFrame:
    """(seed, working, error): the first candidate that works, else the last error."""
    status = fetch_status.select(F.col("url").alias("candidate"), "ok", "error")
    tried = candidates.join(status, "candidate", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    found = tried.groupBy("seed").agg(
        F.min_by(F.when(ok, F.col("candidate")), F.when(ok, F.col("ord"))).alias("working"),
        F.max_by("error", "ord").alias("last_error"))
    return found.select(
        "seed", "working",
        F.when(F.col("working").isNull(), F.coalesce("last_error", F.lit("Unknown error")))
        .alias("error"))


def write_working_seeds(resolved: DataFrame, path: str) -> None:
    """The working addresses as a line list."""
    resolved.filter("working IS NOT NULL").select("working").write.mode("overwrite").text(path)
