"""Page identifiers that a replay derives again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_from_hash(url_hash: Column) -> Column:
    """The first 32 hex digits of a hash in the 8-4-4-4-12 form."""
    return F.regexp_replace(F.substring(url_hash, 1, 32),
                            "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
