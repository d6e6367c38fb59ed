"""Lists inside rows: unnesting and grouping without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, entries: str, *keep: str) -> DataFrame:
    """One row per struct of the list, with the kept columns.

    The outer form is used, and the row of an empty list dropped after it: for the inner
    form the optimizer adds a filter on the list's size below the projections, which
    computes the whole list twice.
    """
    fields = df.schema[entries].dataType.elementType.fieldNames()
    return df.select(*keep, F.inline_outer(entries)).filter(F.col(fields[0]).isNotNull())


def runs(df: DataFrame, entries: str, field: str, value: Callable[[Column], Column], name: str) -> DataFrame:
    """One row per distinct field value of each row's list of structs.

    Sorts the list and cuts it where the field changes. value makes a column out of the
    run, a list of structs in order; the other columns of the row are kept. The field may
    not be null.
    """
    rest = [c for c in df.columns if c != entries]
    ordered = df.select(*rest, F.sort_array(entries).alias("_sorted"))
    s = F.col("_sorted")
    starts = F.filter(F.transform(s, lambda e, i: F.when(
        (i == 0) | (e[field] != F.try_element_at(s, i)[field]), i + 1)), lambda i: i.isNotNull())
    cut = ordered.withColumn("_starts", starts)
    at = F.col("_starts")
    pieces = F.transform(at, lambda start, j: F.struct(
        F.element_at(s, start)[field].alias(field),
        value(F.slice(s, start, F.coalesce(F.try_element_at(at, j + 2), F.size(s) + 1) - start)).alias(name)))
    return unnest(cut.select(*rest, pieces.alias("_pieces")), "_pieces", *rest)
