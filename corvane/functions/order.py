"""Text order. Collation is for sorting only: a collated column would change what joins and groups call equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uni(column) -> Column:
    """Sort key of human order (letters before case), by the Unicode collation."""
    return F.collate(F.col(column) if isinstance(column, str) else column, "UNICODE")


def human(*columns) -> list[Column]:
    """Order-by list: collated, with the plain text to break ties."""
    out = []
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        out += [uni(c), c]
    return out


def ordered(value, *keys) -> Column:
    """Aggregate: an array of `value` in the order of the keys."""
    fields = [k.alias(f"k{i}") if isinstance(k, Column) else F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*fields, value.alias("v")))), lambda s: s["v"])
