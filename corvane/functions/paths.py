"""POSIX path functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    return F.regexp_extract(_col(path), "([^/]*)/*$", 1)


def dirname(path) -> Column:
    """The folder of a path, null at the top."""
    return F.nullif(F.regexp_extract(_col(path), "^(.*[^/])/+[^/]+/*$", 1), F.lit(""))


def extname(path) -> Column:
    """From the last dot of the last part on; empty for a name that has only a leading dot."""
    base = basename(path)
    return F.when(base == "..", "").otherwise(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))


def normalize(path) -> Column:
    """Drops empty and `.` parts and lets `..` take back a part; a trailing slash stays, nothing is `.`."""
    path = _col(path)

    def step(done, part):
        back = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
        # element_at on an empty array is never reached: size is tested first
        return F.when((part == "") | (part == "."), done).when(part == "..", F.when(F.size(done) == 0, F.array(part)).otherwise(back)).otherwise(F.concat(done, F.array(part)))

    out = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    out = F.when(out == "", ".").otherwise(out)
    return F.when(path.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)


def ancestors(path) -> Column:
    """Folders above a path, the topmost first."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def prefixes(path) -> Column:
    """The path itself and every folder above it, and the top (an empty string)."""
    return F.concat(F.array(F.lit("")), ancestors(path), F.array(_col(path)))
