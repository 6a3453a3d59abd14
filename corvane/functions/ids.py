"""Stable identities: SHA-256 over joined parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of knowledge ids.
NAMESPACE = "knowledge:v1"


def _text(part) -> Column:
    return F.coalesce((part if isinstance(part, Column) else F.lit(part)).cast("string"), F.lit(""))


def joined_id(separator: str, *parts) -> Column:
    """Nulls count as empty parts; booleans read true and false."""
    return F.sha2(F.concat_ws(separator, *map(_text, parts)).cast("binary"), 256)


def nul_id(*parts) -> Column:
    return joined_id("\0", *parts)


def colon_id(*parts) -> Column:
    return joined_id(":", *parts)


def knowledge_id(*parts) -> Column:
    return nul_id(NAMESPACE, *parts)


def text_id(separator: str, *parts: str) -> str:
    return hashlib.sha256(separator.join(parts).encode()).hexdigest()
