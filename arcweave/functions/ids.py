"""Node identity: a type ordinal in the top bits, 60 bits of the key's md5 below.

Ids are the same in every process and in SQL engines with md5, so saved graphs stay readable. Keys are compared as
strings. At most eight types fit into the sign-free part of a long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TYPES = 8
TYPE_SHIFT = 60
BUCKETS = 64


def check_ordinal(ordinal: int) -> int:
    if not 0 <= ordinal < MAX_TYPES:
        raise ValueError(f"a graph has at most {MAX_TYPES} node types; ordinal {ordinal} does not fit")
    return ordinal


def node_id(ordinal: int, key: Column) -> Column:
    """Id of the node of a type with this key; null for a null key."""
    hashed = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.lit(check_ordinal(ordinal) << TYPE_SHIFT).cast("bigint").bitwiseOR(hashed)


def node_id_of(ordinal: int, key: object) -> int:
    """The same id on the driver."""
    return check_ordinal(ordinal) << TYPE_SHIFT | int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16)


def type_ordinal(ident: Column) -> Column:
    return F.shiftright(ident, TYPE_SHIFT).cast("int")


def bucket(ident: Column, buckets: int = BUCKETS) -> Column:
    """Low bits of the id: the storage partition of a node's adjacency. ``buckets`` is a power of two."""
    return ident.bitwiseAND(F.lit(buckets - 1).cast("bigint")).cast("int")


def node_id_sql(ordinal: int, key: str) -> str:
    """The id expression for DuckDB."""
    return f"(({check_ordinal(ordinal)}::BIGINT << {TYPE_SHIFT}) | (('0x' || substr(md5({key}::VARCHAR), 1, 15))::BIGINT))"
