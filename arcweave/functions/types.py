"""Type tokens of file headers and the parsing of field texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header token -> Spark type. ``str`` attributes are kept; ``numeric_only`` projections leave them out.
TOKENS: dict[str, T.DataType] = {
    "int": T.LongType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "str": T.StringType(),
}

#: Texts that mean true, in any letter case; every other text means false.
TRUE_WORDS = ("yes", "true", "t", "1")


def type_of(token: str) -> T.DataType:
    """Spark type of a header token; an unknown token is an error."""
    if token not in TOKENS:
        raise KeyError(f"unknown attribute type {token!r}; known: {', '.join(TOKENS)}")
    return TOKENS[token]


def bool_column(text: Column) -> Column:
    """True for one of TRUE_WORDS, else false; not a cast, which would give null for other texts."""
    return F.coalesce(F.lower(text).isin(*TRUE_WORDS), F.lit(False))


def parse_column(text: Column, token: str, strict: bool = True) -> Column:
    """The value of a field text. ``strict``: a text that doesn't parse ends the job; else it becomes null."""
    kind = type_of(token)
    if isinstance(kind, T.BooleanType):
        return bool_column(text)
    if isinstance(kind, T.StringType):
        return text
    return text.cast(kind) if strict else text.try_cast(kind)
