"""The N best rows of every group, by a row_number window that the optimiser turns into a group limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from arcweave.common import by_position, position


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, str]], n: int) -> DataFrame:
    """Rows of ``df`` that rank among the first ``n`` of their group.

    ``order`` lists (column, "asc" | "desc"); it should end with an identifier so that the order is total.
    The rank filter over ``row_number`` lets Catalyst plan a WindowGroupLimit below and above the exchange: every
    task sends at most ``n`` rows of a group, so a group with a third of all rows costs no more than any other.
    The local sort that this needs spills.

    Defined cases: nulls of a group column form a group of their own; nulls of an order column rank last, in either
    direction; rows that tie in all order columns are all eligible, and which of them are kept is then open (their
    order columns are equal); groups of fewer than ``n`` rows come out whole; n <= 0 gives no rows; an empty table
    gives an empty one. All columns of ``df`` are kept under their own names, whatever they are called.
    """
    names, plain = df.columns, by_position(df)
    part = ", ".join(f"c{position(df, c)}" for c in group)
    by = []
    for column, way in order:
        if way.lower() not in ("asc", "desc"):
            raise ValueError(f"direction of {column} is {way!r}, not asc or desc")
        by.append(f"c{position(df, column)} {way} NULLS LAST")
    kept = ", ".join(f"c{i}" for i in range(len(names)))
    ranked = df.sparkSession.sql(
        f"""
        SELECT {kept}
        FROM (SELECT {kept}, row_number() OVER (PARTITION BY {part} ORDER BY {", ".join(by)}) AS place FROM {{rows}})
        WHERE place <= {int(n)}
        """,
        rows=plain,
    )
    return ranked.toDF(*names)
