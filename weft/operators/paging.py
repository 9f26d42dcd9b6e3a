"""Pages, orderings and capped lists that the read queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit in a total order: a bounded top-k, not a full sort of the table unless limit is None."""
    if limit is None:
        return df.orderBy(*order).offset(offset)
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def has_more(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> bool:
    """Whether a row follows the page; a limit of 0 asks only that."""
    return len(page(df, order, 1, offset + limit).take(1)) > 0


def keyset(df: DataFrame, after: dict | None, limit: int) -> DataFrame:
    """The next ``limit`` turns after a cursor in the order newest first, then provider, session, ordinal."""
    if after:
        tail = (F.col("provider"), F.col("session_id"), F.col("turn_ordinal"))
        behind = F.struct(*tail) > F.struct(*(F.lit(after[k]).cast(t) for k, t in (("provider", "string"), ("session_id", "string"), ("turn_ordinal", "long"))))
        df = df.filter((F.col("started_at") < after["started_at"]) | ((F.col("started_at") == after["started_at"]) & behind))
    return page(df, TURN_ORDER(), limit)


def TURN_ORDER() -> list[Column]:  # noqa: N802
    return [F.desc("started_at"), F.asc("provider"), F.asc("session_id"), F.asc("turn_ordinal")]


def capped(values: Column, cap: int) -> tuple[Column, Column, Column]:
    """Sorted distinct values cut at ``cap``, their true count, and whether any were cut."""
    every = F.sort_array(F.array_distinct(values))
    return F.slice(every, 1, cap), F.size(every).cast("long"), F.size(every) > cap


def whole_sum(c: str) -> Column:
    """Sum that is null if any row's value is."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))
