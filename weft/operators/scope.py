"""Filters that narrow sessions and turns: project, provider, origin, author, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.times import between

ORIGINS = ("local", "shared", "all")


def equal(df: DataFrame, **values) -> DataFrame:
    """Optional equality on each named column; None leaves it open."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def origin(df: DataFrame, scope: str) -> DataFrame:
    if scope not in ORIGINS:
        raise ValueError(f"origin scope is one of {ORIGINS}")
    return df if scope == "all" else df.filter(F.col("origin_kind") == scope)


def with_author(sessions: DataFrame, users: DataFrame | None, author: str | None = None) -> DataFrame:
    """Sessions with their user's name and mail; ``author`` is an id, a mail or a name."""
    if users is None:
        users = sessions.sparkSession.createDataFrame([], "user_id string, display_name string, email string")
    u = users.select(F.col("user_id").alias("__user"), F.col("display_name").alias("user_name"), F.col("email").alias("user_email"))
    out = sessions.join(u, F.col("origin_user_id") == F.col("__user"), "left").drop("__user")
    if author is not None:
        out = out.filter((F.col("origin_user_id") == author) | (F.col("user_email") == author) | (F.col("user_name") == author))
    return out


def in_window(df: DataFrame, since: str | None, until: str | None, column: str = "started_at", as_text: bool = False) -> DataFrame:
    if since is None and until is None:
        return df
    return df.filter(between(F.col(column), since, until, as_text))


def active(status: Column, duration: Column) -> Column:
    """A turn counts as active time if it completed and took two seconds or more."""
    return (status == "completed") & (duration >= 2000)
