"""A dictionary of paths: each spelling that accesses hold, once, with its project-scoped and its normal form.

Accesses name a spelling by ``path_id``, 16 bytes, so pivots group and join short keys, and a path is
normalised, folded or matched by a glob once however often it is touched. Stored beside the accesses, the
dictionary answers a glob without them; only accesses of its hits are read then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import display_path, file_name, normal_path
from weft.operators.sessions import matches_glob
from weft.runtime import materialize

RAW = ["repo_relative_path", "path"]


def path_id() -> Column:
    """Name of an access's spelling, the pair of its stored paths; null and empty are apart."""
    part = lambda c: F.coalesce(F.concat(F.lit("1"), F.col(c)), F.lit("0"))
    return F.unhex(F.md5(F.concat(part(RAW[0]), F.lit("\0"), part(RAW[1])).cast("binary")))


def keyed(accesses: DataFrame) -> DataFrame:
    """Accesses with ``path_id``; stored ones have it already."""
    return accesses if "path_id" in accesses.columns else accesses.withColumn("path_id", path_id())


def dictionary(accesses: DataFrame, root: str | None = None) -> DataFrame:
    """(path_id, stored paths, shown, normal, file_name) of each distinct spelling.

    The spellings are stored before their forms are made: a filter on a form would else be moved below the
    distinct, and every access would be normalised for it.
    """
    each = materialize(keyed(accesses).select("path_id", *RAW).distinct(), "spellings")
    return each.select("path_id", *RAW, display_path(F.col(RAW[0]), F.col(RAW[1]), root).alias("shown"), normal_path(F.col("path")).alias("normal"), file_name(F.col("path")).alias("file_name"))


def matching(paths: DataFrame, glob: str, root: str | None = None) -> DataFrame:
    """Rows of the dictionary that a glob matches in either form."""
    return paths.filter(matches_glob(glob, root, F.col("shown"), F.col("normal")))
