"""Small helpers for operators that report spans of a text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[int, int, str]  # start, end (exclusive), kind; code points


def joined(spans: Iterable[Span], rank: dict[str, int]) -> str:
    """``kind:start:end`` by start, then by the kind's rank, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def map_texts(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    fields: list[tuple[str, T.DataType]],
    row: Callable[[str], tuple],
) -> DataFrame:
    """One output row per input row: the ``keep`` columns and what ``row(text)`` returns.

    Arrow batches in, Arrow batches out; a null text is handed over as "". No shuffle.
    """
    source = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([source.schema[k] for k in keep] + [T.StructField(n, t) for n, t in fields])
    kinds = [T_TO_ARROW[type(t)] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = [row(t or "") for t in batch.column(len(keep)).to_pylist()]
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)


T_TO_ARROW = {
    T.LongType: pa.int64(),
    T.StringType: pa.string(),
    T.BooleanType: pa.bool_(),
    T.DoubleType: pa.float64(),
    T.BinaryType: pa.binary(),
}
