"""Row-wise operators in Arrow batches: all input columns pass, new ones are added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.core.session import prepare


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Add the columns that ``fn`` makes from each Arrow batch.

    An input column whose name equals a new one (letter case aside, as Spark
    compares names) is replaced, so that clashing extra columns do no harm.
    """
    prepare(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    where = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    names = [f.name for f in [*keep, *fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in where), *fn(b)], names=names)

    return df.mapInArrow(run, T.StructType([*keep, *fields]))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with nulls as empty texts."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def int_lists(parts: list[bytes]) -> pa.Array:
    """Lists of int32 from their bytes, without a Python object for each number."""
    import numpy as np

    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
