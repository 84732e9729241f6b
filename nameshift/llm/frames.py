"""Arrow-batch functions over the text column of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from nameshift.llm.buffers import slices

#: Gets the bytes and row offsets of a slice of rows; returns an Arrow array for each new column.
SliceFunction = Callable[[np.ndarray, np.ndarray], Sequence[pa.Array]]


#: Rows go to Python in batches of about so many bytes, a longer row alone: the JVM and Python each hold copies of a batch.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after holding the session's Arrow batches to ``BATCH_BYTES``; a smaller setting of the user stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, "64m").strip().lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[now[-1]] if now[-1:] in "kmgt" else int(now)
    if not 0 < size <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def map_text(df: DataFrame, text: str, make: Callable[[], SliceFunction], fields: Sequence[StructField], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of every row, then ``fields`` as computed from its whole text.

    ``make`` runs once in each task. Rows stay where they are: there is no shuffle. Columns travel under
    positions, so names that clash with each other or with ``fields`` only clash in the result.
    """
    n = len(keep)
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    schema = StructType([StructField(f"c{i}", source.schema[i].dataType) for i in range(n)] + [StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for i, j, data, offs in slices(batch.column(n)):
                old = [batch.column(k).slice(i, j - i) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*old, *function(data, offs)], names)

    return small_batches(source).mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.int64), pa.int64())


def binaries(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Ragged bytes as a binary column; ``offs`` count bytes."""
    if offs[-1] > np.iinfo(np.int32).max:
        raise ValueError("a slice of rows holds over 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])
