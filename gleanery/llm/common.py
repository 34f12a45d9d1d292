"""What the operators of this subpackage share: column selection, bounded Arrow slices, checkpoints.

Every operator reads an id and a text column and ignores all others, so extra columns, also ones
named like a result column, never clash. Results hold the id (as ``doc_id``) and derived columns only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one call of a vectorised kernel sees. A longer single text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker, unless the session has a smaller bound.
BATCH_BYTES = 8 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes, as rows may be very long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"([0-9]+)([a-z]*)", spark.conf.get(name).lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) as integer and string; a doc_id that is no integer is an error, as in any cast under ANSI."""
    bounded(docs.sparkSession)
    return docs.select(
        F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the reliable folder that the session names.

    That is ``spark.checkpoint.dir``, which a cluster's machines share. Where it is unset, a folder in the warehouse, shared as well, is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together stay near ``most`` bytes. No row is split or left out."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def map_texts(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, column: str = "text") -> DataFrame:
    """Run ``kernel`` over bounded slices of every partition."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, column):
                yield kernel(part)

    return df.mapInArrow(run, schema)


def record(**columns: object) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
