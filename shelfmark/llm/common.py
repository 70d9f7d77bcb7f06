"""Small helpers of the operators in this folder."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: names of Spark's connectors for stores that Arrow has under another one
STORE_NAMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def arrow_uri(uri: str) -> str:
    """The name that Arrow's file systems have for what Spark calls ``uri``; a plain path stays one."""
    scheme, mark, rest = uri.partition("://")
    if mark and scheme != "file":
        return f"{STORE_NAMES.get(scheme, scheme)}://{rest}"
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``uri`` for a worker; a scheme Arrow does not know is left to Hadoop's library."""
    name = arrow_uri(uri)
    try:
        return fs.FileSystem.from_uri(name)
    except pa.ArrowInvalid:
        scheme, mark, rest = name.partition("://")
        if not mark:
            raise
        host, _, path = rest.partition("/")
        return fs.HadoopFileSystem(f"{scheme}://{host}"), f"/{path}"


def raw_texts(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A text column as strings; null is empty."""
    return [t or "" for t in column.to_pylist()]


def text_column(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch that has a column ``text``, or whole rows in a struct ``_row``."""
    if "_row" in batch.schema.names:
        return pc.struct_field(batch.column("_row"), "text")
    return batch.column("text")


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns appended; a column of the same name is replaced."""
    kept = [i for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in kept), *columns.values()],
        names=[*(batch.schema.names[i] for i in kept), *columns])


def schema_with(df: DataFrame, added: str) -> str:
    """DDL of the columns of ``df`` followed by ``added`` (``name type, ...``), which replace equal names."""
    fresh = {part.split()[0].lower() for part in added.split(", ") if part}
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields
           if f.name.lower() not in fresh]
    return ", ".join([*own, added])


def list_array(lists: list, kind: pa.DataType) -> pa.Array:
    return pa.array(lists, pa.list_(kind))


def large_text(column: pa.Array) -> pa.Array:
    """A text column as large strings from offset 0 (string kernels go wrong on slices); null is empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([text, text.slice(0, 0)])


def parts_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``size`` bytes, so that what is made of a part stays small."""
    for batch in batches:
        step = max(1, len(batch) * size // max(1, batch.nbytes))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def release(spark: SparkSession) -> None:
    """Free the shuffle files of finished jobs now: Spark drops them when the driver collects their plans.

    Plans that refer to each other go in the second round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more, whatever store it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
