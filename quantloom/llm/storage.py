"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

#: Tables up to this many bytes may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a temporary folder, removed at exit, stands in on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quantloom-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        path = _own[app]
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and its size is known.

    A table that nothing lazy reads any more is removed by ``free``; the others go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    out._written_to = path
    return out


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    # the JVM may be gone by now
    with contextlib.suppress(Py4JError, OSError):
        for path in [*_written]:
            _remove(path)


def free(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote."""
    for table in tables:
        _remove(table._written_to)


def _bytes_of(field: StructField) -> Column:
    """About how many bytes a value takes in a row; a nested value by its JSON form."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.lit(8) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.lit(8) + F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
    return F.lit(8)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows are counted to take ``most`` bytes or less, else unchanged."""
    rows = most // (8 + 8 * len(df.columns))
    taken = df.limit(rows + 1).agg(F.count("*"), F.sum(sum((_bytes_of(f) for f in df.schema), F.lit(8)))).first()
    return F.broadcast(df) if taken[0] <= rows and (taken[1] or 0) <= most else df


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5 = 0; true for a null id, which is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Bytes of one Arrow batch between the JVM and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, as texts can be long; an idle worker gives Arrow's memory back.

    The bound is the session's ``spark.sql.execution.arrow.maxBytesPerBatch``, which is lowered where it is larger.
    """
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)

    def bounded_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded_run, schema)
