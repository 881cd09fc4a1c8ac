"""What the operators of this subpackage share: folders, staged tables and folds."""

from __future__ import annotations

import atexit
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process (tests).
LOCAL_FOLDER = "file:///tmp/checkpoints/framelytics"
_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Without that setting a local session uses LOCAL_FOLDER and any other session
    is an error, as its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_FOLDER
    return posixpath.join(qualified(spark, base), f"framelytics-{_RUN}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI; one without a scheme is in the session's default file system."""
    if "://" in path:
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return found if "://" in found else found.replace(":/", ":///", 1)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver's process ends."""
    base = shared_dir(spark)
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_remove, base)
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


_cleaned: set[str] = set()


def _remove(uri: str) -> None:
    try:
        files, path = pafs.FileSystem.from_uri(uri)
        files.delete_dir(path)
    except Exception:  # the folder may be gone; nothing depends on its removal
        pass


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends here.

    With batch_rows, Python gets so many rows at a time while it is written: long texts
    in full batches take both Spark's memory and Python's.
    """
    conf, place = df.sparkSession.conf, new_folder(df.sparkSession, name)
    if batch_rows is None:
        return table_at(df, place)
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(batch_rows))
    try:
        return table_at(df, place)
    finally:
        conf.set(BATCH_ROWS, before)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def sent_in_parts(spark: SparkSession, most: int) -> Iterator[None]:
    """Python gets about so many bytes at a time from what runs within; a row is never cut."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def table_at(df: DataFrame, path: str) -> DataFrame:
    """Write df to this path and read it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(path: str) -> None:
    """Remove a table that nothing reads any more."""
    _remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id has fold -1."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % of).cast("int"), F.lit(-1))


def where_late(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated on top of df's columns.

    Spark pushes a filter below projections by copying their expressions into it; for
    arrays that later steps read element by element, it would compute them anew for each
    element. A row id in the condition keeps the filter where it is written.
    """
    late = free_name(df, "late")
    return df.withColumn(late, F.monotonically_increasing_id()).where(condition & (F.col(late) >= 0)).drop(late)
