"""Shared plumbing of the operators: code shipping, work folders, Arrow maps."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.session import checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so tasks can
    import it wherever they run. Spark distributes the file itself."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="hunkline-code-"), "hunkline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``, as a
    path that tasks can open and memory-map. The folder must be mounted on all
    machines (a ``file:`` path); another scheme is refused here, not later."""
    shared = checkpoint_dir(spark)
    url = urlparse(shared)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped stores need a mounted shared folder, not {shared}")
    path = os.path.join(url.path, f"hunkline-{name}-{uuid.uuid4().hex[:12]}")
    os.makedirs(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def take(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, picked by place: other columns
    whose names differ in case only do not clash."""
    places = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(n) for i, n in zip(places, names)])


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, whatever its scheme.
    A task that runs twice writes its file once (Spark's output committer)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/hunkline-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def fields(*cols: tuple[str, T.DataType | str]) -> T.StructType:
    out = T.StructType()
    for name, kind in cols:
        out = out.add(name, kind)
    return out


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
