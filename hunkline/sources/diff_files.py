"""Diff files as a source (A2).

A file is one diff; its name without the suffix is the change-set's id, with ``~XX``
for bytes that file names do not carry well. Files may lie in any folders below the
root; nothing is inferred from folder names. A listing of the files (name and length,
no content) completes what the readers see: empty files have no line and no text
row, and only the length tells whether the last line ends in a newline.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

DIFF_FILE_SCHEMA = "value STRING"
SUFFIX = ".diff"
FOLDERS = 256       # folders that written files are dealt to
SAFE = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-.")


def file_name(changeset_id: str) -> str:
    """The file of a change-set: bytes outside ``SAFE`` as ``~XX``."""
    return "".join(chr(b) if b in SAFE else f"~{b:02X}" for b in changeset_id.encode()) + SUFFIX


def _decoded(text: Column) -> Column:
    """URL decoding, in which a plus sign is itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def changeset_of(file: Column) -> Column:
    """The id in a file's name: the last path segment, suffix off, ``~XX`` decoded."""
    stem = F.regexp_replace(F.substring_index(file, "/", -1), F.lit(r"\.[^.]*\z"), F.lit(""))
    return _decoded(F.replace(F.replace(stem, F.lit("%"), F.lit("%25")), F.lit("~"), F.lit("%")))


def below(root: str, file: Column) -> Column:
    """``_metadata.file_path`` as the path below ``root``."""
    folder = urlparse(root).path.rstrip("/") + "/"
    path = _decoded(file)
    return path.substr(F.instr(path, folder) + len(folder), F.lit(1 << 30))


def write_diff_files(changesets: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """One file per change-set, dealt to at most ``folders`` folders by a hash of
    the id. Tasks write the bytes as they are (a text writer would end each diff
    with a newline, and cannot name files), through the filesystem of ``path``'s scheme;
    a file is renamed into place, so a task that runs twice leaves the same files."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _filesystem(path)
        made: set[str] = set()
        for batch in batches:
            for name, diff in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{root}/{uuid.uuid5(uuid.NAMESPACE_OID, name).int % folders:03d}"
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write(diff)
                where.move(part, f"{folder}/{file_name(name)}")
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("done", pa.int32())]))

    (changesets.select("changeset_id", F.coalesce("diff", F.lit("")).cast("binary").alias("diff"))
     .filter(F.col("changeset_id").isNotNull()).mapInArrow(task, "done int").write.format("noop").mode("overwrite").save())


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path's scheme, and the path in it."""
    url = urlparse(path)
    return fs.FileSystem.from_uri(path if url.scheme not in ("", "file") else f"file://{quote(url.path)}")


_ENTRY = "file string, size long, folder boolean"


def _lister(root: str, recursive: bool):
    """Entries of the folders that arrive, a batch of names at a time."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = where.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/"), recursive=recursive))
                found = [i for i in found if not i.base_name.startswith((".", "_"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.path.removeprefix(base.rstrip("/") + "/") for i in found], pa.string()),
                     pa.array([i.size for i in found], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_())],
                    names=["file", "size", "folder"])

    return task


def list_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """(changeset_id, file, size) of every diff file; contents are not read. Spark's
    own listing leaves empty files out, so tasks list: one the root, then each folder
    in it by one task. ``file`` is the path below the root."""
    top = spark.createDataFrame([("",)], "folder string").mapInArrow(_lister(path, False), _ENTRY)
    rest = (top.filter("folder").select("file").repartition("file").mapInArrow(_lister(path, True), _ENTRY))
    files = top.unionByName(rest).filter(~F.col("folder") & F.col("file").endswith(SUFFIX))
    return files.select(changeset_of(F.col("file")).alias("changeset_id"), "file", "size")


def read_options(spark: SparkSession, schema: str) -> DataFrameReader:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + SUFFIX)


def scan_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """A2: every file is one diff (``wholetext``), the empty ones included, which
    come from the listing. Each file is one row, read by one task; no text is shuffled."""
    df = (read_options(spark, DIFF_FILE_SCHEMA).text(path, wholetext=True)
          .select(F.col("value").alias("diff"), below(path, F.col("_metadata.file_path")).alias("file")).filter(F.length("diff") > 0))
    empty = list_diff_files(spark, path).filter(F.col("size") == 0).select(F.lit("").alias("diff"), "file")
    return df.unionByName(empty).select(changeset_of(F.col("file")).alias("changeset_id"), "diff", "file")
