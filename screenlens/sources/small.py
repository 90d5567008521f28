"""Many small files: written and read by the tasks themselves where the file system is mounted (scheme ``file``).

Spark's file sink takes a writer and a commit for every folder, and its file index lists every folder and keeps every file
in the driver. Here a task opens, reads and writes one file after another, folders are listed by tasks too, and the
driver holds nothing that grows with the number of files. Elsewhere Spark's own sources and sinks serve.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files that a task holds before it hands them on.
BATCH_BYTES = 4 << 20
BATCH_FILES = 4096
MISSING = "__HIVE_DEFAULT_PARTITION__"
_RESERVED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def mounted(spark: SparkSession, path: str) -> str | None:
    """The plain path on a mounted file system, null on any other."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        return None
    return system.makeQualified(target).toUri().getPath()


def cleared(spark: SparkSession, path: str) -> None:
    """An empty folder at ``path``."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    system.delete(target, True)
    system.mkdirs(target)


def folder_name(value: str | None) -> str:
    """A value as Spark names its folder."""
    return _RESERVED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else MISSING


def put(folder: str, name: str, value: bytes) -> None:
    """A file that is there as a whole or not at all, so that a repeated task does no harm."""
    os.makedirs(folder, exist_ok=True)
    hidden = f"{folder}/.{uuid.uuid4().hex}"
    with open(hidden, "wb") as file:
        file.write(value)
    os.replace(hidden, f"{folder}/{name}")


def write_keyed(documents: DataFrame, root: str, keys: list[str]) -> None:
    """Documents (keys, text) as Spark's text sink writes them partitioned by ``keys``: a folder per document, a file per
    folder and task, and a line end after every text."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        held, folder, texts, n = None, "", [], 0
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != held:
                    if texts:
                        put(folder, name, b"".join(texts))
                    parts = [f"{k}={folder_name(v)}" for k, v in zip(keys, key, strict=True)]
                    held, folder, texts = key, "/".join([root, *parts]), []
                texts.append((text or b"") + b"\n")
                n += 1
        if texts:
            put(folder, name, b"".join(texts))
        yield _batch(n=([n], "int64"))

    plain = documents.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("text").cast("binary").alias("text"))
    plain.sortWithinPartitions(*keys).mapInArrow(store, "n long").agg(F.sum("n")).collect()


def _hidden(name: str) -> bool:
    """Names that Spark's file index leaves out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(folder: str, suffix: str) -> tuple[list[str], list[str]]:
    """Folders in a folder, and files whose names end in ``suffix``."""
    folders, files = [], []
    with os.scandir(folder) as found:
        for entry in found:
            if _hidden(entry.name):
                continue
            if entry.is_dir():
                folders.append(entry.path)
            elif entry.name.endswith(suffix):
                files.append(entry.path)
    return folders, files


def _batch(**columns: tuple[list, str]) -> pa.RecordBatch:
    arrays = [pa.array(values, kind) for values, kind in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def read_whole(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files below a folder, at any depth, whose names end in ``suffix`` (origin, value). The top folder is listed by one
    task, what lies below it by all, and the files found are dealt out evenly before they are read."""
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for paths, folder in zip(_listed(root, suffix), (True, False), strict=True):
                for i in range(0, len(paths), BATCH_FILES):
                    some = paths[i : i + BATCH_FILES]
                    yield _batch(path=(some, "string"), folder=([folder] * len(some), "bool"))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, open_ = [], []
            for path, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (open_ if folder else found).append(path)
            while open_:
                folders, files = _listed(open_.pop(), suffix)
                open_ += folders
                found += files
                if len(found) >= BATCH_FILES:
                    yield _batch(path=(found, "string"))
                    found = []
            yield _batch(path=(found, "string"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origins, values, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as file:
                    value = file.read()
                if not value:  # Spark leaves out empty files
                    continue
                if values and size + len(value) > BATCH_BYTES:
                    yield _batch(origin=(origins, "string"), value=(values, "binary"))
                    origins, values, size = [], [], 0
                origins.append(f"file:{path}")
                values.append(value)
                size += len(value)
            yield _batch(origin=(origins, "string"), value=(values, "binary"))

    begun = spark.range(1, numPartitions=1).mapInArrow(top, "path string, folder boolean")
    files = begun.repartition(width).mapInArrow(below, "path string").repartition(width)
    return files.mapInArrow(read, "origin string, value binary").withColumn("value", F.col("value").cast("string"))
