"""Small helpers that the training-data operators share."""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that leave Python are cut at about this many bytes, so a worker's memory doesn't follow the batch size.
OUT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local one will do if driver
    and executors are one process (local mode); on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("poolstrata.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("poolstrata.shared.dir", where)
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write within this as soon as it has ended; nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have (names are the same in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(what: DataFrame | SparkSession, path: str | None = None) -> None:
    """Delete a folder of the shared one: by its path, or the one that a frame of ``materialise`` reads (nothing may read it later)."""
    spark = what.sparkSession if isinstance(what, DataFrame) else what
    folders = [path] if path else {name.rsplit("/", 1)[0] for name in what.inputFiles()}
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def local_path(path: str) -> Path | None:
    """The path that the operating system knows, if the file system is a mounted one."""
    parts = urlparse(path)
    return Path(unquote(parts.path)) if parts.scheme in ("", "file") else None


def write_bytes(path: str, data: bytes) -> None:
    """Write a file of the shared folder from a task: under another name first, so a file is whole or not there."""
    where = local_path(path)
    if where:
        where.parent.mkdir(parents=True, exist_ok=True)
        part = where.with_name(f".{where.name}-{uuid.uuid4().hex}")
        part.write_bytes(data)
        part.replace(where)
        return
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}-{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, name)


def read_bytes(path: str) -> memoryview:
    """A file of the shared folder, mapped in memory where the folder is mounted, else fetched."""
    where = local_path(path)
    if where:
        with where.open("rb") as file:
            return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        return memoryview(file.read_buffer())


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the contracts' train and held-out split."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def batches_of(rows: Iterator[tuple[list, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches from (row values, bytes) pairs, cut at OUT_BYTES."""
    held: list[list] = [[] for _ in schema]
    size = 0
    for values, n in rows:
        for column, value in zip(held, values):
            column.append(value)
        size += n
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)
            held, size = [[] for _ in schema], 0
    if held and held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)
