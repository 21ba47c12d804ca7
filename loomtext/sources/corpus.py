"""Corpora of files, one document per row.

A document is a row, so a file of 2 GiB or more can't be one; ``read_lines`` reads files of any size line by line, for
programs whose records or views are lines.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from typing import BinaryIO
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch, ship


def read_binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``doc_id, doc_ord, path, content``: whole files as bytes, NULs and invalid UTF-8 included.

    ``doc_ord`` is the place of the path in the argument list, ``doc_id`` the hash of the path.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, p in enumerate(listed):
        files = spark.read.format("binaryFile").load(p)
        full = files.select("path", "content")
        # The file source leaves out empty files; they are documents too. Its own index holds these names on the driver as well.
        names = spark.createDataFrame([(unquote(f.replace("file:///", "file:/")),) for f in files.inputFiles()], "path string")
        empty = names.join(full.select("path"), "path", "left_anti").withColumn("content", F.lit(b""))
        one = full.unionByName(empty).select(F.xxhash64("path").alias("doc_id"), F.lit(i).cast("long").alias("doc_ord"), "path", "content")
        out = one if out is None else out.unionByName(one)
    return out


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``doc_id, doc_ord, path, text``: whole files as UTF-8 text."""
    return read_binary(spark, paths).withColumn("text", F.col("content").cast("string")).drop("content")


def read_input(spark: SparkSession, data: bytes | BinaryIO) -> DataFrame:
    """The one document ``-``, from bytes or from a stream such as ``sys.stdin.buffer`` that is read to its end."""
    content = data if isinstance(data, bytes) else data.read()
    rows = spark.createDataFrame([("-", bytearray(content))], "path string, content binary")
    return rows.select(F.xxhash64("path").alias("doc_id"), F.lit(0).cast("long").alias("doc_ord"), "path", "content")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, line``: the lines of files of any size, without their line feeds; large files are read by several tasks."""
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def in_order(outputs: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outputs (or rendered documents) in the order of the argument list, then of paths, then of printing."""
    places = files.select(F.col(key), "doc_ord", "path")
    return outputs.join(places, key).orderBy("doc_ord", "path", *[c for c in ("seq",) if c in outputs.columns])


def print_outputs(outputs: DataFrame, files: DataFrame, stream, key: str = "doc_id") -> None:
    """Sink: what is printed, in order, to a text stream; the driver holds one partition of it at a time."""
    for row in in_order(outputs, files, key).select("text").toLocalIterator():
        stream.write(row.text)


def write_outputs(outputs: DataFrame, files: DataFrame, path: str, key: str = "doc_id") -> None:
    """Sink: what is printed, as text files whose names are in order."""
    in_order(outputs, files, key).select(F.regexp_replace("text", "\\n\\z", "").alias("text")).write.text(path)


def write_texts(documents: DataFrame, path: str, mode: str = "error") -> None:
    """Documents as Parquet (doc_id, text, changed)."""
    documents.write.mode(mode).parquet(path)


def _local(path: str) -> str:
    """The name of a path in a file system that is mounted on the executors."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"only mounted files can be replaced in place, not {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def _digest(name: str) -> str:
    with open(name, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _staged(name: str, text: str | bytes, mark: str) -> tuple[str, str]:
    """Write a file's new content beside it, with its permissions; its name and the digest of what it replaces."""
    fresh = f"{name}.{mark}.new"
    mine = f"{fresh}.{uuid.uuid4().hex}"  # another attempt may write the same
    with open(mine, "wb") as out:
        out.write(text.encode("utf-8", "surrogateescape") if isinstance(text, str) else text)
        out.flush()
        os.fchmod(out.fileno(), os.stat(name).st_mode & 0o7777)
        os.fsync(out.fileno())
    os.replace(mine, fresh)
    return fresh, _digest(name)


def _swapped(name: str, fresh: str, digest: str, backup: str | None) -> None:
    """Put the new content in place. Nothing is left to do if that happened before; a backup is only made of the original."""
    if not os.path.exists(fresh):
        return
    if backup:
        link = f"{name}.{uuid.uuid4().hex}.old"
        os.link(name, link)
        if _digest(link) == digest:
            os.replace(link, name + backup)
        if os.path.exists(link):  # also where the backup is the same file already
            os.unlink(link)
    try:
        os.replace(fresh, name)
    except FileNotFoundError:  # another attempt was first
        return
    folder = os.open(os.path.dirname(name) or ".", os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def stage(files: DataFrame, documents: DataFrame, manifest: str) -> None:
    """First step of ``write_back``: new contents beside the files, and a table of them. The files stay as they are."""
    text = F.col("text")
    changed = documents.where("changed").join(files.select("doc_id", "path"), "doc_id").select("path", text)
    mark = uuid.uuid4().hex
    ship(files.sparkSession)

    def write(batches):
        import pyarrow as pa

        for b in batches:
            names = [_local(p) for p in b.column(0).to_pylist()]
            made = [_staged(n, t, mark) for n, t in zip(names, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (names, [m[0] for m in made], [m[1] for m in made])], names=["name", "fresh", "digest"])

    changed.mapInArrow(write, "name string, fresh string, digest string").write.parquet(manifest)


def commit(spark: SparkSession, manifest: str, backup: str | None = None) -> int:
    """Second step: renames only, which may be repeated any number of times. Returns the number of files."""
    ship(spark)

    def swap(batches):
        for b in batches:
            for name, fresh, digest in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _swapped(name, fresh, digest, backup)
            yield b

    rows = spark.read.schema("name string, fresh string, digest string").parquet(manifest)
    return rows.mapInArrow(swap, rows.schema).count()


def write_back(files: DataFrame, documents: DataFrame, backup: str | None = None, manifest: str | None = None) -> int:
    """In place: replace each changed file by its document, optionally keeping the original as ``path + backup``.

    ``files`` holds doc_id and path, in a file system that is mounted on all executors. All new contents are written
    beside their files first and listed in ``manifest`` (by default below the shared folder); only then are they renamed
    over the originals. A task that runs again repeats nothing that could harm: no file is edited twice, and a backup
    holds the original. If the second step fails, ``commit`` with the same manifest ends it. Permissions are kept, and
    files are synced; unchanged files aren't touched. Returns the number of files.
    """
    spark = files.sparkSession
    manifest = manifest or f"{scratch(spark)}/loomtext/edits-{uuid.uuid4().hex}"
    stage(files, documents, manifest)
    return commit(spark, manifest, backup)
