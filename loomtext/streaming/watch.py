"""Watching: a program runs again whenever a file arrives (streams) or is modified (polling)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Program, Result
from ..cluster import scratch
from ..sources.corpus import read_binary

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, program: Program, path: str, handle: Callable[[Result, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Structured Streaming over a folder: each micro-batch of new files is run as a corpus and given to ``handle``.

    The program runs once per file that arrives; nothing of earlier files is kept, as each document is independent.
    With ``once`` the query stops when all files present are handled. Files that the handler may see again after a
    failure carry the batch's number.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)
    docs = files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").cast("string").alias("text"))

    def each(batch: DataFrame, number: int) -> None:
        handle(program.run(batch), number)

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def poll(spark: SparkSession, program: Program, path: str, every: float = 1.0, rounds: int | None = None, state: str | None = None) -> Iterator[Result]:
    """Re-run over the files whose time or length changed since the last look; the first look takes all.

    The file source of streams doesn't see a file again that was rewritten under its name; this does. Each look is a table
    of paths, times and lengths below ``state`` (by default the shared folder); the driver holds none of them.
    """
    state = state or f"{scratch(spark)}/loomtext/looks-{uuid.uuid4().hex}"
    last, n = None, 0
    while rounds is None or n < rounds:
        look = f"{state}/{n}"
        spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").write.mode("overwrite").parquet(look)
        now = spark.read.schema("path string, modificationTime timestamp, length long").parquet(look)
        fresh = now if last is None else now.join(last, ["path", "modificationTime", "length"], "left_anti")
        last, n = now, n + 1
        if fresh.limit(1).count():
            docs = read_binary(spark, path).join(fresh.select("path"), "path", "left_semi").withColumn("text", F.col("content").cast("string"))
            yield program.run(docs)
        if rounds is None or n < rounds:
            time.sleep(every)
