"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens is cut by the binary digits of n: whole pieces of ``size`` tokens (a power of two), then one
piece for each lower binary digit that is set, longest first. Pieces of one length form a bucket, and each piece is a
sequence of its own in that bucket, so batches drawn from a bucket are rectangular and need no padding or masks.

Edge cases: null text counts as empty and has the closing id alone; equal documents make equal pieces under their own
sequence ids; an empty table has no pieces; an id column with nulls or repeats is passed through as it is; other
columns aren't read, whatever their names. A very long text is one row and must fit its task; it is encoded block by
block, so long runs of one kind (millions of spaces) only cost time n log n.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PATTERN, codec, ids_array, pieces_of

SIZE, CLOSE = 2048, 1


#: Runs from twice this length on are never given to the compiled tokenizer: its matcher recurses and its merges are quadratic.
RUN = 1024


def _has_runs(text: str) -> bool:
    """Whether a text may hold a pre-token of ``2 * RUN`` characters: one of its windows has no two words then."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to ``split`` alone
        return True
    return any(len(text[i : i + RUN].split(None, 1)) < 2 for i in range(0, len(text) - RUN + 1, RUN))


class FastIds:
    """Ids of the same vocabulary by a compiled tokenizer whose ranks are the ids; by our own codec if they aren't.

    Blocks with very long runs always go to our own codec.
    """

    def __init__(self, path: str):
        self.codec = c = codec(path)
        made = [m[1] for m in sorted(c.merges.values())]
        ranks = {c.pieces[i]: i for i in [*c.byte_ids, *made]}
        self.fast = None
        if sorted(c.byte_ids) == list(range(256)) and made == sorted(set(made)) and len(ranks) == 256 + len(made):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=c.added)

    def _block(self, text: str) -> np.ndarray:
        if _has_runs(text):
            return self.codec.ids(text)
        return np.asarray(self.fast.encode_ordinary(text), np.int32)

    def __call__(self, text: str) -> np.ndarray:
        return self.codec.encode(text, self._block if self.fast else None).astype(np.uint32)


@lru_cache(maxsize=4)
def fast_ids(path: str) -> FastIds:
    return FastIds(path)


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(s, size) for s in range(0, n - n % size, size)]
    at = n - n % size
    bit = size >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, close: int = CLOSE, with_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place, sequence and checksum, and with ``with_ids`` its ids.

    ``length`` is the bucket. ``sequence_id`` is the task's partition number times 2^33 plus a running number, unique
    over all buckets without a shuffle.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    schema = T.StructType([*PIECES, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    df = df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text"))

    def run(batches):
        ids_of = fast_ids(path)
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                out: list[list[int]] = [[] for _ in range(5)]
                docs, kept = [], []
                for doc, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.append(ids_of(s or ""), np.uint32(close)).astype("<u4")
                    raw, n = ids.tobytes(), len(ids)
                    for start, length in cut(n, size):
                        docs.append(doc)
                        for col, x in zip(out, (start, length, n, number, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                            col.append(x)
                        number += 1
                        if with_ids:
                            kept.append(ids[start : start + length].astype(np.int32))
                start, length, n, seq, crc = (pa.array(c, pa.int64()) for c in out)
                cols = [pa.array(docs, pa.int64()), start, length, n, seq, pa.array(np.zeros(len(docs), np.int64)), crc]
                yield pa.RecordBatch.from_arrays(cols + ([ids_array(kept)] if with_ids else []), names=schema.names)

    return df.mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sink: one folder per length, ``length=1`` to ``length=2048``."""
    pieces.write.partitionBy("length").parquet(path)
