"""Order MinHash fingerprints.

A text's k-mers are runs of ``K`` code points, each numbered by its occurrence. ``M`` permutations of their 40-bit
hashes each select the ``L`` smallest; these keep their order in the text, and a hash of that ordered tuple is one of
the ``M`` values of the signature. Likeness of two signatures is the share of equal values: it falls with edit distance
and, other than plain MinHash, also when the same k-mers change their order.

The permutations are ``h -> h XOR mask_j`` on one random hash, so the ``L`` smallest lie in one aligned block of the
sorted hashes; each text is sorted once, whatever ``M`` is.

Edge cases: null text counts as empty; a text shorter than ``K`` is one k-mer; fewer than ``L`` k-mers: all of them;
two empty texts are alike (1.0), an empty and another text are not (0.0). Equal texts have equal fingerprints. Rows that
repeat an id, or have none, are ordered by a hash of their text and then by the text; each is a row of its own, and they
may be spread over many tasks. Columns besides the two that are named aren't read; an empty table gives an empty table. A
very long text is one row and must fit its task, with about 60 bytes for each of its characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import U, mix

K, L, M = 8, 2, 64
_BITS, _POS = 40, U(24)
#: From this many k-mers on, positions no longer fit beside the hash in one word.
PACKED = 1 << 24
#: Bytes of text that one task of the walk over all rows is dealt, about.
TASK_BYTES = 64 << 20
_MASKS = mix(np.arange(1, M + 1, dtype=U), 11) >> _POS
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = (1 << 64) - 1


def _kmers(cp: np.ndarray) -> np.ndarray:
    """40-bit hashes of all k-mers of code points, in text order."""
    h = mix(cp.astype(U), 3)
    if len(cp) < K:
        total = 0
        for x in h.tolist():
            total = (total * _BASE + x) & _LOW
        return mix(np.array([total], U), 50 + len(cp)) >> _POS
    size = 1
    while size < K:  # runs of 1, 2, 4, 8
        h = h[:-size] * U(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return mix(h, K) >> _POS


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers in ascending order, and their positions."""
    n = len(h)
    pos = np.arange(n, dtype=U)
    if n >= PACKED:
        order = np.argsort(h, kind="stable")
        hs, pos = h[order], pos[order]
    else:
        both = np.sort((h << _POS) | pos)
        hs, pos = both >> _POS, both & U((1 << 24) - 1)
    same = hs[1:] == hs[:-1]
    if same.any():
        at = np.arange(n)
        starts = np.concatenate(([True], ~same))
        nth = (at - np.maximum.accumulate(np.where(starts, at, 0))).astype(U)
        hs = np.where(nth > 0, mix(hs + nth * U(0xC2B2AE3D27D4EB4F), 5) >> _POS, hs)
        if n >= PACKED:
            order = np.argsort(hs, kind="stable")
            hs, pos = hs[order], pos[order]
        else:
            both = np.sort((hs << _POS) | pos)
            hs, pos = both >> _POS, both & U((1 << 24) - 1)
    return hs, pos


def signature(text: str | None) -> np.ndarray:
    """``M`` values of 32 bits."""
    if not text:
        return np.zeros(M, np.uint32)
    hs, pos = _numbered(_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))
    n = len(hs)
    if n <= 48:
        pick = np.broadcast_to(np.arange(n), (M, n))
        keys = hs[pick] ^ _MASKS[:, None]
    else:
        bits = max(0, _BITS - int(np.log2(n / 16)))
        while True:  # the aligned block around each mask that holds L hashes at least
            lo = np.searchsorted(hs, (_MASKS >> U(bits)) << U(bits))
            hi = np.searchsorted(hs, ((_MASKS >> U(bits)) + U(1)) << U(bits)) if bits < _BITS else np.full(M, n)
            if (hi - lo).min() >= L or bits >= _BITS:
                break
            bits += 1
        pick = lo[:, None] + np.arange(int((hi - lo).max()))
        inside = pick < hi[:, None]
        pick = np.where(inside, pick, n - 1)
        keys = np.where(inside, hs[pick] ^ _MASKS[:, None], U(_LOW))
    best = np.argsort(keys, axis=1, kind="stable")[:, :L]
    chosen = np.take_along_axis(pick, best, axis=1)
    p, h = pos[chosen], hs[chosen]
    h = np.take_along_axis(h, np.argsort(p, axis=1, kind="stable"), axis=1)
    out = np.zeros(M, U)
    for i in range(h.shape[1]):
        out = mix(out + h[:, i] + U(1), 20 + i)
    return (out >> U(32)).astype(np.uint32)


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / M


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """Column function: the fingerprint of a text."""
    return text.map(lambda s: to_text(signature(s)))


@F.pandas_udf(T.DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column function: likeness of two fingerprints (null if one is null)."""
    return pd.Series([None if x is None or y is None else likeness(from_text(x), from_text(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def _cuts(df: DataFrame, parts: int, nulls: int, total: int) -> list[tuple]:
    """The buckets' upper ends in the order of the walk, as (key, share of that key's hashes); the last one is open.

    A key that is several of the quantiles has as many buckets, cut by the hash of the text; so have null keys.
    """
    found = df.stat.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) if total > nulls and parts > 1 else []
    # Quantiles are doubles; of the keys that round to a hot one the most frequent is meant.
    rounded = [c for c in set(found) if abs(c) >= 1 << 53 and found.count(c) > 1]
    exact = {}
    if rounded:
        near = df.select("k", F.col("k").cast("double").alias("c")).where(F.col("c").isin(rounded)).groupBy("c", "k").count()
        exact = {r.c: r.k for r in near.groupBy("c").agg(F.max_by("k", F.struct("count", "k")).alias("k")).collect()}
    found = [exact[c] if c in exact else min(int(c), (1 << 63) - 1) for c in found]
    out: list[tuple] = []
    for k, same in groupby(sorted(found, reverse=True)):
        n = len(list(same))
        # Greater keys and, of a hot key, one share after the other; else the key itself begins the next bucket.
        out += [(k, i / n) for i in range(n)] + ([(k, 1.0)] if n > 1 else [])
    many = -(-nulls * parts // total) if total else 0
    return out + [(None, i / many) for i in range(many)]


def with_next(df: DataFrame, key: str, text: str, visit: Callable[[list[tuple]], pa.RecordBatch], schema: T.StructType, parts: int | None = None) -> DataFrame:
    """Walk the rows by descending integer ``key`` (nulls last, ties by text), each with the row after it; the last row's is the first.

    The walk is cut at approximate quantiles into buckets of about ``TASK_BYTES`` of text, one task each. The row that
    follows a bucket is the first row of the next bucket that has rows; it is sent along as a guest, so rows and texts are
    shuffled once. ``visit`` gets (row, next row) pairs of (key, text) and makes a record batch. What the driver collects
    is a few numbers a bucket.
    """
    spark = df.sparkSession
    df = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    seen = df.agg(F.count(F.lit(1)), F.count_if(F.col("k").isNull()), F.sum(F.octet_length("t"))).first()
    if not seen[0]:
        return spark.createDataFrame([], schema)
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen[2] // TASK_BYTES))
    cuts = _cuts(df, parts, seen[1], seen[0])
    hot = sorted({k for k, share in cuts if share > 0 and k is not None})
    # Bucket i ends where the first i + 1 cuts begin: ranks of the cuts' keys in descending order, nulls last.
    keys = np.array(sorted({~k for k, _ in cuts if k is not None}), np.int64)
    place = lambda k: len(keys) if k is None else int(np.searchsorted(keys, ~k))
    edges = np.array([2 * place(k) + 1 + share / 2 for k, share in cuts])

    @F.pandas_udf(T.IntegerType())
    def bucket(down: pd.Series, none: pd.Series, share: pd.Series) -> pd.Series:
        down, null = down.to_numpy(), none.to_numpy()
        at = np.searchsorted(keys, down)
        equal = at < len(keys)
        equal[equal] = keys[at[equal]] == down[equal]
        rank = np.where(null, 2 * len(keys) + 1, 2 * at + equal) + np.where(null | equal, share.to_numpy() / 2, 0)
        return pd.Series(np.searchsorted(edges, rank, side="right").astype("int32"))

    h = F.when(F.col("k").isNull() | F.col("k").isin(hot), F.shiftrightunsigned(F.xxhash64("t"), 1)) if hot or seen[1] else F.lit(None).cast("long")
    df = df.withColumn("h", h)
    share = F.coalesce(F.shiftright("h", 10) / F.lit(float(1 << 53)), F.lit(0.0))
    down, none = F.bitwise_not("k"), F.col("k").isNull()
    df = df.withColumn("b", bucket(F.coalesce(down, F.lit(0)), none, share))
    first = F.min(F.struct(none.alias("none"), down.alias("down"), "h"))
    heads = {r.b: (r.f.down, r.f.h) for r in df.groupBy("b").agg(first.alias("f")).collect()}
    have = sorted(heads)
    # A row that heads a bucket also visits the bucket before it.
    rows = [(b, *heads[b], have[i - 1]) for i, b in enumerate(have)]
    table = spark.createDataFrame(rows, "b int, head long, head_h long, before int")  # a row for each bucket
    leads = down.eqNullSafe(F.col("head")) & F.col("h").eqNullSafe(F.col("head_h"))
    to = F.explode(F.when(leads, F.array("b", -1 - F.col("before"))).otherwise(F.array("b"))).alias("p")
    dealt = df.join(F.broadcast(table), "b").select(to, "k", "h", "t").select(F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("b"), (F.col("p") < 0).alias("guest"), "k", "t", "h")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("b"))
    dealt = dealt.sortWithinPartitions("b", "guest", F.col("k").desc_nulls_last(), "h", "t")

    def run(batches):
        rows: list[tuple] = []
        held, bucket_now, spent, size = None, None, False, 0

        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                b, guest, k = cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py()
                if b != bucket_now:
                    held, bucket_now, spent = None, b, False
                if guest and spent:
                    continue
                row = (k, cols[3][i].as_py())
                if held is not None:
                    rows.append((held, row))
                    size += len(row[1])
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield visit(rows)
                        rows, size = [], 0
                held, spent = row, guest
        if rows:
            yield visit(rows)

    return dealt.mapInArrow(run, schema)


FINGERPRINTS = T.StructType(
    [T.StructField(n, t()) for n, t in (("doc_id", T.LongType), ("n_chars", T.LongType), ("edited_sha256", T.StringType), ("fingerprint", T.StringType), ("edited_fingerprint", T.StringType), ("near_edited", T.DoubleType), ("near_next", T.DoubleType))]
)


def _visit(rows: list[tuple]) -> pa.RecordBatch:
    out: list[list] = [[] for _ in FINGERPRINTS]
    last_text = last_sig = None
    for (k, text), (_, nxt) in rows:
        sig = last_sig if last_text is text else signature(text)
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        edited_sig, next_sig = signature(edited), signature(nxt)
        last_text, last_sig = nxt, next_sig
        for col, x in zip(out, (k, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(sig), to_text(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig)), strict=True):
            col.append(x)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=FINGERPRINTS.names)


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next text by descending key."""
    return with_next(df, key, text, _visit, FINGERPRINTS, parts)
