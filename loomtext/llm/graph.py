"""Connected components by alternating large-star and small-star steps over DataFrames, and joins with hot keys.

Tables of at most ``FEW`` rows of a few numbers are worked on in one task: a shuffle has a cost for each of its partitions
that such a table doesn't repay. Larger ones are shuffled, with the same results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

#: Hot keys that may be broadcast, and the rows from which a key may be one.
SENT, HOT = 1 << 14, 1 << 16
#: Rows of a few numbers, some MB, that one task may hold.
FEW = 1 << 18


def gathered(rows: DataFrame, total: int) -> DataFrame:
    """``rows``, ``total`` of them or fewer; few are put into one partition, so grouping and joining them needs no shuffle."""
    return rows.coalesce(1) if total <= FEW else rows


def spread(rows: DataFrame, keys: DataFrame, by: list[str], size: str, total: int, hot: int = HOT, sent: int = SENT) -> DataFrame:
    """``rows`` joined with ``keys``, a row for each key with its number of rows in ``size``, without hot tasks.

    Of ``total`` rows at most ``sent`` keys can have more than a ``sent``-th each; these are broadcast, by that bound, and
    their rows stay where they are. The others meet in a shuffle, where no key has more rows than that.
    """
    bound = max(hot, -(-total // sent))
    if total <= bound:
        return rows.join(keys, by)
    given = [c for c in keys.columns if c not in by]
    marked = rows.join(F.broadcast(keys.where(F.col(size) > bound)), by, "left")
    seldom = marked.where(F.col(size).isNull()).drop(*given).join(keys.where(F.col(size) <= bound), by)
    return marked.where(F.col(size).isNotNull()).unionByName(seldom)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each node's neighbours to the smallest of them; the ``total`` ``edges`` (u, v) hold u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    out = spread(both, least, ["u"], "size", 2 * total if large else total).where(F.col("v") > F.col("u") if large else F.lit(True))
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _at_once(batches):
    """``(node, component)`` of all edges (u, v), in one task."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(u), top(v)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, store: Store) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its smallest node.

    ``edges`` are undirected pairs (u, v) of longs. Up to ``FEW`` are joined in one task, more in rounds. Each round is cut
    to the shared folder; the driver sees a count and a checksum only.
    """
    now = store.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    if now.limit(FEW + 1).count() <= FEW:
        return now.coalesce(1).mapInArrow(_at_once, "node long, component long")
    every, now, seen = now, store.cut(now.distinct(), "edges"), None
    store.drop(every)
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        # The first step makes no more edges than it has, the second one adds at most as many nodes.
        last, now = now, store.cut(_star(_star(now, True, mark[0]), False, 2 * mark[0]), "star")
        store.drop(last)
