"""Near-duplicate vectors by NN-descent.

Vectors of one label (and length) link when their cosine, in double precision, is at least ``threshold``.

1. Equal vectors form classes, with their number of copies; from here on a class is one node.
2. Neighbour lists of ``K`` start from sorted random-projection codes: windows of vectors with neighbouring codes.
3. Descent: each node's list and its reverse list meet in one group; every pair in a group with at least one entry that is
   new since the last round is a candidate for the lists of both, and the ``K`` best stay. Groups without new entries don't
   meet. Rounds go on until few entries change. Reverse lists are bounded by ``K``, as the method has it; this bounds what
   is tried, not what is kept.
4. List entries at or above the threshold are links. Where a list is saturated, that is full of links, the links beyond
   it are counted exactly: lists grow to the whole component, whose members are compared tile by tile, so that no task
   holds more than two tiles and no pair leaves its task. Before that, components that only saturated nodes link (a list
   that isn't full holds its links) are joined: saturated nodes of different components of a label are compared unless
   the balls around them, by their centres' angle and their radii, are too far apart.
5. Audit: nodes without links, with some, and with many are sampled apart, ``AUDIT`` of each, and compared with all
   vectors of their label. Recall is the mean over vectors of the share of their links that was found, so a large family
   doesn't hide what is lost in small ones; nodes of each kind count by their number, and no kind with links may fall
   short. As long as recall is below ``RECALL``, further projections are added and the descent goes on. Where that falls
   behind, that is where the rounds still to be expected from the last one's gain try more pairs than there are, all pairs
   of a label are compared, tile by tile. So the result has the recall that is promised, or is exact; ``report`` says which.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows whose id or label is
null, link with nothing; vectors of different lengths never link; repeated rows are vectors of their own and link with
one another, rows that repeat an id too; columns besides the three that are named aren't read; an empty table gives an
empty table. A vector must fit a task some thousand times, whatever its length.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, spread
from .store import Store

K, TABLES, WINDOW, STRIDE, CODE = 10, 3, 160, 96, 24
ROUNDS, SETTLED = 5, 0.02
TILE = 1024
AUDIT, RECALL = 160, 0.99
#: Rows with vectors from which a component, a label or a vector is spread over tasks; bytes of vectors for a task.
HOT, TASK_BYTES = 256, 128 << 20
#: Bytes of the vectors with most copies that are broadcast at most.
SENT_BYTES = 32 << 20

log = logging.getLogger(__name__)
_LIST = "u long, v long, sim double"


def _packed(nodes: DataFrame) -> DataFrame:
    """Vectors (of floats or doubles) as bytes, which are sorted, shuffled and sent to Python without a look at each number."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "vector" else f for f in nodes.schema])
    at = nodes.columns.index("vector")

    def run(batches):
        for b in batches:
            col = b.column(at)
            numbers = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False)))) * numbers.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(numbers)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return nodes.mapInArrow(run, schema)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, from packed ones."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, dim))
    _, ends, raw = col.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(col.type) else np.int32)
    raw = np.frombuffer(raw, np.uint8)[ends[col.offset] : ends[col.offset + len(col)]]
    x = raw.view("<f4" if len(raw) == 4 * dim * len(col) else "<f8").astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _pairs(u: list[np.ndarray], v: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(join(u, np.int64)), pa.array(join(v, np.int64)), pa.array(join(s, np.float64))], names=["u", "v", "sim"])


def _codes(nodes: DataFrame, table: int) -> DataFrame:
    """Add ``code``: the signs of ``CODE`` random projections, first one in the highest bit."""

    def run(batches):
        for b in batches:
            dims, code = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                plane = np.random.default_rng([table, int(d)]).standard_normal((int(d), CODE))
                signs = _matrix(b.column(3).take(pa.array(at)), int(d)) @ plane > 0
                code[at] = signs @ (1 << np.arange(CODE - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=[*b.schema.names, "code"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema, T.StructField("code", T.LongType())]))


def _start(nodes: DataFrame, table: int, parts: int) -> DataFrame:
    """Candidate entries from windows over vectors in the order of their codes."""
    rows = _codes(nodes.select("node", "label", "dim", "vector"), table)
    # Cut evenly by range, whatever the labels' sizes.
    rows = rows.repartitionByRange(parts, "label", "dim", "code", "node").sortWithinPartitions("label", "dim", "code", "node")

    def best(ids, x):
        u, v, s = [], [], []
        for lo in range(0, max(1, len(ids) - (WINDOW - STRIDE)), STRIDE):
            w = slice(lo, lo + WINDOW)
            sim = x[w] @ x[w].T
            np.fill_diagonal(sim, -2)
            k = min(K, len(sim) - 1)
            if k < 1:
                continue
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            u.append(np.repeat(ids[w], k))
            v.append(ids[w][top].ravel())
            s.append(np.take_along_axis(sim, top, 1).ravel())
        return _pairs(u, v, s)

    def run(batches):
        group, ids, x = None, np.zeros(0, np.int64), None
        for b in batches:
            node, label, dim = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                now, more = (label[lo], int(dim[lo])), _matrix(b.column(3).slice(lo, hi - lo), int(dim[lo]))
                if now == group:  # with the last rows of this group before, as windows overlap
                    ids, x = np.concatenate((ids[STRIDE - WINDOW :], node[lo:hi])), np.concatenate((x[STRIDE - WINDOW :], more))
                else:
                    group, ids, x = now, node[lo:hi], more
                yield best(ids, x)

    return rows.mapInArrow(run, _LIST)


def _top(entries: DataFrame) -> DataFrame:
    """The ``K`` best entries of each node; those that were there before aren't new."""
    ranked = entries.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.bool_and("new").alias("new")).withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")))
    return ranked.where(f"r <= {K}").select("u", "v", "sim", "new")


def _descend(lists: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """Candidates from neighbours of neighbours, as (u, v, sim) that would enter u's list."""
    back = lists.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.col("sim").desc(), "u"))).where(f"r <= {K}")
    meet = lists.select(F.col("u").alias("g"), F.col("v").alias("m"), "new").union(back.select(F.col("v").alias("g"), F.col("u").alias("m"), "new"))
    meet = meet.groupBy("g", "m").agg(F.bool_or("new").alias("new"))
    meet = meet.join(meet.where("new").select("g").distinct(), "g", "left_semi")
    worst = lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("m"), F.when(F.col("c") == K, F.col("worst")).otherwise(-2.0).alias("worst"))
    rows = meet.join(nodes.select(F.col("node").alias("m"), "dim", "vector"), "m").join(worst, "m")
    rows = rows.select("g", "m", "dim", "worst", "vector", "new").repartition(parts, "g").sortWithinPartitions("g", "m")

    def run(batches):
        held = None

        def work(table, final):
            g = table.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            rest = None if final else table.slice(cuts[-2])
            ends = cuts[1:] if final else cuts[1:-1]
            m, worst, dim, new = table.column(1).to_numpy(), table.column(3).to_numpy(), table.column(2).to_numpy(), table.column(5).to_numpy()
            u, v, s = [], [], []
            x = {int(d): _matrix(table.column(4).filter(pa.array(dim == d)), int(d)) for d in np.unique(dim)}
            place = np.zeros(len(g), np.int64)
            for d in x:
                place[dim == d] = np.arange(len(x[d]))
            for lo, hi in zip(cuts, ends, strict=False):
                p = int(place[lo])
                y = x[int(dim[lo])][p : p + hi - lo]
                sim = y @ y.T
                np.fill_diagonal(sim, -3)
                own = new[lo:hi]
                a, b = np.nonzero((sim > worst[lo:hi, None]) & (own[:, None] | own[None, :]))
                if len(a):
                    u.append(m[lo:hi][a])
                    v.append(m[lo:hi][b])
                    s.append(sim[a, b])
            return _pairs(u, v, s), rest

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None or not held.num_rows else pa.concat_tables([held, t]).combine_chunks()
            if held.num_rows > 4096:
                out, held = work(held, False)
                yield out
        if held is not None and held.num_rows:
            yield work(held, True)[0]

    return rows.mapInArrow(run, _LIST)


def _tiled(rows: DataFrame, by: list[str], total: int, store: Store) -> DataFrame:
    """Rows with the number of ``tiles`` that their group has, written as they are read several times."""
    rows = store.cut(rows, "untiled")
    size = store.cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size")), "sizes")
    return spread(rows, size, by, "size", total, HOT).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))


def _crossing(full: DataFrame, threshold: float, total: int, store: Store) -> DataFrame:
    """Links (u, v) between saturated nodes of different components, one at least for every two components so linked.

    The nodes of a component lie in balls of about ``TILE``. Pairs of balls that their bounds don't keep apart are
    compared node by node, about two tiles in a task.
    """
    rows = _tiled(full, ["component"], total, store).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = store.cut(rows.select("component", "cell", "label", "dim", "node", "vector"), "cells")

    def ball(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vector"), table.column("dim")[0].as_py())
        c = x.mean(0)
        c = c / np.linalg.norm(c) if c.any() else x[0]
        one = table.select(["component", "cell", "label", "dim"]).slice(0, 1)
        return one.append_column("n", pa.array([len(x)], pa.int64())).append_column("vector", pa.array([c.astype("<f8").tobytes()], pa.binary())).append_column("radius", pa.array([float(np.arccos(np.clip((x @ c).min(), -1, 1)))]))

    shape = T.StructType([*rows.select("component", "cell", "label", "dim").schema, *T.StructType.fromDDL("n long, vector binary, radius double")])
    balls = _tiled(rows.groupBy("component", "cell").applyInArrow(ball, shape), ["label", "dim"], total, store).withColumn("t", F.pmod(F.xxhash64("component", "cell"), F.col("tiles")).cast("int"))
    balls = balls.select("label", "dim", "component", "cell", "n", "vector", "radius", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    balls = balls.withColumn("i", F.least("t", "o")).withColumn("j", F.greatest("t", "o")).drop("o")
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def near(table: pa.Table) -> pa.Table:
        i, j, dim = (table.column(c)[0].as_py() for c in ("i", "j", "dim"))
        component, cell, n, radius, t = (table.column(c).to_numpy() for c in ("component", "cell", "n", "radius", "t"))
        x = _matrix(table.column("vector"), dim)
        one, two = np.flatnonzero(t == i), np.flatnonzero(t == j)
        angle = np.arccos(np.clip(x[one] @ x[two].T, -1, 1)) - radius[one][:, None] - radius[two][None, :]
        a, b = np.nonzero((angle <= widest) & (component[one][:, None] != component[two][None, :]))
        a, b = one[a], two[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        return pa.table({"a": component[a], "ca": cell[a], "b": component[b], "cb": cell[b], "n": n[b]})

    pairs = store.cut(balls.groupBy("label", "dim", "i", "j").applyInArrow(near, "a long, ca int, b long, cb int, n long"), "near")
    many = pairs.groupBy("a", "ca").agg(F.ceil(F.sum("n") / TILE).alias("salts"))
    pairs = pairs.join(many, ["a", "ca"]).withColumn("salt", F.pmod(F.xxhash64("b", "cb"), F.col("salts")).cast("int"))
    left = pairs.select("a", "ca", "salt", F.col("a").alias("component"), F.col("ca").alias("cell"), F.lit(True).alias("own")).distinct()
    right = pairs.select("a", "ca", "salt", F.col("b").alias("component"), F.col("cb").alias("cell"), F.lit(False).alias("own"))
    met = left.union(right).join(rows, ["component", "cell"]).select("a", "ca", "salt", "own", "component", "node", "dim", "vector")

    def meet(table: pa.Table) -> pa.Table:
        own, component, node = (table.column(c).to_numpy(zero_copy_only=False) if c == "own" else table.column(c).to_numpy() for c in ("own", "component", "node"))
        x = _matrix(table.column("vector"), table.column("dim")[0].as_py())
        one, two = np.flatnonzero(own), np.flatnonzero(~own)
        linked = x[one] @ x[two].T >= threshold
        at = np.flatnonzero(linked.any(0))
        at = at[np.unique(component[two][at], return_index=True)[1]]
        return pa.table({"u": node[one][linked[:, at].argmax(0)] if len(at) else node[:0], "v": node[two][at]})

    return met.groupBy("a", "ca", "salt").applyInArrow(meet, "u long, v long")


def _forest(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join all that the links ``near`` between ``rows`` and ``cols`` join."""
    u, v = [], []
    new_row, new_col = near.any(1), near.any(0)
    for first in np.flatnonzero(new_row):
        if not new_row[first]:
            continue
        front = np.array([first])
        new_row[first] = False
        while len(front):
            at = np.flatnonzero(near[front].any(0) & new_col)
            new_col[at] = False
            front = np.flatnonzero(near[:, at].any(1) & new_row)
            new_row[front] = False
            for ids in (cols[at], rows[front]):
                u.append(np.full(len(ids), rows[first]))
                v.append(ids)
    return (np.concatenate(u), np.concatenate(v)) if u else (rows[:0], cols[:0])


def _degrees(members: DataFrame, threshold: float, total: int, store: Store, by: tuple[str, ...] = ("component",), links: bool = False) -> DataFrame:
    """``node, degree``: linked copies of other classes with the same ``by``, tile by tile.

    With ``links``, ``u, v, degree``: these with v null, and pairs (u, v) with degree null that join what is linked.
    """
    rows = _tiled(members, list(by), total, store).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    own = dict.fromkeys((*by, "dim"))
    rows = rows.select(*own, "node", "copies", "vector", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    rows = rows.select(*own, F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "node", "copies", "vector")

    def meet(table: pa.Table) -> pa.Table:
        i, j, dim = (table.column(c)[0].as_py() for c in ("i", "j", "dim"))
        t, node, copies = (table.column(c).to_numpy() for c in ("t", "node", "copies"))
        x = _matrix(table.column("vector"), dim)
        a, b = np.flatnonzero(t == i), np.flatnonzero(t == j)
        near = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            out, degree = node[a], near @ copies[b]
        else:
            out, degree = np.concatenate((node[a], node[b])), np.concatenate((near @ copies[b], near.T @ copies[a]))
        if not links:
            return pa.table({"node": out, "degree": degree})
        u, v = _forest(near, node[a], node[b])
        none = pa.nulls(len(u), pa.int64())
        return pa.table({"u": np.concatenate((out, u)), "v": pa.concat_arrays([pa.nulls(len(out), pa.int64()), pa.array(v)]), "degree": pa.concat_arrays([pa.array(degree), none])})

    met = rows.groupBy(*by, "i", "j").applyInArrow(meet, "u long, v long, degree long" if links else "node long, degree long")
    return met if links else met.groupBy("node").agg(F.sum("degree").alias("degree"))


def _audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Recall by vector of ``AUDIT`` nodes of each kind (no, some, or ``K`` links and more found), held against all vectors."""
    kinds = nodes.join(found, "node", "left").select("node", "label", "dim", "vector", F.coalesce("degree", F.lit(0)).alias("degree"))
    kinds = kinds.withColumn("kind", F.when(F.col("degree") == 0, 0).when(F.col("degree") < K, 1).otherwise(2))
    count = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    asked = [r for kind in count for r in kinds.where(F.col("kind") == kind).orderBy(F.xxhash64("node"), "node").limit(AUDIT).collect()]
    if not asked:
        return 1.0
    by: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r.label, r.dim) for r in asked}:
        own = [r for r in asked if (r.label, r.dim) == key]
        q = _matrix(pa.array([bytes(r.vector) for r in own], pa.binary()), key[1])
        by[key] = (np.array([r.node for r in own], np.int64), q)
    sent = nodes.sparkSession.sparkContext.broadcast(by)  # AUDIT vectors

    def run(batches):
        for b in batches:
            label, dim, copies, node = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy(), b.column(4).to_numpy(), b.column(0).to_numpy()
            for (own, d), (ids, q) in sent.value.items():
                at = np.flatnonzero((label == own) & (dim == d))
                if len(at):
                    near = (_matrix(b.column(3).take(pa.array(at)), d) @ q.T >= threshold) & (node[at][:, None] != ids[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(copies[at] @ near)], names=["node", "true"])

    true = nodes.select("node", "label", "dim", "vector", "copies").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    links = {r.node: r.true for r in true.collect()}  # of the nodes asked
    good = every = 0.0
    worst = 1.0
    for kind, n in count.items():
        shares = [min(1.0, r.degree / links[r.node]) if links.get(r.node) else None for r in asked if r["kind"] == kind]
        some = [x for x in shares if x is not None]
        good, every = good + n * sum(some) / len(shares), every + n * len(some) / len(shares)
        if kind and some:
            worst = min(worst, sum(some) / len(some))
    return min(worst, good / every) if every else 1.0


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, report: dict | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``report`` gets ``nodes``, ``projections``, the audited ``recall`` and whether all pairs were compared (``exact``).
    """
    spark = df.sparkSession
    store = Store(spark, "nn")
    rows = df.select(df[key].cast("long").alias("vec_id"), df[label].alias("label"), df[vector].alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    rows = rows.withColumn("ok", F.coalesce(F.when(valid, F.when(fine, (norm > 0) & (norm < float("inf")))), F.lit(False)))

    classes = rows.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = store.cut(classes, "classes")
    numbers = "vector" if classes.schema["vector"].dataType.elementType == T.FloatType() else F.col("vector").cast("array<double>").alias("vector")
    nodes = store.cut(_packed(classes.select("node", "label", F.size("vector").alias("dim"), numbers, "copies")), "nodes")
    n, size, total, dim = nodes.agg(F.count(F.lit(1)), *[F.coalesce(f, F.lit(0)) for f in (F.sum("dim"), F.sum("copies"), F.max("dim"))]).first()
    # A node's vector, of 4 bytes a number or 8, meets up to 2 K others in a round.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 8 * 2 * K // TASK_BYTES))
    every = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c") / 2)).first()[0] or 0.0
    lists, table, short = None, 0, 1.0
    told = report if report is not None else {}
    while True:
        tried, fresh = TABLES * n * WINDOW * WINDOW / STRIDE, lists
        for _ in range(TABLES):
            new = _start(nodes, table, parts).withColumn("new", F.lit(True))
            fresh = new if fresh is None else fresh.union(new)
            table += 1
        before, lists = lists, store.cut(_top(fresh), "lists")
        store.only(classes, nodes, lists)
        for _ in range(ROUNDS):
            tries = _descend(lists, nodes, parts).withColumn("new", F.lit(True))
            before, lists = lists, store.cut(_top(lists.withColumn("new", F.lit(False)).unionByName(tries)), "lists")
            changed = lists.where("new").count()
            store.drop(before)
            tried += n * (2 * K) ** 2 / 2
            if changed <= SETTLED * K * n:
                break
        links = lists.where(F.col("sim") >= threshold).select("u", "v")
        comp = store.cut(components(links, store), "components")
        full = lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("c")).where((F.col("worst") >= threshold) & (F.col("c") == K))
        full = store.cut(full.select(F.col("u").alias("node")), "full")
        plain = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().join(nodes.select(F.col("node").alias("v"), "copies"), "v")
        plain = plain.groupBy("u").agg(F.sum("copies").alias("degree")).withColumnRenamed("u", "node")
        if full.limit(1).count():
            crossing = store.cut(_crossing(nodes.join(comp.join(full, "node"), "node"), threshold, n, store), "crossing")
            if crossing.limit(1).count():
                comp = store.cut(components(links.union(crossing), store), "components")
            grown = comp.join(comp.join(full, "node").select("component").distinct(), "component")
            whole = _degrees(nodes.join(grown, "node"), threshold, n, store)
            plain = plain.join(grown.select("node"), "node", "left_anti").unionByName(whole)
        degree = store.cut(plain, "degrees")
        recall = _audit(nodes, degree, threshold)
        log.info("nn-descent: %d nodes, %d projections, audited recall %.4f", n, table, recall)
        told.update(nodes=n, projections=table, recall=recall, exact=False)
        if recall >= RECALL:
            break
        last, short = short, 1 - recall
        if short >= last or tried * np.log((1 - RECALL) / short) / np.log(short / last) >= every:
            log.warning("nn-descent: recall %.4f is below %.2f; all %.0f pairs of the labels are compared", recall, RECALL, every)
            met = store.cut(_degrees(nodes, threshold, n, store, ("label", "dim"), links=True), "met")
            told.update(recall=1.0, exact=True)
            comp = store.cut(components(met.where("v is not null").select("u", "v"), store), "components")
            degree = met.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("degree").alias("degree"))
            break
    of = classes.join(degree, "node", "left").join(comp, "node", "left")
    of = of.select("label", "vector", "copies", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    of = store.cut(of, "classes")
    store.only(of)
    good = spread(rows.where("ok"), of, ["label", "vector"], "copies", total, HOT, max(1, SENT_BYTES // (64 + 8 * dim))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
