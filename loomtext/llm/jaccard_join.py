"""Exact Jaccard join of documents on word shingles.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of ``k``-word shingles. The result has one row
per document with its component; copies are joined once, as one class.

Method. Jaccard distance is a metric, so pivots, Voronoi cells and triangle-inequality windows apply, but only among
documents that have something in common: unrelated documents are all at distance 1 from every pivot and no window can
part them. Documents are therefore first dealt to regions they can share with a partner, without a miss:

* A linked pair of sizes a <= b differs in at most H = (100-percent)(a+b)/(100+percent) shingles. In classes of similar
  size, shingles are dealt by hash into m = H+1+E slices; a linked pair has E+1 equal slices at least, so one of them is
  not empty unless both have more than E empty slices, and those documents are dealt again by another hash.
* Every class also has coordinates: its counts of shingles in 64 buckets or more, a quarter of its size at least. Their
  L1 distance is at most the number of differing shingles, so two classes whose coordinates are further apart than H are
  outside each other's window.
* A region is the set of classes with the same slice. Its pivot is one of its members: the smallest of those that reach
  the region's task first, which any member may be without changing the result. Members within the pivot's window form
  its cell; pairs across cells are looked for in the windows, in small regions pair by pair, in large ones tile by tile,
  so that a task holds two tiles. Large regions are dealt again, by other hashes, as long as that parts them. Cells that
  such a pair joins are one; no link crosses cells.
* Regions that largely coincide, as those of a common passage's slices do, are put together, which keeps every pair that
  meets and adds neither rows nor comparisons.
* A cell's members are compared exactly, tile by tile; only links that join components leave a task. In cells of more
  than ``LIMIT`` members, those within the radius of their pivots are joined first and need no comparisons among
  themselves; the others are compared region by region.
* Where links are asked for, all members of each cell are compared, also of large ones, and counted by class.
* Regions of more than ``LIMIT`` members are dealt again, by other hashes, into regions within them, and so on: a linked
  pair meets again on every level, while documents that only share the slice part.

Shingles and sets are held as 64-bit fingerprints; sets are told apart by 128 bits.

Sizes and overlaps are integers, exact at any size.

Edge cases: null text counts as empty; documents without words have size 0 and link with nothing; with fewer than
``k`` words the whole sequence is one shingle; a null id has component null and links with nothing; rows that repeat an
id are documents of their own, whose components have the smallest id that each reaches; columns besides the two that are
named aren't read; an empty table gives an empty table. A very long text is one row and must fit its task, with about 60
bytes for each of its words, and two sets of shingles must fit another.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import CHUNK, U, mix, shingles, slices, utf8
from .graph import components, gathered
from .store import Store

SEEDS, SMALL, TILE, LIMIT, TASK = 6, 48, 1024, 16384, 1 << 19
#: Classes (three numbers each) that may be broadcast, 6 MB.
SENT = 1 << 18
#: Shingles of a tile, about; a tile of long documents has fewer members.
TILE_SHINGLES = 1 << 19
#: Large regions are dealt again while that leaves at most this share of their members in large regions.
PARTED = 0.75
BUCKETS = 64
#: Regions are put together, by another hash each time, while that leaves at most this share of their rows.
FOLDED = 0.75


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@lru_cache(maxsize=8)
def _classes(percent: int, upto: int) -> np.ndarray:
    """Rows (lo, hi, slices, E) of the size classes that cover sizes up to ``upto``; a pair belongs to its smaller size's class."""
    out, lo = [], 1
    while lo <= upto:
        hi = max(lo, lo * 3 // 2 - 1)
        h = (100 - percent) * (hi + hi * 100 // percent) // (100 + percent)
        spare = max(1, int(np.ceil(2 * (h + 2) * np.exp(-lo / (h + 2))))) if h else 0
        out.append((lo, hi, h + 1 + spare, spare))
        lo = hi + 1
    return np.array(out, np.int64).reshape(-1, 4)


def _table(percent: int, largest: int) -> np.ndarray:
    size = 1024
    while size < largest:
        size *= 4
    return _classes(percent, size)


def set_marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit fingerprint of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    h = [np.array([mix(s, salt).sum(dtype=U) if len(s) else 0 for s in sets], U) for salt in (31, 32)]
    return n, _i64(mix(h[0], 33)), _i64(mix(h[1] + n.astype(U), 34))


def slice_marks(sets: list[np.ndarray], percent: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, mark) for every slice of every set, in all the classes and seeds it takes part in."""
    n = np.array([len(s) for s in sets], np.int64)
    if not len(n) or not n.max():
        return np.zeros(0, np.int64), np.zeros(0, U)
    table = _table(percent, int(n.max()))
    out_i, out_s = [], []
    own = np.searchsorted(table[:, 0], n, side="right") - 1
    step = 0
    while True:
        c = own - step
        ok = (n > 0) & (c >= 0)
        ok[ok] = n[ok] <= table[c[ok], 1] * 100 // percent
        if not ok.any():
            return np.concatenate(out_i), np.concatenate(out_s)
        who = np.flatnonzero(ok)
        for seed in range(SEEDS):
            m, spare, cls = table[c[who], 2], table[c[who], 3], c[who]
            flat = np.concatenate([sets[i] for i in who])
            sizes = n[who]
            base = np.concatenate(([0], np.cumsum(m)))
            a = mix(flat, 40 + seed + 100 * level)
            key = (((a >> U(32)) * np.repeat(m, sizes).astype(U)) >> U(32)).astype(np.int64) + np.repeat(base[:-1], sizes)
            b = mix(flat, 60 + seed + 100 * level)
            total = int(base[-1])
            count = np.bincount(key, minlength=total)
            lo = np.bincount(key, weights=(b & U(0xFFFFFFFF)).astype(np.float64), minlength=total)
            hi = np.bincount(key, weights=(b >> U(32)).astype(np.float64), minlength=total)
            mark = lo.astype(U) * U(0x9E3779B97F4A7C15) + hi.astype(U) * U(0xC2B2AE3D27D4EB4F) + count.astype(U)
            part = np.arange(total) - np.repeat(base[:-1], m)
            mark = mix(mark + (np.repeat(cls, m) * SEEDS + seed).astype(U) * U(0xD6E8FEB86659FD93) + part.astype(U) * U(0xA0761D6478BD642F), 70)
            full = count > 0
            out_i.append(np.repeat(who, m)[full])
            out_s.append(mark[full])
            empty = np.add.reduceat((~full).astype(np.int64), base[:-1])
            again = empty > spare
            if not again.any():
                break
            who = who[again]
            if seed == SEEDS - 1:  # all those meet in one region
                out_i.append(who)
                out_s.append(mix(c[who].astype(U), 80))
        step += 1


def _sets(batch: pa.RecordBatch, col: int, k: int):
    """(row range, sets) of a batch, some text at a time."""
    data, offs = utf8(batch.column(col))
    for a, b in slices(offs, 2 * CHUNK):
        yield a, b, shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The coordinates of each set: its shingles in each bucket, up to 255. Buckets are a power of 4, a quarter of the size or more."""
    n = np.array([len(s) for s in sets], np.int64)
    many = np.full(len(sets), BUCKETS)
    while (small := many * 4 < n).any():
        many[small] *= 4
    out = [b""] * len(sets)
    for b in np.unique(many).tolist():
        own = np.flatnonzero(many == b)
        flat = mix(np.concatenate([np.zeros(0, U), *(sets[i] for i in own)]), 90)
        key = (flat >> U(65 - b.bit_length())).astype(np.int64) + b * np.repeat(np.arange(len(own)), n[own])
        rows = np.minimum(np.bincount(key, minlength=b * len(own)), 255).astype(np.uint8).reshape(-1, b)
        for i, r in zip(own.tolist(), rows, strict=True):
            out[i] = r.tobytes()
    return out


def _folded(rows: list[bytes], b: int) -> np.ndarray:
    """Coordinates of sketches of one length, in ``b`` buckets."""
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return x.reshape(len(rows), b, -1).sum(2, dtype=np.int16 if x.shape[1] < 128 * b else np.int32)


def _in_window(x: list[bytes], y: list[bytes], total: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets each, of ``total`` shingles together, can link by their coordinates."""
    size = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    ok = np.zeros(len(size), bool)
    for la, lb in {tuple(r) for r in size.tolist()}:
        own, b = np.flatnonzero((size == (la, lb)).all(1)), min(la, lb)
        for lo in range(0, len(own), step := max(1, (1 << 21) // b)):
            at = own[lo : lo + step]
            left, right = [x[i] for i in at], [y[i] for i in at]
            apart = np.abs(_folded(left, b).astype(np.int32) - _folded(right, b)).sum(1, dtype=np.int64)
            full = np.array([255 in p or 255 in q for p, q in zip(left, right, strict=True)])  # counts that went on
            ok[at] = full | (apart * (100 + percent) <= (100 - percent) * total[at])
    return ok


def _marks(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, n, h1, h2, marks, sketch`` of every document."""

    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch, 1, k):
                n, h1, h2 = set_marks(sets)
                table = _table(percent, int(n.max()) if len(n) else 1)
                at = np.searchsorted(table[:, 0], n, side="right") - 1
                marks = np.where(n > 0, table[np.maximum(at, 0), 2], 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, (n, h1, h2, marks)), pa.array(sketches(sets), pa.binary())], names=["doc_id", "n", "h1", "h2", "marks", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, marks long, sketch binary")


def _regions(docs: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """``region, node, pivot`` (set fingerprints h1) of every region with two different sets or more.

    Marks travel as packed arrays, one row per task batch and target, so the shuffle has no row overhead. A target
    streams its arrays and remembers one pivot per mark; it never holds the members of a region together.
    """

    def deal(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            node, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            p = ((mark >> U(32)) * U(parts) >> U(32)).astype(np.int32)
            order = np.argsort(p, kind="stable")
            p, node, low = p[order], node[order], mark[order].astype(np.uint32)
            ends = np.flatnonzero(np.append(p[1:] != p[:-1], True)) + 1
            starts = np.concatenate(([0], ends[:-1]))
            pairs = list(zip(starts.tolist(), ends.tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(p[starts]), pa.array([low[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([node[a:b].tobytes() for a, b in pairs], pa.binary())],
                names=["p", "marks", "nodes"],
            )

        for batch in batches:
            for _, _, sets in _sets(batch, 1, k):
                _, h1, _ = set_marks(sets)
                who, mark = slice_marks(sets, percent)
                if len(who):
                    held.append((h1[who], mark))
                    size += len(who)
                if size > TASK // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def gather(batches):
        old_mark, old_pivot, old_told = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        held: list[tuple[bytes, bytes]] = []
        size, p = 0, None

        def flush():
            nonlocal old_mark, old_pivot, old_told
            mark = np.concatenate([np.frombuffer(m, np.uint32) for m, _ in held])
            node = np.concatenate([np.frombuffer(x, np.int64) for _, x in held])
            order = np.lexsort((node, mark))
            mark, node = mark[order], node[order]
            new = np.append(True, (mark[1:] != mark[:-1]) | (node[1:] != node[:-1]))
            mark, node = mark[new], node[new]
            head = np.append(True, mark[1:] != mark[:-1])
            group = np.cumsum(head) - 1
            heads, firsts = mark[head], node[head]
            at = np.searchsorted(old_mark, heads)
            known = (at < len(old_mark)) & (old_mark[np.minimum(at, max(len(old_mark) - 1, 0))] == heads) if len(old_mark) else np.zeros(len(heads), bool)
            pivot, told = firsts.copy(), np.zeros(len(heads), bool)
            if known.any():
                pivot[known], told[known] = old_pivot[at[known]], old_told[at[known]]
            other = node != pivot[group]
            has = np.zeros(len(heads), bool)
            has[group[other]] = True
            tell = has & ~told
            region = (np.int64(p) << 32) | heads.astype(np.int64)
            r = np.concatenate((region[group[other]], region[tell]))
            n = np.concatenate((node[other], pivot[tell]))
            v = np.concatenate((pivot[group[other]], pivot[tell]))
            told |= has
            if known.any():
                old_told[at[known]] = told[known]
            fresh = ~known
            old_mark = np.concatenate((old_mark, heads[fresh]))
            order = np.argsort(old_mark, kind="stable")
            old_pivot, old_told = np.concatenate((old_pivot, pivot[fresh]))[order], np.concatenate((old_told, told[fresh]))[order]
            old_mark = old_mark[order]
            return pa.RecordBatch.from_arrays([pa.array(r), pa.array(n), pa.array(v)], names=["region", "node", "pivot"])

        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(0)[i].as_py()
                if now != p and held:
                    yield flush()
                    held, size = [], 0
                if now != p:
                    p, old_mark, old_pivot, old_told = now, old_mark[:0], old_pivot[:0], old_told[:0]
                held.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
                size += len(held[-1][0]) >> 2
                if size > 2 * TASK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    dealt = docs.mapInArrow(deal, "p int, marks binary, nodes binary").repartitionById(parts, F.col("p"))
    return dealt.sortWithinPartitions("p").mapInArrow(gather, "region long, node long, pivot long")


def _reps_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``rep, shingles`` of the classes in ``reps (rep, h1, h2)``, made again from the texts.

    Up to ``SENT`` classes are sent to the texts; more meet them in a shuffle.
    """
    few = reps.limit(SENT + 1).count() <= SENT
    texts = docs.join(F.broadcast(reps) if few else reps.hint("merge"), docs.doc_id == reps.rep).select("text", "rep", "h1", "h2")

    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch, 0, k):
                _, h1, h2 = set_marks(sets)
                same = (h1 == batch.column(2).slice(a, b - a).to_numpy()) & (h2 == batch.column(3).slice(a, b - a).to_numpy())
                keep = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a).take(pa.array(keep)), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["rep", "shingles"])

    return texts.mapInArrow(run, "rep long, shingles binary")


def _may_link(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't rule out, as (a, b)."""
    left = light.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = light.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b").where(f"na * 100 >= nb * {percent} and nb * 100 >= na * {percent}").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for t in batches:
            ok = _in_window(t.column(4).to_pylist(), t.column(5).to_pylist(), t.column(2).to_numpy() + t.column(3).to_numpy(), percent)
            yield t.select([0, 1]).filter(pa.array(ok))

    return rows.mapInArrow(run, "a long, b long")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact comparison of pairs (a, b): ``a, b, same, total, linked``.

    Pairs are grouped by a, in salted groups of about 256, so that a's set is sent once a group.
    """
    salted = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / 256)).cast("long"))
    groups = salted.select("a", "salt").distinct()
    one = groups.join(sets.select(F.col("rep").alias("a"), "shingles"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    many = salted.select("a", "salt", "b").join(sets.select(F.col("rep").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = one.union(many).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        key, base = None, None
        for t in batches:
            out: list[list] = [[], [], [], []]
            for a, salt, b, raw in zip(*(t.column(i).to_pylist() for i in range(4)), strict=True):
                s = np.frombuffer(raw, U)
                if b is None:
                    key, base = (a, salt), s
                elif key == (a, salt):
                    at = np.searchsorted(base, s)
                    same = int((base[np.minimum(at, len(base) - 1)] == s).sum())
                    for col, x in zip(out, (a, b, same, len(base) + len(s) - same), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "same", "total"])

    return rows.mapInArrow(run, "a long, b long, same long, total long").withColumn("linked", F.expr(f"100 * same >= {percent} * total"))


def _dealt_again(members: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """Members (region, rep, label) of large regions, in regions within their regions."""
    rows = members.join(sets.select("rep", "shingles"), "rep").select("region", "rep", "label", "shingles")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            region, rep, label = (batch.column(i).to_numpy() for i in range(3))
            who, mark = slice_marks([np.frombuffer(x, U) for x in batch.column(3).to_pylist()], percent, level)
            inner = _i64(mix(region[who].view(U) * U(0x9FB21C651E98DF25) + mark, 95))
            yield pa.RecordBatch.from_arrays([pa.array(inner), pa.array(rep[who]), pa.array(label[who])], names=["region", "rep", "label"])

    return rows.mapInArrow(run, "region long, rep long, label long")


def _open(members: DataFrame) -> DataFrame:
    """Members (region, rep, label) of the regions that hold different labels, with their region's number.

    Of regions with the same members only one stays.
    """
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), *marks)
    size = size.where("size > 1 and lo < hi").groupBy("size", "m0", "m1").agg(F.min("region").alias("region"))
    return members.join(size.select("region", "size"), "region")


def _merged(members: DataFrame, store: Store) -> DataFrame:
    """Members (region, rep, label, size) of open regions, a table of ``store`` that is dropped, with regions that largely coincide as one.

    Regions whose first member by a hash is the same are put together if the square of what they hold together is at most
    the sum of their squares, so neither rows nor comparisons grow, and whoever met still meets.
    """
    now, seed, rows, before = members, 0, members.count(), None
    while rows and (before is None or rows <= FOLDED * before):
        last, now = now, gathered(now, rows)
        first = now.groupBy("region").agg(F.min(F.xxhash64("rep", F.lit(seed))).alias("first"))
        # Each row holds its region's size, so these sum up to squares.
        held = now.join(first, "region").groupBy("first", "rep").agg(F.sum(F.col("size").cast("double")).alias("size"), F.min("region").alias("lo"), F.max("region").alias("hi"))
        held = held.groupBy("first").agg(F.count(F.lit(1)).cast("double").alias("held"), F.sum("size").alias("squares"), F.min("lo").alias("into"), F.max("hi").alias("hi"))
        into = first.join(held.where("into < hi and held * held <= squares"), "first").select("region", "into")
        moved = store.cut(now.join(into, "region", "left").select(F.coalesce("into", "region").alias("region"), "rep", "label").distinct(), "moved")
        now = store.cut(_open(gathered(moved, rows)), "merged")
        store.drop(last, moved)
        seed, before, rows = seed + 1, rows, now.count()
    return now


def _tiled(members: DataFrame) -> DataFrame:
    """Members (region, rep, label, tiles) once for every pair of tiles (i, j) that their own tile t is in.

    With a column ``own``, the first ``own`` tiles are those of members with ``main``, which don't meet each other.
    """
    own = F.col("own") if "own" in members.columns else F.lit(0)
    main = F.col("main") if "own" in members.columns else F.lit(False)
    t = F.when(main, F.pmod(F.xxhash64("rep"), own)).otherwise(own + F.pmod(F.xxhash64("rep"), F.col("tiles") - own))
    rows = members.withColumn("t", t.cast("int"))
    rows = rows.select("region", "rep", "label", "t", F.explode(F.sequence(F.when(main, own).otherwise(F.lit(0)), F.col("tiles") - 1)).alias("o"))
    return rows.select("region", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "rep", "label", "t")


def _forest(pairs, label: np.ndarray, rep: np.ndarray) -> pa.Table:
    """Of pairs of rows, those that join labels not yet joined, as (a, b)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = y
        return x

    found = []
    for u, v in pairs:
        p, q = top(int(label[u])), top(int(label[v]))
        if p != q:
            up[max(p, q)] = min(p, q)
            found.append((int(rep[u]), int(rep[v])))
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def _windows(members: DataFrame, light: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) of different labels within each other's window, enough to join all labels that such pairs join.

    Tile by tile: two tiles meet in one task, but for two of the label with most members, which is joined already. So a
    label's members are copied by the tiles of the others only.
    """
    most = members.where(f"size > {2 * TILE}").groupBy("region", "label").agg(F.count(F.lit(1)).alias("most"))
    most = most.groupBy("region").agg(F.max(F.struct("most", "label")).alias("x")).select("region", "x.most", F.col("x.label").alias("top"))
    rows = members.join(most, "region", "left").withColumn("main", F.coalesce(F.col("label") == F.col("top"), F.lit(False)))
    tiles = [F.ceil(n / (2 * TILE)).cast("int") for n in (F.coalesce("most", F.lit(0)), F.col("size") - F.coalesce("most", F.lit(0)))]  # coordinates are small
    rows = _tiled(rows.withColumn("own", tiles[0]).withColumn("tiles", tiles[0] + tiles[1]))
    rows = rows.join(light.select("rep", "n", "sketch"), "rep").select("region", "i", "j", "t", "rep", "label", "n", "sketch")

    def meet(table: pa.Table) -> pa.Table:
        t, rep, label, n = (table.column(c).to_numpy() for c in ("t", "rep", "label", "n"))
        sketch = table.column("sketch").to_pylist()
        coarse = np.concatenate([_folded([r], BUCKETS) for r in sketch]).astype(np.int32)
        full = np.array([255 in r for r in sketch])
        one, two = np.flatnonzero(t == table.column("i")[0].as_py()), np.flatnonzero(t == table.column("j")[0].as_py())

        def near():
            for lo in range(0, len(one), 32):
                rows = one[lo : lo + 32]
                total = n[rows][:, None] + n[two][None, :]
                apart = np.abs(coarse[rows][:, None, :] - coarse[two][None, :, :]).sum(2, dtype=np.int64)
                close = (apart * (100 + percent) <= (100 - percent) * total) | full[rows][:, None] | full[two][None, :]
                close &= (label[rows][:, None] != label[two][None, :]) & (np.minimum(n[rows][:, None], n[two][None, :]) * 100 >= np.maximum(n[rows][:, None], n[two][None, :]) * percent)
                u, v = np.nonzero(close)
                u, v = rows[u], two[v]
                fine = _in_window([sketch[i] for i in u], [sketch[i] for i in v], n[u] + n[v], percent)
                yield from zip(u[fine].tolist(), v[fine].tolist(), strict=True)

        return _forest(near(), label, rep)

    return rows.repartition(parts, "region", "i", "j").groupBy("region", "i", "j").applyInArrow(meet, "a long, b long")


def _linked(own: list[np.ndarray], percent: int, block: int = 4096) -> np.ndarray:
    """Whether each two of the sets link."""
    n = np.array([len(s) for s in own], np.int64)
    _, at, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = often > 1  # only these can be in two sets
    rows_of, cols_of = np.repeat(np.arange(len(own)), n)[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    order = np.argsort(cols_of, kind="stable")
    rows_of, cols_of = rows_of[order], cols_of[order]
    same = np.zeros((len(own), len(own)), np.int64)
    for lo in range(0, int(shared.sum()), block):  # a dense block of shingles at a time, whose counts fit single precision
        a, b = np.searchsorted(cols_of, (lo, lo + block))
        x = np.zeros((len(own), block), np.float32)
        x[rows_of[a:b], cols_of[a:b] - lo] = 1
        same += (x @ x.T).astype(np.int64)
    return 100 * same >= percent * (n[:, None] + n[None, :] - same)


def _tiles(members: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Exact links (a, b) between different labels, enough to join all labels that links join, tile by tile.

    No pair leaves its task but these: at most one fewer than there are labels in two tiles.
    """
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingled") / TILE_SHINGLES)).cast("int")
    rows = _tiled(members.withColumn("tiles", tiles)).join(sets, "rep").select("region", "i", "j", "t", "rep", "label", "shingles")

    def meet(table: pa.Table) -> pa.Table:
        t, rep, label = (table.column(c).to_numpy() for c in ("t", "rep", "label"))
        own = [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]
        linked = _linked(own, percent) & (label[:, None] != label[None, :])
        u, v = np.nonzero(np.triu(linked, 1))
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            u, v = u[t[u] != t[v]], v[t[u] != t[v]]
        return _forest(zip(u.tolist(), v.tolist(), strict=True), label, rep)

    return rows.repartition(parts, "region", "i", "j").groupBy("region", "i", "j").applyInArrow(meet, "a long, b long")


def _degrees(cells: DataFrame, sets: DataFrame, copies: DataFrame, percent: int, parts: int) -> DataFrame:
    """``rep, degree``: linked copies of other classes, for every class in ``cells``, tile by tile.

    ``copies`` (rep, n, copies) are documents of a class. No link crosses cells, so each pair is counted in one region only.
    """

    rows = cells.join(copies, "rep").select(F.col("cell").alias("region"), "rep", "n", "copies")
    size = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingled"))
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingled") / TILE_SHINGLES)).cast("int")
    dealt = _tiled(rows.join(size, "region").select("region", "rep", F.col("copies").alias("label"), tiles.alias("tiles")))
    dealt = dealt.join(sets, "rep").select("region", "i", "j", "rep", F.col("label").alias("copies"), "t", "shingles")

    def meet(table: pa.Table) -> pa.Table:
        t, rep, copies = (table.column(c).to_numpy() for c in ("t", "rep", "copies"))
        linked = _linked([np.frombuffer(x, U) for x in table.column("shingles").to_pylist()], percent)
        np.fill_diagonal(linked, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            linked &= t[:, None] != t[None, :]
        return pa.table({"rep": rep, "degree": linked @ copies})

    met = dealt.repartition(parts, "region", "i", "j").groupBy("region", "i", "j").applyInArrow(meet, "rep long, degree long")
    return met.groupBy("rep").agg(F.sum("degree").alias("degree"))


def _shingled(members: DataFrame, light: DataFrame) -> DataFrame:
    """Members with their region's number of shingles."""
    total = members.join(light.select("rep", "n"), "rep").groupBy("region").agg(F.sum("n").alias("shingled"))
    return members.join(total, "region")


def _cells(pairs: DataFrame, store: Store) -> DataFrame:
    """``rep, cell`` of everything that pairs (a, b) join."""
    return components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), store).select(F.col("node").alias("rep"), F.col("component").alias("cell"))


def _across(left: DataFrame, light: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) of different labels in one region and within each other's window, enough to join all such labels."""
    few = left.where(f"size <= {SMALL}")
    other = few.select("region", F.col("rep").alias("b"), F.col("label").alias("lb"))
    pairs = few.select("region", F.col("rep").alias("a"), F.col("label").alias("la")).join(other, "region").where("a < b and la <> lb").select("a", "b").distinct()
    return _may_link(pairs, light, percent).union(_windows(left.where(f"size > {SMALL}"), light, percent, parts)).distinct()


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, links: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document (links as defined above).

    With ``links`` also ``n_links``: the other documents it links with, copies included; all pairs of a cell are compared.
    """
    store = Store(df.sparkSession, "jaccard")
    docs = df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text"))
    marks = store.cut(_marks(docs, k, percent), "marks")
    ids = marks.where("doc_id is not null")
    if not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _joined(docs, marks, k, percent, links, store)
    # Ids repeat: rows are joined by a number of their own, written with them as it must not change.
    numbered = store.cut(docs.where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    rows = numbered.select(F.col("row").alias("doc_id"), "text")
    found = _joined(rows, store.cut(_marks(rows, k, percent), "marks"), k, percent, links, store).withColumnRenamed("doc_id", "row")
    found = store.cut(found.join(numbered.select("row", "doc_id"), "row"), "found")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    counts = ["n_links"] if links else []
    out = found.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"), *counts)
    none = marks.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in counts])
    return out.union(none)


def _joined(docs: DataFrame, marks: DataFrame, k: int, percent: int, links: bool, store: Store) -> DataFrame:
    """The result for documents whose ids don't repeat, from their ``marks``."""
    spark, counted = docs.sparkSession, links
    with_id = docs.where("doc_id is not null")
    linkable = marks.where("doc_id is not null and n > 0")
    classes = linkable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))

    total = marks.agg(F.sum("marks")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    regions = store.cut(_regions(with_id, k, percent, parts), "regions")
    # Coordinates travel for the classes that share a region with others only.
    some = store.cut(classes.join(regions.select(F.col("node").alias("h1")).distinct(), "h1"), "some")
    few = some.limit(SENT + 1).count() <= SENT
    own = marks.select(F.col("doc_id").alias("rep"), "sketch")
    light = store.cut((own.join(F.broadcast(some), "rep") if few else own.join(some.hint("merge"), "rep")).select("rep", "h1", "h2", "n", "copies", "sketch"), "light")
    names = light.select("rep", "h1")

    # Cells: members within the window of their region's pivot, then of any other member of their region.
    pairs = regions.where("node <> pivot").select("pivot", "node").distinct()
    pairs = pairs.join(names.select(F.col("rep").alias("a"), F.col("h1").alias("pivot")), "pivot").join(names.select(F.col("rep").alias("b"), F.col("h1").alias("node")), "node")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = store.cut(_may_link(pairs, light, percent), "first")
    cells = store.cut(_cells(first, store), "cells")
    met = regions.count()  # no fewer than members, and than classes in cells
    members = store.cut(gathered(regions.join(names.select("rep", F.col("h1").alias("node")), "node").select("region", "rep").distinct(), met), "members")
    left = gathered(members, met).join(gathered(cells, met), "rep", "left").select("region", "rep", F.coalesce("cell", "rep").alias("label"))
    left = _merged(store.cut(_open(left).where("size > 2"), "left"), store)
    level, before = 0, None
    while (many := left.where(f"size > {LIMIT}").count()) and (before is None or many <= PARTED * before):
        level, before, large = level + 1, many, left.where(f"size > {LIMIT}")
        own = _reps_sets(with_id, light.join(large.select("rep").distinct(), "rep").select("rep", "h1", "h2"), k)
        left = _merged(store.cut(left.where(f"size <= {LIMIT}").unionByName(_open(_dealt_again(large, own, percent, level).distinct())), "left"), store)
    pairs = store.cut(first.union(_across(left, light, percent, parts)), "pairs")
    cells = store.cut(_cells(pairs, store), "cells")

    # Exact comparison of each cell's members, tile by tile.
    sets = store.cut(_reps_sets(with_id, light.join(cells.select("rep"), "rep").select("rep", "h1", "h2"), k), "sets")
    one = cells.select(F.col("cell").alias("region"), "rep", F.col("rep").alias("label"))
    one = store.cut(_open(gathered(one, cells.count())), "one")
    links = _tiles(_shingled(one.where(f"size <= {LIMIT}"), light), sets, percent, parts)
    large = one.where(f"size > {LIMIT}").select(F.col("region").alias("cell")).distinct()
    if large.limit(1).count():  # pivots first, then what they leave apart, region by region
        inside = pairs.join(cells.withColumnRenamed("rep", "a"), "a").join(large, "cell", "left_semi").select("a", "b")
        told = _compare(inside, sets, percent).where("linked").select("a", "b")
        links = store.cut(links.union(told), "links")
        balls = store.cut(_cells(links, store).withColumnRenamed("cell", "ball"), "balls")
        inner = members.join(cells.join(large, "cell", "left_semi"), "rep").join(balls, "rep", "left")
        inner = inner.select(F.xxhash64("region", "cell").alias("region"), "rep", F.coalesce("ball", "rep").alias("label")).distinct()
        inner = _merged(store.cut(_open(inner), "inner"), store)
        links = links.union(_tiles(_shingled(inner, light), sets, percent, parts))
    found = store.cut(_cells(links, store).withColumnRenamed("cell", "component"), "components")

    of = classes.join(found, "rep", "left").select("h1", "h2", "rep", "copies", F.coalesce("component", "rep").alias("component"))
    cols = ["doc_id", F.col("n").alias("n_shingles")]
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    cols.append(F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    if counted:
        degree = _degrees(cells, sets, light.select("rep", "n", "copies"), percent, parts)
        of = store.cut(of.join(degree, "rep", "left").withColumn("links", F.coalesce("degree", F.lit(0)) + F.col("copies") - 1), "counts")
        cols.append(F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links"))
    return marks.join(of.drop("rep", "copies"), ["h1", "h2"], "left").select(*cols)
