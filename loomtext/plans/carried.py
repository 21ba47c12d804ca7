"""Record programs that go on from document to document, without one task for all: each document by itself first, then sums.

This holds for programs of selectors and one record program whose main part only adds (``n += NF``, ``n++``), prints nothing
and reads no sum, and whose END reads sums and NR only. Each document's own sums are found in parallel and written, dealt by
ranges of the order without their texts, added up within and before each range, and END runs on what they come to. A variable
that nothing has been added to yet is unset, as in a single run. Sums of fractions are added range by range, so their last
binary digit may be another. Documents with equal places follow each other in any order, as they do in one task.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..awk.run import Machine
from ..awk.syntax import Program, parse, walk
from ..cluster import scratch
from ..lang.program import Awk, Fuzzy, Node, Reduce, Select, Simple
from ..operators.edit import NotExact
from .local import run_document
from .records import adding, dealt_by_range, starts

_PURE = frozenset("num str var bin cmp and or not neg pos cond cat call expr block if".split())
_CALLS = frozenset("int sqrt exp log sin cos atan2 length substr index tolower toupper sprintf".split())
_OWN = frozenset("FS OFS ORS SUBSEP NR NF".split())


def adds(nodes: tuple[Node, ...]) -> tuple[Program, tuple[str, ...]]:
    """The record program and the variables it adds to; ``NotExact`` for programs of another kind."""
    if not nodes or not isinstance(nodes[-1], Awk) or not all(isinstance(n, (Select, Fuzzy, Reduce)) or (isinstance(n, Simple) and n.kind not in "p=") for n in nodes[:-1]):
        raise NotExact("more than selectors and a record program")
    prog = parse(nodes[-1].source)
    names = adding(prog.main)
    if prog.begin or _OWN & set(names) or len(names) != sum(t[0] in ("assign", "incr") for t in walk(prog.main)):
        raise NotExact("keeps more than sums")
    for part, more in ((prog.main, {"field", "assign", "incr", "next"}), (prog.end, {"print", "printf"})):
        for t in walk(part):
            if t[0] not in _PURE | more or (t[0] == "call" and t[1] not in _CALLS):
                raise NotExact(f"{t[0]} may depend on earlier documents")
    if any(t == ("var", "NF") or (t[0] == "print" and not t[1]) or (t[0] == "call" and t[1] == "length" and not t[2]) for t in walk(prog.end)):
        raise NotExact("END reads the last record")
    return prog, tuple(dict.fromkeys(names))


def ends(docs: DataFrame, nodes: tuple[Node, ...], key: str, text: str, order: tuple[str, ...], decode) -> DataFrame:
    """``key, text``: what END prints for each document, in the given order of documents."""
    prog, names = adds(nodes)
    spark, places = docs.sparkSession, [f"__o{i}" for i in range(len(order))]
    rows = docs.select(F.col(text), F.col(key).alias("__key"), *[F.col(c).alias(o) for c, o in zip(order, places, strict=True)])
    own = T.StructType([*rows.schema.fields[1:], T.StructField("__a", T.LongType()), *[T.StructField(f"__a{i}", T.DoubleType()) for i in range(len(names))]])

    def run(batches):
        for b in batches:
            counts, sums = [], [[] for _ in names]
            for doc in b.column(0).to_pylist():
                machine = Machine(Program(main=prog.main))
                run_document(nodes, decode(doc), {id(nodes[-1]): machine})
                counts.append(machine.nr)
                for s, name in zip(sums, names, strict=True):
                    s.append(machine.vars.get(name))
            made = [*b.columns[1:], pa.array(counts, pa.int64()), *[pa.array(s, pa.float64()) for s in sums]]
            yield pa.RecordBatch.from_arrays(made, names=own.names)

    # Written before the deal, whose ranges are found by a run of their own.
    folder = f"{scratch(spark)}/loomtext/sums-{uuid.uuid4().hex}"
    rows.mapInArrow(run, own).write.parquet(folder)
    dealt, added = dealt_by_range(spark.read.parquet(folder), places), [c for c in own.names if c.startswith("__a")]
    here = Window.partitionBy("__range").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("__range", "__key", *[F.sum(c).over(here).alias(f"{c}h") for c in added]).join(F.broadcast(starts(dealt, added)), "__range")
    total = lambda c: F.when(F.col(f"{c}h").isNotNull() | F.col(f"{c}b").isNotNull(), F.coalesce(f"{c}h", F.lit(0)) + F.coalesce(f"{c}b", F.lit(0)))
    schema = T.StructType([T.StructField("__key", own["__key"].dataType), T.StructField("text", T.StringType())])

    def finish(batches):
        machine = Machine(Program(end=prog.end))
        fresh = dict(machine.vars)
        for b in batches:
            out = []
            for nr, *values in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True):
                machine.nr, machine.vars = nr, fresh | {n: v for n, v in zip(names, values, strict=True) if v is not None}
                out.append(machine.run(()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=schema.names)

    return summed.select("__key", *[total(c).alias(c) for c in added]).mapInArrow(finish, schema).withColumnRenamed("__key", key)
