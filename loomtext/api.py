"""The public entry: compile a program, run it over a corpus of one document per row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import ship
from .lang.program import Awk, Node, Simple, edits_text, parse, walk
from .operators.edit import NotExact
from .plans import lower
from .plans.carried import adds, ends
from .plans.local import run_document, stitch

_OUT = [T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())]
_SPAN = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
SCHEMAS = {
    "outputs": _OUT,
    "views": [T.StructField("seq", T.LongType()), *_SPAN, T.StructField("value", T.StringType())],
    "edits": [T.StructField("seq", T.LongType()), *_SPAN, T.StructField("replacement", T.StringType())],
    "documents": [T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())],
    "rendered": [T.StructField("text", T.StringType())],
}


def _text(value) -> str:
    return value.decode("utf-8", "surrogateescape") if isinstance(value, bytes) else value or ""


def _rows(nodes: tuple[Node, ...], doc: str, what: str, machines: dict | None = None) -> list[tuple]:
    run, left = run_document(nodes, doc, machines)
    if what == "outputs":
        return list(enumerate(run.printed))
    if what == "views":
        return [(i, None if v.start is None else run.byte(v.start), None if v.start is None else run.byte(v.end), v.text) for i, v in enumerate(left)]
    if what == "edits":
        return [(i, run.byte(a), run.byte(b), new) for i, (a, b, new) in enumerate(run.edits)]
    new = stitch(doc, run.edits)
    if what == "rendered":
        return [("".join(run.printed) + (new if edits_text(nodes) else ""),)]
    return [(new, new != doc)]


def _clean(s: str | None) -> str | None:
    """Text that holds bytes that aren't UTF-8 gets replacement characters where a string column must hold it."""
    return s if s is None or s.isascii() else s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@dataclass(frozen=True)
class Result:
    """Frames of one run. Each is made by expressions where these are exact, else by the local plan in Arrow batches."""

    nodes: tuple[Node, ...]
    docs: DataFrame
    key: str
    text: str
    tier: str = "auto"
    order: tuple[str, ...] = ()

    def _lowered(self, build):
        if self.tier == "local" or self.order or dict(self.docs.dtypes)[self.text] != "string":
            return None
        try:
            return build(self.nodes, F.coalesce(F.col(self.text), F.lit("")))
        except NotExact:
            if self.tier == "expressions":
                raise
            return None

    def _local(self, what: str) -> DataFrame:
        df = self.docs.select(F.col(self.key), F.col(self.text), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(self.order)])
        carry = bool(self.order)
        if carry and what in ("outputs", "rendered"):
            try:
                adds(self.nodes)
            except NotExact:
                pass
            else:
                ship(df.sparkSession)
                made = ends(self.docs, self.nodes, self.key, self.text, self.order, _text)
                return made if what == "rendered" else made.select(self.key, F.lit(0).cast("long").alias("seq"), "text")
        if carry:  # documents one after the other, by request
            df = df.repartition(1).sortWithinPartitions(*[f"__o{i}" for i in range(len(self.order))])
        ship(df.sparkSession)
        schema = T.StructType([df.schema[self.key], *SCHEMAS[what]])
        nodes = self.nodes

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            kind, machines = to_arrow_schema(schema), {}
            for b in batches:
                keys, rows = [], []
                for key, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    made = _rows(nodes, _text(doc), what, machines if carry else None)
                    keys += [key] * len(made)
                    rows += made
                    if len(rows) > 50_000:
                        yield _frame(keys, rows, kind)
                        keys, rows = [], []
                yield _frame(keys, rows, kind)

        return df.mapInArrow(run, schema)

    @cached_property
    def outputs(self) -> DataFrame:
        """``key, seq, text``: what the program prints, a row per record in order."""
        made = self._lowered(lower.prints)
        if made is None:
            return self._local("outputs")
        docs = self.docs
        for lit in lower.needed_literals(self.nodes):  # before any splitting
            docs = docs.where(F.col(self.text).contains(lit))
        return docs.select(F.col(self.key), F.posexplode(made).alias("seq", "text")).withColumn("seq", F.col("seq").cast("long"))

    @cached_property
    def values(self) -> DataFrame:
        """``key, seq, value``: the views that come out, without their places."""
        made = self._lowered(lower.views)
        if made is None:
            return self._local("views").drop("start", "end")
        docs = self.docs
        for lit in lower.needed_literals(self.nodes):
            docs = docs.where(F.col(self.text).contains(lit))
        return docs.select(F.col(self.key), F.posexplode(made).alias("seq", "value")).withColumn("seq", F.col("seq").cast("long"))

    @cached_property
    def views(self) -> DataFrame:
        """``key, seq, start, end, value``: the views that come out, with byte offsets (null for texts of their own)."""
        made = self._lowered(lower.spans)
        if made is None:
            return self._local("views")
        docs = self.docs
        for lit in lower.needed_literals(self.nodes):
            docs = docs.where(F.col(self.text).contains(lit))
        at = docs.select(F.col(self.key), F.posexplode(made).alias("seq", "v"))
        return at.select(self.key, F.col("seq").cast("long").alias("seq"), "v.start", "v.end", "v.value")

    @cached_property
    def edits(self) -> DataFrame:
        """``key, seq, start, end, replacement``: pending edits in order of recording."""
        return self._local("edits")

    @cached_property
    def documents(self) -> DataFrame:
        """``key, text, changed``: every document as the program leaves it."""
        if not edits_text(self.nodes):
            return self.docs.select(self.key, F.col(self.text).alias("text"), F.lit(False).alias("changed"))
        made = self._lowered(lower.rewritten)
        if made is None:
            return self._local("documents")
        out = self.docs.select(self.key, F.col(self.text).alias("__old"), made.alias("text"))
        return out.select(self.key, "text", (F.col("text") != F.coalesce(F.col("__old"), F.lit(""))).alias("changed"))


    @cached_property
    def rendered(self) -> DataFrame:
        """``key, text``: all that is printed for a document, then the document itself if the program edits."""
        edited = edits_text(self.nodes)
        printing = any(isinstance(n, Awk) or (isinstance(n, Simple) and n.kind in "p=") for n in walk(self.nodes))
        if edited and not printing:
            return self.documents.select(self.key, "text")
        made = None if edited or not printing else self._lowered(lower.prints)
        if made is None:
            return self._local("rendered")
        return self.docs.select(F.col(self.key), F.array_join(made, "").alias("text"))


def _frame(keys: list, rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * (len(kind) - 1)
    arrays = [pa.array(keys, kind[0].type)]
    for f, c in zip(list(kind)[1:], cols, strict=True):
        arrays.append(pa.array([_clean(x) for x in c] if pa.types.is_string(f.type) else c, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=kind)


@dataclass(frozen=True)
class Program:
    source: str
    nodes: tuple[Node, ...]

    def run(self, docs: DataFrame, key: str = "doc_id", text: str = "text", tier: str = "auto", carry: tuple[str, ...] = ()) -> Result:
        """Run over a corpus; ``tier`` is ``auto``, ``expressions`` (or fail) or ``local``.

        Record programs start anew for each document. ``carry`` names columns that order the documents and lets variables,
        arrays and NR live on from one to the next. That takes a single task, unless a program only adds up and its END
        prints sums (``plans/carried.py``).
        """
        return Result(self.nodes, docs, key, text, tier, tuple(carry))


def compile(source: str, *, n: bool = False, E: bool = True) -> Program:  # noqa: A001, N803
    """Parse and check a program; raises ``ProgramError``.

    The options ``n`` (print only what is asked for) and ``E`` (extended patterns) are accepted as other tools have them;
    both always hold.
    """
    return Program(source, parse(source))
