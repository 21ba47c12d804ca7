"""Selectors, substitution, brackets, near matches and concepts as column functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.pattern import NotExact, Pattern
from ..lang.program import Subst, concept_pattern
from ..lang.template import compile_template
from ..operators import edit, select
from ..plans import local


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _made(c: Column, build: Callable[[Column], Column], kind: T.DataType, one: Callable[[str], object]) -> Column:
    """By expressions; by Python's matcher, in Arrow batches, where these aren't exact."""
    try:
        return build(c)
    except NotExact:

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else one(x))

        return run(c)


def _gaps(p: Pattern, text: str) -> list[str]:
    return [v.text for v in local.gaps(local.View(text, 0), p)]


def split_matches(text: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """array<string> of matches (``x``)."""
    p = Pattern(pattern, ignore_case)
    return _made(_col(text), lambda c: select.matches(c, p), T.ArrayType(T.StringType()), lambda x: [m[0] for m in p.matches(x)])


def split_gaps(text: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """array<string> of gaps (``y``)."""
    p = Pattern(pattern, ignore_case)
    return _made(_col(text), lambda c: select.gaps(c, p), T.ArrayType(T.StringType()), lambda x: _gaps(p, x))


def keep(text: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Whether there is a match (``g``)."""
    p = Pattern(pattern, ignore_case)
    return _made(_col(text), lambda c: select.found(c, p), T.BooleanType(), p.found)


def concept(text: Column | str, name: str) -> Column:
    """Whether a concept is mentioned (``:sem:``)."""
    return select.found(_col(text), concept_pattern(name))


def replace(text: Column | str, pattern: str, template: str, every: bool = True, nth: int | None = None) -> Column:
    """Substitution (``s``) with a template of literal text and group references."""
    p = Pattern(pattern)
    s = Subst(p, tuple(compile_template(template, p)), every, nth)
    return _made(_col(text), lambda c: edit.substitute(c, s), T.StringType(), lambda x: local.stitch(x, local.run_document((s,), x)[0].edits))


def fuzzy(text: Column | str, literal: str, distance: int) -> Column:
    """Whether some stretch of the text is within ``distance`` byte edits of a literal (``~``).

    A null text has none.
    """
    return F.coalesce(select.near(_col(text), literal, distance), F.lit(distance >= len(literal.encode())))


def collapse(text: Column | str) -> Column:
    """The inside of the first bracket pair (``-``), null without one. Built-in functions only.

    One fold over the characters: depth, and the start and end found so far.
    """
    c = _col(text)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, ch: Column) -> Column:
        i = s["i"] + 1
        moved = s["depth"] + F.when(ch.isin("(", "[", "{"), 1).when(ch.isin(")", "]", "}") & (s["first"] > 0), -1).otherwise(0)
        depth = F.when(s["last"] > 0, s["depth"]).otherwise(moved)
        first = F.when((s["first"] == 0) & ch.isin("(", "[", "{"), i).otherwise(s["first"])
        last = F.when((s["last"] == 0) & (first > 0) & (depth == 0), i).otherwise(s["last"])
        return F.struct(i.alias("i"), depth.alias("depth"), first.alias("first"), last.alias("last"))

    found = F.transform(F.array(F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step)), lambda s: F.when(s["first"] > 0, F.substr(c, s["first"] + 1, F.when(s["last"] > 0, s["last"] - s["first"] - 1).otherwise(F.length(c)))))
    return F.get(found, F.lit(0))


def expand(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """struct<start, end> of the smallest bracketed stretch around the characters [start, end) (``+``)."""

    @F.pandas_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    def widened(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([local.expand(x or "", int(i), int(j)) for x, i, j in zip(s, a, b, strict=True)], columns=["start", "end"])

    return widened(_col(text), _col(start), _col(end))
