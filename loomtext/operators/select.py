"""Selecting: matches, gaps, and the tests that keep or reject."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.pattern import NotExact, Pattern

#: Line splits, written so that no empty match at the end needs a guard, and an unfinished last line is tried once only.
_LINES = {".*\\n?": "[^\\n]*+\\n|[^\\n]++", ".*\\n": "(?<![^\\n])[^\\n]*+\\n"}


def quoted(literal: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", literal)


def java(p: Pattern) -> str:
    """The pattern for selecting, as the JVM's matcher takes it."""
    if splits_lines(p):
        return _LINES[p.source]
    return quoted(p.literal) if p.literal is not None else p.java_match


def splits_lines(p: Pattern) -> bool:
    return not p.dot_all and p.source in _LINES


def line_parts(text: Column, p: Pattern) -> Column:
    """A line split's matches without their line feeds; all but an unfinished last line had one."""

    def of(parts: Column) -> Column:
        whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
        return whole if p.source == ".*\\n" else F.when(F.get(parts, F.size(parts) - 1) == "", whole).otherwise(parts)

    return _once(F.split(text, "\n", -1), of)


def _lines(text: Column, p: Pattern) -> Column:
    def of(parts: Column) -> Column:
        n = F.size(parts)
        whole = F.transform(F.slice(parts, F.lit(1), n - 1), lambda x: F.concat(x, F.lit("\n")))
        return whole if p.source == ".*\\n" else F.concat(whole, F.filter(F.slice(parts, n, F.lit(1)), lambda x: x != ""))

    return _once(F.split(text, "\n", -1), of)


def matches(text: Column, p: Pattern) -> Column:
    """``x``: array of the matches."""
    if splits_lines(p):
        return _lines(text, p)
    return F.regexp_extract_all(text, F.lit(java(p)), F.lit(0))


def gaps(text: Column, p: Pattern) -> Column:
    """``y``, ``z``: array of the stretches between matches, without empty ones."""
    return F.filter(F.split(text, java(p), -1), lambda g: g != "")


def found(text: Column, p: Pattern) -> Column:
    """``g``: whether there is a match; ``v`` is its negation."""
    return text.contains(p.literal) if p.literal is not None else F.regexp_like(text, F.lit(p.java_match))


def terminated(text: Column) -> Column:
    """``p``: the text with a line feed at its end."""
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def reduced(values: Column, sep: str) -> Column:
    """``r``: an array of one joined text, or none."""
    return F.when(F.size(values) > 0, F.array(F.array_join(values, sep))).otherwise(F.slice(values, 1, 0))


#: Views of one block of running sums, and characters of one block of near matching.
BLOCK, STRETCH = 32, 256


def placed(text: Column, start: Column) -> Column:
    """A text and where it begins and ends, in bytes."""
    return F.struct(start.cast("long").alias("start"), (start + F.octet_length(text)).cast("long").alias("end"), text.alias("value"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is used several times and evaluated once."""
    return F.transform(F.array(value), use)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def _running(steps: Column) -> Column:
    """Sums of what stands before each of an array's numbers, by sums of blocks."""

    def of(steps: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
        before = lambda sums: F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b)))

        def inside(sums: Column) -> Column:
            return F.transform(steps, lambda _, i: F.get(sums, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(steps, i - i % BLOCK + 1, i % BLOCK)))

        return _once(_once(whole, before), inside)

    return _once(steps, of)


def _parts(text: Column, p: Pattern, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use`` of the matches, the gaps around them, and where each gap begins."""
    if p.literal is None and p.nullable and java(p) == p.java_match:
        raise NotExact("empty matches have no interleaving")
    rest = F.split(text, java(p), -1)

    def of(m: Column, g: Column) -> Column:
        steps = F.zip_with(g, m, lambda a, b: (F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0))).cast("long"))
        return _once(_running(steps), lambda at: use(m, g, at))

    if p.literal is not None:  # all matches are the same text
        return _once(rest, lambda g: of(F.array_repeat(F.lit(p.literal), F.size(g) - 1), g))
    found = F.regexp_extract_all(text, F.lit(java(p)), F.lit(0))
    return _once(F.struct(found.alias("m"), rest.alias("g")), lambda both: of(both["m"], both["g"]))


def matches_at(view: Column, p: Pattern) -> Column:
    """``x`` with places: array of the matches in a view."""
    return _parts(view["value"], p, lambda m, g, at: F.transform(m, lambda x, i: placed(x, view["start"] + F.get(at, i) + F.octet_length(F.get(g, i)))))


def gaps_at(view: Column, p: Pattern) -> Column:
    """``y``, ``z`` with places: array of the stretches between matches, without empty ones."""
    return F.filter(_parts(view["value"], p, lambda m, g, at: F.transform(g, lambda x, i: placed(x, view["start"] + F.get(at, i)))), lambda v: v["value"] != "")


def paired(views: Column, text: Column) -> Column:
    """``N``: views by twos, each pair from the first one's start to the last one's end; a last one alone."""

    def of(v: Column) -> Column:
        def one(i: Column) -> Column:
            a, b = F.get(v, 2 * i), F.get(v, 2 * i + 1)
            start, end = F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"])
            both = F.substring(text.cast("binary"), start.cast("int") + 1, (end - start).cast("int")).cast("string")
            return F.when(b.isNull(), a).otherwise(placed(both, start))

        pairs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 2).cast("int") - 1), one)
        return F.when(F.size(v) > 0, pairs).otherwise(v)

    return _once(views, of)


def near(text: Column, literal: str, k: int) -> Column:
    """``~``: whether some stretch is within ``k`` byte edits of a literal.

    One of ``k + 1`` pieces of the literal survives any such edits: only stretches of the text with such a piece are looked
    at, window by window. Bytes are compared as Latin-1 characters.
    """
    want = literal.encode("utf-8", "surrogateescape").decode("latin-1")
    n = len(want)
    if k >= n:
        return F.lit(True)
    pieces = [want[n * i // (k + 1) : n * (i + 1) // (k + 1)] for i in range(k + 1)]

    def may(c: Column) -> Column:
        out = F.lit(False)
        for p in pieces:
            out = out | c.contains(p)
        return out

    def hit(part: Column) -> Column:
        def at(i: Column) -> Column:
            out = F.lit(False)
            for size in range(n - k, n + k + 1):
                out = out | (F.levenshtein(F.substr(part, i, F.lit(size)), F.lit(want), k) >= 0)
            return out

        return F.exists(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), at)

    def of(b: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(b) / STRETCH).cast("int")), lambda i: F.substr(b, i * STRETCH + 1, F.lit(STRETCH + n + k)))
        return F.when(may(b), F.exists(parts, lambda part: may(part) & hit(part))).otherwise(False)

    looked = _once(F.decode(text.cast("binary"), "ISO-8859-1"), of)
    if literal.isascii():  # pieces of it are the same bytes in both, so most texts are ruled out as they are
        looked = F.when(may(text), looked).otherwise(False)
    return F.when(text.contains(literal), True).otherwise(looked)
