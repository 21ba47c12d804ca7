"""Rewriting: substitutions and changes as expressions over the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.pattern import NotExact, Pattern
from ..lang.program import Subst
from ..lang.template import fill
from .select import java, quoted


def _java_template(s: Subst) -> str:
    out = ""
    for i, piece in enumerate(s.template):
        if isinstance(piece, str):
            out += piece.replace("\\", "\\\\").replace("$", "\\$")
            continue
        after = s.template[i + 1] if i + 1 < len(s.template) else ""
        if isinstance(after, str) and after[:1].isdigit() and piece * 10 + int(after[0]) <= s.pattern.groups:
            raise NotExact("ambiguous group number")
        out += f"${piece}"
    return out


def substitute(text: Column, s: Subst) -> Column:
    """``s``: all matches in one pass of the JVM's matcher, or chosen ones by interleaving gaps and matches."""
    p = s.pattern
    if s.every and s.nth is None:
        if p.literal is not None and all(isinstance(x, str) for x in s.template):
            return F.replace(text, F.lit(p.literal), F.lit("".join(s.template)))
        out = F.regexp_replace(text, quoted(p.literal) if p.literal is not None else p.java_edit, _java_template(s))
        if not p.nullable:
            return out
        empty = "".join(fill(list(s.template), m) for m in p.edits(""))
        return F.when(text == "", F.lit(empty)).otherwise(out)
    if p.literal is None and p.nullable:
        raise NotExact("empty matches have no interleaving")
    regex = java(p)
    used = sorted({x for x in s.template if isinstance(x, int)} | {0})
    found = {n: F.regexp_extract_all(text, F.lit(regex), F.lit(n)) for n in used}
    first = (s.nth or 1) - 1

    def swap(whole: Column, i: Column) -> Column:
        pieces = [F.lit(x) if isinstance(x, str) else F.get(found[x], i) for x in s.template] or [F.lit("")]
        return F.when(i >= first if s.every else i == first, F.concat(*pieces)).otherwise(whole)

    changed = weave(F.split(text, regex, -1), F.transform(found[0], swap))
    return F.when(F.regexp_like(text, F.lit(regex)), changed).otherwise(text)


def weave(gaps: Column, between: Column) -> Column:
    """Gaps and what stands between them, as one text."""
    return F.array_join(F.zip_with(gaps, between, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def within(text: Column, p: Pattern, change: Callable[[Column], Column], gaps: bool = False) -> Column:
    """Rewrite each match (or each gap) of a pattern and leave the rest."""
    if p.literal is None and p.nullable and java(p) == p.java_match:
        raise NotExact("empty matches have no interleaving")
    found = F.regexp_extract_all(text, F.lit(java(p)), F.lit(0))
    rest = F.split(text, java(p), -1)
    if gaps:
        return weave(F.transform(rest, lambda g: F.when(g == "", g).otherwise(change(g))), found)
    return weave(rest, F.transform(found, change))
