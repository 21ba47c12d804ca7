"""Lowering programs to Catalyst expressions, without UDFs and without shuffles.

A document's views are an array of texts in its own row, so selectors are array expressions and nothing moves between
rows. Where places in the document are asked for, views are structs of a text and its bytes' start and end. Programs that
need sequential state or more than one printer raise ``NotExact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.program import Change, Fuzzy, Group, Guard, Node, Reduce, Select, Simple, Subst, walk
from ..operators import edit, select
from ..operators.edit import NotExact


def needed_literals(nodes: tuple[Node, ...]) -> list[str]:
    """Literals that a document must hold to print anything: those its views must hold on the way."""
    out = []
    for n in nodes:
        if isinstance(n, Select) and n.kind in "xg" and n.pattern.literal is not None:
            out.append(n.pattern.literal)
        elif isinstance(n, Guard) and n.pattern.literal is not None and n is nodes[-1]:
            out.append(n.pattern.literal)
        elif not (isinstance(n, Select) and n.kind in "xyg"):
            break
    return out


def views(nodes: tuple[Node, ...], text: Column) -> Column:
    """array<string>: the texts of the views that come out."""
    return _views(nodes, None, text)


def _views(nodes: tuple[Node, ...], values: Column | None, text: Column | None) -> Column:
    for n in nodes:
        values, text = _stepped(n, F.array(text) if values is None else values, text if values is None else None), None
    return F.array(text) if values is None else values


def _stepped(n: Node, values: Column, alone: Column | None) -> Column:
    """One command over an array of texts; ``alone`` is the text if the array holds just that."""
    if isinstance(n, Select):
        if n.kind == "g":
            return F.filter(values, lambda v: select.found(v, n.pattern))
        if n.kind == "v":
            return F.filter(values, lambda v: ~select.found(v, n.pattern))
        one = select.matches if n.kind == "x" else select.gaps
        return one(alone, n.pattern) if alone is not None else F.flatten(F.transform(values, lambda v: one(v, n.pattern)))
    if isinstance(n, Reduce):
        return select.reduced(values, n.sep)
    if isinstance(n, Fuzzy):
        return F.filter(values, lambda v: select.near(v, n.literal, n.distance))
    if isinstance(n, Group):
        return F.flatten(F.transform(values, lambda v: _views(n.body, None, v)))
    if isinstance(n, Simple) and n.kind == "p":
        return values
    raise NotExact(f"{type(n).__name__} needs the local plan")


def prints(nodes: tuple[Node, ...], text: Column) -> Column:
    """array<string>: what a program with a single ``p`` (or final ``/re/``) prints, in order."""
    printers = [n for n in walk(nodes) if isinstance(n, Simple) and n.kind in "p="]
    if len(printers) != 1:
        raise NotExact("one printer only")
    lines = _lines_kept(nodes, text)
    if lines is not None:
        return lines
    if any(isinstance(n, Simple) and n.kind in "=N" for n in walk(nodes)):
        return _printed_at(nodes, F.array(select.placed(text, F.lit(0))), text)
    return F.transform(_printed(nodes, None, text), select.terminated)


def _lines_kept(nodes: tuple[Node, ...], text: Column) -> Column | None:
    """Lines that hold literals or don't, printed: they are told apart before their line feeds are put back."""
    if len(nodes) < 2 or not isinstance(nodes[0], Select) or nodes[0].kind != "x" or not select.splits_lines(nodes[0].pattern):
        return None
    last, tests = nodes[-1], [(n.pattern, n.kind == "g") for n in nodes[1:-1] if isinstance(n, Select) and n.kind in "gv"]
    if isinstance(last, Guard) and last.body == (Simple("p"),):
        tests.append((last.pattern, True))
        last = last.body[0]
    if last != Simple("p") or len(tests) + 2 - isinstance(nodes[-1], Guard) != len(nodes) or any(p.literal is None or "\n" in p.literal for p, _ in tests):
        return None
    parts = select.line_parts(text, nodes[0].pattern)
    for p, keep in tests:
        parts = F.filter(parts, lambda x: x.contains(p.literal) if keep else ~x.contains(p.literal))
    return F.transform(parts, lambda x: F.concat(x, F.lit("\n")))


def _printed(nodes: tuple[Node, ...], values: Column | None, text: Column | None) -> Column:
    for i, n in enumerate(nodes):
        if isinstance(n, Simple) and n.kind == "p":
            return _views(nodes[:i], values, text)
        body = getattr(n, "body", ())
        if any(isinstance(m, Simple) and m.kind == "p" for m in walk(body)):
            before = _views(nodes[:i], values, text)
            if isinstance(n, Guard):
                before = F.filter(before, lambda v: select.found(v, n.pattern))
            elif not isinstance(n, Group):
                raise NotExact("printer in a conditional block")
            if i + 1 < len(nodes) and any(not isinstance(m, (Select, Group)) for m in walk(nodes[i + 1 :])):
                raise NotExact("commands after a printing block")
            return F.flatten(F.transform(before, lambda v: _printed(body, None, v)))
    raise NotExact("no printer")


def spans(nodes: tuple[Node, ...], text: Column) -> Column:
    """array<struct<start, end, value>>: the views that come out, with their places."""
    return _spans(nodes, F.array(select.placed(text, F.lit(0))), text)


def _spans(nodes: tuple[Node, ...], views: Column, text: Column) -> Column:
    for n in nodes:
        if isinstance(n, Select) and n.kind in "gv":
            views = F.filter(views, lambda v: select.found(v["value"], n.pattern) if n.kind == "g" else ~select.found(v["value"], n.pattern))
        elif isinstance(n, Select):
            one = select.matches_at if n.kind == "x" else select.gaps_at
            views = F.flatten(F.transform(views, lambda v: one(v, n.pattern)))
        elif isinstance(n, Fuzzy):
            views = F.filter(views, lambda v: select.near(v["value"], n.literal, n.distance))
        elif isinstance(n, Group):
            views = F.flatten(F.transform(views, lambda v: _spans(n.body, F.array(v), text)))
        elif isinstance(n, Simple) and n.kind == "N":
            views = select.paired(views, text)
        elif not (isinstance(n, Simple) and n.kind in "p="):
            raise NotExact(f"{type(n).__name__} needs the local plan")
    return views


def _printed_at(nodes: tuple[Node, ...], views: Column, text: Column) -> Column:
    for i, n in enumerate(nodes):
        if isinstance(n, Simple) and n.kind in "p=":
            if any(not isinstance(m, (Select, Group, Fuzzy)) for m in walk(nodes[i + 1 :])):
                raise NotExact("commands after the printer")
            shown = _spans(nodes[:i], views, text)
            if n.kind == "p":
                return F.transform(shown, lambda v: select.terminated(v["value"]))
            return F.transform(shown, lambda v: F.concat(F.concat_ws(",", v["start"], v["end"], v["end"] - v["start"]), F.lit("\n")))
        if isinstance(n, Group) and any(isinstance(m, Simple) and m.kind in "p=" for m in walk(n.body)):
            return F.flatten(F.transform(_spans(nodes[:i], views, text), lambda v: _printed_at(n.body, F.array(v), text)))
    raise NotExact("no printer among the pipeline's commands")


def rewritten(nodes: tuple[Node, ...], text: Column) -> Column:
    """The document after a program with a single ``s`` or ``c``."""
    mutators = [n for n in walk(nodes) if isinstance(n, (Subst, Change))]
    if len(mutators) != 1:
        raise NotExact("one edit command only")
    return _rewrite(nodes, text)


def _holds(n: Node) -> bool:
    return isinstance(n, (Subst, Change)) or any(map(_holds, getattr(n, "body", ())))


def _rewrite(nodes: tuple[Node, ...], text: Column) -> Column:
    n, rest = nodes[0], nodes[1:]
    if _holds(n):
        if isinstance(n, Subst):
            return edit.substitute(text, n)
        if isinstance(n, Change):
            return F.lit(n.text)
        if isinstance(n, Group):
            return _rewrite(n.body, text)
        if isinstance(n, Guard):
            return F.when(select.found(text, n.pattern), _rewrite(n.body, text)).otherwise(text)
        raise NotExact("edits that depend on earlier ones")
    if isinstance(n, Simple) and n.kind == "p":
        return _rewrite(rest, text)
    if isinstance(n, Guard):
        return _rewrite(rest, text)
    if isinstance(n, Select):
        change: Callable[[Column], Column] = lambda v: _rewrite(rest, v)
        if n.kind in "gv":
            hit = select.found(text, n.pattern)
            return F.when(hit if n.kind == "g" else ~hit, change(text)).otherwise(text)
        return edit.within(text, n.pattern, change, gaps=n.kind == "y")
    raise NotExact(f"{type(n).__name__} before an edit")
