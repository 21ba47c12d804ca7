"""Whole programs on one document, in Python: exact for every program, and what lowered plans are tested against."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import accumulate

from ..awk.run import Machine
from ..awk.syntax import parse as parse_awk
from ..lang.pattern import Pattern, ProgramError
from ..lang.program import Awk, Change, Fuzzy, Group, Guard, Node, Reduce, Select, Simple, Subst, Test
from ..lang.template import fill

OPEN, CLOSE = "([{", ")]}"


@dataclass
class View:
    """A stretch of the document, or a text of its own (start is None then)."""

    text: str
    start: int | None

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    def part(self, a: int, b: int) -> View:
        return View(self.text[a:b], None if self.start is None else self.start + a)


@dataclass
class Run:
    """What one document's run gathers."""

    doc: str
    printed: list[str] = field(default_factory=list)
    edits: list[tuple[int, int, str]] = field(default_factory=list)
    replaced: bool = False
    machines: dict[int, Machine] = field(default_factory=dict)

    @cached_property
    def brackets(self) -> Brackets:
        return Brackets(self.doc)

    def byte(self, at: int) -> int:
        if not hasattr(self, "_bytes"):
            self._bytes = None if self.doc.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogateescape")) for c in self.doc)]
        return at if self._bytes is None else self._bytes[at]


def _real(v: View) -> View:
    if v.start is None:
        raise ProgramError("a text made by c or r has no place in the document")
    return v


@lru_cache(maxsize=256)
def _pieces(literal: str, k: int) -> list[str]:
    n = len(literal)
    return [literal[n * i // (k + 1) : n * (i + 1) // (k + 1)] for i in range(k + 1)]


@lru_cache(maxsize=256)
def _places(want: bytes) -> dict[int, int]:
    """For each byte the bits of its places."""
    return {c: sum(1 << i for i, d in enumerate(want) if d == c) for c in set(want)}


def near(text: str, literal: str, k: int) -> bool:
    """Whether some stretch of the text is within ``k`` byte edits of the literal."""
    want, have = literal.encode("utf-8", "surrogateescape"), text.encode("utf-8", "surrogateescape")
    if k >= len(want):
        return True
    if literal in text:
        return True
    if literal.isascii() and not any(p in text for p in _pieces(literal, k)):
        return False  # k edits leave one of k + 1 pieces whole
    # Columns of the edit-distance table as two bit vectors of differences, one step for each byte.
    full, top, places = (1 << len(want)) - 1, 1 << (len(want) - 1), _places(want)
    up, down, score = full, 0, len(want)
    for byte in have:
        equal = places.get(byte, 0)
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(across | up) & full, up & across
        score += (plus & top > 0) - (minus & top > 0)
        if score <= k:
            return True
        plus, minus, equal = plus << 1, minus << 1, equal | down
        up, down = (minus | ~(equal | plus)) & full, plus & equal & full
    return False


class Brackets:
    """For every place of a text the innermost open bracket before it and the innermost closing one after it."""

    def __init__(self, doc: str):
        self.at = [i for i, c in enumerate(doc) if c in OPEN or c in CLOSE]
        self.left = self._tops(doc, self.at, OPEN)
        self.right = self._tops(doc, self.at[::-1], CLOSE)[::-1]

    @staticmethod
    def _tops(doc: str, places: list[int], up: str) -> list[int | None]:
        stack, out = [], []
        for i in places:
            if doc[i] in up:
                stack.append(i)
            elif stack:
                stack.pop()
            out.append(stack[-1] if stack else None)
        return out

    def around(self, start: int, end: int) -> tuple[int, int]:
        """The smallest bracketed stretch around [start, end); itself if there is none."""
        i, j = bisect_left(self.at, start), bisect_left(self.at, end)
        left, right = self.left[i - 1] if i else None, self.right[j] if j < len(self.at) else None
        return (start, end) if left is None or right is None else (left, right + 1)


def expand(doc: str, start: int, end: int) -> tuple[int, int]:
    """The smallest bracketed stretch around [start, end); itself if there is none."""
    return Brackets(doc).around(start, end)


def collapse(text: str) -> tuple[int, int] | None:
    """The inside of the first bracket pair; to the end if it isn't closed; None without an opener."""
    first = next((i for i, c in enumerate(text) if c in OPEN), None)
    if first is None:
        return None
    depth = 0
    for i in range(first, len(text)):
        depth += (text[i] in OPEN) - (text[i] in CLOSE)
        if not depth:
            return first + 1, i
    return first + 1, len(text)


def gaps(v: View, p: Pattern) -> Iterator[View]:
    """The stretches between a pattern's matches, without empty ones."""
    at = 0
    for m in p.matches(v.text):
        if m.start() > at:
            yield v.part(at, m.start())
        at = m.end()
    if at < len(v.text):
        yield v.part(at, len(v.text))


def record(text: str) -> str:
    """A view as a record: without its line end."""
    return text[:-2] if text.endswith("\r\n") else text[:-1] if text.endswith("\n") else text


def _step(node: Node, views: Iterator[View], run: Run, own: list[list[str]]) -> Iterator[View]:
    if isinstance(node, Select):
        p = node.pattern
        if node.kind in "gv":
            yield from (v for v in views if p.found(v.text) == (node.kind == "g"))
        elif node.kind == "x":
            for v in views:
                yield from (v.part(*m.span()) for m in p.matches(v.text))
        else:
            for v in views:
                yield from gaps(v, p)
    elif isinstance(node, Fuzzy):
        yield from (v for v in views if near(v.text, node.literal, node.distance))
    elif isinstance(node, Simple):
        yield from _simple(node.kind, views, run, own)
    elif isinstance(node, Change):
        for v in views:
            run.edits.append((_real(v).start, v.end, node.text))
            yield View(node.text, None)
    elif isinstance(node, Reduce):
        kept = [v.text for v in views]
        if kept:
            yield View(node.sep.join(kept), None)
    elif isinstance(node, Group):
        for v in views:
            yield from list(execute(node.body, iter([v]), run))
    elif isinstance(node, Guard):
        for v in views:
            if node.pattern.found(v.text):
                for _ in execute(node.body, iter([v]), run):
                    pass
            yield v
    elif isinstance(node, Test):
        for v in views:
            was, run.replaced = run.replaced, False
            if was:
                yield from list(execute(node.body, iter([v]), run))
            else:
                yield v
    elif isinstance(node, Subst):
        for v in views:
            _real(v)
            for i, m in enumerate(node.pattern.edits(v.text)):
                if node.picks(i):
                    run.edits.append((v.start + m.start(), v.start + m.end(), fill(list(node.template), m)))
                    run.replaced = True
                    if not node.every:
                        break
            yield v
    elif isinstance(node, Awk):
        machine = run.machines.get(id(node)) or run.machines.setdefault(id(node), Machine(_awk(node.source)))
        seen: list[View] = []

        def records():
            for v in views:
                seen.append(v)
                yield record(v.text)

        run.printed.append(machine.run(records()))
        yield from seen
    else:
        raise ProgramError(f"unknown command {node}")


@lru_cache(maxsize=64)
def _awk(source: str):
    return parse_awk(source)


def _simple(kind: str, views: Iterator[View], run: Run, own: list[list[str]]) -> Iterator[View]:
    if kind in "p=":
        lines: list[str] = []
        own.append(lines)
        for v in views:
            if kind == "p":
                lines.append(v.text if v.text.endswith("\n") else v.text + "\n")
            else:
                a, b = run.byte(_real(v).start), run.byte(v.end)
                lines.append(f"{a},{b},{b - a}\n")
            yield v
    elif kind == "N":
        for v in views:
            other = next(views, None)
            if other is None:
                yield v
            else:
                a, b = min(_real(v).start, _real(other).start), max(v.end, other.end)
                yield View(run.doc[a:b], a)
    elif kind == "+":
        for v in views:
            a, b = run.brackets.around(_real(v).start, v.end)
            yield View(run.doc[a:b], a)
    else:
        for v in views:
            inner = collapse(v.text)
            if inner:
                yield v.part(*inner)


def execute(nodes: tuple[Node, ...], views: Iterator[View], run: Run) -> Iterator[View]:
    """The views that come out. What the pipeline's own printers print follows what inner pipelines print."""
    own: list[list[str]] = []
    for n in nodes:
        views = _step(n, views, run, own)
    yield from views
    for lines in own:
        run.printed += lines


def stitch(doc: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits in order of their start; the first recorded wins where they overlap."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        if start >= at:
            out += [doc[at:start], new]
            at = end
    return "".join([*out, doc[at:]])


def run_document(nodes: tuple[Node, ...], doc: str, machines: dict[int, Machine] | None = None) -> tuple[Run, list[View]]:
    """All that a program does to one document; ``machines`` carries interpreters over from earlier ones."""
    run = Run(doc, machines={} if machines is None else machines)
    return run, list(execute(nodes, iter([View(doc, 0)]), run))
