"""Programs: single-letter commands over streams of views, as a tree of nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .pattern import Pattern, ProgramError
from .template import compile_template, unescape


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Select(Node):
    """``x`` matches, ``y`` gaps, ``g`` keep, ``v`` reject."""

    kind: str
    pattern: Pattern


@dataclass(frozen=True)
class Fuzzy(Node):
    distance: int
    literal: str


@dataclass(frozen=True)
class Change(Node):
    text: str


@dataclass(frozen=True)
class Reduce(Node):
    sep: str


@dataclass(frozen=True)
class Simple(Node):
    """``p = N + -``"""

    kind: str


@dataclass(frozen=True)
class Group(Node):
    body: tuple[Node, ...]


@dataclass(frozen=True)
class Guard(Node):
    """``/re/ {...}``: effects on the views that match; all views pass."""

    pattern: Pattern
    body: tuple[Node, ...]


@dataclass(frozen=True)
class Test(Node):
    body: tuple[Node, ...]


@dataclass(frozen=True)
class Subst(Node):
    pattern: Pattern
    template: tuple[str | int, ...]
    every: bool = False
    nth: int | None = None

    def picks(self, i: int) -> bool:
        """Whether the i-th match (from 0) is replaced."""
        first = (self.nth or 1) - 1
        return i >= first if self.every else i == first


@dataclass(frozen=True)
class Awk(Node):
    source: str


#: Concepts and the words they stand for.
CONCEPTS = {
    "error": "error err fail failure failed exception fatal panic crash abort fault bug",
    "warning": "warning warn caution deprecated alert",
    "success": "success succeeded succeed ok okay passed pass done complete completed",
    "time": "time date datetime timestamp clock hour minute second day month year",
    "money": "money price cost dollar payment pay invoice salary fee budget currency amount",
    "person": "person user username customer employee author member account owner",
    "location": "location place city country address region geo coordinate coordinates latitude longitude",
    "network": "network connection socket tcp udp ip host hostname port dns http https",
    "delete": "delete remove removed drop dropped erase destroy purge discard",
    "create": "create created add added insert inserted new make build generate",
    "speed": "speed fast quick rapid performance latency throughput slow",
    "security": "security auth authentication authorization password credential token encrypt decrypt vulnerability",
}


def concept_pattern(name: str) -> Pattern:
    """Any mention of a concept, in any case; an unknown one stands for itself."""
    key = "".join(c.lower() if c.isascii() else c for c in name)
    terms = CONCEPTS[key].split() if key in CONCEPTS else [name]
    return Pattern("|".join(re.sub(r"[^\w\s]", lambda m: "\\" + m[0] if m[0].isascii() else m[0], t) for t in terms), ignore_case=True)


@dataclass
class _Reader:
    src: str
    at: int = 0

    def peek(self) -> str:
        return self.src[self.at : self.at + 1]

    def space(self) -> None:
        while self.peek().isspace():
            self.at += 1

    def delimited(self, mark: str | None = None) -> str:
        """Text up to the delimiter (the next character, if not given); escapes keep their backslash."""
        if mark is None:
            mark = self.peek()
            if not mark:
                raise ProgramError("expected a delimiter")
            self.at += 1
        start = self.at
        while (c := self.peek()) != mark:
            if not c:
                raise ProgramError(f"unterminated text, expected {mark!r}")
            self.at += 2 if c == "\\" else 1
        if self.at > len(self.src):
            raise ProgramError(f"unterminated text, expected {mark!r}")
        self.at += 1
        return self.src[start : self.at - 1]

    def modifiers(self) -> dict:
        """Letters and digits glued to a closing delimiter."""
        m = re.compile(r"[iIsgmM0-9]*").match(self.src, self.at)
        self.at = m.end()
        digits = "".join(c for c in m[0] if c.isdigit())
        return {"i": bool(set(m[0]) & set("iI")), "s": "s" in m[0], "g": "g" in m[0], "n": int(digits) if digits else None}

    def pattern(self, mark: str | None = None) -> Pattern:
        text = self.delimited(mark)
        f = self.modifiers()
        return self.checked(text, f)

    @staticmethod
    def checked(text: str, f: dict) -> Pattern:
        p = Pattern(text, f["i"], f["s"])
        if p.literal is None:
            p.python  # noqa: B018  raises if it can't be compiled
        return p

    def block(self) -> tuple[Node, ...]:
        self.space()
        if self.peek() != "{":
            raise ProgramError("expected a block")
        self.at += 1
        body = self.commands()
        if self.peek() != "}":
            raise ProgramError("unterminated block")
        self.at += 1
        return body

    def awk(self) -> str:
        """The source between balanced braces; strings and comments don't count."""
        self.space()
        if self.peek() != "{":
            raise ProgramError("@ needs a block")
        depth, start = 0, self.at + 1
        for m in re.compile(r'"(?:\\.|[^"\\])*"?|#[^\n]*|[{}]', re.S).finditer(self.src, self.at):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if depth == 0 and m[0] == "}":
                self.at = m.end()
                return self.src[start : m.start()]
        raise ProgramError("unterminated @ block")

    def commands(self) -> tuple[Node, ...]:
        out: list[Node] = []
        while True:
            while self.peek() == ";" or self.peek().isspace():
                self.at += 1
            c = self.peek()
            if not c or c == "}":
                return tuple(out)
            self.at += 1
            out += self.command(c)

    def command(self, c: str) -> list[Node]:
        if c in "xyzgv":
            return [Select("y" if c == "z" else c, self.pattern())]
        if c in "p=N+-":
            return [Simple(c)]
        if c == "c":
            return [Change(unescape(self.delimited()))]
        if c == "r":
            return [Reduce(unescape(self.delimited()))]
        if c == "~":
            m = re.compile(r"[0-9]+").match(self.src, self.at)
            if not m:
                raise ProgramError("~ needs a distance")
            self.at = m.end()
            return [Fuzzy(int(m[0]), self.delimited())]
        if c == ":":
            if not self.src.startswith("sem:", self.at):
                raise ProgramError("unknown modifier")
            self.at += 4
            self.space()
            return [Select("g", concept_pattern(self.delimited()))]
        if c == "@":
            return [Awk(self.awk())]
        if c == "{":
            self.at -= 1
            return [Group(self.block())]
        if c == "/":
            p = self.pattern("/")
            was = self.at
            self.space()
            if self.peek() == "{":
                return [Guard(p, self.block())]
            self.at = was
            return [Guard(p, (Simple("p"),))]
        if c == "m":
            return [Select("x", self.pattern()), Group(self.block())]
        if c == "t":
            return [Test(self.block())]
        if c == "s":
            mark = self.peek()
            source = self.delimited()
            raw = self.delimited(mark)
            f = self.modifiers()
            if f["n"] == 0:
                raise ProgramError("occurrence 0")
            p = self.checked(source, f)
            return [Subst(p, tuple(compile_template(raw, p)), f["g"], f["n"])]
        raise ProgramError(f"unknown command {c!r}")


LINES = Select("x", Pattern(".*\\n?"))


def parse(source: str) -> tuple[Node, ...]:
    """The commands of a program. One that starts with ``/`` works on lines."""
    r = _Reader(source)
    out = r.commands()
    if r.at < len(source):
        raise ProgramError("unexpected }")
    return (LINES, *out) if source.lstrip()[:1] == "/" else out


def walk(nodes: tuple[Node, ...]):
    for n in nodes:
        yield n
        yield from walk(getattr(n, "body", ()))


def edits_text(nodes: tuple[Node, ...]) -> bool:
    """Whether a program rewrites its documents."""
    return any(isinstance(n, (Change, Subst)) for n in walk(nodes))
