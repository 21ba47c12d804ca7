"""Patterns: checked once, and written for the JVM's and for Python's matcher.

The dialect is that of automaton engines: no look-around and no back-references in patterns; ``^`` and ``$`` stand at
line ends, ``.`` stops at line feeds only, classes and case are Unicode's. Classes may be nested and combined by ``&&``,
``--`` and ``~~``; the inline flags are ``i m s u x U R``.

Automata take linear time; both matchers here go back and may take longer. The JVM's also recurses once for each round of
a repeated group, so that long runs overflow its stack: such patterns have ``loops`` and are left to Python's matcher,
which keeps its own stack. Repetitions within repetitions, on which going back may take exponential time, are logged.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import regex as pyregex


log = logging.getLogger(__name__)


class ProgramError(ValueError):
    """A program that can't be compiled."""


class NotExact(ValueError):
    """No built-in expression gives exactly this result; the caller takes the local plan."""


#: Rounds of a repeated group from which a pattern isn't given to the JVM's matcher.
ROUNDS = 256


#: POSIX classes as ASCII ranges.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_META = frozenset(".*+?^$()[]{}|\\")
_QUANT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
_FLAGGED = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>")
_ESCAPE = re.compile(r"\\(?:x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([pP])(?:\{(\^?)([^}]*)\}|(\w))|(.))", re.S)


@dataclass(frozen=True)
class Pattern:
    source: str
    ignore_case: bool = False
    dot_all: bool = False

    @property
    def literal(self) -> str | None:
        """The text itself if nothing in it is special and case counts."""
        return self.source if self.source and not self.ignore_case and not _META & set(self.source) else None

    @cached_property
    def _both(self) -> tuple[str, str, dict[str, int], int, bool]:
        return _translate(self.source, self.dot_all)

    @property
    def loops(self) -> bool:
        """Whether the JVM's matcher may recurse without a bound."""
        return self._both[4]

    def _for_jvm(self, form: str) -> str:
        if self.loops:
            raise NotExact("the JVM's matcher recurses on long runs of a repeated group")
        return form

    @property
    def groups(self) -> int:
        return self._both[3]

    @property
    def names(self) -> dict[str, int]:
        return self._both[2]

    @cached_property
    def python(self) -> pyregex.Pattern:
        flags = pyregex.M | pyregex.V0 | (pyregex.I if self.ignore_case else 0) | (pyregex.S if self.dot_all else 0)
        try:
            return pyregex.compile(self._both[1], flags)
        except pyregex.error as e:
            raise ProgramError(f"invalid pattern {self.source!r}: {e}") from None

    @property
    def java_flags(self) -> str:
        return "(?md" + ("s" if self.dot_all else "") + ("iu" if self.ignore_case else "") + ("U" if re.search(r"\\[wWdDsSbB]", self.source) else "") + ")"

    @property
    def java_body(self) -> str:
        return self._both[0]

    @cached_property
    def nullable(self) -> bool:
        """Whether it may match the empty string, by a walk of the JVM form that errs towards yes."""
        try:
            return re._parser.parse(re.sub(r"\\p\{[^}]*\}|\\P\{[^}]*\}", "x", self._both[1]).replace("\\Z", ""), re.M).getwidth()[0] == 0
        except Exception:
            return True

    @property
    def java_match(self) -> str:
        """For selecting: a match must start before the end of the text."""
        return self._for_jvm(self.java_flags + (f"(?=[\\s\\S])(?:{self.java_body})" if self.nullable else self.java_body))

    @property
    def java_edit(self) -> str:
        """For substituting: an empty match at the end counts unless a line feed stands before it."""
        return self._for_jvm(self.java_flags + (f"(?!(?<=\\n)\\z)(?:{self.java_body})" if self.nullable else self.java_body))

    def matches(self, text: str) -> list:
        """Matches for selecting."""
        return [m for m in self.python.finditer(text) if m.start() < len(text)]

    def edits(self, text: str) -> list:
        """Matches for substituting."""
        stop = len(text) if text.endswith("\n") else len(text) + 1
        return [m for m in self.python.finditer(text) if m.start() < stop]

    def found(self, text: str) -> bool:
        if self.literal is not None:
            return self.literal in text
        return any(m.start() < len(text) for m in self.python.finditer(text))


def _one_char(code: int) -> tuple[str, str]:
    if code > 0x10FFFF:
        raise ProgramError("code point out of range")
    return f"\\x{{{code:X}}}", f"\\U{code:08X}"


def _escape(m: re.Match, inside: bool) -> tuple[str, str]:
    """An escape for (JVM, Python)."""
    code = next((m[i] for i in (1, 2, 3, 4, 5) if m[i]), None)
    if code:
        return _one_char(int(code, 16))
    if m[6]:
        name, negated = m[8] or m[9], (m[6] == "P") != (m[7] == "^")
        if name == "Any":
            if inside or negated:
                raise ProgramError("\\p{Any} isn't supported here")
            return r"[\s\S]", r"[\s\S]"
        p = "P" if negated else "p"
        short = len(name) <= 2
        key = name.partition("=")[2] or name
        return f"\\{p}{{{'' if short else 'Is'}{key}}}", f"\\{p}{{{name}}}"
    c = m[10]
    if c in "dDsSwW" or (c in "bBA" and not inside):
        return "\\" + c, "\\" + c
    if c == "z" and not inside:
        return "\\z", "\\Z"
    if c in "nrtfa":
        return "\\" + c, "\\" + c
    if c == "v":
        return "\\x0B", "\\x0B"
    if c == "<":
        return r"\b(?=\w)", r"\b(?=\w)"
    if c == ">":
        return r"\b(?<=\w)", r"\b(?<=\w)"
    if c.isalnum() and c.isascii():
        raise ProgramError("back-references aren't supported" if c.isdigit() else f"unknown escape \\{c}")
    return ("\\" + c, "\\" + c) if c.isascii() else (c, c)


_NOTHING, _ANYTHING = r"[^\s\S]", r"[\s\S]"


def _union(java: str, py: str, nested: list[tuple[str, str]]) -> tuple[str, str]:
    """Plain items and nested classes as one class; Python's matcher has no nested classes, so there they are alternatives."""
    if not nested:
        return (f"[{java}]", f"[{py}]") if java else (_NOTHING, _NOTHING)
    parts = [f"[{py}]"] if py else []
    return "[" + java + "".join(a for a, _ in nested) + "]", "(?:" + "|".join(parts + [b for _, b in nested]) + ")"


def _class(src: str, at: int, verbose: bool = False) -> tuple[str, str, int]:
    """A bracketed class from ``[`` on, for (JVM, Python), and where it ends."""
    i = at + 1
    while verbose and src[i : i + 1].isspace():
        i += 1
    negated = src[i : i + 1] == "^"
    i += negated
    start, java, py, plain = i, "", "", True
    nested: list[tuple[str, str]] = []
    left, op = None, ""

    def combined() -> tuple[str, str]:
        a, b = _union(java, py, nested)
        if left is None:
            return a, b
        c, d = left
        if op == "&&":
            return f"[{c}&&{a}]", f"(?:(?={d}){b})"
        if op == "--":
            return f"[{c}&&[^{a}]]", f"(?:(?!{b}){d})"
        return f"[[{c}{a}]&&[^[{c}&&{a}]]]", f"(?:(?!{b}){d}|(?!{d}){b})"

    while i < len(src):
        c = src[i]
        if verbose and c.isspace():
            i += 1
        elif c == "]" and i > start:
            if plain and not nested and left is None:
                return (f"[{'^' * negated}{java}]", f"[{'^' * negated}{py}]", i + 1) if java else (*((_ANYTHING,) * 2 if negated else (_NOTHING,) * 2), i + 1)
            a, b = combined()
            return (f"[^{a}]", f"(?:(?!{b}){_ANYTHING})", i + 1) if negated else (a, b, i + 1)
        elif c == "[":
            m = re.compile(r"\[:(\^?)([a-z]+):\]").match(src, i)
            if m and m[2] not in POSIX:
                raise ProgramError(f"unknown class [:{m[2]}:]")
            if m and m[1]:
                nested.append((f"[^{POSIX[m[2]]}]",) * 2)
            elif m:
                java, py = java + POSIX[m[2]], py + POSIX[m[2]]
            else:
                a, b, i = _class(src, i, verbose)
                nested.append((a, b))
                continue
            i = m.end()
        elif src[i : i + 2] in ("&&", "--", "~~") and (i > start or c != "-"):
            left = combined()
            op, java, py, nested, plain, i = src[i : i + 2], "", "", [], False, i + 2
        elif c == "\\":
            m = _ESCAPE.match(src, i)
            if not m:
                raise ProgramError("unfinished escape")
            a, b = _escape(m, True)
            java, py, i = java + a, py + b, m.end()
        else:
            shown = "\\" + c if c in "]&~|^ #" else c
            java, py, i = java + shown, py + shown, i + 1
    raise ProgramError("unclosed class")


@dataclass
class _Flags:
    """Inline flags that are turned into other forms here."""

    verbose: bool = False
    swapped: bool = False
    crlf: bool = False
    dot_all: bool = False

    def turned(self, on: str, off: str) -> _Flags:
        given = {"x": "verbose", "U": "swapped", "R": "crlf", "s": "dot_all"}
        return replace(self, **{given[c]: True for c in on if c in given}, **{given[c]: False for c in off if c in given})


#: Line ends where CR LF, CR and LF all end lines, and never between CR and LF.
_CRLF = {"^": r"(?:\A|(?<=\n)|(?<=\r)(?!\n))", "$": r"(?:(?=\r)|(?<!\r)(?=\n)|{})", ".": r"[^\r\n]"}


def _is_text(parts: list[str]) -> bool:
    """Whether parts of a pattern are literal characters only."""
    return all((len(x) == 1 and x not in ".^$|()*+?") or (len(x) == 2 and x[0] == "\\" and not x[1].isalnum()) for x in parts)


@lru_cache(maxsize=512)
def _translate(src: str, dot_all: bool = False) -> tuple[str, str, dict[str, int], int, bool]:
    """(JVM form, Python form, names of groups, number of groups, whether the JVM form loops)."""
    java: list[str] = []
    py: list[str] = []
    opened: list[tuple[int, _Flags]] = []
    inline: list[list[str]] = [[]]  # Python's groups that stand for flags set within each open group
    rounds: list[float] = [1]  # of the JVM's matcher, within each open group
    inner: float = 1
    names: dict[str, int] = {}
    groups, i, atom, quantified, nested = 0, 0, None, False, False
    flags = _Flags(dot_all=dot_all)

    def put(a: str, b: str) -> None:
        java.append(a)
        py.append(b)

    def opening(a: str, b: str, then: _Flags) -> None:
        nonlocal flags
        opened.append((len(java), flags))
        rounds.append(1)
        inline.append([])
        put(a, b)
        flags = then

    def repeated(q: str, lazy: str) -> None:
        """A quantifier on the atom, for both matchers."""
        nonlocal inner, nested
        low, comma, high = q.strip("{}").partition(",") if q[0] == "{" else ("0" if q != "+" else "1", ",", "1" if q == "?" else "")
        most = float(high or (low if not comma else "inf"))
        body = java[atom:]
        if body[0].startswith("("):
            if most > 1 and not (_is_text(body[1:-1]) and inner == 1):
                nested |= most == float("inf") == max(inner, heights.get(atom, 1))
                inner *= most
            rounds[-1] = max(rounds[-1], inner)
        elif q[0] == "{" and comma and not _is_text(body):  # of characters that may have one or two units
            if not high:
                put(f"{{{low}}}", q + lazy)
                java.append(body[0] + "*" + lazy)
                py.append("")
                heights[atom] = float("inf")
                return
            rounds[-1] = max(rounds[-1], most - int(low))
        if most == float("inf"):
            heights[atom] = most
        put(q + lazy, q + lazy)

    heights: dict[int, float] = {}  # atoms repeated without bound
    while i < len(src):
        c = src[i]
        if flags.verbose and (c.isspace() or c == "#"):
            i = i + 1 if c != "#" else (src.find("\n", i) + 1 or len(src))
            continue
        q = _QUANT.match(src, i) if c in "*+?{" else None
        if q:
            if atom is None:
                raise ProgramError("nothing to repeat")
            if quantified:  # a repetition of a repetition, not a possessive one
                for side in (java, py):
                    side[atom:] = ["(?:" + "".join(side[atom:]) + ")"]
                rounds[-1] = inner = float("inf")
            i, quantified = q.end(), True
            lazy = src[i : i + 1] == "?"
            i += lazy
            repeated(q[0], "?" if lazy != flags.swapped else "")
            continue
        if c == "{":
            raise ProgramError("unfinished repetition")
        quantified, inner = False, 1
        if c == "(":
            named, flagged = _NAMED.match(src, i), _FLAGGED.match(src, i)
            if named:
                groups += 1
                names[named[1]] = groups
                opening("(", "(", flags)
                i = named.end()
            elif flagged:
                on, off = flagged[1], flagged[2] or ""
                if set(on + off) - set("imsuxUR"):
                    raise ProgramError(f"flags {flagged[0]!r} aren't supported")
                then = flags.turned(on, off)
                # Unicode classes are a flag of the JVM's matcher alone; the other matcher always has them.
                j_on = "".join({"i": "iu", "s": "s", "u": "U"}.get(x, "") for x in on)
                j_off = "".join({"i": "i", "m": "m", "s": "s", "u": "U"}.get(x, "") for x in off)
                p_on, p_off = ("".join(x for x in y if x in z) for y, z in ((on, "is"), (off, "ims")))
                j_all, p_all = (a + (f"-{b}" if b else "") for a, b in ((j_on, j_off), (p_on, p_off)))
                if flagged[3] == ":":
                    opening(f"(?{j_all}:", f"(?{p_all}:", then)
                else:
                    flags = then
                    # Python's matcher takes flags for the whole pattern or for a group; here up to the end of the one around.
                    put(f"(?{j_all})" if j_all else "", f"(?{p_all}:" if p_all else "")
                    inline[-1] += [f"(?{p_all}:"] if p_all else []
                i = flagged.end()
            elif src[i : i + 2] == "(?":
                raise ProgramError("look-around isn't supported")
            else:
                groups += 1
                opening("(", "(", flags)
                i += 1
            atom = None
            continue
        if c == ")":
            if not opened:
                raise ProgramError("unopened group")
            atom, flags = opened.pop()
            inner = rounds.pop()
            rounds[-1] = max(rounds[-1], inner)
            if any(x > atom for x in heights):
                heights[atom] = float("inf")
            put(")", ")" * (len(inline.pop()) + 1))
            i += 1
            continue
        if c == "|":
            put("|", ")" * len(inline[-1]) + "|" + "".join(inline[-1]))
            atom, i = None, i + 1
            continue
        atom = len(java)
        if c == "[":
            a, b, i = _class(src, i, flags.verbose)
            put(a, b)
        elif c == "\\":
            m = _ESCAPE.match(src, i)
            if not m:
                raise ProgramError("unfinished escape")
            put(*_escape(m, False))
            i = m.end()
        elif flags.crlf and c in "^$" or (flags.crlf and c == "." and not flags.dot_all):
            put(_CRLF[c].format(r"\z"), _CRLF[c].format(r"\Z"))
            i += 1
        elif c in "}]":
            put("\\" + c, "\\" + c)
            i += 1
        else:
            put(c, c)
            i += 1
    if opened:
        raise ProgramError("unclosed group")
    put("", ")" * len(inline[0]))
    if nested:
        log.warning("the pattern %r repeats a repetition; texts that nearly match may take very long", src)
    return "".join(java), "".join(py), names, groups, max(rounds) > ROUNDS
