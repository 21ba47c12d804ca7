"""Replacement templates of substitutions: literal text and references to groups."""

from __future__ import annotations

import re

from .pattern import Pattern

#: Escapes that stand for one character.
CONTROL = {"n": "\n", "t": "\t", "r": "\r"}
_PIECE = re.compile(
    r"""\\x(?P<hex>[0-9A-Fa-f]{2}) | \\(?P<back>[0-9]) | \\(?P<esc>.) | (?P<whole>&) | \$(?P<dollar>\$)
      | \$\{(?P<braced>[^}]*)\} | \$(?P<num>[0-9]+) | \$(?P<name>[A-Za-z_][A-Za-z0-9_]*) | (?P<text>.)""",
    re.S | re.X,
)


def compile_template(raw: str, pattern: Pattern) -> list[str | int]:
    """Pieces in order: text, or a group's number. References to groups that don't exist vanish."""
    out: list[str | int] = []

    def text(s: str) -> None:
        if out and isinstance(out[-1], str):
            out[-1] += s
        elif s:
            out.append(s)

    def group(n: int | None) -> None:
        if n is not None and n <= pattern.groups:
            out.append(n)

    for m in _PIECE.finditer(raw):
        kind, got = m.lastgroup, m[m.lastgroup]
        if kind == "hex":
            text(bytes([int(got, 16)]).decode("utf-8", "surrogateescape"))
        elif kind in ("back", "num"):
            group(int(got))
        elif kind == "whole":
            group(0)
        elif kind == "braced":
            group(int(got) if got.isdigit() else pattern.names.get(got))
        elif kind == "name":
            group(pattern.names.get(got))
        elif kind == "esc":
            text(CONTROL.get(got, got))
        else:
            text(got)
    return out


def fill(template: list[str | int], match) -> str:
    return "".join(p if isinstance(p, str) else match.group(p) or "" for p in template)


def unescape(raw: str) -> str:
    """The text of ``c`` and ``r``: ``\\n \\t \\r \\0`` and any other escaped character as itself."""
    return re.sub(r"\\(.)", lambda m: {"0": "\0"}.get(m[1], CONTROL.get(m[1], m[1])), raw, flags=re.S)
