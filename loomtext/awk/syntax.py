"""From source to a tree of tuples, by binding powers.

Statements: ``(print|printf, args) (if, c, then, else) (while, c, body) (for, init, c, post, body) (forin, var, array,
body) (delete, array, index) (break,) (continue,) (next,) (expr, e) (block, statements)``. Expressions: ``(num, v)
(str, s) (var, n) (field, e) (index, n, args) (call, n, args) (bin, op, l, r) (cmp, op, l, r) (and|or, l, r)
(not|neg|pos, e) (cond, c, a, b) (cat, l, r) (in, e, array) (assign, op, target, e) (incr, target, step, before)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..lang.pattern import ProgramError

KEYWORDS = frozenset("BEGIN END print printf if else while for in delete break continue next".split())
_TOKEN = re.compile(
    r"""(?P<skip>(?:\s|\#[^\n]*)+) | (?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?) | (?P<name>[A-Za-z_]\w*)
      | "(?P<str>(?:\\.|[^"\\])*)" | (?P<op>\+\+|--|[-+*/%^]=|[=!<>]=|&&|\|\||[-+*/%^=!<>?:;,(){}\[\]$])""",
    re.X | re.S | re.A,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
ASSIGN = {"=": None, "+=": "+", "-=": "-", "*=": "*", "/=": "/", "%=": "%", "^=": "^"}
#: Left binding powers of infix operators.
POWER = {"?": 2, "||": 3, "&&": 4, "in": 5, **dict.fromkeys(("<", "<=", ">", ">=", "==", "!="), 6), "cat": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
PREFIX, RAISE = 10, 11


def tokens(src: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(src):
        m = _TOKEN.match(src, at)
        if not m:
            raise ProgramError(f"awk: unexpected {src[at]!r}")
        kind, at = m.lastgroup, m.end()
        if kind == "num":
            out.append(("num", float(m["num"])))
        elif kind == "name":
            out.append(("kw" if m["name"] in KEYWORDS else "name", m["name"]))
        elif kind == "str":
            out.append(("str", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m["str"], flags=re.S)))
        elif kind == "op":
            out.append(("op", m["op"]))
    out.append(("end", ""))
    return out


@dataclass
class Program:
    begin: list = field(default_factory=list)
    main: list = field(default_factory=list)
    end: list = field(default_factory=list)


class _Parser:
    def __init__(self, src: str):
        self.toks, self.i = tokens(src), 0

    @property
    def tok(self) -> tuple[str, object]:
        return self.toks[self.i]

    def at(self, *texts: str) -> bool:
        return self.tok[0] in ("op", "kw") and self.tok[1] in texts

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ProgramError(f"awk: expected {text!r}, not {self.tok[1]!r}")

    def name(self) -> str:
        kind, text = self.tok
        if kind != "name":
            raise ProgramError("awk: expected a name")
        self.i += 1
        return text

    def program(self) -> Program:
        out = Program()
        while self.tok[0] != "end":
            if self.take(";"):
                continue
            if self.take("BEGIN"):
                out.begin += self.block()
            elif self.take("END"):
                out.end += self.block()
            else:
                out.main.append(self.statement())
        return out

    def block(self) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.tok[0] == "end":
                raise ProgramError("awk: unterminated block")
            if not self.take(";"):
                out.append(self.statement())
        return out

    def listed(self, *stops: str) -> list:
        if self.at(*stops) or self.tok[0] == "end":
            return []
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def statement(self) -> tuple:
        if self.at("{"):
            return ("block", self.block())
        kind, text = self.tok
        if kind != "kw" or text == "in":
            return ("expr", self.expr())
        self.i += 1
        if text in ("print", "printf"):
            args = self.listed(";", "}")
            if text == "printf" and not args:
                raise ProgramError("awk: printf needs a format")
            return (text, args)
        if text in ("break", "continue", "next"):
            return (text,)
        if text == "delete":
            array, index = self.name(), []
            if self.take("["):
                index = self.listed("]")
                self.need("]")
            return ("delete", array, index)
        if text in ("if", "while"):
            self.need("(")
            cond = self.expr()
            self.need(")")
            body = self.statement()
            if text == "while":
                return ("while", cond, body)
            mark = self.i
            while self.take(";"):
                pass
            if self.take("else"):
                return ("if", cond, body, self.statement())
            self.i = mark
            return ("if", cond, body, None)
        if text == "for":
            self.need("(")
            if self.tok[0] == "name" and self.toks[self.i + 1] == ("kw", "in"):
                mark, var = self.i, self.name()
                self.i += 1
                array = self.name()
                if self.take(")"):
                    return ("forin", var, array, self.statement())
                self.i = mark
            init = None if self.at(";") else self.statement()
            self.need(";")
            cond = None if self.at(";") else self.expr()
            self.need(";")
            post = None if self.at(")") else self.statement()
            self.need(")")
            return ("for", init, cond, post, self.statement())
        raise ProgramError(f"awk: unexpected {text}")

    def expr(self, least: int = 0) -> tuple:
        left = self.prefix()
        while True:
            kind, text = self.tok
            if kind == "op" and text in ASSIGN and least <= 1:
                self.target(left)
                self.i += 1
                return ("assign", ASSIGN[text], left, self.expr(1))
            op = text if kind == "op" or (kind, text) == ("kw", "in") else None
            if op not in POWER:
                if not (kind in ("num", "str", "name") or op in ("$", "(", "!", "++", "--")) or POWER["cat"] < least:
                    return left
                left = ("cat", left, self.expr(POWER["cat"] + 1))
                continue
            power = POWER[op]
            if power < least:
                return left
            self.i += 1
            if op == "?":
                yes = self.expr(1)
                self.need(":")
                return ("cond", left, yes, self.expr(1))
            if op == "in":
                left = ("in", left, self.name())
            elif power == 6:  # comparisons don't chain
                left = ("cmp", op, left, self.expr(7))
                if self.tok[0] == "op" and POWER.get(self.tok[1]) == 6:
                    return left
            elif op in ("&&", "||"):
                left = ("and" if op == "&&" else "or", left, self.expr(power + 1))
            else:
                left = ("bin", op, left, self.expr(power + 1))

    def target(self, e: tuple) -> tuple:
        if e[0] not in ("var", "field", "index"):
            raise ProgramError("awk: invalid assignment target")
        return e

    def prefix(self) -> tuple:
        for op, node in (("!", "not"), ("-", "neg"), ("+", "pos")):
            if self.take(op):
                return (node, self.prefix())
        for op, step in (("++", 1.0), ("--", -1.0)):
            if self.take(op):
                return ("incr", self.target(self.prefix()), step, True)
        out = self.primary()
        for op, step in (("++", 1.0), ("--", -1.0)):
            if self.at(op) and out[0] in ("var", "field", "index"):
                self.i += 1
                out = ("incr", out, step, False)
                break
        if self.take("^"):
            return ("bin", "^", out, self.prefix())
        return out

    def primary(self) -> tuple:
        kind, text = self.tok
        self.i += 1
        if kind in ("num", "str"):
            return (kind, text)
        if (kind, text) == ("op", "$"):
            return ("field", self.primary())
        if (kind, text) == ("op", "("):
            out = self.expr()
            self.need(")")
            return out
        if kind == "name":
            for open_, close, node in (("(", ")", "call"), ("[", "]", "index")):
                if self.take(open_):
                    args = self.listed(close)
                    self.need(close)
                    return (node, text, args)
            return ("var", text)
        raise ProgramError(f"awk: unexpected {text!r}")


def parse(src: str) -> Program:
    return _Parser(src).program()


def walk(node):
    """All tuples of a tree."""
    if isinstance(node, Program):
        for part in (node.begin, node.main, node.end):
            yield from walk(part)
    elif isinstance(node, list):
        for x in node:
            yield from walk(x)
    elif isinstance(node, tuple):
        yield node
        for x in node[1:]:
            if isinstance(x, (tuple, list)):
                yield from walk(x)
