"""Running a program record by record: the tree is compiled to Python functions once."""

from __future__ import annotations

import math
import struct
import time
from collections.abc import Callable, Iterable

from .syntax import Program, parse
from .values import AwkError, compare, number, printf, split, text, true


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Next(Exception):
    pass


_MATH = {"sin": math.sin, "cos": math.cos, "int": lambda x: float(math.trunc(x)) if math.isfinite(x) else x}


def _guarded(f: Callable[[float], float], x: float) -> float:
    try:
        return f(x)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.nan


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf if x == 0 else math.nan


def _power(a: float, b: float) -> float:
    try:
        out = a**b
        return math.nan if isinstance(out, complex) else out
    except ZeroDivisionError:
        return math.inf
    except OverflowError:
        return -math.inf if a < 0 and b % 2 else math.inf


_DEFAULTS = {"FS": " ", "OFS": " ", "ORS": "\n", "SUBSEP": "\x1c"}
_MASK = (1 << 64) - 1
#: Fixed values of the published xorshift64* generator as awk programs see it: its first state, the state in place of
#: zero, and its multiplier.
_FIRST, _NOT_ZERO, _TIMES = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D


class Machine:
    """One interpreter: variables and arrays live as long as it does; ``run`` handles one stream of records."""

    def __init__(self, source: str | Program):
        self.program = parse(source) if isinstance(source, str) else source
        self.vars: dict[str, float | str] = dict(_DEFAULTS)
        self.arrays: dict[str, dict[str, float | str]] = {}
        self.record, self.fields, self.nr = "", [], 0
        self.out: list[str] = []
        self.state, self.last_seed = _FIRST, 0.0
        c = self._block
        self.begin, self.main, self.end = c(self.program.begin), c(self.program.main), c(self.program.end)

    def run(self, records: Iterable[str]) -> str:
        """Printed text for a stream; ``begin`` and ``end`` run for each stream."""
        self.out = []
        self._outside(self.begin)
        for r in records:
            self.load(r)
            self.nr += 1
            self._outside(self.main)
        self._outside(self.end)
        return "".join(self.out)

    def _outside(self, block: Callable[[], None]) -> None:
        try:
            block()
        except _Next:
            pass
        except (_Break, _Continue):
            raise AwkError("break or continue, but no loop around it") from None

    def load(self, record: str) -> None:
        self.record = record
        self.fields = split(record, text(self.vars["FS"]))

    # Targets

    def _get(self, name: str) -> float | str:
        return float(self.nr) if name == "NR" else float(len(self.fields)) if name == "NF" else self.vars.get(name, "")

    def _join(self) -> None:
        self.record = text(self.vars["OFS"]).join(self.fields)

    def _set_field(self, i: int, v: float | str) -> None:
        if i < 0:
            raise AwkError("a field can't have a negative number")
        if i == 0:
            self.load(text(v))
            return
        self.fields += [""] * (i - len(self.fields))
        self.fields[i - 1] = text(v)
        self._join()

    def _set_nf(self, n: int) -> None:
        n = max(n, 0)
        self.fields = self.fields[:n] + [""] * (n - len(self.fields))
        self._join()

    def _key(self, args: list[Callable]) -> str:
        return text(self.vars["SUBSEP"]).join([text(a()) for a in args])

    def _place(self, e: tuple) -> tuple[Callable[[], object], Callable[[object], float | str], Callable[[object, float | str], None]]:
        """(address, read, write) of a target; the address is evaluated once."""
        if e[0] == "var":
            name = e[1]

            def put(_, v):
                if name == "NF":
                    self._set_nf(int(number(v)))
                else:
                    self.vars[name] = v

            return lambda: None, lambda _: self._get(name), put
        if e[0] == "field":
            at = self._expr(e[1])
            return lambda: int(number(at())), self._field, self._set_field
        name, args = e[1], [self._expr(a) for a in e[2]]
        return (
            lambda: self._key(args),
            lambda k: self.arrays.setdefault(name, {}).setdefault(k, ""),
            lambda k, v: self.arrays.setdefault(name, {}).__setitem__(k, v),
        )

    def _field(self, i: int) -> str:
        if i < 0:
            raise AwkError("a field can't have a negative number")
        return self.record if i == 0 else self.fields[i - 1] if i <= len(self.fields) else ""

    # Expressions

    def _expr(self, e: tuple) -> Callable[[], float | str]:
        return getattr(self, f"_e_{e[0]}")(*e[1:])

    def _e_num(self, v):
        return lambda: v

    _e_str = _e_num

    def _e_var(self, name):
        if name in ("NR", "NF"):
            return lambda: self._get(name)
        return lambda: self.vars.get(name, "")

    def _e_field(self, at):
        if at[0] == "num":
            i = int(at[1])
            return lambda: self._field(i)
        f = self._expr(at)
        return lambda: self._field(int(number(f())))

    def _e_index(self, name, args):
        where, read, _ = self._place(("index", name, args))
        return lambda: read(where())

    def _e_bin(self, op, left, right):
        a, b = self._expr(left), self._expr(right)
        return lambda: self._arith(op, number(a()), number(b()))

    @staticmethod
    def _arith(op: str, x: float, y: float) -> float:
        if op == "+":
            return x + y
        if op == "-":
            return x - y
        if op == "*":
            return x * y
        if op == "^":
            return _power(x, y)
        if y == 0:
            raise AwkError("a division by zero")
        return x / y if op == "/" else math.fmod(x, y) if math.isfinite(x) else math.nan

    def _e_cmp(self, op, left, right):
        a, b = self._expr(left), self._expr(right)
        test = {"<": lambda c: c < 0, "<=": lambda c: c <= 0, ">": lambda c: c > 0, ">=": lambda c: c >= 0, "==": lambda c: c == 0, "!=": lambda c: c != 0}[op]
        return lambda: float(test(compare(a(), b())))

    def _e_and(self, left, right):
        a, b = self._expr(left), self._expr(right)
        return lambda: float(true(a()) and true(b()))

    def _e_or(self, left, right):
        a, b = self._expr(left), self._expr(right)
        return lambda: float(true(a()) or true(b()))

    def _e_not(self, e):
        f = self._expr(e)
        return lambda: float(not true(f()))

    def _e_neg(self, e):
        f = self._expr(e)
        return lambda: -number(f())

    def _e_pos(self, e):
        f = self._expr(e)
        return lambda: number(f())

    def _e_cond(self, c, a, b):
        c, a, b = self._expr(c), self._expr(a), self._expr(b)
        return lambda: a() if true(c()) else b()

    def _e_cat(self, left, right):
        a, b = self._expr(left), self._expr(right)
        return lambda: text(a()) + text(b())

    def _e_in(self, e, array):
        f = self._expr(e)
        return lambda: float(text(f()) in self.arrays.get(array, ()))

    def _e_assign(self, op, target, e):
        where, read, write = self._place(target)
        f = self._expr(e)

        def run():
            if op is None:
                v = f()
                write(where(), v)
            else:
                k, y = where(), number(f())
                v = self._arith(op, number(read(k)), y)
                write(k, v)
            return v

        return run

    def _e_incr(self, target, step, before):
        where, read, write = self._place(target)

        def run():
            k = where()
            old = number(read(k))
            write(k, old + step)
            return old + step if before else old

        return run

    def _e_call(self, name, args):
        fs = [self._expr(a) for a in args] if name != "split" else []
        n = len(args)

        def need(*counts):
            if n not in counts:
                raise AwkError(f"{name} doesn't take {n} arguments")

        if name in _MATH or name in ("exp", "sqrt", "log"):
            f = _MATH.get(name) or {"exp": math.exp, "sqrt": math.sqrt, "log": _log}[name]

            def run():
                need(1)
                return _guarded(f, number(fs[0]()))
        elif name == "atan2":

            def run():
                need(2)
                return math.atan2(number(fs[0]()), number(fs[1]()))
        elif name == "rand":

            def run():
                need(0)
                return self._random()
        elif name == "srand":

            def run():
                seed = number(fs[0]()) if fs else float(int(time.time()))
                old, self.last_seed = self.last_seed, seed
                (bits,) = struct.unpack("<Q", struct.pack("<d", seed))
                self.state = bits ^ _FIRST or _NOT_ZERO
                return old
        elif name == "length":

            def run():
                return float(len(text(fs[0]()) if fs else self.record))
        elif name == "substr":

            def run():
                need(2, 3)
                s, start = text(fs[0]()), math.trunc(number(fs[1]()))
                stop = len(s) if n == 2 else min(len(s), math.trunc(number(fs[1]()) + number(fs[2]()) - 1))
                return s[max(start, 1) - 1 : max(stop, 0)]
        elif name == "index":

            def run():
                need(2)
                return float(text(fs[0]()).find(text(fs[1]())) + 1)
        elif name == "split":
            fs = [self._expr(a) for a in args[:1] + args[2:3]]
            array = args[1][1] if n > 1 and args[1][0] == "var" else None

            def run():
                need(2, 3)
                if array is None:
                    raise AwkError("split fills an array, given by its name")
                s, sep = text(fs[0]()), text(fs[1]() if n == 3 else self.vars["FS"])
                parts = split(s, sep)
                self.arrays[array] = {str(i): p for i, p in enumerate(parts, 1)}
                return float(len(parts))
        elif name in ("tolower", "toupper"):

            def run():
                need(1)
                s = text(fs[0]())
                return s.lower() if name == "tolower" else s.upper()
        elif name == "sprintf":

            def run():
                if not n:
                    need(1)
                return printf(text(fs[0]()), [f() for f in fs[1:]])
        else:

            def run():
                raise AwkError(f"there is no function {name}")

        return run

    def _random(self) -> float:
        x = self.state
        x ^= x >> 12
        x = (x ^ (x << 25)) & _MASK
        x ^= x >> 27
        self.state = x
        return ((x * _TIMES & _MASK) >> 11) / (1 << 53)

    # Statements

    def _block(self, statements: list) -> Callable[[], None]:
        fs = [self._stmt(s) for s in statements]
        if len(fs) == 1:
            return fs[0]

        def run():
            for f in fs:
                f()

        return run

    def _stmt(self, s: tuple) -> Callable[[], None]:
        return getattr(self, f"_s_{s[0]}")(*s[1:])

    def _s_expr(self, e):
        return self._expr(e)

    def _s_block(self, statements):
        return self._block(statements)

    def _s_print(self, args):
        fs = [self._expr(a) for a in args]
        if not fs:
            return lambda: self.out.append(self.record + text(self.vars["ORS"]))
        return lambda: self.out.append(text(self.vars["OFS"]).join([text(f()) for f in fs]) + text(self.vars["ORS"]))

    def _s_printf(self, args):
        fs = [self._expr(a) for a in args]
        return lambda: self.out.append(printf(text(fs[0]()), [f() for f in fs[1:]]))

    def _s_if(self, cond, then, other):
        c, a, b = self._expr(cond), self._stmt(then), self._stmt(other) if other else lambda: None
        return lambda: a() if true(c()) else b()

    def _loop(self, cond, body, post):
        while cond is None or true(cond()):
            try:
                body()
            except _Break:
                return
            except _Continue:
                pass
            if post:
                post()

    def _s_while(self, cond, body):
        c, b = self._expr(cond), self._stmt(body)
        return lambda: self._loop(c, b, None)

    def _s_for(self, init, cond, post, body):
        i, c, p, b = self._stmt(init) if init else None, self._expr(cond) if cond else None, self._stmt(post) if post else None, self._stmt(body)

        def run():
            if i:
                i()
            self._loop(c, b, p)

        return run

    def _s_forin(self, var, array, body):
        b = self._stmt(body)

        def run():
            for k in list(self.arrays.get(array, ())):
                self.vars[var] = k
                try:
                    b()
                except _Break:
                    return
                except _Continue:
                    pass

        return run

    def _s_delete(self, array, index):
        fs = [self._expr(a) for a in index]

        def run():
            if fs:
                self.arrays.get(array, {}).pop(self._key(fs), None)
            else:
                self.arrays.pop(array, None)

        return run

    def _raise(self, kind):
        def run():
            raise kind

        return run

    def _s_break(self):
        return self._raise(_Break)

    def _s_continue(self):
        return self._raise(_Continue)

    def _s_next(self):
        return self._raise(_Next)
