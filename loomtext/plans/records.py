"""The record language over the rows of a DataFrame, each row a record of one stream.

Three classes of programs, found from the tree:

* record-local: nothing read depends on earlier records; one projection.
* algebraic: variables and array elements only gather (sums, counts, constants, minimum and maximum, and where an order is
  given the last value) and are read in END; partial and final aggregation by ``groupBy``, one group per key, whatever the
  number of keys.
* running: records also print variables that only add up, or NR. Rows are dealt by ranges of the given order and written;
  each range adds up by itself, beginning with what the ranges before it add up to.
* sequential: anything else; run in order of the given columns by one task, record by record, if the caller allows it.

Rows that come out are ``part, text``: what a record, an END statement or a key printed. In running and sequential
programs ``part`` is their order; keys of ``for (k in a)`` have none anyway.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..awk.run import Machine
from ..awk.syntax import Program, parse, walk
from ..awk.values import conversions, printf, printf_all, wholly
from ..cluster import scratch, ship
from ..operators.edit import NotExact
from ..operators.select import quoted

#: Unicode's white space, as a plain class, which the JVM's matcher tells sooner than its own ``\s``.
_SPACE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
_NOT_BLANK = _SPACE.replace("\\r ", "\\r").removesuffix("+")
_NUMBER = "^" + _SPACE.replace("]+", "]*") + r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_WHOLE = _NUMBER + _SPACE.replace("]+", "]*$")


@dataclass(frozen=True)
class Val:
    """A value: a double or string column; null doubles are values never set."""

    col: Column
    num: bool
    known: tuple[Column, Column] | None = None  # number and wholly, where a projection before has them

    @property
    def number(self) -> Column:
        if self.num:
            return F.coalesce(self.col, F.lit(0.0))
        if self.known:
            return self.known[0]
        return self.parse(self.wholly)

    def parse(self, wholly: Column) -> Column:
        """The number of a text; the cast takes more than numbers, so only what is wholly one goes there at once."""
        return F.coalesce(F.when(wholly, self.col.try_cast("double")), F.regexp_extract(self.col, _NUMBER, 1).try_cast("double"), F.lit(0.0))

    @property
    def text(self) -> Column:
        if not self.num:
            return self.col
        x = self.col
        whole = (F.abs(x) < 1e16) & (x == F.floor(x))
        digits = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")
        odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        return F.when(x.isNull(), "").when(whole, x.cast("long").cast("string")).otherwise(F.coalesce(odd, digits))

    @property
    def wholly(self) -> Column:
        return F.lit(True) if self.num else self.known[1] if self.known else F.regexp_like(self.col, F.lit(_WHOLE))

    @property
    def true(self) -> Column:
        if self.num:
            return self.number != 0
        return F.when(self.wholly, self.number != 0).otherwise(self.col != "")


def num(c: Column) -> Val:
    return Val(c, True)


def string(c: Column) -> Val:
    return Val(c, False)


def flag(c: Column) -> Val:
    return num(F.when(c, 1.0).otherwise(0.0))


def split_record(s: Column, sep: str) -> Column:
    """Fields of a record (array<string>)."""
    none = F.array().cast("array<string>")
    if sep == " ":
        # The JVM compiles a pattern for each row that is split, but none for a single blank.
        blanks = F.when(F.regexp_like(s, F.lit(_NOT_BLANK)), F.regexp_replace(s, _SPACE, " ")).otherwise(s)
        parts = F.array_remove(F.split(blanks, " ", -1), "")
    elif sep == "":
        parts = F.filter(F.split(s, "", -1), lambda x: x != "")
    else:
        parts = F.split(s, quoted(sep), -1)
    return F.when(s == "", none).otherwise(parts)


@dataclass
class State:
    """One record while its statements are followed."""

    record: Column
    fields: Column | None
    fs: str
    ofs: str
    ors: str
    subsep: str
    given: dict[str, Val] = field(default_factory=dict)
    vars: dict[str, Val] = field(default_factory=dict)
    assigned: frozenset[str] = frozenset()
    arrays: dict[str, Column] = field(default_factory=dict)
    element: object = None
    guard: Column | None = None
    done: Column | None = None
    printed: list[Column] = field(default_factory=list)
    lets: list[tuple[str, Column]] | None = None
    parsed: dict[int, Val] = field(default_factory=dict)

    def let(self, c: Column) -> Column:
        """A column that is worked out once, in a projection of its own, where the plan has these (``lets``)."""
        if self.lets is None:
            return c
        self.lets.append((f"__l{len(self.lets)}", c))
        return F.col(self.lets[-1][0])

    def under(self) -> Column | None:
        parts = [p for p in (self.guard, None if self.done is None else ~self.done) if p is not None]
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    # Expressions

    def expr(self, e: tuple) -> Val:
        return getattr(self, f"_{e[0]}", self._unknown)(*e[1:])

    def _unknown(self, *_):
        raise NotExact("not in this class")

    def _num(self, v):
        return num(F.lit(v))

    def _str(self, v):
        return string(F.lit(v))

    def _var(self, name):
        if name == "NF":
            return num(F.size(self.fields).cast("double"))
        if name in self.vars:
            return self.vars[name]
        if name in self.given:
            return self.given[name]
        if name == "NR" or name in self.assigned:
            raise NotExact(f"{name} depends on earlier records")
        known = {"FS": self.fs, "OFS": self.ofs, "ORS": self.ors, "SUBSEP": self.subsep}
        return string(F.lit(known.get(name, "")))

    def _field(self, at):
        if at[0] == "num":
            i = int(at[1])
            if i not in self.parsed:
                v = string(self.record if i == 0 else F.coalesce(F.get(self.fields, F.lit(i - 1)), F.lit("")))
                if self.lets is not None:
                    v = string(self.let(v.col))
                    wholly = self.let(v.wholly)
                    v = replace(v, known=(self.let(v.parse(wholly)), wholly))
                self.parsed[i] = v
            return self.parsed[i]
        i = self.expr(at).number.cast("int")
        return string(F.when(i == 0, self.record).otherwise(F.coalesce(F.get(self.fields, i - 1), F.lit(""))))

    def _index(self, name, args):
        if name not in self.arrays and self.element is not None:
            return self.element(name, args)
        if name not in self.arrays or len(args) != 1:
            raise NotExact("arrays outlive records")
        return string(F.coalesce(F.get(self.arrays[name], self.expr(args[0]).number.cast("int") - 1), F.lit("")))

    def _bin(self, op, left, right):
        x, y = self.expr(left).number, self.expr(right).number
        if op in "/%":
            safe = F.when(y == 0, F.raise_error(F.lit("a division by zero")).cast("double")).otherwise(y)
            return num(x / safe if op == "/" else x % safe)
        return num({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[op]())

    def _cmp(self, op, left, right):
        a, b = self.expr(left), self.expr(right)
        test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}[op]
        for e in (left, right):  # a constant that isn't a number settles the kind
            if e[0] == "str" and not _numeric(e[1]):
                return flag(test(a.text, b.text))
        if a.num and b.num:
            return flag(test(a.number, b.number))
        return flag(F.when(a.wholly & b.wholly, test(a.number, b.number)).otherwise(test(a.text, b.text)))

    def _and(self, left, right):
        return flag(self.expr(left).true & self.expr(right).true)

    def _or(self, left, right):
        return flag(self.expr(left).true | self.expr(right).true)

    def _not(self, e):
        return flag(~self.expr(e).true)

    def _neg(self, e):
        return num(-self.expr(e).number)

    def _pos(self, e):
        return num(self.expr(e).number)

    def _cond(self, c, a, b):
        test, x, y = self.expr(c).true, self.expr(a), self.expr(b)
        if x.num != y.num:
            raise NotExact("branches of two kinds")
        return Val(F.when(test, x.col).otherwise(y.col), x.num)

    def _cat(self, left, right):
        return string(F.concat(self.expr(left).text, self.expr(right).text))

    def _call(self, name, args):
        if name == "split" and len(args) in (2, 3) and args[1][0] == "var":
            fixed = {"FS": self.fs, "OFS": self.ofs, "ORS": self.ors, "SUBSEP": self.subsep}
            sep = self.fs if len(args) == 2 else args[2][1] if args[2][0] == "str" else fixed.get(args[2][1]) if args[2][0] == "var" else None
            if sep is None or self.guard is not None:
                raise NotExact("separator known at run time only")
            self.arrays[args[1][1]] = split_record(self.expr(args[0]).text, sep)
            return num(F.size(self.arrays[args[1][1]]).cast("double"))
        vals = [self.expr(a) for a in args]
        n = len(vals)
        x = vals[0].number if n else None
        s = vals[0].text if n else self.record
        if name == "length" and n < 2:
            return num(F.length(s).cast("double"))
        one = {
            "int": lambda: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
            "sqrt": lambda: F.sqrt(x),
            "exp": lambda: F.exp(x),
            "sin": lambda: F.sin(x),
            "cos": lambda: F.cos(x),
            "log": lambda: F.when(x > 0, F.log(x)).when(x == 0, float("-inf")).otherwise(float("nan")),
        }
        if name in one and n == 1:
            return num(one[name]())
        if name == "atan2" and n == 2:
            return num(F.atan2(x, vals[1].number))
        if name in ("tolower", "toupper") and n == 1:
            return string(F.lower(s) if name == "tolower" else F.upper(s))
        if name == "index" and n == 2:
            return num(F.instr(s, vals[1].text).cast("double"))
        if name == "substr" and n in (2, 3):
            m = vals[1].number
            start = F.greatest(m.cast("int"), F.lit(1))
            stop = F.length(s) if n == 2 else F.least((m + vals[2].number - 1).cast("int"), F.length(s))
            return string(F.substr(s, start, F.greatest(stop - start + 1, F.lit(0))))
        if name == "sprintf" and n:
            return string(formatted(vals, args[0]))
        raise NotExact(f"{name} isn't a function of one record")

    def _assign(self, op, target, e):
        value = self.expr(e)
        if op is not None:
            value = self._bin(op, target, e)
        return self._store(target, value)

    def _incr(self, target, step, before):
        old = self.expr(target)
        new = num(old.number + step)
        self._store(target, new)
        return new if before else num(old.number)

    def _store(self, target: tuple, value: Val) -> Val:
        when = self.guard  # what a record does after ``next`` is never seen
        if target[0] == "var":
            name = target[1]
            if name in ("FS", "OFS", "ORS", "SUBSEP", "NR"):
                raise NotExact(f"{name} set by a record")
            if name == "NF":
                if when is not None:
                    raise NotExact("conditional NF")
                n = F.greatest(value.number.cast("int"), F.lit(0))
                self.fields = F.slice(F.concat(self.fields, F.array_repeat(F.lit(""), F.greatest(n - F.size(self.fields), F.lit(0)))), F.lit(1), n)
                self.record = F.array_join(self.fields, self.ofs)
                self.parsed = {}
                return value
            if when is not None:
                old = self.vars.get(name)
                if old is None or old.num != value.num:
                    raise NotExact("variable of two kinds")
                value = Val(F.when(when, value.col).otherwise(old.col), value.num)
            self.vars[name] = value
            return value
        if target[0] == "field" and target[1][0] == "num":
            i, text = int(target[1][1]), value.text
            if i == 0:
                record, fields = text, split_record(text, self.fs)
            else:
                padded = F.concat(self.fields, F.array_repeat(F.lit(""), F.greatest(F.lit(i) - F.size(self.fields), F.lit(0))))
                fields = F.transform(padded, lambda f, at: F.when(at == i - 1, text).otherwise(f))
                record = F.array_join(fields, self.ofs)
            self.record = record if when is None else F.when(when, record).otherwise(self.record)
            self.fields = fields if when is None else F.when(when, fields).otherwise(self.fields)
            self.parsed = {}
            return value
        raise NotExact("arrays outlive records")

    # Statements

    def follow(self, statements: list) -> None:
        for s in statements:
            kind = s[0]
            if kind == "expr":
                self.expr(s[1])
            elif kind == "block":
                self.follow(s[1])
            elif kind == "print":
                vals = [self.expr(a).text for a in s[1]] or [self.record]
                self.emit(F.concat(F.concat_ws(self.ofs, *vals), F.lit(self.ors)))
            elif kind == "printf":
                self.emit(formatted([self.expr(a) for a in s[1]], s[1][0]))
            elif kind == "if":
                cond, outer, now = self.expr(s[1]).true, self.guard, self.under()
                if self.lets is not None:  # null where it isn't reached
                    cond = self.let(cond if now is None else F.when(now, cond))
                    yes, no = (cond, ~cond) if now is None else (F.coalesce(cond, F.lit(False)), F.coalesce(~cond, F.lit(False)))
                else:
                    yes, no = (cond, ~cond) if outer is None else (outer & cond, outer & ~cond)
                self.guard = yes
                self.follow([s[2]])
                if s[3]:
                    self.guard = no
                    self.follow([s[3]])
                self.guard = outer
            elif kind == "next":
                now = self.under()
                gone = F.lit(True) if now is None else now
                self.done = gone if self.done is None else self.done | gone
            else:
                raise NotExact(f"{kind} runs record by record")

    def emit(self, text: Column) -> None:
        when = self.under()
        self.printed.append(self.let(text if when is None else F.when(when, text)))

    def result(self) -> Column:
        """All printed text, null if nothing was."""
        if not self.printed:
            return F.lit(None).cast("string")
        if len(self.printed) == 1:
            return self.printed[0]
        any_ = F.coalesce(*self.printed)
        return F.when(any_.isNotNull(), F.concat(*[F.coalesce(p, F.lit("")) for p in self.printed]))


@dataclass
class Running(State):
    """A record where variables add up over records: ``names`` of those that each adding statement has, in order.

    On the first walk the statements' values are found; on the second one their sums are the columns ``__x`` (before the
    record) and ``__w`` (after it).
    """

    names: tuple[str, ...] = ()
    first: bool = True
    added: list[Column] = field(default_factory=list)

    def _var(self, name):
        if name == "NR":
            return num(F.lit(0.0) if self.first else F.col("__nr"))
        return self._sum(name) if name in self.names else super()._var(name)

    def _sum(self, name: str) -> Val:
        if self.first:
            return num(F.lit(0.0))
        start = self.given[name].number if name in self.given else None
        return num(_total([F.col(f"__{'w' if i < len(self.added) else 'x'}{i}") for i, n in enumerate(self.names) if n == name], start))

    def _add(self, name: str, value: Column) -> None:
        when = self.under()
        self.added.append(value if when is None else F.when(when, value))

    def _assign(self, op, target, e):
        if target[0] != "var" or target[1] not in self.names:
            return super()._assign(op, target, e)
        value = self.expr(e).number
        self._add(target[1], value if op == "+" else -value)
        return self._sum(target[1])

    def _incr(self, target, step, before):
        if target[0] != "var" or target[1] not in self.names:
            return super()._incr(target, step, before)
        old = self._sum(target[1])
        self._add(target[1], F.lit(float(step)))
        return self._sum(target[1]) if before else num(old.number)


def _total(parts: list[Column], start: Column | None) -> Column:
    """The sum of what was added; null if nothing ever was."""
    out = parts[0]
    for p in parts[1:]:
        out = F.when(out.isNotNull() | p.isNotNull(), F.coalesce(out, F.lit(0.0)) + F.coalesce(p, F.lit(0.0)))
    return out if start is None else start + F.coalesce(out, F.lit(0.0))


def adding(main: list) -> tuple[str, ...]:
    """The variable of each adding statement (``s += e``, ``n++``), in order; ``NotExact`` if one reads what is added up."""
    found: list[tuple[str, list]] = []
    others: list[tuple[tuple, list]] = []

    def scan(statements: list, conds: list) -> None:
        for s in statements:
            if s[0] == "block":
                scan(s[1], conds)
            elif s[0] == "if":
                scan([s[2]] + ([s[3]] if s[3] else []), [*conds, s[1]])
            elif s[0] == "expr" and s[1][0] == "incr" and s[1][1][0] == "var" and s[1][1][1] not in ("NR", "NF"):
                found.append((s[1][1][1], conds))
            elif s[0] == "expr" and s[1][0] == "assign" and s[1][1] in ("+", "-") and s[1][2][0] == "var" and s[1][2][1] not in ("NR", "NF"):
                found.append((s[1][2][1], [*conds, s[1][3]]))
            elif s[0] == "next":
                others.append((("next",), conds))
            else:
                others.extend((t[2] if t[0] == "assign" else t[1], [*conds, t[3] if t[0] == "assign" else t[1]]) for t in walk(s) if t[0] in ("assign", "incr"))

    scan(main, [])
    running = {name for name, _ in found} | {"NR"}
    while True:  # what is made of sums runs as well
        more = set(running)
        for target, parts in others:
            if any(t[0] == "var" and t[1] in running for p in parts for t in walk(p)):
                if target[0] != "var" or target[1] in {name for name, _ in found}:
                    raise NotExact("a record changes by what is added up")
                more.add(target[1])
        if more == running:
            break
        running = more
    if any(t[0] == "var" and t[1] in running for _, parts in found for p in parts for t in walk(p)) or any(t[0] == "var" and t[1] in {n for n, _ in found} for t, _ in others):
        raise NotExact("adds what it has added up")
    return tuple(name for name, _ in found)


def dealt_by_range(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by ranges of ``order``, numbered in ``__range``."""
    folder = f"{scratch(rows.sparkSession)}/loomtext/ranges-{uuid.uuid4().hex}"
    # Written, as the ranges must be the same in both passes; their number is that of the shuffle's tasks.
    rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def starts(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each range: the sum of each column over the ranges before it, as ``<column>b``."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"{c}t") for c in columns])
    return total.select("__range", *[F.sum(f"{c}t").over(before).alias(f"{c}b") for c in columns])


def _numeric(s: str) -> bool:
    return wholly(s) is not None


def formatted(vals: list[Val], form: tuple = ()) -> Column:
    """printf: exact digits of the C library's rules, in Arrow batches. Values of a constant ``form`` come as it takes them."""
    kinds = conversions(form[1]) if form[:1] == ("str",) else ()
    numeric = [v.num or i < len(kinds) and kinds[i] not in "sc" for i, v in enumerate(vals[1:])]

    @F.arrow_udf(T.StringType())
    def run(forms: pa.Array, *args: pa.Array) -> pa.Array:
        distinct = forms.unique().to_pylist()
        if len(distinct) == 1 and distinct[0] is not None and (made := printf_all(distinct[0], args)) is not None:
            return pa.array(made, pa.string())
        rows = zip(*[["" if x is None else x for x in a.to_pylist()] for a in args], strict=True) if args else iter([()] * len(forms))
        return pa.array([printf(f or "", list(r)) for f, r in zip(forms.to_pylist(), rows, strict=True)], pa.string())

    return run(vals[0].text, *[v.col if v.num else v.number if n else v.text for v, n in zip(vals[1:], numeric, strict=True)])


@dataclass(frozen=True)
class Gather:
    """One gathering statement: what is updated, how, with what, under which condition."""

    target: tuple
    how: str
    value: tuple | float
    guard: tuple[tuple[tuple, bool], ...]


def gathers(main: list, guard: tuple = (), ordered: bool = False) -> list[Gather]:
    """The gathering statements of a main part; ``NotExact`` if it has others. Last values need an order."""
    out: list[Gather] = []
    for s in main:
        if s[0] == "block":
            out += gathers(s[1], guard, ordered)
        elif s[0] == "if":
            best = _extreme(s)
            if best:
                out.append(replace(best, guard=guard))
            else:
                out += gathers([s[2]], (*guard, (s[1], True)), ordered)
                out += gathers([s[3]], (*guard, (s[1], False)), ordered) if s[3] else []
        elif s[0] == "expr" and s[1][0] == "incr" and s[1][1][0] in ("var", "index"):
            out.append(Gather(s[1][1], "sum", ("num", s[1][2]), guard))
        elif s[0] == "expr" and s[1][0] == "assign" and s[1][2][0] in ("var", "index"):
            _, op, target, e = s[1]
            if op in ("+", "-"):
                out.append(Gather(target, "sum", e if op == "+" else ("neg", e), guard))
            elif op is None and e[0] in ("num", "str"):
                out.append(Gather(target, "const", e, guard))
            elif op is None and ordered:
                out.append(Gather(target, "last", e, guard))
            else:
                raise NotExact("not a gathering statement")
        else:
            raise NotExact("not a gathering statement")
    names = {g.target[1] for g in out}
    for g in out:
        parts = [g.value, *(c for c, _ in g.guard), *(g.target[2] if g.target[0] == "index" else [])]
        if any(t[0] in ("var", "index", "in") and (t[1] in names or t[-1] in names or t == ("var", "NR")) for p in parts if isinstance(p, (tuple, list)) for t in walk(p)):
            raise NotExact("reads what it gathers")
    return out


def _extreme(s: tuple) -> Gather | None:
    """``if (NR == 1 || e < m) m = e`` and its like for the maximum."""
    _, cond, then, other = s
    while then[0] == "block" and len(then[1]) == 1:
        then = then[1][0]
    if other or then[0] != "expr" or then[1][0] != "assign" or then[1][1] is not None:
        return None
    target, value = then[1][2], then[1][3]
    if cond[0] != "or" or cond[1] != ("cmp", "==", ("var", "NR"), ("num", 1.0)) or cond[2][0] != "cmp" or cond[2][1] not in "<>":
        return None
    _, op, left, right = cond[2]
    if (left, right) == (value, target):
        return Gather(target, "min" if op == "<" else "max", value, ())
    if (left, right) == (target, value):
        return Gather(target, "max" if op == "<" else "min", value, ())
    return None


@dataclass(frozen=True)
class RecordProgram:
    source: str

    def _parts(self) -> tuple[Program, dict, str]:
        prog = parse(self.source)
        first = Machine(Program(begin=prog.begin))
        printed = first.run([])
        if first.arrays:
            raise NotExact("BEGIN fills arrays")
        return prog, first.vars, printed

    def _state(self, variables: dict, record: Column, fields: Column | None) -> State:
        own = {k: v for k, v in variables.items() if k not in ("FS", "OFS", "ORS", "SUBSEP")}
        text = lambda k: variables[k] if isinstance(variables[k], str) else str(variables[k])
        given = {k: num(F.lit(v)) if isinstance(v, float) else string(F.lit(v)) for k, v in own.items()}
        return State(record, fields, text("FS"), text("OFS"), text("ORS"), text("SUBSEP"), given=given)

    def kind(self) -> str:
        """``local``, ``algebraic`` or ``sequential``."""
        for name, plan in (("local", self._local), ("algebraic", self._algebraic)):
            try:
                plan(None)
                return name
            except NotExact:
                continue
        return "sequential"

    def over(self, df: DataFrame, record: str, order: list[str] | None = None) -> DataFrame:
        """Run over the rows of ``df``; ``order`` allows the sequential class, in that order."""
        ship(df.sparkSession)
        at = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order or ())]
        line = F.col(record).cast("string")
        ended = F.when(line.endswith("\n"), F.regexp_replace(line, "\\r?\\n\\z", "")).otherwise(line)
        rows = df.select(F.coalesce(ended, F.lit("")).alias("__record"), *at)
        for plan in (self._local, lambda rows: self._algebraic(rows, len(at))):
            try:
                return plan(rows)
            except NotExact:
                continue
        if order:
            try:
                return self._running(rows, len(order))
            except NotExact:
                pass
        if order is None:
            raise NotExact("this program depends on the order of records: name the columns that order them")
        return self._sequential(df, record, order)

    def _local(self, rows: DataFrame | None):
        prog, variables, printed = self._parts()
        if prog.end:
            raise NotExact("END sees all records")
        sep = variables["FS"] if isinstance(variables["FS"], str) else str(variables["FS"])
        state = self._state(variables, F.col("__record"), F.col("__fields"))
        state.assigned = frozenset(t[2][1] if t[0] == "assign" else t[1][1] for t in walk(prog.main) if t[0] in ("assign", "incr") and (t[2] if t[0] == "assign" else t[1])[0] == "var")
        state.lets = []
        state.follow(prog.main)
        if rows is None:
            return None
        out = rows.withColumn("__fields", split_record(F.col("__record"), sep))
        for name, c in state.lets:
            out = out.withColumn(name, c)
        if _prints(prog.main):
            out = out.select(F.lit(1).alias("part"), state.result().alias("text"))
        else:  # behind a generator: else the filter would be pushed below the projections and repeat them all
            out = out.select(F.lit(1).alias("part"), F.stack(F.lit(1), state.result()).alias("text")).where("text is not null")
        return self._after(rows, printed, [out])

    @staticmethod
    def _after(rows: DataFrame, printed: str, parts: list[DataFrame]) -> DataFrame:
        if printed:
            parts = [rows.sparkSession.createDataFrame([(0, printed)], "part int, text string"), *parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _algebraic(self, rows: DataFrame | None, ordered: int = 0):
        prog, variables, printed = self._parts()
        if not prog.end:
            raise NotExact("nothing is read in the end")
        found = gathers(prog.main, ordered=ordered > 0)
        place = F.struct(*[F.col(f"__o{i}") for i in range(ordered)]) if ordered else None
        sep = variables["FS"] if isinstance(variables["FS"], str) else str(variables["FS"])
        state = self._state(variables, F.col("__record"), F.col("__fields"))
        src = None if rows is None else rows.withColumn("__fields", split_record(F.col("__record"), sep))

        def aggregate(g: Gather) -> Column:
            cond = None
            for c, want in g.guard:
                t = state.expr(c).true
                t = t if want else ~t
                cond = t if cond is None else cond & t
            v = state.expr(g.value)
            if g.how in ("min", "max"):  # by number, shown as it stood; texts have no order that aggregation could keep
                sure = F.when(v.wholly, v.number).otherwise(F.raise_error(F.lit("the least or greatest of values that aren't all numbers depends on their order")).cast("double"))
                pair = F.struct(sure, v.text.alias("text"))
                return (F.min if g.how == "min" else F.max)(pair if cond is None else F.when(cond, pair))["text"]
            if g.how == "last":
                return F.max_by(v.col, place if cond is None else F.when(cond, place))
            col = v.number if g.how == "sum" else v.col
            col = col if cond is None else F.when(cond, col)
            return (F.sum if g.how == "sum" else F.max)(col)

        scalars: dict[str, list[Gather]] = {}
        arrays: dict[str, list[Gather]] = {}
        for g in found:
            (arrays if g.target[0] == "index" else scalars).setdefault(g.target[1], []).append(g)
        aggs, given = [F.count(F.lit(1)).cast("double").alias("__nr")], {"NR": num(F.col("__nr"))}
        for name, gs in scalars.items():
            if len({g.how for g in gs}) > 1 or (len(gs) > 1 and gs[0].how != "sum"):
                raise NotExact("gathers in two ways")
            cols = [aggregate(g) for g in gs]
            total = cols[0]
            for c in cols[1:]:
                total = F.coalesce(total, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))
            aggs.append(total.alias(f"s_{name}"))
            given[name] = _gathered(f"s_{name}", gs[0], state)
        keyed: dict[str, tuple[str, Val]] = {}
        groups: dict[str, tuple[Column, list[Column]]] = {}
        for name, gs in arrays.items():
            if len({repr(g.target[2]) for g in gs}) > 1 or len({g.how for g in gs}) > 1 or (len(gs) > 1 and gs[0].how != "sum"):
                raise NotExact("one key and one way for an array")
            key = repr(gs[0].target[2])
            made = F.concat_ws(state.subsep, *[state.expr(a).text for a in gs[0].target[2]])
            cols = [aggregate(g) for g in gs]
            total = cols[0]
            for c in cols[1:]:
                total = F.coalesce(total, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))
            total = F.when(F.coalesce(*cols).isNotNull(), total)
            groups.setdefault(key, (made, []))[1].append(total.alias(f"a_{name}"))
            keyed[name] = (key, _gathered(f"a_{name}", gs[0], state))
        one = None if src is None else src.agg(*aggs)
        tables = {} if src is None else {k: src.groupBy(made.alias("__key")).agg(*cols) for k, (made, cols) in groups.items()}
        parts, number = [], 0
        end = self._state(variables, F.lit(""), None)
        end.given |= given
        for s in _flat(prog.end):
            number += 1
            if s[0] == "forin":
                _, var, array, body = s
                if array not in keyed:
                    raise NotExact("an array nothing is gathered in")
                key, _ = keyed[array]
                counted = _tally(body, var)
                if counted is not None:
                    name, value = counted
                    inner = self._inside(end, var, array, keyed, key)
                    total = F.sum(inner.expr(value).number)
                    if one is not None:
                        table = tables[key].where(F.col(f"a_{array}").isNotNull()).agg(total.alias("t"))
                        one = one.withColumn(f"t_{name}", table.scalar())
                    end.given[name] = num(F.col(f"t_{name}"))
                    continue
                inner = self._inside(end, var, array, keyed, key)
                inner.follow([body])
                if one is not None:
                    table = tables[key].where(F.col(f"a_{array}").isNotNull())
                    if any(t[0] == "var" and t[1] in end.given and t[1] != var for t in walk(body)):
                        table = table.withColumn("__one", one.select(F.struct("*")).scalar()).select("*", "__one.*")
                    parts.append(table.select(F.lit(number).alias("part"), inner.result().alias("text")).where("text is not null"))
                continue
            end.printed = []
            end.follow([s])
            if end.printed and one is not None:
                parts.append(one.select(F.lit(number).alias("part"), end.result().alias("text")).where("text is not null"))
        if rows is None:
            return None
        return self._after(rows, printed, parts or [rows.sparkSession.createDataFrame([], "part int, text string")])

    def _running(self, rows: DataFrame, ordered: int) -> DataFrame:
        prog, variables, printed = self._parts()
        names = adding(prog.main)
        sep = variables["FS"] if isinstance(variables["FS"], str) else str(variables["FS"])
        plain = self._state(variables, F.col("__record"), F.col("__fields"))
        state = lambda first: Running(plain.record, plain.fields, plain.fs, plain.ofs, plain.ors, plain.subsep, given=dict(plain.given), names=names, first=first)
        one, two = state(True), state(False)
        for walked in (one, two):
            walked.assigned = frozenset(t[2][1] if t[0] == "assign" else t[1][1] for t in walk(prog.main) if t[0] in ("assign", "incr") and (t[2] if t[0] == "assign" else t[1])[0] == "var") - set(names)
            walked.follow(prog.main)
        end = self._state(variables, F.lit(""), None)
        end.given |= {"NR": num(F.col("__nr"))} | {n: num(_total([F.col(f"__w{i}") for i, m in enumerate(names) if m == n], end.given[n].number if n in end.given else None)) for n in names}
        end.follow(prog.end)

        order = [f"__o{i}" for i in range(ordered)]
        values = [c.cast("double").alias(f"__a{i}") for i, c in enumerate(one.added)]
        split = rows.withColumn("__fields", split_record(F.col("__record"), sep))
        dealt = dealt_by_range(split.select("__record", *order, *values).withColumn("__a", F.lit(1)), order)
        n = range(len(values))
        start = starts(dealt, ["__a", *[f"__a{i}" for i in n]])
        by = Window.partitionBy("__range").orderBy(*order)
        here, past = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
        numbered = dealt.withColumn("__i", F.row_number().over(by))
        for i in n:
            numbered = numbered.withColumn(f"__h{i}", F.sum(f"__a{i}").over(here)).withColumn(f"__p{i}", F.sum(f"__a{i}").over(past))
        summed = numbered.join(F.broadcast(start), "__range")
        nr = (F.coalesce("__ab", F.lit(0)) + F.col("__i")).cast("double").alias("__nr")
        sums = [_total([F.col(f"__a{i}b"), F.col(f"__{c}{i}")], None).alias(f"__{d}{i}") for i in n for c, d in (("h", "w"), ("p", "x"))]
        summed = summed.select("__record", split_record(F.col("__record"), sep).alias("__fields"), nr, *sums)
        most = F.lit((1 << 31) - 1)
        parts = [summed.select(F.least(F.col("__nr"), most).cast("int").alias("part"), two.result().alias("text")).where("text is not null")]
        if end.printed:
            whole = dealt.agg(F.count(F.lit(1)).cast("double").alias("__nr"), *[F.sum(f"__a{i}").alias(f"__w{i}") for i in n])
            parts.append(whole.select(most.alias("part"), end.result().alias("text")).where("text is not null"))
        return self._after(rows, printed, parts)

    def _inside(self, end: State, var: str, array: str, keyed: dict, key: str) -> State:
        """The state of a loop over keys: the key, and the elements under that key."""

        def element(name, args):
            if args != [("var", var)] or name not in keyed or keyed[name][0] != key:
                raise NotExact("an element under another key")
            return keyed[name][1]

        return replace(end, given=end.given | {var: string(F.col("__key"))}, vars=dict(end.vars), arrays=dict(end.arrays), printed=[], element=element)

    def _sequential(self, df: DataFrame, record: str, order: list[str]) -> DataFrame:
        source = self.source
        rows = df.select(F.col(record).cast("string").alias("__record"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
        rows = rows.repartition(1).sortWithinPartitions(*[f"__o{i}" for i in range(len(order))])

        def run(batches):
            from .local import record as trimmed

            machine = Machine(source)

            def printed():
                machine.out = []
                machine._outside(machine.begin)
                yield from machine.out
                for b in batches:
                    for r in b.column(0).to_pylist():
                        machine.out = []
                        machine.load(trimmed(r or ""))
                        machine.nr += 1
                        machine._outside(machine.main)
                        yield from machine.out
                machine.out = []
                machine._outside(machine.end)
                yield from machine.out

            held: list[str] = []
            for i, line in enumerate(printed(), 1):
                held.append(line)
                if len(held) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(range(i - len(held) + 1, i + 1), pa.int32()), pa.array(held, pa.string())], names=["part", "text"])
                    held = []
                last = i
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(range(last - len(held) + 1, last + 1), pa.int32()), pa.array(held, pa.string())], names=["part", "text"])

        return rows.mapInArrow(run, "part int, text string")


def _gathered(column: str, g: Gather, state: State) -> Val:
    if g.how == "sum" or (g.how == "const" and g.value[0] == "num") or (g.how == "last" and state.expr(g.value).num):
        return num(F.col(column))
    return string(F.coalesce(F.col(column), F.lit("")))


def _prints(statements: list) -> bool:
    """Whether each record prints something."""
    for s in statements:
        if s[0] in ("print", "printf") or (s[0] == "block" and _prints(s[1])) or (s[0] == "if" and s[3] and _prints([s[2]]) and _prints([s[3]])):
            return True
        if any(t[0] == "next" for t in walk(s)):
            return False
    return False


def _flat(statements: list) -> list:
    out = []
    for s in statements:
        out += _flat(s[1]) if s[0] == "block" else [s]
    return out


def _tally(body: tuple, var: str) -> tuple[str, tuple] | None:
    """``n++`` or ``n += e`` as the only statement of a loop over keys."""
    while body[0] == "block" and len(body[1]) == 1:
        body = body[1][0]
    if body[0] != "expr":
        return None
    e = body[1]
    if e[0] == "incr" and e[1][0] == "var":
        return e[1][1], ("num", e[2])
    if e[0] == "assign" and e[1] == "+" and e[2][0] == "var":
        return e[2][1], e[3]
    return None


def records(source: str) -> RecordProgram:
    """A record program; its syntax is checked here."""
    parse(source)
    return RecordProgram(source)
