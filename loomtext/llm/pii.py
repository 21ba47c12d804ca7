"""Format-preserving pseudonyms of personal numbers and dates, by keyed Feistel permutations; SQL functions only.

Each kind is found by pattern, validated, mapped to a pair (x, y) in Z_a x Z_b that enumerates exactly its valid values,
permuted there, and mapped back. x and y take turns in being shifted by a keyed hash of the other, which is a bijection
for any a and b; so equal values get equal pseudonyms in all documents, different ones stay different, and a pseudonym
is again valid (Luhn digits, calendar dates, octets, area codes). No table of values is kept and nothing is shuffled.

| kind | validation | what is permuted |
|-|-|-|
| card | 13 to 19 digits, Luhn | all digits but the first; the check digit is made anew |
| phone | ten digits as area, exchange and line, with or without 1 | area, exchange and line; in the North American plan (area and exchange from 200 on) and outside it, each within itself |
| ssn | area 001-899 but 666, group and serial not zero | area, group and serial |
| date | a day of the calendar from 1800 to 2199: Y-M-D, D-M-Y or M-D-Y with - / or ., or an English month's name | the day, within these 400 years |
| iban | two letters, check digits, 11 to 30 more; remainder 1 modulo 97 (others with more letters, all hexadecimal, are secrets) | letters and digits of the account, each within its class; the check digits are made anew |
| ip | four octets | all 32 bits |
| email | local part of up to 64 characters | letters and digits of the local part, each within its class |
| secret | access keys and hexadecimal strings from 16 digits on | letters and digits but a key's prefix, each within its class |

Edge cases: null text stays null and empty text empty; values that fail validation stay and aren't listed as found;
separators, case and all other text stay; columns besides the text pass through, names of our own columns may clash as
they are replaced; repeated rows get the same pseudonyms; an empty table gives an empty table. A very long text is one
row and must fit its task; no pattern recurses or goes back over a run of any length, so it takes linear time and a
bounded stack.

The key reaches the plan as a literal made from it by SHA-256. ``REDACT`` is set as the session's
``spark.sql.redaction.string.regex`` where that is unset, so plans and event logs don't show it.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
MARK = "loomtext-key-"
#: What shows the key in a plan.
REDACT = MARK + "[0-9a-f]{64}"
#: Patterns of the kinds, in order of precedence.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A word that an account number's pattern takes in though it is a hexadecimal string.
HEX = r"(?<![^ ])(?=[0-9]*[A-F][A-F0-9]*[0-9][0-9]*[A-F])[0-9A-F]{16,}(?![^ ])"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
    "day": rf"(?<![0-9A-Za-z])(?:[0-9]{{1,2}} (?:{MONTHS}),? [0-9]{{4}}|(?:{MONTHS}) [0-9]{{1,2}},? [0-9]{{4}})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{16,128})(?![0-9A-Za-z])",
}


def _number(c: Column) -> Column:
    return c.cast("long")


def _round(key: str, kind: str, i: Column, other: Column) -> Column:
    """60 bits of a keyed hash."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a, b, key: str, kind: str, undo: bool = False) -> Column:
    """The permuted pair as struct<x, y>; ``undo`` inverts it."""
    a, b = (c if isinstance(c, Column) else F.lit(c) for c in (a, b))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        hx, hy = _round(key, kind, i, s["y"]) % a, _round(key, kind, i, s["x"]) % b
        if undo:
            hx, hy = a - hx, b - hy
        return F.struct(F.when(even, (s["x"] + hx) % a).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise((s["y"] + hy) % b).alias("y"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _with(pair: Column, make) -> Column:
    """Apply ``make`` to a value that is used several times, evaluating it once."""
    return F.transform(F.array(pair), make)[0]


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _pad(c: Column, n) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """Put ``digits`` in the places of the digits of ``shape``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    out = F.aggregate(
        chars,
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["s"], F.substr(digits, s["i"], F.lit(1))).alias("s"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i"))),
    )
    return out["s"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string, doubling every second digit from the last or the one before."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((i % 2 == 0) == F.lit(double_last), F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda s, d: s + d)


def _card(v: Column, key: str) -> Column:
    def make(d: Column) -> Column:
        n = F.length(d) - 2  # without the first and the check digit
        u = F.floor(n / 2).cast("int")
        x, y = _number(F.substr(d, F.lit(2), u)), _number(F.substr(d, u + 2, n - u))
        moved = _with(feistel(x, y, _pow10(u), _pow10(n - u), key, "card"), lambda p: F.concat(F.substr(d, F.lit(1), F.lit(1)), _pad(p["x"], u), _pad(p["y"], n - u)))
        whole = _with(moved, lambda m: F.concat(m, ((F.lit(10) - _luhn_sum(m, True) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(d, False) % 10 == 0, _refill(v, whole))

    return _with(_digits(v), make)


def _phone(v: Column, key: str) -> Column:
    def make(d: Column) -> Column:
        d10 = F.substr(d, F.length(d) - 9, F.lit(10))
        area, exch, line = (_number(F.substring(d10, s, n)) for s, n in ((1, 3), (4, 3), (7, 4)))
        value = ((area - 200) * 800 + exch - 200) * 10000 + line
        moved = _with(feistel(F.floor(value / 80000), value % 80000, 80000, 80000, key, "phone"), lambda p: p["x"] * 80000 + p["y"])
        back = _with(moved, lambda z: F.concat((F.floor(z / 8000000) + 200).cast("string"), (F.floor(z / 10000) % 800 + 200).cast("string"), _pad(z % 10000, 4)))
        # Outside the plan: 200 areas with 1000 exchanges, 800 with 200; with lines these are 60000 * 60000.
        other = F.when(area < 200, area * 1000 + exch).otherwise(200000 + (area - 200) * 200 + exch) * 10000 + line
        shifted = _with(feistel(F.floor(other / 60000), other % 60000, 60000, 60000, key, "phone outside"), lambda p: p["x"] * 60000 + p["y"])

        def write(z: Column) -> Column:
            n = F.floor(z / 10000)
            return F.concat(F.when(n < 200000, _pad(n, 6)).otherwise(F.concat((F.floor((n - 200000) / 200) + 200).cast("string"), _pad(n % 200, 3))), _pad(z % 10000, 4))

        moved10 = F.when((area >= 200) & (exch >= 200), back).otherwise(_with(shifted, write))
        return _refill(v, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), moved10))

    return _with(_digits(v), make)


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (_number(F.substring(v, s, n)) for s, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1

    def make(p: Column) -> Column:
        a = F.floor(p["x"] / 99) + 1
        return F.concat_ws("-", _pad(F.when(a >= 666, a + 1).otherwise(a), 3), _pad(p["x"] % 99 + 1, 2), _pad(p["y"] + 1, 4))

    return F.when(ok, _with(feistel(x, serial - 1, 898 * 99, 9999, key, "ssn"), make))


def _moved_day(d: Column, key: str) -> Column:
    """The 400 years from 1800 have 146097 = 189 * 773 days."""
    first = F.lit("1800-01-01").cast("date")
    n = F.datediff(d, first)
    return _with(feistel(F.floor(n / 773), n % 773, 189, 773, key, "date"), lambda p: F.date_add(first, (p["x"] * 773 + p["y"]).cast("int")))


def _to_date(s: Column, form: str) -> Column:
    return F.try_to_timestamp(s, F.lit(form)).cast("date")


def _known(d: Column) -> Column:
    return d.isNotNull() & F.year(d).between(1800, 2199)


def _date(v: Column, key: str) -> Column:
    """Numeric dates; month and day come in either order where only one is a date. Parts keep their padding."""

    def make(a: Column) -> Column:
        iso = lambda y, m, d: _to_date(F.concat_ws("-", a[y], F.lpad(a[m], 2, "0"), F.lpad(a[d], 2, "0")), "yyyy-MM-dd")
        year_first = F.length(a[0]) == 4
        dmy = iso(2, 1, 0)
        day = F.when(year_first, iso(0, 1, 2)).otherwise(F.coalesce(dmy, iso(2, 0, 1)))

        def write(z: Column) -> Column:
            part = lambda at, c: F.when(F.length(a[at]) == 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
            sep = F.when(year_first, F.substring(v, 5, 1)).otherwise(F.substr(v, F.length(a[0]) + 1, F.lit(1)))
            ymd = (F.year(z).cast("string"), part(1, F.month(z)), part(2, F.dayofmonth(z)))
            ends = F.when(dmy.isNotNull(), F.concat(part(0, F.dayofmonth(z)), sep, part(1, F.month(z)))).otherwise(F.concat(part(0, F.month(z)), sep, part(1, F.dayofmonth(z))))
            return F.when(year_first, F.concat(ymd[0], sep, ymd[1], sep, ymd[2])).otherwise(F.concat(ends, sep, F.year(z).cast("string")))

        return _with(day, lambda d: F.when(_known(d), _with(_moved_day(d, key), write)))

    return _with(F.split(v, "[-/.]"), make)


def _day(v: Column, key: str) -> Column:
    """Dates with an English month's name, full or of three letters."""
    comma, first = v.contains(","), v.rlike("^[0-9]")
    name = F.regexp_extract(v, "[A-Za-z]+", 0)
    rest = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    day = _to_date(F.concat_ws(" ", F.initcap(F.substring(name, 1, 3)), F.get(rest, F.lit(0)), F.get(rest, F.lit(1))), "MMM d yyyy")

    def write(z: Column) -> Column:
        month = F.when(F.length(name) == 3, F.date_format(z, "MMM")).otherwise(F.date_format(z, "MMMM"))
        number = F.dayofmonth(z).cast("string")
        number = F.when(F.length(F.get(rest, F.lit(0))) == 2, F.lpad(number, 2, "0")).otherwise(number)
        return F.concat(F.when(first, F.concat_ws(" ", number, month)).otherwise(F.concat_ws(" ", month, number)), F.when(comma, ", ").otherwise(" "), F.year(z).cast("string"))

    return _with(day, lambda d: F.when(_known(d), _with(_moved_day(d, key), write)))


def _mod97(s: Column) -> Column:
    """Remainder of letters (A is 10) and digits read as one number."""
    digits = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(digits, F.lit(0), lambda r, d: (r * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _iban(v: Column, key: str) -> Column:
    def make(s: Column) -> Column:
        land, account = F.substring(s, 1, 2), F.substring(s, 5, 40)

        def write(b: Column) -> Column:
            whole = F.concat(land, F.lpad((F.lit(98) - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b)
            return _with(whole, lambda w: _spaced(v, w))

        return _with(_letters(account, key, "iban"), write)

    return _with(_compact(v), make)


def _compact(v: Column) -> Column:
    return F.replace(v, F.lit(" "), F.lit(""))


def _is_iban(s: Column) -> Column:
    return F.length(s).between(15, 34) & (_mod97(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))) == 1)


def _spaced(shape: Column, text: Column) -> Column:
    """``text`` with spaces where ``shape`` has them."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(
        chars, start, lambda s, c: F.when(c == " ", F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i"))).otherwise(F.struct(F.concat(s["s"], F.substr(text, s["i"], F.lit(1))).alias("s"), (s["i"] + 1).alias("i")))
    )["s"]


def _ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda c: c.cast("long"))

    def make(a: Column) -> Column:
        return _with(
            feistel(a[0] * 256 + a[1], a[2] * 256 + a[3], 65536, 65536, key, "ip"),
            lambda p: F.concat_ws(".", *[c.cast("string") for c in (F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256)]),
        )

    return _with(o, make)


def _letters(s: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Permute letters and digits, each within its class, by a Feistel over the two halves of a string."""
    classes = [("0", 10), ("a", 6 if hexadecimal else 26), ("A", 6 if hexadecimal else 26)]

    def shift(half: Column, other: Column, i: Column) -> Column:
        stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.lit(j), other), 256) for j in "ab"])

        def move(c: Column, at: Column) -> Column:
            b = F.conv(F.substr(stream, (at % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for low, size in classes:
                base = ord(low)
                out = F.when((F.ascii(c) >= base) & (F.ascii(c) < base + size), F.chr((F.ascii(c) - base + b) % size + base)).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), move), "")

    def step(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shift(p["x"], p["y"], i)).otherwise(p["x"]).alias("x"), F.when(even, p["y"]).otherwise(shift(p["y"], p["x"], i)).alias("y"))

    half = F.floor((F.length(s) + 1) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("x"), F.substr(s, half + 1, F.length(s)).alias("y"))
    return _with(F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step), lambda p: F.concat(p["x"], p["y"]))


def _email(v: Column, key: str) -> Column:
    return F.concat(_letters(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


def _secret(v: Column, key: str) -> Column:
    return F.when(v.startswith("AKIA"), F.concat(F.lit("AKIA"), _letters(F.substring(v, 5, 1000), key, "key"))).otherwise(_letters(v, key, "hex", True))


def _words(v: Column, key: str) -> Column:
    """What an account number's pattern found, but whose words are hexadecimal strings."""
    return F.array_join(F.transform(F.split(v, " "), lambda w: F.when(w.rlike(HEX), _secret(w, key)).otherwise(w)), " ")


MAKERS = {"email": _email, "ip": _ip, "date": _date, "day": _day, "iban": _iban, "phone": _phone, "ssn": _ssn, "card": _card, "secret": _secret, "words": _words}


def kind_of(v: Column) -> Column:
    """The kind of a found value; patterns are tried in their order of precedence."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        name = F.when(_is_iban(_compact(v)), kind).when(v.rlike(HEX), "words") if kind == "iban" else F.lit(kind)
        out = F.when(v.rlike(f"^(?:{KINDS[kind]})$"), name).otherwise(out)
    return out


def pseudonym(v: Column, key: str) -> Column:
    """struct<kind, value, pseudonym> of a found value; the pseudonym is null where the value isn't valid."""

    def made(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, make in MAKERS.items():
            new = F.when(kind == name, make(v, key)).otherwise(new)
        return F.struct(F.when(kind == "words", "secret").otherwise(kind).alias("kind"), v.alias("value"), new.alias("pseudonym"))

    return _with(kind_of(v), made)


def pseudonymize(df: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """Replace ``text``; with ``found`` add array<struct<kind, value, pseudonym>> of the valid values in order of occurrence."""
    cols = df.columns
    conf = df.sparkSession.conf
    if not conf.get("spark.sql.redaction.string.regex", None):
        conf.set("spark.sql.redaction.string.regex", REDACT)
    secret = MARK + hashlib.sha256(key.encode()).hexdigest()
    mark = "__pii"
    while any(c.startswith(mark) for c in cols):
        mark += "_"
    # Texts without any digit or at-sign hold none of the kinds.
    values = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(_any()), F.lit(0)))
    old, fresh = f"{mark}_values", f"{mark}_new"
    out = df.withColumn(old, values)
    out = out.withColumn(fresh, F.transform(old, lambda v: pseudonym(v, secret)))
    gaps = F.split(F.col(text), _any(), -1)
    made = F.array_join(F.zip_with(gaps, F.col(fresh), lambda a, b: F.concat(a, F.coalesce(b["pseudonym"], b["value"], F.lit("")))), "")
    new = F.when(F.size(fresh) > 0, made).otherwise(F.col(text))
    names = [new.alias(text) if c == text else F.col(c) for c in cols if c != found]
    if found:
        names.append(F.coalesce(F.filter(fresh, lambda x: x["pseudonym"].isNotNull()), F.array()).alias(found))
    return out.select(*names)


def _any() -> str:
    """All kinds as one pattern; back-references are counted on."""
    out, groups = [], 0
    for p in KINDS.values():
        out.append(re.sub(r"\\([12])", lambda m, g=groups: f"\\{int(m[1]) + g}", p))
        groups += re.compile(p).groups
    return "|".join(out)
