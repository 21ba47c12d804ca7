"""Values are floats and strings; conversions, comparison, field splitting and printf."""

from __future__ import annotations

import math
import re


class AwkError(RuntimeError):
    """A program that fails while it runs."""


_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", re.A)


def number(v: float | str) -> float:
    """The longest numeric prefix, else 0."""
    if isinstance(v, float):
        return v
    m = _NUMBER.match(v.lstrip())
    return float(m[1]) if m else 0.0


def wholly(v: float | str) -> float | None:
    """The number if all of a value is one."""
    if isinstance(v, float):
        return v
    s = v.strip()
    m = _NUMBER.fullmatch(s)
    return float(m[1]) if m else None


def text(v: float | str) -> str:
    if isinstance(v, str):
        return v
    if math.isnan(v):
        return "nan"
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    if v == int(v) and abs(v) < 1e16:
        return str(int(v))
    return f"{v:.6f}".rstrip("0").rstrip(".")


def true(v: float | str) -> bool:
    n = wholly(v)
    return n != 0 if n is not None else v != ""


def compare(a: float | str, b: float | str) -> int:
    """-1, 0 or 1; as numbers if both are."""
    x, y = wholly(a), wholly(b)
    if x is not None and y is not None:
        return (x > y) - (x < y)
    s, t = text(a), text(b)
    return (s > t) - (s < t)


#: Python takes these for white space, Unicode doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORD = re.compile(r"[\S\x1c-\x1f]+")


def _words(s: str) -> list[str]:
    """The stretches between runs of Unicode's white space."""
    return _WORD.findall(s) if _SEPARATORS.search(s) else s.split()


def split(s: str, sep: str) -> list[str]:
    if s == "":
        return []
    if sep == " ":
        return _words(s)
    return list(s) if sep == "" else s.split(sep)


_SPEC = re.compile(r"%(?:(?P<percent>%)|(?P<flags>[-+ 0#]*)(?P<width>\d*)(?:\.(?P<prec>\d*))?(?P<conv>.)?)", re.S)


def printf(form: str, args: list) -> str:
    rest = iter(args)

    def one(m: re.Match) -> str:
        if m["percent"]:
            return "%"
        conv, flags, width = m["conv"], m["flags"], int(m["width"] or 0)
        if conv is None:
            raise AwkError("the format ends within a conversion")
        prec = None if m["prec"] is None else int(m["prec"] or 0)
        if conv not in "diouxXcsfFeEgG":
            raise AwkError(f"the format has no conversion %{conv}")
        try:
            v = next(rest)
        except StopIteration:
            raise AwkError("the format asks for more values than there are") from None
        sign, numeric = "", conv not in "cs"
        if conv == "s":
            body = text(v) if prec is None else text(v)[:prec]
        elif conv == "c":
            body = v[:1] if isinstance(v, str) else _char(v)
        elif conv in "di":
            n = _whole(number(v))
            sign, body = _sign(n < 0, flags), str(abs(n)).rjust(prec or 0, "0")
        elif conv in "ouxX":
            n = _whole(number(v)) & 0xFFFFFFFFFFFFFFFF
            body = format(n, {"u": "d"}.get(conv, conv)).rjust(prec or 0, "0")
            if "#" in flags and n:
                body = {"x": "0x", "X": "0X", "o": "0"}.get(conv, "") + body
        else:
            x = number(v)
            sign, body = _sign(math.copysign(1, x) < 0, flags), _float(abs(x), conv, 6 if prec is None else prec, "#" in flags)
        fill = width - len(sign) - len(body)
        if fill <= 0:
            return sign + body
        if "-" in flags:
            return sign + body + " " * fill
        if "0" in flags and numeric and prec is None:
            return sign + "0" * fill + body
        return " " * fill + sign + body

    return _SPEC.sub(one, form)


def conversions(form: str) -> list[str]:
    """The letter of each conversion that takes a value ("" if there is none)."""
    return [m["conv"] or "" for m in _SPEC.finditer(form) if not m["percent"]]


def printf_all(form: str, columns) -> list[str] | None:
    """``printf`` over Arrow columns by Python's own operator; None where that isn't sure to print the same."""
    specs = [m for m in _SPEC.finditer(form) if not m["percent"]]
    if not specs or len(columns) < len(specs):
        return None
    values = []
    for m, c in zip(specs, columns, strict=False):
        conv, texts = m["conv"], not str(c.type) == "double"
        if not conv or conv not in "sdiouxXfFeE" or "#" in m["flags"] or c.null_count or texts != (conv == "s"):
            return None
        if texts:
            values.append(c.to_pylist())
            continue
        x = c.to_numpy(zero_copy_only=False)
        if not (abs(x) < 9e18).all():  # neither NaN
            return None
        if conv in "fFeE":
            values.append(x.tolist())
        else:
            n = x.astype("int64")
            values.append((n if conv in "di" else n.astype("uint64")).tolist())

    def spec(m: re.Match) -> str:
        if m["percent"]:
            return "%%"
        flags, prec = m["flags"], m["prec"]
        if prec is not None or m["conv"] == "s":
            flags = flags.replace("0", "")
        if m["conv"] in "ouxXs":
            flags = flags.replace("+", "").replace(" ", "")
        return f"%{flags}{m['width']}{'' if prec is None else '.' + (prec or '0')}{m['conv']}"

    own = _SPEC.sub(spec, form)
    return [own % row for row in zip(*values, strict=True)]


def _whole(x: float) -> int:
    if math.isnan(x):
        return 0
    return max(-(1 << 63), min((1 << 63) - 1, int(x))) if math.isfinite(x) else ((1 << 63) - 1 if x > 0 else -(1 << 63))


def _sign(negative: bool, flags: str) -> str:
    return "-" if negative else "+" if "+" in flags else " " if " " in flags else ""


def _char(x: float) -> str:
    n = _whole(x)
    return chr(n) if 0 <= n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else "�"


def _float(x: float, conv: str, prec: int, alternate: bool) -> str:
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf"
    if conv in "fF":
        return f"{x:.{prec}f}"
    if conv in "eE":
        return f"{x:.{prec}{conv}}"
    prec = max(prec, 1)
    exp = math.floor(math.log10(x)) if x else 0
    if -4 <= exp < prec:
        out, tail = f"{x:.{max(prec - 1 - exp, 0)}f}", ""
    else:
        out, mark, tail = f"{x:.{prec - 1}{'E' if conv == 'G' else 'e'}}".partition("E" if conv == "G" else "e")
        tail = mark + tail
    if not alternate and "." in out:
        out = out.rstrip("0").rstrip(".")
    return out + tail
