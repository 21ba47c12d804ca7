"""Token counts of sections by offset-mapped attribution: each document is encoded once, as a whole.

Token character spans come from the ids' byte lengths; sections are intervals of characters, joined with the spans.
A token that crosses a boundary is allocated by ``rule``:

* ``first``: to every section that holds its first character;
* ``largest``: to the section that holds most of its characters, the earlier one at a tie (sections must not overlap);
* ``share``: to each section by the share of its characters there.

A token that holds only part of a character spans that whole character.

Edge cases: null text counts as empty: one empty line section and no tokens; null or absent sections count as none;
sections beyond the text's end count what lies inside; a section whose end is not after its start counts nothing;
repeated rows give their sections again; an empty table gives no rows; columns besides the three that are named aren't
read. A very long text is one row and must fit its task, with some twenty bytes for each of its own; it is encoded block
by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec, pieces_of
from .packing import fast_ids

RULES = ("first", "largest", "share")
SECTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spans(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of a text."""
    ids = fast_ids(path)(text)
    sizes = _sizes(path)[ids]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return chars[starts + 1] - 1 if len(starts) else starts, chars[ends]


_SIZES: dict[str, np.ndarray] = {}


def _sizes(path: str) -> np.ndarray:
    if path not in _SIZES:
        _SIZES[path] = np.array([len(p) for p in codec(path).pieces], np.int64)
    return _SIZES[path]


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Line sections, each with its line feed; a text without one is a single section."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.flatnonzero(cp == 10) + 1
    if len(cuts) and cuts[-1] == len(cp):
        cuts = cuts[:-1]
    return np.concatenate(([0], cuts)).astype(np.int64), np.concatenate((cuts, [len(cp)])).astype(np.int64)


def attribute(tok_start: np.ndarray, tok_end: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section by one of the rules."""
    sec_end = np.maximum(sec_start, sec_end)
    if rule == "first":
        return (np.searchsorted(tok_start, sec_end, "left") - np.searchsorted(tok_start, sec_start, "left")).astype(float)
    if rule == "share":
        # Tokens that end by x, plus the part of each token that x cuts; parts of one character share its span.
        size = np.maximum(tok_end - tok_start, 1)
        last = int(tok_end[-1]) if len(tok_end) else 0
        weight = np.zeros(last + 2)
        np.add.at(weight, tok_start, 1 / size)
        np.add.at(weight, tok_end, -1 / size)
        upto = np.concatenate(([0.0], np.cumsum(np.cumsum(weight))))
        at = lambda x: upto[np.clip(x, 0, last)]
        return at(sec_end) - at(sec_start)
    if rule != "largest":
        raise ValueError(f"rule must be one of {RULES}")
    order = np.argsort(sec_start, kind="stable")
    s, e = sec_start[order], sec_end[order]
    if (s[1:] < e[:-1]).any():
        raise ValueError("the rule 'largest' needs sections that do not overlap")
    out = np.zeros(len(s))
    first = np.searchsorted(e, tok_start, "right")  # the first section that ends after the token's start
    until = np.searchsorted(s, tok_end, "left")
    one = until - first == 1
    np.add.at(out, first[one], 1)
    for t in np.flatnonzero(until - first > 1):
        j = np.arange(first[t], until[t])
        held = np.minimum(e[j], tok_end[t]) - np.maximum(s[j], tok_start[t])
        if held.max() > 0:
            out[j[int(np.argmax(held))]] += 1
    back = np.empty_like(out)
    back[order] = out
    return back


def count_sections(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "first") -> DataFrame:
    """One row per section: ``doc_id, section, name, sec_start, sec_end, tokens, doc_tokens``.

    ``sections`` names a column of (name, start, end) intervals; without it each line is a section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("section", T.LongType()), T.StructField("name", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("sec_start", "sec_end")]
        + [T.StructField("tokens", T.DoubleType()), T.StructField("doc_tokens", T.LongType())]
    )
    df = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.col(sections).cast(SECTIONS).alias("sections")] if sections else []))

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                parts: list[list] = [[] for _ in range(7)]
                listed = batch.column(2).to_pylist() if sections else [None] * batch.num_rows
                for doc, s, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), listed, strict=True):
                    a, b = spans(path, s or "")
                    if sections:
                        own = [x for x in own or [] if x and x["start"] is not None and x["end"] is not None]
                        names = [x["name"] for x in own]
                        lo, hi = (np.array([x[k] for x in own], np.int64) for k in ("start", "end"))
                    else:
                        lo, hi = lines(s or "")
                        names = [None] * len(lo)
                    n = len(lo)
                    for col, x in zip(parts, ([doc] * n, range(n), names, lo, hi, attribute(a, b, lo, hi, rule) if n else [], [len(a)] * n), strict=True):
                        col.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=schema.names)

    return df.mapInArrow(run, schema)


def field_document(df: DataFrame, fields: list[str], sep: str = "\n") -> DataFrame:
    """Join columns into one ``text`` with one section per field, so that tokens can be attributed to fields."""
    vals = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    out, at = [], F.lit(0)
    for f, v in zip(fields, vals, strict=True):
        out.append(F.struct(F.lit(f).alias("name"), at.cast("long").alias("start"), (at + F.length(v)).cast("long").alias("end")))
        at = at + F.length(v) + len(sep)
    return df.withColumn("sections", F.array(*out)).withColumn("text", F.concat_ws(sep, *vals))
