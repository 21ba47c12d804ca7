"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list; decoding by concatenation.

Interface: ``encode(df)`` adds ``ids`` (array<int>), ``decode(df)`` adds ``decoded`` (string). Any vocabulary file of
the tokenizers library with a byte-level BPE model can be named; its path is a parameter.

Edge cases: null text counts as empty (no ids, decodes to ""); the strings of added tokens are found as the library
finds them; repeated rows and ties are encoded alike; an empty table gives an empty table; columns besides the text
column pass through unchanged and an existing column of the output's name is replaced. A very long text is one row and
must fit its task, but is worked on in blocks of ``BLOCK`` characters, cut where no pre-token can cross; a single run
without such a place, such as millions of spaces, is one pre-token and takes time n log n.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import utf8

#: Pre-token results kept for each Python worker: entries, and the longest pre-token that is kept; some 100 MB at most.
CACHE, CACHED = 400_000, 32
#: Characters of a text that are split into pre-tokens at once.
BLOCK = 1 << 16
#: The published pre-tokenisation pattern of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: No pre-token goes on from something else into white space, and none looks back.
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in parts of ``size`` characters or a little more, whose pre-tokens are those of the whole."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        value = {c: b for b, c in enumerate(letters)}
        self.pieces = [b""] * (max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1)
        for s, i in vocab.items():
            self.pieces[i] = bytes(value[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.added.items():
            self.pieces[i] = s.encode()
        self.split_added = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True))) if self.added else None
        self.split_words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token. Merges run by (rank, position); an entry whose symbols changed meanwhile is skipped."""
        sym = [self.byte_ids[b] for b in text.encode()]
        n = len(sym)
        if n == 1:
            return (sym[0],)
        merges = self.merges
        queue = []
        for i in range(n - 1):
            m = merges.get(sym[i] << 32 | sym[i + 1])
            if m:
                queue.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, a, b, made = heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # stale
            sym[i], sym[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(made << 32 | sym[k])
                if m:
                    heappush(queue, (m[0], i, made, sym[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get(sym[h] << 32 | made)
                if m:
                    heappush(queue, (m[0], h, sym[h], made, m[1]))
        return tuple(s for s in sym if s >= 0)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a block without added tokens; each new pre-token is encoded once."""
        cache, word = self.cache, self.word
        found = self.split_words.findall(text)
        new = {w: word(w) for w in set(found).difference(cache)}
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = {w: word(w) for w in set(found)}
            cache.update((w, x) for w, x in new.items() if len(w) <= CACHED)
            parts = [new[w] if w in new else cache[w] for w in found]
        else:
            parts = map(cache.__getitem__, found)
        return np.fromiter(chain.from_iterable(parts), np.int32)

    def encode(self, text: str, ids: Callable[[str], np.ndarray] | None = None) -> np.ndarray:
        """Ids of a text, as int32; ``ids`` may be another way to encode a block."""
        ids = ids or self.ids
        parts, at = [], 0
        if self.split_added and any(s in text for s in self.added):
            for m in self.split_added.finditer(text):
                parts += map(ids, blocks(text[at : m.start()]))
                parts.append(np.array([self.added[m.group()]], np.int32))
                at = m.end()
        parts += map(ids, blocks(text[at:] if at else text))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The vocabulary strings of ids, concatenated."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def ids_array(ids: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offs[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32()))


def pieces_of(batch: pa.RecordBatch, col: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch with at most ``limit`` bytes of text (one row at least)."""
    from .arrowtext import slices

    _, offs = utf8(batch.column(batch.schema.get_field_index(col)))
    for a, b in slices(offs, limit):
        yield batch.slice(a, b - a)


def _with(df: DataFrame, out: dict[str, T.DataType], needs: str, fn) -> DataFrame:
    keep = [c for c in df.columns if c not in out]
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(k, v) for k, v in out.items()])

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, needs):
                cols = fn(batch.column(batch.schema.get_field_index(needs)))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + cols, names=keep + list(out))

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of ``text``; with ``decoded`` also what those ids decode to, in the same pass over the rows."""

    def run(col):
        c = codec(path)
        found = [c.encode(s or "") for s in col.to_pylist()]
        back = [pa.array([c.decode(x).decode("utf-8", "replace") for x in found], pa.string())] if decoded else []
        return [ids_array(found), *back]

    return _with(df, {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {}), text, run)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of an array of ids (null: empty); bytes that are not UTF-8 become U+FFFD."""
    keep = [c for c in df.columns if c != decoded]
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(decoded, T.StringType())])

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = b.column(b.schema.get_field_index(ids)).to_pylist()
            text = [c.decode(np.array(r or [], np.int32)).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keep] + [pa.array(text, pa.string())], names=[*keep, decoded])

    return df.mapInArrow(run, schema)
