"""Fingerprints, codec, token counts and packing, against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import bpe, omh, packing, token_counts

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()
LIB = tokenizers.Tokenizer.from_file(PATH)
TEXTS = [
    None, "", "a", "hello world", "The quick brown fox's tail; it'll jump 123,456 times!\n\n  Twice  ", "x" * 5000, "été naïve 中文 テスト 🙂🙂 ½٣", "  \t\n ", "a<|endoftext|>b",
    "the cat sat on the mat " * 300, "hello world", "　wide space\r\n",
]
DOCS = "doc_id long, text string, b int, k string, decoded string"


def rows():
    return [(i * 7 % 23, t, i, "x", None) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


def test_signature():
    assert (omh.signature("abcdefgh" * 9) == omh.signature("abcdefgh" * 9)).all()
    base = np.random.default_rng(0).integers(97, 123, 3000).astype(np.uint8).tobytes().decode()
    slight, half = base[:1500] + "#" + base[1501:], base[:1500] + base[:1500][::-1]
    moved = base[1500:] + base[:1500]
    like = lambda s: omh.likeness(omh.signature(base), omh.signature(s))
    assert like(base) == 1 > like(slight) > 0.9 > like(half) > like(base[::-1]) == 0
    assert like(moved) < 0.75  # the same k-mers in another order
    assert omh.likeness(omh.signature(""), omh.signature(None)) == 1 and omh.likeness(omh.signature(""), omh.signature("a")) == 0
    assert (omh.from_text(omh.to_text(omh.signature(base))) == omh.signature(base)).all()


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 30, 60, 200])
def test_signature_is_the_order_of_minima(n):
    """The block search against sorting all keys for each permutation."""
    text = "".join(chr(97 + i * i % 7) for i in range(n))
    hs, pos = omh._numbered(omh._kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
    want = []
    for mask in omh._MASKS:
        best = sorted(range(len(hs)), key=lambda i: int(hs[i] ^ mask))[: omh.L]
        out = np.zeros(1, omh.U)
        for j, i in enumerate(sorted(best, key=lambda i: int(pos[i]))):
            out = omh.mix(out + hs[i] + omh.U(1), 20 + j)
        want.append(int(out[0] >> omh.U(32)))
    assert omh.signature(text).tolist() == want


def brute_edits(data, tied=None):
    tied = tied or {}
    """Rows of one id are in the order of the hash that the operator names, then of their texts."""
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), tied.get((r[0], r[1] or ""), 0), r[1] or ""))
    out = []
    for i, r in enumerate(order):
        t, n = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        s = omh.signature(t)
        out.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), omh.to_text(s), omh.to_text(omh.signature(edited)), omh.likeness(s, omh.signature(edited)), omh.likeness(s, omh.signature(n))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [2, 7])
def test_edit_report(spark, docs, parts):
    assert sorted(map(tuple, omh.edit_report(docs, parts=parts).collect()), key=str) == brute_edits(rows())


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_edit_report_of_hot_ids(spark, parts):
    """Half of the rows have one id and a quarter none, among very large and very small ids; no task gets most of them."""
    rng = np.random.default_rng(3)
    hot = 7 if parts < 23 else (1 << 61) + 7
    data = [(hot, f"seven {i % 90}") for i in range(200)] + [(None, f"none {i}") for i in range(100)] + [(int(x), f"text {x}") for x in rng.integers(-(1 << 63), 1 << 63, 90)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "greatest")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    tied = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "shiftrightunsigned(xxhash64(text), 1) h").collect() if r.doc_id in (hot, None)} if parts > 1 else {(r.doc_id, r.text): r.h for r in df.where("doc_id is null").selectExpr("doc_id", "text", "shiftrightunsigned(xxhash64(text), 1) h").collect()}
    out = omh.edit_report(df, parts=parts)
    assert sorted(map(tuple, out.collect()), key=str) == brute_edits(data, tied)
    if parts == 23:
        sizes = out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert max(sizes) < 60


@pytest.mark.parametrize("data", [[(5, "alone text", 0, "", "")], [(None, "n", 0, "", ""), (1, "b", 0, "", ""), (1, "a", 0, "", ""), (None, "m", 0, "", "")], []])
def test_edit_report_edges(spark, data):
    df = spark.createDataFrame(data, DOCS)
    assert sorted(map(tuple, omh.edit_report(df, parts=3).collect()), key=str) == brute_edits(data)


def test_fingerprint_columns(spark, docs):
    got = docs.withColumn("f", omh.fingerprint("text")).selectExpr("f").withColumn("l", omh.alike("f", "f")).collect()
    assert all(r.l == 1 for r in got if r.f)


def want_ids(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


def test_encode_and_decode(docs):
    got = bpe.encode(docs, PATH, decoded="decoded").collect()
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in got} == {(r[0], tuple(want_ids(r[1])), LIB.decode(want_ids(r[1]), skip_special_tokens=False)) for r in rows()}
    assert got[0].__fields__ == ["doc_id", "text", "b", "k", "ids", "decoded"]
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(r[0], r[1] or "") for r in rows()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert bpe.encode(none, PATH).count() == bpe.decode(bpe.encode(none, PATH), PATH).count() == packing.pack(none, PATH).count() == token_counts.count_sections(none, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("ab 'sltre\n\t1é", max_size=60))
def test_codec_is_the_library(text):
    c = bpe.codec(PATH)
    ids = c.encode(text).tolist()
    assert ids == want_ids(text) and packing.fast_ids(PATH)(text).tolist() == ids
    assert c.decode(np.array(ids)) == text.encode()


def test_stray_bytes_decode():
    ids = bpe.codec(PATH).encode("🙂")[:1]
    assert bpe.codec(PATH).decode(ids).decode("utf-8", "replace") == LIB.decode(ids.tolist(), skip_special_tokens=False)


def test_cut():
    for n in [1, 2, 3, 2047, 2048, 2049, 5000, 8192]:
        pieces = packing.cut(n)
        assert [s for s, _ in pieces] == list(np.cumsum([0, *(size for _, size in pieces)])[:-1]) and sum(size for _, size in pieces) == n
        assert all(size & (size - 1) == 0 and size <= 2048 for _, size in pieces)


def test_pack(docs, tmp_path):
    got = packing.pack(docs, PATH).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        raw = np.array(r.ids, "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(raw) and r.length == len(r.ids) and r.offset == 0
    assert len({r.sequence_id for r in got}) == len(got)
    for doc, text, *_ in rows():
        parts = sorted(by[doc], key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == [*want_ids(text), 1] and {r.doc_tokens for r in parts} == {len(want_ids(text)) + 1}
    packing.write_buckets(packing.pack(docs, PATH), str(tmp_path / "b"))
    assert (tmp_path / "b" / "length=1024").exists()


def test_spans_are_the_library():
    for t in filter(None, TEXTS):
        a, b = token_counts.spans(PATH, t)
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == LIB.encode(t, add_special_tokens=False).offsets


def brute_attribution(toks, secs, rule):
    out = [0.0] * len(secs)
    for a, b in toks:
        inside = [max(0, min(b, e) - max(a, s)) for s, e in secs]
        if rule == "first":
            for i, (s, e) in enumerate(secs):
                out[i] += s <= a < e
        elif rule == "share":
            for i, x in enumerate(inside):
                out[i] += x / (b - a)
        elif max(inside, default=0):
            out[inside.index(max(inside))] += 1
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    rng = np.random.default_rng(1)
    for _ in range(100):
        text = "".join(rng.choice(list("ab é🙂\n,the "), 40))
        a, b = token_counts.spans(PATH, text)
        cuts = np.sort(rng.choice(45, 6, replace=False))
        secs = [(int(cuts[i]), int(cuts[i + 1])) for i in (0, 2, 3, 4)]
        lo, hi = np.array([s for s, _ in secs]), np.array([e for _, e in secs])
        assert np.allclose(token_counts.attribute(a, b, lo, hi, rule), brute_attribution(list(zip(a, b, strict=True)), secs, rule))


def test_sections(spark, docs):
    got = token_counts.count_sections(docs, PATH).collect()
    for doc, text, *_ in rows():
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.section)
        assert sum(r.tokens for r in mine) == len(want_ids(text)) == mine[0].doc_tokens
        assert [(r.sec_start, r.sec_end) for r in mine] == [(0, 0)] if not text else mine[-1].sec_end == len(text)
    fields = token_counts.field_document(spark.createDataFrame([(1, "ab cd", None, "é x")], "doc_id long, title string, none string, body string"), ["title", "none", "body"])
    out = {r.name: r.tokens for r in token_counts.count_sections(fields, PATH, sections="sections", rule="share").collect()}
    assert out["none"] == 0 and out["title"] > 0 and out["body"] > 0
    own = spark.createDataFrame([(1, "abc", None), (2, "abc", [("x", 0, 2), ("y", None, 2), ("z", 2, 1)])], "doc_id long, text string, s array<struct<name:string,start:long,end:long>>")
    assert {(r.doc_id, r.name, r.tokens) for r in token_counts.count_sections(own, PATH, sections="s").collect()} == {(2, "x", 1.0), (2, "z", 0.0)}


def test_section_rules(docs):
    with pytest.raises(ValueError):
        token_counts.count_sections(docs, PATH, rule="half")
    with pytest.raises(ValueError):
        token_counts.attribute(np.array([0]), np.array([1]), np.array([0, 0]), np.array([2, 2]), "largest")


#: Texts that once ended in a crash: runs without any place to cut, a run of dotted labels, everything in one word.
LONG = [" " * 2_000_000, "a" + " \n\t" * 50_000 + "b", "ab" * 100_000, "." * 200_000, "x@" + "a." * 100_000, "!\x1c" * 50_000, "the cat sat on the mat. " * 50_000]


def test_long_texts(spark):
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(len(LONG))
    ids = {i: bpe.codec(PATH).encode(t) for i, t in enumerate(LONG)}
    for i, t in enumerate(LONG):
        assert bpe.codec(PATH).decode(ids[i]) == t.encode() and "".join(bpe.blocks(t)) == t
        if len(t) < 500_000:
            assert ids[i].tolist() == want_ids(t)
    packed = {r.doc_id: r.n for r in packing.pack(df, PATH, with_ids=False).groupBy("doc_id").agg({"doc_tokens": "max"}).toDF("doc_id", "n").collect()}
    assert packed == {i: len(x) + 1 for i, x in ids.items()}
    counted = token_counts.count_sections(df, PATH).groupBy("doc_id").sum("tokens").collect()
    assert {r[0]: r[1] for r in counted} == {i: len(x) for i, x in ids.items()}
    assert {r.doc_id: r.n for r in bpe.encode(df, PATH).selectExpr("doc_id", "size(ids) n").collect()} == {i: len(x) for i, x in ids.items()}
    assert omh.edit_report(df).count() == len(LONG)


def test_blocks_are_cut_where_no_pre_token_crosses():
    text = "It's  12 a\n\n b,c 'll  " * 40
    for size in (1, 3, 7, 50):
        parts = list(bpe.blocks(text, size))
        assert "".join(parts) == text and len(parts) > 1
        assert [i for p in parts for i in want_ids(p)] == want_ids(text)


def test_signature_of_more_k_mers_than_a_word_has_room_for(monkeypatch):
    text = "".join(chr(97 + i * i % 11) for i in range(5000)) + "ab" * 500
    want = omh.signature(text)
    monkeypatch.setattr(omh, "PACKED", 100)
    assert (omh.signature(text) == want).all()
