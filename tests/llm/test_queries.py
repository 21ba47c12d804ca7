"""The registered queries over whole small tables: their columns, their rows, their SQL."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest

from loomtext.llm import bpe, omh, packing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")

#: Columns that the contracts name, in order.
COLUMNS = {
    "op1_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_nn_descent": "vec_id n_links component_id kept",
    "op10_jaccard_join": "doc_id n_shingles component_id",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_are_registered():
    import __spark_entry__ as e

    assert {int(k[2:].split("_")[0]) for k in e.queries() if k.startswith("op")} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns(spark, name):
    out = queries.queries()[name](spark, SF)
    if name in COLUMNS:
        assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).fetchdf()
    rows = lambda df: sorted(map(repr, zip(*[df[c].tolist() for c in sorted(df.columns)], strict=True)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_digests(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op2_bpe(spark, SF).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), sha(",".join(map(str, ids[r.doc_id]))), sha(texts[r.doc_id] or ""))
    seen: dict = {}
    for r in queries.op7_packing(spark, SF).collect():
        whole = np.array([*ids[r.doc_id], 1], "<u4")
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert all(sorted(v) == packing.cut(len(ids[d]) + 1) for d, v in seen.items()) and set(seen) == set(texts)


def test_edits(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries.op1_order_minhash(spark, SF).collect()}
    for i, d in enumerate(order):
        t, n = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_edited == omh.likeness(omh.signature(t), omh.signature(edited)) and got[d].fingerprint == omh.to_text(omh.signature(t))
