"""Sources, in-place writing, watching, and the queries against their SQL."""

import io
import os
from pathlib import Path

import pytest

from loomtext import catalogue, compile
from loomtext.sources import commit, corpus, print_outputs, read_binary, read_input, read_lines, read_texts, stage, write_back, write_outputs
from loomtext.streaming import poll, watch

SF = "/root/testdata/sf0.001"


def _folder(tmp_path) -> Path:
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.txt").write_bytes(b"one\ntwo\n")
    (at / "b.txt").write_bytes("drei\n".encode())
    (at / "c.bin").write_bytes(b"\xff\x00one")
    (at / "d.txt").write_bytes(b"")
    return at


def test_reading(spark, tmp_path):
    at = _folder(tmp_path)
    got = {Path(r.path).name: r for r in read_binary(spark, [f"{at}/*.txt", f"{at}/c.bin"]).collect()}
    assert bytes(got["a.txt"].content) == b"one\ntwo\n" and got["c.bin"].doc_ord == 1 and bytes(got["d.txt"].content) == b""
    files = read_binary(spark, str(at)).withColumnRenamed("content", "text")
    assert sorted(r.text for r in compile("x/one/ =").run(files).outputs.collect()) == ["0,3,3\n", "2,5,3\n"]


def test_in_place(spark, tmp_path):
    at = _folder(tmp_path)
    files = read_texts(spark, f"{at}/*.txt")
    out = compile("s/o/0/g").run(files).documents
    assert write_back(files, out, ".bak") == 1
    assert (at / "a.txt").read_text() == "0ne\ntw0\n" and (at / "a.txt.bak").read_text() == "one\ntwo\n"
    assert (at / "b.txt").read_text() == "drei\n" and not (at / "b.txt.bak").exists()


def test_in_place_keeps_modes_and_survives_retries(spark, tmp_path, monkeypatch):
    """A second step that stops midway and is repeated, and repeated again, edits each file once and backs up originals."""
    at = tmp_path / "in"
    at.mkdir()
    for i in range(6):
        (at / f"{i}.txt").write_text(f"a{i} a\n")
        (at / f"{i}.txt").chmod(0o640 if i % 2 else 0o755)
    files = read_texts(spark, f"{at}/*.txt")
    manifest = str(tmp_path / "edits")
    stage(files, compile("s/a/aa/").run(files).documents, manifest)
    assert (at / "0.txt").read_text() == "a0 a\n"
    rows = spark.read.parquet(manifest).collect()
    corpus._swapped(rows[0].name, rows[0].fresh, rows[0].digest, ".bak")  # as a task that was lost then
    os.link(rows[1].name, rows[1].name + ".bak")
    for _ in range(2):
        assert commit(spark, manifest, ".bak") == 6
        for i in range(6):
            assert (at / f"{i}.txt").read_text() == f"aa{i} a\n" and (at / f"{i}.txt.bak").read_text() == f"a{i} a\n"
            assert (at / f"{i}.txt").stat().st_mode & 0o777 == (0o640 if i % 2 else 0o755)
    assert sorted(p.name for p in at.iterdir()) == sorted(f"{i}.txt{e}" for i in range(6) for e in ("", ".bak"))
    # Another attempt that read the table before: the file is the edited one now, and isn't taken for the original.
    (at / "again").write_text("aaa0 a\n")
    corpus._swapped(rows[0].name, str(at / "again"), rows[0].digest, ".bak")
    assert (at / "0.txt.bak").read_text() == "a0 a\n"
    with pytest.raises(ValueError, match="mounted"):
        corpus._local("s3://bucket/x")


def test_order_of_files(spark, tmp_path):
    at = _folder(tmp_path)
    files = read_texts(spark, [f"{at}/b.txt", f"{at}/a.txt"])
    out, shown = compile("/e/").run(files).outputs, io.StringIO()
    print_outputs(out, files, shown)
    assert shown.getvalue() == "drei\none\n"
    write_outputs(out, files, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "drei\none\n"


def test_standard_input_and_lines(spark, tmp_path):
    for data in (b"one\xff\ntwo", io.BytesIO(b"one\xff\ntwo")):
        doc = read_input(spark, data).withColumnRenamed("content", "text")
        assert [r.text for r in compile("x/two/ =", n=True, E=True).run(doc).outputs.collect()] == ["5,8,3\n"]
    at = _folder(tmp_path)
    assert sorted(r.line for r in read_lines(spark, f"{at}/*.txt").collect()) == ["drei", "one", "two"]


def test_watch(spark, tmp_path):
    at, seen = _folder(tmp_path), []
    query = watch(spark, compile("/one/"), str(at), lambda run, n: seen.extend(r.text for r in run.outputs.collect()), str(tmp_path / "state"), once=True)
    query.awaitTermination(60)
    assert "one\n" in seen


def test_poll(spark, tmp_path):
    at = _folder(tmp_path)
    looks = poll(spark, compile("/e/"), f"{at}/*.txt", every=0, rounds=3)
    assert next(looks).outputs.count() == 2
    (at / "b.txt").write_text("e\ne\n")
    os.utime(at / "b.txt", (1, 1))
    assert next(looks).outputs.count() == 2
    assert list(looks) == []


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_match_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, zip(*[df[c].tolist() for c in sorted(df.columns)], strict=True)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
