"""Queries of the catalogue against their SQL where texts are odd."""

import pytest

from loomtext.awk.values import split
from loomtext.catalogue import QUERIES, SQL

TEXTS = ["a b\nc d e\n", "", "x\x1cy z\n", "The end\nThe", "\n\n", ""]


def differing(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    return set(map(tuple, got)) ^ set(want.fetchall())


def test_separators_of_files_are_no_white_space():
    assert split(" a\x1cb\x85c\x1f ", " ") == ["a\x1cb", "c\x1f"]


def test_assign_over_empty_documents(spark, tmp_path):
    assert not differing(spark, tmp_path, "awk_assign")


def test_counts_over_empty_documents(spark, tmp_path):
    assert not differing(spark, tmp_path, "awk_documents")


def test_loops_over_empty_documents(spark, tmp_path):
    assert not differing(spark, tmp_path, "awk_loops")


def test_carried_sums_need_no_single_task(spark, tmp_path):
    assert not differing(spark, tmp_path, "awk_carried")
    plan = QUERIES["awk_carried"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan


CARRIED = [
    "n += NF END { print NR, n }", "if (NF > 2) { s -= $2; n++ } else next; s += 1 END { if (NR) printf \"%d %s|\", NR, s; print n, u }",
    "n += NF; print n END { print NR }", "last = $1; n++ END { print last, n }", "n++ END { print NF, $1 }", "BEGIN { n = 1 } n++ END { print n }", "c[$1]++; n++ END { print n, c[1] }", "n++ END { print n; n = 0 }",
]


@pytest.mark.parametrize("source", CARRIED)
def test_carried_as_in_one_run(spark, source):
    from loomtext import compile
    from loomtext.plans.local import run_document

    texts = ["", "1 2 3\n4\n", "", "x", "5 6 7\n" * 3, "\n", None] * 5
    program, machines = compile(r"x/.*\n?/ @{ " + source + " }"), {}
    want = [(i, "".join(run_document(program.nodes, t or "", machines)[0].printed)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, -i // 2, i, t) for i, t in enumerate(texts)], "doc_id int, a int, b int, text string").repartition(5)
    for run in (program.run(df, carry=("b",)).rendered, program.run(df, carry=("b",)).outputs.select("doc_id", "text")):
        assert sorted(map(tuple, run.collect())) == want


def test_conditions_are_worked_out_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, 26.0, "R", "F", 1)], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["awk_control"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 2  # one for white space, one for $3
    assert [r.text for r in out.collect()] == ["big 1\n"]


@pytest.mark.parametrize("source", ["{ if ($2 + 0 == 0) next; if (10 / $2 > 1) print $1; else if ($3) print \"c\"; else print }", "{ if ($1) { if ($2 > 5) print $2; else $2 = 7 } print $2 + 1, $0 }", "{ if (NF) { print $3; next } else print \"none\"; print \"more\" }"])
def test_local_conditions_agree_with_the_machine(spark, source):
    from loomtext.awk.run import Machine
    from loomtext.plans.records import records

    lines = ["a 0 1", "b 2 x", "", " c\t\u00a0 3  0 ", "d 20", "1e1 +6. .5", "0 1 1", "5x \u2003-6e1d Infinity", "nan 1f 0x1p3"]
    got = records(source).over(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert sorted("".join(r.text for r in got.collect()).splitlines()) == sorted(Machine(source).run(lines).splitlines())


def test_numbers_behind_any_white_space(spark):
    from loomtext.plans.records import records

    df = spark.createDataFrame([("\u00a05\u2003:x",), ("\x0b-3:y",)], "line string")
    assert {r.text for r in records("BEGIN { FS = \":\" } { print $1 + 1, $1 < 10 }").over(df, "line").collect()} == {"6 1\n", "-2 1\n"}


@pytest.mark.parametrize("flags", ["", "-", "0", "+", " ", "+0", "-0"])
def test_printf_of_columns_is_printf(flags):
    import pyarrow as pa

    from loomtext.awk.values import printf, printf_all

    numbers = [0.0, -0.0, 1.5, -2.5, 0.125, 0.375, 1e15, -5e17, 123456.789, 1e-9]
    for conv in "sdiouxXfFeE":
        values = ["", "é", "abcde"] if conv == "s" else numbers
        for size in ("", "12", ".", ".3", "12.0"):
            form = f"%%a%{flags}{size}{conv}|"
            assert printf_all(form, [pa.array(values)]) == [printf(form, [v]) for v in values], form
    assert printf_all("%d", [pa.array([float("nan")])]) is printf_all("%g", [pa.array([1.0])]) is printf_all("%d", []) is None


def test_printf_plan_agrees_with_the_machine(spark):
    from loomtext.awk.run import Machine
    from loomtext.plans.records import records

    lines = ["a 0 1", "", "b 1e400 -1e400", "c -7.9 2.675", "é 9223372036854775807 1e20", "d 3 0.125"]
    for source in ('{ printf "%-4s|%5d|%08.2f|%x|%u\\n", $1, $2, $3 / 8, $2, $3 }', '{ printf "%c%s %g %5.1e\\n", $1, $2 / 3, $3, $3 }', '{ f = NF ? "%s=%d\\n" : "%s\\n"; printf f, $1, $2 }'):
        got = records(source).over(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), "line")
        assert "".join(r.text for r in got.collect()) == Machine(source).run(lines)
