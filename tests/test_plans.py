"""Expressions against the local plan, and the shape of the plans."""

import pytest

from loomtext import compile
from loomtext.functions import collapse, concept, fuzzy, replace
from loomtext.operators.edit import NotExact

TEXTS = ["", "a\n", "the cat\nThe dog sat\n\nthen", "ünï the thé\nfoo the\n", "a,b,,c\n12 34", "x\r\ny", "\n\n", "aXbXc the the the", None, "\u2028 the\tb", "({[the]})"]
PROGRAMS = [
    r"x/.*\n?/ g/the/ p", r"x/.*\n/ v/the/ p", "/the/", "x/[a-z]+/ p", r"x/\w+/ p", "y/the/ p", "y/[ ,\n]+/ p", "x/a*/ p", "g/^$/ p", "x/$/ p", r"x/.*\n?/ g/T/i p", r"x/.*\n?/ { x/[a-z]+/ r/-/ } p",
    r"x/.*\n?/ :sem:/time/ p", "m/[a-z]+/ { g/t/ p }", r"x/[^\n]+/ x/./ p", "x/the/ r/+/ p", "x/a.b/s p", r"x/.*\n?/ /the/ { p }",
]
PROGRAMS += [r"x/.*\n?/ g/the/ v/cat/ p", r"x/.*\n/ p", r"x/.*\n?/ p", r"x/.*\n?/s p", r"x/.*\n?/ v/the\n/ p", r"x/.*\n/ g/a/ { p }", r"x/.*\n?/i g/a/ p", r"x/.*\n?/ x/.*\n?/ p"]
PLACED = [
    "x/the/ =", r"x/.*\n?/ N p", r"x/.*\n?/ N =", "y/the/ =", r"x/[^\n]+/ x/[a-z]+/ =", r"x/.*\n?/ g/the/ { x/[a-z]+/ N = }", "x/[a-zé]+/ ~1/the/ =", "x/[a-z]+/ ~1/teh/ p", r"x/.*\n?/ ~2/doggy/ p", "~1/ünö/ p", "~9/the/ p", "x/b/ =",
    r"x/.*\n?/ { y/ / = }", "=", "N =", "z/[ ,]+/ N N =", "~1/thé/ =", r"x/\w+/ ~1/sat/ N p",
]
EDITS = [
    "s/the/X/g", "s/the/X/", "s/the/X/2", "s/the/X/g2", "s/([a-z])([a-z])/$2$1/g", "s/([a-z])([a-z])/<$2>/", "s/x*/-/g", "s/^/> /g", "s/$/!/g", "s/THE/[&]/gi", "x/[a-z]+/ c/w/", "y/the/ c/w/",
    r"x/.*\n?/ { g/the/ c// }", r"x/.*\n?/ v/the/ s/a/b/", "/the/ { s/e/E/ }", r"x/.*\n?/ s/[a-z]/_/2", "g/the/ s/a/\\$1&/g",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").cache()


@pytest.mark.parametrize("program", PROGRAMS)
def test_prints(docs, program):
    run = compile(program).run
    assert sorted(run(docs, tier="expressions").outputs.collect()) == sorted(run(docs, tier="local").outputs.collect())


@pytest.mark.parametrize("program", PLACED)
def test_places(docs, program):
    run = compile(program).run
    assert sorted(run(docs, tier="expressions").outputs.collect()) == sorted(run(docs, tier="local").outputs.collect())
    assert sorted(run(docs, tier="expressions").views.collect(), key=str) == sorted(run(docs, tier="local").views.collect(), key=str)


def test_places_of_many_views(spark):
    """More views than a block of running sums, and texts of several stretches."""
    words = ["the", "é", "teh", "thhe", "x" * 300, "a\n", "🙂"]
    texts = [" ".join(words[(i * j) % 7] for j in range(1, 900)) for i in range(1, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for program in (r"x/[^ ]+/ =", r"x/[^ ]+/ N =", "y/t/ =", "x/the/ =", r"x/[^ ]+/ ~1/the/ ="):
        run = compile(program).run
        assert sorted(run(df, tier="expressions").outputs.collect()) == sorted(run(df, tier="local").outputs.collect())
    from loomtext.plans.local import near

    got = df.select("doc_id", *[fuzzy("text", lit, k).alias(f"f{i}") for i, (lit, k) in enumerate(NEAR)]).collect()
    for r in got:
        assert [r[f"f{i}"] for i in range(len(NEAR))] == [near(texts[r.doc_id], lit, k) for lit, k in NEAR]


NEAR = [("the", 0), ("thxhe", 1), ("tehe thhe", 2), ("🙃", 1), ("xxx 🙂a", 2), ("qqqqq", 2), ("é t", 1), ("x" * 40 + "y", 1), ("the" * 5, 3)]


def test_places_without_python(docs):
    for program in PLACED:
        plan = compile(program).run(docs, tier="expressions").outputs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("program", EDITS)
def test_edits(docs, program):
    run = compile(program).run
    assert sorted(run(docs, tier="expressions").documents.collect()) == sorted(run(docs, tier="local").documents.collect())


def test_no_shuffle_no_python(docs):
    plan = compile("/the/ { s/a/b/g }").run(docs).documents._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_pushed_literal(spark, tmp_path):
    spark.createDataFrame([(1, "a the\nb"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out = compile("/the/").run(spark.read.parquet(str(tmp_path / "d"))).outputs
    assert "StringContains(text,the)" in out._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in out.collect()] == ["a the\n"]


def test_not_exact(docs):
    for program in ("x/a*/ =", "x/a/ + p", "p =", "r/,/ ="):
        with pytest.raises(NotExact):
            compile(program).run(docs, tier="expressions").outputs
    assert compile("x/a*/ =").run(docs).outputs.count() > 0


def test_binary_input(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xffhit\xfe\nmiss"))], "doc_id long, text binary")
    out = compile("x/hit/ =").run(df).outputs.collect()
    assert [r.text for r in out] == ["1,4,3\n"]


def test_functions(docs):
    from pyspark.sql import functions as F

    got = docs.select("doc_id", collapse("text").alias("c"), concept("text", "time").alias("t"), fuzzy("text", "dgo", 1).alias("f"), replace("text", "the", "<&>").alias("r")).collect()
    by = {r.doc_id: r for r in got}
    assert by[10].c == "{[the]}" and by[0].c is None and by[2].f and not by[0].f and by[3].r.count("<the>") == 2
    assert docs.select(F.count_if(concept("text", "unheard"))).first()[0] == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for program in ("/a/", "x/a/ =", "s/a/b/g", "s/a/b/ s/b/c/"):
        run = compile(program).run(none)
        assert run.outputs.count() == run.documents.count() == run.edits.count() == run.views.count() == 0


def test_rendered_and_carried(spark):
    df = spark.createDataFrame([(1, "b\na\n", 2), (2, "a", 1)], "doc_id long, text string, at int")
    show = lambda r: {x.doc_id: x.text for x in r.rendered.collect()}
    assert show(compile(r"x/.*\n?/ p s/a/c/").run(df)) == {1: "b\na\nb\nc\n", 2: "a\nc"}
    assert show(compile("/a/").run(df)) == {1: "a\n", 2: "a\n"} and show(compile("s/a/c/").run(df)) == {1: "b\nc\n", 2: "c"}
    count = compile(r"x/.*\n?/ @{ END { print NR } }")
    assert show(count.run(df)) == {1: "2\n", 2: "1\n"} and show(count.run(df, carry=("at",))) == {1: "3\n", 2: "1\n"}
