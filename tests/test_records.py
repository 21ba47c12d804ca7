"""Cases of the record language, record by record and as plans."""

import struct

import pytest

from loomtext.awk.run import Machine
from loomtext.awk.values import AwkError, printf
from loomtext.plans.records import NotExact, records

CASES = [
    ("{ print $1, NF, NR }", ["a b", "", "c"], "a 2 1\n 0 2\nc 1 3\n"),
    ("BEGIN { FS = \":\" } print $2", ["a:b:c", ":x"], "b\nx\n"),
    ("BEGIN { FS = \"\" } print $2 $1", ["ab"], "ba\n"),
    ("BEGIN { FS = \"::\" } print $2", ["a::b"], "b\n"),
    ("BEGIN { OFS = \"-\" } { $1 = $1; print }", ["a b c"], "a-b-c\n"),
    ("{ $5 = \"e\"; print; print NF }", ["a b"], "a b   e\n5\n"),
    ("{ NF = 2; print }", ["a b c"], "a b\n"),
    ("{ $0 = \"x y\"; print $2, NF }", ["a"], "y 2\n"),
    ("{ print $NF, $NF-1 }", ["1 2 5"], "5 4\n"),
    ("{ print -2^2, 2^3^2, 2^-1 }", ["x"], "-4 512 0.5\n"),
    ("{ print 1+2*3, (1+2)*3, 7%3, -7%3, 1/4 }", ["x"], "7 9 1 -1 0.25\n"),
    ("{ print 1e15, 1e16, 123456.789, 1e-7, 0.1+0.2 }", ["x"], "1000000000000000 10000000000000000 123456.789 0 0.3\n"),
    ("{ print 1 \" \" 2, 1 2, \"a\" \"b\" }", ["x"], "1 2 12 ab\n"),
    ("{ print 10 < 9, \"10\" < \"9\", \"a\" < \"b\", \"10\" == 10.0, x == 0, x == \"\" }", ["x"], "0 0 1 1 0 1\n"),
    ("{ print !x, !1, 1 && 0, 1 || 0, x ? \"t\" : \"f\", \"0\" ? \"t\" : \"f\" }", ["x"], "1 0 0 1 f f\n"),
    ("{ x = 5; x += 2; x *= 3; x -= 1; x /= 4; x ^= 2; x %= 7; print x, x++, x, ++x, x--, --x }", ["r"], "4 4 5 6 6 4\n"),
    ("{ if ($1 > 2) print \"big\"; else print \"small\" }", ["1", "3"], "small\nbig\n"),
    ("{ while (i < 3) { i++; if (i == 2) continue; print i } }", ["x"], "1\n3\n"),
    ("{ for (i = 1; i <= 9; i++) { if (i == 3) break; print i } }", ["x"], "1\n2\n"),
    ("{ if ($1 == \"skip\") next; print }", ["a", "skip", "b"], "a\nb\n"),
    ("{ c[$1]++ } END { print c[\"a\"], (\"b\" in c), (\"z\" in c), c[\"z\"] + 0 }", ["a", "b", "a"], "2 1 0 0\n"),
    ("{ a[1, 2] = 3; for (k in a) { split(k, p, SUBSEP); print p[1], p[2] } delete a[1, 2]; for (k in a) print k }", ["x"], "1 2\n"),
    ("{ a[1] = 1; delete a; print (1 in a) }", ["x"], "0\n"),
    ("{ print length($0), length(), substr($0, 2, 3), substr($0, 0, 2), substr($0, -1), substr($0, 4) }", ["héllo"], "5 5 éll h héllo lo\n"),
    ("{ print index($0, \"l\"), index($0, \"z\"), index($0, \"\"), toupper($0), tolower(\"ÀB\") }", ["hello"], "3 0 1 HELLO àb\n"),
    ("{ n = split($0, a, \",\"); print n, a[1], a[3] }", ["x,,z"], "3 x z\n"),
    ("{ print int(3.9), int(-3.9), sqrt(16), log(0), log(-1), exp(0), atan2(0, 1) }", ["x"], "3 -3 4 -inf nan 1 0\n"),
    ("{ printf \"%5.2f|%-4s|%04d|%x|%c|%e|%g|%%\\n\", 3.14159, \"ab\", 42, 255, \"hey\", 12345.678, 0.0001 }", ["x"], " 3.14|ab  |0042|ff|h|1.234568e+04|0.0001|%\n"),
    ("{ s = sprintf(\"%+d %o %u %G\", 5, 8, 7, 1e10); print s }", ["x"], "+5 10 7 1E+10\n"),
    ("{ print \"3x\" + 4, \"abc\" + 1, \" 12 \" + 1, \".5\" + 0 }", ["x"], "7 1 13 0.5\n"),
    ("BEGIN { print 1 } END { print NR }", [], "1\n0\n"),
    ("{ print FNR, FILENAME } # a comment", ["x"], " \n"),
    ("{ r = rand(); print r >= 0 && r < 1, srand(3), srand(4), srand(5, 6) }", ["x"], "1 0 3 4\n"),
    ("{ print -1e-7, 1e-7, -0, 1e-6 }", ["x"], "-0 0 0 0.000001\n"),
]


@pytest.mark.parametrize(("source", "rows", "want"), CASES)
def test_machine(source, rows, want):
    assert Machine(source).run(rows) == want


@pytest.mark.parametrize("source", ["{ print 1 / 0 }", "{ gsub(1, 2) }", "{ print 5 % 0 }", "{ break }", "{ printf \"%d\" }", "{ print substr(1) }", "{ printf \"%*d\", 1, 2 }"])
def test_run_time_errors(source):
    with pytest.raises(AwkError):
        Machine(source).run(["x"])


def plain_random(state, n):
    out = []
    for _ in range(n):
        state ^= state >> 12
        state = (state ^ state << 25) % 2**64
        state ^= state >> 27
        out.append((state * 0x2545F4914F6CDD1D % 2**64 >> 11) / 2**53)
    return out


def test_random_numbers_are_the_known_ones():
    shown = lambda xs: "".join(f"{x:.17f}\n" for x in xs)
    source = '{ printf "%.17f\\n", rand() }'
    assert Machine(source).run(["x"] * 3) == shown(plain_random(0x2545F4914F6CDD1D, 3)) and shown(plain_random(0x2545F4914F6CDD1D, 1)).startswith("0.677211")
    for seed in (1.0, -2.5, 1e300):
        bits = int.from_bytes(struct.pack("<d", seed), "little") ^ 0x2545F4914F6CDD1D
        assert Machine("BEGIN { srand(%r) } %s" % (seed, source)).run(["x"] * 2) == shown(plain_random(bits, 2))
    assert Machine("BEGIN { srand(1) } { print rand() }").run(["x"]) == "0.522819\n"


def test_reproducible_random():
    assert Machine("{ print rand() }").run(["a", "b"]) == Machine("{ print rand() }").run(["a", "b"])


def test_printf_errors():
    with pytest.raises(AwkError):
        printf("%", [])


ROWS = ["ab 12 x", "cd 7 y", "ab -3.5 x", "", "ef 1e2 z w", "é 07 ÿ"]
PLANS = [
    ("{ print $1, $2 + 1, NF }", "local"),
    ("{ if ($2 > 5) print toupper($1); else if (NF) print $2; print length($0) }", "local"),
    ("{ $2 = $2 * 2; print; print $0 }", "local"),
    ("{ if ($1 == \"ab\") next; x = $2 * 2; x = x + 1; print x, substr($0, 2, 3), index($0, \" \") }", "local"),
    ("{ n = split($0, a, \" \"); print n, a[2] }", "local"),
    ("{ print $1 < $3, $2 < 10, $2 == \"7\", !$2, $2 && $3, ($2 > 1) ? \"a\" : \"b\" }", "local"),
    ("{ printf \"%s-%d\\n\", $1, $2 }", "local"),
    ("{ s += $2; n++ } END { print s, n, NR, s / NR }", "algebraic"),
    ("{ c[$1]++; t[$1] += $2 } END { for (k in c) print k, c[k], t[k] }", "algebraic"),
    ("{ if (NF > 2) { m[$3] = 1; s -= $2 } else u++ } END { for (k in m) n++; print n, s, u, v }", "algebraic"),
    ("{ x[NF] = 1; if (NR == 1 || length($0) < lo) lo = length($0); if (NR == 1 || hi < length($0)) hi = length($0) } END { print lo, hi, lo + 1 }", "algebraic"),
    ("{ s += $2; print s }", "sequential"),
    ("{ last = $1 } END { print last }", "sequential"),
    ("{ if (!($1 in seen)) print $1; seen[$1] = 1 }", "sequential"),
    ("{ if (NF) last = $1; n = $2 + 1; at[$3] = $1 } END { print last, n; for (k in at) print k, at[k] }", "sequential"),
]


RUNNING = [
    "{ s += $2; print $1, s }", "{ print s, NR; s += $2; n++; print s, n }", "{ if ($3 == \"x\") { s += $2; n++ } print s, n, s / (n + 1), NR }", "BEGIN { s = 5; OFS = \"-\" } { s -= $2; print s, $1 } END { print s, NR, u }",
    "{ if (!NF) next; n++; print n \":\" $1 }", "{ n++; if (n > 2) print NR, n; x = n * 2; print x }", "{ print NR, $0 }", "{ s += $2; s += 1; print s; s++ } END { print s }",
]


@pytest.mark.parametrize("source", RUNNING)
def test_running_sums(spark, source):
    rows = [ROWS[(i * i) % 6] for i in range(200)]
    df = spark.createDataFrame([(i // 7, i, r) for i, r in enumerate(rows)], "a int, b int, line string").repartition(7)
    out = records(source).over(df, "line", ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0] and "MapInArrow" not in plan
    got = "".join(r.text for r in sorted(out.collect(), key=lambda r: r.part))
    assert got == Machine(source).run(rows)


@pytest.mark.parametrize("source", ["{ s += s + 1; print s }", "{ if (s > 3) s += 1; s += $2; print s }", "{ x = s; s += x; print s }", "{ $2 = s; s += $2; print }", "{ s += $2; print s; if (NR % 2) s = 0 }", "{ if (n > 2) next; n++; print n }"])
def test_sums_of_sums_run_in_one_task(spark, source):
    df = spark.createDataFrame(list(enumerate(ROWS)), "i long, line string")
    assert "MapInArrow" in (plan := records(source).over(df, "line", ["i"]))._jdf.queryExecution().executedPlan().toString()
    assert "".join(r.text for r in sorted(plan.collect())) == Machine(source).run(ROWS)


def test_last_values_are_gathered(spark):
    df = spark.createDataFrame(list(enumerate(ROWS)), "i long, line string")
    plan = records("{ if (NF) last = $1; at[$3] = $2 * 2 } END { print last; for (k in at) print k, at[k] }").over(df, "line", ["i"])
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.text for r in plan.collect()) == sorted(["é\n", " 0\n", "x -7\n", "y 14\n", "z 200\n", "ÿ 14\n"])


@pytest.mark.parametrize(("source", "kind"), PLANS)
def test_plans_agree_with_the_machine(spark, source, kind):
    assert records(source).kind() == kind
    df = spark.createDataFrame(list(enumerate(ROWS)), "i long, line string")
    got = records(source).over(df, "line", ["i"] if kind == "sequential" else None)
    lines = sorted("".join(r.text for r in got.collect()).splitlines())
    assert lines == sorted(Machine(source).run(ROWS).splitlines())
    if kind == "sequential":
        with pytest.raises(NotExact):
            records(source).over(df, "line")


def test_white_space_is_unicode_s(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"a{c}b",) for c in chars if c not in "\n"], "line string")
    got = {r.text for r in records("{ if (NF == 2) print $0 }").over(df, "line").collect()}
    assert got == {f"a{c}b\n" for c in map(chr, [9, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])}


def test_empty_table(spark):
    none = spark.createDataFrame([], "line string")
    assert records("{ print }").over(none, "line").count() == 0
    assert [r.text for r in records("{ s += $1 } END { print NR, s }").over(none, "line").collect()] == ["0 \n"]
