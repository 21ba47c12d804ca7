"""Patterns for both matchers, against sets and plain versions; no text may end a process."""

import pytest
import regex

from loomtext import ProgramError, compile
from loomtext.functions import keep, replace, split_gaps, split_matches
from loomtext.lang.pattern import NotExact, Pattern

CHARS = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x2028, 0x3000, 0x4E2D, 0x1F642]]
ASCII = set(map(chr, range(128)))
LETTERS, DIGITS = set("abcdefghijklmnopqrstuvwxyz"), set("0123456789")

CLASSES = [
    ("[[:^digit:]]", lambda c: c not in DIGITS), ("[x[:^digit:]5]", lambda c: c not in DIGITS - {"5"}), ("[a-z&&[^aeiou]]", lambda c: c in LETTERS - set("aeiou")), ("[a-z&&a-f]", lambda c: c in set("abcdef")),
    ("[a-z--[aeiou]]", lambda c: c in LETTERS - set("aeiou")), ("[a-f~~d-z]", lambda c: c in LETTERS - set("def")), ("[^a-z--x]", lambda c: c not in LETTERS - {"x"}), ("[a[0-9]z]", lambda c: c in DIGITS | {"a", "z"}),
    ("[^a[0-9]]", lambda c: c not in DIGITS | {"a"}), ("[\\w&&[^\\d_]--[a-z]]", lambda c: regex.match(r"\w", c) and not c.isdecimal() and c not in LETTERS | {"_"}),
    ("[[a-c][x-z]&&[b-y]]", lambda c: c in set("bcxy")), ("[]a]", lambda c: c in "]a"), ("[a-]", lambda c: c in "a-"), ("[&a~]", lambda c: c in "&a~"), ("[a&&b]", lambda c: False), ("(?x)[ a # b ]", lambda c: c in "a#b"),
    ("(?i)[a-z&&[^aeiou]]", lambda c: c in set("bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ") | {"ſ"}),
]


@pytest.mark.parametrize(("source", "holds"), CLASSES)
def test_classes(spark, source, holds):
    want = [c for c in CHARS if holds(c)]
    p = Pattern(source)
    assert [c for c in CHARS if p.python.fullmatch(c)] == want
    df = spark.createDataFrame([(c,) for c in CHARS], "c string")
    java = [r.c for r in df.where(df.c.rlike(f"{p.java_flags}\\A(?:{p.java_body})\\z")).collect()]
    assert sorted(java) == sorted(want)


FLAGS = [
    ("(?x) a b # c\n + ", "abb ab a b", ["abb", "ab"]), ("(?U)a+b*", "aab", ["a", "a"]), ("(?U)a+?", "aab", ["aa"]), ("(?U:a+)b", "aab", ["aab"]), ("x(?i)a|b", "xA B xb", ["xA", "B", "b"]), ("(x(?i)a|b)c", "xAc Bc bC", ["xAc", "Bc"]),
    ("(?i)a(?-i)b", "Ab aB AB", ["Ab"]), ("(?R)^b$", "a\r\nb\r\nc\rb\nb", ["b", "b", "b"]), ("(?R).+", "ab\r\nc\rd", ["ab", "c", "d"]), ("(?Rs)b.+", "ab\r\nc", ["b\r\nc"]), (r"(?x)a\ b", "ab a b", ["a b"]), ("(?x: a )b ", "ab ", ["ab "]),
    ("(?s).(?-s:.)", "\n\na", ["\na"]), ("a{2,}", "a aa aaaa", ["aa", "aaaa"]), ("[a\U0001f642]{2,}", "a\U0001f642a a", ["a\U0001f642a"]), ("[ab]{2,}?", "abab", ["ab", "ab"]), ("a++b", "aab", ["aab"]),
]


@pytest.mark.parametrize(("source", "text", "found"), FLAGS)
def test_flags(spark, source, text, found):
    assert [m[0] for m in Pattern(source).matches(text)] == found
    assert spark.createDataFrame([(text,)], "t string").select(split_matches("t", source).alias("x")).first().x == found


@pytest.mark.parametrize("source", ["[[:none:]]", "[a", "(?q)a", "a(?=b)", r"(a)\1", "a{2", "*"])
def test_rejected(source):
    with pytest.raises(ProgramError):
        Pattern(source).python  # noqa: B018


LOOPS = ["(ab|cd)+", "([a-z]+ )+", "(?:a|b)*c", "(.\n?)*", "((ab|cd){20}){20}", "(a|b){300}", "(\\w\\s)+", ".{3,900}x", "(a?){500}", "(?:ab)++|([ab]{2})*"]
SAFE = ["(ab)+", "(?:a\\.b)*", r"(\d{1,3}\.){3}", "[a-z]+ [a-z]*?", "(cat|dog)?", "x{3,}", ".{2,}", "(a|b){20}", "a{2000}"]


def test_loops():
    assert [s for s in LOOPS if not Pattern(s).loops] == [] and [s for s in SAFE if Pattern(s).loops] == []


@pytest.mark.parametrize("program", ["x/(ab|cd)+/", "s/([a-z]+ )+/X/g", "x/(.|\\n)*/ g/z/", "y/(ab|cd)+/", "x/([^x]\\s?){2,}/", "x/(ab)+/", "x/.{2,}/"])
def test_long_texts(spark, program):
    texts = ["abcd" * 50_000, "ab " * 50_000, "a\U0001f642" * 50_000, " " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    run = compile(program).run(df)
    out = run.documents if program[0] == "s" else run.values
    assert out.selectExpr("count(*)").first()[0] >= 0


def test_long_texts_by_functions(spark):
    df = spark.createDataFrame([("abcd" * 100_000,), (None,), ("xaby",)], "t string")
    got = df.select(keep("t", "(ab|cd)+").alias("k"), split_matches("t", "(ab|cd)+").alias("m"), split_gaps("t", "(ab|cd)+").alias("g"), replace("t", "(ab|cd)+", "<$1>").alias("r")).collect()
    assert [(r.k, r.r) for r in got] == [(True, "<cd>"), (None, None), (True, "x<ab>y")] and got[2].m == ["ab"] and got[2].g == ["x", "y"] and len(got[0].m[0]) == 400_000
    with pytest.raises(NotExact):
        compile("x/(ab|cd)+/").run(df.selectExpr("1 doc_id", "t text"), tier="expressions").values


def test_repetitions_of_repetitions_are_logged(caplog):
    Pattern("(a+)+b7").loops  # noqa: B018
    assert "may take very long" in caplog.text
    caplog.clear()
    Pattern("(ab)+c7|x*y").loops  # noqa: B018
    assert not caplog.text
