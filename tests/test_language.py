"""Cases of the structural language: program, input, what is printed (or the rewritten document)."""

import random

import pytest

from loomtext import ProgramError, compile
from loomtext.lang.program import edits_text
from loomtext.plans.local import run_document, stitch

LINES = r"x/.*\n?/ "

CASES = [
    # lines and literals
    (LINES + "g/needle/ p", "hay\nneedle here\nstraw\n", "needle here\n"),
    ("/needle/", "hay\nneedle here\nstraw", "needle here\n"),
    (LINES + "g/b/ p", "ax\nbx", "bx\n"),
    (r"x/.*\n/ g/b/ p", "ax\nbx", ""),
    (LINES + "v/b/ p", "ax\nbx\n\ncx", "ax\n\ncx\n"),
    (LINES + "g/ERROR/ p", "a\n\nERROR\n\nb\n", "ERROR\n"),
    (LINES + "g/a/i p", "ALL a\nB\nAa\n", "ALL a\nAa\n"),
    (LINES + "g/érr/i p", "unicode Érror line\nx\n", "unicode Érror line\n"),
    (LINES + "g/k/i p", "\u212a\nx\n", "\u212a\n"),
    (LINES + "v/x/i p", "X\ny\n", "y\n"),
    # dialect
    (LINES + "g/^foo$/ p", "foo\nfoobar\n", "foo\n"),
    (LINES + r"g/foo\r?$/ p", "foo\r\nfoobar\r\n", "foo\r\n"),
    (LINES + "g/a.c/ p", "abc\nac\n", "abc\n"),
    (LINES + "g/ab*c/ p", "ac\nabbc\nadc\n", "ac\nabbc\n"),
    (LINES + "g/ab+c/ p", "ac\nabbc\n", "abbc\n"),
    (LINES + "g/colou?r/ p", "color\ncolour\ncolr\n", "color\ncolour\n"),
    (LINES + "g/cat|dog/ p", "cat\nbird\ndog\n", "cat\ndog\n"),
    (LINES + "g/(ab){2}/ p", "abab\nab\n", "abab\n"),
    (LINES + "g/[[:digit:]]+/ p", "a1\nb\n", "a1\n"),
    (LINES + "g/^[^[:space:]]+$/ p", "ab\na b\n", "ab\n"),
    (LINES + r"g/\bcat\b/ p", "cat\ncatalog\nthe cat\n", "cat\nthe cat\n"),
    (LINES + r"g/\w{4}/ p", "abc\nabcd\nñandú\n", "abcd\nñandú\n"),
    (LINES + r"g/^(\d{1,3}\.){3}\d{1,3}$/ p", "10.0.0.1\n10.0.0\n", "10.0.0.1\n"),
    (LINES + r"g/\p{Greek}/ p", "αβγ\nabc\n", "αβγ\n"),
    (LINES + r"g/a\tb/ p", "a\tb\na b\n", "a\tb\n"),
    (LINES + r"g/(?i)hello/ p", "HeLLo\nx\n", "HeLLo\n"),
    (LINES + "g/a++/ p", "aa\nb\n", "aa\n"),
    (LINES + r"g/\x41/ p", "A\nB\n", "A\n"),
    # empty patterns and matches
    (LINES + "g// p", "a\n\nb\n", "a\n\nb\n"),
    (LINES + "g/^$/ p", "a\n\nb\n", "\n"),
    ("g/$/ p", "abc", ""),
    ("x/a*/ p", "bbb", "\n\n\n"),
    ("p", "", "\n"),
    (LINES + "p", "", ""),
    # extraction and gaps
    ("x/[0-9]+/ p", "a1b22c333", "1\n22\n333\n"),
    ("x/aa/ p", "aaaaa", "aa\naa\n"),
    ("x/<.*?>/ p", "<a><b>", "<a>\n<b>\n"),
    ("x/a.b/s p", "a\nb", "a\nb\n"),
    ("x/a.b/ p", "a\nb", ""),
    ("y/,/ p", "alpha,beta,,gamma", "alpha\nbeta\ngamma\n"),
    ("z/[ \\n]+/ p", " a b\nc", "a\nb\nc\n"),
    ("x#a/b# p", "xa/by", "a/b\n"),
    ("x/a\\/b/ p", "xa/by", "a/b\n"),
    # offsets
    ("x/b/ =", "abab", "1,2,1\n3,4,1\n"),
    ("x/test/ =", "café test", "6,10,4\n"),
    ("x/b/ =", "a\0b", "2,3,1\n"),
    # blocks and streams
    (LINES + "{ x/[a-z]+/ r/,/ p }", "a b\n1\nc d\n", "a,b\nc,d\n"),
    ("m/[a-z]+/ { p }", "ab1cd", "ab\ncd\n"),
    (r"x/\w+/ N p", "a b c", "a b\nc\n"),
    (r"x/\w+/ r/\t/ p", "a b c", "a\tb\tc\n"),
    ("x/zz/ r/,/ p", "abc", ""),
    (r"x/\w/ g/[ab]/; p", "abc", "a\nb\n"),
    ("p p", "a", "a\na\n"),
    (LINES + "{ p p }", "a\nb\n", "a\na\nb\nb\n"),
    (LINES + "p { g/a/ p }", "a\nb\n", "a\na\nb\n"),
    # brackets
    ("x/b/ + p", "f({a, b}, c)", "{a, b}\n"),
    ("x/b/ + + p", "f({a, b}, c)", "({a, b}, c)\n"),
    ("x/f/ + p", "f(x)", "f\n"),
    ("- p", "f({a, b}, c)", "{a, b}, c\n"),
    ("- - p", "f({a, b}, c)", "a, b\n"),
    ("- p", "no brackets", ""),
    ("- p", "open (rest", "rest\n"),
    # near matches and concepts
    (LINES + "~1/error/ p", "no\nerrror\nerror\nxyz\neror\n", "errror\nerror\neror\n"),
    (LINES + "~0/ab/ p", "ab\nba\n", "ab\n"),
    (LINES + "~9/ab/ p", "zz\n", "zz\n"),
    (LINES + ":sem:/error/ p", "it FAILED\nfine\n", "it FAILED\n"),
    (LINES + ":sem:/unheard/ p", "an Unheard word\nno\n", "an Unheard word\n"),
    # changes and substitutions
    ("x/[0-9]+/ c/N/", "a1b22", "aNbN"),
    (r"x/,/ c/\n/", "a,b", "a\nb"),
    (LINES + "{ g/a/ c// }", "a\nb\nca\n", "b\n"),
    ("s/foo/bar/", "foo foo", "bar foo"),
    ("s/foo/bar/g", "foo foo", "bar bar"),
    ("s/foo/bar/2", "foo foo foo", "foo bar foo"),
    ("s/foo/bar/g2", "foo foo foo", "foo bar bar"),
    ("s/foo/bar/3", "foo foo", "foo foo"),
    ("s/FOO/x/gi", "foo Foo", "x x"),
    ("s#a/b#c#", "a/b", "c"),
    (r"s/(\w+) (\w+)/\2 \1/", "hello world", "world hello"),
    ("s/(\\w+) (\\w+)/$2 $1/", "hello world", "world hello"),
    ("s/(?P<k>\\w+)=(?P<v>\\w+)/${v}=$k/g", "a=1 b=2", "1=a 2=b"),
    ("s/b/[&]/", "abc", "a[b]c"),
    (r"s/b/[\&]/", "abc", "a[&]c"),
    ("s/b/$$/", "abc", "a$c"),
    ("s/b/$/", "abc", "a$c"),
    ("s/b/${x/", "abc", "a${xc"),
    ("s/b/$7/", "abc", "ac"),
    (r"s/b/\x41\t\q/", "abc", "aA\tqc"),
    ("s/(a)|(b)/[$1$2]/g", "ab", "[a][b]"),
    ("s/x*/-/g", "abxc", "-a-b--c-"),
    ("s/^/> /g", "a\nb\n", "> a\n> b\n"),
    ("s/$/!/g", "a\nb\n", "a!\nb!\n"),
    ("s/$/!/g", "a\nb", "a!\nb!"),
    ("s/^/X/", "", "X"),
    ("s/a/b/g s/b/c/g", "abab", "bcbc"),
    ("s/the/X/g s/he/Y/g", "the he", "X Y"),
    ("/a/ { s/a/b/ }", "aa\nc\na\n", "ba\nc\nb\n"),
    ("s/a/b/ t { s/x/y/ }", "ax", "by"),
    ("s/q/b/ t { s/x/y/ }", "ax", "ax"),
    # records
    (LINES + "@{ print $2, $1 }", "a b\nc d\n", "b a\nd c\n"),
    (LINES + "@{ s += $2 END { print s, NR } }", "tea 12\ncoffee 18\nwater 3\n", "33 3\n"),
    ("g/nothing/ @{ BEGIN { print 1 } END { print NR } }", "abc", "1\n0\n"),
    (LINES + "{ @{ END { print NR } } }", "a\nb\n", "1\n1\n".replace("1\n1\n", "1\n2\n")),
]


@pytest.mark.parametrize(("program", "text", "want"), CASES)
def test_cases(program, text, want):
    nodes = compile(program).nodes
    run, _ = run_document(nodes, text)
    got = "".join(run.printed)
    if edits_text(nodes):
        got += stitch(text, run.edits)
    assert got == want


@pytest.mark.parametrize("program", ["x/(/", "x/a", "k", "m/a/", "~/a/", "s/a/b/0", "}", "{ p", "@{ print", "x/(a)\\1/", "x/(?=a)/", ":foo:/a/", "x/*/", "@{ 1 & 2 }", "@{ $-1 }", "s/a/b", "x/[a/", "@{ a ~ b }"])
def test_rejected(program):
    with pytest.raises(ProgramError):
        nodes = compile(program).nodes
        run_document(nodes, "a\n")


def test_derived_views_have_no_place():
    with pytest.raises(ProgramError):
        run_document(compile("x/a/ r/,/ =").nodes, "aa")


def test_near_is_the_table():
    """Against the whole edit-distance table, on random texts."""
    import random

    from loomtext.plans.local import near

    def table(text, want, k):
        row = list(range(len(want) + 1))
        best = row[-1]
        for c in text:
            diagonal, row[0] = row[0], 0
            for i, w in enumerate(want, 1):
                diagonal, row[i] = row[i], min(diagonal + (c != w), row[i] + 1, row[i - 1] + 1)
            best = min(best, row[-1])
        return best <= k

    pick = random.Random(3)
    for _ in range(3000):
        want, text, k = "".join(pick.choices("abc", k=pick.randint(1, 9))), "".join(pick.choices("abcd", k=pick.randint(0, 14))), pick.randint(0, 4)
        assert near(text, want, k) == table(text, want, k), (text, want, k)
    assert near("x" * 50 + "naïve", "naive", 2) and not near("naïve", "naive", 1)


def test_brackets_by_a_plain_search():
    from loomtext.plans.local import CLOSE, OPEN, Brackets

    rng = random.Random(1)
    for _ in range(300):
        doc = "".join(rng.choice("ab()[]{}") for _ in range(rng.randrange(30)))
        found = Brackets(doc)
        for start in range(len(doc) + 1):
            for end in range(start, len(doc) + 1):
                depth, left, right = 0, None, None
                for i in range(start - 1, -1, -1):
                    if doc[i] in OPEN and not depth:
                        left = i
                        break
                    depth += (doc[i] in CLOSE) - (doc[i] in OPEN)
                depth = 0
                for i in range(end, len(doc)):
                    if doc[i] in CLOSE and not depth:
                        right = i
                        break
                    depth += (doc[i] in OPEN) - (doc[i] in CLOSE)
                assert found.around(start, end) == ((start, end) if left is None or right is None else (left, right + 1))
