from datetime import datetime, timedelta

import pytest

from quirefold.lang import rewrite
from quirefold.lang.dates import LAYOUTS, fuzz, interval, parse_datetime
from quirefold.lang.lexer import Kind, Token, describe, lex
from quirefold.lang.parser import DepthError, EmptyQueryError, ParseError, QueryError, compile_tree, parse
from quirefold.lang.tree import Category, Clause, Op, Statement


def short(text):
    """Tokens as one line."""
    return " ".join(t.text for t in lex(text))


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("", "( and )"),
        ('a:"two words"', "( and a : two words )"),
        ("foo:bar", "( and foo:bar )"),
        ("a:x t=y d:2020-01-01", "( and a : x t = y d : 2020-01-01 )"),
        ("(or a:x a:y)", "( and ( or a : x a : y ) )"),
        ("(or a:x a:y) (OR a:z a:w)", "( and ( or a : x a : y ) ( OR a : z a : w ) )"),
        ("a:x (or t:y t!=z) or d<=2020-01-01 and -T~u t/v", "( and a : x ( or t : y t != z ) ( or d <= 2020-01-01 ( and - T ~ u t / v ) ) )"),
        ("a:x (or (and a:y a:z) a:w)", "( and a : x ( or ( and a : y a : z ) a : w ) )"),
        ("(or (and a:x", "( and ( or ( and a : x ) ) )"),
        ("p/a(b)c) t:x", "( and p / a(b)c ) t : x"),
        ("title=x path:y filetime>2020-01-01", "( and title = x path : y filetime > 2020-01-01 )"),
        ("order:x", "( and order:x )"),
        ('T:""', "( and T :  )"),
    ],
)
def test_lex(text, tokens):
    assert short(text).split() == tokens.split()


def test_lex_kinds_and_description():
    assert lex("d>x")[2:5] == [Token(Kind.CATEGORY, "d", Category.DATE), Token(Kind.OPERATOR, ">"), Token(Kind.DATE, "x")]
    assert lex("foo:bar")[2].kind is Kind.UNKNOWN
    assert describe(lex("(or a:x)")).split("\n")[2].startswith("  OPEN")


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("foo:bar", ParseError), ("And a:b", ParseError), ("d:noday", ParseError), ("d/abc", ParseError), ("T<a", ParseError),
        ("a=b) c:d", ParseError), ("a=b))", ParseError), ("( a=b )", ParseError), ("", EmptyQueryError), ("(or (and", EmptyQueryError),
        ("(and " * 16 + "a=b", DepthError), ("-", ParseError), ("a=", ParseError),
    ],
)
def test_errors(text, error):
    with pytest.raises(error):
        compile_tree(text)
    assert issubclass(error, QueryError)


def test_parse_values():
    tree = parse(lex('T:"two words" -d>="January 1, 2025"'))
    assert tree == Clause(False, [Statement(Category.TITLE, Op.AP, "two words"), Statement(Category.DATE, Op.GE, datetime(2025, 1, 1), True)])
    assert tree.depth() == 1 and tree.order() == 1 and [*tree.levels()] == [tree]


@pytest.mark.parametrize(
    ("text", "result"),
    [
        ("-T=x -T!=x -d<2020-01-01 -d<=2020-01-01 -T:x", '(and title!="x" title="x" date>="2020-01-01 00:00:00" date>"2020-01-01 00:00:00" -title:"x")'),
        ("(or a=x a=y)", '(or authors="x" authors="y")'),
        ("(and t=a (and t=b))", '(and tags="a" tags="b")'),
        ("T=x (or t=a)", '(and title="x" tags="a")'),
        ("T=x (or t=a t=b)", '(and title="x" (or tags="a" tags="b"))'),
        ("(or (and (or T=x)))", '(and title="x")'),
    ],
)
def test_normal_form(text, result):
    got = str(compile_tree(text, -1))
    assert got == result or got == result.replace("(and title", "(or title")


def tree(text):
    return rewrite.simplify(parse(lex(text)))


@pytest.mark.parametrize(
    ("name", "text", "result"),
    [
        ("compact", "T=x t=a T=x", "T=x t=a"),
        ("sort", "t=a T=x T:x", "t=a T:x T=x"),
        ("tighten", "d>2020-01-01 d>=2021-01-01 d<2023-01-01 d<=2022-01-01", "d>=2021-01-01 d<=2022-01-01"),
        ("tighten", "d>2020-01-01 d>=2020-01-01", "d>2020-01-01"),
        ("tighten", "(or d>2020-01-01 d>=2021-01-01 d<2019-01-01)", "(or d>2020-01-01 d<2019-01-01)"),
        ("tighten", "T:harbour T:harb t:har t:harbour", "T:harbour t:har t:harbour"),
        ("tighten", "(or T:harbour T:harb)", "(or T:harb)"),
        ("tighten", "T:harbour -T:harb", "T:harbour -T:harb"),
        ("mergeregex", "(or T/a T/b p/c -T/d)", "(or T/a|b p/c -T/d)"),
        ("mergeregex", "T/a T/b", "T/a T/b"),
        ("contradictions", "T=a T=b", "T=a T=b"),
        ("strictEq", "T=a T:monday", "T=a T:monday"),
        ("mergeap", "T:foo -T:bar", "T:foo -T:bar"),
    ],
)
def test_passes(name, text, result):
    assert rewrite.PASSES[name](tree(text)) == tree(result)


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("Jan  2, 2024", (2024, 1, 2)), ("Jan 12, 2024", (2024, 1, 12)), ("december 11, 2017", (2017, 12, 11)), ("March 3 2017", (2017, 3, 3)),
        ("Mar 3 2017", (2017, 3, 3)), ("2017 March 3", (2017, 3, 3)), ("2020-02-29", (2020, 2, 29)), ("2020-02-03 04:05:06", (2020, 2, 3, 4, 5, 6)),
        ("01/02 03:04:05PM '06 -0700", (2006, 1, 2, 22, 4, 5)), ("Mon Jan  2 15:04:05 2006", (2006, 1, 2, 15, 4, 5)),
        ("Mon Jan  2 15:04:05 UTC 2006", (2006, 1, 2, 15, 4, 5)), ("Mon Jan 02 15:04:05 +0100 2006", (2006, 1, 2, 14, 4, 5)),
        ("02 Jan 70 15:04 MST", (1970, 1, 2, 15, 4)), ("02 Jan 68 15:04 -0100", (2068, 1, 2, 16, 4)), ("Monday, 02-Jan-06 15:04:05 GMT", (2006, 1, 2, 15, 4, 5)),
        ("Mon, 02 Jan 2006 15:04:05 GMT", (2006, 1, 2, 15, 4, 5)), ("Mon, 02 Jan 2006 15:04:05 +0200", (2006, 1, 2, 13, 4, 5)),
        ("2006-01-02T15:04:05Z", (2006, 1, 2, 15, 4, 5)), ("2006-01-02T15:04:05.25+07:00", (2006, 1, 2, 8, 4, 5)),
        ("2020-02-30", None), ("16/09/2017", None), ("sometime", None), ("", None), ("2020-1-1", None), ("01/02 13:04:05PM '06 -0700", None),
    ],
)
def test_dates(text, moment):
    assert parse_datetime(text) == (datetime(*moment) if moment else None)
    assert len(LAYOUTS) == 17


def test_fuzz():
    for t, d in [
        ((2024, 5, 6, 7, 8, 9), timedelta(minutes=5)), ((2024, 5, 6, 7, 8), timedelta(minutes=30)), ((2024, 5, 6, 7), timedelta(hours=4)),
        ((2024, 5, 6), timedelta(hours=84)), ((2024, 5, 1), timedelta(hours=336)), ((2024, 1, 1), timedelta(hours=4380)),
    ]:
        assert fuzz(datetime(*t)) == d
    assert interval(datetime(2025, 6, 14)) == (datetime(2025, 6, 10, 12), datetime(2025, 6, 17, 12))
    assert interval(datetime(1, 1, 1))[0] == datetime.min
