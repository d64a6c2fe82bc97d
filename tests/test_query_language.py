"""Parsing: precedence, atoms and the forms that need care."""

import pytest

from logquarry.plans.query import And, Field, Fuzzy, Level, Not, Or, Phrase, Regex, Term, parse, terms


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("Error", Term("error")),
        ("a AND b OR c", Or((And((Term("a"), Term("b"))), Term("c")))),
        ("(a OR b) AND c", And((Or((Term("a"), Term("b"))), Term("c")))),
        ("error NOT 404", And((Term("error"), Not(Term("404"))))),
        ("a NOT b NOT c", And((Term("a"), Not(Term("b")), Not(Term("c"))))),
        ("a AND NOT b", And((Term("a"), Not(Term("b"))))),
        ("NOT a", Not(Term("a"))),
        ("ERROR 500", And((Term("error"), Term("500")))),
        ('"disk is full"', Phrase("disk is full")),
        ('"Disk"', Term("disk")),
        ("level:error", Level("ERROR")),
        ("severity:Warn", Level("WARN")),
        ("(level:ERROR OR level:FATAL)", Or((Level("ERROR"), Level("FATAL")))),
        ('path:"/api/x y"', Field("path", "/api/x y")),
        ("status:500", Field("status", "500")),
        ("~eror", Fuzzy("eror", 0.85)),
        ("~eror:0.7", Fuzzy("eror", 0.7)),
        ("~host:8080", Fuzzy("host:8080", 0.85)),
        ("/time(out|d)/", Regex("time(out|d)", "i")),
        ("/a[/", Term("/a[/")),
        ("", Term("")),
        ("a )", Term("a")),
        ("(a", Term("a")),
        ('say "a OR b" AND c', And((Term("say"), Phrase("a OR b"), Term("c")))),
    ],
)
def test_parse(query, tree):
    assert parse(query) == tree


def test_regex_flag_and_strict():
    assert parse("a(", is_regex=True) == Regex(r"a\(", "i")
    assert parse("/x/m", ignore_case=False) == Regex("x", "m")
    assert parse("ERROR 500", strict=True) == Term("error 500")


def test_terms_include_negated_ones():
    assert terms(parse('a AND "b c" NOT d')) == ["a", "b", "c", "d"]
    assert terms(parse("/a/")) == []
