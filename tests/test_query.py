import pytest

from strata.query.parser import QueryError, SearchType, Strategy, parse, tokenize
from strata.query.translate import glob_to_regex, strategy, translate


@pytest.mark.parametrize(
    "text, want",
    [("foo bar baz", ["foo", "bar", "baz"]), ('lang:rust "foo bar" baz', ["lang:rust", "foo bar", "baz"]), ("  foo   bar  ", ["foo", "bar"]), ("", []), ('foo "bar baz', ["foo", "bar baz"]), ('file:"a b"', ["file:", "a b"]), ("a\tb", ["a", "b"])],
)
def test_tokens(text, want):
    assert [t.text for t in tokenize(text)] == want


def test_filters_and_groups():
    q = parse("repo:myrepo@develop -repo:x file:*.rs -file:test l:go -lang:c count:7 case:yes author:a -author:b before:2024-01-01 after:2023-01-01 message:m -message:n select:symbol.struct error handling OR panic recovery")
    f = q.filters
    assert (f.repo, f.rev, f.not_repo, f.file, f.not_file, f.lang, f.not_lang, f.count, f.case) == ("myrepo", "develop", "x", "*.rs", "test", "go", "c", 7, True)
    assert (f.author, f.not_author, f.before, f.after, f.message, f.not_message, f.select, f.select_kind) == ("a", "b", "2024-01-01", "2023-01-01", "m", "n", "symbol", "struct")
    assert q.texts == ["error handling", "panic recovery"] and q.pattern == "error handling OR panic recovery"


def test_terms_that_look_like_filters():
    assert parse("http://example.com foo").texts == ["http://example.com foo"]
    assert parse("-word foo").texts == ["-word foo"]
    assert parse("OR a OR OR b OR").texts == ["a", "b"]
    assert parse("lang:go lang:rust x").filters.lang == "rust"
    assert parse("case:no x").filters.case is False
    assert parse('"lang:go"').texts == ["lang:go"]


def test_regex():
    q = parse(r"/err\d+/")
    assert q.is_regex and q.texts == [r"err\d+"]
    assert parse("patterntype:regexp /a/").texts == ["/a/"]
    assert not parse("/a/ OR b").is_regex


@pytest.mark.parametrize(
    "text, message",
    [("type:bogus", "unknown search type"), ("count:abc", "count: must be a positive integer"), ("count:0 x", "count: must be a positive integer"), ("count:-1 x", "count: must be a positive integer"), ("patterntype:structural", "unsupported pattern type"), ("select:foo", "unknown select type"), ("-count:5", "negation not supported for"), ("-foo:bar", "negation not supported for"), ("//", "empty regex pattern"), ("patterntype:regexp a OR b", "regex patterns cannot be combined with OR")],
)
def test_parse_errors(text, message):
    with pytest.raises(QueryError, match=message):
        parse(text)


@pytest.mark.parametrize(
    "text, message",
    [("lang:rust", "code search requires a search pattern"), ("type:diff author:a", "diff search requires a search pattern"), ("type:commit", "commit search requires a search pattern or at least one filter"), ("type:symbol repo:x", "symbol search requires a search pattern or filter"), ("type:commit /a/", "regex patterns are only supported"), ("calls:f /a/", "regex patterns are only supported")],
)
def test_translate_errors(text, message):
    with pytest.raises(QueryError, match=message):
        translate(parse(text))


def test_translation():
    t = translate(parse("lang:rust file:*.rs count:10 foo"))
    assert "b.language = :" in t.sql and "LIMIT 10" in t.sql and t.args["p1"] == "foo" and "refs/heads/main" in t.args.values() and "code_search(:p1)" in t.sql
    assert "refs/heads/develop" in translate(parse("rev:develop foo")).args.values()
    assert "refs/tags/v1" in translate(parse("rev:refs/tags/v1 foo")).args.values()
    both = translate(parse("type:commit repo:a -repo:b")).sql
    assert both.count("JOIN repos") == 1 and "NOT (" in both
    assert translate(parse("calls:a calledby:b returns:c")).args["p1"] == "%a%"
    assert "JOIN repos" not in translate(parse("type:commit author:x")).sql
    assert "SELECT DISTINCT fr.path" in translate(parse("select:file foo")).sql
    assert "s.kind IN ('function', 'method')" in translate(parse("returns:Result")).sql


@pytest.mark.parametrize("text, want", [("foo", Strategy.TEXT_ONLY), ("lang:go foo", Strategy.INTERSECT), ("rev:x foo", Strategy.INTERSECT), ("author:x foo", Strategy.TEXT_ONLY), ("type:diff author:x foo", Strategy.INTERSECT), ("type:diff lang:go foo", Strategy.TEXT_ONLY), ("type:commit x", Strategy.SQL_ONLY), ("calls:x type:code", Strategy.SQL_ONLY), ("type:symbol x", Strategy.SQL_ONLY)])
def test_strategy(text, want):
    assert strategy(parse(text)) is want
    assert want.value in ("sql_only", "bleve_only", "intersect") and SearchType.CODE.value == "code"


def test_globs():
    import re

    for pattern, text, hit in [("*.rs", "src/a.rs", True), ("*.rs", "a.rsx", False), ("a?c", "abc", True), ("[ab]*", "bx", True), ("[^ab]*", "bx", False), ("*a[b*", "a[b", False), ("a+b", "a+b", True), ("*\n*", "x\ny", True)]:
        assert bool(re.search(glob_to_regex(pattern), text)) is hit, pattern
