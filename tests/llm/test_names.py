import pytest

from strata.llm import names as N

SAME = [
    ["Michael Binokura", "Binokura Michael", "Binokura, Mike", "MICHAEL BINOKURA", "michael.binokura", "mbinokura", "M. Binokura", "Micheal Binokura", "Dr. Michael Binokura", "MichaelBinokura", "binokura_michael", "Michael P. Binokura", "Michael\u00a0Binokura", "Michael Binokura (they/them)"],
    ["Jürgen Drivovov", "Juergen Drivovov", "Jurgen Drivovov", "J. Drivovov", "Jürgen Drivoov"],
    ["Chloë Probustidis", "Chloe Probustidis", "C Probsutidis"],
    ["Faunaukek Technologies", "Faunaukek Tech", "Faunaukek Technolgies", "Faunaukek Technologies LLC", "Fanaukek Technologies"],
    ["Sateirek Build Bot", "Sateirek [bot]", "Sateirek buildbot", "Sateirek Build-Bot"],
    ["The Skemosini Foundation", "Skemosini Fdn.", "Skemosini foundation"],
    ["Zudienez Software GmbH", "Zudienez SW GmbH", "Zudienez Software G.m.b.H."],
    ["Priya Binokura"], ["Robert Binokura", "Bob Binokura", "Binokura, Rob"], ["Anna Skauller"], ["Anne Skauller"], ["Sateirek Software"], ["Leo Marti", "Leandro Marti"],
]


@pytest.fixture(scope="module")
def resolved(spark):
    rows = [(s, i, "x") for i, group in enumerate(SAME) for s in group for _ in range(1 + i % 2)] + [(None, 1, "x"), ("", 1, "x"), ("  ", 1, "x")]
    return N.resolve(spark.createDataFrame(rows, "author string, entity int, node string"), "author")


def test_groups(resolved):
    got = {r.spelling: r.entity for r in resolved.collect()}
    assert set(got) == {s for g in SAME for s in g}
    for g in SAME:
        assert len({got[s] for s in g}) == 1, {s: got[s] for s in g}
    assert len({got[g[0]] for g in SAME}) == len(SAME), [(g[0], got[g[0]]) for g in SAME]


def test_pairs_are_closed_and_ordered(resolved):
    pairs = {(r.author_a, r.author_b) for r in N.variant_pairs(resolved).collect()}
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in SAME) and all(a < b for a, b in pairs)


def test_several_people_possible(spark):
    rows = [("Michael Stuzendov",), ("Margaret Stuzendov",), ("M. Stuzendov",), ("mstuzendov",), ("J. Alone",), ("Alone, J.",), ("jalone",)]
    got = {r.spelling: r.entity for r in N.resolve(spark.createDataFrame(rows, "author string"), "author").collect()}
    assert got["Michael Stuzendov"] != got["Margaret Stuzendov"]
    assert got["M. Stuzendov"] not in (got["Michael Stuzendov"], got["Margaret Stuzendov"])
    assert got["J. Alone"] == got["Alone, J."] == got["jalone"]


def entities(spark, names):
    return {r.spelling: r.entity for r in N.resolve(spark.createDataFrame([(n,) for n in names], "author string"), "author").collect()}


def test_errors_make_no_chains(spark):
    got = entities(spark, ["Anna Martin", "Anna Marton", "Anna Barton", "Anna Burton"] + ["Ella Stuzendov"] * 9 + ["Ella Stuzendo", "Ella Stuzendof", "Michael Binokura", "Micheal Binokrua", "Anna Rossi", "Anne Rossi"])
    assert len({got[n] for n in got if n.startswith("Anna")}) == 5 and got["Anna Rossi"] != got["Anne Rossi"]
    assert len({got[n] for n in got if n.startswith("Ella")}) == 1 and got["Michael Binokura"] == got["Micheal Binokrua"]


def test_shortened_names(spark):
    got = entities(spark, ["International Business Machines", "Int. Business Machines", "Intern. Business Machines", "Rodrigo Vane", "Rod. Vane", "Vane, Rod.", "Roderick Other", "Rodney Same", "Roderick Same", "Rod. Same"])
    assert got["International Business Machines"] == got["Int. Business Machines"] == got["Intern. Business Machines"]
    assert got["Rodrigo Vane"] == got["Rod. Vane"] == got["Vane, Rod."] != got["Roderick Other"]
    assert len({got[n] for n in ("Rodney Same", "Roderick Same", "Rod. Same")}) == 3


def test_merged_profiles_match_again(spark):
    """A nickname that has found its person lends its misspelt surname to the person, and what is near that joins in a later round."""
    got = entities(spark, ["Alexander Probustidis", "A. Probustidis", "aprobustidis", "Alex Probustidsi", "Bob Drivovov", "Robert Drivovov", "B. Drivovov", "rdrivovov"])
    assert len({v for k, v in got.items() if "rob" in k and "Bob" not in k and "Robert" not in k}) == 1
    assert got["B. Drivovov"] == got["Bob Drivovov"] == got["rdrivovov"]


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "author string")
    assert N.resolve(df, "author").count() == 0


@pytest.mark.parametrize("text, want", [("", None), ("...", None), ("Dr. Ann Lee", ("full", "ann", "lee")), ("A. Lee", ("init", "a", "lee")), ("alee", ("handle", "alee", "")), ("Foo Labs", ("org", "foo", "laboratories")), ("Foo [bot]", ("org", "foo", "bot")), ("Chris Nolanov", ("nick", "chris", "nolanov")), ("Foo Inc", ("org", "foo", ""))])
def test_forms(text, want):
    assert N.read_form(text) == want
