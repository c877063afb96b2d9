import pytest

from strata import contract_queries as C
from strata.functions.symbols import LANGUAGES, extract


@pytest.mark.parametrize("lang", C.SOURCES)
def test_own_sources(lang):
    found = extract(C.SOURCES[lang], lang)
    if lang not in LANGUAGES:
        assert found is None
        return
    assert [(s.name, s.kind, *s.at, s.parent, s.signature, s.return_type, s.params) for s in found.symbols] == [r[2:] for r in C.SYMBOLS if r[0] == lang]
    assert [(r.name, r.kind, *r.at, r.inside) for r in found.refs] == [r[2:] for r in C.CALLS if r[0] == lang]


def test_unreadable_texts():
    assert len(LANGUAGES) == 9 and extract("def broken(:", "python").symbols == []
    for lang in LANGUAGES:
        assert extract("", lang).symbols == []
        extract("((((((" * 50 + "}}}]" + "\"'`/*", lang)
