"""Work that must not grow with every character, row or pair."""

from lexforge.functions import text as X
from lexforge.operators import geography as G


def counted(monkeypatch, module):
    calls = []
    plain = X.fold_text

    def fold_text(t):
        calls.append(t)
        return plain(t)

    monkeypatch.setattr(module, "fold_text", fold_text)
    return calls


def test_a_long_text_is_folded_as_a_whole(monkeypatch):
    calls = counted(monkeypatch, X)
    monkeypatch.setattr(X, "_FOLDS", X._Folds())
    text = "Færgen  går\u00ad over Øresund. " * 500
    folded, origin = X.fold_with_origin(text)
    assert len(calls) <= len(set(text))
    assert folded == "".join(X.fold_text(c) for c in text) and len(origin) == len(folded)
    assert text[origin[folded.index("oeresund")]] == "Ø" and [int(o) for o in origin[:4]] == [0, 1, 1, 2]


def test_places_fold_a_long_text_as_a_whole(monkeypatch):
    where = G.Gazetteer({"sund": ["over Øresund"]})
    calls = counted(monkeypatch, X)
    text = "Færgen  går \n over \u00a0 Øresund. " * 500
    found = where.find(text)
    assert len(calls) <= len(set(text)) and len(found) == 500
    assert found[0][2] == "over \u00a0 Øresund" and all(text[f[5] : f[6]] == f[2] for f in found)
    folded, origin = G._spaced(" \n\u2003a\u00adå\t b")
    assert folded == " aaa b" and [int(o) for o in origin] == [0, 3, 5, 5, 6, 8]
