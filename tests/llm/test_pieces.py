import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lexforge.llm import queries
from lexforge.llm.pieces import checked, encode, encoder
from tests.llm.fixtures import SF, no_docs, odd_docs, odd_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        model = checked(f.read())
    return encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def agree(both, text):
    own, library = both
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True), text
    assert own.decode(ids) == library.decode(library.encode(text))


def test_random_texts(both):
    r = random.Random(5)
    pool = "  \n\t▁aeionrst.,!?'\"()[]{}<>/\\=_-:;#$%&*0123456789éüñ日本語\U0001f600ﬁÅ　\0"
    for _ in range(1500):
        agree(both, "".join(r.choices(pool, k=r.randint(0, 40))))
    pieces = list(both[0].ids)
    for _ in range(1500):
        agree(both, "".join(r.choices(pieces, k=r.randint(0, 12))))
    for n in range(70):
        agree(both, " " * n)
        agree(both, "a" + " " * n + "b")
        agree(both, "aB" * n)


def test_marks_after_superscripts_and_fractions(both):
    agree(both, "an area of 40 km². The next m², m³. and x¹, ½. ¼, Ⅳ. a²b. (c²)")
    alone = sorted({c for p in both[0].ids for c in p if c.isnumeric() and not c.isdecimal()})
    for c in alone:
        for mark in map(chr, range(33, 127)):
            agree(both, f"km{c}{mark} The {c}{mark}{mark}x")
    assert any(len(p) > 1 and p[0] in alone and p[1] in ".,)" for p in both[0].ids)
    assert both[0].cut.findall("▁a▁b") == ["▁a", "▁b"]


def test_backtracking_alone(both):
    own, library = both
    for text in ("▁unbelievably", "▁" * 37, "▁aaaaaaaaaaaaaaaaaaaaa", "▁thththththe"):
        assert [own.ids[p] for p in own.merge(text)] == own.encode_part(text)


def test_other_models_are_refused():
    with pytest.raises((ValueError, KeyError, IndexError)):
        checked(b"\x12\x02\x18\x01\x1a\x02\x18\x01")


def test_odd_documents(spark, both):
    texts = [t or "" for _, t, *_ in odd_texts()]
    rows = encode(spark, odd_docs(spark), PATH).collect()
    assert [r.ids for r in rows] == [both[1].encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [r.decoded for r in rows] == [both[1].decode(both[1].encode(t)) for t in texts]
    assert encode(spark, no_docs(spark), PATH).count() == 0


def test_query(spark, both):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = both[1].encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()
