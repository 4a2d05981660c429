import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from tests.llm.fixtures import SF, no_docs, odd_docs, odd_texts
from tests.llm.test_simhash import brute_near
from tests.llm.test_substring import brute as brute_substrings

cp = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept; language ID and mixing have their own tests and are taken as they come."""
    import hashlib

    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, outs[-1], SF).write.parquet(f"{tmp_path}/{i}")
        outs.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(o.columns == docs.columns for o in outs[:-1])
    rows = [o.collect() for o in outs]
    assert len(rows[1]) >= 0.98 * len(rows[0])
    given = sorted(rows[1], key=lambda r: r.doc_id)
    kept = {given[i].doc_id for i in brute_near([r.text for r in given])}
    assert sorted(r.doc_id for r in rows[2]) == sorted(kept)
    given = sorted(rows[2], key=lambda r: r.doc_id)
    for r, g, b in zip(sorted(rows[3], key=lambda r: r.doc_id), given, brute_substrings([g.text for g in given]), strict=True):
        assert r.text == (b[3] if b[1] else g.text) and r.n_chars == len(r.text)
    assert {(r.doc_id, r.text) for r in rows[4]} == {(r.doc_id, r.text) for r in rows[3]} and max(Counter(r.doc_id for r in rows[4]).values()) <= 2
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, hashlib.sha256(np.array(library.encode(r.text, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()) for r in rows[4])
    assert Counter((r.doc_id, r.ids_sha256) for r in rows[5]) == want
    assert cp.run(spark, SF).count() == len(rows[5])


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, further columns with any names, and no rows at all: each stage keeps its columns."""
    odd, none = odd_docs(spark), no_docs(spark)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        kept[name] = out.count()
        assert stage(spark, none, SF).count() == 0, name
    letters = sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in odd_texts())
    assert kept["language ID"] <= letters
    assert kept["SimHash near-dedup"] == len(set(brute_near([r[1] for r in odd_texts()])))
    assert kept["substring dedup"] == len(odd_texts()) <= kept["mixing sources to target weights"]
    assert cp.STAGES[-1][1](spark, odd, SF).count() == len(odd_texts()) and cp.STAGES[-1][1](spark, none, SF).count() == 0


def test_work_tables_go_with_their_stage(spark):
    """After a run only what its result reads is left, and nothing after release_all."""
    from lexforge.llm.common import Workspace, exists, release_all

    release_all()
    cp.run(spark, SF).count()
    assert len(Workspace.opened) == 1 and exists(spark, Workspace.opened[0].root)
    root = Workspace.opened[0].root
    release_all()
    assert not Workspace.opened and not exists(spark, root)
