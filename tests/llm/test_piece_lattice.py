import random

import pytest

public = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from docgraph.llm.piece_lattice import PieceLattice, decode_ids, encode_texts, encoding_digests  # noqa: E402


def texts():
    r = random.Random(3)
    parts = ["word", "Words,", "the", "straße", "中文", "😀", "don't", "\n", "\n\n", "\t", " ", "  ", "    ", "a", "=" * 40, "http://x.org/?q=1", "é", "\x00", "ﬁ"]
    out = ["", " ", "\n", "a", " a", "a ", "a\n b", "x \n y", "   lead", "▁ mark", "=" * 300]
    out += ["".join(r.choice(parts) + r.choice([" ", " ", ""]) for _ in range(r.randint(1, 80))) for _ in range(300)]
    return out + ["long words here " * 3000, "unbroken" * 4000]


def test_ids_equal_the_sentencepiece_library():
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    lattice = PieceLattice.of(None)
    import numpy as np

    for _ in range(2):  # cold and warm
        for text, packed in zip(texts(), lattice.encode(texts())):
            ids = np.frombuffer(packed, "<i4").tolist()
            assert ids == model.encode(text), repr(text[:80])
            assert lattice.decode(ids) == model.decode(ids), repr(text[:80])


def test_round_trip_and_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (9000, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int").repartition(3)
    encoded = encode_texts(df)
    back = sorted(((r.doc_id, r.text) for r in decode_ids(encoded).collect()), key=repr)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=repr)
    digests = {r.doc_id: r for r in encoding_digests(df).collect()}
    assert digests[9000].n_ids == 0 and digests[9000].round_trip
    assert all(r.round_trip == ("▁" not in texts()[r.doc_id]) for r in digests.values() if r.doc_id is not None and r.doc_id < len(texts()) and r.doc_id != 5)
    assert encode_texts(df.limit(0)).count() == 0


def test_one_unspaced_line_of_a_megabyte():
    import time

    import numpy as np

    r = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    model, lattice = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model")), PieceLattice.of(None)
    line = "".join(r.choice(letters) for _ in range(1_000_000))
    began = time.time()
    packed = lattice.encode([line, "a" * 50_000, "short words"])
    assert time.time() - began < 60
    assert [np.frombuffer(p, "<i4").tolist() for p in packed] == [model.encode(t) for t in (line, "a" * 50_000, "short words")]


def test_models_of_another_kind_are_refused(monkeypatch):
    from docgraph.llm import piece_lattice

    def message(kind, rule):
        return bytes([2 << 3 | 2, 2, 3 << 3, kind]) + bytes([3 << 3 | 2, len(rule) + 2, 1 << 3 | 2, len(rule)]) + rule

    assert piece_lattice.model_settings(message(2, b"identity")) == ("bpe", "identity")
    assert piece_lattice.model_settings(message(1, b"nmt_nfkc")) == ("unigram", "nmt_nfkc")
    monkeypatch.setattr(piece_lattice, "model_settings", lambda proto: ("unigram", "nmt_nfkc"))
    with pytest.raises(ValueError, match="only BPE"):
        PieceLattice(None)
