import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from docgraph.llm.byte_bpe import ByteBpe  # noqa: E402
from docgraph.llm.packing import SumOfSquares, pack_documents  # noqa: E402


def texts():
    r = random.Random(11)
    pieces = ["word", "Word.", "a,b", "l'été", "don't", "中文字", "123", "4,5", "\n", "\n\n", "\t", "  ", " \n", "\r\n", "!?", "...", "x y", "　", "naïve;", "q:", "<|endoftext|>", "😀", "\x1c"]
    out = [None, "", " ", "  ", "a", " a", "a ", "\n a", "a \n b", "a  b", "a\n\n b", "x" * 500]
    for _ in range(300):
        out.append(r.choice(["", " "]).join(r.choice(pieces) + r.choice([" ", " ", " ", ""]) for _ in range(r.randint(1, 60))))
    out += ["word one two. three, " * 900, "long" * 6000]
    return out


def test_ids_equal_the_tokenizers_library():
    encoder = ByteBpe.of(None)
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for _ in range(2):  # cold and warm
        for text in texts():
            assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_level_minimises_the_sum_of_squares():
    r = random.Random(2)
    packer = SumOfSquares(16)
    for _ in range(400):
        size = r.randint(1, 15)

        def cost(level):
            counts = packer.counts.copy()
            if level:
                counts[level] -= 1
            if level + size < 16:
                counts[level + size] += 1
            return int((counts**2).sum())

        options = [x for x in range(0, 17 - size) if x == 0 or packer.counts[x]]
        chosen = packer.level_for(size)
        assert chosen in options and cost(chosen) == min(map(cost, options))
        packer.place((0, np.zeros(size, "<u4"), 0, size))


def test_every_id_lies_in_one_piece(spark):
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, ids string").repartition(3)
    out = pack_documents(df, with_ids=True).collect()
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in out:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        pieces[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    for key, text in rows:
        parts = sorted(pieces[key], key=lambda p: p.start)
        expected = whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert sum((list(p.ids) for p in parts), []) == expected
        assert all(p.doc_tokens == len(expected) for p in parts) and [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
    short = 0
    for parts in windows.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        total = sum(p.length for p in parts)
        assert total <= 1024
        short += total < 1024
    assert short <= 3  # one for each task
    assert pack_documents(df.limit(0)).count() == 0


def test_other_tokenizers_go_through_the_library(tmp_path):
    import json
    import random
    from array import array

    import public_tokenizers as public
    from tokenizers import Tokenizer

    from docgraph.llm.byte_bpe import ByteBpe

    settings = json.loads(Tokenizer.from_file(public.path("byte_bpe_50k.json")).to_str())
    assert ByteBpe(None).usual
    r = random.Random(2)
    texts = ["".join(r.choice(["Word", " the", "  ", "\n", "é", "don't", "42", "ß", " and"]) for _ in range(40)) for _ in range(200)]
    lower = {**settings, "normalizer": {"type": "Lowercase"}}
    prefixed = {**settings, "pre_tokenizer": {**settings["pre_tokenizer"], "add_prefix_space": True}}
    merges = settings["model"]["merges"]
    turned = {**settings, "model": {**settings["model"], "merges": [*merges[:2000][::-1], *merges[2000:]]}}
    for k, other in enumerate((lower, prefixed, turned)):
        path = str(tmp_path / f"{k}.json")
        (tmp_path / f"{k}.json").write_text(json.dumps(other))
        fast, library = ByteBpe(path), Tokenizer.from_file(path)
        assert not fast.usual
        assert all(array("I", fast.encode(t)).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)
