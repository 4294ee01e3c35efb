"""Alignment against comparing the byte ranges of the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from docgraph.llm import alignment  # noqa: E402
from docgraph.llm.alignment import aligned, alignment_counts  # noqa: E402
from docgraph.llm.queries import QUERIES  # noqa: E402
from docgraph.llm.shared import arrow_rows  # noqa: E402

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(rows):
    a_model = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    byte_of = letters()
    a_bytes = lambda i: bytes(byte_of[c] for c in a_model.id_to_token(i))
    def b_bytes(i):
        return bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            raw = (" " + text).encode()
            if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
                a, b = [], []
        i = j = x = y = 0
        group = ([], [])
        while i < len(a):
            la, lb = len(a_bytes(a[i])), len(b_bytes(b[j]))
            links.append((a[i], b[j]))
            ends = x + la, y + lb
            if ends[0] <= ends[1]:
                group[0].append(a[i])
                i, x = i + 1, ends[0]
            if ends[1] <= ends[0]:
                group[1].append(b[j])
                j, y = j + 1, ends[1]
            if x == y:
                groups.append(group)
                group = ([], [])
        counts.update(set(links))
        docs.append((doc_id, a, b, groups, links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=repr), {d: groups for d, _, _, groups, _ in docs}


def texts():
    r = random.Random(3)
    parts = ["word", "Words,", "the", "straße", "中文", "😀", "don't", "\n", "\n\n", "\t", " ", "  ", "a", "=" * 40, "http://x.org/?q=1", "é", "\x00", "ﬁ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "1234567"]
    out = ["", None, " ", "\n", "a", " a", "a ", "a\n b", "   lead", "▁ mark", "mid ▁dle", "=" * 300, "<|endoftext|>", "x<|endoftext|>y"]
    return out + ["".join(r.choice(parts) + r.choice([" ", " ", ""]) for _ in range(r.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("block", [300, 8 << 20])
def test_counts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "GROUP_BYTES", max(200, block // 4))
    rows = [*enumerate(texts()), (None, "no id"), (5, "again"), (5, "again"), (9000, "a long text of words " * 20_000)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, block int, pair int, n int").repartition(3)
    want, groups = brute(rows)
    assert sorted(map(tuple, alignment_counts(df).select(*COLUMNS).collect()), key=repr) == want
    for row in aligned(df.where("doc_id < 200 AND doc_id <> 5")).collect():
        assert [(g.a, g.b) for g in row.groups] == groups[row.doc_id]


def test_no_rows_and_text_ids(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert alignment_counts(df).collect() == []
    df = spark.createDataFrame([("x", "two words"), ("y", None)], "doc_id string, text string")
    assert sorted(map(tuple, alignment_counts(df).select(*COLUMNS).collect())) == brute([("x", "two words"), ("y", None)])[0]


def test_spans_end_at_bytes_where_both_end():
    labels = np.array([0, 1, 3, 2, 0, 1, 3, 3], np.uint8)
    ends, a, b = alignment.spans(labels)
    assert ends.tolist() == [3, 7, 8] and a.tolist() == [2, 2, 1] and b.tolist() == [1, 2, 1]


def test_the_query_equals_brute_force_on_the_smallest_tables(spark):
    from conftest import DATA

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()]
    found = QUERIES["op12_byte_label_alignment"](spark, str(DATA)).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)[0]


def test_a_reader_decodes_one_block_at_a_time(spark, monkeypatch):
    """Blocks are rows of megabytes, and a reader decodes a row group at once, so each has a group of its own."""
    import pyarrow.parquet as pq

    saved = []
    save = alignment.save
    monkeypatch.setattr(alignment, "save", lambda *a, **b: saved.append(save(*a, **b)) or saved[-1])
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    docs = spark.createDataFrame([(i, f"words of text {i} " * 12) for i in range(40)], "doc_id long, text string").coalesce(1)
    with arrow_rows(spark, 2):
        assert alignment_counts(docs).count() == 40
    groups = [m.row_group(k).num_rows for f in saved[0].inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for k in range(m.num_row_groups)]
    assert len(groups) > 10 and set(groups) == {1}
