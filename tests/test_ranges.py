"""Split JSON arrays and delimited files against one stream over the file."""

import csv
import gzip
import io
import json
import random

import pytest
from pyspark.errors import PySparkException

from docgraph.sources import ranges
from docgraph.sources.documents import json_elements, read_delimited, read_json_array


def array(seed, size):
    r = random.Random(seed)
    atoms = ["a,b", "[", "]}", 'say "x"', "\\", '\\"', "é中😀", "", "{", "\n", '","', "\\\\"]
    value = lambda depth: r.choice(atoms) if depth == 0 or r.random() < 0.4 else ([value(depth - 1) for _ in range(r.randrange(4))] if r.random() < 0.5 else {r.choice(atoms): value(depth - 1)})
    items = [json.dumps({"k": k, "v": value(3), "\\": r.choice(atoms)}, ensure_ascii=False) for k in range(size)]
    return " \n[" + ",".join(r.choice(["", " ", "\n"]) + x + r.choice(["", " "]) for x in items) + "] \n"


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_arrays_are_read_as_one_stream_reads_them(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "RANGE_BYTES", size)
    texts = {"a.json": array(1, 60 if size > 7 else 8), "b.json": array(2, 5), "c.json": "[]", "d.json": "[1,,2,]" + " " * 90, "e.json": '["' + "\\\\" * 400 + '", "' + '\\"' * 300 + '"]'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "f.json.gz").write_bytes(gzip.compress(texts["a.json"].encode()))
    texts["f.json.gz"] = texts["a.json"]
    got: dict[str, list] = {}
    for row in read_json_array(spark, str(tmp_path), place=True).collect():
        got.setdefault(row.file.rpartition("/")[2], []).append((row.file_start, row.line, row.doc))
    assert {n: [d for *_, d in sorted(x)] for n, x in got.items()} == {n: x for n, t in texts.items() if (x := list(json_elements(t)))}
    one = sorted((r.ordinal, r.doc) for r in read_json_array(spark, str(tmp_path / "a.json")).collect())
    assert one == list(enumerate(json_elements(texts["a.json"]), 1))


@pytest.mark.parametrize("bad", ['[{"a":1},{"b":2}', '{"a":[1]}' + " " * 40, '[1,2] tail' + " " * 40, '[{"a":"x},{"b":2}]', '[1,{"a" 2},3]' + " " * 40])
def test_what_is_no_array_fails(spark, tmp_path, monkeypatch, bad):
    monkeypatch.setattr(ranges, "RANGE_BYTES", 10)
    (tmp_path / "x.json").write_text(bad)
    with pytest.raises(PySparkException):
        read_json_array(spark, str(tmp_path)).collect()


def table(seed, size, irregular):
    r = random.Random(seed)
    cells = ["a", "", "two\nlines", 'say "hi"', "x,y", "é", "\r\n", '"', '","', "\n\n", "long " * 9]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
    writer.writerow(["p", "q", "r"])
    for _ in range(size):
        writer.writerow([r.choice(cells) for _ in range(r.choice((3, 3, 3, 2, 4)))])
    return out.getvalue() + ('bare"quote,1,"x\ny"\nb,c,d\n' if irregular else "")


@pytest.mark.parametrize("size", [11, 90])
@pytest.mark.parametrize("irregular", [False, True])
def test_records_over_lines_are_read_as_one_stream_reads_them(spark, tmp_path, monkeypatch, size, irregular):
    monkeypatch.setattr(ranges, "RANGE_BYTES", size)
    for name, count in (("a.csv", 50 if size > 11 else 12), ("b.csv", 3)):
        (tmp_path / name).write_text(table(len(name) + count, count, irregular), newline="")
    rows = read_delimited(spark, str(tmp_path), multi_line=True, place=True)
    got: dict[str, list] = {}
    for row in rows.collect():
        got.setdefault(row["__place"].file.rpartition("/")[2], []).append((row["__place"].file_start, row["__place"].line, [row.p, row.q, row.r]))
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, newline="") as text:
            want = [[*x[:3], *[None] * (3 - len(x))] for x in list(csv.reader(text))[1:] if x]
        assert [x for *_, x in sorted(got[name], key=lambda y: y[:2])] == want
    splits = {r.whole for r in ranges.chunks(spark, str(tmp_path), json=False).where("path LIKE '%a.csv'").collect()}
    assert splits == {irregular}
