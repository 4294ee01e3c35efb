import pytest

from docgraph.llm.license_scan import RULES, SENTENCES, rule_pattern, scan_licenses

MIT = """MIT License
Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.
"""
BSD = ". ".join(k for k, v in SENTENCES.items() if v.startswith("bsd")) + "."


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string").repartition(3)
    return {r.doc_id: r for r in scan_licenses(df).collect()}


def test_rules(spark):
    out = scan(spark, [
        (1, MIT), (2, "prose. Licensed under the Apache License, Version 2.0. More prose.\nAll rights reserved."), (3, BSD), (4, None), (5, ""), (6, "no such words"),
        (7, "Licensed under our own licence."), (8, "Permission is everything.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."),
        (9, "word " * 60000 + "\nThis work is licensed under the GNU General Public License, version 3."),
    ])
    assert out[1].sentence_ids == "mit-title,mit-grant,mit-keep,mit-as-is" and out[1].licenses == "MIT" and out[1].unknown == 1
    assert out[2].licenses == "Apache-2.0,All-Rights-Reserved"
    assert out[3].licenses == "BSD-3-Clause"
    for i in (4, 5, 6):
        assert (out[i].sentence_ids, out[i].licenses, out[i].critical, out[i].unknown) == ("", "", 0, 0)
    assert out[7].licenses == "" and out[7].unknown == 1
    assert out[8].licenses == "CC-BY-NC-4.0" and out[8].sentence_ids == "cc-by-nc-4-notice,cc-by-nc-4-notice" and out[8].unknown == 1
    assert out[None].licenses == "MIT" and out[9].licenses == "GPL-3.0"


def test_order_matters(spark):
    keys = [k for k, v in SENTENCES.items() if v in ("mit-grant", "mit-keep", "mit-as-is")]
    out = scan(spark, [(1, "\n".join(keys)), (2, "\n".join(reversed(keys)))])
    assert out[1].licenses == "MIT" and out[2].licenses == ""


def test_tables_and_plan(spark):
    assert {i for _, ids in RULES for i in ids} <= set(SENTENCES.values())
    assert rule_pattern(("a", "b")) == ",a,(.*,)?b,"
    df = spark.createDataFrame([], "doc_id long, text string")
    out = scan_licenses(df)
    assert out.count() == 0 and not any(w in out._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize(
    "text, licenses",
    [
        ("This project is not released under the MIT License.", ""),
        ("It is no longer licensed under the MIT License.", ""),
        ("It is released under the MIT License, not proprietary terms.", "MIT"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
        ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
        ("SPDX-License-Identifier: (BSD-3-Clause AND OFL-1.1)", "BSD-3-Clause,OFL-1.1"),
        ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ],
)
def test_denials_and_tag_expressions(spark, text, licenses):
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sorted(row.licenses.split(",")) == sorted(licenses.split(","))


def test_ten_thousand_notices_in_one_text(spark):
    import time

    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    began = time.time()
    row = scan_licenses(spark.createDataFrame([(1, notice * 10_000)], "doc_id long, text string")).first()
    assert row.licenses == "" and row.critical == 20_000 and time.time() - began < 60
