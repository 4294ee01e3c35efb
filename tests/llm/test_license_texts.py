"""Official licence texts as they are usually wrapped, and notices within longer sentences."""

from pathlib import Path

import pytest

from docgraph.llm.license_scan import scan_licenses

#: Whole official texts that the system ships.
SHIPPED = Path("/usr/share/common-licenses")
WHOLE = {
    "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0",
    "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause,All-Rights-Reserved", "Artistic": "", "GFDL-1.3": "",
}
ISC = """Copyright (c) 2020 Someone <a@b.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
ZLIB = """/* This software is provided 'as-is', without any express or implied
 * warranty.  In no event will the authors be held liable for any damages
 * arising from the use of this software.
 *
 * Permission is granted to anyone to use this software for any purpose,
 * including commercial applications, and to alter it and redistribute it
 * freely, subject to the following restrictions:
 *
 * 1. The origin of this software must not be misrepresented.
 */
"""
OTHERS = [
    (ISC, "ISC"), (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "0BSD"), (ZLIB, "Zlib"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.", "Unlicense"),
    ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-SA-4.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See the copy)", "BSL-1.0"),
    # Near misses.
    ("SPDX-License-Identifier: LicenseRef-Ours", ""), ("Licensed under the Apache Software License, Version 1.1.", ""), (ISC.split("THE SOFTWARE")[0], ""),
    ("Permission is hereby granted, for a fee, to any person obtaining a copy of this software.", ""), ("The GNU General Public License is long.", ""),
]


def test_whole_shipped_texts(spark):
    found = {n: (SHIPPED / n).read_text(errors="replace") for n in WHOLE if (SHIPPED / n).exists()}
    if not found:
        pytest.skip("no licence texts on this system")
    names = list(found)
    rows = [(i, found[n]) for i, n in enumerate(names)] + [(100 + i, " ".join(found[n].split())) for i, n in enumerate(names)]
    out = {r.doc_id: r.licenses for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {n: out[i] for i, n in enumerate(names)} == {n: WHOLE[n] for n in names}
    assert {n: out[100 + i] for i, n in enumerate(names)} == {n: WHOLE[n] for n in names}


def test_other_texts_tags_and_near_misses(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OTHERS)], "doc_id long, text string")
    out = {r.doc_id: r.licenses for r in scan_licenses(df).collect()}
    assert [out[i] for i in range(len(OTHERS))] == [name for _, name in OTHERS]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""


def test_wrapped_texts_and_notices_in_sentences(spark):
    rows = [(1, MIT), (2, APACHE), (3, BSD), (4, GPL), (5, "This project is licensed under the MIT License."), (6, "(c) X, all rights\r\n// reserved"), (7, MIT.replace("\n", "\r\n"))]
    out = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k].licenses for k in range(1, 8)] == ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0-or-later", "MIT", "All-Rights-Reserved", "MIT"]
    assert out[2].sentence_ids == "apache2-notice,apache2-compliance,apache2-copy,apache2-as-is,apache2-see"
    assert out[4].sentence_ids == "gpl3-later,gpl-no-warranty,gpl-details"
