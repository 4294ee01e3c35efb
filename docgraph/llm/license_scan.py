"""Licence recognition by sentences, with DataFrame functions only.

Wrapped lines are joined, without comment and list markers, and a text is split into sentences; those
with a critical word are normalised (ASCII lower case, other characters than letters and digits as one space)
and searched for known licence sentences, which map to identifiers.  The identifiers, in order of
appearance, are matched against licence rules: ordered identifier sequences that
may have others between them, followed in one pass of a pointer a rule.  A notice after a negation does not count.  A rule also names the rules it implies, which are
then not reported again.  Everything is a projection of the row; nothing is
shuffled, whatever the length of a text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied": "mit-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-no-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "apache license version 2 0 january 2004": "apache2-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost-grant",
    "distributed under the boost software license version 1 0": "boost-notice",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl-freedom",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license": "lgpl3-preamble",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works": "agpl3-preamble",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "mozilla public license version 2 0": "mpl2-title",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-notice",
    "the contents of this file are subject to the mozilla public license version 1 1": "mpl11-notice",
    "creative commons attribution 4 0 international public license": "cc-by-4-title",
    "creative commons attribution sharealike 4 0 international public license": "cc-by-sa-4-title",
    "creative commons attribution noncommercial 4 0 international public license": "cc-by-nc-4-title",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-notice",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-notice",
    "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights": "cc0-preamble",
    "has waived all copyright and related or neighboring rights to": "cc0-notice",
    "eclipse public license v 2 0": "epl2-title",
    "are made available under the terms of the eclipse public license 2 0": "epl2-notice",
    "the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl1-notice",
    "sil open font license version 1 1 26 february 2007": "ofl11-title",
    "this font software is licensed under the sil open font license version 1 1": "ofl11-notice",
    "the artistic license 2 0": "artistic2-title",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "python software foundation license version 2": "psf2-title",
    "licensed under the eupl": "eupl-notice",
    "european union public licence v 1 2": "eupl12-title",
    "common development and distribution license cddl version 1 0": "cddl1-title",
    "common development and distribution license cddl version 1 1": "cddl11-title",
    "licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4-notice",
    "creative commons attribution noderivatives 4 0 international public license": "cc-by-nd-4-title",
    "all rights reserved": "all-rights-reserved",
    "this work is in the public domain": "public-domain",
}

# Licences by the ordered identifiers that show them, longest first.
RULES = (
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-notice",)),
    ("AGPL-3.0", ("agpl3-title", "agpl3-preamble")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-3.0", ("lgpl3-title", "lgpl3-preamble")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.1", ("lgpl21-title", "gpl-freedom")),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("GPL-3.0", ("gpl3-title", "gpl3-preamble")),
    ("GPL-2.0", ("gpl2-title", "gpl-freedom")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-no-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("MPL-1.1", ("mpl11-notice",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-preamble",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-title",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-title",)),
    ("CC-BY-4.0", ("cc-by-4-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("OFL-1.1", ("ofl11-title",)),
    ("OFL-1.1", ("ofl11-notice",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("PSF-2.0", ("psf2-title",)),
    ("EUPL-1.2", ("eupl12-title",)),
    ("CDDL-1.1", ("cddl11-title",)),
    ("CDDL-1.0", ("cddl1-title",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-title",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("all-rights-reserved",)),
)
# What a sequence of identifiers shows besides, and is not reported: a text that quotes the usual notices.
IMPLIED = {
    ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"): ("BSD-2-Clause",),
    ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"): ("BSD-3-Clause",),
    ("gpl3-title", "gpl3-preamble"): ("GPL-3.0-or-later",),
    ("gpl2-title", "gpl-freedom"): ("GPL-2.0-or-later",),
    ("agpl3-title", "agpl3-preamble"): ("AGPL-3.0-or-later",),
    ("lgpl21-title", "gpl-freedom"): ("LGPL-2.1-or-later",),
    ("mpl2-title",): ("MPL-1.1",),
}


def _spdx(names: tuple[str, ...]) -> tuple[dict[str, str], tuple]:
    """Sentences and rules of the tags ``SPDX-License-Identifier: <name>``, for these names and their usual variants."""
    tagged = {}
    for name in dict.fromkeys(names):
        for given in (name, f"{name}-only") if re.fullmatch("[AL]?GPL-[0-9.]+", name) else (name,):
            tagged["spdx license identifier " + " ".join(re.findall("[a-z0-9]+", given.lower()))] = (f"spdx-{given.lower()}", given)
    return {k: i for k, (i, _) in tagged.items()}, tuple((name, (i,)) for i, name in tagged.values())


# Names that are known from tags alone.
TAGGED = ("AFL-3.0", "Apache-1.1", "Artistic-1.0", "BlueOak-1.0.0", "CC-BY-3.0", "CC-BY-SA-3.0", "CECILL-2.1", "EUPL-1.1", "GPL-1.0", "LGPL-2.0", "MIT-0", "MS-PL", "NCSA", "OpenSSL", "PostgreSQL", "Python-2.0", "WTFPL", "X11")
TAGS, TAG_RULES = _spdx((*(name for name, _ in RULES if name not in ("Public-Domain", "All-Rights-Reserved")), *TAGGED))
SENTENCES |= TAGS
RULES += TAG_RULES

CRITICAL = r"(?i)licen[cs]e|copyright|all rights reserved|permission|warrant|redistribut|public domain|as is"
TAG = "spdx license identifier"
#: What stands before a notice that is denied.
DENIED = r"(?<!\b(?:not|never|no longer|neither|nor|not yet|not been|never been|not be|longer be) )"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The same where lines may be wrapped.
ANYWHERE = CRITICAL.replace(" ", "[^A-Za-z0-9]+")
END = r"(?>\r\n|\r|\n)"
#: Lines that state a copyright stand alone.
STATED = r"(?=Copyright (?:\([cC]\)|\u00a9|[0-9]))"
CUT = "\0"


def sentences(text: Column) -> Column:
    """Sentences of a text: cut at lines without letters or digits, and after a full stop, question or exclamation mark before white space."""
    cut = F.regexp_replace(text, rf"{END}[^\p{{L}}\p{{N}}\r\n]*(?:{END}|{STATED})", CUT)
    joined = F.regexp_replace(cut, rf"[ \t]*{END}[^\p{{L}}\p{{N}}\r\n\x00]*", " ")
    return F.split(F.regexp_replace(joined, r"([.!?])[ \t]+", "$1" + CUT), CUT)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def critical_sentences(text: Column) -> Column:
    found = F.transform(F.filter(sentences(text), lambda s: s.rlike(CRITICAL)), normalised)
    return F.when(text.rlike(ANYWHERE), F.filter(found, lambda s: s != "")).otherwise(F.array().cast("array<string>"))


def notices(sentence: Column, known: dict[str, str]) -> Column:
    """The known sentences within a normalised one, from left to right, the longest where several begin; none that it denies.

    Every name of a tag's expression is a tag of its own.
    """
    pattern = DENIED + r"\b(?:" + "|".join(sorted(known, key=len, reverse=True)) + r")\b" if known else "(?!)"
    spread = F.when(F.startswith(sentence, F.lit(TAG)), F.regexp_replace(sentence, " (?:or(?! later)|and|with) ", f" {TAG} ")).otherwise(sentence)
    return F.regexp_extract_all(spread, F.lit(pattern), F.lit(0))


def shown(ids: Column, rule: tuple[str, ...]) -> Column:
    """Whether the identifiers of a rule appear in its order, with or without others between: one pass that waits for one after another."""
    wanted = F.array(*map(F.lit, rule))
    met = F.aggregate(ids, F.lit(0), lambda at, x: F.when((at < len(rule)) & (F.try_element_at(wanted, at + 1) == x), at + 1).otherwise(at))
    return F.array_contains(ids, rule[0]) & (met == len(rule)) if len(rule) > 1 else F.array_contains(ids, rule[0])


def rule_pattern(ids: tuple[str, ...]) -> str:
    """The same as a regular expression, for the SQL that the query is held against."""
    return "," + ",(.*,)?".join(ids) + ","


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: tuple = RULES) -> DataFrame:
    """Per row: doc_id, sentence_ids and licenses (comma-joined), critical and unknown (counts of sentences).

    ``sentence_ids`` keeps order and repetitions; ``licenses`` lists each matched
    licence once, in rule order.  A null or empty text, or one without critical
    words, gives empty strings and zeros; null ids are carried through; repeated rows
    give a row each; an empty table gives no rows; other columns are not read.
    """
    table = SENTENCES if known is None else known
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), critical_sentences(text).alias("found"))
    rows = rows.withColumn("within", F.transform("found", lambda s: notices(s, table)))
    rows = rows.withColumn("ids", F.transform(F.flatten("within"), lambda s: F.try_element_at(lookup, s)))
    none = F.array().cast("array<string>")
    matched = F.array(*[F.when(shown(F.col("ids"), ids), F.lit(name)) for name, ids in rules])
    rows = rows.withColumn("all", F.when(F.size("ids") > 0, F.array_distinct(F.array_compact(matched))).otherwise(none))
    implied = F.flatten(F.array(*[F.when(shown(F.col("ids"), ids), F.array(*map(F.lit, less))).otherwise(none) for ids, less in IMPLIED.items()]))
    implied = F.when(F.size("ids") > 0, implied).otherwise(none)
    return rows.select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_except("all", implied), ",").alias("licenses"),
        F.size("found").cast("long").alias("critical"), F.size(F.filter("within", lambda w: F.size(w) == 0)).cast("long").alias("unknown"),
    )


def oracle() -> str:
    """The same in DuckDB SQL where known sentences stand alone on their lines, as in the driver's tables."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    keys, values = ", ".join(map(quote, SENTENCES)), ", ".join(map(quote, SENTENCES.values()))
    names = ", ".join(f"CASE WHEN regexp_matches(sequence, {quote(rule_pattern(ids))}) THEN {quote(name)} END" for name, ids in RULES)
    drop = " ".join(f"WHEN x = {quote(less)} AND regexp_matches(sequence, {quote(rule_pattern(ids))}) THEN false" for ids, all_less in IMPLIED.items() for less in all_less)
    critical = quote(CRITICAL)
    return rf"""
        WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS (SELECT doc_id, CASE WHEN regexp_matches(t, {critical}) THEN
                list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(t, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+'),
                  lambda x: regexp_matches(x, {critical})),
                  lambda x: trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '')
                ELSE CAST([] AS VARCHAR[]) END AS found FROM s),
        i AS (SELECT doc_id, found, list_filter(list_transform(found, lambda x: map([{keys}], [{values}])[x]), lambda x: x IS NOT NULL) AS ids FROM f),
        q AS (SELECT *, ',' || coalesce(array_to_string(ids, ','), '') || ',' AS sequence FROM i),
        r AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS every FROM q),
        d AS (SELECT *, list_filter(list_transform(range(1, len(every) + 1), lambda k: CASE WHEN list_position(every, every[k]) = k THEN every[k] END), lambda x: x IS NOT NULL) AS once FROM r)
        SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
               coalesce(array_to_string(list_filter(once, lambda x: CASE {drop} ELSE true END), ','), '') AS licenses,
               CAST(len(found) AS BIGINT) AS critical, CAST(len(found) - len(ids) AS BIGINT) AS unknown FROM d"""
