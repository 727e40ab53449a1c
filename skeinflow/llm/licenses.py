"""Licence scans: sentences become licence-sentence identifiers, identifier sequences become licences.

Texts are cut at line ends and at [.!?;:] before white space, and the pieces
are normalised (A-Z lowered, runs of other characters than a-z and 0-9 made one
space).  A known sentence of the fixed table is a run of whole pieces: the ends
of wrapped lines may lie between any two of its words, a sentence end only
where the sentence itself has one (SPLITS), a blank line nowhere.  Where runs
overlap, the earliest and then the longest counts.  Known sentences between
which nothing lies but blank lines, marks and list numbers make a sequence;
the ordered rules are tried on each sequence of a text, and what a rule matches
is used up, so that a long rule comes before a short one.

Defined results: null and empty texts and texts without known sentences get no
identifiers and no licences; repeated rows each get their own result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import ascii_lower

#: Identifiers of well-known licence sentences, as normalised.
SENTENCES: dict[str, str] = {
    "mit_name": "the mit license",
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache_header": "licensed under the apache license version 2 0",
    "apache_the_license": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_licensed": "licensed under the gnu general public license version 3",
    "gpl2_licensed": "licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl_licensed": "licensed under the gnu lesser general public license version 3",
    "agpl_licensed": "licensed under the gnu affero general public license version 3",
    "mpl_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccby_licensed": "licensed under cc by 4 0",
    "ccbysa_licensed": "licensed under cc by sa 4 0",
    "ccbync_licensed": "licensed under cc by nc 4 0",
    "ccbynd_licensed": "licensed under cc by nd 4 0",
    "ccbyncsa_licensed": "licensed under cc by nc sa 4 0",
    "ccby_work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa_work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0_waive": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_gpl3": "spdx license identifier gpl 3 0 or later",
    "reserved": "all rights reserved",
}

#: Words of known sentences between which the licence's own text may have a sentence end.
SPLITS = [("spdx license identifier", "mit"), ("spdx license identifier", "apache"), ("spdx license identifier", "gpl"), ("mozilla public license v", "2"), ("this program is free software", "you")]

#: A number or letter in a list, as 1. or a.
_MARK = "(?:[0-9]{1,2}|[a-h])"

#: Ordered rules; each is a licence name and the identifiers that follow one another.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit_name", "mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", ("reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("reserved", "bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_the_license", "apache_comply", "apache_copy")),
    ("Apache-2.0", ("apache_header", "apache_comply", "apache_copy")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("ISC", ("isc_grant",)),
    ("MIT", ("mit_released",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("apache_the_license",)),
    ("Apache-2.0", ("apache_header",)),
    ("Apache-2.0", ("apache_basis",)),
    ("Apache-2.0", ("spdx_apache",)),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-3.0-or-later", ("spdx_gpl3",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("GPL-3.0-only", ("gpl3_licensed",)),
    ("GPL-2.0-only", ("gpl2_licensed",)),
    ("LGPL-3.0-only", ("lgpl_licensed",)),
    ("AGPL-3.0-only", ("agpl_licensed",)),
    ("MPL-2.0", ("mpl_subject",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa_licensed",)),
    ("CC-BY-SA-4.0", ("ccbysa_licensed",)),
    ("CC-BY-SA-4.0", ("ccbysa_work",)),
    ("CC-BY-NC-4.0", ("ccbync_licensed",)),
    ("CC-BY-ND-4.0", ("ccbynd_licensed",)),
    ("CC-BY-4.0", ("ccby_licensed",)),
    ("CC-BY-4.0", ("ccby_work",)),
    ("CC0-1.0", ("cc0_waive",)),
    ("Unlicense", ("unlicense_free",)),
    ("Proprietary", ("reserved",)),
]


def pieces(text: Column) -> Column:
    """The pieces as words with one space between, cut by B (blank lines), S (sentence end) or L (line end), which lowered texts don't have."""
    # The closing bracket of a list number, as in 1) or (a), ends it as a full stop does.
    bracket = rf"\)(?<=(?:^|[\n\r])[^a-z0-9\n\r]{{0,9}}{_MARK}\))(?=[ \t])"
    out = F.regexp_replace(ascii_lower(text), rf"[.!?;:]+(?=[ \t\n\r])|{bracket}", "S")
    for pattern, mark in [(r"\r\n?|\n", "L"), ("[^a-z0-9SL]+", " "), ("(?<![S ])[S ]*+L[S ]*+L[SL ]*+", "B"), ("(?<![SL ])[L ]*+S[SL ]*+", "S"), (" ?L ?", "L")]:
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(out)


def _known(sentences: dict[str, str]) -> str:
    """A pattern of all known sentences, long ones first."""
    tries = []
    for s in sorted(sentences.values(), key=lambda s: (-len(s), s)):
        x = re.escape(s).replace("\\ ", " ").replace(" ", "[ L]")
        for left, right in SPLITS:
            left, right = left.replace(" ", "[ L]"), right.replace(" ", "[ L]")
            x = x.replace(f"{left}[ L]{right}", f"{left}[ LS]{right}")
        tries.append(x)
    return f"(?<=^|[BSL])(?:{'|'.join(tries)})(?=$|[BSL])"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[tuple[str, tuple[str, ...]]] | None = None, sentences: dict[str, str] | None = None) -> DataFrame:
    """doc_id, sentence_ids, licences (in rule order, distinct) for every document.

    ``sentence_ids`` has known sentences in order, with ``|`` where others lie between.
    """
    known = sentences or SENTENCES
    ids = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    # K stands before and after each known sentence, so that every other part is one.
    parts = F.split(F.regexp_replace(pieces(F.col(text)), _known(known), "K$0K"), "K")
    between = lambda part: F.when(F.regexp_replace(part, f"(?<=[BSL]){_MARK}(?=[BSL])|[BSL]", "") == "", "").otherwise("|,")
    one = lambda part: F.concat(F.element_at(ids, F.translate(part, "LS", "  ")), F.lit(","))
    inner = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))
    every = docs.select(F.col(doc_id).alias("doc_id"), parts.alias("parts"))
    joined = F.when(F.size("parts") > 1, F.array_join(F.transform(inner, lambda part, i: F.when(i % 2 == 0, one(part)).otherwise(between(part))), "")).otherwise("")
    table = every.select("doc_id", joined.alias("seq"))
    table = table.withColumn("rest", F.concat(F.lit(","), F.replace("seq", F.lit(","), F.lit(",,")), F.lit(",")))
    hits = []
    for i, (name, ids) in enumerate(rules or RULES):
        pattern = "".join(f",{x}," for x in ids)
        table = table.withColumn(f"r{i}", F.contains("rest", F.lit(pattern))).withColumn("rest", F.replace("rest", F.lit(pattern), F.lit(",#,")))
        hits.append(F.when(F.col(f"r{i}"), F.lit(name)))
    names = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return table.select("doc_id", F.regexp_replace("seq", ",$", "").alias("sentence_ids"), names.alias("licences"))
