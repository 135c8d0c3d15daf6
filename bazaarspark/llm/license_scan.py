"""Licence scans by sentence rules. Column expressions only: no join, no exchange, no Python on the executors.

A text is cut into sentences (at lines without letters and digits, and where an end mark precedes white space) and each is
normalised (runs of anything but ASCII letters and digits, line feeds and comment signs too, become a space; lower case).
Each line of a sentence is also tried alone, and the lines from any one to the sentence's end or from its start, so that
notices next to other lines are found. Known sentences have identifiers; a document is then its
sequence of identifiers, others left out, and a rule matches where its identifiers stand in it one after the other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers and sentences of public licence texts and notices.
SENTENCES: dict[str, str] = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-release": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-licensed": "Licensed under the BSD License.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-free-1": "This program is free software:",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty-1": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-warranty-2": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-work-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-work-2": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-work-3": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-work-3": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-source": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-source-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0.",
    "cc0-short": "Licensed under CC0 1.0.",
}

# Licences and the orders of sentences that grant them.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-release"]),
    ("MIT", ["mit-licensed"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD", ["bsd-licensed"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-basis"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-basis"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty-1"]),
    ("GPL-3.0-or-later", ["gpl-free-1", "gpl-terms", "gpl-warranty-1"]),
    ("GPL-3.0", ["gpl-work-3"]),
    ("GPL-2.0", ["gpl-work-2"]),
    ("LGPL-3.0", ["lgpl-work-3"]),
    ("AGPL-3.0", ["agpl-work-3"]),
    ("MPL-2.0", ["mpl-source", "mpl-copy"]),
    ("MPL-2.0", ["mpl-source-1", "mpl-copy"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-short"]),
    ("CC0-1.0", ["cc0-short"]),
]

# Notices that license_sql() does not have. Pieces end at semicolons and colons, as texts are cut there.
MORE_SENTENCES: dict[str, str] = {
    "fsf-library": "This library is free software:",
    "fsf-terms-gpl": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "fsf-terms-lgpl": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "fsf-later-2": "either version 2 of the License, or (at your option) any later version.",
    "fsf-later-2.1": "either version 2.1 of the License, or (at your option) any later version.",
    "fsf-later-3": "either version 3 of the License, or (at your option) any later version.",
    "fsf-only-2": "version 2 of the License.",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "fsf-library-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
}
MORE_RULES: list[tuple[str, list[str]]] = [
    (name, [start, *terms, warranty])
    for start, warranty in (("gpl-free-1", "gpl-warranty-1"), ("fsf-library", "fsf-library-warranty"))
    for name, terms in (
        ("GPL-2.0-or-later", ["fsf-terms-gpl", "fsf-later-2"]),
        ("GPL-2.0", ["fsf-terms-gpl", "fsf-only-2"]),
        ("GPL-3.0-or-later", ["fsf-terms-gpl", "fsf-later-3"]),
        ("LGPL-2.1-or-later", ["fsf-terms-lgpl", "fsf-later-2.1"]),
        ("LGPL-3.0-or-later", ["fsf-terms-lgpl", "fsf-later-3"]),
        ("LGPL-3.0-or-later", ["lgpl-terms"]),
        ("AGPL-3.0-or-later", ["agpl-terms"]),
    )
]
#: A tag and its expression; identifiers stand between operators, and an exception follows WITH.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"

#: Every known sentence holds one of these, so that a text without any needs no sentences.
ANCHORS = r"(?i)licen|permi|copyright|warrant|software|redistribut|compliance|\bmpl\b"


def normalised(sentence: str) -> str:
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip(" ").lower()


def _known_in(text: Column, known: Column) -> Column:
    """The known sentences of a text in their order."""
    marked = F.regexp_replace(text, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n\n")
    pieces = F.split(marked, r"\n(?:[^A-Za-z0-9\n]*\n)+")
    lines = F.transform(pieces, lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")))), lambda x: x != ""))
    longest = max(len(normalised(s).split()) for s in (SENTENCES | MORE_SENTENCES).values())  # a longer run of lines has too many words

    def found(ls: Column) -> Column:
        n = F.size(ls)
        hit = lambda i, m: F.struct(i.alias("from"), m.alias("lines"), F.try_element_at(known, F.array_join(F.slice(ls, i, m), " ")).alias("name"))
        alone = F.transform(ls, lambda x, i: F.struct((i + 1).alias("from"), F.lit(1).alias("lines"), F.try_element_at(known, x).alias("name")))
        most = F.least(n, F.lit(longest))
        to_end = F.transform(F.sequence(F.lit(2), most), lambda m: hit(n - m + 1, m))
        from_start = F.transform(F.sequence(F.lit(2), most), lambda m: hit(F.lit(1), m))
        every = F.when(n > 1, F.concat(alone, to_end, from_start)).otherwise(alone)
        return F.transform(F.array_sort(F.array_distinct(F.filter(every, lambda h: h["name"].isNotNull()))), lambda h: h["name"])

    return F.flatten(F.transform(lines, found))


def _tagged(text: Column) -> Column:
    """Licences of SPDX tags."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda x: F.regexp_replace(x, r"[ \t]WITH[ \t]+[A-Za-z0-9.-]+", ""))
    return F.filter(F.flatten(F.transform(plain, lambda x: F.split(x, r"[()\s]+(?:(?:OR|AND)[()\s]+)*"))), lambda x: x.rlike("[A-Za-z0-9]"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_matched`` (known sentences), ``sentence_ids`` in their order, ``licenses`` in order of name.

    A null or empty text, and one without known sentences, has none and empty lists. Sentences that repeat count each
    time. Known sentences that complete no rule give no licence. SPDX tags give the licences they name and no sentence. Other columns are not read. An empty table gives an empty one.
    """
    known = F.create_map(*[F.lit(x) for name, s in (SENTENCES | MORE_SENTENCES).items() for x in (normalised(s), name)])
    text = F.col(text_col).cast("string")
    none = F.array().cast("array<string>")
    found = docs.select(F.col(id_col), F.when(text.rlike(ANCHORS), _known_in(text, known)).otherwise(none).alias("sentence_ids"), F.when(text.contains("SPDX-License-Identifier:"), _tagged(text)).otherwise(none).alias("_tagged"))
    found = found.withColumns({"sentence_ids": F.coalesce("sentence_ids", none), "_tagged": F.coalesce("_tagged", none)})
    sequence = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    matches = F.array(*[F.when(sequence.contains("," + ",".join(ids) + ","), F.lit(name)) for name, ids in RULES + MORE_RULES])
    licences = F.when(F.size("sentence_ids") + F.size("_tagged") > 0, F.array_sort(F.array_distinct(F.concat(F.array_compact(matches), "_tagged")))).otherwise(none)
    return found.select(id_col, F.size("sentence_ids").cast("long").alias("n_matched"), "sentence_ids", licences.alias("licenses"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    """The same rules as DuckDB SQL over ``documents``."""
    known = ", ".join(f"({_quoted(normalised(s))}, {_quoted(name)})" for name, s in SENTENCES.items())
    rules = ", ".join(f"CASE WHEN contains(q, {_quoted(',' + ','.join(ids) + ',')}) THEN {_quoted(name)} END" for name, ids in RULES)
    return rf"""
WITH known(s, name) AS (VALUES {known}),
parts AS (SELECT doc_id, i, trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS s
          FROM (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM
                (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS xs FROM documents))),
hit AS (SELECT doc_id, list(name ORDER BY i) AS ids FROM parts JOIN known USING (s) GROUP BY doc_id),
q AS (SELECT d.doc_id, coalesce(ids, CAST([] AS VARCHAR[])) AS ids, ',' || array_to_string(coalesce(ids, CAST([] AS VARCHAR[])), ',') || ',' AS q FROM documents d LEFT JOIN hit USING (doc_id))
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_matched, ids AS sentence_ids, list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))) AS licenses FROM q
"""
