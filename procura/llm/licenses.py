"""Licence recognition: normalised sentences to identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import pieces, table, utf8

MAX_GAP = 2  # unknown sentences between two of a notice
TEXT_GAP = 1000  # and between two of a whole text

# Sentences of public licence texts and the usual notices.  Identifier, then sentence.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-ref": "Released under the MIT License.",
    "mit-ref2": "Licensed under the MIT License.",
    "mit-ref3": "This project is licensed under the terms of the MIT license.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software.",
    "asis-mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "liable-mit": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "bsd-names-uc": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-asis-uc": "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so.",
    "ncsa-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without "
    "fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the "
    "following two paragraphs appear in all copies.",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
    "it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
    "furnished to do so, all subject to the following:",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "lgpl2-later": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "ofl-ref": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "eupl-ref": "Licensed under the EUPL",
    "eupl-applies": "This European Union Public Licence (the 'EUPL') applies to the Work (as defined below) which is provided under the "
    "terms of this Licence.",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "mspl-title": "Microsoft Public License (Ms-PL)",
    "mspl-accept": "If you use the software, you accept this license.",
    # Of whole texts: sentences that no other text has, two or three each.
    "apache-text1": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 '
    "through 9 of this document.",
    "apache-text2": "Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to "
    "the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions.",
    "apache-text3": "To apply the Apache License to your work, attach the following boilerplate notice, with the fields enclosed by "
    'brackets "[]" replaced with your own identifying information.',
    "gpl1-text1": "The license agreements of most software companies try to keep users at the mercy of those companies.",
    "gpl1-text2": "You may not copy, modify, sublicense, distribute or transfer the Program except as expressly provided under this "
    "General Public License.",
    "gpl2-text1": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free "
    "software--to make sure the software is free for all its users.",
    "gpl2-text2": "You may not copy, modify, sublicense, or distribute the Program except as expressly provided under this License.",
    "gpl3-text1": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl3-text2": "Limiting the use for publicity purposes of names of licensors or authors of the material;",
    "agpl3-text1": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
    "specifically designed to ensure cooperation with the community in the case of network server software.",
    "lgpl2-text1": "This license, the Library General Public License, applies to some specially designated Free Software Foundation "
    "software, and to any other libraries whose authors decide to use it.",
    "lgpl2-text2": "However, in a textual and legal sense, the linked executable is a combined work, a derivative of the original "
    "library, and the ordinary General Public License treats it as such.",
    "lgpl21-text1": "This license, the Lesser General Public License, applies to some specially designated software "
    "packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "lgpl21-text2": "The Lesser General Public License permits more lax criteria for linking other code with the library.",
    "lgpl3-text1": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU "
    "General Public License, supplemented by the additional permissions listed below.",
    "lgpl3-text2": "If the Library as you received it does not specify a version number of the GNU Lesser General Public License, you "
    "may choose any version of the GNU Lesser General Public License ever published by the Free Software Foundation.",
    "mpl11-text1": "The Initial Developer hereby grants You a world-wide, royalty-free, non-exclusive license, subject to third party "
    "intellectual property claims:",
    "mpl11-text2": "Once Covered Code has been published under a particular version of the License, You may always continue to use it "
    "under the terms of that version.",
    "mpl2-text1": "that the Covered Software was made available under the terms of version 1.1 or earlier of the License, but not also "
    "under the terms of a Secondary License.",
    "mpl2-text2": "If it is impossible for You to comply with any of the terms of this License with respect to some or all of the "
    "Covered Software due to statute, judicial order, or regulation then You must:",
    "cc0-text1": "The License shall be deemed effective as of the date CC0 was applied by Affirmer to the Work.",
    "cc0-text2": "No trademark or patent rights held by Affirmer are waived, abandoned, surrendered, licensed or otherwise affected by "
    "this document.",
    "artistic1-text1": "It also means that recipients of the item may redistribute it under the same conditions they received it.",
    "artistic1-text2": 'THIS PACKAGE IS PROVIDED "AS IS" AND WITHOUT ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, WITHOUT LIMITATION, '
    "THE IMPLIED WARRANTIES OF MERCHANTIBILITY AND FITNESS FOR A PARTICULAR PURPOSE.",
    "gfdl12-text": "Any other attempt to copy, modify, sublicense or distribute the Document is void, and will automatically terminate "
    "your rights under this License.",
    "gfdl13-text": "If the Document specifies that a proxy can decide which future versions of this License can be used, that proxy's "
    "public statement of acceptance of a version permanently authorizes you to choose that version for the Document.",
    "gfdl12-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
    "Documentation License, Version 1.2 or any later version published by the Free Software Foundation;",
    "gfdl13-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
    "Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
}
#: Identifiers of the one-line form, which are their licences' names.
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "NCSA", "PostgreSQL", "Unlicense",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "OFL-1.1",
    "MS-PL", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Licence, then identifiers in order; longer rules win over those inside them.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "asis-mit", "liable-mit")),
    ("MIT", ("mit-grant", "mit-notice", "asis-mit", "liable-mit")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-grant", "apache-comply")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("MPL-2.0", ("mpl2", "mpl2-copy")),
    ("MPL-2.0", ("mpl2",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("MIT", ("mit-ref3",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-copy",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-uc", "bsd-asis-uc")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-uc")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("MIT-0", ("mit0-grant", "asis-mit")),
    ("MIT-0", ("mit0-grant",)),
    ("NCSA", ("ncsa-grant",)),
    ("ISC", ("isc-grant", "isc-asis")),
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("0BSD", ("0bsd-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-hope", "agpl-see", "agpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.0-or-later", ("lgpl2-later",)),
    ("OFL-1.1", ("ofl-ref",)),
    ("EUPL-1.2", ("eupl-applies",)),
    ("EUPL-1.2", ("eupl-ref",)),
    ("EPL-2.0", ("epl2-title", "epl-terms")),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-title", "epl-terms")),
    ("EPL-1.0", ("epl1-title",)),
    ("MS-PL", ("mspl-title", "mspl-accept")),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-long",)),
    ("GFDL-1.2-or-later", ("gfdl12-notice",)),
    ("GFDL-1.3-or-later", ("gfdl13-notice",)),
    *((x, (f"spdx-{x}",)) for x in SPDX),
]
#: Whole texts: their sentences stand far apart; the notice that a text gives as an example belongs to it.
TEXTS = [
    ("Apache-2.0", ("apache-text1", "apache-text2", "apache-text3", "apache-grant", "apache-comply", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-text1", "apache-text2", "apache-text3")),
    ("Apache-2.0", ("apache-text1", "apache-text2")),
    ("GPL-1.0", ("gpl1-text1", "gpl1-text2")),
    ("GPL-2.0", ("gpl2-text1", "gpl2-text2", "gpl2-later", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0", ("gpl2-text1", "gpl2-text2")),
    ("GPL-3.0", ("gpl3-text1", "gpl3-text2", "gpl3-later", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-3.0", ("gpl3-text1", "gpl3-text2")),
    ("AGPL-3.0", ("agpl3-text1", "gpl3-text2", "agpl3-later", "gpl-hope", "agpl-see", "agpl-copy")),
    ("AGPL-3.0", ("agpl3-text1", "gpl3-text2")),
    ("LGPL-2.0", ("lgpl2-text1", "lgpl2-text2", "lgpl2-later")),
    ("LGPL-2.0", ("lgpl2-text1", "lgpl2-text2")),
    ("LGPL-2.1", ("lgpl21-text1", "lgpl21-text2", "lgpl21-later")),
    ("LGPL-2.1", ("lgpl21-text1", "lgpl21-text2")),
    ("LGPL-3.0", ("lgpl3-text1", "lgpl3-text2")),
    ("MPL-1.1", ("mpl11-text1", "mpl11-text2")),
    ("MPL-2.0", ("mpl2-text1", "mpl2-text2", "mpl2", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-text1", "mpl2-text2")),
    ("CC0-1.0", ("cc0-text1", "cc0-text2")),
    ("Artistic-1.0", ("artistic1-text1", "artistic1-text2")),
    ("GFDL-1.2", ("gfdl12-text", "gfdl12-notice")),
    ("GFDL-1.3", ("gfdl13-text", "gfdl13-notice")),
    ("EUPL-1.2", ("eupl-applies", "eupl-ref")),
]

_JUNK = re.compile(r"[^a-z0-9]+")
_ENDS = re.compile(r"(?<=[.;:!?])\s+|\n\s*\n")
_LEAD = re.compile(r"^\s*(?:[/*#;%-]+|\(?(?:\d+|[a-z])[.)])\s*", re.M)  # comment marks and list numbers


def normal(sentence: str) -> str:
    return _JUNK.sub(" ", sentence.lower()).strip()


KNOWN = {normal(s): i for i, s in SENTENCES.items()}
#: First parts of the known sentences that have an end within, and the most parts of one.
FIRST = {normal(_ENDS.split(s)[0]) for s in SENTENCES.values() if len(_ENDS.split(s)) > 1}
MAX_PARTS = max(len(_ENDS.split(s)) for s in SENTENCES.values())
#: Rules by length, longest first, in the order given.
ORDERED = sorted([(*r, TEXT_GAP) for r in TEXTS] + [(*r, MAX_GAP) for r in RULES], key=lambda r: -len(r[1]))
BY_FIRST: dict[str, list] = {}
for _rule in ORDERED:
    BY_FIRST.setdefault(_rule[1][0], []).append(_rule)
#: Each known sentence has one of these; a text without any has no known sentence.  Single words, as a line may end between two.
TRIGGERS = ("licen", "permission", "redistribut", "warrant", "liable", "endorse", "mozilla.org", "unencumbered", "copies of the software")


#: Comment marks before a line; they become blanks, so that places stay and empty comment lines are empty lines.
_MARKS = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+)(?=[ \t\r\n]|$)", re.M)


def _ways(part: str) -> tuple[str, str, str]:
    """``part`` normalised: a number that begins a line may be of a list, or of the sentence ("version", "2.0")."""
    return normal(_LEAD.sub("", part)), normal(_LEAD.sub("", part, count=1)), normal(part)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Known sentences of ``text`` as ``(start, stop, identifier)``, in order, none inside another.

    Sentences end at punctuation before a blank, or at an empty line; each line is tried as a sentence too, as notices
    often stand without a full stop before them.  A known sentence with such an end within is met as the parts in a row.
    Comment marks and list numbers are taken off before lines, or only before the first, or not at all.
    """
    found = []
    for cut in (_ENDS, re.compile(r"\n")):
        ends = [(m.start(), m.end()) for m in cut.finditer(text)] + [(len(text), len(text))]
        at = 0
        for i, (stop, after) in enumerate(ends):
            part = text[at:stop]
            if part and any(t in part.lower() for t in TRIGGERS):
                ways = _ways(part)
                more = MAX_PARTS if cut is _ENDS and any(w in FIRST for w in ways) else 1
                for last, _ in ends[i : i + more]:
                    if known := next((KNOWN[w] for w in (ways if last == stop else _ways(text[at:last])) if w in KNOWN), None):
                        found.append((at, last, known))
            at = after
    out: list[tuple[int, int, str]] = []
    for s, e, i in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e, i))
    return out


def _between(text: str, start: int, stop: int) -> int:
    """Unknown sentences in a gap."""
    return sum(bool(normal(x)) for x in _ENDS.split(text[start:stop]))


def recognise(text: str) -> tuple[list[tuple[str, int, int, int]], list[str]]:
    """``[(licence, start, stop, sentences)]`` and the identifiers in order.

    The longest rule that matches at the earliest free sentence is taken; between its sentences up to ``MAX_GAP``
    unknown ones may stand (``TEXT_GAP`` in whole texts), and known ones may not.
    """
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return [], []
    text = _MARKS.sub(lambda m: " " * len(m[0]), text)
    known = sentences(text)
    ids, out, at = [i for _, _, i in known], [], 0
    while at < len(ids):
        for licence, rule, gap in BY_FIRST.get(ids[at], ()):
            n = len(rule)
            if tuple(ids[at : at + n]) == rule and all(
                _between(text, known[j][1], known[j + 1][0]) <= gap for j in range(at, at + n - 1)
            ):
                out.append((licence, known[at][0], known[at + n - 1][1], n))
                at += n
                break
        else:
            at += 1
    return out, ids


def _scanned(batches):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["doc_id", "licenses", "n_rules", "n_sentences", "sentence_ids", "spans", "n_unmatched"]
    for b in pieces(batches):
        out = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found, ids = recognise(t.decode())
            if ids:
                spans = ",".join(f"{l}:{s}:{e}" for l, s, e, _ in found)
                used = sum(n for *_, n in found)
                out.append((d, ",".join(sorted({l for l, *_ in found})), len(found), len(ids), " ".join(ids), spans, len(ids) - used))
        cols = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def licenses(docs: DataFrame) -> DataFrame:
    """A row for each document with a known licence sentence.

    ``doc_id, licenses`` (distinct, sorted), ``n_rules, n_sentences, sentence_ids, spans`` (licence:start:stop in code
    points), ``n_unmatched`` (known sentences that no rule took).  Null, empty and other texts have no row; other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(
        _scanned, "doc_id long, licenses string, n_rules long, n_sentences long, sentence_ids string, spans string, n_unmatched long"
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
