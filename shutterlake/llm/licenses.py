r"""Licence recognition by sentence rules, with DataFrame functions only.

A text is normalised: A-Z lower-cased; marks of lists at the start of a line ("1.", "a)") and blank
lines, like . ! ? ; : before white space, end a sentence; every run of other characters than a-z and
0-9 is one space. What stands between is lines of words, and a known sentence is looked for from the
start of a line to the end of a line, over as many lines as it needs, the longest first: so a
sentence is found when it is wrapped, behind the prefixes of a comment, and when it is a line of its
own between lines that don't end. Known ones become identifiers, every other line a gap. The
identifiers form one sequence per text, and ordered rules take consecutive identifiers out of it: a
rule's matches are counted and replaced by a gap before the next rule looks.

Every text is normalised and looked through as a whole; there is no first look that passes over any.

Edge cases: null and empty texts have no sentences and no licences; sentences that no rule takes
are counted as unclaimed; ties can't arise, as of known sentences that start at one line the longest
is taken and rules have an order; repeated rows repeat their result; an empty table gives an empty
result; columns besides doc_id and text are not read. The dictionary and the rules are constants of
the plan, so nothing is joined or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, table


def plain(sentence: str) -> str:
    """A sentence as the dictionary has it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Sentences of licence texts and of notices, by identifier.
TEXTS = {
    "MITgrant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "MITnotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MITwarranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "MITliability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "Apache2head": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "Apache2use": "you may not use this file except in compliance with the License",
    "Apache2copy": "You may obtain a copy of the License at",
    "Apache2url": "http://www.apache.org/licenses/LICENSE-2.0",
    "Apache2asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "Apache2see": "See the License for the specific language governing permissions and limitations under the License",
    "BSDgrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSDsource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSDbinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSDendorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSDwarranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "ISCgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0BSDgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISCwarranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "ISCliability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "MPLterms": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "MPL2": "2.0",
    "MPLcopy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "MPLcopys": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "UNLhead": "This is free and unencumbered software released into the public domain",
    "UNLany": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "ZLIBhead": "This software is provided 'as-is', without any express or implied warranty",
    "ZLIBliable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "ZLIBgrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSLgrant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "GPLfree": "This program is free software",
    "GPLlibrary": "This library is free software",
    "SPDX": "SPDX-License-Identifier",
    "Reserved": "All rights reserved",
}
#: Kinds of the GNU licences, their names and versions.
GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}
CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
#: How a text refers to a licence by name, and the names.
SAYS = ("licensed under", "released under", "distributed under", "available under", "provided under")
WHAT = ("this project is", "this work is", "this software is", "this program is", "this file is", "this code is", "it is")
NAMES = {
    "MIT": ("the MIT License", "the MIT licence", "MIT License", "the terms of the MIT License", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "the Apache 2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, Version 2.0", "MPL 2.0"),
    "ISC": ("the ISC License",),
    "Unlicense": ("the Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0", "the CC0 1.0 Universal license"),
}
for _kind, (_name, _versions) in GNU.items():
    for _v in _versions:
        _full = _v if "." in _v else f"{_v}.0"
        NAMES[f"{_kind}-{_full}"] = (f"the {_name} version {_v}", f"the {_name}, version {_full}", f"the {_name} v{_v}", f"{_kind} v{_v}", f"{_kind}v{_v}", f"the {_kind}v{_v}", f"{_kind} {_full}")
for _cc in CC:
    _words = "-".join(CC_WORDS[x] for x in _cc.split("-"))
    NAMES[f"CC-{_cc}-4.0"] = (f"CC {_cc} 4.0", f"CC-{_cc}-4.0", f"a Creative Commons {_words} 4.0 International License", f"the Creative Commons {_words} 4.0 International License")


def _tag(name: str) -> str:
    return re.sub("[^A-Za-z0-9]", "x", name)


_SAYS = f"(?:(?:{'|'.join(plain(w) for w in WHAT)}) )?(?:{'|'.join(SAYS)}) "


def _sentences() -> dict[str, str]:
    """Sentence -> identifier; a way to refer to a licence stands as 'ref' and the name."""
    out = {re.sub(rf"\A{_SAYS}", "ref ", plain(s)): i for i, s in TEXTS.items()}
    for kind, (name, versions) in GNU.items():
        terms = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
        out[plain(terms)] = f"{kind}terms"
        for v in versions:
            later = f"either version {v} of the License, or (at your option) any later version"
            out[plain(later)] = f"Later{_tag(v)}"
            out[plain(f"{terms}, {later}")] = f"{kind}terms{_tag(v)}"
    for name, ways in NAMES.items():
        out |= {f"ref {plain(way)}": f"Ref{_tag(name)}" for way in ways}
        out[plain(name)] = f"Id{_tag(name)}"
        out |= {plain(f"{name}{x}"): f"Id{_tag(name)}{_tag(x)}" for x in ("-only", "-or-later") if "GPL" in name}
    return out


def _rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Licences and the identifiers that show them, in the order in which they are tried: whole texts, the longest first, then names."""
    out: list[tuple[str, tuple[str, ...]]] = []

    def text(name: str, least: int, *ids: str) -> None:
        out.extend((name, ids[:n]) for n in range(len(ids), least - 1, -1))

    text("MIT", 2, "MITgrant", "MITnotice", "MITwarranty", "MITliability")
    for first in (("Reserved",), ()):
        text("BSD-3-Clause", 4 + len(first), *first, "BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDwarranty")
        text("BSD-2-Clause", 3 + len(first), *first, "BSDgrant", "BSDsource", "BSDbinary", "BSDwarranty")
    text("Apache-2.0", 1, "Apache2head", "Apache2use", "Apache2copy", "Apache2url", "Apache2asis", "Apache2see")
    text("Apache-2.0", 2, "Apache2head", "Apache2use", "Apache2copy", "Apache2asis", "Apache2see")
    text("ISC", 1, "ISCgrant", "ISCwarranty", "ISCliability")
    text("0BSD", 1, "0BSDgrant", "ISCwarranty", "ISCliability")
    text("MPL-2.0", 2, "MPLterms", "MPL2", "MPLcopy")
    text("MPL-2.0", 2, "MPLterms", "MPL2", "MPLcopys")
    text("Unlicense", 1, "UNLhead", "UNLany")
    text("Zlib", 2, "ZLIBhead", "ZLIBliable", "ZLIBgrant")
    text("BSL-1.0", 1, "BSLgrant")
    for kind, (_, versions) in GNU.items():
        for v in versions:
            name = f"{kind}-{v if '.' in v else v + '.0'}-or-later"
            for free in ("GPLfree", "GPLlibrary"):
                out += [(name, (free, f"{kind}terms", f"Later{_tag(v)}")), (name, (free, f"{kind}terms{_tag(v)}"))]
    for name in NAMES:
        out.append((name, (f"Ref{_tag(name)}",)))
        out.append((name, ("SPDX", f"Id{_tag(name)}")))
        if "GPL" in name:
            out += [(name, ("SPDX", f"Id{_tag(name)}xonly")), (f"{name}-or-later", ("SPDX", f"Id{_tag(name)}xorxlater"))]
    return (*out, ("Proprietary", ("Reserved",)))


#: Known licence sentences, normalised, and their identifiers; and the rules.
SENTENCES, RULES = _sentences(), _rules()
GAP = "<>"
#: List marks; ends of sentences; what isn't a word; and the runs that ends and line ends make with spaces.
LIST, END, OTHER, ENDS, LINES = r"(?:\A|\n)[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z])[.)][\t-\r ]", "[.!?;:](?:[\\t-\\r ]|\\z)|\\n[^a-z0-9\x01\\n]*\\n", "[^a-z0-9\x01\\n]+", "[ \\n]*\x01[ \\n\x01]*", " ?\\n ?"
#: A line is between \x02 and \x03; \x01 stands between lines of unlike sentences.
BETWEEN = "(?: |\x03\x02)"


def _known(sentences: dict[str, str] = SENTENCES) -> str:
    """One pattern for all known sentences, parted by first word; of one first word the longest first."""
    by: dict[str, list[str]] = {}
    for s in sorted(sentences, key=lambda s: (-len(s), s)):
        first, _, rest = s.partition(" ")
        by.setdefault(first, []).append(BETWEEN + rest.replace(" ", BETWEEN) if rest else "")
    says = _SAYS.rstrip().replace(" ", BETWEEN)
    words = {w if w != "ref" else says: rests for w, rests in by.items()}
    return "\x02(" + "|".join(f"{w}(?:{'|'.join(rests)})" for w, rests in sorted(words.items())) + ")\x03"


KNOWN = _known()


def marked(text: Column) -> Column:
    """The text's lines of words between marks, known sentences between < and >."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER + "\r\x01\x02\x03", UPPER.lower() + "    ")
    for pattern, by in ((LIST, "\x01"), (END, "\x01"), (OTHER, " "), (ENDS, "\x01"), (LINES, "\n")):
        low = F.regexp_replace(low, pattern, by)
    lines = F.replace(F.replace(F.trim(low), F.lit("\x01"), F.lit("\x03\x01\x02")), F.lit("\n"), F.lit("\x03\x02"))
    return F.regexp_replace(F.concat(F.lit("\x02"), lines, F.lit("\x03")), KNOWN, "<$1>")


def sentence_ids(marks: Column) -> Column:
    """The known sentences' identifiers, gaps for other lines, in one string; empty if none is known."""
    known = F.create_map(*[F.lit(x) for s, i in SENTENCES.items() for x in (s, f"<{i}>")])
    tokens = F.regexp_extract_all(marks, F.lit("<([^>]*)>|\x02"), F.lit(1))
    of = lambda t: F.when(t == "", GAP).otherwise(F.try_element_at(known, F.regexp_replace(F.replace(t, F.lit("\x03\x02"), F.lit(" ")), rf"\A{_SAYS}", "ref ")))
    return F.when(F.contains(marks, F.lit("<")), F.array_join(F.transform(tokens, of), "")).otherwise(F.lit(""))


def recognise(docs: DataFrame, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """doc_id, licenses (distinct, in the order of the rules, ' AND ' between), n_matches, n_known, n_unclaimed."""
    known = lambda c: F.regexp_count(c, F.lit("<[A-Za-z0-9]+>")).cast("long")
    # each step is a column of its own, so that what it makes of a text is made once
    rows = docs.select("doc_id", marked(F.col("text").cast("string")).alias("marks"))
    rows = rows.select("doc_id", sentence_ids(F.col("marks")).alias("ids"))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("seq")) for n, ids in rules])
    start = F.struct(F.col("ids").alias("left"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))

    def take(state: Column, rule: Column) -> Column:
        n = F.floor((F.length(state["left"]) - F.length(F.replace(state["left"], rule["seq"], F.lit("")))) / F.length(rule["seq"]))
        hit = F.contains(state["left"], rule["seq"])
        return F.when(~hit, state).otherwise(F.struct(F.replace(state["left"], rule["seq"], F.lit(GAP)).alias("left"), (state["n"] + n).alias("n"), F.array_union(state["names"], F.array(rule["name"])).alias("names")))

    rows = rows.withColumn("done", F.when(F.col("ids") != "", F.aggregate(listed, start, take)).otherwise(start))
    return rows.select("doc_id", F.array_join("done.names", " AND ").alias("licenses"), F.col("done.n").alias("n_matches"), known(F.col("ids")).alias("n_known"), known(F.col("done.left")).alias("n_unclaimed"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda s: s.replace("\x01", "\\x01").replace("\x02", "\\x02").replace("\x03", "\\x03")
    known = "MAP {" + ", ".join(f"'{s}': '<{i}>'" for s, i in SENTENCES.items()) + "}"
    low = f"translate(coalesce(text, ''), '{UPPER}' || chr(13) || chr(1) || chr(2) || chr(3), '{UPPER.lower()}    ')"
    for pattern, by in ((LIST, "chr(1)"), (END, "chr(1)"), (OTHER, "' '"), (ENDS, "chr(1)"), (LINES, "chr(10)")):
        low = f"regexp_replace({low}, '{q(pattern)}', {by}, 'g')"
    rules = ", ".join(f"{{'x': '{''.join(f'<{i}>' for i in ids)}', 'n': CAST(0 AS BIGINT), 'names': ['{n}']}}" for n, ids in RULES)
    return f"""
WITH l AS (SELECT doc_id, chr(2) || replace(replace(trim({low}), chr(1), chr(3) || chr(1) || chr(2)), chr(10), chr(3) || chr(2)) || chr(3) z FROM documents),
m AS (SELECT doc_id, regexp_replace(z, '{q(KNOWN)}', '<\\1>', 'g') z FROM l),
t AS (SELECT doc_id, CASE WHEN contains(z, '<') THEN regexp_extract_all(z, '<([^>]*)>|\\x02', 1) ELSE [] END z FROM m),
ids AS (SELECT doc_id, coalesce(array_to_string(list_transform(z, lambda v: CASE WHEN v = '' THEN '<>' ELSE ({known})[regexp_replace(replace(v, chr(3) || chr(2), ' '), '\\A{_SAYS}', 'ref ')] END), ''), '') x, CAST(len(list_filter(z, lambda v: v <> '')) AS BIGINT) n_known FROM t),
done AS (SELECT doc_id, n_known, list_reduce([{rules}], lambda s, r: {{'x': replace(s.x, r.x, '<>'), 'n': s.n + (length(s.x) - length(replace(s.x, r.x, ''))) // length(r.x), 'names': CASE WHEN contains(s.x, r.x) AND NOT list_contains(s.names, r.names[1]) THEN list_concat(s.names, r.names) ELSE s.names END}}, {{'x': x, 'n': CAST(0 AS BIGINT), 'names': CAST([] AS VARCHAR[])}}) d FROM ids)
SELECT doc_id, array_to_string(d.names, ' AND ') licenses, d.n n_matches, n_known, CAST(len(regexp_extract_all(d.x, '<[A-Za-z0-9]+>')) AS BIGINT) n_unclaimed FROM done
"""


OP2_SQL = _sql()
