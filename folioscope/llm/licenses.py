"""Licence scan by sentence rules.

A text is normalised: lower case, one space between words, no comment marks, commas, quotes or closing
punctuation, and copyright lines without year and holder.  Known licence sentences are sought in it
that begin and end where a line or a sentence does, also across line breaks, but not across the ends
of sentences: a licence line needs no closing punctuation.  What is found, in order, is a sequence of identifiers.  Licence rules are sequences too, tried in their order; a
rule that matches takes its identifiers out, so that a longer rule wins over a shorter one that
it contains.  Identifiers that no rule took are reported as unmatched: so are copyright lines.  An SPDX tag yields one
identifier for each licence that its expression names; exceptions and unknown names stay unmatched.

Null and empty texts, and texts without a known sentence, yield no row.  Repeated rows, and rows that share a doc_id, yield
one row each; a null doc_id stays null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2_ref",
    "licensed under the apache license version 2.0 (the license)": "apache2_head",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at http//www.apache.org/licenses/license-2.0": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_head",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd_binary",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages (including but not limited to procurement of substitute goods or services": "bsd_liability",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "this work is licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software": "gpl_free",
    "this library is free software": "gpl_free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl_warranty",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl_warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_implied",
    "if not see <http//www.gnu.org/licenses/>": "gpl_see",
    "if not see <https//www.gnu.org/licenses/>": "gpl_see",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc_liability",
    "this source code form is subject to the terms of the mozilla public license v": "mpl_head",
    "if a copy of the mpl was not distributed with this file you can obtain one at http//mozilla.org/mpl/2.0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https//mozilla.org/mpl/2.0": "mpl2_copy",
    "this is free and unencumbered software released into the public domain": "unlicense_head",
    "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "unlicense_liability",
    "to the extent possible under law the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0_head",
    "this software is distributed without any warranty": "cc0_warranty",
    "you should have received a copy of the cc0 public domain dedication along with this software": "cc0_copy",
    "licensed under cc by 4.0": "ccby4_ref",
    "licensed under cc by-sa 4.0": "ccbysa4_ref",
    "licensed under cc by-nc 4.0": "ccbync4_ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4_ref",
    "all rights reserved": "reserved",
    "copyright": "copyright",
}
#: Licence rules, in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["apache2_head", "apache2_comply", "apache2_copy", "apache2_basis", "apache2_see"]),
    ("Apache-2.0", ["apache2_head", "apache2_comply", "apache2_copy"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("ISC", ["isc_grant", "isc_warranty", "isc_liability"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl_head", "mpl2_copy"]),
    ("Unlicense", ["unlicense_head", "mit_warranty", "unlicense_liability"]),
    ("Unlicense", ["unlicense_head"]),
    ("CC0-1.0", ["cc0_head", "cc0_warranty", "cc0_copy"]),
    ("CC0-1.0", ["cc0_head"]),
    ("BSD-3-Clause", ["bsd_head", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty", "bsd_liability"]),
    ("BSD-3-Clause", ["bsd_head", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_head", "bsd_source", "bsd_binary", "bsd_warranty", "bsd_liability"]),
    ("BSD-2-Clause", ["bsd_head", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache2_ref"]),
    ("Apache-2.0", ["apache2_head"]),
    ("MIT", ["mit_ref"]),
    ("GPL-3.0-only", ["gpl3_ref"]),
    ("GPL-2.0-only", ["gpl2_ref"]),
    ("CC-BY-4.0", ["ccby4_ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4_ref"]),
    ("CC-BY-NC-4.0", ["ccbync4_ref"]),
    ("LicenseRef-All-Rights-Reserved", ["reserved"]),
]
#: The GNU licences, by their names in a notice, and the versions that notices give.
GNU = {"GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2.1", "3")), "AGPL": ("gnu affero general public license", ("3",))}
#: Licences that an SPDX tag may name, and older names of some.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
]
SPDX_OLD = {f"{name}-{version}{mark}": f"{name}-{version}-{now}" for name, version in [("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")] for mark, now in [("", "only"), ("+", "or-later")]}
TAG = "spdx-license-identifier"

for _name, (_words, _versions) in GNU.items():
    _key = _name.lower()
    _terms = f"you can redistribute it and/or modify it under the terms of the {_words} as published by the free software foundation"
    SENTENCES[_terms] = f"{_key}_terms"
    SENTENCES[f"see the {_words} for more details"] = f"{_key}_details"
    for _thing in ("program", "library"):
        SENTENCES[f"you should have received a copy of the {_words} along with this {_thing}"] = f"{_key}_copy"
    for _v in _versions:
        _either = f"either version {_v} of the license or (at your option) any later version"
        SENTENCES[_either] = f"gpl_v{_v}plus"
        # The two are one sentence where a comma parts them.
        SENTENCES[f"{_terms} {_either}"] = f"{_key}_terms gpl_v{_v}plus"
        _notice = ["gpl_free", f"{_key}_terms", f"gpl_v{_v}plus", "gpl_warranty", "gpl_implied", f"{_key}_details", f"{_key}_copy", "gpl_see"]
        RULES += [(f"{_name}-{_v if '.' in _v else _v + '.0'}-or-later", _notice[:n]) for n in (8, 7, 6, 3)]
RULES += [(name, [f"spdx:{name.lower()}"]) for name in SPDX] + [(name, [f"spdx:{old.lower()}"]) for old, name in SPDX_OLD.items()]

#: Every known sentence holds one of these, so texts without them need no sentences.
HINTS = "licen|copyright|permission|redistribut|warrant|free software|liable|rights reserved|gnu general|any later version|public domain|the mpl"
#: Steps of the scan, to a text whose lines end in a line feed and whose sentences in a form feed.
LINES = [
    (rf"({TAG}):", "$1"),
    (r"[ \t]+", " "),
    (r"\r?\n[ /#*;%-]*", "\n"),
    (r"([.!?;:])(?: ?\n| )", "$1\f"),
    (r"""(^|[\n\f])[ /#*;%"'-]+""", "$1"),
    (r"""(?<![ .!?;:"'*/])[ .!?;:"'*/]++(?=[\n\f]|\z)""", ""),
    (r"""[,:"'`]""", ""),
    (r" +", " "),
    (r" ?\n[ \n]*", "\n"),
    # The year may stand further on in the sentence; only the line is taken.
    (r"(?<![^\n\f])(?:copyright|\(c\))(?=[ \n](?:[^\f]*[ \n])?(?:\(c\)|[0-9]{4}))[^\n\f]*", "copyright"),
]
#: A tag and what its line may hold; ``identifiers`` takes those with a whole expression.
EXPRESSION = rf"{TAG} [a-z0-9.+() -]+"


def sentence_pattern(space: str) -> str:
    """Alternatives of all known sentences, the longest first, with ``space`` between words, and of SPDX tags."""
    known = sorted(SENTENCES, key=len, reverse=True)
    return "|".join([*(re.sub(r"([.()/+*?-])", r"\\\1", s).replace(" ", space) for s in known), EXPRESSION])


def _normal(text: Column) -> Column:
    for pattern, by in LINES:
        text = F.regexp_replace(text, pattern, by)
    return text


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    found = F.regexp_extract_all(_normal(F.lower(text)), F.lit(rf"(?<![^\n\f])(?:{sentence_pattern('[ \n]')})(?![^\n\f])"), F.lit(0))

    def of_sentence(s: Column) -> Column:
        expression = F.trim(F.regexp_replace(F.substring_index(s, f"{TAG} ", -1), "[() ]+", " "))
        names = F.split(expression, " (?:and|or|with) ")
        whole = ~F.exists(names, lambda x: (x == "") | F.contains(x, F.lit(" ")))
        return F.when(s.startswith(TAG), F.when(whole, F.transform(names, lambda x: F.concat(F.lit("spdx:"), x))).otherwise(F.array())).otherwise(F.split(F.element_at(known, F.translate(s, "\n", " ")), " "))

    return F.flatten(F.transform(found, of_sentence))


def match_rules(found: Column) -> Column:
    """struct(licenses, unmatched) of a sequence of identifiers."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {' '.join(ids)} ").alias("ids")) for name, ids in RULES])
    nothing = F.struct(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        ids = F.replace(rule["ids"], F.lit(" "), F.lit("  ")).substr(F.lit(2), F.length(F.replace(rule["ids"], F.lit(" "), F.lit("  "))) - 2)
        return F.when(F.contains(acc["left"], ids), F.struct(F.replace(acc["left"], ids, F.lit(" | ")).alias("left"), F.array_append(acc["names"], rule["name"]).alias("names"))).otherwise(acc)

    end = F.aggregate(rules, nothing, step)
    rest = F.filter(F.split(end["left"], "[ |]+"), lambda x: x != "")
    return F.struct(F.array_sort(F.array_distinct(end["names"])).alias("licenses"), rest.alias("unmatched"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, identifiers, licenses (sorted) and unmatched of each document with a known sentence."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.lower("text").rlike(HINTS))
    rows = rows.select("doc_id", identifiers(F.col("text")).alias("identifiers")).where(F.size("identifiers") > 0)
    return rows.withColumn("m", match_rules(F.col("identifiers"))).select("doc_id", "identifiers", "m.licenses", "m.unmatched")
