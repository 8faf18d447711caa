"""The other operators: brute force, round trips, edge cases."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import _vec, chat, decontaminate, language_id, licenses, packing, quality, queries, revisits, toxicity

LONG = "word " * 30_000


def test_words_and_hashes():
    import pyarrow as pa

    texts = _vec.strings(pa.array(["a bc", None, "", " \x0bd\x0c", "bc a"]))
    begins, ends, at = texts.words()
    assert [texts.buf[a:b].tobytes() for a, b in zip(begins, ends, strict=True)] == [b"a", b"bc", b"d", b"bc", b"a"]
    assert at.tolist() == [0, 2, 2, 2, 3, 5]
    hashes, _ = texts.word_hashes()
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3


def test_quality(documents, spark):
    texts = [None, "", "a " * 60, " ".join(f"w{k}" for k in range(60)), "x y z\nx y z\nq x y z", "l\nl\n\n \nl", "#a$ %é|", LONG]
    docs = documents(texts).withColumn("source", F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("source"))).selectExpr("*", "1 AS host", "true AS kept")
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    got = {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for k, r in rows.items()}
    assert got[0] == got[1] == (0, 0, 0, 0, 0)
    assert got[2] == (60, 60, 0, 0, 60) and rows[2].base_failed
    assert got[3][4] == 0 and rows[3].kept
    assert got[4] == (10, 10, 0, 1, 9) and got[5] == (3, 3, 0, 2, 0) and got[6] == (2, 6, 4, 0, 0)
    assert got[7][0] == 30_000 and got[7][4] == 30_000
    assert quality.judge(documents(["a"]).where("false")).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good if k % 4 else "short", None, "ok", 0) for k in range(60)] + [(100 + k, "short" if k else good, None, "bad", 0) for k in range(200)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert kept[1] and not kept[0] and not kept[100]


CONVERSATIONS = "conv_id long, turn long, role string, text string"
TRICKY = ["", "\\", "\\\\[INST]", "</s>[INST] ok [/INST]", "[\\INST]", "<s> a </s>", "[ROLE x] y [/ROLE]", "a\nb\r", "[/TOOL]é", " [SYS] ", "\\</s>\\"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "critic", "a] [b\\", "", None]
    rows = [(c, k, rng.choice(roles), rng.choice([None, *TRICKY]) and "".join(rng.choice(TRICKY) for _ in range(3))) for c in range(60) for k in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    out = chat.format_conversations(df.repartition(4)).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    for r in out:
        want = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)


OTHER_TEMPLATES = [
    chat.Template(roles={r: (f"<|im_start|>{r}\n", "<|im_end|>\n", r == "assistant") for r in ("system", "user", "assistant", "tool")}, other=("<|im_start|>", "\n", "<|im_end|>\n")),
    chat.Template(roles={"user": ("### Human: ", "\n###\n", False), "assistant": ("### Assistant: ", "\n###\n", True)}, other=("### (", ") ", "\n###\n")),
]


@pytest.mark.parametrize("template", OTHER_TEMPLATES)
def test_chat_round_trip_of_other_templates(spark, template):
    rng = random.Random(3)
    tricky = [x for b, a, _ in template.roles.values() for x in (b, a)] + ["\\", "#", "##", "<", "|", "\n", "x", "### (u) ", "<|im_start|>critic\nhi<|im_end|>\n", ""]
    rows = [(c, k, rng.choice(["user", "assistant", "system", "critic", "a\nb) \\"]), "".join(rng.choice(tricky) for _ in range(rng.randrange(5)))) for c in range(60) for k in range(rng.randrange(1, 6))]
    out = chat.format_conversations(spark.createDataFrame(rows, CONVERSATIONS), template)
    for r in out.select("conv_id", chat.read_back(F.col("formatted"), template).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect():
        want = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")


def test_templates_that_cannot_be_read_back_are_refused(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], CONVERSATIONS)
    with pytest.raises(ValueError):
        chat.format_conversations(df, chat.Template(roles={"user": ("#", "\n", False)}))


def test_chat_machine(spark):
    cases = {1: ["system", "user", "assistant"], 2: ["user", "user"], 3: ["assistant"], 4: ["user", "assistant", "tool", "assistant"], 5: ["user"], 6: ["user", "assistant", "system"]}
    df = spark.createDataFrame([(c, k, r, LONG if c == 1 else "x") for c, rs in cases.items() for k, r in enumerate(rs)], CONVERSATIONS)
    found = {r.conv_id: (r.valid, r.first_error) for r in chat.format_conversations(df).collect()}
    assert found == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (True, None), 5: (False, None), 6: (False, 2)}
    assert chat.format_conversations(df.where("false")).count() == 0


def test_licences(documents):
    mit = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy of this\n * software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n * The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n */"
    texts = ["Released under the MIT License.\nFoo bar.", mit, "Copyright (c) 2020 Jane Doe. All rights reserved. x", "# SPDX-License-Identifier: Apache-2.0\n", "no such thing", None, "", "a license of sorts\n" + "- " * 50_000, LONG + ". Licensed under CC BY-NC 4.0. Licensed under the MIT License. Licensed under the Apache License, Version 2.0."]
    rows = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(documents(texts).selectExpr("*", "1 AS m", "2 AS identifiers")).collect()}
    assert rows == {0: (["MIT"], []), 1: (["MIT"], []), 2: (["LicenseRef-All-Rights-Reserved"], ["copyright"]), 3: (["Apache-2.0"], []), 8: (["Apache-2.0", "CC-BY-NC-4.0", "MIT"], [])}


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """Copyright (C) 2021  Jane Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Copyright 2022 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_licence_headers_before_code(documents):
    code = "\nimport os\n\ndef f(x):\n    return x + 1\n"
    marked = lambda text, mark: "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())
    want = {
        "# SPDX-License-Identifier: MIT" + code: (["MIT"], []),
        "/* SPDX-License-Identifier: GPL-2.0-only */" + code: (["GPL-2.0-only"], []),
        "intro\r\nReleased under the MIT License\r\nand a body": (["MIT"], []),
        "a heading\nLicensed under the\nApache License, Version 2.0\nand a body": (["Apache-2.0"], []),
        MIT_FILE + code: (["MIT"], ["copyright"]),
        MIT_FILE.split("\n\n", 1)[1] + code: (["MIT"], ["copyright"]),
        marked(GPL, "#") + code: (["GPL-3.0-or-later"], ["copyright"]),
        marked(GPL.replace("version 3", "version 2"), "//") + code: (["GPL-2.0-or-later"], ["copyright"]),
        "/*\n" + marked(APACHE, " *") + " */" + code: (["Apache-2.0"], ["copyright"]),
        "(c) Jane Doe,\nJohn Doe 2020\nAll rights reserved\n" + code: (["LicenseRef-All-Rights-Reserved"], ["copyright"]),
        "not released under the MIT License\nat all": None,
    }
    rows = {r.doc_id: (r.licenses, r.unmatched, r.identifiers) for r in licenses.scan(documents(list(want))).collect()}
    assert {k: v[:2] for k, v in rows.items()} == {k: v for k, v in enumerate(want.values()) if v}
    assert rows[4][2] == ["copyright", "mit_grant", "mit_notice", "mit_warranty", "mit_liability"]
    assert rows[8][2] == ["copyright", "apache2_head", "apache2_comply", "apache2_copy", "apache2_basis", "apache2_see"]


ISC = """Copyright (c) 2019, Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD = """Copyright (c) 2018, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
AGPL = GPL.replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU Affero\nGeneral") + """
You should have received a copy of the GNU Affero General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the public
domain worldwide. This software is distributed without any warranty.

You should have received a copy of the CC0 Public Domain Dedication along with
this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.
"""
NOTICES = {
    ISC: (["ISC"], ["copyright"]),
    MPL: (["MPL-2.0"], []),
    BSD: (["BSD-3-Clause", "LicenseRef-All-Rights-Reserved"], ["copyright"]),
    BSD[: BSD.index("3. ")] + BSD[BSD.index("THIS SOFTWARE") :]: (["BSD-2-Clause", "LicenseRef-All-Rights-Reserved"], ["copyright"]),
    LGPL: (["LGPL-2.1-or-later"], []),
    AGPL: (["AGPL-3.0-or-later"], ["copyright"]),
    UNLICENSE: (["Unlicense"], []),
    CC0: (["CC0-1.0"], []),
    APACHE: (["Apache-2.0"], ["copyright"]),
    MIT_FILE: (["MIT"], ["copyright"]),
    "// SPDX-License-Identifier: Apache-2.0 OR MIT\ncode": (["Apache-2.0", "MIT"], []),
    "/* SPDX-License-Identifier: (LGPL-2.1+ AND ISC) */\ncode": (["ISC", "LGPL-2.1-or-later"], []),
    "# SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\n": (["GPL-2.0-only"], ["spdx:linux-syscall-note"]),
    "SPDX-License-Identifier: MIT is the tag we use": None,
    "SPDX-License-Identifier: MIT" + " OR ISC" * 20_000: (["ISC", "MIT"], []),
    "SPDX-License-Identifier: " + "(" * 50_000: None,
}


def test_genuine_notices_and_tags_by_scan_and_by_sql(documents):
    import duckdb

    texts = [*NOTICES, *(f"/**\r\n{''.join(f' * {line}{chr(13)}{chr(10)}' for line in n.splitlines())} */\r\nint main;" for n in list(NOTICES)[:10]), MIT_FILE, None, ""]
    want = [*NOTICES.values(), *list(NOTICES.values())[:10], NOTICES[MIT_FILE], None, None]
    df = documents(texts)
    rows = {r.doc_id: (r.identifiers, r.licenses, r.unmatched) for r in licenses.scan(df).collect()}
    assert {k: v[1:] for k, v in rows.items()} == {k: v for k, v in enumerate(want) if v}
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert {r[0]: tuple(r[1:]) for r in con.execute(queries.oracle_sql()["op1_license_scan"]).fetchall()} == {k: tuple(" ".join(x) for x in v) for k, v in rows.items()}


def test_every_licence_sentence_is_hinted_and_normal(spark):
    import re

    assert all(re.search(licenses.HINTS, s) for s in licenses.SENTENCES)
    rows = spark.createDataFrame([(s,) for s in licenses.SENTENCES], "t string").select("t", licenses._normal(F.col("t")).alias("c")).collect()
    assert all(r.c == r.t for r in rows)
    known = {i for ids in licenses.SENTENCES.values() for i in ids.split(" ")}
    assert {i for _, ids in licenses.RULES for i in ids if not i.startswith("spdx:")} <= known


def _records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, ts long, type string, status int, headers map<string,string>, digest string, response string, last int")


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com:80/x/?utm_source=f&b=2&a=1#t", 10, "response", 200, {"etag": '"1"', "content-type": "t", "vary": "x"}, "d1", "", 0),
        (2, "https://a.com/x?a=1&b=2", 200_000, "response", 200, {"last-modified": "m"}, "d2", "", 0),
        (3, "//a.com/x?a=1&b=2", 200_000, "revisit", 304, {"etag": 'W/"1"', "vary": "y", "content-type": "no"}, None, "", 0),
        (4, "//a.com/x?a=1&b=2", 900_000, "revisit", 304, {"last-modified": "other"}, None, "", 0),
        (5, "//a.com/x?a=1&b=2", 950_000, "revisit", 304, {}, "d2", "", 0),
        (6, "//a.com/x?a=1&b=2", 960_000, "revisit", 304, None, None, "", 0),
        (7, "//a.com/x?a=1&b=2", 5, "revisit", 304, {}, None, "", 0),
        (8, None, 5, "revisit", 304, {}, None, "", 0),
        (9, "//a.com/x?a=1&b=2", None, "revisit", 304, {}, None, "", 0),
        (10, "//a.com/x?a=1&b=2", 300_000, "response", 503, {}, None, "", 0),
    ]
    found = {r.record_id: r for r in revisits.resolve(_records(spark, rows)).collect()}
    assert {k: (r.response_id, r.outcome) for k, r in found.items()} == {3: (1, "resolved"), 4: (2, "mismatch"), 5: (2, "resolved"), 6: (2, "unchecked"), 7: (None, "orphan"), 8: (None, "orphan"), 9: (None, "orphan")}
    assert found[3].headers == {"etag": 'W/"1"', "content-type": "t", "vary": "y"}
    assert revisits.resolve(_records(spark, rows[:1])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_revisits_at_random(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"http://h/{rng.randrange(3)}", rng.randrange(40), rng.choice(["response", "revisit"]), rng.choice([200, 200, 404]), {}, None, "", 0) for k in range(200)]
    found = {r.record_id: r.response_id for r in revisits.resolve(_records(spark, rows), bucket_seconds=7).collect()}
    full = [r for r in rows if r[3] == "response" and r[4] == 200]
    want = {r[0]: max(((f[2], f[0]) for f in full if f[1] == r[1] and f[2] < r[2]), default=(None, None))[1] for r in rows if r[3] == "revisit"}
    assert found == want


def test_warc_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n\r\nWARC/1.1"
    head = {"WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://a/x", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Payload-Digest": "sha1:q"}
    data = revisits.write_record("warcinfo", {}, b"x") + revisits.write_record("response", head, http) + revisits.write_record("revisit", head, b"HTTP/1.1 304 Not Modified\r\n\r\n")
    records = list(revisits.parse_records(data))
    assert [k for k, _, _ in records] == ["warcinfo", "response", "revisit"] and records[1][2] == http
    assert list(revisits.parse_records(gzip.decompress(data))) == records
    assert [k for k, _, _ in revisits.parse_records(gzip.decompress(data)[:-40])] == ["warcinfo", "response"]
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = revisits.read_warc(spark, str(tmp_path)).collect()
    broken = tmp_path / "broken"
    broken.mkdir()
    dated = head | {"WARC-Date": "no date", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    (broken / "a.warc.gz").write_bytes(revisits.write_record("revisit", dated, b"HTTP/1.1 304 x\r\n\r\n") + data[:-20])
    (broken / "b.warc").write_bytes(b"no such file")
    found = revisits.read_warc(spark, str(broken))
    assert sorted((r.type, r.ts is None) for r in found.collect()) == [("response", False), ("revisit", True)]
    assert [r.outcome for r in revisits.resolve(found).collect()] == ["other"]
    assert [r.outcome for r in revisits.resolve(found.union(found).withColumn("profile", F.lit(None).cast("string"))).collect()] == ["orphan"] * 2
    assert [(r.type, r.status, r.ts, r.headers.get("etag")) for r in rows] == [("response", 200, 1704067200, '"1"'), ("revisit", 304, 1704067200, None)]


def test_language(spark, documents):
    rng = random.Random(2)
    say = {"en": "the of and to in that was his with", "de": "der die und den von das mit sich des", "fr": "les des est dans une pour qui sur au"}
    rows = [(k, " ".join(rng.choice(say[lang].split()) for _ in range(30)), lang, "s", 0) for k in range(300) for lang in [rng.choice(list(say))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.fit(df)
    found = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert sum(found[k].lang_pred == lang for k, _, lang, _, _ in rows) >= 295
    odd = documents([None, "", "123 !", "the " * 50_000, "x"])
    rows = language_id.identify(odd.selectExpr("*", "1 AS score"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:4]] == ["und", "und", "und", "en"] and rows[0].score == 0 and all(r.rejected for r in rows[:3])
    assert language_id.accepted(odd.selectExpr("*", "1 AS lettered"), model).count() >= 1
    assert language_id.identify(odd, language_id.fit(odd.where("false"))).where("rejected").count() == 5


def test_language_against_a_plain_program():
    """Subwords, averages, probabilities and rejection, text by text."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    model = language_id.Model(["x", "y", "z"], rng.normal(size=(language_id.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.3, 0.5)
    texts = ["a", "Ab  é\n", "the quick brown fox the the", "word " * 500, "1 2 q", "über straße"]

    def bucket(gram: bytes) -> int:
        return int(_vec.strings(pa.array([gram], pa.binary())).grams(len(gram))[0] >> np.uint64(50))

    columns = [pa.array(range(len(texts))), pa.array(texts), pa.array([True] * len(texts))]
    (found,) = language_id._predict(model)(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lettered"])]))
    (bags,) = language_id._bags(iter([pa.record_batch({"lang": texts, "text": texts})]))
    for k, text in enumerate(texts):
        words = [b"\x02" + w.encode() + b"\x03" for w in text.lower().split()]
        ids = [bucket(w[p : p + n]) for w in words for n in language_id.GRAMS for p in range(len(w) - n + 1)]
        logits = (np.mean([model.scores[i] for i in ids], 0) + model.bias) / model.temperature
        p = np.exp(logits) / np.exp(logits).sum()
        assert found.column(1)[k].as_py() == "xyz"[p.argmax()] and abs(found.column(2)[k].as_py() - p.max()) < 1e-4
        used, count = np.unique(ids, return_counts=True)
        assert np.frombuffer(bags.column(1)[k].as_py(), np.int32).tolist() == used.tolist()
        assert np.allclose(np.frombuffer(bags.column(2)[k].as_py(), np.float32), count / count.sum())


def test_toxicity_edges(spark, documents):
    docs = documents(["you idiot " * 5, "a fine day " * 5, None, "", LONG])
    flat = toxicity.fit(docs.where("false").withColumn("toxic", F.lit(1)), calibrate=F.lit(False))
    rows = toxicity.score(docs.selectExpr("*", "1 AS ratio"), flat).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1
    labelled = spark.createDataFrame([(k, ("you silly idiot " if k % 2 else "a fine warm day ") * 5, k % 2) for k in range(200)], "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, calibrate=F.col("doc_id") % 5 == 0)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert rows[0].predicted == 1 and rows[1].predicted == 0 and all(0 <= r.score <= 1 for r in rows.values())


def test_toxicity_with_few_toxic_rows_to_calibrate(spark, documents, monkeypatch):
    docs = documents(["you idiot " * 5, "a fine day " * 5])
    predicted = lambda model: [r.predicted for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    rows = [(k, ("you silly idiot " if k % 125 == 0 else "a fine warm day ") * 5, int(k % 125 == 0)) for k in range(1000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "CALIBRATE", 20)
    for apart in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 125 == 1, F.col("doc_id") % 125 == 0):
        assert predicted(toxicity.fit(labelled, calibrate=apart)) == [1, 0]


def test_toxicity_keeps_all_ngrams_apart():
    import pyarrow as pa

    rng = random.Random(7)
    texts = [" ".join("".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(0x400, 0x3000)])) for _ in range(6)) for _ in range(800)) for _ in range(20)]
    want: dict = {}
    for k, text in enumerate(texts):
        for word in text.split(" "):
            data = b"\x02" + word.encode() + b"\x03"
            for n in range(1, toxicity.ORDER + 1):
                for at in range(1, len(data)):
                    gram = n, data[max(0, at - n + 1) : at + 1]
                    want.setdefault(gram, [0, 0])[k % 2] += 1
    rows = pa.Table.from_batches(toxicity._count(iter([pa.record_batch({"text": texts, "toxic": [k % 2 for k in range(len(texts))]})])))
    found = {(r["n"], (r["gram"] & 0xFFFFFFFF).to_bytes(4)[4 - (r["gram"] >> 32) :]): [r["ordinary"], r["toxic"]] for r in rows.to_pylist()}
    assert found == want and len(found) == rows.num_rows > 150_000


def _toxicity_by_hand(rows, text):
    """The log ratio of a text, from dictionaries of n-grams as bytes."""
    from math import log

    def words(t):
        return [b"\x02" + w.encode() + b"\x03" for w in t.lower().split()]

    def grams(w, n):
        return [w[max(0, at - n + 1) : at + 1] for at in range(1, len(w))]

    def discount(counts):
        one, two = counts.count(1), counts.count(2)
        return one / (one + 2 * two) if one else 0.5

    order = toxicity.ORDER
    seen = {n: {g for t, _ in rows for w in words(t) for g in grams(w, n)} for n in range(1, order + 1)}
    below, longer = {}, None
    for n in range(1, order):
        continued = {g: sum(x[-n:] == g for x in seen[n + 1]) for g in seen[n]}
        d, own = discount(list(continued.values())), {}
        for g in seen[n]:
            same = [continued[x] for x in seen[n] if x[:-1] == g[:-1]]
            total, kinds = max(sum(same), 1), max(sum(c > 0 for c in same), 1)
            under = below[g[-(n - 1) :]] if n > 1 else 1 / 256
            own[g] = max(max(continued[g] - d, 0) / total + min(1, d * kinds / total) * under, 1e-9)
        below = own
    known, rest = {}, {}
    for label in (1, 0):
        counts = dict.fromkeys(seen[order], 0)
        for t, toxic in rows:
            for w in words(t):
                for g in grams(w, order):
                    counts[g] += toxic == label
        d = discount(list(counts.values()))
        for g in seen[order]:
            same = [counts[x] for x in seen[order] if x[:-1] == g[:-1]]
            rest[label, g[:-1]] = max(d * sum(c > 0 for c in same) / sum(same) if sum(same) else 1.0, 1e-6)
            known[label, g] = max(counts[g] - d, 0) / max(sum(same), 1) + rest[label, g[:-1]] * below[g[-(order - 1) :]]
    values = []
    for w in words(text):
        total = 0.0
        for g in grams(w, order):
            p = known if (1, g) in known else rest if (1, g := g[:-1]) in rest else None
            total += log(p[1, g] / p[0, g]) if p else 0.0
        values.append((total, len(w) - 1))
    runs = [values[k : k + toxicity.PASSAGE] for k in range(max(1, len(values) - toxicity.PASSAGE + 1))]
    return max((sum(v for v, _ in run) / sum(n for _, n in run) for run in runs if run), default=0.0)


def test_toxicity_against_a_plain_program():
    import pyarrow as pa

    rng = random.Random(8)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    rows = [(" ".join(rng.choices(words[:45] if k % 3 else words[15:], k=rng.randrange(1, 12))), int(k % 3 == 0)) for k in range(40)]
    batches = [pa.record_batch({"text": [t for t, _ in rows[a::2]], "toxic": [y for _, y in rows[a::2]]}) for a in (0, 1)]
    models = []
    for parts in (batches, batches[::-1], [pa.Table.from_batches(batches).combine_chunks().to_batches()[0]]):
        table = pa.Table.from_batches([x for b in parts for x in toxicity._count(iter([b]))]).group_by(["n", "gram"]).aggregate([("toxic", "sum"), ("ordinary", "sum")]).sort_by("gram")
        columns = {c.removesuffix("_sum"): table.column(c).to_numpy() for c in table.column_names}
        models.append(toxicity.Model(*toxicity._ratios({n: {c: v[columns["n"] == n] for c, v in columns.items()} for n in range(1, toxicity.ORDER + 1)}), 0.0, 0.0))
    # However the rows are dealt, the model is the same.
    assert all(np.array_equal(getattr(models[0], c), getattr(m, c)) for m in models for c in ("grams", "gram", "contexts", "context"))
    texts = [t for t, _ in rows[:10]] + ["", "zzz", "abc zq aé", " ".join(words)]
    (found,) = toxicity._log_ratios(models[0])(iter([pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})]))
    assert np.allclose(found.column(1).to_numpy(), [_toxicity_by_hand(rows, t) for t in texts], atol=1e-5)


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [None, "", "a", "Don't <|endoftext|>x İstanbul é́ Ⅻ ﬁ 你好 e\u0301 12,3", LONG[:60_000]] + [" ".join(rng.choice(["alpha", "Beta,", "gamma.", "δέλτα", "5km"]) for _ in range(rng.randrange(400))) for _ in range(80)]
    path = queries.tokenizer_path()
    rows = packing.pack_documents(documents(texts).selectExpr("*", "1 AS start", "2 AS ids").repartition(3), path, with_ids=True, shard_bytes=20_000).collect()
    tokenizer = Tokenizer.from_file(path)
    for k, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [i for p in pieces for i in p.ids] == want, text
        assert all(p.doc_tokens == len(want) and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:n]) for n in range(len(pieces))]
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:n]) for n in range(len(pieces))]
        assert size & (size - 1) == 0 and size <= 4096
    assert packing.pack_documents(documents(["a"]).where("false"), path).count() == 0


def _indexed(texts):
    """(a shard of all texts, their words)."""
    import pyarrow as pa

    ids, path = pa.array(range(len(texts))), queries.tokenizer_path()
    vocabulary = packing.Vocabulary.of(path, 2)
    batches = list(packing._read(path, 2, vocabulary.kind)(iter([pa.record_batch([ids, ids, pa.array(texts)], ["doc_id", "tie", "text"])])))
    (counted,) = packing._count(vocabulary)(iter(batches))
    corpus = packing.Corpus.of(*(c.to_numpy() for c in counted.columns))
    return packing.Shard(batches, corpus, vocabulary), [t.split() for t in texts]


def test_a_shard_is_indexed_in_bounded_memory():
    """Terms are found a slice at a time, not for all ids of a shard at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    words = np.array([f"w{k}" for k in range(2000)])
    drawn = np.random.default_rng(5).integers(0, len(words), (600, 1500))
    texts = [" ".join(words[row]) for row in drawn]
    ids, path = pa.array(range(len(texts))), queries.tokenizer_path()
    vocabulary = packing.Vocabulary.of(path, 2)
    batches = list(packing._read(path, 2, vocabulary.kind)(iter([pa.record_batch([ids, ids, pa.array(texts)], ["doc_id", "tie", "text"])])))
    corpus = packing.Corpus(len(texts), sum(map(len, texts)), 1500.0, np.ones(1 << packing.SLOTS, np.float32))
    tracemalloc.start()
    shard = packing.Shard(batches, corpus, vocabulary)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(shard.ids) == shard.off[-1] > 600 * 1500
    assert peak < 20 * shard.ids.nbytes
    whole = vocabulary.terms(shard.ids, shard.off)
    assert len(shard.doc_terms) == len(whole[0])  # all have a weight, and other documents that have them
    assert (shard.doc_off == np.searchsorted(whole[0], np.arange(601))).all()


def _bm25(words, seed):
    """Scores of all documents, by hand."""
    from math import log

    n, mean = len(words), sum(map(len, words)) / len(words)
    out = []
    for own in words:
        total = 0.0
        for t in set(words[seed]) & set(own):
            df = sum(t in w for w in words)
            idf = max(0.0, log((n - df + 0.5) / (df + 0.5)))
            tf = own.count(t)
            total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(own) / mean))
        out.append(total)
    return out


def test_neighbours_against_bm25_by_hand():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(150)]
    copy = " ".join(vocabulary[:3])
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(150)], k=rng.randrange(1, 60))) for _ in range(120)] + [copy] * 5 + [""]
    shard, words = _indexed(texts)
    used = np.zeros(len(texts), bool)
    used[[0, 2, 121]] = True
    for seed in (0, 7, 120, 125):
        want = _bm25(words, seed)
        assert np.allclose(np.delete(shard.scores(seed), seed), np.delete(want, seed), rtol=1e-4)
        order = list(shard.neighbours(seed, used))
        assert sorted(order) == [k for k in range(len(texts)) if not used[k]]
        scores = [want[k] for k in order if k != seed]
        assert all(x >= y - 1e-3 for x, y in zip(scores, scores[1:], strict=False))
        ties = [k for k in order if texts[k] == copy and k != seed]
        assert ties == sorted(ties)


def test_packing_is_greedy_and_does_not_depend_on_partitions(spark, documents):
    """A shard against a plain program: seeds in order, the best unused neighbours next, cut documents carried on."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(80)], k=rng.randrange(1, 30))) for _ in range(60)] + [" ".join(["big"] * 300)]
    shard, _ = _indexed(texts)
    window, want, left, carried = 64, [], list(range(len(texts))), None
    while left or carried:
        room, queue = window, None
        doc, start = carried or (left.pop(0), 0)
        seed, carried, sequence = doc, None, []
        while True:
            size = min(room, int(shard.sizes[doc]) - start)
            sequence.append((doc, start, size))
            room -= size
            if start + size < shard.sizes[doc]:
                carried = doc, start + size
            if not room or not left:
                break
            score = shard.scores(seed)
            doc, start = min(left, key=lambda k: (-score[k], k)), 0
            left.remove(doc)
        want.append(sequence)
    got: dict[int, list] = {}
    for doc, start, length, sequence, _ in shard.pack(window):
        got.setdefault(sequence, []).append((doc, start, length))
    full = [s for s in want if sum(x[2] for x in s) == window]
    assert len(full) >= len(want) - 1 and list(got.values())[: len(full)] == full

    path = queries.tokenizer_path()
    rows = [sorted(map(tuple, packing.pack_documents(documents(texts * 3).repartition(n), path, window=window, shard_bytes=2000).collect())) for n in (1, 5)]
    assert rows[0] == rows[1] and len({r[5] >> 32 for r in rows[0]}) > 3


def test_words_of_one_hash_have_their_own_ids(monkeypatch, documents):
    from tokenizers import Tokenizer

    monkeypatch.setattr(_vec.Texts, "span_hashes", lambda self, begins, ends, lower=False: np.full(len(begins), 7, np.uint64))
    path = queries.tokenizer_path()
    words = packing.WordIds(path)
    import pyarrow as pa

    texts = ["one two three one", "two four on", "one"]
    for text in texts:
        own = _vec.strings(pa.array([text]))
        begins, ends, hashes, _, where, which = packing._distinct(own)
        first, count = words.places(hashes[where], begins[where], ends[where], own.buf)
        found = words.ids[_vec.gather(first[which], count[which])].tolist()
        assert found == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def _overlaps(spark, documents, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(documents(texts).selectExpr("*", "9 AS item_id"), bench).collect()}


def test_decontamination(spark, documents):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [" ".join(word() for _ in range(40)), " ".join(word() for _ in range(8)), "a b", None, "", " ".join(word() for _ in range(30))]
    other = " ".join(word() for _ in range(300))
    changed = items[0].split()
    for k in range(4, 40, 9):
        changed[k] = "other"
    texts = [f"{other} {items[0].upper()}! {other}", f"x {' '.join(changed)} y", f"({items[1]})", "a b " * 50, None, "", other, " ".join(items[0].split()[:20]), " ".join(items[0].split()[:10]), f"{LONG}{items[5]}"]
    found = _overlaps(spark, documents, texts, items)
    assert set(found) == {(0, 0), (1, 0), (2, 1), (7, 0), (9, 5)}
    assert (found[0, 0].n_tokens, found[0, 0].n_substituted, found[0, 0].token) == (40, 0, 300)
    assert found[1, 0].n_substituted >= 3
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(documents(texts), bench).collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.overlaps(documents(texts), bench.where("false")).count() == 0


def test_decontamination_in_other_letter_case(spark, documents):
    items = [
        "Él dijo que mañana íbamos a cenar según la opinión de su señora después del café",
        "в начале было слово и слово было у бога и слово было бог оно было в начале",
        "οι άνθρωποι στους δρόμους της πόλης είδαν τους ξένους και τις γυναίκες στις πόρτες τους",
        "die straße außerhalb der größeren stadt heißt süße gasse und grüßt müßig alle füße weiß",
    ]
    found = _overlaps(spark, documents, [f"pad é {i.upper()} pad" for i in items], items)
    assert set(found) == {(k, k) for k in range(4)}
    assert all(r.n_tokens == len(items[k].split()) and r.n_substituted == 0 and r.token == 2 for (k, _), r in found.items())


def test_decontamination_of_short_items(spark, documents):
    sizes = list(range(decontaminate.LEAST, 26))
    items = [" ".join(f"i{n}w{k}" for k in range(n)) for n in sizes]
    assert set(_overlaps(spark, documents, ["It is. Two Words!\nno two words", "no two words", "two words", "a\nTwo\nwords\nb", "So: 42; done"], ["two words", "42", ""])) == {(0, 0), (2, 0), (3, 0), (4, 1)}
    texts, want = [], {}
    for item, n in enumerate(sizes):
        at = [{a, b} for a in range(n) for b in range(a, n) if a == b or n >= decontaminate.TWO_FROM]
        for changed in at:
            want[len(texts), item] = n
            texts.append(f"pad {' '.join('other' if k in changed else f'i{n}w{k}' for k in range(n))} pad")
    beyond = len(texts)
    texts += [" ".join("other" if k in (1, n - 2) else f"i{n}w{k}" for k in range(n)) for n in sizes if n < 15]
    found = _overlaps(spark, documents, texts, items)
    assert set(found) == set(want) and beyond < len(texts)
    assert all(r.n_tokens == n and r.token == 1 for (_, i), r in found.items() for n in [sizes[i]] if n <= decontaminate.SPAN)


def test_decontamination_in_blocks(spark, documents, monkeypatch):
    items = [" ".join(f"i{k}w{n}" for n in range(20)) for k in range(30)]
    texts = [f"pad {i} pad" for i in items] + ["nothing of it"]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    assert set(_overlaps(spark, documents, texts, items)) == {(k, k) for k in range(30)}
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    assert [r.doc_id for r in decontaminate.clean(documents(texts), bench).collect()] == [30]


def test_decontamination_with_ids_of_any_kind(spark):
    item = " ".join(f"w{n}" for n in range(20))
    docs = spark.createDataFrame([(None, item, 1), ("x", f"a {item}", 2), ("x", "clean", 3), (None, "clean", 4), ("y", None, 5)], "doc_id string, text string, __hit int")
    bench = spark.createDataFrame([(None, item), ("b", item), (None, None), ("b", item)], "item_id string, text string")
    rows = decontaminate.overlaps(docs, bench)
    assert dict(rows.dtypes)["doc_id"] == dict(rows.dtypes)["item_id"] == "string"
    assert sorted(((r.doc_id, r.item_id, r.token) for r in rows.collect()), key=str) == sorted([(d, i, int(d == "x")) for d in (None, "x") for i in (None, "b", "b")], key=str)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r["__hit"] for r in left.collect()) == [3, 4, 5]


def _by_hand(text, item):
    """(tokens that match, first token negated, tokens) of the best run, over all diagonals; or nothing."""
    import re

    x, y = ([t.encode() for t in re.findall("[a-z0-9\x80-\U0010ffff]+", s.casefold())] for s in (text, item))
    best = None
    for begin in range(-len(y), len(x) + 1):
        same = [x[begin + k] == y[k] for k in range(len(y)) if 0 <= begin + k < len(x)]
        at, runs = max(0, begin), []
        for a in range(len(same)):
            total = 0
            for b in range(a, len(same)):
                total += 1 if same[b] else decontaminate.SUBSTITUTION
                runs.append((total, -b, -a))
        total, b, a = max(runs, default=(0, 0, 0))
        length = a - b + 1 if total > 0 else 0
        wrong = same[-a : 1 - b].count(False) if length else 0
        if length >= min(decontaminate.OVERLAP, len(y)):
            best = max(best or (0, 0, 0), (length - wrong, a - at, length))
        elif len(same) == len(y) and same.count(False) <= 1 + (len(y) >= decontaminate.TWO_FROM):
            best = max(best or (0, 0, 0), (same.count(True), -begin, len(y)))
    return best


def test_decontamination_against_brute_force(spark, documents):
    """Runs of 13 to 40 tokens with up to one substitution in seven tokens: none is lost."""
    rng = random.Random(11)
    items = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(n)) for n in (20, 25, 30, 40) * 3]
    texts = []
    for k in range(400):
        words = items[k % 12].split()
        size = rng.randrange(min(13, len(words)), len(words) + 1)
        a = rng.randrange(len(words) - size + 1)
        words = words[a : a + size]
        for _ in range(rng.randrange(1 + size // 7)):
            words[rng.randrange(size)] = "other"
        texts.append("pad one two " + " ".join(words) + " three pad")
    found = {k: (r.n_tokens - r.n_substituted, -r.token, r.n_tokens) for k, r in _overlaps(spark, documents, texts, items).items()}
    want = {(i, j): w for i, t in enumerate(texts) for j in [i % 12] if (w := _by_hand(t, items[j]))}
    got = {k: v for k, v in found.items() if k in want}
    assert {k for k in found if k[1] == k[0] % 12} <= set(want)
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want) and len(want) > 250


def test_digest_of_empty_conversation(spark):
    rows = {r.conv_id: r for r in queries.op10_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert rows[-1].loss_chars == len(text) and rows[-1].valid


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b " * 40, None, None, None), (1, None, None, None, None), (1, "a fine text", "en", "s", 3), (1, "a fine text", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.judge(df).count() == 4
    assert toxicity.score(df, toxicity.fit(df.withColumn("toxic", F.lit(0)), calibrate=F.lit(True))).count() == 4
    assert language_id.identify(df, language_id.fit(df)).count() == 4
    assert packing.pack_documents(df, queries.tokenizer_path()).where("start = 0").count() == 4
    bench = spark.createDataFrame([(None, "a b a b a b a b a b a b a b a b")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.overlaps(df, bench).collect()] == [None]
    assert decontaminate.clean(df, bench).count() == 3
    assert licenses.scan(df).count() == 0
