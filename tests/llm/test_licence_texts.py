"""Licence scans of the standard texts as they are: wrapped, indented and commented out."""

from __future__ import annotations

import textwrap

import pytest

from flowtally.llm import licences

MIT = '''MIT License

Copyright (c) 2018 A. Writer

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
'''
GRANT = '''Copyright (c) 2020 A. Writer
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

'''
SOURCE = '''1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

'''
NAME = '''3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.

'''
DISCLAIMER = '''THIS SOFTWARE IS PROVIDED BY {} "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE.
'''
HOLDERS = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
BSD2, BSD3 = GRANT + SOURCE + DISCLAIMER.format(HOLDERS), GRANT + SOURCE + NAME.format("the copyright holder") + DISCLAIMER.format(HOLDERS)
NAMED = GRANT + SOURCE + NAME.format("the University of Nowhere") + DISCLAIMER.format("THE REGENTS AND\nCONTRIBUTORS")
CLEAR = BSD3.replace("are permitted provided", "are permitted (subject to the limitations in the disclaimer\nbelow) provided").replace("1. ", " * ").replace("2. ", " * ")
APACHE = '''Copyright 2020 A. Writer

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
GPL3 = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
'''
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
ONLY2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n"
ISC = "Copyright (c) 2020 A. Writer\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
CC = "This work is licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License.\n"
AGPL = GPL3.replace("GNU General", "GNU Affero General")
LGPL21 = GPL3.replace("GNU General", "GNU Lesser General").replace("program", "library").replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either\nversion 2.1")
LGPL3 = GPL3.replace("GNU General", "GNU Lesser General")
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.\n"
ZLIB = "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented.\n"
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
CC0 = """Certain owners wish to permanently relinquish those rights to a Work for the
purpose of contributing to a commons of creative, cultural and scientific
works ("Commons") that the public can reliably and without fear of later
claims of infringement build upon, modify, incorporate in other works, reuse
and redistribute as freely as possible in any form whatsoever and for any
purposes, including without limitation commercial purposes.
"""
TEXTS = {"AGPL-3.0-or-later": AGPL, "LGPL-2.1-or-later": LGPL21, "LGPL-3.0-or-later": LGPL3, "MPL-2.0": MPL, "Unlicense": UNLICENSE, "Zlib": ZLIB, "BSL-1.0": BOOST, "CC0-1.0": CC0, "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "BSD-3-Clause ": NAMED, "BSD-3-Clause-Clear": CLEAR, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "GPL-2.0-only": ONLY2, "ISC": ISC, "CC-BY-SA-4.0": CC}
FORMS = {
    "as it is": lambda t: t,
    "hashes": lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()),
    "slashes": lambda t: "".join(f"// {x}\n" for x in t.splitlines()),
    "stars": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint main;",
    "semicolons": lambda t: "".join(f";; {x}\n" for x in t.splitlines()),
    "carriage returns": lambda t: t.replace("\n", "\r\n"),
    "short lines": lambda t: "\n\n".join(textwrap.fill(x, 60) for x in t.split("\n\n")),
    "long lines": lambda t: "\n\n".join(textwrap.fill(x, 100) for x in t.split("\n\n")),
    "unwrapped": lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n")),
}


@pytest.mark.parametrize("form", FORMS)
def test_standard_texts(spark, form):
    docs = spark.createDataFrame([(k, "Some words\n\n" + FORMS[form](t)) for k, t in TEXTS.items()], "doc_id string, text string")
    assert {r.doc_id: r.licences for r in licences.scan(docs).collect()} == {k: k.strip() for k in TEXTS}


def test_every_rule_of_whole_sentences_can_fire():
    assert {i for runs in licences.WHOLE_RULES.values() for run in runs for i in run} <= set(licences.KNOWN.values())


def test_lines_that_only_hold_a_part_are_not_known(spark):
    texts = ["not licensed under\nthe MIT License", "Licensed under the MIT\n\nLicense", "Licensed under. The MIT License", "Licensed under the\nMIT License and more", "Title\nLicensed under the\nMIT License\nmore"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licences for r in licences.scan(docs).orderBy("doc_id").collect()] == ["", "", "", "", "MIT"]


def test_two_licences_in_one_text(spark):
    pairs = [("MIT", "Apache-2.0"), ("GPL-3.0-or-later", "BSD-3-Clause"), ("MPL-2.0", "Zlib")]
    docs = spark.createDataFrame([(k, f"Part one\n\n{TEXTS[a]}\n\nPart two\n\n{TEXTS[b]}") for k, (a, b) in enumerate(pairs)], "doc_id long, text string")
    assert [r.licences for r in licences.scan(docs).orderBy("doc_id").collect()] == [",".join(sorted(p)) for p in pairs]


def plain_ids(text: str) -> list[str]:
    """Sentences word by word, without patterns: for texts without comment marks and named holders."""
    out, words, blank = [], [], False
    flat = text.lower().replace("\r\n", "\n") + "\n\n"
    close = lambda: (out.append(" ".join(words).strip(". ")), words.clear())
    token = ""
    for k, c in enumerate(flat):
        if c.isascii() and (c.isalnum() or c == "."):
            token, blank = token + c, False
            continue
        ends = c in "!?;:" and flat[k + 1 : k + 2].isspace() or c.isspace() and (token.endswith(".") or c == "\n" and blank)
        if token:
            words.append(token.rstrip(".") if token.endswith(".") and c.isspace() else token)
            token = ""
        if ends:
            close()
        blank = c == "\n" or blank and c in " \t"
    return [licences.KNOWN[s] for s in out if s in licences.KNOWN]


def test_sentences_against_a_plain_reading(spark):
    texts = [t for k, t in TEXTS.items() if not k.endswith(" ") and " * " not in t]
    docs = spark.createDataFrame([(k, "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in licences.scan(docs).collect()}
    want = {r.doc_id: "|".join(plain_ids(r.text)) for r in docs.collect()}
    assert got == want and all(want.values())


# Mentions -----------------------------------------------------------------------------

MENTIONS = {
    "This project is licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License - see the LICENSE.md file for details.": "MIT",
    "The code was released under the Apache License 2.0 by its authors.": "Apache-2.0",
    "Licensed under the GNU General Public License v3.0": "GPL-3.0-only",
    "It is distributed under the terms of the GNU General Public License, version 2 or (at your option) any later version.": "GPL-2.0-or-later",
    "This work is licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "The text is available under a Creative Commons Attribution-ShareAlike License": "CC-BY-SA",
    "All of it is licensed under the BSD 3-Clause License, see below.": "BSD-3-Clause",
    "Code in this folder is licensed\nunder the Mozilla Public\nLicense, version 2.0, as is common.": "MPL-2.0",
    "Available under the ISC licence": "ISC",
    "The data are released under CC0 1.0 Universal.": "CC0-1.0",
    "Published under the LGPL v2.1 or later.": "LGPL-2.1-or-later",
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0\nint x;": "Apache-2.0",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n": "Apache-2.0,MIT",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later",
    "<p>This page is licensed under the <a href=\"x\">MIT License</a>.</p>": "MIT",
}
NEGATIVE = [
    "This project is not licensed under the MIT License.", "It was never released under the GPL v3.", "The MIT License is short.", "Licensed under the MIT License and more", "licensed under the mit licensee rules",
    "We wrote about permission, warranty and copyright.", "Released under the old bridge, the Apache helicopter 2.0 flew.", "SPDX-License-Identifier: Unknown-9", "It can't be licensed under the ISC License.", "A licensed plumber works under the MIT dome.",
    "released under the moon", "available under the counter", "The GPL v3 was discussed by people who hold a licence to fish.", "Distributed under the tree by MIT people.",
]


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licences for r in licences.scan(docs).orderBy("doc_id").collect()]


def test_mentions_in_longer_sentences(spark):
    got = scanned(spark, [f"Some words.\n\n{t}\n\nMore words." for t in MENTIONS])
    assert dict(zip(MENTIONS, got)) == MENTIONS


def test_no_licence_where_none_is_given(spark):
    assert dict(zip(NEGATIVE, scanned(spark, NEGATIVE))) == dict.fromkeys(NEGATIVE, "")


LETTERS = BSD3.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) ")
ONE_LINE = " ".join(MIT.split())
TAGGED = "<html><body><pre>" + MIT.replace('"', "&quot;") + "</pre></body></html>"
COPYING = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"
LESSER = COPYING.replace("GNU GENERAL", "GNU LESSER GENERAL").replace("Version 3, 29 June 2007", "Version 2.1, February 1999").split(" Copyright")[0]


def test_whole_texts_in_other_layouts(spark):
    assert scanned(spark, [LETTERS, ONE_LINE, TAGGED, COPYING, LESSER]) == ["BSD-3-Clause", "MIT", "MIT", "GPL-3.0-only", "LGPL-2.1-only"]


def test_the_oracle_reads_all_of_these(spark):
    """The SQL, which knows no look-around, against the scan on every text, form and mention of this file."""
    import duckdb

    texts = [f(t) for f in FORMS.values() for t in TEXTS.values()] + [*MENTIONS, *NEGATIVE, LETTERS, ONE_LINE, TAGGED, COPYING, LESSER, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT * FROM documents")
    want = {r[0]: r[1:] for r in con.sql(licences.oracle_sql()).fetchall()}
    got = {r.doc_id: (r.n_known, r.sentences, r.licences) for r in licences.scan(docs).collect()}
    assert {k: (got[k], want[k], texts[k]) for k in got if got[k] != want[k]} == {}
