"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, every run of
other characters than letters, digits and dots a space, outer dots dropped) and looked
up among known licence sentences.  Sentences may be wrapped over lines and commented out,
as in the standard texts; a notice may also be a line of its own.  What is left of a text is the sequence of known
sentence identifiers; a rule is an ordered run of identifiers, and a text holds a
licence if one of its rules occurs in the sequence without a gap of known sentences.

Longer sentences that mention a licence ("this project is licensed under the X license, see the
file") and SPDX tags are rewritten into a known sentence first: a verb that is not denied, a
preposition and a licence's name, which ends the sentence or the line or goes on with one of
``TAILS``.  A copyright line ends where a known sentence begins, letters and numbers in brackets
before a clause go as comment marks do, and tags of markup count as spaces.

All of it is one projection over the text: no shuffle, no Python.  A known sentence
always has one of ``ANCHORS``, so texts without any are settled by one pattern.

Cases: null, empty and blank texts have no sentences and no licence; a sentence that
repeats counts each time; a long text is read whole; more columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Normalised sentences of well-known licences, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_condition",
    "the software is provided as is without warranty of any kind express or implied": "mit_warranty",
    "licensed under the apache license version 2.0": "apache_notice",
    "licensed under the apache license version 2.0 the license": "apache_notice",
    "you may not use this file except in compliance with the license": "apache_condition",
    "you may obtain a copy of the license at": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache_warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "this work is licensed under the gnu general public license version 2": "gpl2_notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl_grant",
    "either version 3 of the license or at your option any later version": "gpl3_or_later",
    "either version 2 of the license or at your option any later version": "gpl2_or_later",
    "licensed under cc by nc 4.0": "cc_by_nc_notice",
    "licensed under cc by 4.0": "cc_by_notice",
    "licensed under cc by sa 4.0": "cc_by_sa_notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc_by_notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd_binary",
    "this software is provided by the copyright holders and contributors as is": "bsd_warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc_grant",
}
# Licence -> its rules, each an ordered run of sentence identifiers.
RULES = {
    "Apache-2.0": [["apache_notice"], ["apache_condition", "apache_copy", "apache_warranty"]],
    "BSD-2-Clause": [["bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty"], ["bsd_source", "bsd_binary"]],
    "CC-BY-4.0": [["cc_by_notice"]],
    "CC-BY-NC-4.0": [["cc_by_nc_notice"]],
    "CC-BY-SA-4.0": [["cc_by_sa_notice"]],
    "GPL-2.0-only": [["gpl2_notice"]],
    "GPL-2.0-or-later": [["gpl_grant", "gpl2_or_later"]],
    "GPL-3.0-only": [["gpl3_notice"]],
    "GPL-3.0-or-later": [["gpl_grant", "gpl3_or_later"]],
    "ISC": [["isc_grant"]],
    "MIT": [["mit_notice"], ["mit_grant", "mit_condition"], ["mit_grant", "mit_condition", "mit_warranty"]],
}
MENTION_ANCHORS = (r"\b[al]?gpl", r"\bcc[ -]by", r"\bcc0\b", "creative commons", r"\bmpl\b", "spdx")
ANCHORS = ("licen", "permission", "copyright", "warranty", "redistribut", "acknowledgement", "or later", "public domain")
# The whole sentences of the standard texts, normalised like SENTENCES.
WHOLE = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_warranty",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_or_later_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_or_later_grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3_notice",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_or_later_grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license version 3 as published by the free software foundation": "agpl3_notice",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_or_later_grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21_or_later_grant",
    "either version 2.1 of the license or at your option any later version": "lgpl21_or_later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl_notice",
    "this is free and unencumbered software released into the public domain": "unlicense_dedication",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost_grant",
    "certain owners wish to permanently relinquish those rights to a work for the purpose of contributing to a commons of creative cultural and scientific works commons that the public can reliably and without fear of later claims of infringement build upon modify incorporate in other works reuse and redistribute as freely as possible in any form whatsoever and for any purposes including without limitation commercial purposes": "cc0_purpose",
    "this work is licensed under the creative commons attribution 4.0 international license": "cc_by_notice",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "cc_by_sa_notice",
    "this work is licensed under the creative commons attribution sharealike 4.0 international license": "cc_by_sa_notice",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "cc_by_nc_notice",
    "this work is licensed under the creative commons attribution noncommercial 4.0 international license": "cc_by_nc_notice",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4.0 international public license public license": "cc_by_notice",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4.0 international public license public license": "cc_by_sa_notice",
    "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4.0 international public license public license": "cc_by_nc_notice",
    "redistribution and use in source and binary forms with or without modification are permitted subject to the limitations in the disclaimer below provided that the following conditions are met": "bsd_clear_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source_clause",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary_clause",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advertising_clause",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorsement_clause",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty_clause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
}
WHOLE_RULES = {
    "AGPL-3.0-only": [["agpl3_notice"]],
    "AGPL-3.0-or-later": [["agpl3_or_later_grant"]],
    "Apache-2.0": [["apache_grant"]],
    "BSD-2-Clause": [["bsd_grant", "bsd_source_clause", "bsd_binary_clause", "bsd_warranty_clause"]],
    "BSD-3-Clause": [["bsd_grant", "bsd_source_clause", "bsd_binary_clause", "bsd_endorsement_clause"]],
    "BSD-3-Clause-Clear": [["bsd_clear_grant", "bsd_source_clause", "bsd_binary_clause", "bsd_endorsement_clause"]],
    "BSD-4-Clause": [["bsd_grant", "bsd_source_clause", "bsd_binary_clause", "bsd_advertising_clause"]],
    "BSL-1.0": [["boost_grant"]],
    "CC0-1.0": [["cc0_purpose"]],
    "GPL-2.0-or-later": [["gpl2_or_later_grant"]],
    "GPL-3.0-or-later": [["gpl3_or_later_grant"]],
    "LGPL-2.1-or-later": [["lgpl_grant", "lgpl21_or_later"], ["lgpl21_or_later_grant"]],
    "LGPL-3.0-or-later": [["lgpl_grant", "gpl3_or_later"], ["lgpl3_or_later_grant"]],
    "MPL-2.0": [["mpl_notice"]],
    "Unlicense": [["unlicense_dedication"]],
    "Zlib": [["zlib_grant"]],
}
# Titles of whole licence texts and the openings of their preambles.
TITLES = {
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu lesser general public license version 2.1 february 1999": "lgpl21_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "mozilla public license version 2.0": "mpl_title",
    "apache license version 2.0 january 2004": "apache_title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3_preamble",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl3_preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "gnu_v2_preamble",
}
# How licences are named in mentions (patterns without groups that capture), by SPDX identifier or family.
LATER = "(?: or(?: at your option)?(?: any)? later(?: version)?)"
V = lambda n: rf"(?: license)?(?: version| v)? ?v?{n}(?:\.0)?"
GNU = {"GPL": ("(?:gnu general public license|gnu gpl|gpl)", ("2", "3")), "LGPL": ("(?:gnu lesser general public license|gnu library general public license|gnu lgpl|lgpl)", (r"2\.1", "3")), "AGPL": ("(?:gnu affero general public license|gnu agpl|agpl)", ("3",))}
NAMES = {
    "MIT": "(?:mit|expat)(?: open source)? licen[sc]e",
    "Apache-2.0": rf"(?:apache(?: software)? licen[sc]e{V('2')}|apache{V('2')}(?: licen[sc]e)?|asl 2\.0)",
    "BSD-3-Clause": "(?:bsd 3 clause(?: licen[sc]e)?|(?:3|three) clause bsd(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e)",
    "BSD-2-Clause": "(?:bsd 2 clause(?: licen[sc]e)?|(?:2|two) clause bsd(?: licen[sc]e)?|(?:simplified|freebsd) bsd licen[sc]e)",
    "ISC": "isc licen[sc]e",
    "MPL-2.0": rf"(?:mozilla public licen[sc]e|mpl){V('2')}",
    "Zlib": "zlib(?: libpng)? licen[sc]e",
    "BSL-1.0": r"boost software licen[sc]e(?: version| v)? ?1\.0",
    "Unlicense": "the unlicense",
    "CC0-1.0": r"(?:cc0(?: 1\.0)?|creative commons zero(?: v?1\.0)?)(?: universal)?(?: licen[sc]e)?",
    **{f"{k}-{v.replace(chr(92), '')}{'' if '.' in v else '.0'}-or-later": rf"{name}{V(v)}{LATER}" for k, (name, versions) in GNU.items() for v in versions},
    **{f"{k}-{v.replace(chr(92), '')}{'' if '.' in v else '.0'}-only": rf"{name}{V(v)}(?: only)?(?: licen[sc]e)?" for k, (name, versions) in GNU.items() for v in versions},
    **{f"CC-{kind}-4.0": rf"(?:cc {kind.lower().replace('-', ' ')} 4\.0|creative commons {long} 4\.0)(?: international)?(?: public)?(?: licen[sc]e)?" for kind, long in (("BY-NC-SA", "attribution non ?commercial share ?alike"), ("BY-NC", "attribution non ?commercial"), ("BY-SA", "attribution share ?alike"), ("BY", "attribution"))},
    **{f"CC-{kind}": rf"(?:cc {kind.lower().replace('-', ' ')}|creative commons {long})(?: international)?(?: public)?(?: licen[sc]e)?" for kind, long in (("BY-NC-SA", "attribution non ?commercial share ?alike"), ("BY-NC", "attribution non ?commercial"), ("BY-SA", "attribution share ?alike"), ("BY", "attribution"))},
    **{k: f"{name}(?: licen[sc]e)?" for k, (name, _) in GNU.items()},
}
VERB = "(?:dual )?(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|covered|made available)"
TAILS = "(?:see|for|as|at|which|except|unless|by|to|in|copyright|http|https|found|you)"
# What a tag of markup looks like, and a denied verb.
TAG = r"</?[a-z][^<>]{0,200}>|&(?:[a-z]{2,6}|#[0-9]{1,5});"
DENIED = r"\b(not|never|longer|cannot|t)((?: be| been|\nbe)?[ \n])(licen|releas|distrib|redistrib|avail|publish|provid|cover|made)"
KNOWN = SENTENCES | WHOLE | TITLES
# A mention counts as the notice of its licence where the tables have one.
NOTICES = {"MIT": "mit_notice", "Apache-2.0": "apache_notice", "GPL-3.0-only": "gpl3_notice", "GPL-2.0-only": "gpl2_notice", "AGPL-3.0-only": "agpl3_notice", "MPL-2.0": "mpl_notice", "CC-BY-4.0": "cc_by_notice", "CC-BY-NC-4.0": "cc_by_nc_notice", "CC-BY-SA-4.0": "cc_by_sa_notice"}
MENTIONED = {name: NOTICES.get(name, f"mention_{name}") for name in NAMES}
ALL_RULES = {name: RULES.get(name, []) + WHOLE_RULES.get(name, []) + ([[MENTIONED[name]]] if name in NAMES and name not in NOTICES else []) for name in {**RULES, **WHOLE_RULES, **NAMES}}
for _name, _title in (("GPL-3.0-only", "gpl3_title"), ("GPL-2.0-only", "gpl2_title"), ("LGPL-3.0-only", "lgpl3_title"), ("LGPL-2.1-only", "lgpl21_title"), ("AGPL-3.0-only", "agpl3_title"), ("MPL-2.0", "mpl_title"), ("Apache-2.0", "apache_title")):
    ALL_RULES[_name] = [*ALL_RULES[_name], [_title]]
# Where a standard text names its holder, the name is put back to the standard one.
HOLDERS = {
    r"neither[ \n]the[ \n]names?[ \n]of[ \n][a-z0-9. \n]+?[ \n]nor[ \n]the[ \n]names[ \n]of[ \n](?:its|their|the|any)[ \n]contributors": "neither the name of the copyright holder nor the names of its contributors",
    r"this[ \n]software[ \n]is[ \n]provided[ \n]by[ \n][a-z0-9. \n]+?[ \n]as[ \n]is[ \n]and[ \n]any": "this software is provided by the copyright holders and contributors as is and any",
}
# Comment marks at the start of a line; ends of sentences and blank lines; what a space stands for, newlines aside.
MARKS = r"(?<![^\x0A\x0D])[\x20\x09]*+(?:[#/*;:!%>|<-]+|(?:rem|dnl)(?=[\x20\x09\x0A\x0D]))"
LETTERED = r"(?<![^\x0A\x0D])[\x20\x09]*+\(?(?:[a-z]|[0-9]{1,2}|[ivx]{2,4})\)(?=[\x20\x09])"
STOP = r"[.!?;:]+[\x20\x09-\x0D]+|(?>\x0D\x0A|\x0A|\x0D)[\x20\x09]*+[\x0A\x0D][\x20\x09-\x0D]*+"
INLINE = r"[^a-z0-9.\x0A\x0D\x01]+"


def _anchored(sentences: dict[str, str]) -> str:
    missing = [s for s in sentences if not any(a in s for a in ANCHORS) and "later version" not in s]
    if missing:
        raise ValueError(f"no anchor in: {missing}")
    return "|".join((*ANCHORS, "later version", *MENTION_ANCHORS))


# Patterns that Java's and RE2's engines read alike, on normalised text.
GAP = r"[ \n]"
FREE = lambda pattern: pattern.replace("\\n", "\0").replace(" ", r"[ \n]").replace("\0", "\\n")


def mention_pattern() -> str:
    """Groups: what comes before, the licence's name, and the end of the sentence or line or what goes on."""
    names = "|".join(NAMES.values())
    verb = f"{VERB}(?: to you| freely| here)? (?:under|by|with)(?: the terms(?: and conditions)? of| version [0-9.]+ of)?(?: the| a| an)? "
    return rf"(^|[ \n\x01]){FREE(verb)}({FREE(names)})([. ]*(?:[\n\x01]|\z)|{FREE(' ' + TAILS)}\b)"


def spdx_pattern() -> str:
    """Groups: up to three names of an SPDX tag, joined by or, and, with."""
    name = r"[a-z0-9]+(?:[ .][a-z0-9.]+)*?(?: or later)?"
    return rf"spdx license identifier[ \x01]+({name})(?: (?:or|and) ({name}))?(?: (?:or|and) ({name}))?[. ]*([\n\x01]|\z)"


def spdx_name(licence: str) -> str:
    return licence.lower().replace("-", " ")


def named_mentions(names: Column) -> Column:
    """The identifier of a mention, from the name that was met."""
    out = F.lit(None).cast("string")
    for licence, pattern in reversed(NAMES.items()):
        out = F.when((names == spdx_name(licence)) | names.rlike(rf"^(?:{pattern})$"), F.lit(MENTIONED[licence])).otherwise(out)
    return out


# What follows the layout: pairs of a pattern, read alike by Java and RE2, and what takes its place.
CLOSING = [
    *HOLDERS.items(),
    (DENIED, r"\1\2un\3"),
    (mention_pattern(), "\\1\x01=\\2\x01\\3"),
    (spdx_pattern(), "\x01=\\1\x01=\\2\x01=\\3\x01\\4"),
    # A grant behind other words, as where the layout is lost, is a sentence of its own.
    (rf"([^\x01\n]) ({FREE('permission is hereby granted free|redistribution and use in source and binary')})", "\\1\x01\\2"),
]


def plain_text(text: Column) -> Column:
    """A text as lines of words, with \\x01 at every end of a sentence, its mentions as sentences of their own."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "\x01", " "), TAG, " ")
    plain = F.regexp_replace(F.regexp_replace(low, MARKS, ""), LETTERED, "")
    plain = F.regexp_replace(F.regexp_replace(plain, STOP, "\x01"), INLINE, " ")
    plain = F.regexp_replace(plain, r" ?[\x0A\x0D][ \x0A\x0D]*+", "\n")
    for pattern, instead in CLOSING:
        plain = F.regexp_replace(plain, pattern, instead.replace("\\", "$"))
    return plain


def sentence_ids(text: Column, sentences: dict[str, str] = KNOWN) -> Column:
    """The identifiers of the known sentences of a text, in order.

    A known sentence starts and ends with a line or a sentence and may be wrapped between any two words.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    any_ = "|".join(s.replace(".", r"\.").replace(" ", r"[ \n]") for s in sorted(sentences, key=len, reverse=True))
    found = F.regexp_extract_all(plain_text(text), F.lit(rf"(?<![^\x01\n])(?:[. ]*+({any_})[. ]*+|=([^\x01]*+))(?![^\x01\n])"), F.lit(0))
    tidy = F.transform(found, lambda s: F.trim(F.translate(s, "\n", " "), F.lit(". ")))
    ids = F.transform(tidy, lambda s: F.when(s.startswith("="), named_mentions(F.substr(s, F.lit(2)))).otherwise(F.try_element_at(known, s)))
    return F.when(F.lower(text).rlike(_anchored(sentences)), F.array_compact(ids)).otherwise(F.array().cast("array<string>"))


def licences(ids: Column, rules: dict[str, list[list[str]]] = ALL_RULES) -> Column:
    """The licences of which a rule occurs in a sequence of identifiers, in order of name."""
    path = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    found = [F.when(F.greatest(*[F.contains(path, F.lit("|" + "|".join(r) + "|")) for r in [*runs, runs[0]]]), F.lit(name)) for name, runs in sorted(rules.items())]
    return F.array_compact(F.array(*found))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_known (known sentences), sentences (identifiers in order) and licences of every row."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(sentence_ids(F.col(text)), F.array().cast("array<string>")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", "|").alias("sentences"), F.array_join(licences(F.col("ids")), ",").alias("licences"))


def oracle_sql() -> str:
    """The scan in DuckDB's SQL, from the same tables and CLOSING patterns, without look-around: every run of lines of a sentence is looked up."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in KNOWN.items())
    tests = ", ".join("CASE WHEN " + " OR ".join(f"contains(path, {q('|' + '|'.join(r) + '|')})" for r in runs) + f" THEN {q(name)} END" for name, runs in sorted(ALL_RULES.items()))
    steps = [
        ("\x01", " "), (TAG, " "), (r"\r\n", "\n"), (r"(^|[\n\r])[ \t]*(?:rem|dnl)([ \t\n\r])", r"\1\2"), (r"(^|[\n\r])[ \t]*[#/*;:!%>|<-]+", r"\1"),
        (r"(^|[\n\r])[ \t]*\(?(?:[a-z]|[0-9]{1,2}|[ivx]{2,4})\)([ \t])", r"\1\2"), (r"[.!?;:]+[\x20\x09-\x0D]+|[\n\r][ \t]*[\n\r][\x20\x09-\x0D]*", "\x01"), (INLINE, " "), (r" ?[\n\r][ \n\r]*", "\n"), *CLOSING,
    ]
    plain = "lower(coalesce(text, ''))"
    for pattern, instead in steps:
        plain = f"regexp_replace({plain}, {q(pattern)}, {q(instead)}, 'g')"
    named = "CASE " + " ".join(f"WHEN name = {q(spdx_name(n))} OR regexp_full_match(name, {q(p)}) THEN {q(MENTIONED[n])}" for n, p in NAMES.items()) + " END"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
every AS (SELECT doc_id, row_number() OVER () AS rid, text FROM documents),
parts AS (
  SELECT rid, z[1] AS part, CAST(z[2] AS BIGINT) AS sno FROM (
    SELECT rid, unnest(list_zip(list, range(1, len(list) + 1))) AS z FROM (
      SELECT rid, string_split({plain}, chr(1)) AS list FROM every WHERE regexp_matches(lower(coalesce(text, '')), {q(_anchored(KNOWN))})))),
runs AS (
  SELECT rid, sno, i, unnest(range(i, least(i + 16, len(lines) + 1))) AS j, lines FROM (
    SELECT rid, sno, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT rid, sno, string_split(part, chr(10)) AS lines FROM parts))),
met AS (SELECT r.rid, r.sno, r.i, r.j, k.id FROM (SELECT rid, sno, i, j, trim(array_to_string(lines[i:j], ' '), '. ') AS sentence FROM runs) r JOIN known k USING (sentence)),
kept AS (SELECT rid, sno, i, id FROM met a WHERE NOT EXISTS (SELECT 1 FROM met b WHERE b.rid = a.rid AND b.sno = a.sno AND ((b.i < a.i AND b.j >= a.i) OR (b.i = a.i AND b.j > a.j)))
  UNION ALL SELECT rid, sno, 0, {named} FROM (SELECT rid, sno, trim(replace(part[2:], chr(10), ' '), '. ') AS name FROM parts WHERE starts_with(part, '='))),
seq AS (SELECT rid, count(*) AS n, string_agg(id, '|' ORDER BY sno, i) AS sentences FROM kept WHERE id IS NOT NULL GROUP BY rid),
all_ AS (SELECT e.doc_id, coalesce(s.n, 0) AS n_known, coalesce(s.sentences, '') AS sentences FROM every e LEFT JOIN seq s USING (rid)),
pathed AS (SELECT *, '|' || sentences || '|' AS path FROM all_)
SELECT doc_id, n_known, sentences, concat_ws(',', {tests}) AS licences FROM pathed
"""
