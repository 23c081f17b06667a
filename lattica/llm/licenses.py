"""Licence scans by rules over sentences (DataFrame functions only).

Sentences are normalised and mapped to identifiers of known licence sentences; the sequence of a text's identifiers is
matched against ordered rules. A rule takes the identifiers that it matches, so a later rule can't match them again.

Sentences that say that a work is released, licensed, distributed or available under something are put in one form,
"under ...", whatever the work and the verb. Lines of a paragraph are joined, so a sentence may be wrapped anywhere. A known sentence also counts if it fills whole
lines of a paragraph without end marks, as titles and tags do, or what stands before or after a colon.

Each operand of an SPDX expression (OR, AND, WITH, parentheses) is a tag of its own, exceptions too, and "+" after a GNU
licence is "or later". "Under either of A or B at your option" is a grant of each. Whether licences are a choice or hold
together isn't told apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = r"[.!?;]+(\s|$)"
#: Where a sentence may be wrapped or a known one may end: after a colon, as at the end of a line.
COLON = r":(?:[ \t\r]+\n?|\n)"
#: A list's number or letter before its item, which begins a sentence.
LIST_MARK = r"\n[^A-Za-z0-9\n]{0,40}[A-Za-z0-9]{1,2}\)[ \t]"

# Identifiers of known licence sentences, and their texts as normalised, one or several.
_MIT_COPY = "permission is hereby granted free of charge to any person obtaining a copy"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted"
_BSD_SOURCE = "must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = (
    "must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_BSD_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_HOLDER = "neither the name of the copyright holder nor the names of its contributors " + _BSD_ENDORSE
SENTENCES = {
    "apache-grant": (
        "under apache license version 2 0",
        "under apache license version 2 0 the license",
        "under apache license version 2 0 license",
        "the asf licenses this file to you under the apache license version 2 0 the license",
        "the asf licenses this file to you under the apache license version 2 0",
        "under apache license 2 0",
        "under apache 2 0 license",
        "apache license version 2 0 january 2004",
    ),
    "apache-compliance": (
        "you may not use this file except in compliance with the license",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "mit-name": ("mit license", "the mit license", "the mit license mit", "mit license mit"),
    "mit-released": ("under mit license", "under mit license mit"),
    "mit-grant": (
        _MIT_COPY,
        *(
            f"{_MIT_COPY} of this software and {files} the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
            f"software and to permit persons to whom the software is furnished to do so{end}"
            for files in ("associated documentation files", "associated documentation")
            for end in (" subject to the following conditions", "")
        ),
    ),
    "gpl-terms": "this program is free software you can redistribute it under the terms of the gnu general public license",
    "gpl-3": (
        "gnu general public license version 3",
        "gnu general public license version 3 29 june 2007",
        "under gnu general public license version 3",
        "under gnu gpl version 3",
        "under gpl v3",
    ),
    "gpl-2": (
        "gnu general public license version 2",
        "gnu general public license version 2 june 1991",
        "under gnu general public license version 2",
        "under gpl v2",
    ),
    "bsd-grant": (
        _BSD_GRANT,
        f"{_BSD_GRANT} provided that the following conditions are met",
        f"{_BSD_GRANT} provided that the following condition is met",
        f"{_BSD_GRANT} subject to the following conditions",
    ),
    "bsd-source": (
        f"redistributions of source code {_BSD_SOURCE}",
        f"redistributions of source code {_BSD_SOURCE} and",
        f"redistribution of source code {_BSD_SOURCE}",
    ),
    "bsd-binary": (
        f"redistributions in binary form {_BSD_BINARY}",
        f"redistributions in binary form {_BSD_BINARY} and",
        f"redistribution in binary form {_BSD_BINARY}",
    ),
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": (_HOLDER, f"the name of the author may not be {_BSD_ENDORSE[len('may be '):]}"),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v",  # "v." ends a sentence
        "under mozilla public license version 2 0",
        "under mozilla public license 2 0",
        "mozilla public license version 2 0",
    ),
    "epl-1": ("under eclipse public license v1 0", "under eclipse public license 1 0", "eclipse public license v 1 0"),
    "epl-2": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 "
        "which is available at",
        "under eclipse public license 2 0",
        "under eclipse public license v2 0",
        "eclipse public license v 2 0",
    ),
    "permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "under isc license",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "under unlicense",
    ),
    "boost": (
        "under boost software license version 1 0",
        "under boost software license 1 0",
        "boost software license version 1 0 august 17th 2003",
        "boost software license version 1 0",
    ),
    "zlib-grant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter "
        "it and redistribute it freely subject to the following restrictions",
        "under zlib license",
    ),
    "cc0": (
        "under cc0 1 0",
        "under cc0 1 0 universal",
        "under creative commons cc0 1 0 universal license",
        "under creative commons zero v1 0 universal",
    ),
    "wtfpl": ("do what the fuck you want to public license", "under wtfpl"),
    "artistic-2": ("under artistic license 2 0", "the artistic license 2 0"),
    "cddl-1": (
        "the contents of this file are subject to the terms of the common development and distribution license the license",
        "under common development and distribution license version 1 0",
        "under cddl 1 0",
    ),
    "eupl": ("under eupl version 1 2", "under european union public licence version 1 2", "under eupl 1 2"),
    "bsd-name": ("under bsd license", "under a bsd style license"),
    "bsd-2-name": ("under bsd 2 clause license", "under simplified bsd license"),
    "bsd-3-name": ("under bsd 3 clause license", "under new bsd license", "under modified bsd license"),
    "reserved": "all rights reserved",
    "free-software": tuple(f"this {work} is free software" for work in ("program", "library", "file", "software")),
}
# The notices of the Free Software Foundation: an identifier per licence for the grant, others for the versions.
_FAMILIES = {"GPL": "general", "LGPL": "lesser general", "AGPL": "affero general"}
_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
for _family, _kind in _FAMILIES.items():
    _terms = "you can redistribute it and or modify it under the terms of"
    _law, _by = f"gnu {_kind} public license", "as published by the free software foundation"
    SENTENCES[f"{_family.lower()}-grant"] = (f"{_terms} the {_law} {_by}", f"{_terms} the {_law}")
    for _version in _VERSIONS[_family]:
        _v = f"version {_version.replace('.', ' ')}"
        SENTENCES[f"{_family.lower()}-{_version}-later"] = tuple(
            f"{_terms} the {_law} {_by} either {_v} of the license or at your option any later version{end}"
            for end in ("", " of the license")
        )
        SENTENCES[f"{_family.lower()}-{_version}-only"] = (
            f"{_terms} the {_law} {_v} {_by}",
            f"{_terms} {_v} of the {_law} {_by}",
            f"{_terms} the {_law} {_by} {_v}",
            f"{_terms} the {_law} {_by} {_v} of the license",
        )
for _version in sorted({v for versions in _VERSIONS.values() for v in versions}):
    _v = f"version {_version.replace('.', ' ')} of the license"
    SENTENCES[f"later-{_version}"] = (f"either {_v} or at your option any later version",)
    SENTENCES[f"only-{_version}"] = (_v,)
# Creative Commons: a kind, its words, and the versions that name it.
CREATIVE_COMMONS = {
    "BY": "attribution",
    "BY-SA": "attribution sharealike",
    "BY-ND": "attribution noderivatives",
    "BY-NC": "attribution noncommercial",
    "BY-NC-SA": "attribution noncommercial sharealike",
    "BY-NC-ND": "attribution noncommercial noderivatives",
}
CREATIVE_COMMONS_VERSIONS = ("3.0", "4.0")
for _kind, _name in CREATIVE_COMMONS.items():
    for _version in CREATIVE_COMMONS_VERSIONS:
        _v = _version.replace(".", " ")
        _words = (
            f"creative commons {_name} {_v}", f"creative commons {_name} license {_v}", f"{_name} license {_v}",
            f"cc {_kind.lower().replace('-', ' ')} {_v}",
        )
        _ends = ("", " license", " licence", " international license", " international licence", " international", " unported license")
        SENTENCES[f"cc-{_kind.lower()}-{_version}"] = (
            *(f"under {w}{end}" for w in _words for end in _ends), *_words[:3]
        )
# Tags "SPDX-License-Identifier: ..." of these identifiers.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
    *(f"CC-{kind}-{version}" for kind in CREATIVE_COMMONS for version in CREATIVE_COMMONS_VERSIONS),
)
# Exceptions that such a tag adds with WITH; each is listed by its own name.
SPDX_EXCEPTIONS = (
    "Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1",
    "LLVM-exception", "Linux-syscall-note", "OCaml-LGPL-linking-exception", "Qt-GPL-exception-1.0",
)
for _name in (*SPDX, *SPDX_EXCEPTIONS):
    SENTENCES[f"spdx-{_name.lower()}"] = "spdx license identifier " + _name.lower().replace("-", " ").replace(".", " ")
#: The tag, an operand of a tag's expression with what joins it to the next (the match goes on where the last one ended),
#: and a GNU licence of a version or later.
TAG = "SPDX-License-Identifier"
OPERAND = rf"((?:\G(?!\A)|{TAG}:[ \t]*)\(*[A-Za-z0-9.+-]+\)*)[ \t]+(?:OR|AND|WITH)[ \t]+"
OR_LATER = r"((?:L|A)?GPL-[0-9]+(?:\.[0-9]+)*)\+"
#: A sentence's beginning that says that something is under a licence; what is left of it is "under".
GRANT = (
    r"(?:(?:this|the|our)[ \n](?:[a-z]+[ \n])?(?:file|files|project|software|code|work|program|library|package|document|"
    r"repository|module|source)[ \n](?:is|are)[ \n])?(?:re|dual[ \n])?(?:licensed|licenced|released|distributed|published|"
    r"(?:made[ \n])?available)[ \n](?:to[ \n]you[ \n])?under[ \n](?:the[ \n]terms[ \n](?:and[ \n]conditions[ \n])?of[ \n])?"
    r"(?:the[ \n]|an?[ \n](?!bsd[ \n]style))?"
)
#: The clause with any holder's name, which is put as that of the copyright holder.
NAMED_HOLDER = (
    r"([\n\f])neither[ \n]the[ \n]names?[ \n]of(?:[ \n\f][a-z0-9]+){1,20}?[ \n\f]nor(?:[ \n]the)?[ \n]names?[ \n]of"
    r"(?:[ \n][a-z0-9]+){0,3}?[ \n]contributors[ \n]" + _BSD_ENDORSE.replace(" ", r"[ \n]") + r"(?=[\n\f])"
)


def _fsf_rules():
    """The versions of the GNU licences, in one sentence or (with a semicolon) two, after "is free software" or not."""
    for family, versions in _VERSIONS.items():
        low = family.lower()
        for version in versions:
            name = f"{family}-{version}" + ("" if "." in version else ".0")
            for kind, suffix in (("later", "-or-later"), ("only", "-only")):
                for tail in ((f"{low}-{version}-{kind}",), (f"{low}-grant", f"{kind}-{version}")):
                    yield name + suffix, ("free-software", *tail)
                    yield name + suffix, tail
        yield family, ("free-software", f"{low}-grant")
        yield family, (f"{low}-grant",)


_BSD = ("bsd-grant", "bsd-source", "bsd-binary")
# Ordered rules, the more telling sequences first: a licence and identifiers that follow each other.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-compliance")),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-name", "mit-grant")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-grant",)),
    *_fsf_rules(),
    ("GPL-3.0", ("gpl-terms", "gpl-3")),
    ("GPL-3.0", ("gpl-3",)),
    ("GPL-2.0", ("gpl-2",)),
    ("GPL", ("gpl-terms",)),
    *(
        (licence, (*reserved, *sequence))
        for licence, sequence in (
            ("BSD-4-Clause", (*_BSD, "bsd-advertising", "bsd-endorse")),
            ("BSD-3-Clause", (*_BSD, "bsd-endorse")),
            ("BSD-2-Clause", _BSD),
            ("BSD", ("bsd-grant",)),
        )
        for reserved in (("reserved",), ())  # the words are part of the notice there
    ),
    ("BSD-2-Clause", ("bsd-2-name",)),
    ("BSD-3-Clause", ("bsd-3-name",)),
    ("BSD", ("bsd-name",)),
    ("MPL-2.0", ("mpl-2",)),
    ("EPL-2.0", ("epl-2",)),
    ("EPL-1.0", ("epl-1",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("permission",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost",)),
    ("Zlib", ("zlib-grant",)),
    ("CC0-1.0", ("cc0",)),
    ("WTFPL", ("wtfpl",)),
    ("Artistic-2.0", ("artistic-2",)),
    ("CDDL-1.0", ("cddl-1",)),
    ("EUPL-1.2", ("eupl",)),
    *((f"CC-{kind}-{version}", (f"cc-{kind.lower()}-{version}",)) for kind in CREATIVE_COMMONS for version in CREATIVE_COMMONS_VERSIONS),
    *((name, (f"spdx-{name.lower()}",)) for name in (*SPDX, *SPDX_EXCEPTIONS)),
    ("Proprietary", ("reserved",)),
)


def _texts(known) -> dict[str, str]:
    """The identifier of each text of ``known``, whose values are one text or several, with grants in their one form."""
    listed = ((text, name) for name, texts in known.items() for text in ((texts,) if isinstance(texts, str) else texts))
    return {re.sub(f"^{GRANT}", "under ", text): name for text, name in listed}


def _tree(texts) -> dict:
    """The words of texts as a tree, in which None marks the end of a text."""
    tree: dict = {}
    for text in texts:
        node = tree
        for word in text.split():
            node = node.setdefault(word, {})
        node[None] = True
    return tree


def _pattern(tree: dict) -> str:
    """A regular expression of the word sequences of ``tree``, the longest first, with lines ended anywhere."""
    parts = []
    for word, rest in tree.items():
        if word is None:
            continue
        longer = _pattern(rest)
        parts.append(word + (f"(?:[ \\n]{longer})?" if longer and None in rest else f"[ \\n]{longer}" if longer else ""))
    return f"(?:{'|'.join(parts)})" if len(parts) > 1 else "".join(parts)


def sentences(text: Column, known=None) -> Column:
    """The normalised sentences of a text: ASCII letters in lower case and digits, other characters one space.

    They end with end marks and with paragraphs, and around known sentences that fill whole lines.
    """
    texts = _texts(SENTENCES if known is None else known)
    tree, granted = _tree(texts), _tree(text.removeprefix("under ") for text in texts if text.startswith("under "))
    text = F.when(F.contains(text, F.lit("GPL-")), F.regexp_replace(text, OR_LATER, "$1-or-later")).otherwise(text)
    text = F.when(F.contains(text, F.lit(TAG)), F.regexp_replace(text, OPERAND, f"$1\n{TAG}: ")).otherwise(text)
    ended = F.regexp_replace(F.regexp_replace(text, SENTENCE_END, "\f"), COLON, "\n")
    ended = F.regexp_replace(ended, LIST_MARK, "\f")
    plain = F.regexp_replace(F.translate(ended, UPPER, LOWER), r"[^a-z0-9\n\f]+", " ")
    # One separator between words: a space, the end of a line, or that of a sentence or paragraph
    plain = F.regexp_replace(F.concat(F.lit("\f"), plain, F.lit("\f")), r"\n ?\n[ \n]*", "\f")
    plain = F.regexp_replace(F.regexp_replace(plain, r" ?\n? ?\f[ \n\f]*", "\f"), r" ?\n ?", "\n")
    plain = F.regexp_replace(plain, NAMED_HOLDER, f"$1{_HOLDER}")
    plain = F.regexp_replace(plain, rf"([\n\f]){GRANT}", "$1under ")
    if granted:
        one, article = _pattern(granted), r"(?:the[ \n]|an?[ \n])?"
        plain = F.regexp_replace(plain, rf"([\n\f]under[ \n])either[ \n](?:of[ \n])?{article}(?={one})", "$1")
        last = rf"{one}(?:[\n\f]|[ \n](?:or|and|at)[ \n])"
        choice = rf"((?:[\n\f]under[ \n]|\G(?!\A)){one})[ \n](?:or|and)[ \n](?:under[ \n])?{article}(?={last})"
        plain = F.regexp_replace(plain, choice, "$1\funder ")
        plain = F.regexp_replace(plain, rf"([\n\f]under[ \n]{one})[ \n]at[ \n]your[ \n]option(?=[\n\f])", "$1")
    if tree:
        plain = F.regexp_replace(plain, rf"[\n\f]({_pattern(tree)})(?=[\n\f])", "\f$1\f")
    joined = F.translate(F.replace(plain, F.lit("\f\n"), F.lit("\f")), "\n", " ")
    # No trim of the parts: within transform, Spark 4.1 returns wrong characters for some of them
    return F.filter(F.split(joined, "\f"), lambda s: s != "")


def scan(docs: DataFrame, known=None, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences, sentence_ids, licences (both comma-joined), n_matched.

    sentence_ids are the known sentences in the order of the text; licences are those whose rules match, in the order
    of the rules, each once. The sentences and rules are a fixed table, so they are part of the expression, and the
    scan needs no join and no shuffle.

    A licence that several rules name, or that a text grants more than once, is listed once; sentence_ids keep repeats.
    Null and empty texts have no sentences and no licences; long texts are read to their end. Repeated rows each get a row, null ids too. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    known = SENTENCES if known is None else known
    lookup = F.create_map(*[F.lit(x) for pair in _texts(known).items() for x in pair])
    split = F.coalesce(sentences(F.col("text"), known), F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id"), split.alias("s"))
    ids = F.filter(F.transform("s", lambda s: F.try_element_at(lookup, s)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), ids.alias("ids"))
    left = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    ordered = F.array(*[
        F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"|{name}|" for name in sequence)).alias("sequence"))
        for licence, sequence in rules
    ])
    none = F.array().cast("array<string>")

    def take(state: Column, rule: Column) -> Column:
        matches = F.contains(state["left"], rule["sequence"])
        taken = F.struct(
            F.replace(state["left"], rule["sequence"], F.lit("#")).alias("left"),
            F.array_append(state["found"], rule["licence"]).alias("found"),
        )
        return F.when(matches, taken).otherwise(state)

    start = F.struct(left.alias("left"), none.alias("found"))
    found = F.aggregate(ordered, start, take, lambda state: state["found"]) if rules else none
    rows = rows.withColumn("found", F.when(F.size("ids") > 0, found).otherwise(none))
    return rows.select(
        "doc_id",
        "n_sentences",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("found"), ",").alias("licences"),
        F.size("ids").cast("long").alias("n_matched"),
    )
