import re
import textwrap

from lattica.llm import licenses


def run(docs):
    return {r["doc_id"]: r for r in licenses.scan(docs).collect()}


def test_sequences_rules_and_nulls(spark, documents):
    rows = [
        (1, "Words. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. More"),
        (2, "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy!"),
        (3, "You may not use this file except in compliance with the License."),
        (4, None), (5, ""), (6, "x. " * 300_000 + "All rights reserved"), (7, "All rights reserved. Licensed under the Apache License, Version 2.0"),
    ]
    out = run(documents(rows))
    assert out[1]["licences"] == "Apache-2.0" and out[1]["sentence_ids"] == "apache-grant,apache-compliance" and out[1]["n_sentences"] == 4
    assert out[2]["licences"] == "MIT" and out[3]["licences"] == "" and out[3]["n_matched"] == 1
    assert [out[k]["n_sentences"] for k in (4, 5)] == [0, 0] and out[6]["licences"] == "Proprietary"
    assert out[7]["licences"] == "Apache-2.0,Proprietary"
    assert licenses.scan(documents([])).count() == 0
    assert licenses.scan(documents([(1, "a"), (1, "a"), (None, "a")])).count() == 3


APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
MIT = '''The MIT License (MIT)

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
'''
BSD = '''Copyright (c) 2020, Some Lab Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD_3 = BSD + '''
3. Neither the name of Some Lab Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
GPL_2 = GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL_2.replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1").replace("This program", "This library")


def test_unaltered_notices_however_wrapped(spark, documents):
    notices = {
        "Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD_3,
        "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL_2, "LGPL-2.1-or-later": LGPL,
    }
    rows, want = [], {}
    for licence, notice in notices.items():
        paragraphs = [" ".join(p.split()) for p in notice.split("\n\n")]
        ways = [
            notice, notice.replace("\n", "\r\n"), "\n\n".join(paragraphs), "\n\n".join(textwrap.fill(p, 31) for p in paragraphs),
            "".join(f" * {line}\n" for line in notice.split("\n")), "".join(f"# {line}".strip() + "\n" for line in notice.split("\n")),
            "Some words of a readme.\n\n" + notice + "\nMore words",
        ]
        for text in ways:
            want[len(rows)] = licence
            rows.append((len(rows), text))
    out = run(documents(rows))
    assert {k: r["licences"] for k, r in out.items()} == want


def test_lines_without_end_marks_and_words_around(spark, documents):
    rows = [
        (1, "words and words\nReleased under the MIT License.\nmore words"), (2, "// SPDX-License-Identifier: MIT\nimport this\n"),
        (3, "It is not licensed under the Apache License, Version 2.0."), (4, "Two wrapped\nlines. One more\n\nand a paragraph"),
        (5, "Licensed under the Apache\nLicense, Version 2.0 but not this"), (6, "\n" * 300_000 + " \n" * 300_000 + "All rights\nreserved"),
    ]
    out = run(documents(rows))
    assert {k: r["licences"] for k, r in out.items()} == {1: "MIT", 2: "MIT", 3: "", 4: "", 5: "", 6: "Proprietary"}
    assert out[4]["n_sentences"] == 3 and out[1]["n_sentences"] == 3


def test_sentences_keep_all_their_characters(spark, documents):
    texts = [" ".join(f"No {k * j} of  words, and {'é' * (k % 5)} more {'!!' if j % 3 else '.'}" for j in range(k)) for k in range(60)]
    ended = "\nLicensed under CC BY-NC 4.0."
    rows = documents([(k, text + ended) for k, text in enumerate(texts)])
    got = {r["doc_id"]: r["s"] for r in rows.select("doc_id", licenses.sentences(rows["text"]).alias("s")).collect()}
    for k, text in enumerate(texts):
        parts = [" ".join(re.findall("[a-z0-9]+", part.lower())) for part in re.split(r"[.!?;]+(?:\s|$)", text + ended)]
        parts = [part.replace("licensed under", "under") for part in parts if part]  # the one form of a grant
        assert got[k] == parts


def test_short_grants_and_tags(spark, documents):
    rows, want = [], {}

    def case(text, licence):
        want[len(rows)] = licence
        rows.append((len(rows), text))

    case("// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0")
    for name in licenses.SPDX:
        case(f"# SPDX-License-Identifier: {name}\nimport x\n", name)
    for text in ("This file is released under the MIT License.", "Our project is distributed under the terms of the MIT license",
                 "/* The source code is made\n * available under the MIT License. */", "Licensed to you under the MIT License"):
        case(text, "MIT")
    case("This library is published under the Boost Software License, Version 1.0.", "BSL-1.0")
    case("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0")
    case("Licensed under CC BY-NC-ND 3.0", "CC-BY-NC-ND-3.0")
    case("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "MPL-2.0")
    case("Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted.", "0BSD")
    case("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided "
         "that the above\ncopyright notice and this permission notice appear in all copies.", "ISC")  # fmt: skip
    case("This is free and unencumbered software released into the public domain.", "Unlicense")
    case("Nothing is released under the MIT License of old", "")
    out = run(documents(rows))
    assert {k: r["licences"] for k, r in out.items()} == want


def test_expressions_and_grants_of_several_licences(spark, documents):
    tag = licenses.TAG
    cases = {
        f"// {tag}: GPL-2.0+": "GPL-2.0-or-later",
        f"# {tag}: Apache-2.0 OR MIT": "Apache-2.0,MIT",
        f"/* {tag}: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */\nint x;": "GPL-2.0-only,MIT,Linux-syscall-note",
        f"# {tag}: MIT OR unheard-of-1.0 OR Zlib": "MIT,Zlib",
        f"# {tag}: MIT\nthis OR that WITH those": "MIT",
        "A OR B AND C": "",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
        "This crate is dual. Dual-licensed under the MIT License or the\nApache License, Version 2.0.": "Apache-2.0,MIT",
        "Licensed under the MIT License, the words. Or not": "",
        "Licensed under either the ISC license or the MIT license or the zlib license": "MIT,ISC,Zlib",
        "Released under the Apache License 2.0 or the MIT license of old": "",
        "Attribution-ShareAlike License 4.0": "CC-BY-SA-4.0",
        "Licensed under the Creative Commons Attribution License 3.0": "CC-BY-3.0",
    }
    out = run(documents(list(enumerate(cases))))
    assert {text: out[k]["licences"] for k, text in enumerate(cases)} == cases
    assert run(documents([(0, "a OR b " * 300_000 + f"\n{tag}: " + " OR ".join(["MIT"] * 50_000))]))[0]["n_matched"] == 50_000


def brute(text):
    """The sentences and licences of a text by tokens: words with what separates them, then longest known runs.

    Named holders, which the scan puts as the copyright holder, and grants of one licence or another are left out here.
    """
    if text is None:
        return 0, "", ""
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"GPL-(\d+(\.\d+)*)\+", r"GPL-\1-or-later", line)
        head, tag, rest = line.partition(licenses.TAG + ":")
        lines.append(head + f"\n{tag}: ".join(["", *re.split(r"[ \t]+(?:OR|AND|WITH)[ \t]+", rest)])[1:] if tag else line)
    text = "\n".join(lines)
    for pattern, instead in ((licenses.SENTENCE_END, "\f"), (licenses.COLON, "\n"), (licenses.LIST_MARK, "\f")):
        text = re.sub(pattern, instead, text, flags=re.ASCII)
    tokens = re.findall(r"[a-z0-9]+|[^a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    words, gaps = [], ["\f"]
    for token in tokens:
        if re.match("[a-z0-9]", token):
            words.append(token)
            gaps.append("")
        else:
            marks = re.sub(r"[^\n\f]+", " ", token)
            ends = "\f" in marks or marks.count("\n") > 1
            gaps[-1] = "\f" if ends or gaps[-1] == "\f" else "\n" if "\n" in marks else " "
    gaps[-1] = "\f"
    known = licenses._texts(licenses.SENTENCES)
    grant = re.compile(licenses.GRANT.replace(r"[ \n]", " "))
    longest = max(len(k.split()) for k in known)
    ends = lambda k: gaps[k] in "\n\f"
    out, at, begin = [], 0, 0

    def close(end):
        if end > begin:
            out.append(" ".join(words[begin:end]))

    while at < len(words):
        found = None
        if ends(at):
            size = min(len(words), at + longest + 30)
            stops = [k for k in range(at + 1, size + 1) if ends(k)]
            stop = next((k for k in range(at + 1, size + 1) if gaps[k] == "\f"), size)
            for k in sorted((k for k in stops if k <= stop), reverse=True):
                text = grant.sub("under ", " ".join(words[at:k]), count=1) if grant.match(" ".join(words[at:k])) else " ".join(words[at:k])
                if text in known:
                    found = k, text
                    break
        if found:
            close(at)
            out.append(found[1])
            at = begin = found[0]
            continue
        at += 1
        if gaps[at] == "\f":
            close(at)
            begin = at
    ids = [known[s] for s in out if s in known]
    left, licences = "".join(f"|{i}|" for i in ids), []
    for licence, sequence in licenses.RULES:
        mark = "".join(f"|{name}|" for name in sequence)
        if mark in left:
            left = left.replace(mark, "#")
            licences += [licence] * (licence not in licences)
    return len(out), ",".join(ids), ",".join(licences)


def test_against_brute_force(spark, documents):
    texts = [f"// {licenses.TAG}: {e}\nuse" for e in ("GPL-2.0+", "(MIT OR Apache-2.0) AND LGPL-2.1+", "GPL-2.0-only WITH Linux-syscall-note")]
    texts += [APACHE, MIT, BSD, GPL, GPL_2, LGPL, "", None, "Released under the MIT License. All rights reserved"]
    stored = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts += [r["text"] for r in stored]
    out = run(documents(list(enumerate(texts))))
    for k, text in enumerate(texts):
        got = (out[k]["n_sentences"], out[k]["sentence_ids"], out[k]["licences"])
        assert got[1:] == brute(text)[1:], text
        assert got[0] == brute(text)[0], text
