import pytest

from merchlens.llm import licences

MIT = """Copyright (c) 2020 Someone

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""


def rules(docs, text):
    return {r.rule: (r.n_matches, r.first_sentence) for r in licences.scan(docs([(1, text)])).collect()}


def test_texts_and_notices(docs):
    assert rules(docs, "Intro here.\n" + MIT) == {"mit-text": (1, 2)}
    assert rules(docs, BSD2).keys() == {"bsd2-text"}
    assert rules(docs, BSD3).keys() == {"bsd2-text", "bsd3-text"}
    assert rules(docs, "x. All rights reserved. Released under the MIT License. y\nReleased under the MIT License\nz") == {
        "mit-notice": (2, 2)
    }
    assert rules(docs, "# SPDX-License-Identifier: Apache-2.0\ncode") == {"apache-tag": (1, 0)}


def test_order_matters(docs):
    parts = MIT.split("\n\n")
    assert rules(docs, "\n\n".join([parts[0], parts[2], parts[1], parts[3]])) == {}
    assert rules(docs, "\n\n".join([*parts[:2], "A stranger's sentence.", *parts[2:]])) == {"mit-text": (1, 1)}
    notice = "Released under the MIT License.\n\n"
    assert "mit-text" not in rules(docs, "\n\n".join([*parts[:2], notice, *parts[2:]]))


@pytest.mark.parametrize("text", [None, "", " \n\n ", "All rights reserved.", "the mit licence is nice", "..."])
def test_nothing_found(docs, text):
    assert rules(docs, text) == {}


def test_rows(docs):
    rows = [(1, "Released under the MIT License.")] * 3 + [(None, "Licensed under CC BY-NC 4.0.\n" + "word " * 90_000)]
    got = licences.scan(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.licence) for r in got) == [(0, "CC-BY-NC-4.0")] + [(1, "MIT")] * 3
    assert licences.scan(docs([])).count() == 0
    clash = docs(rows).withColumnRenamed("lang", "found").withColumnRenamed("source", "rule")
    assert licences.scan(clash).count() == 4


def test_rules_use_known_sentences():
    known = set(licences.SENTENCES.values())
    assert all(i in known for _, _, ids in licences.RULES for i in ids)


LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


@pytest.mark.parametrize("text, licence", [
    (LGPL21, "LGPL-2.1-or-later"),
    (AGPL3, "AGPL-3.0-or-later"),
    (AGPL3.replace("program", "library").replace("Affero\nGeneral", "Lesser General"), "LGPL-3.0-or-later"),
    ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-only"),
    ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-only"),
    ("Licensed under the GNU General Public License, version 2.", "GPL-2.0-only"),
    ("Dedicated to the public domain under CC0 1.0.", "CC0-1.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("Released under the ISC License.", "ISC"),
    ("// SPDX-License-Identifier: MPL-2.0\ncode", "MPL-2.0"),
    ("2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You "
     "a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
     "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works "
     "in Source or Object form. More.", "Apache-2.0"),
])
def test_one_text_and_one_near_miss_of_each(docs, text, licence):
    got = licences.scan(docs([(1, f"Words before.\n\n{text}\n\nWords after.")])).collect()
    assert [r.licence for r in got] == [licence]
    for near in (text.replace("icense", "icence").replace("CC", "CX"), f"Not {text}"):
        if near != text:
            assert licence not in {r.licence for r in licences.scan(docs([(1, near)])).collect()} or "\n" in text or ". " in text


def test_the_span_of_a_match(docs):
    parts = MIT.split("\n\n")
    text = "\n\n".join([*parts[:2], *[f"Stranger {i}." for i in range(50)], *parts[2:]])
    (r,) = licences.scan(docs([(1, text)])).collect()
    assert (r.rule, r.first_sentence, r.last_sentence) == ("mit-text", 1, 53)
