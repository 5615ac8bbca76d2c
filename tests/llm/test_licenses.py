"""Licence sentences and rules."""

import re

import pytest
from conftest import SF01

from dqengine.llm import licenses as L
from dqengine.sources.tables import read_table

MIT = """Copyright (c) 2020 Somebody

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
"""
CASES = {
    MIT: "MIT", "# " + MIT.replace("\n", "\n# "): "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "prose before. Released under the MIT Licence. And prose after": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "a line without an end\nLicensed under CC BY-NC 4.0.\nRELEASED UNDER THE MIT LICENSE\n": "CC-BY-NC-4.0,MIT",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "// SPDX-License-Identifier: GPL-2.0-or-later\nint main": "GPL-2.0-or-later",
    "This program is distributed under the terms of the GNU GPL v2 or later.": "GPL-2.0-or-later",
    "Available under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "The poet's license is no licence to print money. All rights reserved.": "",
    "A license of no kind": "", "": "", None: "", "Plain text. Nothing here!": "",
}


def test_cases(spark):
    rows = [(i, t, "clash") for i, t in enumerate(CASES)] + [(None, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x")]
    got = L.licenses(spark.createDataFrame(rows, "doc_id long, text string, q string")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.licenses) for r in got}
    assert by == {(i, w) for i, w in enumerate(CASES.values())} | {(None, "MIT"), (3, "MIT")}
    mit = next(r for r in got if r.doc_id == 0)
    assert mit.n_matches == 1 and mit.unmatched == "" and "mit-grant" in mit.sentence_ids
    reserved = next(r for r in got if r.doc_id == list(CASES).index("The poet's license is no licence to print money. All rights reserved."))
    assert reserved.unmatched == "rights-reserved"


def test_apache_notice(spark):
    r = L.licenses(spark.createDataFrame([(1, APACHE)], "doc_id long, text string")).first()
    assert r.licenses == "Apache-2.0"


def test_every_known_sentence_has_a_hint():
    assert all(re.search(L.HINTS, s) for s in L.known_sentences() if "may not use" not in s and "unencumbered" not in s)
    assert all(re.search(L.HINTS, s) for s in L.known_sentences())


def test_all_documents_against_a_plain_search(spark):
    """Each planted line, as a line of its own or a sentence of one, is found; other documents have none."""
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    docs = read_table(spark, SF01, "documents")
    got = {r.doc_id: r.licenses for r in L.licenses(docs).collect()}
    want = {r.doc_id: ",".join(sorted(v for k, v in lines.items() if re.search(rf"(^|\n|[.!?;:]\s+){re.escape(k)}(\s|$)", r.text))) for r in docs.collect()}
    assert got == want and any(want.values())


def test_native_and_empty(spark):
    df = L.licenses(read_table(spark, SF01, "documents"))
    assert not re.search("Python|Pandas|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())
    assert L.licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


WRAPPED = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
ONE_LINE = "SPDX-License-Identifier: MIT\nLicensed under CC BY-NC 4.0\n"


@pytest.mark.parametrize("text, want", [
    (ONE_LINE + "\n" + WRAPPED, "CC-BY-NC-4.0,GPL-3.0-or-later,MIT"),
    (ONE_LINE + WRAPPED, "CC-BY-NC-4.0,GPL-3.0-or-later,MIT"),  # no blank line between
    (WRAPPED[:-1] + "\n" + ONE_LINE, "CC-BY-NC-4.0,GPL-3.0-or-later,MIT"),
    (MIT + "\n\nlines\n" * 3 + ONE_LINE + APACHE, "Apache-2.0,CC-BY-NC-4.0,MIT"),
    ("# " + (ONE_LINE + WRAPPED).replace("\n", "\n# "), "CC-BY-NC-4.0,GPL-3.0-or-later,MIT"),
    ("words\n" * 200 + "released under\nthe\nMIT\nlicense\n" + "words\n" * 200, "MIT"),
    ("Licensed under the GNU General Public License,\nversion 3", "GPL-3.0-only"),
    ("License\nwords\nMIT", ""), (".\n\n;\n" * 5 + "permission", ""),
])
def test_one_line_and_wrapped_licences_together(spark, text, want):
    r = L.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licenses == want and r.n_known == len([i for i in r.sentence_ids.split() if i != "-"])


def test_longest_sentence_fits_a_run():
    for s in L.known_sentences():
        wide = "this very own is free software " + s.replace(" under ", " freely under the terms and conditions of ") + " the license"
        assert len(wide.split()) <= L.MOST_WORDS


@pytest.mark.parametrize("text", ["This code is released\nunder GPL v3.", "# This code is released\n# under GPL v3.", "This code is released  under GPL v3.",
                                  "// provided\n//  to you\n// under GPL v3\n", "Published, freely, under the GPL v3!"])
def test_hints_across_blanks_and_marks(spark, text):
    assert L.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == "GPL-3.0-only"


@pytest.mark.parametrize("text, known", [("all rights\n * reserved", "rights-reserved"), ("all - rights .- reserved", "rights-reserved"), ("This is free\n# software;", "gpl-free")])
def test_known_sentences_across_blanks_and_marks(spark, text, known):
    assert L.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().sentence_ids == known
