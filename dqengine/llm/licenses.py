"""Operator 7: licence scan by sentence rules, natively in Spark.

A text is cut into sentences, sentences are normalised (case, punctuation,
comment marks, spelling, interchangeable wording) and looked up in a table of
known licence sentences.  The identifiers that are found, in their order and
with a gap wherever an unknown sentence stands between, form a sequence.
Licence rules are matched against it one after another: a rule names a run of
identifiers and consumes what it matches, so the whole text of a licence is
recognised before its sentences could be taken for something else.

The tables are fixed and small, so they are literals of the plan: no join, no
shuffle, one pass over the texts with SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licences (SPDX identifiers) and the names they go by, normalised.
NAMES = {
    "Apache-1.1": ("apache license version 1.1", "apache software license 1.1"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0", "apache license version 2", "apache version 2.0"),
    "MIT": ("mit license", "mit", "expat license", "mit open source license"),
    "ISC": ("isc license", "isc"),
    "BSD-2-Clause": ("2 clause bsd license", "bsd 2 clause license", "simplified bsd license", "freebsd license"),
    "BSD-3-Clause": ("3 clause bsd license", "bsd 3 clause license", "new bsd license", "modified bsd license", "revised bsd license"),
    "BSD": ("bsd license", "bsd style license"),
    "GPL": ("gnu general public license", "gnu gpl", "gpl"),
    "LGPL": ("gnu lesser general public license", "gnu lgpl", "lgpl"),
    "MPL-1.1": ("mozilla public license version 1.1", "mpl 1.1"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0", "mozilla public license v. 2.0"),
    "EPL-1.0": ("eclipse public license version 1.0", "eclipse public license 1.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license 1.0", "boost software license"),
    "Zlib": ("zlib license", "zlib libpng license"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1.0", "cc0", "cc0 1.0 universal", "creative commons cc0 1.0 universal public domain dedication"),
    "Artistic-2.0": ("artistic license 2.0", "artistic license version 2.0"),
    "OFL-1.1": ("sil open font license version 1.1", "sil open font license 1.1"),
    "ODbL-1.0": ("open database license", "open database license version 1.0"),
}
# Families whose names follow a rule.
for _family, _long in (("GPL", "gnu general public license"), ("LGPL", "gnu lesser general public license"), ("AGPL", "gnu affero general public license")):
    for _v, _also in (("2", "2.0"), ("2.1", "2.1"), ("3", "3.0")):
        _spdx = f"{_family}-{_also}"
        _short = [f"gnu {_family.lower()}", _family.lower()]
        _plain = [f"{n} {mark}{v}" for n in (_long, *_short) for mark in ("version ", "") for v in dict.fromkeys((_v, _also))]
        NAMES[f"{_spdx}-only"] = (*_plain, *(f"{n} only" for n in _plain))
        NAMES[f"{_spdx}-or-later"] = tuple(f"{n}{tail}" for n in _plain for tail in (" or later", " or any later version", " or at your option any later version"))
for _parts, _words in (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"),
                       ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        NAMES[f"CC-{_parts.upper()}-{_v}"] = (f"cc {_parts.replace('-', ' ')} {_v}", f"cc {_parts.replace('-', ' ')} {_v} license", f"creative commons {_words} {_v} license",
                                             f"creative commons {_words} {_v} international license", f"creative commons {_words} {_v}", f"creative commons {_words} {_v} unported license")

# Sentences of licence texts, normalised, by identifier.
SENTENCES = {
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-asis": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
                   "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
                  "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-asis": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at https www.apache.org licenses license 2.0"),
    "apache-asis": ("unless required by applicable law or agreed to in writing software licensed under the license is licensed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl-3-later": ("you can redistribute it and or modify it under the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-2-later": ("you can redistribute it and or modify it under the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-free": ("free software",),
    "gpl-asis": ("licensed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    "gpl-see": ("see the gnu general public license for more details",),
    "gpl-copy": ("you should have received a copy of the gnu general public license along with this program",),
    "mpl-2-source": ("this source code form is subject to the mozilla public license version 2.0",),
    "unlicense-domain": ("free and unencumbered software released into the public domain", "free and unencumbered software licensed into the public domain"),
    "rights-reserved": ("all rights reserved",),
}
# Licence rules in their order: whole texts, then notices, then single sentences.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("name:Apache-2.0", "apache-comply", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("name:Apache-2.0", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-comply", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-asis", "gpl-asis", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-asis", "gpl-asis", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("MPL-2.0", ("mpl-2-source",)),
    ("Unlicense", ("unlicense-domain",)),
    *((spdx, (f"name:{spdx}",)) for spdx in NAMES),
]
#: Every known sentence holds one of these before its wording is normalised,
#: with anything but letters and digits between the words; texts without any
#: are passed over.
HINTS = "licen|copyright|warrant|permission|redistribut|public_domain|spdx|rights_reserved|free_software|(?:released|distributed|available|published|covered|governed|provided)(?:_by|_freely|_to_you)?_under".replace("_", "[^a-z0-9]+")


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    table = {s: name for name, all_ in SENTENCES.items() for s in all_}
    for spdx, names in NAMES.items():
        for n in names:
            for s in (f"licensed under the {n}", f"licensed under {n}", f"licensed under a {n}", f"license {n}", f"licensed under the {n} license"):
                table.setdefault(s, f"name:{spdx}")
        table.setdefault(f"spdx license identifier {spdx.lower().replace('-', ' ')}", f"name:{spdx}")
    return table


#: Words of the longest known sentence before its wording is normalised: what
#: WORDING takes away is at most eight words and eight for each "under".
MOST_WORDS = max(len(s.split()) + 8 + 8 * s.split().count("under") for s in known_sentences())
# Interchangeable wording, in order: (pattern, what it becomes).
WORDING = (
    (r"licence", "license"),
    (r"^ *(?:(?:this|the) )?(?:[a-z]+ ){0,2}?(?:is|are|may be) (?=(?:free software|free and unencumbered|released|distributed|licensed|available|published|made available|covered|provided under|dual licensed))", ""),
    (r"\\b(?:released|distributed|made available|available|published|covered|governed|provided)(?: by| freely| to you)? under\\b", "licensed under"),
    (r"\\bdistributed (?=in the hope|on an)", "licensed "),
    (r"\\bsoftware distributed under the license\\b", "software licensed under the license"),
    (r"\\bunder (?:the )?terms(?: and conditions)? of\\b", "under"),
    (r"\\bv(?=[0-9])", "version "),
    (r"\\b(?:free software )(?=you can redistribute)", ""),
    (r"(?<=[0-9]) the license *$", ""),
    (r" {2,}", " "),
)


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``licenses`` (different SPDX
    identifiers in alphabetical order, joined by commas), ``n_matches`` (rules
    matched), ``n_known`` (known sentences), ``sentence_ids`` (their
    identifiers in order, ``-`` for a gap) and ``unmatched`` (known sentences
    that no rule explains).

    A null or empty text has none; null keys stay null; repeated rows give
    repeated results; an empty table an empty one; other columns are never
    read.  A sentence may lie on one line or be wrapped: of the lines between
    two sentence ends, the longest run that is a known sentence counts at each
    place, else the line is unknown.
    """
    quoted = lambda s: "'" + s.replace("'", "\\'") + "'"
    table = "map(" + ", ".join(f"{quoted(s)}, {quoted(i)}" for s, i in known_sentences().items()) + ")"
    clean = r"regexp_replace(lower(t), '(?m)^[ \\t]*(?://+|#+|[*]+/?|/[*]+|--+|;+|%+)[ \\t]?', '')"
    end = r"(?<=[.!?;])\\s+"
    cut = f"regexp_replace(regexp_replace({clean}, '{end}|\\\\n\\\\s*\\\\n', '\u0001'), '[\\\\r\\\\n]+', '\u0002')"
    wording = "s"
    for pattern, to in WORDING:
        wording = f"regexp_replace({wording}, '{pattern}', '{to}')"
    parts = f"split(regexp_replace(regexp_replace({cut}, '[^a-z0-9.+\u0001\u0002]+', ' '), '\\\\.(?=[ \u0001\u0002]|$)', ''), '\u0001')"
    bind = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    # of the runs of lines from line i on, the longest known one
    run = f"""transform(filter(transform(sequence(1, least(size(l) - i, {MOST_WORDS})), n -> struct(n AS n, array_join(slice(l, i + 1, n), ' ') AS s)),
        r -> size(split(r.s, ' +')) <= {MOST_WORDS} AND r.s rlike '{HINTS}'), r -> struct(r.n AS n, {bind('r.s', 's', f"try_element_at(m, trim({wording}))")} AS id))"""
    best = bind(f"filter({run}, r -> r.id IS NOT NULL)", "h", "if(size(h) > 0, h[size(h) - 1], struct(1 AS n, '-' AS id))")
    found = f"""aggregate(sequence(0, size(l) - 1), struct(0 AS at, CAST(array() AS array<string>) AS ids), (a, i) ->
        if(i < a.at, a, {bind(best, 'b', "struct(i + b.n AS at, concat(a.ids, array(b.id)) AS ids)")})).ids"""
    ids = f"""flatten(transform({parts}, p -> {bind("filter(transform(split(p, '\u0002'), x -> trim(x)), x -> x <> '')", 'l', f"if(size(l) > 0 AND array_join(l, ' ') rlike '{HINTS}', {found}, array('-'))")}))"""
    # known sentences only, with one gap for what stands between
    sequence = bind(ids, "x", "filter(x, (e, i) -> e <> '-' OR (i > 0 AND x[greatest(i - 1, 0)] <> '-'))")
    known = lambda x: f"size(filter({x}, e -> e <> '-'))"
    rules = "array(" + ", ".join(f"struct({quoted(spdx)} AS spdx, {quoted('|' + '||'.join(run) + '|')} AS run)" for spdx, run in RULES) + ")"
    matched = f"""aggregate({rules}, struct(concat('|', array_join(q, '||'), '|') AS left, CAST(array() AS array<string>) AS found), (a, r) ->
        if(contains(a.left, r.run), struct(replace(a.left, r.run, '|-|') AS left,
           concat(a.found, array_repeat(r.spdx, CAST((octet_length(a.left) - octet_length(replace(a.left, r.run, ''))) / octet_length(r.run) AS INT))) AS found), a))"""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    seen = f"if(lower(t) rlike '{HINTS}', transform(array({table}), m -> {sequence})[0], CAST(array() AS array<string>))"
    rows = rows.select("k", F.expr(seen).alias("q"))
    rows = rows.select("k", "q", F.expr(f"if(size(q) = 0, struct('' AS left, CAST(array() AS array<string>) AS found), {matched})").alias("a"))
    return rows.select(F.col("k").alias(key), F.expr("array_join(array_sort(array_distinct(a.found)), ',')").alias("licenses"), F.expr("CAST(size(a.found) AS BIGINT)").alias("n_matches"),
                       F.expr(f"CAST({known('q')} AS BIGINT)").alias("n_known"), F.expr("array_join(q, ' ')").alias("sentence_ids"),
                       F.expr("array_join(filter(split(a.left, '[|]+'), e -> e <> '' AND e <> '-'), ' ')").alias("unmatched"))


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    """Licences named or quoted in every document."""
    from ..sources.tables import read_table
    return licenses(read_table(spark, sf_dir, "documents"))
