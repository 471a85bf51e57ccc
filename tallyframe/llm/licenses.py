"""License scans: MinHash bands over overlapping windows, then exact shingle containment. DataFrame functions only.

Text is lower-cased and cut into words of a-z and 0-9. A template of s five-word shingles is sought in windows of
W shingles, W being the least power of two with s <= W / 2 + 1; windows begin every W / 2 shingles, so a window holds any run of the
template's length whole. A template that is contained to 0.75 has a Jaccard similarity of at least 0.18 to
its window; of BANDS single minima at least one agrees with a probability of 1 - (1 - 0.18) ** BANDS, over 1 - 3e-6. What the
bands retrieve is verified: shingles of the template in the window, over those of the template, at least 0.75.

Only windows around a cue word are hashed, and only those that the bands retrieve for some template go on. Cues lose nothing: so many shingles of each template hold one that no 0.75 of them do without
(a test holds the catalogue against this). Versions are told apart: a license whose name has one (as gpl-3.0) is found only where a shingle with a number of its notice is; so are
the names of a family (GPL, LGPL, AGPL), by a shingle with the word that parts them.
A notice of fewer words than a shingle is sought whole, as one sequence, in every text. Templates are a catalogue of fixed size, hence broadcast. Windows stay in
the task that read the document; only matches move, a row for each document and license. A lost executor costs its tasks.

The catalogue: the notices of the licenses below and the whole texts of the short ones (BSD, ISC, MIT, Unlicense, zlib); the bodies of the long ones (Apache, Creative Commons,
EPL, GPL, LGPL, AGPL, MPL) aren't in it. A BSD text comes out as bsd and as the clauses that it has. matches() takes other catalogues.

Defined results: null, empty and short text matches nothing; whole texts are read; a license that is found in several
windows is one row with its best containment and the first place of that license; repeated rows give one row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SHINGLE, BANDS, LEAST = 5, 64, 0.75
CUES = (
    "licensed", "license", "permission", "granted", "obtaining", "redistribution", "binary", "modification", "mozilla", "software", "copyright", "conditions", "contributors", "warranties", "liability",
    "damages", "distribute", "neighboring", "eclipse", "materials", "foundation", "public",
)
#: Fixed values: (license, words of its notice or text).
TEMPLATES = (
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-2-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
#: Bytes of a catalogue's keys and shingles up to which it is broadcast.
MOST_BYTES = 64 << 20
#: A license with a version in its name, and a shingle that has a number.
VERSIONED, NUMBERED = r"[0-9]\.[0-9]", "(^| )[0-9]+( |$)"
#: Licenses of one family differ by a word of their name; a shingle that has it.
FAMILY = "gnu (general|lesser|affero)( |$)"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """The shingles of an array of words, in order; none if there are fewer words than one takes."""
    n = F.size(words) - SHINGLE
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE)))).otherwise(F.array().cast("array<string>"))


def band_keys(shingles: Column, width: Column) -> Column:
    """A key for each of BANDS: the minimum of its hash function over the shingles, with the band and the width of the window."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda seed: F.xxhash64(F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, seed))), seed, width))


def width_of(n: int) -> int:
    """Shingles of a window for templates of n shingles."""
    width = 2
    while n > width // 2 + 1:
        width *= 2
    return width


def sequence_of(notice: str) -> list[str]:
    """words_of() of a notice."""
    return re.findall("[a-z0-9]+", notice.lower())


def catalogue(spark, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template, license, width, the shingles wanted and those of them that tell its version and its family, of the notices that have a shingle."""
    rows = spark.createDataFrame([(k, name, text, width_of(n_shingles(text))) for k, (name, text) in enumerate(templates)], "template int, license string, notice string, width int")
    wanted = rows.select("template", "license", "width", F.array_distinct(shingles_of(words_of(F.col("notice")))).alias("wanted")).filter("size(wanted) > 0")
    telling = F.when(F.col("license").rlike(VERSIONED), F.filter("wanted", lambda s: s.rlike(NUMBERED))).otherwise(F.slice("wanted", 1, 0))
    return wanted.withColumn("telling", telling).withColumn("family", F.filter("wanted", lambda s: s.rlike(FAMILY)))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, cues: tuple[str, ...] = CUES) -> DataFrame:
    """doc_id, license, containment (of the best template) and first_word (where the first window with it, or a notice shorter than a shingle, begins), a row for each document and license."""
    short = tuple((name, text) for name, text in templates if len(sequence_of(text)) < SHINGLE)
    templates = tuple(x for x in templates if x not in short)
    parts = [_banded_matches(docs, id_col, text_col, templates, cues)] if templates or not short else []
    if short:
        parts.append(_whole_matches(docs, id_col, text_col, short))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))


def _whole_matches(docs: DataFrame, id_col: str, text_col: str, short: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, license, containment and first_word of notices that are shorter than a shingle."""
    wanted = [(name, f" {' '.join(sequence_of(text))} ") for name, text in short]
    if any(not w.strip() for _, w in wanted):
        raise ValueError("a notice without words")
    telling = sorted({max(sequence_of(text), key=len) for _, text in short})  # a text without the longest word of a notice can't hold it
    hinted = docs.filter(_any([F.lower(F.col(text_col)).contains(w) for w in telling]))
    own = hinted.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(" "), F.array_join(words_of(F.col(text_col)), " "), F.lit(" ")).alias("line"))
    before = lambda w: F.length(F.regexp_replace(F.substring_index("line", w, 1), "[^ ]+", ""))
    hits = F.array(*(F.when(F.col("line").contains(w), F.struct(F.lit(name).alias("license"), F.lit(1.0).alias("containment"), before(w).alias("first_word"))) for name, w in wanted))
    return own.select("doc_id", F.inline(F.filter(hits, lambda x: x.isNotNull())))


def _banded_matches(docs: DataFrame, id_col: str, text_col: str, templates: tuple[tuple[str, str], ...], cues: tuple[str, ...]) -> DataFrame:
    """doc_id, license, containment and first_word of each window that holds a template."""
    known = catalogue(docs.sparkSession, templates).select("template", "license", "wanted", "telling", "family", F.explode(band_keys(F.col("wanted"), F.col("width"))).alias("key"))
    keys = sorted({row["key"] for row in known.select("key").collect()})  # of the catalogue: BANDS a template
    sizes = sorted({width_of(n_shingles(t)) for _, t in templates})
    low = F.lower(F.col(text_col))
    hinted = docs.filter(_any([low.contains(c) for c in cues]))
    own = hinted.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    spots = own.filter(F.size("words") >= SHINGLE).withColumn("cued", F.filter(F.transform("words", lambda w, i: F.when(w.isin(*cues), i)), lambda i: i.isNotNull())).filter("size(cued) > 0")
    held = lambda x: F.array_distinct(shingles_of(F.slice("words", x["first_word"] + 1, x["width"] + SHINGLE - 1)))
    windows = F.transform(F.flatten(F.array(*(_windows_around(width) for width in sizes))), lambda x: F.struct(x["first_word"].alias("first_word"), x["width"].alias("width"), held(x).alias("held")))
    opened = spots.select("doc_id", F.explode(windows).alias("at")).select("doc_id", "at.*").withColumn("keys", F.filter(band_keys(F.col("held"), F.col("width")), lambda k: k.isin(*keys)))
    banded = opened.filter("size(keys) > 0").select("doc_id", "first_word", "held", F.explode("keys").alias("key"))
    held_bytes = BANDS * sum(SHINGLE * len(t) for _, t in templates)  # of known: each key carries its template's shingles
    met = banded.join(F.broadcast(known) if held_bytes <= MOST_BYTES else known, "key")
    inside = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    told = ((F.size("telling") == 0) | F.arrays_overlap("held", "telling")) & ((F.size("family") == 0) | F.arrays_overlap("held", "family"))
    return met.withColumn("containment", inside).filter((F.col("containment") >= LEAST) & told).select("doc_id", "license", "containment", "first_word")


def n_shingles(notice: str) -> int:
    """Different shingles of a notice, 1 at least."""
    words = sequence_of(notice)
    return max(1, len({tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}))


def _windows_around(width: int) -> Column:
    """(width, first_word) of the windows of so many shingles that hold a cue; a window of first word f has words f to f + width + SHINGLE - 2."""
    stride, span = width // 2, width + SHINGLE - 2
    of = lambda c: F.sequence(F.greatest(F.ceil((c - span) / stride), F.lit(0)).cast("int"), F.floor(c / stride).cast("int"))
    at = F.transform(F.array_distinct(F.flatten(F.transform("cued", of))), lambda k: F.struct(F.lit(width).alias("width"), (k * stride).alias("first_word")))
    return F.filter(at, lambda x: x["first_word"] <= F.size("words") - SHINGLE)


def _any(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses in all documents."""
    return matches(table(spark, sf_dir, "documents")).select("doc_id", "license", F.round("containment", 6).alias("containment"), F.col("first_word").cast("long").alias("first_word"))


def _sql(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(templates))
    words = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""
WITH known AS (SELECT * FROM (VALUES {rows}) t(template, license, notice)),
sets AS (SELECT template, license, {words.format("notice")} AS w FROM known),
wanted AS (SELECT DISTINCT template, license, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT template, license, w, unnest(range(1, len(w) - 3)) AS i FROM sets)),
told AS (SELECT *, regexp_matches(license, '{VERSIONED}') AND regexp_matches(shingle, '{NUMBERED}') AS telling, regexp_matches(shingle, '{FAMILY}') AS family FROM wanted),
sized AS (SELECT template, license, count(*) AS n, bool_or(telling) AS versioned, bool_or(family) AS named, greatest(2, CAST(pow(2, ceil(log2(greatest(1, 2 * (count(*) - 1))))) AS BIGINT)) AS width FROM told GROUP BY ALL),
cut AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
held AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut)),
hits AS (SELECT doc_id, p, h.shingle, template, telling, family FROM held h JOIN told USING (shingle)),
placed AS (SELECT doc_id, shingle, telling, family, template, license, n, versioned, named, width, p // (width // 2) - b AS k FROM hits JOIN sized USING (template) CROSS JOIN (VALUES (0), (1)) x(b)),
scored AS (SELECT doc_id, license, k * (width // 2) AS first_word, count(DISTINCT shingle) / any_value(n) AS c, (bool_or(telling) OR NOT any_value(versioned)) AND (bool_or(family) OR NOT any_value(named)) AS v FROM placed WHERE k >= 0 GROUP BY doc_id, template, license, k, width),
short AS (SELECT license, ' ' || array_to_string(w, ' ') || ' ' AS notice FROM sets WHERE len(w) < {SHINGLE}),
lines AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM cut),
whole AS (SELECT doc_id, license, length(regexp_replace(substr(line, 1, strpos(line, notice)), '[^ ]', '', 'g')) - 1 AS first_word, 1.0 AS c FROM lines JOIN short ON contains(line, notice)),
found AS (SELECT doc_id, license, first_word, c FROM scored WHERE c >= {LEAST} AND v UNION ALL SELECT * FROM whole)
SELECT doc_id, license, round(max(c), 6) AS containment, min(first_word) AS first_word FROM found GROUP BY doc_id, license
"""


OP4_SQL = _sql()
