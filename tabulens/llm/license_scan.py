"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Segments of a text (its lines, its paragraphs and the whole text) that hold a gate term are turned into
TF-IDF vectors and compared with the templates' vectors by joins on terms; only non-zero products
are formed. Gate terms are the rarest terms of each template, so many that the terms left out cannot
make a cosine of LINE_COSINE by themselves; so no segment that reaches it is passed over. Document
frequencies of the templates' terms are counted over all texts; a term in no template counts as unseen, so
foreign words lower a cosine. A segment matches a template from LINE_COSINE up, unless it lacks the licence's version or has a
word that makes another licence of it (Lesser, NonCommercial and the like). Clauses count where all of a licence's are there. A text's
own licence is the one whose matching segments have most terms together, each weighed by its cosine; a bare rights line
counts only where nothing else does.

A text governs its directory if as a whole it is a licence (from FILE_COSINE up), or if its name is that of a
licence file and it has a licence of its own: full licences are much longer than any template, but
each has its title, its notice or its clauses among its paragraphs. Files without a licence of their own take
that of the nearest directory upwards, found by a join of their directory's ancestors with the governing
directories.

Defined results: a null or blank text has no licence; a null path part is left out; equal cosines
go to the first licence id in code point order; of several licence files in a directory the
highest cosine governs, then the first id, and a rights line only by itself; repeated rows are scanned each; an empty table gives no
rows. Only the id, path and text columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import bounded_join, named, store, text_or_empty

LINE_COSINE, FILE_COSINE = 0.7, 0.85
#: Names of files that state their directory's licence, in any case, with any extension.
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright)([._-][^/]*)?$"

#: Usual notices and the openings of licence files, by SPDX id.
TEMPLATES = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal license."),
    "EPL-1.0": ("Licensed under the Eclipse Public License, version 1.0.", "Eclipse Public License - v 1.0"),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.0": ("Licensed under the GNU Library General Public License, version 2.", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}
#: The Creative Commons licences by their parts: name, word in titles.
_PARTS = {"NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
for _version, _kind in (("3.0", "Unported"), ("4.0", "International")):
    for _parts in ((), ("NC",), ("NC", "ND"), ("NC", "SA"), ("ND",), ("SA",)):
        _short, _long = "-".join(("BY", *_parts)), "-".join(("Attribution", *(_PARTS[p] for p in _parts)))
        _title = f"Creative Commons {_long} {_version} {_kind}"
        TEMPLATES[f"CC-{_short}-{_version}"] = (f"Licensed under CC {_short} {_version}.", f"{_title} Public License", f"This work is licensed under a {_title} License.")

#: Templates (by place) of which a licence needs all.
CLAUSES = {"BSD-2-Clause": (1,), "BSD-3-Clause": (1, 2), "Zlib": (1, 2)}
#: Licences that hold only where no other does.
LAST = ("Proprietary",)
#: Words that make another licence of a GNU or a Creative Commons one, a name and its other forms together.
CHANGES = (("affero",), ("lesser",), ("nc", "noncommercial"), ("nd", "noderivatives", "noderivs"), ("sa", "sharealike"))
_FAMILY = {"gnu", "creative", "cc"}


def marks(licence: str, terms: set[str]) -> tuple[list[str], list[str]]:
    """Terms that a segment must have for a template of these terms, and those that it must not have."""
    version = re.search(r"-(\d+)\.(\d+)$", licence)
    needs = [t for t in (version.groups() if version else ()) if t != "0" and t in terms]
    forbids = [t for change in CHANGES if not terms & set(change) for t in change] if terms & _FAMILY else []
    return needs, forbids


def gate_terms(weights: list[tuple[int, str, float, float]], cosine: float) -> list[str]:
    """Terms of which every segment with ``cosine`` to a template has one; ``weights``: template, term, idf, weight in the unit vector.

    A segment's cosine to a template is at most the length of the template's part in the terms they share.
    """
    gate: set[str] = set()
    for number in {w[0] for w in weights}:
        # From the most common term on, what may be left out. The margin is for rounding.
        out = 0.0
        for _, _, weight, term in sorted((idf, term, weight, term) for n, term, idf, weight in weights if n == number):
            out += weight * weight
            if out >= cosine * cosine - 1e-6:
                gate.add(term)
    return sorted(gate)


def gate_pattern(terms: list[str]) -> str:
    """Whole terms of lower-cased text; those with the same first character are tried together."""
    firsts = sorted({t[0] for t in terms})
    groups = [c + "(?:" + "|".join(t[1:] for t in terms if t[0] == c) + ")(?![a-z0-9])" for c in firsts]
    return "(?<![a-z0-9])(?=[" + "".join(firsts) + "])(?:" + "|".join(groups) + ")"


def template_marks(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[int, int, list[str], list[str]]]:
    """(template number, clauses that its licence needs with it (0 if it stands by itself), terms it needs, terms it forbids)."""
    rows = []
    for number, (licence, place, text) in enumerate((k, i, t) for k, ts in templates.items() for i, t in enumerate(ts)):
        clauses = CLAUSES.get(licence, ()) if templates is TEMPLATES else ()
        rows.append((number, len(clauses) if place in clauses else 0, *marks(licence, set(re.findall("[a-z0-9]+", text.lower())))))
    return rows


def template_terms(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[int, str, str, int]]:
    """(template number, licence, term, count)."""
    rows = []
    for number, (licence, text) in enumerate((k, t) for k, ts in templates.items() for t in ts):
        terms = re.findall("[a-z0-9]+", text.lower())
        rows += [(number, licence, t, terms.count(t)) for t in sorted(set(terms))]
    return rows


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def segments(text: Column, pattern: str) -> Column:
    """(text, whether it is the whole text) for each distinct line and paragraph that matches, and the whole text."""
    parts = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n")))
    parts = F.filter(parts, lambda x: F.lower(x).rlike(pattern))
    each = F.transform(parts, lambda x: F.struct(x.alias("part"), F.lit(False).alias("whole")))
    return F.when(F.lower(text).rlike(pattern), F.concat(each, F.array(F.struct(text.alias("part"), F.lit(True).alias("whole")))))


def _weights(base: DataFrame, of: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame, int]:
    """Stored tables of the templates' terms with their idf and of the templates' unit vectors, and the number of texts."""
    given = template_terms(of)
    templates = base.sparkSession.createDataFrame(given, "template int, licence string, term string, tf int")
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for _, _, t, _ in given})])
    # Each text counts once for the empty term.
    own = F.concat(F.array_intersect(terms_of(F.col("text")), vocabulary), F.array(F.lit("")))
    found = store(base.select(F.explode(own).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n_docs = (found.where("term = ''").first() or {"df": 0})["df"]
    # As many rows as the fixed templates have terms.
    idf = store(templates.select("term").distinct().join(found, "term", "left").select("term", (F.log((n_docs + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")), "idf")
    own = templates.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = own.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, store(own.join(norms, "template").select("template", "licence", "term", "idf", (F.col("w") / F.col("norm")).alias("tw")), "templates"), n_docs


def _cosines(scanned: DataFrame, idf: DataFrame, own: DataFrame, n_docs: int, of: dict[str, tuple[str, ...]]) -> DataFrame:
    """row, part, whole, template, licence, clauses, size (terms), cosine of each segment and template that share a term and do not contradict."""
    unseen = F.log(F.lit(n_docs + 1.0)) + 1
    own = own.drop("idf")
    about = template_marks(of)
    known = sorted({t for _, _, needs, forbids in about for t in (*needs, *forbids)})
    about = scanned.sparkSession.createDataFrame(about, "template int, clauses int, needs array<string>, forbids array<string>")
    parts = scanned.where("segments is not null").select("row", F.posexplode("segments").alias("part", "s"))
    words = parts.select("row", "part", F.col("s.whole").alias("whole"), F.explode(terms_of(F.col("s.part"))).alias("term"))
    weighed = words.groupBy("row", "part", "whole", "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(idf), "term", "left")
    weighed = store(weighed.select("row", "part", "whole", "term", "tf", (F.col("tf") * F.coalesce("idf", unseen)).alias("w")), "segments")
    # Of a segment's terms only those that decide are gathered; they are as many as ``known`` at most.
    decide = F.collect_set(F.when(F.col("term").isin(known), F.col("term"))).alias("marks")
    lengths = weighed.groupBy("row", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.sum("tf").alias("size"), decide)
    dots = weighed.join(F.broadcast(own), "term").groupBy("row", "part", "whole", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    found = dots.join(lengths, ["row", "part"]).join(F.broadcast(about), "template")
    fits = (F.size(F.array_except("needs", "marks")) == 0) & ~F.arrays_overlap("forbids", "marks")
    return found.where(fits).select("row", "part", "whole", "template", "licence", "clauses", "size", F.round(F.col("dot") / F.col("length"), 9).alias("cosine"))


def _own(cosines: DataFrame) -> DataFrame:
    """__row, licence, cosine of texts with a matching segment."""
    found = cosines.where(F.col("cosine") >= LINE_COSINE)
    # A licence's clauses count together or not at all. A row per template and licence of a text at most.
    there = found.where("clauses > 0").groupBy("row", "licence").agg(F.count_distinct("template").alias("n"), F.max("clauses").alias("wanted"))
    there = there.where("n = wanted").select(F.col("row").alias("r"), F.col("licence").alias("l"), F.lit(True).alias("all"))
    found = found.join(there, (F.col("row") == F.col("r")) & (F.col("licence") == F.col("l")), "left").where("clauses = 0 or all")
    each = found.groupBy("row", "licence", "part").agg(F.max("cosine").alias("cosine"), F.first("size").alias("size"))
    score = F.round(F.sum(F.col("cosine") * F.col("size")), 6)
    each = each.groupBy("row", "licence").agg(score.alias("score"), F.max("cosine").alias("cosine"))
    best = F.min(F.struct(F.col("licence").isin(list(LAST)).alias("last"), (-F.col("score")).alias("less"), "licence", "cosine"))
    return each.groupBy(F.col("row").alias("__row")).agg(best.alias("b")).select("__row", F.col("b.licence").alias("licence"), F.col("b.cosine").alias("cosine"))


def _best() -> Column:
    """The highest cosine, then the first licence; a rights line comes last."""
    return F.min(F.struct(F.col("licence").isin(list(LAST)).alias("last"), (-F.col("cosine")).alias("c"), "licence"))


def scan(files: DataFrame, doc_id: str, path: Column, text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, path, licence, cosine, inherited_licence, inherited_from, one row per file; ``path`` has /
    between parts; ``templates``: notices, titles or whole texts by licence id."""
    base = files.select(named(doc_id).alias("doc_id"), path.alias("path"), text_or_empty(text).alias("text"))
    idf, weights, n_docs = _weights(base, templates)
    # A row per term of the templates.
    gate = gate_terms([(r.template, r.term, r.idf, r.tw) for r in weights.collect()], LINE_COSINE)
    scanned = base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"),
        F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)).alias("named"), segments(F.col("text"), gate_pattern(gate)).alias("segments"),
    )
    scanned = store(scanned, "scanned")
    cosines = store(_cosines(scanned, idf, weights, n_docs, templates), "cosines")
    own = store(_own(cosines), "own")
    by_name = own.join(scanned.where("named").select("row", "folder"), F.col("__row") == F.col("row")).select("folder", "licence", "cosine")
    # As a whole it is the licence that it was found to have.
    whole = cosines.where("whole").where(F.col("cosine") >= FILE_COSINE).join(own.select("__row", F.col("licence").alias("own")), F.col("row") == F.col("__row")).where("licence = own")
    whole = whole.join(scanned.select("row", "folder"), "row").select("folder", "licence", "cosine")
    governing = by_name.union(whole).groupBy("folder").agg(_best().alias("b"))
    governing = governing.select("folder", F.col("b.licence").alias("inherited_licence"))
    folders = store(scanned.groupBy("folder").agg(F.count(F.lit(1)).alias("files")), "folders")
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ups = store(folders.select("folder", "files", F.explode(F.array_distinct(up)).alias("up")), "ups")
    below = ups.groupBy("up").agg(F.count(F.lit(1)).alias("below"))
    nearest = bounded_join(ups, store(below.join(governing, F.col("up") == F.col("folder")).drop("folder"), "governing"), "up", "below", "inner")
    near = F.max_by(F.struct("inherited_licence", F.col("up").alias("inherited_from")), F.length("up")).alias("near")
    nearest = store(nearest.groupBy("folder").agg(F.first("files").alias("files"), near), "nearest")
    out = scanned.select("row", "doc_id", "path", "folder").where("folder is not null")
    out = bounded_join(out, nearest, "folder", "files").unionByName(scanned.where("folder is null").select("row", "doc_id", "path", "folder"), True)
    out = out.join(own, out.row == F.col("__row"), "left")
    none = F.col("licence").isNull()
    return out.select("doc_id", "path", "licence", "cosine", F.when(none, F.col("near.inherited_licence")).alias("inherited_licence"), F.when(none, F.col("near.inherited_from")).alias("inherited_from"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """``scan`` over documents, where a source is a directory with one below it for each language."""
    return scan(docs, "doc_id", F.concat_ws("/", F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _sql() -> str:
    values = ", ".join(f"({n}, '{k}', '{t}', {c})" for n, k, t, c in template_terms())
    listed = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]::VARCHAR[]"
    about = ", ".join(f"({n}, {c}, {listed(needs)}, {listed(forbids)})" for n, c, needs, forbids in template_marks())
    last = ", ".join(f"'{x}'" for x in LAST)
    return rf"""
WITH templates(template, licence, term, tf) AS (VALUES {values}),
about(template, clauses, needs, forbids) AS (VALUES {about}),
vocabulary AS (SELECT list(DISTINCT term) AS v FROM templates),
files AS (
  SELECT row_number() OVER () AS row, doc_id, concat_ws('/', source, lang, coalesce(CAST(doc_id AS VARCHAR), '')) AS path, coalesce(text, '') AS text FROM documents
),
scanned AS (
  SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder,
         list_distinct(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n') || string_split(text, chr(10))) AS parts
  FROM files
),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), v)) AS term FROM files, vocabulary) GROUP BY term),
n AS (SELECT count(*) AS n FROM files),
idf AS (SELECT term, ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM templates) LEFT JOIN df USING (term), n),
own AS (SELECT template, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS tw FROM templates JOIN idf USING (term)),
segments AS (
  SELECT row, part, part AS body, false AS whole FROM (SELECT row, unnest(parts) AS part FROM scanned)
  UNION ALL SELECT row, NULL, text, true FROM scanned
),
words AS (SELECT row, part, whole, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM segments),
weighed AS (
  SELECT row, part, whole, term, tf, tf * coalesce(idf, ln((SELECT n FROM n) + 1.0) + 1) AS w
  FROM (SELECT row, part, whole, term, count(*) AS tf FROM words GROUP BY ALL) LEFT JOIN idf USING (term)
),
lengths AS (SELECT row, part, whole, sqrt(sum(w * w)) AS length, sum(tf) AS size, list(term) AS marks FROM weighed GROUP BY ALL),
dots AS (SELECT row, part, whole, template, licence, sum(w * tw) AS dot FROM weighed JOIN own USING (term) GROUP BY ALL),
cosines AS (
  SELECT d.row, d.part, d.whole, template, licence, clauses, size, round(dot / length, 9) AS cosine
  FROM dots d JOIN lengths l ON d.row = l.row AND d.part IS NOT DISTINCT FROM l.part AND d.whole = l.whole JOIN about USING (template)
  WHERE list_has_all(marks, needs) AND NOT list_has_any(marks, forbids)
),
matching AS (
  SELECT *, count(DISTINCT CASE WHEN clauses > 0 THEN template END) OVER (PARTITION BY row, licence) AS there,
         max(clauses) OVER (PARTITION BY row, licence) AS wanted FROM cosines WHERE cosine >= {LINE_COSINE}
),
scores AS (
  SELECT row, licence, round(sum(cosine * size), 6) AS score, max(cosine) AS cosine
  FROM (SELECT row, licence, part, whole, max(cosine) AS cosine, any_value(size) AS size FROM matching WHERE clauses = 0 OR there = wanted GROUP BY ALL) GROUP BY ALL
),
best AS (SELECT row, min(struct_pack(last := licence IN ({last}), less := -score, l := licence, c := cosine)) AS b FROM scores GROUP BY row),
governing AS (
  SELECT folder, min(struct_pack(last := licence IN ({last}), c := -cosine, l := licence)).l AS licence FROM (
    SELECT folder, b.l AS licence, b.c AS cosine FROM best JOIN scanned USING (row) WHERE regexp_matches(path, '{LICENCE_FILE}')
    UNION ALL SELECT folder, licence, cosine FROM cosines JOIN scanned USING (row) JOIN best USING (row) WHERE whole AND cosine >= {FILE_COSINE} AND licence = b.l
  ) GROUP BY folder
),
nearest AS (
  SELECT f.folder, max_by(struct_pack(l := g.licence, up := g.folder), length(g.folder)) AS near
  FROM (SELECT DISTINCT folder FROM scanned) f JOIN governing g ON g.folder = '' OR f.folder = g.folder OR starts_with(f.folder, g.folder || '/')
  GROUP BY f.folder
)
SELECT doc_id, path, b.l AS licence, b.c AS cosine, CASE WHEN b IS NULL THEN near.l END AS inherited_licence, CASE WHEN b IS NULL THEN near.up END AS inherited_from
FROM scanned LEFT JOIN best USING (row) LEFT JOIN nearest USING (folder)
"""


OP8_SQL = _sql()
