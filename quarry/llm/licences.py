"""Operator 2: licence scans with sparse TF-IDF vectors, in DataFrame functions only.

Every line of a file, every paragraph of several lines and, for licence files, the whole text is a unit. Whole texts of
licence files are also compared with whole licences (``full_texts``), which come first where one is near. A unit's
sparse vector holds ``tf * idf`` of its terms; document frequencies of the templates' terms are counted over all files,
other terms weigh like a term of no file. Units match the template with the highest cosine of at least ``threshold``.

Which units can match is decided exactly, not by sampling: per template the most common terms are set aside as long as
their share of the template's norm stays below the threshold. A unit made of such terms and foreign ones only cannot
reach it, so texts without any other template term are passed over before they are split.

A file without a match of its own inherits from the nearest ancestor directory that holds a matched licence file; files
are joined to licences by the path of each ancestor.
"""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import materialise

#: Notices by which licences are named.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2 of the License, or any later version",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
}
TEMPLATES["Apache-2.0"] += (
    "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache "
    "License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
)
TEMPLATES["MPL-2.0"] += (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
    "one at http://mozilla.org/MPL/2.0/.",
)
TEMPLATES["MIT"] += ("Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at opensource.org/licenses/MIT.",)
for _name, _of, _version in (("GPL-1.0", "", "1"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
    TEMPLATES[_name] = TEMPLATES.get(_name, (f"Licensed under the GNU {_of}General Public License, version {_version}.",)) + (
        f"you can redistribute it and/or modify it under the terms of the GNU {_of}General Public License, either version {_version} of the License, or any later version",
    )
for _version, _where in (("4.0", "International"), ("3.0", "Unported")):
    for _short, _long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
        TEMPLATES[f"CC-{_short}-{_version}"] = (f"Licensed under CC {_short} {_version}.", f"This work is licensed under a Creative Commons Attribution{_long} {_version} {_where} License.")
#: Words that tell licences apart. A unit must hold those of a template and its version; of a family's notice, a unit
#: that holds another of ``APART`` is of another licence.
TOLD = frozenset("apache mit lesser library affero mozilla bsd".split())
APART = frozenset("lesser affero nd nc sa noderivatives noncommercial sharealike".split())
FAMILIES = frozenset("gnu cc creative".split())
#: How files name their licence by its identifier, and endings that do not change which it is.
SPDX, SPDX_END = "SPDX-License-Identifier:[ \t]*[(]?([A-Za-z0-9.+-]+)", "(-only|-or-later|[+])$"
PARAGRAPH = "\n[ \t\r]*[#*/;%!-]*[ \t\r]*\n"
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies."
)
#: For files named as licence files only: whole short licences, their grants, and the titles of long ones.
FILE_TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, _MIT + _MIT_REST),
    "BSD-2-Clause": (_BSD + _BSD_REST,),
    "BSD-3-Clause": (_BSD + _BSD_NAMES + _BSD_REST,),
    "ISC": (_ISC,),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991",),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU Lesser General Public License Version 2.1, February 1999",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3, 29 June 2007",),
    "AGPL-3.0": ("GNU Affero General Public License Version 3, 19 November 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
TERM = "[a-z]+|[0-9]+(?:\\.[0-9]+)*"
#: Whole short licences, beside the texts in the folder ``licence_texts``.
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
    "not be removed or altered from any source distribution."
)
_ISC_REST = (
    " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
    "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act "
    "of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT "
    "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AFFERO = (
    " Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, "
    "your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such "
    "interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server "
    "at no charge, through some standard or customary means of facilitating copying of software. "
)
#: A whole text counts as a licence from this cosine on.
FULL = 0.85
SALTS = 16
_COPYRIGHT = r"(?i)(^|\n)[ \t]*copyright\b[^\n]*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def full_texts() -> dict[str, str]:
    """Whole licences by name: those of the folder ``licence_texts``, the short ones above, and the Affero licence, which is
    the GPL 3 under its own name with one more section."""
    folder, out = os.path.join(os.path.dirname(__file__), "licence_texts"), {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out[name.removesuffix(".txt")] = f.read()
    out["AGPL-3.0"] = re.sub(r"(?i)GNU\s+General\s+Public", "GNU Affero General Public", out["GPL-3.0"]) + _AFFERO
    out |= {"MIT": "MIT License " + _MIT + _MIT_REST, "BSD-2-Clause": _BSD + _BSD_REST, "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_REST}
    return out | {"ISC": "ISC License " + _ISC + _ISC_REST, "Unlicense": _UNLICENSE, "Zlib": _ZLIB}


def full_counts() -> dict[str, dict[str, int]]:
    """Terms of each whole licence and how often they stand in it, without lines that begin with "Copyright"."""
    return {name: _counts(re.sub(_COPYRIGHT, " ", text)) for name, text in full_texts().items()}


def _full_matches(rows: DataFrame) -> DataFrame:
    """``k1, k2, full_licence, full_cosine`` of the rows whose whole text, lines of copyright apart, is near a licence.

    A text that holds few of a licence's rarest terms cannot reach ``FULL``: its cosine is at most the root of the share of
    the licence's squared weights on terms it holds. So only texts with ``least`` of the rare terms are looked at further."""
    spark = rows.sparkSession
    counted = full_counts()
    vocabulary = spark.createDataFrame([(t,) for t in sorted({t for c in counted.values() for t in c})], "term string")
    words = terms(F.regexp_replace("text", _COPYRIGHT, " "))
    total = rows.count()
    held = rows.select(F.explode(F.array_distinct(words)).alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").count().collect()  # one row a term
    df = {r["term"]: r["count"] for r in held}
    idf = {r: math.log((total + 1) / (df.get(r, 0) + 1)) + 1 for c in counted.values() for r in c}
    foreign = math.log(total + 1) + 1
    weights, rare, least = [], set(), 1 << 30
    for name, c in counted.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        w = {t: n * idf[t] / norm for t, n in c.items()}
        weights += [(t, name, x, idf[t]) for t, x in w.items()]
        own, mass = [], 0.0
        for t in sorted(w, key=lambda t: (df.get(t, 0), -w[t], t)):
            own.append(w[t] ** 2)
            rare.add(t)
            mass += own[-1]
            if mass > 0.5:
                break
        reach, need = 1 - mass, 0
        for x in sorted(own, reverse=True):
            if reach >= FULL * FULL * (1 - 1e-9):
                break
            reach, need = reach + x, need + 1
        least = min(least, need)
    some = F.split(F.lit(" ".join(sorted(rare))), " ")
    near = rows.filter(F.size(F.array_intersect(words, some)) >= least).dropDuplicates(["k1", "k2"])
    tf = near.select("k1", "k2", F.explode(words).alias("term")).groupBy("k1", "k2", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialise(tf, "licence-words")
    table = spark.createDataFrame(weights, "term string, licence string, weight double, idf double")
    norm = tf.join(F.broadcast(table.select("term", "idf").distinct()), "term", "left")
    norm = norm.groupBy("k1", "k2").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(foreign)), 2))).alias("norm"))
    dots = tf.join(F.broadcast(table), "term").groupBy("k1", "k2", "licence").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    hits = dots.join(norm, ["k1", "k2"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= FULL)
    best = hits.groupBy("k1", "k2").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"))
    return materialise(best.select("k1", "k2", F.col("best.licence").alias("full_licence"), (-F.col("best.c")).alias("full_cosine")), "licence-wholes")


def told(counts: dict[str, int]) -> tuple[set[str], bool]:
    """The terms of a template that a unit must hold: its version's numbers and the words that tell licences apart; and whether
    the template is of a family, of which a unit may not hold other words of ``APART``."""
    return {t for t in counts if t[0].isdigit() or t in TOLD or t in APART}, not FAMILIES.isdisjoint(counts)


def spdx_names() -> list[str]:
    """Identifiers that count: of all licences that are known here."""
    return sorted({*TEMPLATES, *FILE_TEMPLATES, *full_texts()})


def _counts(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in re.findall(TERM, text.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def telling_terms(vectors: list[dict[str, float]], threshold: float) -> set[str]:
    """Terms of which a unit must hold one to reach ``threshold``: for each vector all but its lightest terms, as long
    as the lightest together stay below the threshold's share of the norm."""
    out: set[str] = set()
    for v in vectors:
        total, held = sum(w * w for w in v.values()), 0.0
        for term, w in sorted(v.items(), key=lambda x: (x[1], x[0])):
            held += w * w
            if held >= threshold * threshold * total * (1 - 1e-9):
                out.add(term)
    return out


def _matches(rows: DataFrame, templates: dict[str, tuple[str, ...]], threshold: float) -> DataFrame:
    """``k1, k2, licence, cosine, file_licence, file_cosine`` of the rows of which a unit reaches the threshold; the last
    two are of whole texts."""
    spark = rows.sparkSession
    counted = [(name, i, _counts(t)) for name, texts in templates.items() for i, t in enumerate(texts)]
    vocabulary = sorted({t for _, _, c in counted for t in c})
    known = F.array(*map(F.lit, vocabulary))
    total = rows.count()
    seen = rows.select(F.explode(F.array_intersect(terms(F.col("text")), known)).alias("term")).groupBy("term").count().collect()  # one row a term
    df = {r["term"]: r["count"] for r in seen}
    idf = {t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    foreign = math.log(total + 1) + 1
    vectors = [{t: n * idf[t] for t, n in c.items()} for _, _, c in counted]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    weights = spark.createDataFrame(
        [(t, name, i, w / norm, idf[t], t in told(c)[0], len(told(c)[0]), told(c)[1]) for (name, i, c), v, norm in zip(counted, vectors, norms, strict=True) for t, w in v.items()],
        "term string, licence string, template int, weight double, idf double, must boolean, need int, family boolean",
    )
    telling = sorted(telling_terms(vectors, threshold))
    # Whole terms: words between other characters than letters, numbers between other characters than digits.
    words_, numbers = ("|".join(re.escape(t) for t in telling if t[0].isdigit() == digit) or "[^\\s\\S]" for digit in (False, True))
    pattern = f"(?i)(?<![a-z])(?:{words_})(?![a-z])|(?<![0-9])(?:{numbers})(?![0-9])"

    text = F.col("text")
    paragraphs = F.filter(F.split(text, PARAGRAPH), lambda p: F.contains(F.trim(p), F.lit("\n")))
    unit = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("unit"))
    whole = F.when(F.col("whole"), F.array(F.struct(F.lit(2).alias("kind"), text.alias("unit")))).otherwise(F.array().cast("array<struct<kind:int,unit:string>>"))
    units = (
        rows.filter(text.rlike(pattern))
        .dropDuplicates(["k1", "k2"])
        .select("k1", "k2", F.posexplode(F.concat(F.transform(F.split(text, "\n"), unit(0)), F.transform(paragraphs, unit(1)), whole)).alias("at", "u"))
        .filter(F.col("u.unit").rlike(pattern))
    )
    each = units.select("k1", "k2", "at", "u.kind", F.explode(terms(F.col("u.unit"))).alias("term"))
    tf = each.groupBy("k1", "k2", "at", "kind", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialise(tf, "licence-terms")
    ideal = F.broadcast(weights.select("term", "idf").distinct())
    apart = F.col("term").isin(*sorted(APART))
    norm = tf.join(ideal, "term", "left").groupBy("k1", "k2", "at").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(foreign)), 2))).alias("norm"), F.count(F.when(apart, 1)).alias("others"))
    dots = (
        tf.join(F.broadcast(weights), "term").groupBy("k1", "k2", "at", "kind", "licence", "template")
        .agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"), F.count(F.when(F.col("must"), 1)).alias("had"), F.count(F.when(apart, 1)).alias("own"), F.max("need").alias("need"), F.max("family").alias("family"))
        .filter(F.col("had") == F.col("need"))
    )
    hits = dots.join(norm, ["k1", "k2", "at"]).filter(~F.col("family") | (F.col("own") == F.col("others")))
    hits = hits.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold)
    best = lambda f: F.max_by(f, F.struct("cosine", F.lit(0) - F.col("order")))
    names = spark.createDataFrame([(n, k) for k, n in enumerate(sorted(templates))], "licence string, order int")
    hits = hits.join(F.broadcast(names), "licence")
    own = hits.groupBy("k1", "k2").agg(
        best(F.col("licence")).alias("licence"),
        F.max("cosine").alias("cosine"),
        F.max_by(F.when(F.col("kind") == 2, F.col("licence")), F.when(F.col("kind") == 2, F.struct("cosine", F.lit(0) - F.col("order")))).alias("file_licence"),
        F.max(F.when(F.col("kind") == 2, F.col("cosine"))).alias("file_cosine"),
    )
    return materialise(own, "licences")


def licence_scan(
    files: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    threshold: float = 0.6,
    whole_file: Column | None = None,
) -> DataFrame:
    """One row for each input row: ``doc_id, path, licence, cosine, licence_file, inherited, inherited_from``.

    ``licence`` is the file's own best match, null if none reaches ``threshold``; equal cosines go to the first name. A match
    must hold the version and the words that tell its licence apart (``told``). The first SPDX identifier of a file, if its
    licence is known here, comes before its notices, with a cosine of 1.
    ``licence_file`` tells that the file counts for its directory: one named as a licence file by its best match of any
    kind, with ``FILE_TEMPLATES`` (idf from such files) where those are nearer; one where ``whole_file`` holds if its whole
    text matches. The whole text of either is first compared with ``full_texts`` (idf from such files, lines of copyright
    left out); a cosine of ``FULL`` or more decides, as its name. ``inherited`` and ``inherited_from`` (the licence file's path) are set for files without a
    match of their own; of several licence files in one directory the highest cosine counts, then the smallest path.
    Null text is empty and matches nothing; a null path has no directory. Repeated rows get equal results, an empty
    table an empty result; further columns are not read.
    """
    rows = files.select(
        F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.coalesce(F.col(path_col).rlike(LICENCE_FILE), F.lit(False)) | (F.coalesce(whole_file, F.lit(False)) if whole_file is not None else F.lit(False))).alias("whole"),
    )
    rows = rows.withColumns({"k1": F.xxhash64("path", "text", "whole"), "k2": F.xxhash64(F.lit(2), "whole", "text", "path")})

    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    own = _matches(rows, templates or TEMPLATES, threshold)
    if templates is None:
        said = F.regexp_replace(F.regexp_extract("text", SPDX, 1), SPDX_END, "")
        said = rows.filter(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("k1", "k2", said.alias("said")).filter(F.col("said").isin(spdx_names())).dropDuplicates(["k1", "k2"])
        own = own.join(said, ["k1", "k2"], "full_outer")
        own = own.withColumns({"licence": F.coalesce("said", "licence"), "cosine": F.when(F.col("said").isNotNull(), 1.0).otherwise(F.col("cosine"))}).drop("said")
    nothing = rows.sparkSession.createDataFrame([], "k1 long, k2 long, full_licence string, full_cosine double")
    if templates is None and rows.filter(named).limit(1).count():
        full = _matches(materialise(rows.filter(named), "licence-texts"), FILE_TEMPLATES, threshold)
        full = full.select("k1", "k2", F.col("licence").alias("full_licence"), F.col("cosine").alias("full_cosine"))
        nearer = F.coalesce(F.col("full_cosine") > F.coalesce("cosine", F.lit(0.0)), F.lit(False))
        both = own.join(full, ["k1", "k2"], "full_outer").withColumn("nearer", nearer)
        own = both.withColumns({c: F.when(F.col("nearer"), F.col(f"full_{c}")).otherwise(F.col(c)) for c in ("licence", "cosine")})
        own = materialise(own.drop("nearer", "full_licence", "full_cosine"), "licences")
    wholes = _full_matches(rows.filter("whole")) if templates is None else nothing

    slim = rows.select("doc_id", "path", "k1", "k2").join(own, ["k1", "k2"], "left")
    slim = slim.withColumns({f"file_{c}": F.when(named, F.col(c)).otherwise(F.col(f"file_{c}")) for c in ("licence", "cosine")})
    whole = F.col("full_licence").isNotNull()
    slim = slim.join(wholes, ["k1", "k2"], "left").withColumns({f"{f}{c}": F.when(whole, F.col(f"full_{c}")).otherwise(F.col(f"{f}{c}")) for f in ("", "file_") for c in ("licence", "cosine")})
    slim = slim.drop("full_licence", "full_cosine")
    slim = materialise(slim, "licence-files")
    own_dir = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    held = slim.filter("file_licence IS NOT NULL AND path IS NOT NULL").withColumn("dir", own_dir)
    held = held.groupBy("dir").agg(F.min(F.struct((-F.col("file_cosine")).alias("c"), "path", "file_licence")).alias("best"))
    held = materialise(held.select("dir", F.col("best.path").alias("inherited_from"), F.col("best.file_licence").alias("inherited")), "licence-dirs")
    # Directories, not files, are joined to their ancestors. The root, an ancestor of all, is one row that is broadcast; a
    # directory that holds many files is dealt out over SALTS.
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("above")))
    lacking = slim.filter("licence IS NULL AND path IS NOT NULL").select(own_dir.alias("dir")).distinct().filter("dir <> ''")
    chain = lacking.select("dir", F.explode(above).alias("a")).select(F.col("dir").alias("own_dir"), "a.depth", F.col("a.above").alias("dir"))
    near = chain.join(held.filter("dir <> ''"), "dir").groupBy("own_dir").agg(F.max_by(F.struct("inherited", "inherited_from"), "depth").alias("near"))
    near = materialise(near, "licence-near").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    root = held.filter("dir = ''").select(F.struct("inherited", "inherited_from").alias("root"))
    root = F.broadcast(slim.sparkSession.range(1).select().join(root, F.lit(True), "left"))  # exactly one row
    dealt = slim.withColumns({"own_dir": own_dir, "salt": F.pmod(F.xxhash64("doc_id", "path", "k1"), F.lit(SALTS)).cast("int")})
    out = dealt.join(near, ["own_dir", "salt"], "left").crossJoin(root)
    out = out.withColumn("near", F.when(F.col("path").isNotNull(), F.coalesce("near", "root")))
    none = F.col("licence").isNull()
    return out.select(
        "doc_id", "path", "licence", "cosine", F.col("file_licence").isNotNull().alias("licence_file"),
        F.when(none, F.col("near.inherited")).alias("inherited"), F.when(none, F.col("near.inherited_from")).alias("inherited_from"),
    )
