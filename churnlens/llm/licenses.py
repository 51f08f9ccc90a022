"""License scan: a trained classifier of lines and paragraphs, confirmed by telling phrases and templates.

A paragraph is a run of consecutive lines with a word.  Looked at are its lines, every ``LINES`` or
fewer neighbouring lines joined, and all its lines joined, so that wrapped notices are read whole and
single lines within other text are found too.  One- and two-word parts of lines are hashed to
``BUCKETS`` places; a multinomial logistic regression over these sparse vectors tells the licence
families and the class ``unknown`` apart; the sum for joined lines is the sum of theirs.  It is trained
here on parts of the templates that hold a telling phrase (the families) and on lines of at most
``FIT_DOCS`` documents, those with the least hash of id and text, that share little with any template
(``unknown``); these bounds are for the fit alone.

A licence is predicted if the odds against ``unknown`` are even at least and exceed what 99.9 % of
all pieces of all documents reach that share little with any template; that threshold comes from a
histogram of the log odds in steps of 1/``STEPS``, counted per task.  A prediction is confirmed as the
likeliest family whose telling phrases are there, whose excluding phrases (lesser, affero,
noncommercial, sharealike, ...) are not, and with which most of the words, or of those of one of its
templates, are shared.

Scoring is done once, inside each document's row, with SQL functions; text is not shuffled.  Weights
are rounded to whole steps of a fine power of two, so that one number sums three classes exactly; a
joined piece's classes are summed only if its lines' greatest odds leave it a chance of even odds.

Defined results: null or blank text has no paragraphs and no families; repeated rows get equal
results; a paragraph counts as confirmed if any piece of it is, as unconfirmed if pieces were predicted
and none confirmed; if no unknown piece reaches even odds, these are needed; an empty table gives no
rows; columns beyond the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import materialised

# The families and the notices and grants of their public texts.
_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software "
        "Foundation, either version {2} of the License, or (at your option) any later version.")
_GNU_END = "You should have received a copy of the GNU {0}General Public License along with this {1}. If not, see <https://www.gnu.org/licenses/>."
_GNU_NO = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
           "PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.")


def _gnu(kind: str, short: str, thing: str, version: str) -> list[str]:
    kind = kind + " " if kind else ""
    return [f"This work is licensed under the GNU {kind}General Public License, version {version}.", f"Released under the GNU {kind}General Public License.",
            f"Licensed under the {short}.", f"Licensed under the GNU {short} v{version}.", f"SPDX-License-Identifier: {short}-{version}.0-or-later",
            _GNU.format(thing, kind, version), _GNU_NO.format(kind), _GNU_END.format(kind, thing)]


def _cc(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.",
            f"Except where otherwise noted, this content is licensed under a Creative Commons {long} 4.0 International License (CC {short} 4.0).",
            f"This article is distributed under the terms of the Creative Commons {long} 4.0 License.",
            f"This work is licensed under the Creative Commons {long} 3.0 Unported License. To view a copy of this license, visit https://creativecommons.org/licenses/{short.lower()}/3.0/ "
            "or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]


TEMPLATES = {
    "agpl": _gnu("Affero", "AGPL", "program", "3"),
    "apache": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
               "See the License for the specific language governing permissions and limitations under the License."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003",
              "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "bsd": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by": _cc("BY", "Attribution"),
    "cc-by-nc": _cc("BY-NC", "Attribution-NonCommercial"),
    "cc-by-nc-nd": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "cc-by-nc-sa": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nd": _cc("BY-ND", "Attribution-NoDerivatives"),
    "cc-by-sa": _cc("BY-SA", "Attribution-ShareAlike"),
    "cc0": ["Licensed under CC0 1.0.", "This work is released under CC0 1.0 Universal (Public Domain Dedication).", "This work is dedicated to the public domain under the Creative Commons Zero license.",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."],
    "epl": ["Released under the Eclipse Public License.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
            "Licensed under the EPL 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": _gnu("", "GPL", "program", "3"),
    "isc": ["Released under the ISC License.", "Licensed under the ISC license.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [*_gnu("Lesser", "LGPL", "library", "3"), _GNU.format("library", "Library ", "2"), _GNU_END.format("Library ", "library")],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License.", "Licensed under the MPL 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without written permission.",
                    "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
    "unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["Released under the zlib License.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
             "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
}
_CC, _NC = ["creative commons", "cc by"], ["noncommercial", "non commercial", "nc"]
_SA, _ND = ["sharealike", "share alike", "sa"], ["noderivatives", "noderivs", "no derivatives", "nd"]
_GNU_LESSER = ["lesser", "lgpl", "library general"]
#: Telling phrases: one of each list must be there, and none of the last one.
TELLING = {
    "agpl": ([["affero general", "gnu affero", "agpl", "agplv3"]], []),
    "apache": ([["apache license", "apache licence", "apache software license", "licensed under apache", "apache 2 0", "apache org licenses", "unless required by applicable law",
                 "without warranties or conditions", "governing permissions and limitations"]], []),
    "boost": ([["boost software license", "to any person or organization obtaining"]], []),
    "bsd": ([["bsd license", "bsd licence", "bsd style", "bsd 2", "bsd 3", "redistribution and use in source", "redistributions of source code", "redistributions in binary form", "endorse or promote products"]], []),
    "cc-by": ([_CC, ["attribution", "cc by"]], [*_NC, *_SA, *_ND]),
    "cc-by-nc": ([_CC, _NC], [*_SA, *_ND]),
    "cc-by-nc-nd": ([_CC, _NC, _ND], _SA),
    "cc-by-nc-sa": ([_CC, _NC, _SA], _ND),
    "cc-by-nd": ([_CC, _ND], [*_NC, *_SA]),
    "cc-by-sa": ([_CC, _SA], [*_NC, *_ND]),
    "cc0": ([["cc0", "creative commons zero", "waived all copyright"]], []),
    "epl": ([["eclipse public license", "epl 1 0", "epl 2 0", "the epl"]], []),
    "gpl": ([["gnu general public", "gnu gpl", "gpl", "gplv2", "gplv3"]], [*_GNU_LESSER, "affero", "agpl"]),
    "isc": ([["isc license", "isc licence", "with or without fee"]], []),
    "lgpl": ([[*_GNU_LESSER[1:], "lesser general", "gnu lesser"]], ["affero", "agpl"]),
    "mit": ([["mit license", "mit licence", "mit licensed", "any person obtaining a copy of this software", "free of charge to any person obtaining", "deal in the software without restriction",
              "merge publish distribute sublicense", "this permission notice shall be included"]], []),
    "mpl": ([["mozilla public license", "mpl 1 1", "mpl 2 0", "the mpl", "mozilla org mpl"]], []),
    "proprietary": ([["all rights reserved", "no part of this"]], []),
    "unlicense": ([["the unlicense", "free and unencumbered", "anyone is free to copy modify"]], []),
    "zlib": ([["zlib license", "zlib licence", "must not be misrepresented", "to alter it and redistribute it freely"]], []),
}
UNKNOWN = "unknown"
BUCKETS = 1024
PART = 0.7
#: Words in a line or a few wrapped lines; longer templates are trained on parts of these sizes too.
PART_WORDS = (7, 10, 14, 20, 30)
LINES = 3
STEPS = 16
FIT_DOCS = 2_000
#: Bits of one class's sum in a number that holds three, half its range, and how many weights are summed before they are parted.
LANE = 21
HALF = 1 << (LANE - 1)
SLICE = 256
CONFIRM = 0.6
FAMILIES = [*sorted(TEMPLATES), UNKNOWN]
BREAK = r"\n[^\p{L}\p{N}]*\n"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(w: str) -> str:
    return (f"transform(concat({w}, if(size({w}) < 2, array(), transform(sequence(1, size({w}) - 1), i -> concat({w}[i - 1], ' ', {w}[i])))), "
            f"g -> cast(pmod(xxhash64(g), {BUCKETS}) AS int))")


def _literal(values: list) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)!r}D" for v in values) + ")"


def _template_words() -> dict[str, list[list[str]]]:
    import re

    return {k: [sorted(set(re.findall(r"[^\W_]+", t.lower()))) for t in v] for k, v in TEMPLATES.items()}


def _shared(w: str, family: str) -> str:
    """Share of a piece's words that are the family's, or of one of its templates' that are in the piece."""
    own = _template_words()[family]
    every = _literal(sorted({x for t in own for x in t}))
    parts = [f"size(array_intersect({w}, {every})) / size(array_distinct({w}))"]
    parts += [f"size(array_intersect({w}, {_literal(t)})) / {len(t)}" for t in own]
    return f"greatest({', '.join(parts)})"


def _tells(said: str, family: str) -> str:
    """Whether the words ``said``, joined and edged by spaces, hold the family's phrases and none that exclude it."""
    groups, never = TELLING[family]
    has = [" OR ".join(f"contains({said}, ' {x} ')" for x in g) for g in groups]
    return " AND ".join([*(f"({h})" for h in has), *(f"NOT contains({said}, ' {x} ')" for x in never)])


def _said(w: str) -> str:
    return f"concat(' ', array_join({w}, ' '), ' ')"


def _alike(w: str) -> str:
    return "greatest(" + ", ".join(_shared(w, k) for k in FAMILIES[:-1]) + ")"


def training_rows(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(w, label): telling runs of template words, and lines of other content."""
    spark = docs.sparkSession
    given = spark.createDataFrame([(FAMILIES.index(k), t) for k, v in sorted(TEMPLATES.items()) for t in v], "label int, t string")
    sizes = f"array_distinct(concat(sequence(cast(ceil(size(w) * {PART}) AS int), size(w)), filter(array({', '.join(map(str, PART_WORDS))}), n -> n < size(w))))"
    runs = given.select("label", _words(F.col("t")).alias("w")).withColumn("n", F.explode(F.expr(sizes)))
    runs = runs.select("label", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("w")).withColumn("said", F.expr(_said("w")))
    runs = runs.where(F.expr("CASE label " + " ".join(f"WHEN {i} THEN {_tells('said', f)}" for i, f in enumerate(FAMILIES[:-1])) + " END"))
    some = docs.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(fit_docs)
    other = some.select(F.explode(F.split("text", "\n", -1)).alias("p")).select(_words(F.col("p")).alias("w")).where("size(w) > 0").distinct()
    return runs.select("w", "label").unionByName(other.where(F.expr(_alike("w")) < 0.5).select("w", F.lit(len(FAMILIES) - 1).alias("label")))


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> dict:
    """Weights by class and intercepts."""
    fit = materialised(training_rows(docs, fit_docs).select("label", F.expr(_grams("w")).alias("g")), "license-rows")
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], "t", "features", minTF=1.0)
    sizes = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(1.0 / n))]), F.col("label"))
    data = fit.select(F.col("g").cast("array<string>").alias("t"), F.col("label").cast("double").alias("label"), (weight * 1000).alias("weight"))
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=100, weightCol="weight", standardization=False).fit(counted.transform(data))
    matrix, shift = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    k = len(FAMILIES)
    return {"weights": [matrix[i].tolist() if i < len(matrix) else [0.0] * BUCKETS for i in range(k)],
            "shift": [float(shift[i]) if i < len(shift) else -50.0 for i in range(k)]}


def packed_weights(weights: list[list[float]]) -> tuple[int, np.ndarray]:
    """(steps, rows): weights in whole numbers of 1/steps, those of three classes in each row's numbers.

    A sum of at most ``SLICE`` of them keeps the three sums apart: each is below ``HALF``.
    """
    w = np.array(weights, np.float64)
    steps = 1 << max(int(np.floor(np.log2((HALF - SLICE) / (SLICE * max(np.abs(w).max(), 1e-3))))), 0)
    whole = np.round(w * steps).astype(np.int64)
    whole = np.concatenate([whole, np.zeros((-len(whole) % 3, whole.shape[1]), np.int64)])
    return steps, whole[0::3] + (whole[1::3] << LANE) + (whole[2::3] << 2 * LANE)


def _slices(g: Column) -> Column:
    """The numbers of a line in arrays of ``SLICE`` at most."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(g) - 1) / SLICE).cast("int")), lambda j: F.slice(g, j * SLICE + 1, F.lit(SLICE)))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_paragraphs, n_pieces, found: of each piece with even odds its paragraph, log odds, family (null: not confirmed) and whether it is unlike all templates."""
    k = len(FAMILIES) - 1
    paragraphs = F.transform(F.split("text", BREAK, -1), lambda p: F.filter(F.transform(F.split(p, "\n", -1), _words), lambda w: F.size(w) > 0))
    d = docs.select("doc_id", F.filter(paragraphs, lambda p: F.size(p) > 0).alias("ps"))
    d = d.select("doc_id", F.size("ps").cast("long").alias("n_paragraphs"), F.expr(f"transform(ps, p -> transform(p, w -> struct(w AS w, {_grams('w')} AS g)))").alias("ps"))

    steps, packed = packed_weights(model["weights"])
    lanes = [F.lit(row) for row in packed]

    def fold(g: Column, w: Column) -> Column:
        return F.aggregate(g, F.lit(0).cast("long"), lambda a, i: a + F.get(w, i))

    d = d.select("doc_id", "n_paragraphs", F.transform("ps", lambda p: F.transform(p, lambda x: F.struct(
        x["w"].alias("w"), F.transform(_slices(x["g"]), lambda g: F.array(*[fold(g, w) for w in lanes])).alias("t")))).alias("ps"))
    low = f"((v + {HALF}L) & {2 * HALF - 1}L) - {HALF}L"
    up = f"shiftright(v + {HALF}L, {LANE})"
    each = f"flatten(transform(t, v -> array({low}, {low.replace('v', f'({up})')}, {up.replace('v', f'({up})', 1)})))"
    d = d.select("doc_id", "n_paragraphs", F.expr(
        f"transform(ps, p -> transform(p, x -> struct(x.w AS w, transform(aggregate(x.t, array_repeat(0L, {3 * len(lanes)}), (a, t) -> zip_with(a, {each}, (x, y) -> x + y)), v -> v / {float(steps)!r}D) AS z)))").alias("ps"))
    # no family's log odds against unknown in a joined piece exceed the sum of its lines' greatest ones: m
    d = d.select("doc_id", "n_paragraphs", F.expr(f"transform(ps, p -> transform(p, x -> struct(x.w AS w, x.z AS z, array_max(slice(x.z, 1, {k})) - x.z[{k}] AS m)))").alias("ps"))
    least = -float(np.log(k)) - max(a - model["shift"][k] for a in model["shift"][:k]) - 1e-6
    # pieces as (first line, lines): neighbouring lines, then the whole paragraph where it is longer
    spans = "concat(" + ", ".join(f"if(size(p) < {n}, array(), transform(sequence(1, size(p) - {n} + 1), i -> struct(i AS i, {n} AS n)))" for n in range(1, LINES + 1))
    spans += f", if(size(p) > {LINES}, array(struct(1 AS i, size(p) AS n)), array()))"
    total = f"aggregate(slice(p, s.i, s.n), {_literal(model['shift'])}, (a, l) -> zip_with(a, l.z, (x, y) -> x + y))"
    # log of the families' summed odds against unknown; the greatest alone tells whether they can be even
    odds = f"aggregate(slice(z, 1, {k}), 0D, (a, y) -> a + exp(greatest(least(y - z[{k}], 690D), -690D)))"
    spans = f"filter({spans}, s -> aggregate(slice(p, s.i, s.n), 0D, (a, l) -> a + l.m) >= {least!r}D)"
    pieces = (f"transform(filter(transform({spans}, s -> struct(s AS s, {total} AS z)), v -> array_max(slice(v.z, 1, {k})) + {float(np.log(k))!r}D >= v.z[{k}]), "
              f"v -> struct(flatten(transform(slice(p, v.s.i, v.s.n), l -> l.w)) AS w, v.z AS z, ln({odds.replace('z[', 'v.z[').replace('slice(z', 'slice(v.z')}) AS t))")
    n_pieces = f"aggregate(ps, 0L, (a, p) -> a + " + " + ".join(f"greatest(size(p) - {n - 1}, 0)" for n in range(1, LINES + 1)) + f" + if(size(p) > {LINES}, 1, 0))"
    d = d.select("doc_id", "n_paragraphs", F.expr(n_pieces).alias("n_pieces"), F.expr(
        f"filter(flatten(transform(ps, (p, j) -> transform({pieces}, v -> struct(j AS j, v.w AS w, v.z AS z, v.t AS t)))), x -> x.t >= 0)").alias("xs"))
    d = d.select("doc_id", "n_paragraphs", "n_pieces", F.expr(f"transform(xs, x -> struct(x.j AS j, x.t AS t, x.w AS w, x.z AS z, {_said('x.w')} AS said))").alias("xs"))
    sure = ", ".join(f"if({_tells('x.said', f)} AND {_shared('x.w', f)} >= {CONFIRM}, struct(x.z[{i}] AS z, '{f}' AS f), null)" for i, f in enumerate(FAMILIES[:-1]))
    return d.select("doc_id", "n_paragraphs", "n_pieces", F.expr(
        f"transform(xs, x -> struct(x.j AS j, x.t AS t, array_max(array({sure})).f AS f, {_alike('x.w')} < 0.5 AS other))").alias("found"))


def needed(rows: DataFrame) -> float:
    """Log odds that at most one in 1,000 of the pieces unlike all templates exceeds, from a histogram over all rows; zero at least."""
    total = rows.agg(F.sum("n_pieces").alias("n"), F.sum(F.expr("cast(size(filter(found, x -> NOT x.other)) AS long)")).alias("own")).first()
    most = ((total["n"] or 0) - (total["own"] or 0)) / 1000
    bins = rows.select(F.explode(F.expr("filter(found, x -> x.other)")).alias("x")).groupBy(F.floor(F.col("x.t") * STEPS).alias("bin")).agg(F.count("*").alias("n")).collect()
    above = 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        above += r["n"]
        if above > most:
            return (r["bin"] + 1) / STEPS
    return 0.0


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, n_paragraphs, families (confirmed, sorted), n_confirmed, n_unconfirmed (paragraphs), score (best confirmed probability)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = materialised(scored(d, train(d, fit_docs)), "license-scores")
    d = rows.withColumn("ps", F.expr(f"filter(found, x -> x.t >= {needed(rows)!r}D)")).withColumn("sure", F.expr("filter(ps, x -> x.f IS NOT NULL)"))
    sure = "array_distinct(transform(sure, x -> x.j))"
    return d.select("doc_id", "n_paragraphs", F.expr("array_join(array_sort(array_distinct(transform(sure, x -> x.f))), ',')").alias("families"),
                    F.expr(f"cast(size({sure}) AS long)").alias("n_confirmed"), F.expr(f"cast(size(array_except(transform(ps, x -> x.j), {sure})) AS long)").alias("n_unconfirmed"),
                    F.expr("coalesce(array_max(transform(sure, x -> 1 / (1 + exp(-x.t)))), 0D)").alias("score"))
