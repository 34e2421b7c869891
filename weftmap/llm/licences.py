"""Licence scans: a trained paragraph classifier, confirmed by templates, in DataFrame functions.

A paragraph is a line with a word; a run of two or more short lines (wrapped text, up to a blank
or a long line) is joined to one more.  A sparse multinomial logistic regression over word
1- and 2-grams gives every paragraph its class: a licence family, ``unknown`` (a licence of no
family here) or ``none``.  It is trained here, with an L1 penalty, on notices made from names of
licences and frames, on paragraphs of licence texts and their cuts, on names and paragraphs of other
licences (for ``unknown``), and on a bounded sample of corpus lines (``TRAIN_LINES``) that match no
template (for ``none``).

Two limits are calibrated on texts that training did not see: a family counts from the confidence
that texts of left-out licences hardly ever reach; ``unknown`` from the share that left-out corpus
lines hardly ever reach.  A sure family must also share enough words with a template of its own, some of
which no other licence here uses, or it is unknown too.  A paragraph gets one family, the surest.

Defined results
    null or empty text   no paragraphs, licence null
    very long texts      split into paragraphs where they are read; none is cut
    ties                 the family first in alphabet, then the earliest paragraph
    repeated rows        one result each
    empty table          no rows; the classifier then knows the made texts only
    extra columns        not read
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, saved

# Names by which licence families are known.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License", "Apache-Lizenz"],
    "bsd": ["BSD License", "BSD 3-Clause License", "3-Clause BSD License", "2-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "BSD-Lizenz"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPLv3", "GPLv2", "GPLv3+", "GPL v3", "GPL-3.0-or-later", "GPL-2.0-only", "GPL version 3", "General Public License"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "LGPLv3", "LGPL v2.1", "LGPL-2.1", "LGPL-3.0-or-later", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT licence", "Expat License", "MIT-Lizenz", "MIT/X11 License", "The MIT License (MIT)"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPL v2"],
    "public-domain": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Unlicense", "CC0 1.0 Universal Public Domain Dedication", "The Unlicense", "Public Domain Mark 1.0"],
}
# Paragraphs of licence texts and notices.
PARAGRAPHS = {
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "You may not use the material for commercial purposes, and you must give appropriate credit."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "proprietary": [
        "All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission.", "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Copyright holders reserve all rights.", "Alle Rechte vorbehalten.", "Alle Rechte vorbehalten. Nachdruck nur mit Genehmigung des Verlags.", "Copyright 2019. Alle Rechte vorbehalten.", "Tous droits réservés.", "Tous droits réservés. Toute reproduction est interdite.", "Todos los derechos reservados.", "Todos los derechos reservados. Prohibida su reproducción.", "Copyright 2019. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
}
# Licences of no family here; the second half is left out of training, for calibration.
OTHER_NAMES = [
    "Eclipse Public License 2.0", "European Union Public Licence 1.2", "ISC License", "zlib License", "Artistic License 2.0", "SIL Open Font License 1.1", "Boost Software License 1.0", "CeCILL License", "Common Development and Distribution License", "Open RAIL License", "Business Source License 1.1", "Elastic License 2.0",
    "Microsoft Public License", "PostgreSQL License", "Python Software Foundation License", "Academic Free License 3.0", "Open Database License", "Community Data License Agreement", "IBM Public License", "Ruby License", "Vim License", "Sleepycat License", "PHP License 3.01", "Zope Public License 2.1",
]
# Paragraphs of licences of no family here; those of the second list are left out of training, for calibration.
OTHER_PARAGRAPHS = (
    [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at https://openfontlicense.org",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\").",
        "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work.",
        "Permission is granted to make and distribute verbatim copies of this manual provided the copyright notice and this permission notice are preserved on all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    ],
    [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
        "If you bring a patent claim against any contributor over patents that you claim are infringed by the software, your patent license from such contributor to the software ends automatically.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    ],
)
# Sentences in which a licence is named.
FRAMES = ["{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This file is {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "Available under the {}.", "Available under {}.", "SPDX-License-Identifier: {}", "License: {}", "Lizenziert unter {}.", "Veröffentlicht unter der {}.", "Sous licence {}.", "Publicado bajo la licencia {}."]
# Sentences that use words of licences without giving one.
TALK = ["The driver had a license and a permit.", "He asked for permission to leave.", "The warranty covers two years.", "copyright law", "a public library", "the general public", "free software conference", "a commons by the river", "Commission on the public domain", "the notice on the door", "under the bridge", "He lost his driving licence.", "a driving license under the old law", "MIT researchers found a new material.", "She studied at MIT.", "The BSD and GPL camps met.", "CC the manager on this.", "the terms of the treaty", "version 2.0", "the following conditions"]
UNKNOWN, NONE = "unknown", "none"
CLASSES = [*sorted({*NAMES, *PARAGRAPHS}), NONE, UNKNOWN]
TRAIN_LINES, VOCABULARY_SIZE = 1000, 12_000
#: Lines up to so many characters may be parts of a wrapped paragraph.
WRAP_CHARS = 100
#: Share of left-out texts that may pass a limit, and the least limits.
PASSING, LEAST_SURE, LEAST_LICENCE = 0.01, 0.5, 0.5
MIN_OVERLAP = 0.6


def paragraph_words(text: Column) -> Column:
    """Lower-case words; short words in capitals (MIT, CC, BY) end in "_", so they differ from ordinary ones.

    In a text of longer words in capitals and no small letters, capitals say nothing.
    """
    marked = F.when(text.rlike(r"\p{Ll}") | ~text.rlike(r"\p{Lu}{4}"), F.regexp_replace(text, r"\b(\p{Lu}{2,3})\b", "$1_")).otherwise(text)
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{N}._]+|\.(?=\s|$)", -1), lambda w: w != "")


def grams(words: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, k: F.concat(w, F.lit(" "), F.get(words, k + 1)))
    return F.concat(words, pairs)


def paragraphs(text: Column) -> Column:
    """Array of (line number from 0, body): the lines with a word, then the runs of short lines.

    A run gets the number of its first line.  Blank and long lines end it: they become a mark
    that no text holds, and what stands between two marks is a run.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda s, k: F.struct(k.cast("int").alias("line"), s.alias("body")))
    single = F.filter(lines, lambda x: x["body"].rlike(r"[\p{L}\p{N}]"))
    short = lambda x: (F.length(x["body"]) <= WRAP_CHARS) & (F.trim(x["body"]) != "")
    # first lines of runs: short, after none or another kind, before a short one
    firsts = F.filter(lines, lambda x, k: short(x) & ~F.coalesce(short(F.get(lines, k - 1)), F.lit(False)) & F.coalesce(short(F.get(lines, k + 1)), F.lit(False)))
    ends = F.filter(lines, lambda x, k: short(x) & F.coalesce(short(F.get(lines, k - 1)), F.lit(False)) & ~F.coalesce(short(F.get(lines, k + 1)), F.lit(False)))
    joined = F.zip_with(firsts, ends, lambda a, b: F.struct(a["line"].alias("line"), F.array_join(F.transform(F.slice(lines, a["line"] + 1, b["line"] - a["line"] + 1), lambda x: x["body"]), " ").alias("body")))
    return F.concat(single, joined)


def _cuts(text: str) -> list[str]:
    """A text, windows of it, and what is left of it without some words at either end."""
    words = text.split()
    out = [text]
    if len(words) >= 20:
        out += [" ".join(words[k : k + 20]) for k in range(0, len(words) - 10, 6)]
    for k in (1, 3):
        if len(words) - k >= 4:
            out += [" ".join(words[k:]), " ".join(words[:-k])]
    return out


def made_texts() -> list[dict]:
    """(label, body, held) of all made texts; held ones only calibrate."""
    out = []
    for family, names in NAMES.items():
        out += [{"label": family, "body": f.format(n), "held": i > 0 and (i + j) % 7 == 6} for i, n in enumerate(names) for j, f in enumerate(FRAMES)]
    for family, texts in PARAGRAPHS.items():
        out += [{"label": family, "body": c, "held": j > 0 and (i + j) % 5 == 4} for i, t in enumerate(texts) for j, c in enumerate(_cuts(t))]
    # what a line of a rights holder begins with
    heads = ("Copyright 2019. ", "(c) 2021. ", "© 2024 by the authors. ", "Copyright (c) 2020 Example Ltd. ")
    out += [{"label": "proprietary", "body": h + t, "held": False} for t in PARAGRAPHS["proprietary"] for h in heads]
    half = len(OTHER_NAMES) // 2
    out += [{"label": UNKNOWN, "body": f.format(n), "held": i >= half} for i, n in enumerate(OTHER_NAMES) for f in FRAMES if f != "{}"]
    out += [{"label": UNKNOWN, "body": c, "held": bool(held)} for held, texts in enumerate(OTHER_PARAGRAPHS) for t in texts for c in _cuts(t)]
    return out + [{"label": NONE, "body": t, "held": False} for t in TALK]


def templates() -> dict[str, list[str]]:
    """By family: its names and paragraphs."""
    return {c: [*NAMES.get(c, []), *PARAGRAPHS.get(c, [])] for c in CLASSES if c not in (NONE, UNKNOWN)}


def template_words(spark: SparkSession) -> dict[str, list[dict[str, list[str]]]]:
    """The distinct words of each template, and those of them that no other family and no other licence here uses.

    Made by the functions that read the corpus.
    """
    rows = [{"class": c, "body": t} for c, ts in templates().items() for t in ts] + [{"class": UNKNOWN, "body": t} for ts in OTHER_PARAGRAPHS for t in ts]
    found: dict[str, set[tuple[str, ...]]] = {}
    for r in _literal_rows(spark, rows, "class string, body string").select("class", F.array_sort(F.array_distinct(paragraph_words(F.col("body")))).alias("words")).collect():  # a fixed list
        found.setdefault(r["class"], set()).add(tuple(r["words"]))
    used = {c: set().union(*ws) for c, ws in found.items()}
    others = {c: set().union(*(u for k, u in used.items() if k != c)) for c in found}
    return {c: [{"words": list(w), "own": [x for x in w if x not in others[c]]} for w in sorted(ws) if w] for c, ws in found.items() if c != UNKNOWN}


def overlap(words: Column, known: list[dict[str, list[str]]]) -> Column:
    """The largest share of common words with a template; all words of a template of up to three must be there.

    Of a longer one that has words of its own, one at least must be there: what many licences say confirms none.
    """
    array = F.from_json(F.lit(json.dumps(known)), "array<struct<words:array<string>,own:array<string>>>")
    shared = lambda t: F.size(F.array_intersect(t, words)) / F.when(F.size(t) <= 3, F.size(t)).otherwise(F.least(F.size(t), F.size(words)))
    empty = lambda t: (F.size(words) == 0) | ((F.size(t["words"]) <= 3) & (shared(t["words"]) < 1)) | ((F.size(t["words"]) > 3) & (F.size(t["own"]) > 0) & ~F.arrays_overlap(t["own"], words))
    return F.array_max(F.transform(array, lambda t: F.when(empty(t), F.lit(0.0)).otherwise(shared(t["words"]))))


def _literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


class Model(NamedTuple):
    vectors: CountVectorizerModel
    regression: LogisticRegressionModel
    sure: float
    licence: float

    def scored(self, df: DataFrame, body: str) -> DataFrame:
        """``df`` with ``__words`` and the array ``__p`` of the probabilities of ``CLASSES``."""
        df = df.withColumn("__words", paragraph_words(F.col(body)))
        df = self.regression.transform(self.vectors.transform(df.withColumn("__grams", grams(F.col("__words")))))
        return df.withColumn("__p", vector_to_array("__probability")).drop("__grams", "__x", "__probability")


def train(docs: DataFrame, text: str = "text", lines: int = TRAIN_LINES) -> Model:
    """The classifier, and the calibrated limits."""
    spark = docs.sparkSession
    positive = _literal_rows(spark, made_texts(), "label string, body string, held boolean")
    every = [{"words": t["words"], "own": []} for ts in template_words(spark).values() for t in ts]
    # a few documents for each line that is wanted, then the lines of least hash
    share = min(1.0, 4 * lines / max(1, docs.count()))
    body = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < F.lit(share * (1 << 30))).select(F.explode(F.split(F.col(text), "\n", -1)).alias("body")).where(F.col("body").rlike(r"[\p{L}\p{N}]"))
    sample = body.orderBy(F.xxhash64("body"), "body").limit(lines)
    negative = sample.where(overlap(F.array_distinct(paragraph_words(F.col("body"))), every) < MIN_OVERLAP)
    rows = positive.unionByName(negative.select(F.lit(NONE).alias("label"), "body", (F.pmod(F.xxhash64("body", F.lit(5)), F.lit(5)) == 0).alias("held")))
    rows = saved(rows.withColumn("__grams", grams(paragraph_words(F.col("body")))), "train").coalesce(1)
    rows = rows.withColumn("y", F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")).cast("double") - 1)
    vectors = CountVectorizer(inputCol="__grams", outputCol="__x", vocabSize=VOCABULARY_SIZE, binary=True).fit(rows.where(F.col("label") != NONE))
    ready = vectors.transform(rows)
    regression = LogisticRegression(featuresCol="__x", labelCol="y", probabilityCol="__probability", rawPredictionCol="", predictionCol="", family="multinomial", regParam=3e-4, elasticNetParam=0.5, maxIter=60, standardization=False).fit(ready.where("not held"))
    model = Model(vectors, regression, LEAST_SURE, LEAST_LICENCE)
    held = model.scored(rows.where("held").select("label", "body"), "body").select("label", "__p").collect()  # bounded by the made texts and TRAIN_LINES
    drop_saved(rows)
    none, unknown = CLASSES.index(NONE), CLASSES.index(UNKNOWN)
    families = [max(p for k, p in enumerate(r["__p"]) if k not in (none, unknown)) for r in held if r["label"] in (UNKNOWN, NONE)]
    licence = [1 - r["__p"][none] for r in held if r["label"] == NONE]
    limit = lambda values, least: min(0.9, max([least, *sorted(values)[int((1 - PASSING) * len(values)) :][:1]]))
    return model._replace(sure=limit(families, LEAST_SURE), licence=limit(licence, LEAST_LICENCE))


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_overlap: float = MIN_OVERLAP, model: Model | None = None) -> DataFrame:
    """(doc_id, n_lines, n_paragraphs, n_licence_paragraphs, licence, licences, line, confidence, overlap) of every row.

    ``licence`` is the surest one, ``licences`` all families found, in alphabet, with commas.
    """
    model = model or train(docs.select(F.col(f"`{text}`").alias("text")))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n_lines = F.when(body == "", 0).otherwise(F.size(F.split(body, "\n", -1))).cast("long")
    units = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{doc_id}`").alias("doc_id"), n_lines.alias("n_lines"), paragraphs(body).alias("__all"))
    units = units.select("__row", "doc_id", "n_lines", F.size("__all").cast("long").alias("n_paragraphs"), F.posexplode_outer("__all").alias("__k", "__unit"))
    units = units.select("*", F.col("__unit.line").alias("line"), F.coalesce("__unit.body", F.lit("")).alias("__body")).drop("__unit")
    scored = model.scored(units, "__body").drop("__body")
    names = F.array(*[F.lit(c) for c in CLASSES])
    p = F.col("__p")
    none = F.get(p, F.lit(CLASSES.index(NONE)))
    # the best family, for its own sake; ties go to the first in alphabet
    best = F.array_max(F.transform(F.slice(p, 1, len(CLASSES) - 2), lambda x, k: F.struct(x.alias("p"), (-k).alias("k"))))
    hit = (F.col("__k").isNotNull()) & ((best["p"] >= model.sure) | (1 - none >= model.licence))
    # through a generator, so that nothing above is computed again for a filter
    judged = scored.select("__row", "doc_id", "n_lines", "n_paragraphs", "__k", "line", "__words", F.explode(F.array(F.struct(hit.alias("hit"), best["p"].alias("p"), F.get(names, -best["k"]).alias("class"), (1 - none).alias("licence"), F.get(p, F.lit(CLASSES.index(UNKNOWN))).alias("unknown")))).alias("s"))
    judged = judged.where(F.col("s.hit") | (F.coalesce(F.col("__k"), F.lit(0)) == 0))
    shared = F.lit(0.0)
    for c, known in template_words(docs.sparkSession).items():
        shared = F.when(F.col("s.class") == c, overlap(F.array_distinct("__words"), known)).otherwise(shared)
    judged = judged.withColumn("overlap", F.when(F.col("s.hit"), shared))
    sure = (F.col("s.p") >= model.sure) & (F.col("s.p") >= F.col("s.unknown")) & (F.col("overlap") >= min_overlap)
    name = F.when(~F.col("s.hit"), F.lit(None).cast("string")).when(sure, F.col("s.class")).when(F.col("s.licence") >= model.licence, F.lit(UNKNOWN))
    named = judged.select("__row", "doc_id", "n_lines", "n_paragraphs", "line", name.alias("licence"), F.when(sure, F.col("s.p")).otherwise(F.col("s.licence")).alias("confidence"), "overlap")
    rank = F.when(F.col("licence").isNotNull(), F.struct((F.col("licence") == UNKNOWN).alias("u"), (-F.col("confidence")).alias("c"), "licence", "line", "confidence", "overlap"))
    found = named.groupBy("__row", "doc_id", "n_lines", "n_paragraphs").agg(F.min(rank).alias("best"), F.count("licence").alias("n_licence_paragraphs"), F.array_sort(F.collect_set("licence")).alias("all"))
    families = F.when(F.size("all") > 1, F.array_remove("all", UNKNOWN)).otherwise(F.col("all"))  # parts of a wrapped notice may be unknown
    return found.select("doc_id", "n_lines", "n_paragraphs", "n_licence_paragraphs", F.col("best.licence").alias("licence"), F.array_join(families, ",").alias("licences"), F.col("best.line").alias("line"), F.col("best.confidence").alias("confidence"), F.col("best.overlap").alias("overlap"))
