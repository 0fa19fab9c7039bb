"""Licence scans by a trained paragraph classifier; DataFrame functions and spark.ml only.

A paragraph is a run of lines that aren't blank, without comment marks. Long ones hold other text besides a notice, and notices are wrapped, so what
is classified are the windows of one to WINDOW lines of a paragraph in which an anchor word stands. Features are the word uni- and
bigrams that the texts of TEMPLATES hold, present or not. A multinomial logistic regression with an L1 penalty tells the licence families and
`unknown` apart. It is trained on the paragraphs of the templates, whole, wrapped, in comments and with words left out, on sentences that only
sound like notices, and on at most `negatives` lines of the corpus, those with the least hash.

Unknown is calibrated by held-out families: for each group of KIN a model is trained without its families, and their paragraphs, which it
cannot know, are scored with it, as are the held-out rows of the others and held-out unknown rows. The temperature is the one under which
all these held-out rows are likeliest; `confidence` is raised, if need be, until at most `false_share` of the rows of held-out families pass.
A family counts only if a template of it confirms: `confirm` of the words of one of its paragraphs are in the window. Windows of a paragraph that overlap
count once, by the share of the template that they hold, then by probability, then the shorter, then the first; equal families by name.

Anchors are n-grams chosen from the model: without them no family can outscore unknown, as the other n-grams' positive weights don't sum up to
it. So passing over lines without them loses nothing.

Null and empty texts have no licences. Repeated rows are rows; other columns pass by. Very long texts are scanned whole. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear, table

UNKNOWN = "unknown"

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def _gnu(name: str, version: str) -> list[str]:
    """The notices that the GNU licences ask to be put at the start of files."""
    return [
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        f"You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/.",
        f"This work is licensed under the GNU {name}, version {version}",
        f"licensed under the GNU {name} version {version}",
    ]


def _commons(name: str, short: str) -> list[str]:
    return [f"Licensed under {short} 4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License", f"To view a copy of this license, visit http://creativecommons.org/licenses/{short[3:].lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]


# Standard texts by family, a paragraph each, whole where they are short, else the notices that they ask for; and the usual short forms.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _WARRANTY, "Released under the MIT License", "SPDX-License-Identifier: MIT", "Licensed under the MIT license",
    ],
    "gpl-3.0": [*_gnu("General Public License", "3"), "SPDX-License-Identifier: GPL-3.0-or-later", "released under the GPL v3"],
    "gpl-2.0": [*_gnu("General Public License", "2"), "SPDX-License-Identifier: GPL-2.0-only", "released under the GPL v2"],
    "lgpl": [*_gnu("Lesser General Public License", "2.1"), "licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "released under the LGPL"],
    "agpl": [*_gnu("Affero General Public License", "3"), "licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0", "released under the AGPL"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Licensed under the BSD License", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "subject to the terms of the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
        "Released under the ISC License", "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "SPDX-License-Identifier: Zlib",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", "SPDX-License-Identifier: BSL-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense",
    ],
    "cc-by": _commons("Attribution", "CC BY"),
    "cc-by-sa": _commons("Attribution-ShareAlike", "CC BY-SA"),
    "cc-by-nc": _commons("Attribution-NonCommercial", "CC BY-NC"),
    "cc-by-nd": _commons("Attribution-NoDerivatives", "CC BY-ND"),
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "released into the public domain under CC0", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["Copyright, all rights reserved", "This software is proprietary and confidential", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
#: Sentences with the notices' words that are none.
LOOKALIKES = [
    "She renewed her driving licence at the public office", "the version 2.0 of the film was released in march", "general practitioners work under public health rules",
    "He took a creative approach to common problems", "the source of the river is in the north", "permission to enter was granted to every person at the gate",
    "this work is described in the annex", "the terms of the treaty are subject to change", "free of charge for children", "a copy of the letter was sent to the office",
    "the museum is released from its duties under the law", "all rights and duties of members", "the software was tested", "license plates are issued by the state",
]
WORD = "[a-z0-9]+"
#: No features alone, only with the word beside.
SHORT = frozenset({"nc", "nd", "sa", "mit"})
#: Function words and digits: alone, or with each other, they are no features.
COMMON = frozenset(
    "the of and to in is that for it as with be on by at are this from or was an not have but which any all has no without under use you your a if may its such can "
    "following do so only also will been their they them these those were had into out up than then there when who more other each both either 0 1 2 3 4 5 6 7 8 9 10".split()
)


#: Lines that a window holds at most, and the words that a line should have: where a paragraph's lines are shorter on average, windows also go by as many lines
#: together as have them, so that a notice is covered however short the lines are that it is wrapped to.
WINDOW, LINE_WORDS = 4, 12
#: Families with texts in common, which are held out together.
KIN = (("gpl-3.0", "gpl-2.0", "lgpl", "agpl"), ("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc0"), ("mit", "bsd", "isc", "zlib", "boost", "unlicense"), ("apache-2.0", "mpl-2.0", "proprietary"))


@dataclass(frozen=True)
class LicenceRules:
    negatives: int = 2000
    confidence: float = 0.50
    confirm: float = 0.60
    penalty: float = 0.0002
    false_share: float = 0.10


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:]))]))


def grams(text: Column) -> Column:
    """Distinct word uni- and bigrams of a text column."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: lambda variables are, repeated expressions within lambdas aren't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SMALL = frozenset("the this a is work of under released and to".split())


def variants() -> list[tuple[str, str]]:
    """(text, family): each paragraph whole, in capitals, in a comment, in a sentence, its lines when wrapped by two and by three, and with one word left out."""
    out = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            out += [(x, family) for x in (notice, f"{notice}.", notice.upper(), f"# {notice}", f"// {notice}", f"Note: {notice}, see the file for more")]
            rows = [" ".join(words[k : k + 11]) for k in range(0, len(words), 11)]
            out += [(" ".join(rows[k : k + n]), family) for n in (2, 3) for k in range(len(rows) - n + 1) if len(rows) > n]
            out += [(" ".join(words[:k] + words[k + 1 :]), family) for k in range(len(words)) if len(words) < 40 and set(words_of(words[k])[:1]) & SMALL]
    return out + [(x, UNKNOWN) for s in LOOKALIKES for x in (s, s.upper(), f"# {s}")]


def training_rows(spark: SparkSession, documents: DataFrame, rules: LicenceRules) -> DataFrame:
    """(line, family), with whether the row is held out."""
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 20 and 2000")
    # One hash in `every` leaves a few thousand different lines of any corpus, so that tasks don't each send the driver as many.
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    every = max(1, total // (300 * rules.negatives))
    few = lines.where(F.pmod(F.xxhash64("line"), F.lit(every)) == 0).distinct()
    least = [x[0] for x in few.orderBy(F.xxhash64("line"), "line").limit(rules.negatives).collect()]  # bounded by the rules, 2000 characters each
    # The corpus may hold notices: lines with most words of a template aren't examples of unknown.
    known = [set(words_of(n)) for ns in TEMPLATES.values() for n in ns]
    plain = [x for x in least if not any(len(t & own) >= rules.confirm * len(t) for own in [set(words_of(x))] for t in known)]
    sample = spark.createDataFrame([(x, UNKNOWN) for x in plain], "line string, family string")
    given = spark.createDataFrame(variants(), "line string, family string")
    return given.unionByName(sample).withColumn("held_out", F.conv(F.substring(F.md5(F.concat_ws("|", "family", "line")), 1, 4), 16, 10).cast("int") % 4 == 0)


class Model:
    """Weights of n-grams for each family, relative to unknown, and the temperature."""

    def __init__(self, families: list[str], vocabulary: list[str], weights: list[list[float]], intercepts: list[float], temperature: float) -> None:
        unknown = families.index(UNKNOWN)
        self.families = [f for f in families if f != UNKNOWN]
        keep = [k for k in range(len(families)) if k != unknown]
        self.intercepts = [intercepts[k] - intercepts[unknown] for k in keep]
        rows = [[weights[k][j] - weights[unknown][j] for k in keep] for j in range(len(vocabulary))]
        self.weights = {g: w for g, w in zip(vocabulary, rows) if any(w)}
        self.temperature = temperature

    def anchors(self) -> list[str]:
        """N-grams one of which a window must have: without them, no family's positive weights reach its distance to unknown."""
        rest, chosen = dict(self.weights), []
        for k, intercept in enumerate(self.intercepts):
            while sum(max(0.0, w[k]) for w in rest.values()) + intercept >= 0:
                best = max(sorted(rest), key=lambda g: rest[g][k], default=None)
                if best is None or rest[best][k] <= 0:
                    raise ValueError("unknown isn't the answer for a line without features")
                chosen.append(best)
                del rest[best]
        return chosen

    def logits(self, found: Column) -> Column:
        """An array of the families' logits (unknown: 0) for an array of n-grams: the weights of those that the model knows are looked up and added."""
        # Literals, so that they are made once and not for each row.
        known = F.from_json(F.lit(json.dumps(sorted(self.weights))), "array<string>")
        weights = F.from_json(F.lit(json.dumps(self.weights)), "map<string,array<double>>")
        zero = F.array(*map(F.lit, map(float, self.intercepts)))
        return F.aggregate(F.array_intersect(found, known), zero, lambda acc, x: F.zip_with(acc, weights[x], lambda a, b: a + b))


def fitted(rows: DataFrame, families: list[str], vocabulary: list[str], rules: LicenceRules, steps: int = 60) -> Model:
    """A model of the families for rows (features, grams, family)."""
    from pyspark.ml.classification import LogisticRegression

    place = F.create_map(*[x for k, f in enumerate(families) for x in (F.lit(f), F.lit(float(k)))])
    fit = LogisticRegression(family="multinomial", maxIter=steps, regParam=rules.penalty, elasticNetParam=1.0, standardization=False).fit(rows.withColumn("label", place[F.col("family")]))
    return Model(families, vocabulary, fit.coefficientMatrix.toArray().tolist(), list(fit.interceptVector), 1.0)


def trained(spark: SparkSession, documents: DataFrame, rules: LicenceRules) -> tuple[Model, float]:
    """The model and the confidence that it takes. The model's size is bounded by the templates; training rows by rules.negatives."""
    from pyspark.ml.feature import CountVectorizerModel

    families = [*sorted(TEMPLATES), UNKNOWN]
    vocabulary = sorted({g for notices in TEMPLATES.values() for n in notices for g in grams_of(words_of(n)) if not set(g.split()) <= COMMON and g not in SHORT})
    known = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    given = training_rows(spark, documents, rules).withColumn("grams", grams(F.col("line"))).select("held_out", "grams", "family")
    rows = known.transform(given).coalesce(1).cache()  # some thousands of rows, by the rules
    model = fitted(rows.where("not held_out"), families, vocabulary, rules)
    scored = [told(rows.where("held_out"), model, F.col("family"))]
    for out in KIN:
        part = fitted(rows.where("not held_out").where(~F.col("family").isin(*out)), [f for f in families if f not in out], vocabulary, rules, 30)
        scored.append(told(rows.where(F.col("family").isin(*out)), part, F.lit(UNKNOWN)))  # to this model they are unknown
    model.temperature, confidence = calibrated(scored[0], scored[1:], rules)
    rows.unpersist()
    return model, confidence


def told(rows: DataFrame, model: Model, family: Column) -> list[tuple[list[float], int]]:
    """The logits (unknown: 0, at the end) and the place of the right answer, of training rows."""
    at = F.create_map(*[x for k, f in enumerate([*model.families, UNKNOWN]) for x in (F.lit(f), F.lit(k))])
    return [(list(r["z"]), r["own"]) for r in rows.select(F.concat(model.logits(F.col("grams")), F.array(F.lit(0.0))).alias("z"), at[family].alias("own")).collect()]


def calibrated(own: list, strange: list[list], rules: LicenceRules) -> tuple[float, float]:
    """The temperature under which held-out rows, of known and of unknown families, are likeliest, and the confidence that it takes."""
    import math

    def chances(z: list[float], t: float) -> list[float]:
        top = max(z)
        e = [math.exp((x - top) / t) for x in z]
        return [x / sum(e) for x in e]

    every = [*own, *(x for rows in strange for x in rows)]
    loss = lambda t: -sum(math.log(max(chances(z, t)[k], 1e-300)) for z, k in every)
    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    best = sorted((max(chances(z, temperature)[:-1]) for rows in strange for z, _ in rows), reverse=True)
    passing = best[int(rules.false_share * len(best))] if best else 0.0
    return temperature, min(max(rules.confidence, passing), 0.9)


#: What begins or ends a line of a comment.
MARKS = r"(?m)^[ \t\r#/*;%!<>|-]+|[ \t\r*/>-]+$"


def paragraphs(text: Column) -> Column:
    """The runs of lines that aren't blank, as arrays of lines without comment marks."""
    return F.transform(F.split(F.regexp_replace(text, MARKS, ""), "\n\n+"), lambda x: F.split(x, "\n"))


def scanned(documents: DataFrame, keys: list[str], rules: LicenceRules | None = None) -> DataFrame:
    """keys and `found`: the licence windows of each document in order, with family and probability. Nothing is shuffled."""
    rules = rules or LicenceRules()
    model, confidence = trained(documents.sparkSession, documents, rules)
    anchors = F.from_json(F.lit(json.dumps(sorted(model.anchors()))), "array<string>")
    # A text without the rarest word of any anchor has none; that is quickly seen, and few texts are left.
    rarest = {max(a.split(), key=lambda w: (w not in COMMON, w not in SHORT, len(w))) for a in model.anchors()}
    words = F.from_json(F.lit(json.dumps(sorted(rarest))), "array<string>")
    p = clear(documents)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<array<string>>")
    some = F.when(F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), words), paragraphs(text)).otherwise(none)
    templates = F.from_json(F.lit(json.dumps({f: [sorted(set(words_of(n))) for n in ns] for f, ns in TEMPLATES.items()})), "map<string,array<array<string>>>")
    names = F.array(*map(F.lit, model.families))
    own_words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"), 1))

    def judged(window: Column, z: Column) -> Column:
        best = F.array_max(z)
        family = F.get(names, F.array_position(z, best).cast("int") - 1)
        share = lambda words: F.array_max(F.transform(templates[family], lambda t: F.size(F.array_intersect(t, words)) / F.size(t)))
        return F.struct(
            family.alias("family"), (F.exp(best) / (F.exp(F.lit(0.0)) + F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x)))).alias("probability"),
            let(own_words(window["text"]), share).alias("share"), window["at"].alias("at"), window["n"].alias("n"), window["text"].alias("paragraph"),
        )

    def classified(window: Column) -> Column:
        cooled = lambda own: F.transform(model.logits(own), lambda x: x / model.temperature)
        return let(grams(window["text"]), lambda own: let(cooled(own), lambda z: judged(window, z)))

    def windows(lines: Column) -> Column:
        """Windows (at, n, text) of a paragraph's lines with an anchor in them: those of every length that hold the anchor's line."""
        # An n-gram may go over the end of its line.
        beside = lambda k: F.concat(F.get(lines, k), F.lit(" "), F.regexp_extract(F.lower(F.coalesce(F.get(lines, k + 1), F.lit(""))), WORD, 0))
        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.arrays_overlap(grams(beside(k)), anchors))
        spans = F.flatten(F.transform(at, lambda k: F.flatten(F.transform(
            F.sequence(F.lit(1), F.lit(WINDOW)), lambda n: F.transform(F.sequence(F.greatest(k - n + 1, F.lit(0)), k), lambda s: F.struct(s.alias("at"), n.alias("n")))))))
        # The same in steps of `several` lines, cut at the paragraph's ends.
        n_words = F.aggregate(lines, F.lit(0), lambda n, x: n + F.regexp_count(F.lower(x), F.lit(WORD)))
        several = F.least(F.lit(LINE_WORDS), F.ceil(F.size(lines) * F.lit(float(LINE_WORDS)) / F.greatest(n_words, F.lit(1)))).cast("int")
        cut = lambda s, n: let(F.greatest(s, F.lit(0)), lambda a: F.struct(a.alias("at"), (F.least(s + n, F.size(lines)) - a).alias("n")))
        wide = let(several, lambda g: F.flatten(F.transform(at, lambda k: F.flatten(F.transform(
            F.sequence(F.lit(1), F.lit(WINDOW)), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda m: cut(k - m * g, n * g)))))))
        spans = F.when(several > 1, F.concat(spans, wide)).otherwise(spans)
        inside = F.filter(F.array_distinct(spans), lambda x: x["at"] + x["n"] <= F.size(lines))
        return F.transform(inside, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice(lines, x["at"] + 1, x["n"]), " ").alias("text")))

    def chosen(judgements: Column) -> Column:
        """The confirmed windows of a paragraph, none overlapping a better one, in order."""
        good = F.filter(judgements, lambda x: (x["probability"] >= confidence) & (x["share"] >= rules.confirm))
        ranked = F.array_sort(F.transform(good, lambda x: F.struct((-x["share"]).alias("r"), (-x["probability"]).alias("q"), x["n"].alias("n"), x["at"].alias("at"), x.alias("x"))))
        apart = lambda kept, x: ~F.exists(kept, lambda y: (y["at"] < x["at"] + x["n"]) & (x["at"] < y["at"] + y["n"]))
        zero = F.slice(ranked, 1, 0)
        kept = F.aggregate(ranked, zero, lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
        return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["x"].alias("x")))), lambda x: F.struct(x["x"]["family"].alias("family"), x["x"]["probability"].alias("probability"), x["x"]["paragraph"].alias("paragraph")))

    few = documents.select(*keys, some.alias(f"{p}lines"))
    each = F.transform(f"{p}lines", lambda lines: let(F.transform(windows(lines), classified), chosen))
    return few.select(*[k for k in keys if k != "found"], F.flatten(each).alias("found"))


def op8_licence_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, families (distinct, by name, comma-joined), n_paragraphs, probability (the least) of every document."""
    found = scanned(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
        F.size("found").cast("long").alias("n_paragraphs"), F.array_min(F.transform("found", lambda x: x["probability"])).alias("probability"),
    )
