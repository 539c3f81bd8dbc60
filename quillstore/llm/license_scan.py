"""Licence scans: a trained paragraph classifier, in DataFrame functions only when it scans.

A sparse multinomial logistic regression over word 1- and 2-grams tells licence
families from an ``unknown`` class.  It is fitted on the driver on a small
built-in table of notices, made by rule from families' names, the usual
phrases and well-known sentences.  Scores are calibrated by a model of three
quarters of its distinct texts on the rest.  A predicted family counts as confirmed
if enough of the paragraph's word 3-grams stand in one of the family's templates;
a paragraph of fewer words is compared as a whole.

A paragraph is a line, with those that follow as long as it does not end like a
sentence (wrapped notices).  Each one that the model could name is scored: one
without any of the words that follow from its weights (``telling_words``) is
unknown.  Scores and comparison come from one pass: one join of all grams with one
table, one group per paragraph.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logistic import fit_softmax, softmax, temperature

UNKNOWN = "unknown"

#: Names under which notices refer to a family.
NAMES = {
    "Apache": ["the Apache License, Version 2.0", "the Apache License", "Apache 2.0", "Apache-2.0", "the Apache Software License"],
    "MIT": ["the MIT License", "the MIT licence", "MIT", "an MIT-style license", "the Expat license"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License", "the GNU GPL", "GPLv2", "GPLv3", "GPL-3.0", "the GPL", "the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["the GNU Lesser General Public License", "LGPL", "LGPL-2.1", "the LGPL version 3", "the GNU Library General Public License"],
    "AGPL": ["the GNU Affero General Public License", "AGPL", "AGPL-3.0", "the AGPLv3"],
    "BSD": ["the BSD License", "the 3-clause BSD license", "the BSD 2-Clause License", "BSD-3-Clause", "a BSD-style license"],
    "MPL": ["the Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0", "the Mozilla Public License"],
    "CC-BY": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution License", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0", "CC BY-SA"],
    "CC-BY-NC": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC"],
    "CC0": ["CC0 1.0 Universal", "the CC0 public domain dedication", "CC0-1.0", "the Creative Commons CC0 license"],
    "ISC": ["the ISC License", "ISC", "the ISC licence"],
    "Proprietary": ["a commercial license agreement", "a proprietary license", "a separate commercial license"],
}

#: The usual phrases around a name.
PHRASES = [
    "Licensed under {}.",
    "Released under {}.",
    "This work is licensed under {}.",
    "This software is licensed under {}.",
    "Distributed under the terms of {}.",
    "This project is available under {}.",
    "The code is published under {}, see the LICENSE file for details.",
    "License: {}",
    "SPDX-License-Identifier: {}",
    "You may use this file under the terms of {}.",
    "Dieses Werk ist lizenziert unter {}.",
    "Ce travail est distribué sous licence {}.",
    "Esta obra está bajo licencia {}.",
]

#: Well-known sentences of licence texts.
SENTENCES = {
    "Apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, users who interact with it remotely over a network"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY": ["You are free to share and adapt the material for any purpose, even commercially, with attribution under a Creative Commons license."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed or transmitted without the prior written permission of the publisher.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}

#: Paragraphs with anchor words that state no licence of a known family.
OTHERS = [
    "He lost his driving licence last year and had to take the bus.", "The restaurant applied for a liquor license in the spring.", "A fishing license is required in this county.",
    "The committee granted permission to build the house.", "Copyright law differs from country to country.", "The warranty covers parts and labour for two years.",
    "She asked for permission to leave early.", "The new licence fee will be collected from January.", "The company licensed the technology to a rival.",
    "Licensing costs rose again this quarter.", "They need a license plate for the trailer.", "The dealer offers an extended warranty on used cars.",
    "Questions of copyright were discussed at the conference.", "Under the terms of the agreement both sides withdrew.", "The book was released under a new title.",
    "The film was distributed under another name in France.", "The museum is open to the public and free of charge.", "This license expires at the end of the month.",
    "The public was dedicated to the cause.", "Published by the foundation in its general report.", "All rights come with duties.", "License",
    "Redistribution of wealth was a subject of the debate.", "A copy of the certificate is attached.", "Public domain is a term that few people know.", "Free software is a matter of liberty.",
]

#: Ordinary paragraphs with words that also stand in names; "mit" is German for "with".
ORDINARY = [
    "Er kam mit dem Zug.", "Mit der Zeit wird es besser.", "Das ist mit uns so.", "Sie ging mit ihm und mit den Kindern nach Hause.", "Mit.", "Es war mit ein Grund.",
    "She studied physics at MIT.", "Researchers at MIT have built a robot.", "The Apache helicopter landed.", "The Apache lived in the south.", "The general public was not invited.",
    "Mozilla released a new version.", "A creative mind is common.", "The universal remote costs 4.0 dollars.", "Version 2.0 is faster than version 1.0.", "Under the terms of the treaty the border was moved.",
    "The report is available under the link below.", "The film was released under pressure.", "A commercial agreement was signed.", "The foundation is free and open to any person.",
    "This is a list of all the things that you may see, or that are of use to you, and any of them may be part of it.", "You must do the work without an answer, as it has no end.", "Any of the following may be included.",
    "It may be that he or she has to be there, and that you see it in the file.", "All of this is part of the work that has to be done by you.", "There are two of them, and a third as well, but no more than that.",
    "A part of it was in use, and the details are above.", "The code of the door is written on a card in the library.", "The source of the river must be in the hills above the village.", "The use of salt is permitted in some of the cases, see the list.",
    "Ce n'est pas une bonne idée, et il est tard.", "La casa está cerca y esta noche es larga.", "Das ist unter dem Tisch, und es ist gut.", "Le chat est sous la table.", "El gato está bajo la mesa.", "Die Kinder sind unter uns.", "Esta es la obra de mi vida.", "Dieses Haus ist alt.",
    "Ce travail est long.", "The project has no name, and the software is not ready.", "They provided all of the food for the international guests.", "The documentation was published in the spring, and copies of it are on the shelf.", "No part of the city was spared.", "The general has rights, and conditions are good.",
]
#: A line break inside a paragraph: the line does not end like a sentence, and the next is not blank.
WRAP = r"(?<=[^.!?:;\s])[ \t]*\r?\n(?=[ \t]*[^\s])"
#: Marks a gram of the comparison.
MARK = "\u0001"
SPLIT = "[^\\p{L}\\p{N}.]+"


def table() -> list[tuple[str, str]]:
    """The labelled paragraphs (family, text)."""
    rows = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES]
    rows += [(f, s) for f, sentences in SENTENCES.items() for s in sentences]
    rows += [r for r in rows if r[1].count(" ") < 3 for _ in range(5)]  # few grams tell these
    return rows + [(UNKNOWN, s) for s in OTHERS + ORDINARY for _ in range(8)]


def python_words(text: str) -> list[str]:
    """The words that the scan's expression gives, for fitting."""
    return [w.strip(".") for w in re.split(r"[^\w.]+|_", text.lower()) if w.strip(".")]


def python_paragraphs(text: str | None) -> list[str]:
    """The paragraphs that the scan's expression gives."""
    return re.sub(WRAP, " ", text or "").split("\n")


def python_grams(words: list[str], sizes=(1, 2)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


@dataclass
class Model:
    families: list
    biases: list
    weights: list  # (gram, family, weight), zero weights left out
    threshold: float
    templates: list  # (family, template, gram)


#: Strength of the penalty that makes the weights sparse.
L1 = 1e-3


def held_out(rows: list[tuple[str, str]]) -> np.ndarray:
    """Every fourth distinct text of a table, with all its repetitions."""
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, t in rows))}
    return np.array([number[t] % 4 == 3 for _, t in rows])


def _regression(rows: list[tuple[str, str]], families: list, train: np.ndarray):
    """(vocabulary, rows as 0/1 vectors, classes, weights, biases) of a regression on the rows marked to train on."""
    grams = [python_grams(python_words(t)) for _, t in rows]
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(g for g, own in zip(grams, train, strict=True) if own))))}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, g in enumerate(grams):
        x[i, [vocabulary[t] for t in g if t in vocabulary]] = 1
    y = np.array([families.index(f) for f, _ in rows])
    return vocabulary, x, y, *fit_softmax(x[train], y[train], len(families), l1=L1, steps=300)


def fit(threshold: float = 0.6, train: np.ndarray | None = None) -> Model:
    """Fit on the table, or on the rows of it marked by ``train``; scores are calibrated on texts that a model like this
    has not seen.

    threshold: least calibrated probability for a family; below it a paragraph is unknown."""
    rows = table() if train is None else [r for r, own in zip(table(), train, strict=True) if own]
    families, held = [*NAMES, UNKNOWN], held_out(rows)
    _, x, y, w, b = _regression(rows, families, ~held)
    t = temperature(x[held] @ w + b, y[held])
    vocabulary, _, _, w, b = _regression(rows, families, np.ones(len(rows), bool))
    w, b = w * t, b * t
    weights = [(g, families[k], float(w[i, k])) for g, i in vocabulary.items() for k in range(len(families)) if abs(w[i, k]) > 1e-6]
    templates = [(f, j, g) for j, (f, s) in enumerate(rows) if f != UNKNOWN for g in sorted(_compared(python_words(s)))]
    return Model(families, b.tolist(), weights, threshold, templates)


def _compared(words: list[str]) -> set[str]:
    """The grams by which a paragraph is compared with templates."""
    return python_grams(words, (3,)) or {" ".join(words)}


def python_similarity(model: Model, text: str, family: str) -> float:
    """The brute-force form of the comparison."""
    own = _compared(python_words(text))
    most: dict[int, int] = {}
    for f, j, g in model.templates:
        most[j] = most.get(j, 0) + (f == family and g in own)
    return max(most.values(), default=0) / len(own)


def python_predict(model: Model, text: str) -> tuple[str, float]:
    """The brute-force form of a prediction."""
    held = python_grams(python_words(text))
    z = np.array(model.biases) + [sum(w for g, k, w in model.weights if k == f and g in held) for f in model.families]
    p = softmax(z[None])[0]
    return model.families[int(p.argmax())], float(p.max())


def telling_words(model: Model) -> list[str]:
    """Words of which every paragraph that the model can name holds one.

    The others are those that, even all together with each gram among them, cannot lift a family above ``unknown``."""
    at = {f: k for k, f in enumerate(model.families)}
    none = at[UNKNOWN]
    room = model.biases[none] - np.array(model.biases)
    room[none] = np.inf
    gain: dict[str, np.ndarray] = {}
    for g, f, w in model.weights:
        gain.setdefault(g, np.zeros(len(at)))[at[f]] = w
    gain = {g: np.maximum(0, w - w[none]) for g, w in gain.items()}
    of: dict[str, set] = {}
    for g in gain:
        for w in g.split(" "):
            of.setdefault(w, set()).add(g)
    weak: set[str] = set()
    total = np.zeros(len(at))
    for word in sorted(of, key=lambda w: (gain[w].max() if w in gain else 0.0, w)):
        more = total + sum((gain[g] for g in of[word] if weak.issuperset(set(g.split(" ")) - {word})), np.zeros(len(at)))
        if (more < room - 1e-6).all():
            weak.add(word)
            total = more
    return sorted(set(of) - weak)


def scan(docs: DataFrame, model: Model | None = None, least_similarity: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph with a licence family: doc_id, paragraph (number from 0), family, probability, similarity
    (largest share of its grams in one template of the family), confirmed and verdict (the family if confirmed, else
    ``unknown``).

    Null and empty texts have no paragraphs; repeated rows are each reported; of families with equal scores the last by
    name is taken; an empty table gives no rows; a very long paragraph is one group of its distinct grams that the
    model knows, so it is bounded by the model.  What is broadcast are the model's own tables, whose size does not
    depend on the data.
    """
    model = model or fit()
    spark: SparkSession = docs.sparkSession
    number = {f: k for k, f in enumerate(model.families)}
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    lines = slim.select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.regexp_replace("text", WRAP, " "), "\n", -1)).alias("paragraph", "line"))
    some = "|".join(re.escape(w) for w in telling_words(model))
    lines = lines.where(F.lower("line").rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{some})(?![\\p{{L}}\\p{{N}}])"))
    words = F.filter(F.transform(F.split(F.lower("line"), SPLIT, -1), lambda x: F.trim(x, F.lit("."))), lambda x: x != "")
    split = lines.select("doc_id", "row", "paragraph", words.alias("words"))

    # One row per gram: a weight per family, and the templates that hold it (numbered within families).  Grams of the
    # comparison are marked, so that they are apart from those of the regression.
    wide: dict[str, list] = {}
    for g, f, w in model.weights:
        wide.setdefault(g, [None] * len(number))[number[f]] = w
    held: dict[str, list] = {}
    for f, j, g in model.templates:
        held.setdefault(MARK + g, []).append(j * len(number) + number[f])
    names = [f"w{k}" for k in range(len(number))]
    known = [(g, *w, None) for g, w in wide.items()] + [(g, *[None] * len(number), t) for g, t in held.items()]
    known = _small(spark, known, "gram string, " + ", ".join(f"{w} double" for w in names) + ", templates array<int>")
    pairs = F.zip_with(F.slice("words", 2, F.size("words")), "words", lambda b, a: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.concat(F.lit(MARK), F.array_join(F.slice("words", i, 3), " ")))
    split = split.select("doc_id", "row", "paragraph", "words", F.array_distinct(spans).alias("spans"))
    # explode_outer, as explode would evaluate the array once more to skip empty ones; a null gram joins nothing.
    grams = split.select("doc_id", "row", "paragraph", F.size("spans").alias("n"), F.explode_outer(F.concat(F.array_distinct(F.concat("words", pairs)), "spans")).alias("gram"))
    got = grams.join(F.broadcast(known), "gram").groupBy("doc_id", "row", "paragraph", "n").agg(*(F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in names), F.flatten(F.collect_list("templates")).alias("t"))
    scores = F.array(*(F.struct((F.col(w) + F.lit(b)).alias("z"), F.lit(f).alias("family"), F.lit(number[f]).alias("k")) for w, f, b in zip(names, model.families, model.biases, strict=True)))
    best = got.select("doc_id", "paragraph", "n", "t", F.array_max(scores).alias("best"), scores.alias("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x["z"] - F.col("best")["z"]))
    named = best.select("doc_id", "paragraph", "n", "t", "best", (1 / total).alias("probability")).where((F.col("best")["family"] != UNKNOWN) & (F.col("probability") >= model.threshold))
    own = F.filter("t", lambda x: x % len(number) == F.col("best")["k"])
    named = named.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "n", F.col("best")["family"].alias("family"), "probability", F.array_sort(own).alias("own"))
    # The length of the longest run of one number.
    runs = F.aggregate("own", F.struct(F.lit(-1).alias("of"), F.lit(0).alias("run"), F.lit(0).alias("most")), lambda s, x: F.struct(x.alias("of"), F.when(x == s["of"], s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["most"], F.when(x == s["of"], s["run"] + 1).otherwise(1)).alias("most")))
    out = named.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), (runs["most"] / F.col("n")).alias("similarity"))
    confirmed = F.col("similarity") >= least_similarity
    return out.select("*", confirmed.alias("confirmed"), F.when(confirmed, F.col("family")).otherwise(UNKNOWN).alias("verdict"))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A model's table as a relation, parsed from one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))
