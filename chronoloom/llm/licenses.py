"""License scans (operator 4, native): trained paragraph classifier.

A softmax regression over sparse word n-grams is fit on fixed licence notices, disturbed copies of them, and sentences
of other kinds; an L1 penalty leaves weights on the n-grams that tell, some hundreds. Every text is cut into words and
its n-grams are looked up among them; where none has a weight, the score is the bias, which is the unknown class. The
others are scored line by line, by runs of lines and by whole paragraphs. The temperature that calibrates the scores is
fit on notices left out of training. A family counts when its probability is high enough and a comparison with the
family's templates confirms it.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rows

#: Notices of public licences, by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "Copyright (c) 2020 the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder.",
        "All rights reserved.",
    ),
}
#: Names of licences, and sentences that hold one; each name in each sentence is a template, too.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "BSD": ("the BSD License", "the BSD 3-Clause License"),
    "CC-BY": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0": ("CC0 1.0 Universal", "the CC0 1.0 Universal Public Domain Dedication"),
    "GPL": ("the GNU General Public License, version 3", "the GNU GPL, version 2"),
    "LGPL": ("the GNU Lesser General Public License, version 3", "the GNU LGPL, version 2.1"),
    "MIT": ("the MIT License", "the terms of the MIT License"),
    "MPL": ("the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0"),
}
FRAMES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is released under {}, see the file LICENSE.", "Published under {} by its authors.")


def templates(family: str) -> tuple[str, ...]:
    return TEMPLATES[family] + tuple(f.format(n) for f in FRAMES for n in NAMES.get(family, ()))


#: Sentences of the unknown class: words of notices in other places, then prose of other kinds and languages.
OTHERS = (
    "The driver needs a license to drive a car in this country.",
    "Poetic license lets the author change the order of events.",
    "A fishing license costs ten dollars and is valid for one year.",
    "Copyright law protects authors for many years after their death.",
    "He asked the teacher for permission to leave the room early.",
    "The warranty of the washing machine ends after two years.",
    "Civil rights and human rights are taught in every school.",
    "The bar lost its license after the police came twice.",
    "They discussed the license, the version, the terms and the public.",
    "The apache helicopter and its crew had permission to land.",
    "Creative work is a public good, and so is a general education.",
    "The redistribution of income was the subject of the debate.",
    "A licensed doctor must sign the form.",
    "The commons were open to all villagers by ancient rights.",
    "You need a software license key to start the program.",
    "The library is free for members, and the books are free of charge for students.",
    "This work was published by a small foundation in the north of the country.",
    "The source of the river lies in the mountains, and its form changes with the season.",
    "You should have received a letter with a copy of the contract.",
    "The software stores files and documentation on the disk without any compression.",
    "Any person may obtain a copy of the map at the office.",
    "The general public may use the park from nine to six, with or without a dog.",
    "The conditions of work in the mine were bad, and the following years brought no change.",
    "He agreed in writing to sell the house and to redistribute the money.",
    "The license fee is paid either by the publisher or by the state, at the option of the state.",
    "Version three of the program is the first that runs on this computer.",
    "The article is about the history of copyright, licenses and public domain works.",
    "The author has written a book about law and the related rights of neighbors.",
    "The table was reserved for ten people, and all seats were taken.",
    "The notice at the door said that the shop was closed.",
    "The university of the city is known for its work on computer programs.",
    "The international conference was open to the public, and the talks are free to read.",
    "Attribution of the painting to the young master is in dispute.",
    "The company sells commercial and noncommercial products under the same name.",
    "The list of conditions was long, and the disclaimer stood at the end.",
    "The quick brown fox jumps over the lazy dog and runs into the forest.",
    "It was a cold day in winter, and the children were at home with their mother.",
    "She opened the window, looked at the street and waited for the bus to come.",
    "In the morning the market is full of people who buy fruit, fish and bread.",
    "The results of the experiment are shown in the second table of this report.",
    "We use a simple method to measure the speed of light in water and in glass.",
    "The function returns the number of items in the list or zero if it is empty.",
    "Click on the button to open the file, then save the file under a new name.",
    "The team won the last game of the season by two points in front of its own fans.",
    "Prices rose by four percent in May, which is more than the bank had expected.",
    "Add the flour and the sugar, stir until smooth, and bake for forty minutes.",
    "The president of the republic met the ministers to speak about the new budget.",
    "To be or not to be is the question that every student of the theatre knows.",
    "There is no such thing as a free lunch, as the saying goes among economists.",
    "If you have any question about your order, please write to us at this address.",
    "Der Verein hat seine Lizenz f\u00fcr die zweite Liga verloren und sucht nun neue Spieler.",
    "Die Kinder gehen am Morgen in die Schule und kommen am Mittag nach Hause.",
    "Das Urheberrecht sch\u00fctzt die Werke der Autoren noch lange nach ihrem Tod.",
    "Wir haben gestern mit den Nachbarn im Garten gegessen und viel gelacht.",
    "Le conducteur doit avoir un permis pour conduire cette voiture dans la ville.",
    "Les enfants jouent dans le jardin pendant que leur m\u00e8re lit un livre.",
    "Le droit d'auteur prot\u00e8ge les \u0153uvres de l'esprit pendant de longues ann\u00e9es.",
    "La maison est grande et le chien dort devant la porte tous les soirs.",
    "El conductor necesita una licencia para manejar el coche en la ciudad.",
    "Los ni\u00f1os van a la escuela por la ma\u00f1ana y vuelven a casa por la tarde.",
    "La empresa perdi\u00f3 la licencia despu\u00e9s de una larga disputa con el estado.",
    "El libro cuenta la historia de un viejo pescador y de su barco en el mar.",
)
UNKNOWN = "unknown"
MIN_PROBABILITY = 0.6
#: Share of a template's word pairs that a confirmed paragraph holds.
MIN_TEMPLATE = 0.6
TOKEN = r"[^a-z0-9]+"
#: Lines that one notice may be wrapped over; a whole paragraph is tried as well.
RUNS = (1, 2, 3, 4, 5, 6, 7, 8)
#: White space, comment marks and comment words at the start of a line; a line of nothing else is blank.
MARKS = r"(?md)^[^\p{L}\p{N}\n]*(?:(?:rem|REM|dnl)(?![\p{L}\p{N}]))?[^\p{L}\p{N}\n]*"
#: A comment word at the start of a line: it would stand between the words of a wrapped notice.
COMMENT = r"(?md)^[^\p{L}\p{N}\n]*(?:rem|REM|dnl)(?![\p{L}\p{N}])"
#: A copyright line in normal form, and what stands for any year and holder.
HOLDER = r"(?<![a-z0-9])(?:copyright (?:c |copy )?|(?:c|copy) (?=[0-9]{4} ))(?:[a-z0-9]+ ){0,20}?all rights reserved(?![a-z0-9])"
ANY_HOLDER = "copyright c 2020 the authors all rights reserved"
#: Texts with an n-gram of the model up to which their results are broadcast; more are joined by a shuffle.
BROADCAST_TEXTS = 200_000
#: Weight of the L1 penalty, steps of its descent, and groups of notices that are left out in turn.
PENALTY, ROUNDS, FOLDS = 1.5e-3, 120, 3
#: Sentences of the unknown class in which an n-gram may occur to be a feature, and rows that it must occur in.
MAX_OTHERS, MIN_ROWS = 1, 4


def tokens(paragraph: str) -> list[str]:
    import re

    words = [w for w in re.split(TOKEN, "".join(c.lower() if c.isascii() else c for c in paragraph)) if w]
    return re.sub(HOLDER, ANY_HOLDER, " ".join(words)).split()


def normal(paragraph: Column) -> Column:
    """The tokens of a paragraph, joined by spaces."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(paragraph), TOKEN, " ")), HOLDER, ANY_HOLDER)


def runs(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def grams(words: list[str]) -> list[str]:
    """Words, and runs of two and three words."""
    return [g for n in (1, 2, 3) for g in runs(words, n)]


def pairs(words: list[str]) -> set[str]:
    return set(runs(words, 2))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(x: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal descent on the logistic loss with an L1 penalty on the weights (not on the biases)."""
    step = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + 0.5)
    w, b = np.zeros((x.shape[1], one.shape[1]), x.dtype), np.zeros(one.shape[1], x.dtype)
    v, c, t = w, b, 1.0
    for _ in range(ROUNDS):
        error = (_softmax(x @ v + c) - one) / len(x)
        new = v - step * (x.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        bias = c - step * error.sum(axis=0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (last - 1) / t * (new - w), bias + (last - 1) / t * (bias - b)
        w, b = new, bias
    return w, b


@functools.cache
def _trained(seed: int = 3) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], dict[str, float]]:
    rng = np.random.Generator(np.random.PCG64(seed))
    classes = (UNKNOWN, *sorted(TEMPLATES))
    fillers = "the of and to in is that for with on as it by this an are be from at or".split()
    data: list[tuple[list[str], int, int]] = []  # words, class, group
    seen: dict[str, int] = {}
    common: dict[str, int] = {}
    for c, family in enumerate(classes):
        for g, text in enumerate(templates(family) if c else OTHERS):
            words = tokens(text)
            for w in set(grams(words)) if not c else ():
                common[w] = common.get(w, 0) + 1
            for k in range(6):
                w = [x for x in words if k == 0 or rng.random() > 0.08]
                for _ in range(int(rng.integers(0, 4)) if k else 0):
                    w.insert(int(rng.integers(0, len(w) + 1)), fillers[int(rng.integers(0, len(fillers)))])
                data.append((w, c, g % FOLDS))
            # The words of a notice out of their context are no licence.
            w = [x for x in words if rng.random() < 0.5] + [fillers[int(rng.integers(0, len(fillers)))] for _ in range(8)]
            rng.shuffle(w)
            data.append((w, 0, g % FOLDS))
    for w, c, _ in data:
        for g in set(grams(w)) if c else ():
            seen[g] = seen.get(g, 0) + 1
    index = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= MIN_ROWS and common.get(g, 0) <= MAX_OTHERS and g not in fillers))}
    x = np.zeros((len(data), len(index)), np.float32)
    for i, (w, *_) in enumerate(data):
        for g in set(grams(w)) & index.keys():
            x[i, index[g]] = 1
    y, group = np.array([c for _, c, _ in data]), np.array([g for *_, g in data])
    one = np.eye(len(classes), dtype=np.float32)
    z = np.zeros((len(data), len(classes)))
    for fold in range(FOLDS):
        weight, bias = _descend(x[group != fold], one[y[group != fold]])
        z[group == fold] = x[group == fold] @ weight + bias
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.35, 0.5, 0.6, 0.7, 0.85, 1.0, 1.2, 1.4, 1.7, 2.0, 2.8)}
    t = min(loss, key=loss.get)
    p = _softmax(z / t)
    sure = np.where((p.argmax(axis=1) > 0) & (p.max(axis=1) >= MIN_PROBABILITY), p.argmax(axis=1), 0)
    figures = {"temperature": t, "log_loss": loss[t], "right_families": float((sure == y)[y > 0].mean()), "wrong_families": float(((sure != y) & (sure > 0))[y > 0].mean()), "false_alarms": float((sure > 0)[y == 0].mean())}
    weight, bias = _descend(x, one[y])
    if bias.argmax():
        raise ValueError("without n-grams, the class must be unknown")
    kept = {g: tuple(np.round(weight[i] / t, 6).tolist()) for g, i in index.items() if (np.abs(weight[i]) > 1e-3).any()}
    return classes, kept, tuple(np.round(bias / t, 6).tolist()), figures


def model() -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...]]:
    """Classes, weights by n-gram, biases; weights are already divided by the calibrated temperature.

    Trained here on some thousand disturbed notices and other sentences.
    """
    return _trained()[:3]


def held_out() -> dict[str, float]:
    """Figures over notices and sentences that were left out, whole, of the model that scored them (FOLDS models)."""
    return dict(_trained()[3])


def classify(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(paragraph), distinct and in normal form: adds family, probability, confirmed. Unknown families are left out."""
    spark = paragraphs.sparkSession
    classes, weights, bias = model()
    table = F.broadcast(spark.createDataFrame([(g, list(w)) for g, w in weights.items()], "gram string, w array<double>"))  # n-grams of TEMPLATES
    prints = F.broadcast(spark.createDataFrame([(f, sorted(pairs(tokens(t)))) for f in TEMPLATES for t in templates(f)], "family string, pairs array<string>"))
    seen = paragraphs.withColumn("_w", F.split("paragraph", " "))

    def run(n: int):
        joined = lambda i: F.array_join(F.slice("_w", i, n), " ")
        return F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), joined)).otherwise(F.array().cast("array<string>"))

    seen = seen.withColumns({"_p": run(2), "_q": run(3)})
    gram = F.array_distinct(F.concat("_w", "_p", "_q"))
    logit = [F.lit(bias[c]) + F.sum(F.col("w")[c]) for c in range(len(classes))]
    summed = seen.select("paragraph", F.explode(gram).alias("gram")).join(table, "gram").groupBy("paragraph").agg(*[x.alias(f"z{c}") for c, x in enumerate(logit)])
    top = F.greatest(*[F.col(f"z{c}") for c in range(len(classes))])
    total = functools.reduce(lambda a, b: a + b, [F.exp(F.col(f"z{c}") - F.col("top")) for c in range(len(classes))])
    best = functools.reduce(lambda rest, c: F.when(F.col(f"z{c}") == F.col("top"), F.lit(classes[c])).otherwise(rest), reversed(range(len(classes))), F.lit(UNKNOWN))
    named = summed.withColumn("top", top).select("paragraph", best.alias("family"), F.round(1 / total, 4).alias("probability"))
    named = named.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))
    own = named.join(seen.select("paragraph", "_p"), "paragraph").join(prints, "family")
    share = F.size(F.array_intersect("_p", "pairs")) / F.size("pairs")
    return own.groupBy("paragraph", "family", "probability").agg((F.max(share) >= MIN_TEMPLATE).alias("confirmed"))


def narrowest(runs: DataFrame) -> DataFrame:
    """Runs s to e of lines of _k that hold no other run of their family."""
    before = Window.partitionBy("_k", "family").orderBy("e", F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_s", F.max("s").over(before)).filter(F.col("_s").isNull() | (F.col("_s") < F.col("s"))).drop("_s")


@functools.cache
def reach() -> tuple[float, dict[str, float], dict[str, float]]:
    """What a text's n-grams must add up to for any of its parts to be called a notice: need, and each n-gram's and
    each word's share at most.

    A family is named when its score exceeds that of the unknown class by need; an n-gram adds to the difference what it
    adds to the best family and takes from the unknown class. A word stands for the n-grams in which it is the rarest.
    """
    _, weights, bias = model()
    grams_ = {g: max(0.0, *w[1:]) - min(0.0, w[0]) for g, w in weights.items()}
    seen: dict[str, int] = {}
    for text in OTHERS:
        for w in set(tokens(text)):
            seen[w] = seen.get(w, 0) + 1
    words: dict[str, float] = {}
    for g, x in grams_.items():
        rarest = min(g.split(" "), key=lambda w: (seen.get(w, 0), -len(w), w))
        words[rarest] = words.get(rarest, 0.0) + x
    return bias[0] - max(bias[1:]) + math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY)), grams_, words


def _sum(found: Column, shares: dict[str, float]) -> Column:
    """Sum of the shares of the distinct ones that are among them."""
    names = sorted(shares)
    known = F.split(F.lit(",".join(names)), ",")
    table = F.map_from_arrays(known, F.array(*[F.lit(shares[g]) for g in names]))
    return F.aggregate(F.array_intersect(found, known), F.lit(0.0), lambda a, g: a + F.element_at(table, g))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), TOKEN, -1)


def _most(text: Column) -> Column:
    """At most what the n-grams of the text add up to, by its words alone."""
    return F.coalesce(_sum(_words(text), reach()[2]), F.lit(0.0))


def _bound(text: Column) -> Column:
    """What the n-grams of the text add up to: no part of it can have more."""
    words, shares = _words(text), reach()[1]
    two = lambda a, b: F.concat_ws(" ", a, b)
    shifted = lambda i: F.slice(words, i, F.greatest(F.size(words), F.lit(1)))
    couples = F.zip_with(words, shifted(2), two)
    of = lambda n: {g: x for g, x in shares.items() if g.count(" ") == n - 1} or {"-": 0.0}
    return F.coalesce(_sum(words, of(1)) + _sum(couples, of(2)) + _sum(F.zip_with(couples, shifted(3), two), of(3)), F.lit(0.0))


def scan(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: key, n_candidates, n_licenses, families, license, probability.

    A paragraph is what lies between blank lines; lines of comment marks alone are blank. Every text's n-grams are
    weighed by the model; where they cannot add up to a family's score, in the text, a paragraph or a run, the class is
    unknown. In a paragraph, every line and run of lines (RUNS, and the whole) that is left is classified, so that
    wrapped notices are found. n_candidates counts the lines with an n-gram of the model in paragraphs that are left,
    n_licenses the confirmed runs that share no line with a counted one (earliest ends first, then the shortest), families lists the distinct families of all confirmed runs
    sorted and comma-separated. Of the runs of a family only the narrowest matter, and a run of several lines that
    shares one with a likelier such run of another family is a part of that notice (LGPL without its first words reads
    like GPL); license is the family of the likeliest counted run (ties: by name), or null. Null and empty texts have
    none, an empty table gives none. The result depends on the text alone, so null keys, equal ids and repeated rows
    need no rule; every distinct text and run is classified once. Other columns of df are not carried.
    """
    text_key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    rated = df.select(F.col(key).alias("_id"), text_key.alias("_h"), F.col(text).alias("_text"))
    need = reach()[0]
    worded = F.col("_text").contains("REM") | F.col("_text").contains("rem") | F.col("_text").contains("dnl")
    plain = F.when(worded & F.col("_text").rlike(COMMENT), F.regexp_replace("_text", MARKS, "")).otherwise(F.col("_text"))
    first = rated.filter(_most(F.col("_text")) >= need).filter(_bound(plain) >= need).groupBy("_h").agg(F.first("_text").alias("_text"))
    parts = first.select("_h", F.explode(F.split(F.regexp_replace("_text", MARKS, ""), "\n{2,}")).alias("_t"))
    told = rows.checkpoint(parts.select("_h", F.struct(F.xxhash64("_t").alias("a"), F.xxhash64(F.lit(7), "_t").alias("b")).alias("_k"), F.split("_t", "\n").alias("_lines")))
    size = F.size("_lines")
    # What each line, and each line with the next one, adds up to: a run of several has at most the sum of the latter.
    joint = F.transform("_lines", lambda x, i: _bound(F.concat_ws(" ", x, F.get("_lines", i + 1))))
    marked = told.dropDuplicates(["_k"]).select("_k", "_lines", F.transform("_lines", _bound).alias("_own"), joint.alias("_joint"))
    added = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    marked = rows.checkpoint(marked.filter(added(F.col("_joint")) >= need))

    def spans(n: int):
        every = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: F.struct(s.alias("s"), (s + n - 1).alias("e"))))
        hit = lambda x: F.get("_own", x["s"] - 1) >= need if n == 1 else added(F.slice("_joint", x["s"], F.lit(n - 1))) >= need
        return F.coalesce(F.filter(every, hit), F.array().cast("array<struct<s:int,e:int>>"))

    whole = F.when(size > max(RUNS), F.array(F.struct(F.lit(1).alias("s"), size.alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    run = marked.select("_k", "_lines", F.explode(F.concat(*[spans(n) for n in RUNS], whole)).alias("_x"))
    run = run.select("_k", "_x.s", "_x.e", normal(F.array_join(F.slice("_lines", F.col("_x.s"), F.col("_x.e") - F.col("_x.s") + 1), " ")).alias("paragraph"))
    run = rows.checkpoint(run)
    known = classify(run.select("paragraph").distinct()).filter("confirmed")
    spot = F.struct("e", (-F.col("s")).alias("s"), (-F.col("probability")).alias("p"), "family")
    sure = rows.checkpoint(narrowest(run.join(known, "paragraph").select("_k", "s", "e", "family", "probability")))
    spot = F.struct((-F.col("probability")).alias("p"), "family", "s", "e")
    apart = lambda a, r: F.when(F.exists(a, lambda k: (k["family"] != r["family"]) & (k["s"] <= r["e"]) & (r["s"] <= k["e"])), a).otherwise(F.concat(a, F.array(r)))
    best = sure.groupBy("_k").agg(F.collect_list(F.when(F.col("e") == F.col("s"), spot)).alias("_single"), F.sort_array(F.collect_list(F.when(F.col("e") > F.col("s"), spot))).alias("_several"))
    kept = F.concat("_single", F.aggregate("_several", F.array().cast("array<struct<p:double,family:string,s:int,e:int>>"), apart))
    best = best.select("_k", F.array_sort(F.transform(kept, lambda r: F.struct(r["e"].alias("e"), (-r["s"]).alias("s"), r["p"].alias("p"), r["family"].alias("family")))).alias("_r"))
    free = F.struct(F.lit(0).alias("e"), F.array().cast("array<struct<p:double,family:string>>").alias("got"))
    take = lambda a, r: F.when(-r["s"] > a["e"], F.struct(r["e"].alias("e"), F.concat(a["got"], F.array(F.struct(r["p"].alias("p"), r["family"].alias("family")))).alias("got"))).otherwise(a)
    best = best.select("_k", F.array_distinct(F.transform("_r", lambda r: r["family"])).alias("_f"), F.aggregate("_r", free, take)["got"].alias("_got"))
    own = told.select("_h", "_k").join(marked.select("_k", F.size(F.filter("_own", lambda x: x > 0)).alias("_n")), "_k").join(best, "_k", "left")
    found = own.groupBy("_h").agg(
        F.sum("_n").alias("n_candidates"),
        F.sum(F.when(F.col("_got").isNotNull(), F.size("_got")).otherwise(0)).alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_f")))), ",").alias("families"),
        F.min(F.array_min("_got")).alias("top"),
    )
    found = rows.checkpoint(found)
    if found.count() <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    none = F.lit(0).cast("long")
    return rated.select("_id", "_h").join(found, "_h", "left").select(
        F.col("_id").alias(key), F.coalesce("n_candidates", none).alias("n_candidates"), F.coalesce("n_licenses", none).alias("n_licenses"), F.coalesce("families", F.lit("")).alias("families"), F.col("top.family").alias("license"), (-F.col("top.p")).alias("probability")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(rows.documents(spark, sf_dir))
