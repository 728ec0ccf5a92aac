"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A notice is looked for in every line and in every run of lines without a blank line between, as
far as the longest template reaches, as notices are wrapped; signs of comments are no words. A
run's features are the word 1- and 2-grams that occur in ``TEMPLATES``. Multinomial logistic regression over the licence families and an unknown class is
trained on cuttings of the templates, alone and between words of the corpus, and on paragraphs of
a bounded sample of documents as unknown ones; its probabilities are calibrated on a part that the
fit did not see. A predicted family counts if one of its templates is found in the run.

The scan itself is one narrow stage of Spark expressions. A run in which no family can reach the
unknown class, whatever its score, is left after one sum. Of the few that are found, those of one
document meet, and a notice keeps the shortest run that has all of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_guard.functions import text as tx
from corpus_guard.llm.shared import cutoff, lottery, table

UNKNOWN = "unknown"
TEMPLATES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "SPDX-License-Identifier: Apache",
        "Licensed under the Apache License",
        "Apache License, Version",
        "Apache License 2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "The MIT License",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Licensed under the 3-Clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD",
        "Licensed under the 2-Clause BSD License",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL",
        "GNU General Public License",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3",
        "it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL",
        "GNU Lesser General Public License",
        "GNU Library General Public License",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "SPDX-License-Identifier: MPL",
        "Mozilla Public License",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY",
        "Licensed under CC BY",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License",
        "SPDX-License-Identifier: CC-BY-SA",
        "Licensed under CC BY-SA",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License",
        "SPDX-License-Identifier: CC-BY-NC",
        "Licensed under CC BY-NC",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights",
        "Dedicated to the public domain under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0",
        "CC0 1.0 Universal",
    ),
    "reserved": (
        "All rights reserved. No part of this publication may be reproduced or distributed without "
        "prior written permission of the publisher",
        "All rights reserved",
    ),
}


@dataclass(frozen=True)
class Scan:
    """``sample``: documents whose paragraphs stand for the unknown class. ``slots``: places that
    grams are hashed to. ``least``: probability a family needs. ``similar``: share of a template's
    2-grams that must be in the paragraph."""

    sample: int = 300
    cuttings: int = 40
    slots: int = 1 << 15
    least: float = 0.5
    similar: float = 0.7
    seed: int = 5


SCAN = Scan()
#: What stands between words: ASCII characters that are neither letter nor digit.
_BETWEEN = r"[\x00-/:-@\[-`{-\x7f]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.lower()) if w]


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def paragraphs(text: str | None) -> list[str]:
    return [p for p in re.split(r"[\r\n]+", text or "") if p.strip()]


#: Words of the longest template: no template that begins in a line reaches further behind it.
_REACH = max(len(_words(t)) for own in TEMPLATES.values() for t in own)
_LINE = r"\r\n?|\n"


def runs(text: str | None):
    """The numbers, among the lines that are not blank, of the first and last line of every run, and
    its words. A run of several lines begins and ends in what can be a part of a template."""
    pairs = {p for own in TEMPLATES.values() for t in own for p in _pairs(_words(t))}
    single = {w for own in TEMPLATES.values() for t in own for w in _words(t)}
    lines = [(at, _words(line)) for at, line in enumerate(re.split(_LINE, text or "")) if line.strip()]
    part = [bool(pairs & _pairs(words)) for _, words in lines]
    for first, (at, words) in enumerate(lines):
        yield first, first, words
        if not words or not (part[first] or words[-1] in single):
            continue
        behind, own = 0, words
        for last in range(first + 1, len(lines)):
            more = lines[last][1]
            if lines[last][0] != at + last - first or not more or behind >= _REACH - 1:
                break
            behind, own = behind + len(more), own + more
            if part[last] or more[0] in single:
                yield first, last, own


def _unknown(text: str, scan: Scan) -> list[str]:
    """The lines that are not part of a run with a template."""
    lines, taken = paragraphs(text), set()
    templates = [_pairs(_words(t)) for own in TEMPLATES.values() for t in own]
    for first, last, words in runs(text):
        own = _pairs(words) if last > first else set()
        if any(len(t & own) >= scan.similar * len(t) for t in templates):
            taken.update(range(first, last + 1))
    return [line for i, line in enumerate(lines) if i not in taken]


@dataclass
class Model:
    """``weights``: per class and gram, the unknown class last; ``grams`` in the same order."""

    families: list[str]
    grams: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, words: list[str]) -> np.ndarray:
        own = _grams(words)
        score = self.bias + self.weights[:, [g in own for g in self.grams]].sum(axis=1)
        score = np.exp(score - score.max())
        return score / score.sum()


def _descent(x, y, classes: int, steps: int = 200, penalty: float = 1e-3, rate: float = 2.0):
    weights, bias = np.zeros((classes, x.shape[1])), np.zeros(classes)
    target = np.eye(classes)[y]
    for _ in range(steps):
        score = x @ weights.T + bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
        weights -= rate * (error.T @ x + penalty * weights)
        bias -= rate * error.sum(axis=0)
    return weights, bias


def train(unknown: list[str], scan: Scan = SCAN) -> Model:
    """``unknown``: paragraphs of the corpus; those that hold a template are left out."""
    draw = np.random.default_rng(scan.seed)
    families = list(TEMPLATES)
    templates = [(i, _words(t)) for i, name in enumerate(families) for t in TEMPLATES[name]]
    grams = sorted(set().union(*(_grams(words) for _, words in templates)))
    place = {g: i for i, g in enumerate(grams)}
    others = [_words(p) for p in unknown]
    others = [
        w for w in others if w and all(len(_pairs(t) & _pairs(w)) < scan.similar * len(_pairs(t)) for _, t in templates)
    ]
    filler = [w for words in others for w in words] or ["a"]
    rows = [(len(families), words) for words in others]
    for family, words in templates:
        for _ in range(scan.cuttings):
            size = int(np.ceil(len(words) * draw.uniform(scan.similar, 1)))
            at = draw.integers(len(words) - size + 1)
            own = _pairs(words[at : at + size])
            if any(i != family and _pairs(t) <= own for i, t in templates):
                at, size = 0, len(words)  # what is left would be another family's template
            around = draw.integers(0, 12, 2) * draw.integers(0, 2, 2)
            before, after = ([filler[i] for i in draw.integers(len(filler), size=n)] for n in around)
            rows.append((family, before + words[at : at + size] + after))
    rows += [(len(families), words[:n]) for n, words in zip(range(3 * scan.cuttings), [[], *others])]
    rows += [(len(families), [])] * scan.cuttings  # paragraphs without any of the grams
    x, y = np.zeros((len(rows), len(grams))), np.array([label for label, _ in rows])
    for i, (_, words) in enumerate(rows):
        x[i, [place[g] for g in _grams(words) if g in place]] = 1
    held = draw.random(len(rows)) < 0.2
    weights, bias = _descent(x[~held], y[~held], len(families) + 1)
    # one factor for all scores, the best on the part held back
    score = x[held] @ weights.T + bias
    best, scale = np.inf, 1.0
    for factor in np.geomspace(0.25, 8, 41):
        z = factor * score
        loss = np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1)
        loss = (loss - z[np.arange(len(z)), y[held]]).mean() if held.any() else np.inf
        if loss < best:
            best, scale = loss, float(factor)
    return Model(families, grams, scale * weights, scale * bias)


def fit(docs: DataFrame, scan: Scan = SCAN) -> Model:
    """The unknown class is learnt from the ``scan.sample`` documents of smallest hash of doc_id."""
    rows = docs.select("doc_id", "text").where("text IS NOT NULL")
    ids = rows.select("doc_id").where(lottery("doc_id") < cutoff(docs.count(), scan.sample))
    picked = ids.orderBy(lottery("doc_id"), "doc_id").limit(scan.sample).distinct()
    # bounded by scan.sample ids
    rows = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = [r.text for r in rows.orderBy("doc_id").collect()]
    return train([p for text in texts for p in _unknown(text, scan)], scan)


def _constant(values, kind: str) -> str:
    """An array that is made once, when the plan is optimised."""
    return f"CAST(split('{','.join(map(str, values))}', ',') AS ARRAY<{kind}>)"


def _total(numbers: str, start: float, weights) -> str:
    """The sum of the weights of gram numbers, which count from 1."""
    values = _constant([0.0, *(float(w) for w in weights)], "double")
    return f"aggregate({numbers}, CAST({start!r} AS DOUBLE), (s, n) -> s + element_at({values}, n + 1))"


def _found_in(words: str, number: str, body: str) -> str:
    """``body`` with pairs (hashes of the 2-grams), numbers (of the words, then of the 2-grams, 0 for
    unknown ones) and found (those of the known grams). ``number`` holds large constants, so it stands here once."""
    numbers = f"transform(concat(transform(words, w -> xxhash64(w)), pairs), h -> {number})"
    pairs = """zip_with(slice(words, 1, greatest(size(words) - 1, 0)),
        slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> xxhash64(a, b))"""
    body = tx.let("found", "array_distinct(filter(numbers, n -> n > 0))", body)
    return tx.let("words", words, tx.let("pairs", pairs, tx.let("numbers", numbers, body)))


def scanned(docs: DataFrame, model: Model, scan: Scan = SCAN) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, lines of every notice.

    paragraph is the number of the notice's first line among the text's lines that are not blank,
    from 0, and lines how many it has. Null and empty texts have no rows. Repeated rows give
    repeated results. Of equally probable families the first of ``TEMPLATES`` is taken. Further
    columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    hashes, size = _hashes(spark, model.grams), scan.slots
    while len({h % size for h in hashes}) < len(hashes):
        size += 1  # a slot holds one gram
    numbers = np.zeros(size, int)
    for number, h in enumerate(hashes, 1):
        numbers[h % size] = number
    # what each gram can add, at most, to the lead of any family over the unknown class
    lead = np.maximum((model.weights[:-1] - model.weights[-1]).max(axis=0), 0)
    lead_bias = float((model.bias[:-1] - model.bias[-1]).max())
    number = tx.let(
        "m",
        f"element_at({_constant(numbers, 'int')}, CAST(pmod(h, {size}) AS INT) + 1)",
        f"IF(element_at({_constant([0, *hashes], 'bigint')}, m + 1) = h, m, 0)",
    )
    reaches = f"{_total('found', lead_bias, lead)} >= 0"
    is_pair = _constant([int(" " in g) for g in model.grams], "int")

    def words(text: str) -> str:
        return f"filter(split(lower({text}), {tx.sql_string(_BETWEEN)}), w -> w <> '')"

    # at: the line's number with the blank ones; head and tail: whether a template can begin or end
    facts = f"""named_struct('at', at, 'line', line, 'n', size(words), 'alone', {reaches},
        'head', size(words) > 0 AND (part OR get(numbers, size(words) - 1) > 0),
        'tail', size(words) > 0 AND (part OR get(numbers, 0) > 0))"""
    facts = tx.let("part", f"exists(found, n -> element_at({is_pair}, n) = 1)", facts)
    facts = _found_in(words("line"), number, facts)
    lines = f"filter(transform(split(text, {tx.sql_string(_LINE)}, -1), (line, at) -> struct(line, at)), p -> trim(p.line) <> '')"
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.expr(lines).alias("lines"))
    facts = f"transform(lines, p -> {tx.let('line', 'p.line', tx.let('at', 'p.at', facts))})"
    rows = rows.select("doc_id", "row", F.expr(facts).alias("parts"))
    # the last lines, from 0, of the runs of several lines that begin in line i
    ends = f"""aggregate(
        slice(parts, i + 2, {_REACH}),
        named_struct('open', true, 'behind', 0, 'last', i, 'ends', CAST(array() AS ARRAY<INT>)),
        (s, q) -> {tx.let(
            'ok',
            f"s.open AND q.n > 0 AND s.behind < {_REACH - 1} AND q.at = parts[i].at + s.last + 1 - i",
            "named_struct('open', ok, 'behind', s.behind + q.n, 'last', s.last + 1,"
            " 'ends', IF(ok AND q.tail, concat(s.ends, array(s.last + 1)), s.ends))",
        )},
        s -> s.ends)"""
    places = f"""flatten(transform(parts, (p, i) -> transform(
        concat(IF(p.alone, array(i), array()), IF(p.head, {ends}, array())),
        e -> named_struct('paragraph', i, 'last', e,
            'run', array_join(transform(slice(parts, i + 1, e - i + 1), q -> q.line), '\n')))))"""
    rows = rows.select("doc_id", "row", F.inline(F.expr(places)))
    # an array of one run or none, so that all of it, weights too, is evaluated and stands in the plan once
    scores = ", ".join(_total("found", float(b), w) for b, w in zip(model.bias, model.weights))
    hit = f"IF({reaches}, array(named_struct('pairs', pairs, 'scores', array({scores}))), array())"
    hit = _found_in(words("run"), number, hit)
    rows = rows.select("doc_id", "row", "paragraph", "last", F.inline(F.expr(hit)))

    rows = rows.withColumn("best", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    rows = rows.withColumn("probability", 1 / total).withColumn("class", F.array_position("scores", F.col("best")))
    rows = rows.where((F.col("class") <= len(model.families)) & (F.col("probability") >= scan.least))
    family = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.col("class").cast("int"))
    shares = F.lit(None)
    for c, name in enumerate(model.families, 1):
        own = F.array(*[_share(words) for words in map(_words, TEMPLATES[name])])
        shares = F.when(F.col("class") == c, own).otherwise(shares)
    rows = rows.withColumn("shares", F.filter(shares, lambda x: x.similarity >= scan.similar)).where("size(shares) > 0")
    # common: 2-grams of the template of which the run has most
    rows = rows.withColumns(
        {x: F.array_max(F.transform("shares", lambda s: s[x])) for x in ("similarity", "common")}
    )
    found = ["paragraph", "last", family.alias("family"), "probability", "similarity", "common"]
    rows = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct(*found))).alias("hits"))
    # other runs of the family around a run, in a list sorted by first line: a run has at most _REACH lines
    near = f"slice(hits, greatest(1, i + 1 - {_REACH**2}), {2 * _REACH**2 + 1})"
    inside = "o.family = h.family AND o.paragraph >= h.paragraph AND o.last <= h.last AND o.last - o.paragraph < h.last - h.paragraph"
    around = "o.family = h.family AND o.paragraph <= h.paragraph AND o.last >= h.last AND o.last - o.paragraph > h.last - h.paragraph"
    for other in (f"{inside} AND o.common >= h.common", f"{around} AND o.common > h.common"):
        rows = rows.withColumn("hits", F.expr(f"filter(hits, (h, i) -> NOT exists({near}, o -> {other}))"))
    lines = (F.col("last") - F.col("paragraph") + 1).alias("lines")
    return rows.select("doc_id", F.inline("hits")).select("doc_id", "paragraph", "family", "probability", "similarity", lines)


def _share(words: list[str]) -> Column:
    """The share and number of the template's 2-grams that the run has."""
    template = F.array_distinct(F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in zip(words, words[1:])]))
    common = F.size(F.array_intersect(template, "pairs"))
    return F.struct((common / F.size(template)).alias("similarity"), common.alias("common"))


def _hashes(spark: SparkSession, grams: list[str]) -> list[int]:
    rows = spark.createDataFrame([(i, g.split(" ")) for i, g in enumerate(grams)], "i int, words array<string>")
    hashed = F.when(F.size("words") == 1, F.xxhash64(F.get("words", F.lit(0)))).otherwise(
        F.xxhash64(F.get("words", F.lit(0)), F.get("words", F.lit(1)))
    )
    return [r.hash for r in rows.select("i", hashed.alias("hash")).orderBy("i").collect()]


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, fit(docs))
