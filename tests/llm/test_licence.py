import random

from corpus_guard.llm import licence
from corpus_guard.llm.licence import SCAN, TEMPLATES

WORDS = "the of in to be with this work a any and is stone river free use file".split()


def _prose(draw, size):
    return " ".join(draw.choice(WORDS) for _ in range(size))


def _brute(model, rows):
    found = []
    for doc_id, text in rows:
        for number, paragraph in enumerate(licence.paragraphs(text)):
            words = licence._words(paragraph)
            p = model.probabilities(words)
            best = int(p.argmax())
            if best == len(model.families) or p[best] < SCAN.least:
                continue
            own = licence._pairs(words)
            family = model.families[best]
            share = max(len(licence._pairs(t) & own) / len(licence._pairs(t)) for t in map(licence._words, TEMPLATES[family]))
            if share >= SCAN.similar:
                found.append((doc_id, number, family, round(float(p[best]), 6), round(share, 6)))
    return sorted(found, key=str)


def test_scan_is_the_model_and_the_comparison(documents):
    draw = random.Random(1)
    rows, planted = [], {}
    for i in range(120):
        lines = [_prose(draw, draw.randint(1, 40)) for _ in range(draw.randint(1, 5))]
        if i % 3 == 0:
            family = draw.choice(list(TEMPLATES))
            line = draw.choice(TEMPLATES[family])
            at = draw.randrange(len(lines) + 1)
            lines.insert(at, draw.choice([line, line.upper(), f"{_prose(draw, 5)} {line} {_prose(draw, 5)}"]))
            planted[i, at] = family
        rows.append((i, "\n\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n \r\n"), (503, "word"), (None, TEMPLATES["MIT"][0])]
    rows += [(504, _prose(draw, 60_000)), (505, TEMPLATES["GPL"][0]), (505, TEMPLATES["GPL"][0])]
    schema = "doc_id long, text string, words string, found string, family int"
    docs = documents(*rows, schema=schema, defaults=("w", "f", 0))
    model = licence.fit(docs)
    got = licence.scanned(docs, model).collect()
    assert sorted(((r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.similarity, 6)) for r in got), key=str) == _brute(model, rows)
    right = sum(planted.get((r.doc_id, r.paragraph)) == r.family for r in got)
    assert right >= 0.95 * len(planted)
    assert not [r for r in got if r.doc_id is not None and r.doc_id < 500 and (r.doc_id, r.paragraph) not in planted]
    assert licence.scanned(docs.where("false"), licence.fit(docs.where("false"))).collect() == []


def test_calibrated_unknown_class():
    draw = random.Random(4)
    model = licence.train([_prose(draw, 30) for _ in range(300)])
    assert model.probabilities(licence._words(TEMPLATES["MIT"][1]))[:-1].max() > 0.8
    assert model.probabilities([])[-1] > 0.5
    assert model.probabilities("the license of this work is free to use".split())[-1] > 0.2


def test_short_notices_and_other_versions(documents):
    lines = {
        "All rights reserved.": "reserved",
        "Copyright 2020 Stone River. All rights reserved.": "reserved",
        "Licensed under the Apache License, Version 2.0.": "Apache",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL",
        "SPDX-License-Identifier: LGPL-2.1-only": "LGPL",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD",
        "SPDX-License-Identifier: MPL-1.1": "MPL",
        "SPDX-License-Identifier: CC-BY-SA-3.0": "CC-BY-SA",
        "SPDX-License-Identifier: CC0-1.0": "CC0",
        "Licensed under CC BY 3.0": "CC-BY",
        "Apache License, Version 1.1": "Apache",
    }
    draw = random.Random(6)
    rows = [(i, f"{_prose(draw, 20)}\n\n{line}\n\n{_prose(draw, 9)}") for i, line in enumerate(lines)]
    rows += [(100 + i, _prose(draw, 30)) for i in range(60)]
    docs = documents(*rows)
    got = licence.scanned(docs, licence.fit(docs)).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == {(i, 1, f) for i, f in enumerate(lines.values())}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_notices(documents):
    draw = random.Random(8)
    around = lambda text, mark="": f"{_prose(draw, 9)}\n{mark}{text}\n{_prose(draw, 12)}"
    commented = lambda text, sign: "\n".join(sign + line for line in text.split("\n"))
    narrow = TEMPLATES["MIT"][2].replace(" ", "\n")
    rows = [
        (0, around(BSD), {("BSD", 1)}),
        (1, around(commented(GPL, " * ")), {("GPL", 1)}),
        (2, f"#!/bin/sh\n#\n{commented(MIT, '# ')}\n#\nriver()", {("MIT", 2)}),
        (3, f"{BSD}\r\n\r\n{GPL}".replace("\n", "\r\n").replace("\r\r", "\r"), {("BSD", 0), ("GPL", 3)}),
        (4, f"{GPL}\n{MIT}", {("GPL", 0), ("MIT", 4)}),
        (5, f"{narrow}\nriver", {("MIT", 0)}),
        (6, "All rights\nreserved.", {("reserved", 0)}),
        (7, "All rights\n\nreserved.", set()),
        (8, "Released under the MIT License.\nAll rights reserved.\nReleased under the MIT License.", {("MIT", 0), ("reserved", 1), ("MIT", 2)}),
    ]
    rows += [(100 + i, "\n".join(_prose(draw, 11) for _ in range(6)), set()) for i in range(40)]
    docs = documents(*[row[:2] for row in rows])
    got = licence.scanned(docs, licence.fit(docs)).collect()
    for doc_id, _, want in rows:
        assert (doc_id, {(r.family, r.paragraph) for r in got if r.doc_id == doc_id}) == (doc_id, want)
    assert {r.lines for r in got if r.doc_id in (0, 2)} == {3} and [r.similarity for r in got if r.doc_id == 0] == [1.0]


def test_constants_of_the_model_stand_in_the_plan_once(documents):
    """Every state of a plan that adapts is kept as text on the driver: 2.7 million characters before."""
    docs = documents("All rights reserved", "stone and river")
    rows = licence.scanned(docs, licence.fit(docs))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 600_000
