"""Licence scans: a trained paragraph classifier over word n-grams. DataFrame functions only on the main path."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal

#: Notices by licence family, as their stewards publish them; years, versions and holders are left out, as digits do not count.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version.",
        "Licensed under the Apache License, Version (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE",
        "Distributed under the Apache License, Version.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU General Public License.",
        "SPDX-License-Identifier: GPL",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL",
    ),
    "cc-by": (
        "Licensed under CC BY.",
        "This work is licensed under a Creative Commons Attribution International License.",
        "SPDX-License-Identifier: CC-BY",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike International License.",
        "SPDX-License-Identifier: CC-BY-SA",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial International License.",
        "SPDX-License-Identifier: CC-BY-NC",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced in any form without prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Notices of licences that are none of the families.
OTHER_NOTICES = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.", "Licensed under the European Union Public Licence, the EUPL.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies.",
    "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Distributed under the Boost Software License.", "This is free and unencumbered software released into the public domain, under no licence.", "Released under the Artistic License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License, which you may not use except in compliance with.", "This font software is licensed under the SIL Open Font License.",
    "To the extent possible under law, the author has waived all copyright and related rights to this work.", "You may redistribute this package under the same terms as the language itself, see the licence file.",
    "This data is made available under the Open Database License.", "Dual licensed, at your choice, under the terms of two licenses.", "Use of this source code is governed by a license that can be found in the license file.",
    "Licensed under the terms of the academic free license.", "This document may be redistributed under the terms of the free documentation licence.", "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: Zlib",
    "Released under the terms of its own licence, which is found in the file copying.", "This sample is licensed under a custom agreement, see the enclosed terms.",
)
#: Paragraphs that use the same words and grant nothing.
OTHERS = (
    "The driver showed his license to the officer and drove on.", "She asked for permission to leave the room early.", "The general public was invited to the opening of the library.", "An Apache helicopter landed near the village.",
    "He studied at MIT and later founded a company.", "A fishing license costs less than most people think.", "The warranty on the washing machine ran out last year.", "Software is eating the world, one business at a time.",
    "Public schools are free of charge in most countries.", "The foundation published its report about clean water.", "Creative people commonly work at night.", "Source and binary stars are studied by astronomers.",
    "The file was copied to the new server during the night.", "The work of the commission was attributed to its chair.", "License to operate the crane must be renewed every year.", "Mozilla is a company that makes a browser.",
    "The terms of the agreement were published in the newspaper.", "Copyright law differs from country to country.", "This publication may be found in any library.", "Licensed practitioners may use this form.",
    "The court held that the licence had been revoked by the minister.", "Permission to land was refused by the tower.", "Released under pressure from the unions, the report says little.", "This work is dedicated to my parents.",
    "All seats are reserved for members of the club.", "The commons debated the motion until midnight.", "A confidential source told the paper about the deal.", "He sent a cc of the letter to his lawyer.", "The gnu is a large antelope of the plains.",
    "Her licence was suspended for three months after the accident.", "Copyright infringement was the subject of the trial.", "The shop lost its permission to sell wine.", "A warrant for his arrest was issued on Monday.", "Redistribution of wealth was the theme of the campaign.",
    "The proprietary blend of spices is kept secret.", "Nobody may enter the hall without written permission of the guard.", "The doctor is licensed in two states.", "I hereby declare the games open.", "Restaurants need a licence to play music.", "The apache tribes lived in the south west.",
)
#: By how much the bias of no notice exceeds that of any class of notices, at least: a paragraph without a known n-gram is none.
MARGIN = 4.0
#: What a text in lower case must hold for its lines to be read, and a line to be scored. Templates cannot be held without one.
#: The model is not fitted to these; tests score every line of a corpus and of the examples, and find the same notices.
TRIGGERS = ("licens", "licenc", "copyright", "warrant", "redistribut", "hereby", "permission", "mozilla", "gnu", "spdx", "reserved", "proprietary", "confidential", "commons", "cc by", "cc-by", "apache", "bsd", "gpl", "mpl", "unencumbered",
            "public domain", "free of charge", "without restriction", "documentation", "distributed under", "terms of", "this software", "source form", "binary", "unauthorized", "under law", "related rights")
#: Words of a shingle, and the share of a template's shingles that confirms a prediction.
SHINGLE, CONFIRMED = 5, 0.8
#: Names that confirm a prediction of their family, in lower-case text; a paragraph of few words with one needs no sure prediction.
NAMES = {
    "apache": r"\bapache[ -](licen[cs]e,? )?(version |v)?2\.0",
    "gpl": r"\bgpl[ -]?v?[123]\b",
    "lgpl": r"\blgpl[ -]?v?[23]\b",
    "bsd": r"\bbsd[ -][0-4][ -]clause\b",
    "mpl": r"\bmpl[ -]2\.0",
    "cc-by": r"\bcc[ -]by\b(?![ -](sa|nc|nd)\b)|\bcreative commons attribution\b(?! ?- ?| (share|non|no))",
    "cc-by-sa": r"\bcc[ -]by[ -]sa\b|\bcreative commons attribution[ -]share-?alike\b",
    "cc-by-nc": r"\bcc[ -]by[ -]nc\b(?![ -](sa|nd)\b)|\bcreative commons attribution[ -]non-?commercial\b(?![ -](share|no))",
}
FEW = 4
#: Share of other paragraphs that may pass as a notice when the threshold is set, and the seed of the training texts.
PASSING, SEED = 0.01, 5
#: The class of notices of no family, and that of what is no notice.
UNKNOWN, NONE = "unknown", "none"
#: Buckets of the table of weights.
BUCKETS = 4096


def words(text: str) -> list[str]:
    return re.findall("[a-z]+", text.lower())


def shingles(w: list[str], width: int = SHINGLE) -> list[str]:
    return list(dict.fromkeys(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))) if w else []


def ngrams(w: list[str]) -> list[str]:
    return list(dict.fromkeys([*w, *(" ".join(x) for x in zip(w, w[1:], strict=False))]))


@dataclass(frozen=True)
class Model:
    """Softmax regression: for each n-gram its weight for each class, of which the last is no notice.

    A paragraph is a notice from ``threshold`` on: the probability that it is of any class but the last.
    """

    classes: tuple[str, ...]
    vocabulary: dict
    weights: np.ndarray
    bias: np.ndarray
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        rows = [self.vocabulary[g] for g in ngrams(words(text)) if g in self.vocabulary]
        return _softmax(self.bias + self.weights[rows].sum(axis=0))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _examples(rng: random.Random) -> list[tuple[str, str, bool]]:
    """(class, text, held out): variants of the templates and of other paragraphs, by words left out and words of prose around
    them. Each fourth variant of a template is held out, and each fourth of the other notices and paragraphs as a whole."""
    filler = [w for x in OTHERS for w in words(x)]
    out = []
    for name, texts in (*TEMPLATES.items(), (UNKNOWN, OTHER_NOTICES), (NONE, OTHERS)):
        for n, text in enumerate(texts):
            w = words(text)
            for k in range(12 if name != NONE else 6):
                drop = 0.0 if k < 3 else 0.12
                around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 2, 5)))]
                cut = rng.randint(0, len(around))
                kept = [x for x in w if rng.random() >= drop]
                out.append((name, " ".join(around[:cut] + kept + around[cut:]), (n if name in (UNKNOWN, NONE) else k) % 4 == 3))
    out += [(NONE, " ".join(rng.choice(filler) for _ in range(rng.randint(3, 30))), k % 4 == 3) for k in range(240)]
    # Words of notices out of their order.
    licence = [w for texts in (*TEMPLATES.values(), OTHER_NOTICES) for x in texts for w in words(x)]
    out += [(NONE, " ".join(rng.choice(licence + filler) for _ in range(rng.randint(4, 25))), k % 4 == 3) for k in range(160)]
    # Grants by names that nobody has heard of.
    named = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    forms = ("licensed under the {} license", "licensed under the {} terms see elsewhere", "released under the {} licence", "distributed under the {} public license version", "this work is licensed under the {} license", "spdx license identifier {}")
    return out + [(UNKNOWN, rng.choice(forms).format(named()), k % 4 == 3) for k in range(120)]


@cache
def trained() -> Model:
    """Fitted on the driver to the examples above: a fixed number of short texts, none from the corpus.

    What is held out sets the temperature, by its likelihood, and the threshold: but one in a hundred of its paragraphs that are
    no notices passes.
    """
    data = _examples(random.Random(SEED))
    classes = (*TEMPLATES, UNKNOWN, NONE)
    held = np.array([h for _, _, h in data])
    counts: dict[str, int] = {}
    for _, text, h in data:
        for g in () if h else ngrams(words(text)):
            counts[g] = counts.get(g, 0) + 1
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, n in counts.items() if n >= 4))}
    x = np.zeros((len(data), len(vocabulary)))
    for k, (_, text, _) in enumerate(data):
        x[k, [vocabulary[g] for g in ngrams(words(text)) if g in vocabulary]] = 1
    y = np.eye(len(classes))[[classes.index(c) for c, _, _ in data]]
    own, target = x[~held], y[~held]
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    rate = np.zeros_like(w) + 1e-8
    for _ in range(400):
        error = _softmax(own @ w + b) - target
        g = own.T @ error / len(own) + 1e-4 * w
        rate += g * g
        w -= 0.3 * g / np.sqrt(rate)
        # Soft thresholding keeps the weights sparse.
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4, 0)
        b -= 0.5 * error.mean(axis=0)
        b[:-1] = np.minimum(b[:-1], b[-1] - MARGIN)
    scores, right = x[held] @ w + b, y[held].argmax(axis=1)
    likelihood = lambda t: np.log(_softmax(scores / t)[np.arange(len(right)), right] + 1e-300).mean()
    temperature = max(np.linspace(0.5, 3, 26), key=likelihood)
    w, b = (w / temperature).round(4), (b / temperature).round(4)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    names = list(vocabulary)
    model = Model(classes, {names[j]: k for k, j in enumerate(used)}, w[used], b, 0.0)
    passing = sorted(1 - model.probabilities(t)[-1] for c, t, h in data if h and c == NONE)
    threshold = passing[int(len(passing) * (1 - PASSING))] + 1e-6
    return Model(model.classes, model.vocabulary, model.weights, model.bias, round(float(threshold), 6))


def _scores(grams: str, model: Model) -> Column:
    """The sums of the n-grams' weights and the biases, by class."""
    table = literal(model.weights.tolist(), "array<array<double>>")
    start = F.array(*(F.lit(float(b)) for b in model.bias))
    return F.aggregate(grams, start, lambda total, k: F.zip_with(total, F.get(table, k), lambda x, y: x + y))


def _lexicon(model: Model) -> Column:
    """What a word begins, as a hash table: an array of buckets by the word's hash, so that each is looked up in constant time.

    Of a word: the number of its own n-gram (or -1), the words that make an n-gram with it, and the shingles of templates
    that it starts (template, number in it, words, the words after the first).
    """
    entries: dict[str, dict] = {}
    of = lambda g: entries.setdefault(g, {"g": g, "k": -1, "next": [], "s": []})
    for gram, k in model.vocabulary.items():
        first, _, second = gram.partition(" ")
        if second:
            of(first)["next"].append({"g": second, "k": k})
        else:
            of(first)["k"] = k
    for t, (_, own) in enumerate(_templates()):
        for i, x in enumerate(own):
            first, _, rest = x.partition(" ")
            of(first)["s"].append({"t": t, "i": i, "n": x.count(" ") + 1, "rest": rest})
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for g, e in entries.items():
        digest = xxhash.xxh64_intdigest(g.encode(), 42)
        buckets[(digest - (digest >> 63 << 64)) % BUCKETS].append(e)
    return literal(buckets, "array<array<struct<g:string,k:int,next:array<struct<g:string,k:int>>,s:array<struct<t:int,i:int,n:int,rest:string>>>>>")


def _templates() -> list[tuple[str, list[str]]]:
    """(family, shingles): a template of fewer than five words has one shingle, of all of them."""
    return [(f, shingles(words(t))) for f, texts in TEMPLATES.items() for t in texts]


def _met(w: Column, length: Column, lexicon: Column, then) -> Column:
    """``then(met)`` of the words among the first ``length`` ones that the lexicon has: (j, from 0; e, its entry)."""
    entry = lambda g: F.get(F.filter(F.element_at(lexicon, F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int") + 1), lambda e: e["g"] == g), F.lit(0))
    met = F.filter(F.transform(F.slice(w, F.lit(1), length), lambda g, j: F.struct(j.alias("j"), entry(g).alias("e"))), lambda x: x["e"].isNotNull())
    return F.get(F.transform(F.array(met), then), F.lit(0))


def _grams(w: Column, length: Column, met: Column) -> Column:
    """The numbers of the different n-grams within the first ``length`` words."""
    two = lambda x: F.filter(x["e"]["next"], lambda n: (x["j"] + 1 < length) & (n["g"] == F.get(w, x["j"] + 1)))
    return F.array_distinct(F.flatten(F.transform(met, lambda x: F.concat(F.filter(F.array(x["e"]["k"]), lambda k: k >= 0), F.transform(two(x), lambda n: n["k"])))))


def _line(lines: Column, i: Column, lexicon: Column) -> Column:
    """Of line ``i`` (from 0; ``lines`` are their words): its n-grams, and the shingles of templates that start in it.

    A shingle (template t, number i in it, lines a to z) may end some lines further on, so the words of the next four are
    looked at as well.
    """
    after = lambda k: F.flatten(F.slice(lines, i + 2, k))
    own = F.get(lines, i)
    ends = lambda last: F.when(last < 0, i).otherwise(i + 1 + F.size(F.filter(F.sequence(F.lit(1), F.lit(SHINGLE - 1)), lambda k: F.size(after(k)) <= last)))
    whole = lambda w, x: F.filter(x["e"]["s"], lambda s: s["rest"] == F.array_join(F.slice(w, x["j"] + 2, s["n"] - 1), " "))
    hit = lambda s, x, n: F.struct(s["t"].alias("t"), s["i"].alias("i"), i.alias("a"), ends(x["j"] + s["n"] - 1 - n).alias("z"))
    hits = lambda w, n, met: F.flatten(F.transform(F.filter(met, lambda x: F.size(x["e"]["s"]) > 0), lambda x: F.transform(whole(w, x), lambda s: hit(s, x, n))))
    read = lambda w, n: _met(w, n, lexicon, lambda met: F.struct(_grams(w, n, met).alias("grams"), hits(w, n, met).alias("hits")))
    return F.get(F.transform(F.array(F.concat(own, F.slice(after(F.lit(SHINGLE - 1)), 1, SHINGLE - 1))), lambda w: read(w, F.size(own))), F.lit(0))


def _runs(hits: str, lines: str) -> Column:
    """(a, z): runs of lines, of over one and none of them blank, that hold enough shingles of a template to confirm it.

    The hits are read once for each template that has any. Kept are the lines where each shingle started last; of these the
    one that as many as are needed reach up to is the latest start of a run that ends here. With the first line that ends a
    run, the template is read anew: runs of one template share no line. However many lines a notice is wrapped over, each
    hit is looked at once.
    """
    sizes = [len(s) for _, s in _templates()]
    needed, lengths = (literal(x, "array<int>") for x in ([next(k for k in range(n + 1) if k / n >= CONFIRMED) for n in sizes], sizes))
    run = lambda a, z: F.struct(a.alias("a"), z.alias("z"))
    none = lambda t: F.array_repeat(F.lit(-1), F.get(lengths, t))
    blank = lambda a, z: F.exists(F.slice(lines, a + 1, z - a + 1), lambda w: F.size(w) == 0)
    # ``open`` is the run that ends with the line of the hits before, if any: a later start may still come in that line.
    closes = lambda s, h: (s["open"]["a"] >= 0) & (s["open"]["z"] < h["z"])
    done = lambda s: F.concat(s["runs"], F.filter(F.array(s["open"]), lambda r: r["z"] > r["a"]))

    def step(s: Column, h: Column) -> Column:
        before = F.when(closes(s, h), none(h["t"])).otherwise(s["last"])
        free = F.when(closes(s, h), s["open"]["z"] + 1).otherwise(s["free"])
        last = F.transform(before, lambda v, i: F.when((i == h["i"]) & (h["a"] >= free), h["a"]).otherwise(v))
        start = lambda x: F.get(F.sort_array(x, False), F.get(needed, h["t"]) - 1)
        opened = lambda x: F.get(F.transform(F.array(start(x)), lambda a: run(F.when((a >= 0) & ~blank(a, h["z"]), a).otherwise(F.lit(-1)), h["z"])), F.lit(0))
        return F.get(F.transform(F.array(last), lambda x: F.struct(x.alias("last"), opened(x).alias("open"), free.alias("free"), F.when(closes(s, h), done(s)).otherwise(s["runs"]).alias("runs"))), F.lit(0))

    begin = lambda t: F.struct(none(t).alias("last"), run(F.lit(-1), F.lit(-1)).alias("open"), F.lit(0).alias("free"), F.array().cast("array<struct<a:int,z:int>>").alias("runs"))
    end = lambda s: F.when(s["open"]["a"] >= 0, done(s)).otherwise(s["runs"])
    enough = lambda t, own: F.size(F.array_distinct(F.transform(own, lambda h: h["i"]))) >= F.get(needed, t)
    of = lambda t: F.flatten(F.transform(F.filter(F.array(F.filter(hits, lambda h: h["t"] == t)), lambda own: enough(t, own)), lambda own: F.aggregate(own, begin(t), step, end)))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform(hits, lambda h: h["t"])), of)))


def _shingles(w: str, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def _triggered(text) -> Column:
    """Plain searches in the text, which is lower-cased once for all of them; a trigger may go over a line's end."""
    return F.exists(F.array(F.replace(F.lower(text), F.lit("\n"), F.lit(" "))), lambda low: reduce(Column.__or__, (F.contains(low, F.lit(t)) for t in TRIGGERS)))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The licence notices of ``docs`` (doc_id, text; other columns are not read): a row for each paragraph that is one.

    (doc_id, paragraph int from 0, family, probability, similarity, confirmed, text). Paragraphs are the lines of a text. A
    line is a notice if the classifier gives at least the calibrated threshold to its being one of any class: a family, or
    a licence of none of them. A family is confirmed if the line holds 0.8 of the five-word shingles of one of its templates
    (all words, of a shorter one) or its name (``NAMES``), which also confirms a line of FEW words by itself. What is not
    confirmed is returned as ``unknown``. Null and empty texts have no paragraphs.

    Texts without a trigger are not read, and lines without one not scored by themselves: this costs the classifier what it
    would find there, which was nothing in the documents of the tests and less than 1 % of the example notices that pass.

    A notice that is wrapped over several lines is a row of the first of them, with all of them as its text: the fewest
    consecutive lines without a blank one, however many, that hold a template. Those lines are then no rows by themselves,
    unless they are confirmed so; runs of one template share no line. Texts are scanned one by one: repeated and null doc_ids
    do not matter, and nothing but the notices found is shuffled.
    """
    model = model or trained()
    lexicon = _lexicon(model)
    split = docs.select("doc_id", "text").where(_triggered("text")).select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    # A generator is computed once; a plain column would be again for each of its uses below.
    split = split.select("*", F.explode(F.array(F.transform("lines", _words))).alias("w"))
    read = split.select("*", F.explode(F.array(F.transform("w", lambda _, i: _line(F.col("w"), i, lexicon)))).alias("read"))
    read = read.withColumn("hits", F.flatten(F.transform("read", lambda r: r["hits"])))
    joined = F.when(F.size("hits") > 0, _runs("hits", "w")).otherwise(F.array().cast("array<struct<a:int,z:int>>"))
    one = F.filter(F.transform("read", lambda r, i: F.struct(i.alias("paragraph"), F.lit(1).alias("joined"), r["grams"].alias("grams"))), lambda u: _triggered(F.get("lines", u["paragraph"])))
    said = lambda r: F.get(F.transform(F.array(F.flatten(F.slice("w", r["a"] + 1, r["z"] - r["a"] + 1))), lambda w: _met(w, F.size(w), lexicon, lambda met: _grams(w, F.size(w), met))), F.lit(0))
    more = F.transform(joined, lambda r: F.struct(r["a"].alias("paragraph"), (r["z"] - r["a"] + 1).alias("joined"), said(r).alias("grams")))
    rows = read.select("doc_id", "row", "lines", F.explode(F.concat(one, more)).alias("u"))
    rows = rows.select("doc_id", "row", "u.paragraph", "u.joined", F.array_join(F.slice("lines", F.col("u.paragraph") + 1, F.col("u.joined")), "\n").alias("text"), "u.grams")
    rows = rows.withColumn("w", _words(F.col("text")))
    rows = rows.select("*", F.explode(F.array(_scores("grams", model))).alias("z"))
    top = F.array_max("z")
    rows = rows.withColumn("total", F.aggregate("z", F.lit(0.0), lambda t, v: t + F.exp(v - top)))
    notices = F.slice("z", 1, len(model.classes) - 1)
    rows = rows.withColumns(
        {
            "probability": 1 - F.exp(F.element_at("z", -1) - top) / F.col("total"),
            "family": F.element_at(F.array(*map(F.lit, model.classes[:-1])), F.array_position(notices, F.array_max(notices)).cast("int")),
        }
    )
    templates = literal([{"f": f, "s": shingles(words(t))} for f, texts in TEMPLATES.items() for t in texts], "array<struct<f:string,s:array<string>>>")
    # Templates of fewer than five words are compared by shingles of their own width.
    widths = sorted({min(SHINGLE, len(words(t))) for texts in TEMPLATES.values() for t in texts})
    own = F.flatten(
        F.array(*(_shingles("w", n) for n in widths))
    )
    rows = rows.withColumn("own", own)
    alike = F.array_max(F.transform(F.filter(templates, lambda t: t["f"] == F.col("family")), lambda t: F.size(F.array_intersect(t["s"], "own")) / F.size(t["s"])))
    rows = rows.withColumn("similarity", alike)
    sure = F.col("probability") >= model.threshold
    named = reduce(lambda rest, f: F.when(F.col("family") == f, F.lower("text").rlike(NAMES[f])).otherwise(rest), NAMES, F.lit(False))
    # The class of other notices has no template, so its similarity is null.
    confirmed = F.coalesce((sure & ((F.col("similarity") >= CONFIRMED) | named)) | (named & (F.size("w") <= FEW)), F.lit(False))
    rows = rows.where((F.col("joined") == 1) | confirmed)
    found = rows.where(sure | confirmed).select(
        "doc_id", "row", "paragraph", "joined", F.when(confirmed, F.col("family")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), confirmed.alias("confirmed"), "text"
    )
    # What is said of the same place: a confirmed notice speaks for its lines, and of one family the longest does.
    place = Window.partitionBy("row", "paragraph")
    before = Window.partitionBy("row").orderBy("paragraph").rangeBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.when(F.col("confirmed"), F.col("paragraph") + F.col("joined") - 1))
    found = found.withColumns({"any": F.max("confirmed").over(place), "longest": F.max("joined").over(Window.partitionBy("row", "paragraph", "family")), "spoken": F.coalesce(ends.over(before) >= F.col("paragraph"), F.lit(False))})
    return found.where((F.col("confirmed") | ~(F.col("any") | F.col("spoken"))) & (F.col("joined") == F.col("longest"))).drop("row", "joined", "any", "longest", "spoken")
