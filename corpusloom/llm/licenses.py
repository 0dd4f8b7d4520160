"""Licence scans in SQL functions: a trained paragraph classifier with a calibrated unknown class, and template comparison to confirm it."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Notices by family: what training starts from and what predictions are compared with.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 or 3 of the License, or any later version"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1 or later"),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3, for use over a network"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the 3-Clause BSD License. All rights reserved by the copyright holders and contributors"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0, a Creative Commons Attribution-ShareAlike License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "Dedicated to the public domain under CC0 1.0 Universal; no copyright is claimed"),
    *((f, f"SPDX-License-Identifier: {x}") for f, x in (("MIT", "MIT"), ("Apache", "Apache-2.0"), ("GPL", "GPL-3.0-or-later"), ("LGPL", "LGPL-2.1-or-later"), ("AGPL", "AGPL-3.0-or-later"))),
    *((f, f"SPDX-License-Identifier: {x}") for f, x in (("BSD", "BSD-3-Clause"), ("MPL", "MPL-2.0"), ("CC-BY", "CC-BY-4.0"), ("CC-BY-SA", "CC-BY-SA-4.0"), ("CC0", "CC0-1.0"))),
    ("Proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher"),
)
#: Paragraphs with the same words and no licence, and licences of other families.
OTHER = (
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Unlicense",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: OFL-1.1",
    "Licensed under the Boost Software License, Version 1.0.",
    "Distributed under the terms of the Eclipse Public License, version 2.0.",
    "This font is licensed under the SIL Open Font License, version 1.1.",
    "Released under the zlib license.",
    "This work is licensed under the European Union Public License, version 1.2.",
    "Her driving licence expired last spring and the officer asked for another document.",
    "The committee granted permission to open the road again after the storm.",
    "The warranty covers parts for two years when the product is used as intended.",
    "Copyright law differs from country to country, as the lecture explained.",
    "He applied for a fishing license at the town hall.",
    "The version of the general who led the public works was published in a free paper.",
    "She studied at MIT before moving to the coast.",
    "An Apache helicopter was seen over the valley.",
    "The software can be used over a network in many forms.",
    "We license our staff every year and keep the conditions under review.",
    "You may obtain a copy of the report at the library without charge.",
    "Attribution of the painting to the master remains in doubt.",
    "The word international was added to the name of the foundation.",
    "License plates are issued by the state, version two since May.",
    "Please see the file for details of the terms and conditions of sale.",
)
#: Other wordings, and other texts without a licence or with one of another family: no part of training, they set the calibration.
CALIBRATION = (
    ("MIT", "This project is made available under the terms of the MIT licence."),
    ("MIT", "The code is released under the MIT License, see LICENSE.txt for details."),
    ("MIT", "Permission is granted, free of charge, to any person who obtains a copy of the software, to deal in it without restriction."),
    ("Apache", "Distributed under the Apache License, Version 2.0."),
    ("Apache", "This file is covered by the Apache License 2.0; you may not use it except in compliance with the License."),
    ("GPL", "Distributed under the GNU General Public License, version 3."),
    ("GPL", "You can redistribute this package and modify it under the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL", "This library is covered by the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "The server is released under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution in source and binary forms is permitted provided that these conditions are met."),
    ("BSD", "Distributed under the 3-Clause BSD License."),
    ("MPL", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "The text may be used under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Content is available under CC BY-SA 4.0, a Creative Commons Attribution-ShareAlike License."),
    ("CC-BY-NC", "Images are licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "Released under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "Dedicated to the public domain (CC0 1.0 Universal)."),
    ("Proprietary", "All rights reserved. No part of this book may be reproduced without prior written permission of the publisher."),
    ("unknown", "His licence to practise law was renewed in the spring."),
    ("unknown", "The general public was not admitted to the works."),
    ("unknown", "The museum holds the copyright in the photographs it shows."),
    ("unknown", "Parts under warranty are replaced free of charge at the shop."),
    ("unknown", "A commons for creative people was opened in the old mill."),
    ("unknown", "Permission slips must be signed by a parent and returned."),
    ("unknown", "Only licensed plumbers may work on the pipes."),
    ("unknown", "Redistribution of land was the subject of the debate."),
    ("unknown", "The lesser works of the painter were sold without reserve."),
    ("unknown", "Licensed under the Artistic License, Version 2.0."),
    ("unknown", "Distributed under the Open Software License, version 3.0."),
    ("unknown", "SPDX-License-Identifier: ISC"),
    ("unknown", "Released under the terms of the PostgreSQL License."),
)
#: A single line without any of these is no candidate; runs of lines are looked at by the templates' own word triples.
ANCHOR = r"(?i)licen[cs]|copyright|redistribut|permission|warrant|spdx|creative commons|\bcc[ -]?(by|0)|public domain|rights reserved"
UNKNOWN = "unknown"
N = 3
#: Share of a template's word triples that confirms a prediction; at a half, notices that differ in the name alone would.
CONFIRM = 0.55


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(text: str) -> list[str]:
    """All different runs of one to N words."""
    w = words_of(text)
    return sorted({" ".join(w[i : i + n]) for n in range(1, N + 1) for i in range(len(w) - n + 1)})


@dataclass(frozen=True)
class Model:
    """Weights by n-gram, one for each class; the intercepts; the calibrated temperature and least probability."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    least: float
    templates: dict[str, tuple[int, ...]]
    sizes: tuple[int, ...]


def _varied(rng: np.random.Generator, text: str, extra: list[str]) -> str:
    """A paragraph with some words lost, and some of other paragraphs around it."""
    w = [x for x in text.split() if rng.random() > 0.12]
    before, after = rng.integers(0, 8, 2) if rng.random() < 0.5 else (0, 0)
    return " ".join([*rng.choice(extra, before), *w, *rng.choice(extra, after)])


def _logits(x: list[list[int]], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([w[g].sum(0) for g in x]).reshape(len(x), -1) + b


@lru_cache
def trained(seed: int = 11, copies: int = 24, rounds: int = 200, rate: float = 0.05, ridge: float = 2e-3) -> Model:
    """Multinomial logistic regression on varied copies of TEMPLATES and OTHER; CALIBRATION, which it has not seen, sets the temperature (by likelihood) and the least probability at which 99 in 100 predictions of a family are right (0.95 if there is none below)."""
    rng = np.random.default_rng(seed)
    classes = (*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN)
    texts = [(classes.index(f), t) for f, t in TEMPLATES] + [(len(classes) - 1, t) for t in OTHER]
    extra = sorted({w for t in OTHER for w in t.split()})
    rows = [(c, _varied(rng, t, extra) if k else t) for c, t in texts for k in range(copies)]
    rows += [(len(classes) - 1, " ".join(rng.choice(extra, rng.integers(1, 30)))) for _ in range(20 * copies)]
    rng.shuffle(rows)
    rows = [(int(c), str(t)) for c, t in rows]
    known = {g: i for i, g in enumerate(sorted({g for _, t in texts for g in grams_of(t)}))}
    half = len(rows)
    rows += [(classes.index(f), t) for f, t in CALIBRATION]
    x = [[known[g] for g in grams_of(t) if g in known] for _, t in rows]
    y = np.eye(len(classes))[[c for c, _ in rows]]
    w, b = np.zeros((len(known), len(classes))), np.zeros(len(classes))
    row = np.repeat(np.arange(half), [len(g) for g in x[:half]])
    col = np.concatenate([np.array(g, np.int64) for g in x[:half]])
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = _logits(x[:half], w, b)
        p = np.exp(z - z.max(1, keepdims=True))
        err = (p / p.sum(1, keepdims=True) - y[:half]) / half
        g = np.zeros_like(w)
        np.add.at(g, col, err[row])
        g += ridge * w / half
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        b -= 2.0 * err.sum(0)
    z = _logits(x[half:], w, b)
    truth = y[half:].argmax(1)

    def chances(heat: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / heat)
        return p / p.sum(1, keepdims=True)

    heats = np.geomspace(0.25, 8, 41)
    heat = float(heats[np.argmax([np.log(chances(h)[np.arange(len(truth)), truth] + 1e-12).sum() for h in heats])])
    p = chances(heat)
    best, top = p.argmax(1), p.max(1)
    family = best != len(classes) - 1
    right = lambda q: (best[family & (top >= q)] == truth[family & (top >= q)]).mean() if (family & (top >= q)).any() else 1.0
    least = next((float(q) for q in np.arange(0.5, 0.96, 0.05) if right(q) >= 0.99), 0.95)
    in_template: dict[str, list[int]] = {}
    sets = [[g for g in grams_of(t) if len(words_of(t)) < N or g.count(" ") == N - 1] for _, t in TEMPLATES]
    for k, s in enumerate(sets):
        for g in s:
            in_template.setdefault(g, []).append(k)
    rounded = np.round(w, 6)
    return Model(
        classes, {g: tuple(rounded[i].tolist()) for g, i in known.items()}, tuple(np.round(b, 6).tolist()), round(heat, 6), round(least, 2), {g: tuple(v) for g, v in in_template.items()}, tuple(len(s) for s in sets)
    )


def classify(text: str, model: Model | None = None) -> tuple[str, float, int, float]:
    """(family, probability, template, overlap) of one paragraph, in plain Python; what paragraphs() gives for it."""
    m = model or trained()
    grams = grams_of(text)
    z = np.array(m.bias) + np.array([m.weights[g] for g in grams if g in m.weights]).reshape(-1, len(m.classes)).sum(0)
    p = np.exp((z - z.max()) / m.temperature)
    p /= p.sum()
    k = int(p.argmax())
    share = np.zeros(len(TEMPLATES))
    for g in grams:
        for t in m.templates.get(g, ()):
            share[t] += 1 / m.sizes[t]
    own = [t for t, (f, _) in enumerate(TEMPLATES) if f == m.classes[k]]
    t = max(own, key=lambda i: (round(share[i], 9), -i)) if own else -1
    return (m.classes[k] if p[k] >= m.least else UNKNOWN), float(p[k]), t, float(share[t]) if t >= 0 else 0.0


@lru_cache
def needed_words(confirm: float) -> tuple[str, ...]:
    """Words of which every text with an overlap of ``confirm`` has one: without them, too few of each template's triples are left. Long words, and words that are neither very common nor in OTHER, are taken first."""
    m = trained()
    plain = {"this", "with", "that", "from", *(w for t in OTHER for w in words_of(t))}
    left = {t: {g for g, ts in m.templates.items() if t in ts} for t in range(len(TEMPLATES))}
    found: set[str] = set()
    for t, grams in left.items():
        rest = {g for g in grams if not found & set(g.split())}
        while len(rest) >= confirm * m.sizes[t]:
            best = max({w for g in rest for w in g.split()}, key=lambda w: (sum(w in g.split() for g in rest) * len(w) ** 2 * (0.1 if w in plain else 1), w))
            found.add(best)
            rest = {g for g in rest if best not in g.split()}
    return tuple(sorted(found))


def _runs(hits: DataFrame, m: Model) -> DataFrame:
    """(row, first, last, of) of the runs of lines to classify in each row of row, lines: paragraphs with a word triple of a template (of holds -1), and for each family the longest runs of lines within a paragraph that all have a part in its triples (of holds the family's places).

    Triples are taken across lines; a line without a letter or digit ends a paragraph.
    """
    spark = hits.sparkSession
    family = [m.classes.index(f) for f, _ in TEMPLATES]
    rows = [{"g": g, "k": sorted({family[t] for t in ts})} for g, ts in sorted(m.templates.items())] + [{"g": "", "k": [-1]}]
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<g:string,k:array<int>>>")))

    def words(x: Column) -> Column:
        found = F.transform(F.regexp_extract_all(F.lower(x.par), F.lit("[a-z0-9]+"), F.lit(0)), lambda g: F.struct(x.line.alias("line"), g.alias("g")))
        return F.when(x.par.rlike(r"[\p{L}\p{N}]"), found).otherwise(F.array(F.struct(x.line.alias("line"), F.lit("").alias("g"))))

    end = F.array(F.struct(F.size("lines").alias("line"), F.lit("").alias("g")))
    w = hits.select("row", F.concat(F.flatten(F.transform("lines", words)), end).alias("w"))

    def triple(x: Column, i: Column) -> Column:
        b, c = F.get("w", i + 1), F.get("w", i + 2)
        whole = (x.g != "") & (b.g != "") & (c.g != "")
        return F.when(x.g == "", F.struct(x.line.alias("a"), x.line.alias("z"), F.lit("").alias("g"))).when(
            whole, F.struct(x.line.alias("a"), c.line.alias("z"), F.concat_ws(" ", x.g, b.g, c.g).alias("g"))
        )

    met = w.select("row", F.inline(F.filter(F.transform("w", triple), lambda x: x.isNotNull()))).join(F.broadcast(known), "g")
    met = met.select("row", F.explode(F.sequence("a", "z")).alias("line"), "k").select("row", "line", F.explode("k").alias("k")).distinct()
    blank, by_row = F.when(F.col("k") == -1, F.col("line")), Window.partitionBy("row")
    met = met.withColumn("before", F.max(blank).over(by_row.orderBy("line"))).withColumn("after", F.min(blank).over(by_row.orderBy(F.desc("line")))).where("k >= 0")
    met = met.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("row", "k").orderBy("line")))
    runs = met.groupBy("row", "k", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).select("row", "first", "last", "k")
    whole = met.select("row", (F.coalesce("before", F.lit(-1)) + 1).alias("first"), (F.col("after") - 1).alias("last"), F.lit(-1).alias("k")).distinct()
    return runs.union(whole).groupBy("row", "first", "last").agg(F.collect_set("k").alias("of"))


def paragraphs(docs: DataFrame, model: Model | None = None, confirm: float = CONFIRM) -> DataFrame:
    """(row, doc_id, candidates, blocks) for each row of doc_id, text; candidates is an array of (line, family, probability, template, overlap, confirmed) by line, blocks one of (first, last, family, probability, template, overlap, confirmed) by the first and last line.

    Candidates are the lines (numbered from 0) with an anchor word. Blocks are the runs of lines that _runs() names, read as one text, so that
    a notice wrapped over lines is confirmed; a single line is a block only if it has no anchor word. Texts without any of
    needed_words() cannot have a confirmed block and have no blocks. family is the class of the highest probability, or
    "unknown" where that is below the calibrated least; template is the place in TEMPLATES of the notice of that class
    with the largest share of its word triples in the text (-1 for the unknown class), overlap that share, and confirmed
    whether family is known and overlap at least ``confirm`` (and, for a block that is no paragraph, family is one it was taken for). Texts that are null or empty have no candidates, whatever
    their length lines are read whole, rows that repeat stay apart by row, a null doc_id stays null, an empty table
    gives no rows, and other columns are not read. The table of n-grams that is broadcast comes from TEMPLATES and OTHER
    alone.
    """
    m = model or trained()
    spark = docs.sparkSession
    rows = [{"g": g, "w": list(m.weights.get(g, [0.0] * len(m.classes))), "t": list(m.templates.get(g, ()))} for g in sorted(m.weights)]
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<g:string,w:array<double>,t:array<int>>>")))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("par")))
    hit = F.lower("text").rlike(f"(?<![a-z0-9])(?:{'|'.join(needed_words(confirm))})(?![a-z0-9])")
    docs = docs.select("*", hit.alias("hit"))
    read = written(docs.select("row", "doc_id", F.when(F.col("hit") | F.col("text").rlike(ANCHOR), F.col("text")).alias("text"), "hit"))
    pieces = read.where("text IS NOT NULL").select("row", "hit", lines.alias("lines"))
    single = pieces.select("row", F.inline(F.filter("lines", lambda x: x.par.rlike(ANCHOR)))).select("row", F.col("line").alias("first"), F.col("line").alias("last"), F.lit(None).cast("array<int>").alias("of"), "par")
    hits = pieces.where("hit").select("row", "lines")
    taken = hits.join(_runs(hits, m), "row").select("row", "first", "last", "of", F.array_join(F.slice(F.col("lines.par"), F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n").alias("par"))
    taken = taken.where((F.col("first") < F.col("last")) | ~F.col("par").rlike(ANCHOR))
    words = F.regexp_extract_all(F.lower("par"), F.lit("[a-z0-9]+"), F.lit(0))
    one = single.union(taken).select("row", "first", "last", "of", words.alias("w"))
    size = F.size("w")

    def runs_of(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(size >= n, at).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in range(1, N + 1)]
    grams = one.select("row", "first", "last", "of", F.explode_outer(F.array_distinct(F.concat(*runs))).alias("g"))
    met = grams.join(F.broadcast(known), "g", "left")
    n_class, n_template = len(m.classes), len(TEMPLATES)
    sums = [F.sum(F.coalesce(F.col("w")[k], F.lit(0.0))).alias(f"z{k}") for k in range(n_class)]
    shares = [F.count(F.when(F.array_contains("t", k), 1)).alias(f"t{k}") for k in range(n_template)]
    scored = met.groupBy("row", "first", "last", "of").agg(*sums, *shares)
    z = F.array(*[(F.col(f"z{k}") + m.bias[k]) / m.temperature for k in range(n_class)])
    share = F.array(*[F.col(f"t{k}") / m.sizes[k] for k in range(n_template)])
    scored = scored.select("row", "first", "last", "of", z.alias("z"), share.alias("share")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("k", F.array_position("z", F.col("top")).cast("int") - 1)
    scored = scored.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    best: Column = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("t"))
    for c, name in enumerate(m.classes[:-1]):
        own = [t for t, (f, _) in enumerate(TEMPLATES) if f == name]
        pick = F.array_max(F.array(*[F.struct(F.round(F.col("share")[t], 9).alias("s"), F.lit(-t).alias("t")) for t in own]))
        best = F.when(F.col("k") == c, F.struct(pick.s.alias("s"), (-pick.t).alias("t"))).otherwise(best)
    scored = scored.withColumn("best", best)
    family = F.when(F.col("probability") >= m.least, F.element_at(F.array(*map(F.lit, m.classes)), F.col("k") + 1)).otherwise(UNKNOWN)
    out = scored.select("row", "first", "last", "of", "k", family.alias("family"), "probability", F.col("best.t").alias("template"), F.col("best.s").alias("overlap"))
    meant = F.col("of").isNull() | F.array_contains("of", -1) | F.array_contains("of", F.col("k"))
    out = out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("overlap") >= confirm) & meant)
    said = ("family", "probability", "template", "overlap", "confirmed")
    by_row = out.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("of").isNull(), F.struct(F.col("first").alias("line"), *said)))).alias("candidates"),
        F.array_sort(F.collect_list(F.when(F.col("of").isNotNull(), F.struct("first", "last", *said)))).alias("blocks"),
    )
    rest = "family:string,probability:double,template:int,overlap:double,confirmed:boolean"
    no_line, no_block = (F.array().cast(f"array<struct<{at},{rest}>>") for at in ("line:int", "first:int,last:int"))
    return read.select("row", "doc_id").join(by_row, "row", "left").select("row", "doc_id", F.coalesce("candidates", no_line).alias("candidates"), F.coalesce("blocks", no_block).alias("blocks"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: lines looked at, confirmed licences, lines left unknown, and the confirmed families.

    Each confirmed line is a licence, and each confirmed block with no confirmed line or smaller block of its family in it.
    """
    return documents(table(spark, sf_dir, "documents"))


def documents(docs: DataFrame) -> DataFrame:
    """What op3_licenses() gives, for any rows of doc_id, text."""
    c = F.col("candidates")
    found = paragraphs(docs).withColumn("sure", F.filter(c, lambda x: x.confirmed)).withColumn("wide", F.filter("blocks", lambda x: x.confirmed))
    has_line = lambda b: F.exists("sure", lambda x: (x.family == b.family) & x.line.between(b.first, b.last))
    has_block = lambda b: F.exists("wide", lambda x: (x.family == b.family) & (x.first >= b.first) & (x.last <= b.last) & ((x.first > b.first) | (x.last < b.last)))
    found = found.withColumn("wide", F.filter("wide", lambda b: ~has_line(b) & ~has_block(b)))
    families = F.concat(F.transform("sure", lambda x: x.family), F.transform("wide", lambda x: x.family))
    return found.select(
        "doc_id",
        F.size(c).cast("long").alias("n_candidates"),
        (F.size("sure") + F.size("wide")).cast("long").alias("n_licenses"),
        F.size(F.filter(c, lambda x: x.family == UNKNOWN)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(families)), ",").alias("families"),
    )
