"""Licence scans: a trained paragraph classifier, calibrated against unknown text, confirmed by templates.

Paragraphs are lines.  Their words (letters and digits, lower-cased) give unigrams and bigrams; those
of the templates are the features of a sparse softmax regression over licence families and a class
``unknown``.  It is trained here, on the templates with words dropped, on mixtures, and on word
salads of their own words and of common ones, and its temperature is set on held-out samples of the
same kind so that the probability of a family means what it says.  A paragraph whose best family is
probable enough is confirmed where its words contain a template of the family nearly whole and, of the
words that tell like licences apart (Affero, Lesser, ND, version numbers), those of the template and no others.

A paragraph without one word that is typical of licences (its features alone could not lift a family
over ``unknown``) needs no scoring, which is most.

Edge cases: a null or blank text has no paragraphs; a null id is kept; repeated rows stay; a paragraph
of any length is scored once per window of ``WINDOW`` words, half overlapping, so a notice inside long
text is found; windows also run over the lines between two blank ones, so a wrapped notice is found, at
the line it begins in; each of several notices in a line is a hit; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from random import Random

import numpy as np
from pyspark.sql import DataFrame

from coterie.llm.common import small_batches

#: Short notices by family, as plain text.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "Apache License Version 2.0, January 2004", "This project is released under the Apache 2.0 license."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "MIT License", "This software is available under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
                "Licensed under the GPL, version 3 or later."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License version 2", "Licensed under the GPL, version 2."],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License version 3",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License version 3"],
    "lgpl-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License version 2.1"],
    "epl-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v 2.0", "Made available under the terms of the Eclipse Public License 2.0"],
    "isc": ["ISC License", "Licensed under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "apache-1.1": ["Licensed under the Apache License, Version 1.1.", "Apache Software License, Version 1.1"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons BY-NC 4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSD 3-Clause License", "Licensed under the BSD license."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "Released into the public domain."],
    "all-rights-reserved": ["All rights reserved.", "Copyright, all rights reserved. No part may be reproduced without permission."],
}
#: Words that are no sign of a licence by themselves.
COMMON = frozenset("the of and to a in is for with or on this that you may not use be by it as at an any are under from can into no out all part free without".split())
WINDOW = 48
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.8
_WORDS = re.compile(r"[^\W_]+")


def grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


class LicenseModel:
    def __init__(self, seed: int = 3, rounds: int = 200, rate: float = 1.0, l2: float = 1e-3):
        self.families = [*TEMPLATES, "unknown"]
        self.templates = [(f, _WORDS.findall(t.lower())) for f, ts in TEMPLATES.items() for t in ts]
        self.features = {g: i for i, g in enumerate(sorted({g for _, w in self.templates for g in grams(w)}))}
        self.telling = {w for _, t in self.templates for w in t} - COMMON
        self.bags = [(f, set(grams(w))) for f, w in self.templates]
        # Words that tell a licence from one much like it: a place that has others of them is no notice of it.
        words = [(f, frozenset(t)) for f, t in self.templates]
        self.variants = frozenset().union(*(a ^ b for f, a in words for g, b in words if f != g and len(a & b) >= 0.6 * len(a | b))) - COMMON
        rng = Random(seed)
        x, y = self._samples(rng, 60)
        self.w = np.zeros((len(self.families), len(self.features) + 1), np.float32)
        for _ in range(rounds):
            p = self._softmax(x @ self.w.T)
            p[np.arange(len(y)), y] -= 1
            self.w -= rate * (p.T @ x / len(y) + l2 * self.w)
        x, y = self._samples(rng, 20)
        z = x @ self.w.T
        self.scale = min((0.5, 1.0, 2.0, 3.0, 4.0, 6.0), key=lambda s: -np.log(self._softmax(z * s)[np.arange(len(y)), y] + 1e-12).mean())

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def _samples(self, rng: Random, n: int):
        filler = sorted(COMMON)
        every = sorted({w for _, t in self.templates for w in t})
        made = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(2, 9)))
        junk = lambda k: [made() if rng.random() < 0.6 else rng.choice(filler) for _ in range(k)]
        rows, y = [], []
        for f, t in self.templates:
            for _ in range(n):
                words = [w for w in t if rng.random() > 0.08] or t
                a, b = (rng.randrange(16), rng.randrange(16)) if rng.random() < 0.5 else (0, 0)
                rows.append(junk(a) + words + junk(b))
                y.append(self.families.index(f))
                salad = rng.choices(every, k=min(len(t), 4)) if rng.random() < 0.5 else []
                rows.append(junk(rng.randrange(1, 40)) + salad)
                y.append(len(self.families) - 1)
        return np.stack([self.vector(r) for r in rows]).astype(np.float32), np.array(y)

    def vector(self, words: list[str]) -> np.ndarray:
        v = np.zeros(len(self.features) + 1)
        v[-1] = 1
        for g in grams(words):
            if (i := self.features.get(g)) is not None:
                v[i] = 1
        return v

    def window(self, words: list[str]) -> tuple[str, float, float]:
        """(family or unknown, its probability, similarity to the family's best template)."""
        own = set(grams(words))
        known = [i for g in own if (i := self.features.get(g)) is not None]
        p = self._softmax((self.w[:, -1] + self.w[:, sorted(known)].sum(1, dtype=np.float64)) * self.scale)
        i = int(p.argmax())
        family = self.families[i]
        best = max((len(bag & own) / len(bag) for f, bag in self.bags if f == family), default=0.0)
        return family, float(p[i]), best

    def paragraph(self, line: str) -> tuple[str, float, float] | None:
        """The surest notice of a paragraph, or None."""
        return max((tuple(h[1:]) for h in self.notices([line])), key=lambda h: h[1:], default=None)

    def spans(self, words: list[str], k: int) -> list[tuple[int, int, float]]:
        """(start, end, similarity) of the places where template ``k`` stands nearly whole, apart from each other."""
        bag, size = self.bags[k][1], len(self.templates[k][1])
        if len(bag.intersection(grams(words))) < MIN_SIMILARITY * len(bag):
            return []
        n = size + size // 4
        like, a = max(((len(bag.intersection(grams(words[a : a + n]))) / len(bag), -a) for a in range(max(1, len(words) - size + 1))))
        if like < MIN_SIMILARITY:
            return []
        a, b = -a, min(-a + n, len(words))
        score = lambda x, y: len(bag.intersection(grams(words[x:y]))) / len(bag)
        while score(a + 1, b) >= like:
            a += 1
        while score(a, b - 1) >= like:
            b -= 1
        here = self.variants.intersection(words[a:b]) == self.variants.intersection(self.templates[k][1])
        return [*self.spans(words[:a], k), *([(a, b, like)] if here else []), *((b + x, b + y, z) for x, y, z in self.spans(words[b:], k))]

    def notices(self, lines: list[str]) -> list[tuple[int, str, float, float]]:
        """(line it begins in, family, probability, similarity) of each notice in lines that follow one another."""
        words, at = [], []
        for i, line in enumerate(lines):
            words += (w := _WORDS.findall(line.lower()))
            at += [i] * len(w)
        if self.telling.isdisjoint(words):
            return []
        sure, more = [], []
        starts = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1]), len(at)]
        for begin, end in zip(starts, starts[1:]):
            for a in range(begin, max(begin + 1, end - WINDOW // 2), WINDOW // 2):
                part = words[a : min(a + WINDOW, end)]
                if self.telling.isdisjoint(part):
                    continue
                family, p, like = self.window(part)
                if family != "unknown" and p >= MIN_PROBABILITY and like >= MIN_SIMILARITY:
                    found = [(z, y - x, x, y) for k, (f, _) in enumerate(self.bags) if f == family for x, y, z in self.spans(part, k)]
                    if found:
                        like, _, x, y = max(found)
                        sure.append((p, like, a + x, a + y, family))
        # What is not the window's first family, or runs over a line's end, is scored by its own words alone.
        for a in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
            part = words[a : a + WINDOW]
            if self.telling.isdisjoint(part):
                continue
            own = self.features.keys() & grams(part)
            for k, (family, bag) in enumerate(self.bags):
                if len(bag & own) < MIN_SIMILARITY * len(bag):
                    continue
                for x, y, like in self.spans(part, k):
                    got = self.window(part[x:y])
                    if got[0] == family and got[1] >= MIN_PROBABILITY:
                        more.append((y - x, like, got[1], a + x, a + y, family))
        taken: list[tuple[int, int, str, float, float]] = []
        for p, like, x, y, family in sorted(sure, reverse=True):
            if all(y <= c or x >= d or family != f for c, d, f, _, _ in taken):
                taken.append((x, y, family, p, like))
        for _, like, p, x, y, family in sorted(more, reverse=True):
            if all(y <= c or x >= d for c, d, _, _, _ in taken):
                taken.append((x, y, family, p, like))
        return [(at[x], family, p, like) for x, _, family, p, like in sorted(taken)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, float, float]]]:
        """The number of lines with words or signs, and the notices, with the line each begins in."""
        n, run, hits = 0, [], []
        for line in [*(text or "").split("\n"), ""]:
            if line.strip():
                run.append(line)
            elif run:
                hits += [(n + i, *h) for i, *h in self.notices(run)]
                n, run = n + len(run), []
        return n, hits


_MODELS: list[LicenseModel] = []


def model() -> LicenseModel:
    """Trained once, at the driver, on fixed samples; a few thousand weights."""
    if not _MODELS:
        _MODELS.append(LicenseModel())
    return _MODELS[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: paragraphs, those that are licence notices, their families (sorted, comma-separated), and the hits."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    hit = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    m = model()

    def run(batches):
        for b in batches:
            n, hits = [], []
            for t in b.column(1).to_pylist():
                lines, found = m.scan(t)
                n.append(lines)
                hits.append([{"paragraph": i, "family": f, "probability": round(p, 6), "similarity": round(like, 6)} for i, f, p, like in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array([",".join(sorted({x["family"] for x in h})) for h in hits], pa.string()), pa.array(hits, hit)],
                names=[id_col, "n_paragraphs", "n_licenses", "families", "hits"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(
        run, f"`{id_col}` {kind}, n_paragraphs bigint, n_licenses bigint, families string, hits array<struct<paragraph:int,family:string,probability:double,similarity:double>>"
    )


QUERY = "op6_license_scan"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return scan(table(spark, sf_dir, "documents"))
