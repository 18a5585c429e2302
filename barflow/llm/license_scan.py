"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
#: Shingles of a window, its step over a document, and the bands of one row each that a window of a long template has.
SPAN = 16
STEP = 8
BANDS = 4
CONTAINED = 0.8
HIT = "array<struct<license:string,containment:double,first_word:int,places:int>>"

#: Notices and grants of public licenses, worded as published.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Notices of fewer than WORDS words, found as whole word sequences only.
PHRASES = {"All rights reserved": "All rights reserved."}

_MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 63) - 1) | 1 for i in range(BANDS)]


def let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is made once. A plain column of a projection would be put into each lambda that names it, and made anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: F.Column) -> F.Column:
    """Hashes of the lower-cased runs of letters and digits; null has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles_of(hashed: F.Column) -> F.Column:
    """64-bit hashes of all shingles of five words; fewer words have none."""
    last = F.size(hashed) - WORDS
    positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WORDS)]))


def _bands(window: F.Column) -> F.Column:
    """Band keys of a window: for each hash function, the smallest value over the window, tagged with the function."""
    return F.array(*[F.xxhash64(F.lit(band), F.array_min(F.transform(window, _permuted(band)))) for band in range(BANDS)])


def _permuted(band: int):
    """Another order of the hashes for each band: shifted by xor, which keeps them distinct."""
    return lambda x: x.bitwiseXOR(F.lit(_MULTIPLIERS[band])) if band else x


def window_keys(shingles: F.Column, step: int) -> F.Column:
    """Band keys of the windows of SPAN shingles at every ``step``; the last window ends with the text, a shorter text has none."""
    last = F.size(shingles) - SPAN + 1
    starts = F.when(last >= 1, F.array_union(F.sequence(F.lit(1), last, F.lit(step)), F.array(last))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda s: let(F.slice(shingles, s, SPAN), _bands)))


def index_templates(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Shingles and band keys of each template, gathered to the driver: their number is a setting, not data.

    A template of fewer than SPAN shingles is retrieved by windows of one shingle, whose MinHash is the shingle in every band; a longer one by
    windows of SPAN at every offset, so that an unchanged stretch of SPAN + STEP shingles holds a window of the document that also is one of the template.
    A template under five words raises ValueError: it is a phrase, see :func:`scan`.
    """
    short = [name for name, text in templates.items() if len(re.findall(r"[^\W_]+", text)) < WORDS]
    if short:
        raise ValueError(f"templates under {WORDS} words: {short}")
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    ordered = let(word_hashes(F.col("text")), shingles_of)
    made = rows.select("name", ordered.alias("ordered"), F.array_distinct(let(ordered, lambda sh: window_keys(sh, 1))).alias("keys")).collect()
    return [r.asDict() | {"shingles": list(dict.fromkeys(r["ordered"]))} for r in sorted(made)]


def index_phrases(spark: SparkSession, phrases: dict[str, str]) -> list[dict]:
    """Number of words and hash of the whole word sequence of each phrase, gathered to the driver. A phrase without words raises ValueError."""
    if not phrases:
        return []
    rows = spark.createDataFrame(list(phrases.items()), "name string, text string")
    made = rows.select("name", let(word_hashes(F.col("text")), lambda h: F.struct(F.size(h).alias("words"), h.alias("hashes"))).alias("p")).select("name", "p.words", "p.hashes").collect()
    if empty := [r["name"] for r in made if not r["words"]]:
        raise ValueError(f"phrases without words: {empty}")
    return [r.asDict() for r in sorted(made)]


def _said(hashed: F.Column, phrase: dict) -> F.Column:
    """Row of a phrase for a text with these word hashes; null where its words do not stand in a row."""
    own = phrase["hashes"]
    starts = F.filter(
        F.transform(hashed, lambda x, i: F.when(x == own[0], F.when(_all(F.get(hashed, i + k) == own[k] for k in range(1, len(own))), i))), lambda i: i.isNotNull()
    )
    row = lambda at: F.when(F.size(at) > 0, F.struct(F.lit(phrase["name"]).alias("license"), F.lit(1.0).alias("containment"), F.get(at, F.lit(0)).alias("first_word"), F.size(at).alias("places")))
    return F.when(F.array_contains(hashed, own[0]), let(starts, row))


def _all(tests) -> F.Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _literal(values: list[int]) -> F.Column:
    """One constant for a whole list: an array of thousands of constants takes the optimizer seconds."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def scan(
    df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text", contained: float = CONTAINED, phrases: dict[str, str] | None = None
) -> DataFrame:
    """One row (id, license, containment, first_word, places) for each row of ``df`` and template that its text contains.

    containment is the largest share of the template's distinct shingles within one stretch of the text, a quarter longer than the template at either end;
    first_word the place of the first stretch that reaches ``contained``, counted in words from 0; places how many starts of such stretches there are.

    Short templates are always retrieved. For a long one, a window that overlaps a template window with Jaccard likeness j is missed with probability
    (1 - j)^4: 0.2 % at 0.8, and a copy has a window for every eight shingles. Null and empty texts contain nothing, those under five words no template.
    ``phrases`` are notices of any number of words that count only as their whole word sequence, with containment 1; texts under five words have them too.
    Null and repeated ids keep their rows. Texts are scanned whole; rows are never shuffled. Other columns are not looked at.
    """
    index = index_templates(df.sparkSession, TEMPLATES if templates is None else templates)
    said = index_phrases(df.sparkSession, phrases or {})
    long_ = [t for t in index if len(t["ordered"]) >= SPAN]
    short = [t for t in index if len(t["ordered"]) < SPAN]
    all_keys, all_shingles = (_literal(sorted({k for t in part for k in t[name]})) for part, name in ((long_, "keys"), (short, "shingles")))

    def found(sh: F.Column, keys: F.Column) -> F.Column:
        met = [
            F.when(F.arrays_overlap(keys if t in long_ else sh, _literal(t["keys"] if t in long_ else t["shingles"])),
                   F.struct(F.lit(t["name"]).alias("license"), _literal(t["shingles"]).alias("own"), F.lit(len(t["ordered"])).alias("length")))
            for t in index
        ]
        rated = F.transform(F.filter(F.array(*met), lambda t: t.isNotNull()), lambda t: _rated(t, sh, contained))
        return F.filter(rated, lambda r: r["places"] > 0)

    def hits(sh: F.Column) -> F.Column:
        retrieved = lambda keys: F.when(F.arrays_overlap(keys, all_keys) | F.arrays_overlap(sh, all_shingles), found(sh, keys))
        return let(F.array_distinct(window_keys(sh, STEP)), retrieved)

    def rows_of(h: F.Column) -> F.Column:
        own = let(shingles_of(h), hits)
        if not said:
            return own
        return F.concat(F.coalesce(own, F.array().cast(HIT)), F.filter(F.array(*[_said(h, p) for p in said]).cast(HIT), lambda r: r.isNotNull()))

    # an outer explode: Spark would push the test for hits of a plain one below, and make the hits twice
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.explode_outer(let(word_hashes(F.col(f"`{text}`")), rows_of)).alias("hit_"))
    return rows.where("hit_ IS NOT NULL").select(id_col, "hit_.*")


def _rated(template: F.Column, sh: F.Column, contained: float) -> F.Column:
    """Containment of a template in each stretch of the text that one of its shingles points to."""
    spots = F.filter(F.transform(sh, lambda x, i: F.struct(i.alias("at"), F.array_position(template["own"], x).cast("int").alias("nth"))), lambda s: s["nth"] > 0)
    starts = F.array_distinct(F.transform(spots, lambda s: s["at"] - s["nth"] + 1))
    slack = F.ceil(template["length"] / 4).cast("int")
    reach = lambda s: F.slice(sh, F.greatest(s - slack, F.lit(0)) + 1, template["length"] + 2 * slack)
    share = lambda s: F.size(F.array_intersect(template["own"], reach(s))) / F.size(template["own"])
    kept = F.filter(F.transform(starts, lambda s: F.struct(share(s).alias("share"), F.greatest(s, F.lit(0)).alias("at"))), lambda r: r["share"] >= contained)
    return let(kept, lambda k: F.struct(
        template["license"].alias("license"), F.array_max(F.transform(k, lambda r: r["share"])).alias("containment"),
        F.array_min(F.transform(k, lambda r: r["at"])).alias("first_word"), F.size(k).alias("places"),
    ))
