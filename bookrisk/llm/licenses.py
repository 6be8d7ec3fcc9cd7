"""License scans by MinHash bands over text windows (DataFrame functions only).

Text and templates are lower-cased words (letters and digits), hashed as
five-word shingles. Templates of n shingles are sought in windows of
n + g - 1 shingles that start every g = max(1, n // 4) places, so that n
consecutive shingles always lie whole in some window. Where a window holds
``MIN_CONTAINMENT`` = 0.8 of a template, their Jaccard similarity is at least
0.8 n / (n + g - 1 + 0.2 n) > 0.55; with 24 bands of 2 rows such a pair meets
in a band with probability 1 - (1 - 0.55^2)^24 > 0.9998. Band mates are
verified by the exact share of the template's shingles in the window.

Shingles that no template has cannot add to a share: they are left out of a
window before it is hashed (which only raises the similarity), and windows
with too few others for 0.8 of any template are not hashed; nothing else is
left out. Licenses share wordings: where matches of several licenses meet,
each place belongs to the one that holds most shingles there (then the
highest containment), and a match counts if it reaches 0.8 with the places
of its own license. So the notice of GPL-2.0 is not reported as GPL-3.0 too.

Defined results: null or empty text and texts of fewer than five words match
nothing, nor do templates of fewer than five words; repeated rows and rows
with equal ids give one row per id and license; null ids count as one id; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.llm.common import let

SHINGLE = 5
MIN_CONTAINMENT = 0.8
BANDS, ROWS = 24, 2
#: Templates go to every task: at most so many characters of them in all.
MAX_TEMPLATE_CHARS = 2_000_000

# ---- fixed values: notices by which works state their license
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Further notices; whole texts are in ``license_texts``.
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as "
        "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_OLD = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published "
        "by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
NOTICES = (
    ("AGPL-3.0", _GNU.format("Affero General", 3)),
    ("LGPL-3.0", _GNU.format("Lesser General", 3)),
    ("GPL-2.0", _GNU.format("General", 2)),
    ("GPL-2.0", _OLD.format("program", "General", 2)),
    ("LGPL-2.1", _OLD.format("library", "Lesser General", "2.1")),
    ("LGPL-2.0", _OLD.format("library", "Library General", 2)),
    *[(f"{a}-{v}.0", f"This work is licensed under the GNU {b} Public License, version {v}.")
      for a, b, v in (("AGPL", "Affero General", 3), ("LGPL", "Lesser General", 3), ("GPL", "General", 2))],
    *[(f"CC-{a.upper()}-4.0", f"This work is licensed under a Creative Commons Attribution-{b} 4.0 International License.")
      for a, b in (("by-nc", "NonCommercial"), ("by-nd", "NoDerivatives"), ("by-nc-sa", "NonCommercial-ShareAlike"),
                   ("by-nc-nd", "NonCommercial-NoDerivatives"))],
    *[(f"CC-{a}-4.0", f"Licensed under CC {a} 4.0.") for a in ("BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
                "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
                "is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("Artistic-1.0-Perl", "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming "
                          "language system itself."),
)
# ----
ALL = (*TEMPLATES, *NOTICES, *sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in (files(__package__) / "license_texts").iterdir()))


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; empty below five words."""
    def of(words: Column) -> Column:
        starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), of)


def bands(window: Column) -> Column:
    """Band keys of a MinHash signature of a shingle array."""
    def low(i: int) -> Column:
        return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(i))))
    return F.array(*[F.xxhash64(F.lit(b), *[low(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def member(hashes: list[int]) -> Callable[[Column], Column]:
    """Whether a hash is one of ``hashes``: these lie in buckets by remainder,
    about one in each, in one constant (not an expression for each hash, which
    takes the planner a minute)."""
    size = 1 << len(hashes).bit_length()
    buckets: list[list[int]] = [[] for _ in range(size)]
    for h in hashes:
        buckets[h % size].append(h)
    constant = F.from_json(F.lit(json.dumps({"b": buckets}, separators=(",", ":"))), "b array<array<long>>")["b"]
    return lambda h: F.array_contains(F.get(constant, F.pmod(h, F.lit(size)).cast("int")), h)


def template_table(spark: SparkSession, templates=ALL) -> DataFrame:
    """(license, t_sh, n, g) of the templates; raises above the size bound."""
    if sum(len(t) for _, t in templates) > MAX_TEMPLATE_CHARS:
        raise ValueError("templates are sent to every task: split them into several scans")
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(templates)], "license string, text string, template int")
    df = df.select("license", "template", shingles(F.col("text")).alias("t_sh"))
    n = F.size("t_sh")
    return df.where(n > 0).select("license", "template", "t_sh", n.alias("n"), F.greatest(F.lit(1), F.floor(n / 4)).cast("int").alias("g"))


def scan(docs: DataFrame, templates=ALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, windows): one row per
    document and license found."""
    spark = docs.sparkSession
    rows = template_table(spark, templates).withColumns({"t_sh": F.array_distinct("t_sh"), "d": F.size(F.array_distinct("t_sh"))}).collect()
    known = spark.createDataFrame(rows, "license string, template int, t_sh array<long>, n int, g int, d int")
    marks = sorted({h for r in rows for h in r["t_sh"]})
    need: dict[tuple[int, int], int] = {}  # shingles of templates that a window of the class must hold
    for r in rows:
        c = (r["n"], r["g"])
        need[c] = min(need.get(c, r["d"]), math.ceil(MIN_CONTAINMENT * r["d"] - 1e-9))
    classes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(g).alias("g"), F.lit(x).alias("need")) for (n, g), x in sorted(need.items())])

    d = docs.select(F.col(id_col).alias("doc_id"), shingles(F.col(text_col).cast("string")).alias("sh"))
    # shingles that some template has, null elsewhere, and their 0-based places
    has = member(marks)
    d = d.select("doc_id", F.transform("sh", lambda h: F.when(has(h), h)).alias("sh"))
    d = d.withColumn("at", F.filter(F.transform("sh", lambda h, i: F.when(h.isNotNull(), i)), lambda p: p.isNotNull()))
    d = d.where(F.size("at") > 0).withColumn("row", F.monotonically_increasing_id())
    w = d.select("doc_id", "row", "sh", "at", F.explode(F.filter(classes, lambda c: F.size("at") >= c["need"])).alias("c"))
    w = w.select("doc_id", "row", "sh", "at", "c.n", "c.g", "c.need")
    span = F.col("n") + F.col("g") - 1
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(
        F.greatest(F.ceil((p - span + 1) / F.col("g")), F.lit(0)).cast("int"), F.floor(p / F.col("g")).cast("int")))))

    def window(j: Column) -> Column:
        return let(F.slice("sh", j * F.col("g") + 1, span), lambda x: F.struct(
            j.alias("j"), (j * F.col("g")).alias("start"), x.alias("seg"), F.array_distinct(F.array_compact(x)).alias("win")))
    full = F.filter(F.transform(starts, window), lambda x: F.size(x["win"]) >= F.col("need"))
    w = w.select("doc_id", "row", "n", F.explode(full).alias("x")).select("doc_id", "row", "n", "x.*").withColumn("keys", bands(F.col("win")))
    t = known.select("license", "template", "n", "d", "t_sh", bands(F.col("t_sh")).alias("t_keys"))
    met = w.join(F.broadcast(t), (w["n"] == t["n"]) & F.arrays_overlap("keys", "t_keys"))
    met = met.select("doc_id", "row", "license", "template", "d", "j", "start", "seg", F.size(F.array_intersect("win", "t_sh")).alias("found"))
    met = met.where(F.col("found") / F.col("d") >= MIN_CONTAINMENT)

    # every place belongs to the license that holds most shingles there, then the highest containment;
    # a match must reach the share with the places of its license
    places = met.select("doc_id", "row", "license", "template", "d", "j", "start", "found", F.posexplode("seg").alias("o", "h"))
    places = places.join(F.broadcast(known.select("template", F.explode("t_sh").alias("h"))), ["template", "h"])
    one = F.struct("found", (F.col("found") / F.col("d")).alias("containment"), "license", "template", "doc_id", "d", "j", "start", "h")
    held = places.select("row", (F.col("start") + F.col("o")).alias("p"), one.alias("one")).groupBy("row", "p").agg(F.collect_list("one").alias("all"))
    best = let(F.array_max(F.transform("all", lambda x: F.struct(x["found"], x["containment"], x["license"]))),
               lambda b: F.filter("all", lambda x: x["license"] == b["license"]))
    own = held.select("row", F.explode(best).alias("one")).select("row", "one.*")
    own = own.groupBy("doc_id", "row", "license", "template", "j", "start", "d", "containment").agg(F.count_distinct("h").alias("left"))
    return own.where(F.col("left") / F.col("d") >= MIN_CONTAINMENT).groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"),
        F.count_distinct("row", "template", "j").alias("windows"))
