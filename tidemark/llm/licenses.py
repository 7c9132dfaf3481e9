"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every whole text is searched for cue words. Around each cue, windows as long as a template are compared with that
template by the cosine of their TF-IDF vectors; the best template above the threshold is the text's own license. The
document frequency of every term of a window comes from all documents: it is counted in Spark and joined back to the
texts that have such windows. An SPDX line names its license outright. A license file stands for its directory: a
document without a license of its own takes that of the nearest directory above it that has one, found by joins on
path prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version"
)
GNU_ONLY = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} version {} as "
    "published by the Free Software Foundation"
)
CC_FILE = "Creative Commons {} 4.0 International Public License"
CC_HEADER = "This work is licensed under a Creative Commons {} 4.0 International License"
CC_VISIT = "To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/"
#: SPDX identifier -> notices by which it is named: the short forms, the standard header, and the license file's title
#: or opening; plain values, to be replaced by a caller's own. The identifier's own SPDX line needs no template.
TEMPLATES = {
    "AGPL-3.0": [
        "licensed under the GNU Affero General Public License, version 3", GNU_HEADER.format("Affero General Public License", 3),
        GNU_ONLY.format("Affero General Public License", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
        "distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under "
        "the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License",
        CC_HEADER.format("Attribution"), CC_VISIT.format("by"), CC_FILE.format("Attribution"),
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
        CC_HEADER.format("Attribution-NonCommercial"), CC_VISIT.format("by-nc"), CC_FILE.format("Attribution-NonCommercial"),
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License",
        CC_HEADER.format("Attribution-ShareAlike"), CC_VISIT.format("by-sa"), CC_FILE.format("Attribution-ShareAlike"),
    ],
    "GPL-2.0": [
        "licensed under the GNU General Public License, version 2", GNU_HEADER.format("General Public License", 2),
        GNU_ONLY.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        "licensed under the GNU General Public License, version 3", GNU_HEADER.format("General Public License", 3),
        GNU_ONLY.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-2.1": [
        "licensed under the GNU Lesser General Public License, version 2.1", GNU_HEADER.format("Lesser General Public License", 2.1),
        GNU_ONLY.format("Lesser General Public License", 2.1), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "LGPL-3.0": [
        "licensed under the GNU Lesser General Public License, version 3", GNU_HEADER.format("Lesser General Public License", 3),
        GNU_ONLY.format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "MIT": [
        "Licensed under the MIT License", "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    ],
    "MPL-2.0": [
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Mozilla Public License Version 2.0",
    ],
    "all-rights-reserved": ["All rights reserved"],
}
CUE = re.compile(r"licen[cs]e|copyright|rights reserved|redistribution|hereby granted|creative commons")
TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
SPDX = re.compile(r"spdx-license-identifier:[ \t]*\(*([a-z0-9.+-]+(?:\)*[ \t]+(?:or|and|with)[ \t]+\(*[a-z0-9.+-]+)*)")
SPDX_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*")
SPDX_END = re.compile(r"(\+|-only|-or-later)?\.?$")
THRESHOLD = 0.8
#: Terms up to which their set is sent to the workers that count; beyond it every term is counted and joined after.
LISTED = 200_000
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.\w+)?$"


def notices(templates: dict = TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(name, TOKEN.findall(text.lower())) for name in sorted(templates) for text in templates[name]]


def regions(text: str, longest: int) -> list[list[str]]:
    """Tokens around each run of cues in a lower-case text: enough on both sides for the longest template."""
    reach, runs = 16 * longest, []
    for m in CUE.finditer(text):
        if runs and m.start() <= runs[-1][1] + reach:
            runs[-1][1] = m.start()
        else:
            runs.append([m.start(), m.start()])
    return [TOKEN.findall(text[max(0, a - reach) : b + reach]) for a, b in runs]


def windows(tokens: list[str], known: list[tuple[str, list[str]]]):
    """(template, start) of every window as long as a template that holds at least half of its different terms."""
    present = set(tokens)
    for t, (_, notice) in enumerate(known):
        terms, n = set(notice), len(notice)
        if 2 * len(terms & present) < len(terms):
            continue
        held: Counter = Counter(x for x in tokens[:n] if x in terms)
        different = len(held)
        for k in range(max(1, len(tokens) - n + 1)):
            if k:
                left, come = tokens[k - 1], tokens[k + n - 1]
                if left in terms:
                    held[left] -= 1
                    different -= held[left] == 0
                if come in terms:
                    held[come] += 1
                    different += held[come] == 1
            if 2 * different >= len(terms):
                yield t, k


def spdx_name(text: str, names: dict[str, str]) -> str | None:
    """The first by name of the licenses on the SPDX lines of a lower-case text."""
    ids = (SPDX_END.sub("", w) for m in SPDX.finditer(text) for w in SPDX_WORD.findall(m[1]))
    return min((names[i] for i in ids if i in names), default=None)


def document_frequencies(docs: DataFrame, text_col: str, wanted: DataFrame) -> tuple[int, DataFrame]:
    """Number of documents and (term, docs), the number that hold it, for the wanted terms that any document holds.

    A worker adds up its documents before the shuffle. It counts the wanted terms only, if they are few enough to be
    sent to it, and else all terms, which are joined with the wanted ones afterwards; the counts are the same.
    """
    listed = [r["term"] for r in wanted.limit(LISTED + 1).collect()]
    chosen = set(listed) if len(listed) <= LISTED else None

    def count(batches):
        found: Counter = Counter()
        total = 0
        for batch in batches:
            total += batch.num_rows
            for text in batch.column("text"):
                terms = TOKEN.findall(text.as_py().lower())
                found.update(set(terms) if chosen is None else chosen.intersection(terms))
            if len(found) > LISTED:
                yield table(found.items())
                found.clear()
        yield table([(None, total), *found.items()])

    def table(items):
        terms, n = zip(*items)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["term", "docs"])

    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    sums = session.durable(texts.mapInArrow(count, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs")))
    total = sums.filter("term is null").agg(F.sum("docs")).first()[0] or 0
    return total, session.durable(sums.join(wanted, "term"))


class Matcher:
    """TF-IDF vectors of the templates, and the best of them for the windows of a text."""

    def __init__(self, known: list[tuple[str, list[str]]], total: int, docs: dict[str, int]):
        self.known, self.total = known, total
        self.docs = {t: docs.get(t, 0) for _, notice in known for t in notice}
        self.vectors = [self.vector(notice, self.docs) for _, notice in known]

    def vector(self, tokens: list[str], docs: dict[str, int]) -> tuple[dict[str, float], float]:
        v = {t: n * (math.log((self.total + 1) / (docs[t] + 1)) + 1) for t, n in Counter(tokens).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def best(self, found: list[list[str]], docs: dict[str, int]) -> tuple[str | None, float]:
        """(license, cosine) of the closest window; of equal ones the first by name."""
        name, score = None, 0.0
        for tokens in found:
            for t, k in windows(tokens, self.known):
                vector, norm = self.vectors[t]
                v, length = self.vector(tokens[k : k + len(self.known[t][1])], docs)
                cosine = round(sum(x * v.get(w, 0.0) for w, x in vector.items()) / (norm * length), 6)
                if cosine > score or cosine == score and name is not None and self.known[t][0] < name:
                    name, score = self.known[t][0], cosine
        return name, score


def own_licenses(docs: DataFrame, id_col="doc_id", text_col="text", path: Column | None = None, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, license, score): a text's own license or null, and the best cosine, one row per input row.

    An SPDX line that names a known license scores 1.
    """
    common.prepare(docs.sparkSession)
    known = notices(templates)
    names = {name.lower(): name for name in templates}
    longest = max((len(notice) for _, notice in known), default=0)

    def candidates(text: str) -> list[str]:
        kept = []
        for tokens in regions(text, longest):
            spans = [(k, k + len(known[t][1])) for t, k in windows(tokens, known)]
            if spans:
                kept.append(" ".join(tokens[min(a for a, _ in spans) : max(b for _, b in spans)]))
        return kept

    def scan(batches):
        for batch in batches:
            low = [t.as_py().lower() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "path")), pa.array([spdx_name(t, names) for t in low], pa.string()), pa.array(map(candidates, low), pa.list_(pa.string()))],
                ["row", "id", "path", "named", "regions"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"), path.cast("string").alias("path"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    rows = session.durable(rows.mapInArrow(scan, "row long, id long, path string, named string, regions array<string>"))
    held = rows.filter(F.size("regions") > 0)
    words = F.flatten(F.transform("regions", lambda r: F.split(r, " ")))
    terms = session.durable(held.select("row", F.explode(F.array_distinct(words)).alias("term")))
    own_terms = sorted({t for _, notice in known for t in notice})
    listed = docs.sparkSession.createDataFrame([(t,) for t in own_terms], "term string")
    total, counts = document_frequencies(docs, text_col, session.durable(terms.select("term").unionByName(listed).distinct()))
    matcher = Matcher(known, total, {r["term"]: r["docs"] for r in counts.filter(F.col("term").isin(own_terms)).collect()})
    # A term of many windows is in at least as many documents, so the heaviest terms are joined by broadcast.
    by_row = common.attach(terms, counts, ["term"], "docs").groupBy("row").agg(F.collect_list(F.struct("term", "docs")).alias("counted"))
    compared = held.join(by_row, "row").select("row", "id", "path", "named", "regions", F.col("counted.term").alias("terms"), F.col("counted.docs").alias("docs"))

    def score(batches):
        for batch in batches:
            found = []
            for named, texts, words, docs_of in zip(*(batch.column(c).to_pylist() for c in ("named", "regions", "terms", "docs"))):
                name, cosine = matcher.best([t.split(" ") for t in texts], dict(zip(words, docs_of)))
                if named is not None and (cosine < 1 or named < name):
                    name, cosine = named, 1.0
                found.append((name if cosine >= threshold else None, cosine))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["id", "path", "license", "score"],
            )

    others = rows.filter(F.size("regions") == 0).select("id", "path", F.col("named").alias("license"), F.when(F.col("named").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    return compared.mapInArrow(score, "id long, path string, license string, score double").unionByName(others)


def license_scan(
    docs: DataFrame, path: Column, id_col="doc_id", text_col="text", templates: dict = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(id, path, license, score, origin, license_dir), one row per input row.

    ``origin`` is ``own``, ``inherited`` or ``none``. Several license files in a directory: the highest score counts,
    then the first license by name. A null or empty text has no license of its own; a null path belongs to no
    directory. Repeated rows get equal answers; an empty table gives no rows.
    """
    own = session.durable(own_licenses(docs, id_col, text_col, path, templates, threshold))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    own = own.withColumn("dir", folder)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    files = own.filter(name.rlike(LICENSE_FILE) & F.col("license").isNotNull())
    best = Window.partitionBy("dir").orderBy(F.desc("score"), "license")
    files = files.withColumn("place", F.row_number().over(best)).filter("place = 1")
    files = session.durable(files.select(F.col("dir").alias("license_dir"), F.col("license").alias("dir_license")))
    # Ancestors are listed once for each directory, never for each document.
    folders = session.durable(own.filter("path is not null").groupBy("dir").agg(F.count("*").alias("members")))
    steps = F.split("dir", "/")
    above = folders.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("depth", "license_dir"))
    nearest = Window.partitionBy("dir").orderBy(F.desc("depth"))
    held = above.join(files, "license_dir").withColumn("place", F.row_number().over(nearest)).filter("place = 1")
    held = session.durable(folders.join(held.select("dir", "license_dir", "dir_license"), "dir", "left"))
    with_dir = common.attach(own.filter("path is not null"), held, ["dir"], "members")
    lost = own.filter("path is null").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("members", "long"), ("license_dir", "string"), ("dir_license", "string"))])
    rows = with_dir.unionByName(lost)
    mine = F.col("license").isNotNull()
    return rows.select(
        "id", "path", F.coalesce("license", "dir_license").alias("license"), "score",
        F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("license_dir")).alias("license_dir"),
    )
