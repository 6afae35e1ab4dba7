"""Licences of files by sparse TF-IDF cosine to templates, then inheritance along the path. DataFrame functions only.

Every window of up to ``MOST_LINES`` consecutive lines of every file (and, of a licence file, also its whole text) is
a vector over all its terms, so a notice may be wrapped and ordinary prose that shares a few terms with a template
stays far from it. A term weighs (1 + ln tf) * idf, with idf = ln((lines + 1) / (lines with the term + 1)) over all
lines of all files. The window with the greatest cosine to a template decides, if it reaches ``threshold`` (ties: the
fewest lines, then the earliest, then the licence by name). Before scoring, windows without any strong term are left
out: terms are weak as long as weak terms alone can't reach the threshold with any template, so no window is lost.

A directory's licence is the one that most of its licence files name; if it has none and ``by_header`` is set,
the one that most of its files' lines name (ties by name). A file without a licence of its own takes that of
its nearest ancestor directory that has one.

Line counts per term, the terms of the windows left and the files' own licences are tables in the shared folder; the
first two go once the third is written. Frequent terms meet their counts under salted keys.

Defined results: a null text counts as empty, a null path as the root directory's nameless file; files without any
licence around have nulls. Rows that repeat path and text have equal results. An empty table gives no rows;
other columns are ignored. Only counts of the templates' terms (fewer than ``MOST_TERMS``) reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.skew import meet
from keystrata.llm.text import text_or_empty
from keystrata.sources.shared import discard, fresh_folder

# Usual titles and notices of licences, in the words of their publishers.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": ["Eclipse Public License v 2.0"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"],
    "ISC": ["Released under the ISC License", "ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$"
THRESHOLD = 0.75
#: The longest notice among the templates takes four lines of 70 characters.
MOST_LINES = 4
MOST_TERMS = 1000
SEPARATOR = "[^a-z0-9]+"
SALTS = 32


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(SEPARATOR, text.lower()) if t]


def vocabulary() -> list[str]:
    out = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms_of(x)})
    if len(out) > MOST_TERMS:
        raise ValueError("too many template terms")
    return out


def _line_counts(files: DataFrame) -> DataFrame:
    """(term, lines): lines with the term; the empty term counts all lines."""
    lines = files.select(F.explode(F.split("text", "\n")).alias("line"))
    terms = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("line"), SEPARATOR)))
    return lines.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("lines"))


def one_of(words: set[str]) -> str:
    """A pattern of the words that reads what several begin with once, not once a word."""
    heads = sorted({w[:1] for w in words}, reverse=True)
    return f"(?:{'|'.join(h + one_of({w[1:] for w in words if w[:1] == h}) if h else '' for h in heads)})"


def _holds(text: Column, strong: set[str]) -> Column:
    """Whether one of the terms is in the text."""
    return F.lower(text).rlike(f"(^|[^a-z0-9]){one_of(strong)}([^a-z0-9]|$)") if strong else F.lit(False)


def _window_terms(files: DataFrame, strong: set[str]) -> DataFrame:
    """(path, content, line_no, n_lines, term, tf) of the windows that hold a strong term; line -1 is a licence file's whole text."""
    rows = files.filter(_holds(F.col("text"), strong)).select("path", F.xxhash64("text").alias("content"), "text").dropDuplicates(["path", "content"])
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    rows = rows.select("path", "content", "text", F.split("text", "\n").alias("lines"), named.alias("named"))
    n = F.size("lines")

    def window(first: Column, size: Column, text: Column) -> Column:
        return F.struct(first.cast("int").alias("line_no"), size.cast("int").alias("n_lines"), text.alias("text"))

    def of_size(size: int) -> Column:
        firsts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda k: window(k - 1, F.lit(size), F.array_join(F.slice("lines", k, F.lit(size)), "\n")))

    whole = F.when(F.col("named"), F.array(window(F.lit(-1), n, F.col("text")))).otherwise(F.array().cast("array<struct<line_no:int,n_lines:int,text:string>>"))
    windows = F.concat(whole, *(of_size(k + 1) for k in range(MOST_LINES)))
    each = rows.select("path", "content", F.inline(windows)).filter(_holds(F.col("text"), strong))
    key = ["path", "content", "line_no", "n_lines"]
    return each.select(*key, F.explode(F.split(F.lower("text"), SEPARATOR)).alias("term")).filter("term <> ''").groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _weights(counts: DataFrame) -> tuple[int, list[tuple[str, int, str, float]], set[str]]:
    """The number of lines, template vectors of length one, and the strong terms."""
    df = {r["term"]: r["lines"] for r in counts.filter(F.col("term").isin(["", *vocabulary()])).collect()}
    n = df.pop("", 0)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) for t in vocabulary()}
    vectors, shares = [], []
    for name, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            weights = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(terms_of(text)).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            if norm > 0:
                vectors += [(name, k, t, w / norm) for t, w in weights.items()]
                shares.append({t: (w / norm) ** 2 for t, w in weights.items()})
    strong = set(idf)
    for t in sorted(idf, key=lambda t: (idf[t], t)):
        weak = (set(idf) - strong) | {t}
        if all(math.sqrt(sum(v for x, v in s.items() if x in weak)) < THRESHOLD * 0.999 for s in shares):
            strong.discard(t)
        else:
            break
    return n, vectors, strong


def own_licences(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, content, own_licence, score, line_no, n_lines) of files whose best window reaches the threshold."""
    folder = fresh_folder(spark, "licences")
    _line_counts(files).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    n, vectors, strong = _weights(counts)
    _window_terms(files, strong).write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    key = ["path", "content", "line_no", "n_lines"]
    weight = (1 + F.log("tf")) * F.log((F.lit(n) + 1) / (F.col("lines") + 1))
    weighed = meet(terms, counts, "term", "path").select(*key, "term", weight.alias("weight"))
    # A row per template term: a fixed size.
    vectors = spark.createDataFrame(vectors, "licence string, template int, term string, unit double")
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy(*key, "licence", "template").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    scored = dots.join(norms, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= THRESHOLD)
    best = F.min(F.struct((-F.col("score")).alias("lost"), "n_lines", "line_no", F.col("licence").alias("own_licence"))).alias("best")
    own = scored.groupBy("path", "content").agg(best).select("path", "content", "best.own_licence", (-F.col("best.lost")).alias("score"), "best.line_no", "best.n_lines")
    own.write.parquet(f"{folder}/own")
    discard(spark, f"{folder}/counts")
    discard(spark, f"{folder}/terms")
    return spark.read.parquet(f"{folder}/own")


def directory(path: Column) -> Column:
    """The path without its last name; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def directory_licences(own: DataFrame, by_header: bool) -> DataFrame:
    """(dir, dir_licence): the licence most files that speak for a directory name."""
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    votes = own.select(directory(F.col("path")).alias("dir"), "own_licence", named.alias("named"))
    votes = votes if by_header else votes.filter("named")
    counted = votes.groupBy("dir", "named", "own_licence").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((~F.col("named")).alias("a"), (-F.col("n")).alias("b"), F.col("own_licence").alias("licence")))
    return counted.groupBy("dir").agg(first.alias("first")).select("dir", F.col("first.licence").alias("dir_licence"))


def inherited(dirs: DataFrame, licences: DataFrame) -> DataFrame:
    """(dir, from_dir, dir_licence): for each directory its nearest ancestor (itself included) that has a licence."""
    names = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(names))), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    pairs = dirs.select("dir", F.posexplode(above).alias("depth", "from_dir"))
    found = pairs.join(licences.withColumnRenamed("dir", "from_dir"), "from_dir")
    nearest = found.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_licence")).alias("x"))
    return nearest.select("dir", F.col("x.from_dir").alias("from_dir"), F.col("x.dir_licence").alias("dir_licence"))


def scan_licences(spark: SparkSession, files: DataFrame, by_header: bool = False) -> DataFrame:
    """One row per input row (path, text): path, own_licence, score, line_no, n_lines, licence, inherited_from, and the columns carried in ``id``."""
    rows = files.select("id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), text_or_empty().alias("text"))
    own = own_licences(spark, rows)
    listed = rows.select("id", "path", F.xxhash64("text").alias("content"), directory(F.col("path")).alias("dir"))
    mine = listed.join(own, ["path", "content"], "left")
    above = inherited(listed.select("dir").distinct(), directory_licences(own, by_header))
    # A directory with most of the files meets its licence under salted keys.
    salted = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = mine.withColumn("salt", F.pmod(F.xxhash64("path", "content"), F.lit(SALTS)).cast("int"))
    joined = mine.join(salted, ["dir", "salt"], "left")
    without = F.col("own_licence").isNull()
    return joined.select("id", "path", "own_licence", "score", "line_no", "n_lines", F.coalesce("own_licence", "dir_licence").alias("licence"), F.when(without, F.col("from_dir")).alias("inherited_from"))
