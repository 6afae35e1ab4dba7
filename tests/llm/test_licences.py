import math
import re
from collections import Counter

import pytest

from keystrata.llm.licences import MOST_LINES, TEMPLATES, THRESHOLD, _line_counts, _window_terms, scan_licences, terms_of

FILES = [
    (1, "repo/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (2, "repo/src/a.py", "import os\nprint(1)"), (3, "repo/src/deep/er/b.py", "# Licensed under the Apache License, Version 2.0.\nx"), (4, "repo/vendor/COPYING.txt", "GNU General Public License\nVersion 3, 29 June 2007"),
    (5, "repo/vendor/lib/c.c", "int main"), (6, "other/d.txt", "no notice here, the public is free to use it"), (7, "top.txt", None), (8, None, "Released under the MIT License."), (9, "repo/src/a.py", "import os\nprint(1)"),
    (10, "repo/long.txt", "the of and " * 20_000 + "\nThis work is licensed under the GNU General Public License, version 3."), (11, "", ""), (12, "repo/vendor", "plain"), (None, "repo/src/z.py", "z"),
    (20, "bsd/a.c", "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */\nint x;"),
    (21, "gpl/b.c", "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\nint y;"),
    (22, "gpl/c.txt", "intro\nThis work is licensed under the GNU General Public License,\nversion 3\nend"), (23, "cc/d.md", "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License"),
    (24, "press/e.txt", "The MIT Press acquired a license to translate the novel"), (25, "twice/f", "Released under\nthe MIT License"), (26, "twice/f", "Released under\nthe MIT License"),
    (13, "noise/e.txt", "the of and in to " * 30), *((100 + k, f"noise/n{k}.txt", "this is the text of a work and its terms\nof the form\n" * 3) for k in range(40)),
]


def brute_own(files):
    units, lines, df = [], 0, Counter()
    for k, (_, path, text) in enumerate(files):
        parts = (text or "").split("\n")
        lines += len(parts)
        for line in parts:
            df.update(set(terms_of(line)))
        units += [(k, no, size, terms_of("\n".join(parts[no : no + size]))) for size in range(1, MOST_LINES + 1) for no in range(len(parts) - size + 1)]
        if re.match(r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$", (path or "").split("/")[-1]):
            units.append((k, -1, len(parts), terms_of(text or "")))
    vector = lambda terms: {t: (1 + math.log(c)) * math.log((lines + 1) / (df[t] + 1)) for t, c in Counter(terms).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, u, norm(u)) for name, texts in TEMPLATES.items() for u in map(vector, map(terms_of, texts))]
    best = {}
    for k, no, size, terms in units:
        v = vector(terms)
        for name, u, length in templates:
            if length and norm(v):
                score = round(sum(v[t] * u.get(t, 0) for t in v) / length / norm(v), 6)
                if score >= THRESHOLD:
                    best.setdefault(k, []).append((-score, size, no, name))
    return {k: min(x) for k, x in best.items()}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(*f, "x", "y") for f in FILES], "id long, path string, text string, term string, dir string").repartition(3)


def test_own_licences_against_brute_force(spark, files):
    got = {(r.id, r.path): (r.own_licence, r.score, r.line_no, r.n_lines) for r in scan_licences(spark, files).collect()}
    want = brute_own(FILES)
    for k, (file_id, path, _) in enumerate(FILES):
        own = got[file_id, path or ""]
        assert own == ((want[k][3], pytest.approx(-want[k][0], abs=2e-6), want[k][2], want[k][1]) if k in want else (None, None, None, None))


def test_inheritance_from_the_nearest_directory(spark, files):
    got = {r.id: (r.licence, r.inherited_from) for r in scan_licences(spark, files).collect()}
    assert len(got) == len(FILES)
    assert got[1] == ("MIT", None) and got[2] == ("MIT", "repo") and got[9] == ("MIT", "repo") and got[None] == ("MIT", "repo")
    assert got[3] == ("Apache-2.0", None) and got[4] == ("GPL-3.0", None) and got[5] == ("GPL-3.0", "repo/vendor") and got[12] == ("MIT", "repo")
    assert got[6] == (None, None) and got[7] == (None, None) and got[8] == ("MIT", None) and got[10] == ("GPL-3.0", None)


def test_wrapped_notices_and_prose(spark, files):
    got = {r.id: (r.own_licence, r.line_no, r.n_lines) for r in scan_licences(spark, files).collect()}
    assert got[20] == ("BSD-3-Clause", 0, 3) and got[21] == ("GPL-3.0", 0, 4) and got[22] == ("GPL-3.0", 1, 2) and got[23] == ("CC-BY-NC-4.0", 0, 2)
    assert got[24] == (None, None, None) and got[25] == got[26] == ("MIT", 0, 2)


def test_directories_spoken_for_by_headers(spark, files):
    got = {r.id: (r.licence, r.inherited_from) for r in scan_licences(spark, files, by_header=True).collect()}
    assert got[6] == ("MIT", "") and got[2] == ("MIT", "repo") and got[7] == ("MIT", "")


def test_runs_without_python(spark, files):
    for step in (scan_licences(spark, files), _line_counts(files), _window_terms(files, {"mit", "licensed"})):
        plan = step._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark, files):
    assert scan_licences(spark, files.limit(0)).collect() == []
