"""Rows that the operators once left out."""

import math
import random
import re
from collections import Counter

import pytest

from tagwise.llm.license_scan import TEMPLATES, Matcher, licence_texts, scan_files, words_of
from tagwise.llm.url_filter import BLOCK_WORDS, Lexicon, judge_urls


def name(i):
    """A word of five letters for each number."""
    return "".join(chr(97 + i // 26**k % 26) for k in range(5))


# Urls

def test_url_lexicon_and_weights_have_no_bound(spark):
    """60,000 words of equal frequency: more than the lexicon once held."""
    words = [name(7 * i) for i in range(60_000)]
    rows = [(i, f"http://{words[9 * i]}{words[11 * i + 5]}.net/{words[i]}{'casino' if i % 3 == 0 else 'garden'}", " ".join(words[i * 600:(i + 1) * 600])) for i in range(100)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), []).collect()}
    lexicon = Lexicon(Counter(w for *_, t in rows for w in t.split()))
    split = [[w for run in re.findall("[a-z]+", url.split("://")[1]) for w in lexicon.split(run)] for _, url, _ in rows]
    bad = [any(w in BLOCK_WORDS for w in ws) for ws in split]
    n, b = Counter(w for ws in split for w in ws), Counter(w for ws, x in zip(split, bad, strict=True) for w in ws if x)
    b_all, n_all, v = sum(b.values()), sum(n.values()), len(n)
    weight = {w: math.log((b[w] + .5) / (b_all + .5 * (v + 1))) - math.log((n[w] - b[w] + .5) / (n_all - b_all + .5 * (v + 1))) for w in n}
    prior = math.log((sum(bad) + .5) / (len(rows) - sum(bad) + .5))
    assert split[1][:2] == [words[9], words[16]]
    for i, ws in enumerate(split):
        assert got[i].words == ws
        assert got[i].log_odds == pytest.approx(prior + sum(weight[w] for w in ws))


# Licences

MIT = next(t for name, t in licence_texts() if name == "MIT")
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
"""


def test_wrapped_headers_and_whole_licence_files(spark):
    code = "\n".join(f"def f{i}(x): return the_{i} of this and that" for i in range(40))
    lesser = GPL.replace("GNU General", "GNU Lesser General").replace("(at", "  (at")
    files = [("g.py", GPL + code), ("b.c", BSD + code), ("one.py", code + MIT.replace("\n", " ")), ("mit/LICENSE", "Copyright (c) 2020 Jane Roe\n" + MIT), ("mit/sub/x.py", code),
             ("flat/LICENSE", MIT.replace("\n", " ")), ("flat/x.py", code), ("x.py", code), ("l.py", lesser + code), ("s.py", "x under the MIT License y " + code),
             *[(f"{name}/COPYING", t) for name, t in licence_texts()], *[(f"{name}/x.py", code) for name, _ in licence_texts()]]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.path: r for r in scan_files(df, "doc_id", "path", "text").collect()}
    assert [got[p].own for p in ("g.py", "b.c", "one.py", "l.py", "mit/LICENSE", "flat/LICENSE")] == ["GPL-3.0", "BSD-3-Clause", "MIT", "LGPL-3.0", "MIT", "MIT"]
    assert [got[p].license for p in ("mit/sub/x.py", "flat/x.py", "x.py", "s.py")] == ["MIT", "MIT", None, None]
    for name, _ in licence_texts():
        assert (got[f"{name}/COPYING"].own, got[f"{name}/x.py"].license, got[f"{name}/x.py"].inherited_from) == (name, name, name)


def test_runs_match_brute_force():
    r = random.Random(6)
    m = Matcher(TEMPLATES, 1000, {"the": 900, "of": 800, "this": 500, "under": 90, "license": 40, "and": 700}, 0.75)
    for _ in range(300):
        i = r.randrange(len(TEMPLATES))
        t = words_of(TEMPLATES[i][1])
        words = ["the", "code"] * r.randrange(5) + [w if r.random() < 0.9 else "other" for w in t] + ["of", "this"] * r.randrange(5)
        least = 0.95 if len(t) < 8 else 0.75
        v, n = m.vectors[i][1], min(len(t), len(words))
        cosines = [sum(x * v.get(w, 0) for w, x in m._vector(words[a:a + n]).items()) for a in range(len(words) - n + 1)]
        got = next(m.runs(words, i), None)
        assert (got is not None) == (max(cosines) >= least)
        assert got is None or got[0] == pytest.approx(max(cosines))
