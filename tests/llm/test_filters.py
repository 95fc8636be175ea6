import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagwise.llm.decontamination import Items, find_leaks, without_leaks
from tagwise.llm.license_scan import TEMPLATES, Matcher, scan_files, words_of
from tagwise.llm.pii import KINDS, boost, find_pii, fit_pii, redact, span_text
from tagwise.llm.queries import RULES
from tagwise.llm.toxicity import INSULTS, MOVES, START, ToxicityModel, clause_features, fit_toxicity
from tagwise.llm.url_filter import Lexicon, judge_urls

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# Decontamination

def brute_tiles(doc, item, k):
    """Greedy string tiling as first published: longest unmarked common run, marked, repeated."""
    dm, im, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not dm[d + n] and not im[i + n]:
                    n += 1
                best = max(best, (n, -d, -i))
        n, d, i = best[0], -best[1], -best[2]
        if n < k:
            return tiles
        tiles.append(n)
        dm[d:d + n] = [True] * n
        im[i:i + n] = [True] * n


def test_tiling_matches_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [[r.choice(vocab) for _ in range(r.choice([3, 4, 12, 25]))] for _ in range(12)]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 30, 80]))]
        item = r.choice(items)
        if i % 3 == 0:
            w = w[:10] + item + w[10:]
        elif i % 3 == 1:
            cut = len(item) // 2
            w = item[cut:] + w + item[:cut] + item[:3]
        docs.append(w)
    got = {(x.doc_id, x.item_id): x for x in find_leaks(
        spark.createDataFrame([(i, " ".join(w).upper() if i % 2 else "\n ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"), block_words=60).collect()}
    want = set()
    for d, w in enumerate(docs):
        for i, item in enumerate(items):
            tiles = brute_tiles(w, item, 4)
            if len(item) >= 4 and 100 * sum(tiles) >= 50 * len(item):
                want.add((d, i))
                assert got[d, i].longest_tile == max(tiles) and abs(got[d, i].covered_words - sum(tiles)) <= 3
    assert set(got) == want and len(want) > 15


def test_leaks_odd_rows(odd, empty):
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "id")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in find_leaks(odd, items).collect())
    assert got == sorted([(a, b) for a in ("1", "1", "None") for b in ("1", "1", "None")])
    kept = without_leaks(odd, items)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    assert find_leaks(odd, items.limit(0)).count() == 0 and find_leaks(empty, items).count() == 0
    assert without_leaks(odd, items.limit(0)).count() == 5


def test_periodic_texts_end_soon():
    block = Items([0], ["a b " * 30], 4)
    doc = np.frombuffer(b"a b " * 20000, np.uint8)
    assert [(r, i, sum(t)) for r, i, t in block.leaks(doc, np.array([0, len(doc)]), 50)] == [(0, 0, 60)]


# Personal data

def brute_base(text):
    found = []
    for k, (kind, pattern) in enumerate([
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card":
                total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def pii_texts():
    r = random.Random(5)
    bits = ["a@b.c", "x.y+z@h-1.org.uk", "@", "a@b", "+d@e.f", "1.2.3.4", "256.1.1.1", "001.2.003.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "79927398713", "0000000000000", "+1 (555) 010-9999", "+49 30 123456", "+1 2", "+123456789012345678", " ", "-", "é😀", "\n", ".", "word", "12", "(555) 010-9999", "2024-05-17"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(400)]
    return [*texts, "", None, "7 " * 3000, "a" * 3000 + "@b.co " + "1" * 3000, "a@b.co " * 200, "1.2.3.4 " * 150]


def test_base_spans_match_brute_force(spark, pii_texts):
    df = spark.createDataFrame(list(enumerate(pii_texts)), "doc_id long, text string").repartition(4)
    got = find_pii(df, fit_pii(df)).select("doc_id", span_text(F.col("base")).alias("b"), span_text(F.col("spans")).alias("s")).collect()
    for r in got:
        want = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in brute_base(pii_texts[r.doc_id] or ""))
        assert r.b == want, pii_texts[r.doc_id]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))


def test_disguised_spans_are_added_and_plain_numbers_are_not(spark):
    r = random.Random(1)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(300):
        rows.append((i, f"ab {i % 7}{num(3)} user{i}@mail{i % 9}.example.com then {r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)} of "
                        f"+1 ({num(3)}) 555-{num(4)} and code {num(8)} on 2023-0{1 + i % 9}-1{i % 9} v{i % 9}.{i % 7}.2"))
    rows += [(1000, "write to jane at mail2 dot com today"), (1001, "jane [at] mail3.example.org"), (1002, "call (415) 555-2671 now"), (1003, "in 2021-03-04 we had 12345678 units"), (1004, "host 10[.]20[.]30[.]40 is up")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.s for x in find_pii(df, fit_pii(df)).where("doc_id >= 1000").select("doc_id", span_text(F.col("spans")).alias("s")).collect()}
    assert got == {1000: "email:9:30", 1001: "email:0:27", 1002: "phone:5:19", 1003: "", 1004: "ip:5:22"}


def test_pii_odd_rows_and_redaction(spark, odd, empty):
    model = fit_pii(odd)
    got = find_pii(odd.drop("base", "spans"), model)
    assert got.count() == 5 and got.select(F.sum(F.size("spans"))).first()[0] == 0
    assert find_pii(empty, fit_pii(empty)).count() == 0
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!")], "doc_id long, text string")
    assert find_pii(df, model).select(redact(F.col("text"), F.col("spans"))).first()[0] == "é [EMAIL], [IP]!"


def test_boosting_learns_and_calibrates():
    r = np.random.default_rng(0)
    x = r.integers(0, 10, (4000, 4)).astype(float)
    x[:, 0] = r.integers(0, 4, 4000)
    y = ((x[:, 1] > 4) ^ (x[:, 2] > 6)).astype(float)
    model = boost(x, y, r.random(4000) < 0.3)
    assert all(t < 5 for t in model.thresholds)


# Toxicity

def test_transducers_follow_context():
    def walk(classes):
        state, out = START, []
        for c in classes:
            state, p = MOVES[state, c]
            if p is not None:
                out.append(p)
        return out, state[2]
    assert walk("OI") == ([0], 0) and walk("NOI") == ([1], 0) and walk("NOOOI") == ([0], 0)
    assert walk("ROOI") == ([2], 0) and walk("YOI") == ([0], 1) and walk("IY") == ([0], 1)


def test_scores_follow_patterns(spark):
    model = ToxicityModel(dict.fromkeys(INSULTS, 3.0), {"kill": 2.0}, [-4.0, *[1.0, 0.2, 0.2, 1.5, 0.3, 0.3], *[0.0, 0.0, 0.0, 1.5, 0.2, 0.2], 1.0, 1.0, 0.0])
    texts = ["you are an idiot", "you are not an idiot", "they said he was an idiot", "you fine. idiotic", None, "", "kill the process", "I will kill you", "unidiot"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = [r.s for r in df.select("doc_id", model.score(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert s[0] > s[1] and s[0] > s[2] and s[4] == s[5] < 0.1 and s[7] > s[6] and s[8] < 0.1
    assert all(0 <= x <= 1 for x in s)


def test_toxicity_learns_unknown_stems_held_out(spark):
    r = random.Random(2)
    syllables = ["an", "er", "on", "th", "ti", "es", "in", "st"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = [word() for _ in range(r.randrange(5, 60))]
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["qualm", "zorv"]) + r.choice(syllables))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, marks.where("doc_id % 5 <> 0"))
    got = docs.where("doc_id % 5 = 0").withColumn("s", model.score(F.col("text"))).collect()
    assert sum((x.s >= 0.5) == (x.doc_id % 6 == 0) for x in got) >= 0.97 * len(got)


def test_toxicity_odd_rows(odd, empty, spark):
    marks = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(odd, marks)
    got = odd.withColumn("s", model.score(F.col("text"))).collect()
    assert len(got) == 5 and all(0 <= r.s < 0.5 for r in got)
    assert empty.withColumn("s", fit_toxicity(empty, marks).score(F.col("text"))).count() == 0
    assert clause_features(None, None)[0] == 0


# Urls

def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(c.lower() if c.isascii() else c for c in m.group(1))
    fits = [(len(r.text), r) for r in RULES if (host == r.host or host.endswith("." + r.host)) and m.group(2).startswith(r.path)]
    return host, m.group(2), max(fits, key=lambda f: f[0])[1] if fits else None


def test_url_parts_rules_and_verdicts(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://example.com/de/", "http://example.com/de", "x://b.org/fr/#a", "http://net/", "http://internet/", "nothing", None, "", "://", "a://b?c/d",
            "http://É.net/x\ny?z", "http://u@h:8/p://q", "https://cheap-pills.example.org/a", "https://cheappills.org/a", "http://word.org/casino/1", "http://word.org/1"] + ["http://good.word.org/en/"] * 40 + ["http://other.org/casino/2"] * 4
    html = "<p>cheap good word pills word internet</p> www.cheappills.org"
    df = spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in judge_urls(df, RULES).collect()}
    for i, u in enumerate(urls):
        host, path, *rule = brute_url(u)
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (rule[0].text if rule and rule[0] else None)
        if rule and rule[0]:
            assert got[i].verdict == rule[0].action
    verdict = {urls[i]: r.verdict for i, r in got.items()}
    assert [verdict[u] for u in urls[13:18]] == ["block", "block", "block", "allow", "allow"]
    assert verdict[None] == verdict[""] == "allow"


def test_urls_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "http://a.org/", None, "x"), (1, "http://a.org/", None, "x")], "page_id long, url string, html string, host string")
    assert sorted(r.host for r in judge_urls(odd, RULES).collect()) == ["", "a.org", "a.org"]
    assert judge_urls(odd.limit(0), RULES).count() == 0


def test_viterbi_takes_the_likeliest_words():
    lex = Lexicon({"the": 100, "rapist": 1, "therapist": 30, "finder": 20, "find": 20, "er": 1, "spam": 0})
    assert lex.split("therapistfinder") == ["therapist", "finder"] and lex.split("thefind") == ["the", "find"]
    assert lex.split("") == [] and "".join(lex.split("zzzqq")) == "zzzqq" and lex.split("spamfinder") == ["spam", "finder"]


# Licences

def test_licences_and_inheritance(spark):
    fill = "Some plain words that say nothing of the matter at all and go on. " * 6
    files = [("LICENSE", "Released under the MIT License."), ("a/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
             ("a/b/x.c", fill), ("a/b/y.c", "Licensed under CC BY-NC 4.0.\n" + fill), ("c/z.c", fill), ("top.c", None), (None, fill), ("a/b/y.c", "all of the rights of man and version of work.")]
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)], "doc_id long, path string, text string, own string")
    got = {r.doc_id: (r.own, r.license, r.inherited_from) for r in scan_files(df, "doc_id", "path", "text").collect()}
    assert got == {0: ("MIT", "MIT", None), 1: ("GPL-3.0", "GPL-3.0", None), 2: (None, "GPL-3.0", "a"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
                   4: (None, "MIT", ""), 5: (None, "MIT", ""), 6: (None, None, None), 7: (None, "GPL-3.0", "a")}
    assert scan_files(df.limit(0), "doc_id", "path", "text").count() == 0


def test_skipped_sentences_stay_below_the_threshold():
    r = random.Random(4)
    m = Matcher(TEMPLATES, 1000, {"the": 900, "of": 800, "this": 500, "under": 90, "license": 40, "and": 700}, 0.75)
    vocab = [w for _, t in TEMPLATES for w in words_of(t)]
    for _ in range(2000):
        words = [r.choice(vocab) for _ in range(r.randrange(1, 12))]
        v = m._vector(words)
        top = max(sum(x * v.get(w, 0) for w, x in t.items()) for _, t in m.vectors)
        assert (m.best(words)[1] is not None) == (top >= 0.75)
    for name, t in TEMPLATES:
        assert m.best(words_of(t))[0] == pytest.approx(1)
