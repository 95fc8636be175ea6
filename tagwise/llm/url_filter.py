"""URL filter: rules first, then naive Bayes over segmented host and path words.

Rules name a host (with its subdomains) and a path prefix; the longest one that fits
decides. For the rest, host and path are cut into words: a unigram Viterbi search splits
concatenated names by word counts over the pages' whole texts; lexicon and weights are
tables of any size, met by joins. Multinomial naive Bayes then scores the words. Its classes start from fixed words of unwanted trades: urls that
hold one are the block class, all others the allow class, so words that keep company
with them weigh too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

# Words of unwanted trades.
BLOCK_WORDS = ("ads adult bet bets betting casino cheap cialis cracked escort gambling hoax jackpot keygen lottery malware miracle phishing pills poker porn "
               "replica scam sex slots spam torrent viagra warez webcam xxx").split()
#: Letters by which parts of a name are looked up; longer words are found by their first ones.
HEAD = 24


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule string and action of the longest rule that fits (then the first in order of its
    string), or nulls. Rules are configuration: a short list, tried in turn within the row."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``(w, n)``: every lower-case word of two letters and more in all rows' whole texts,
    tags and host names left out."""
    plain = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "<[^>]*>", " ")
    plain = F.regexp_replace(plain, r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", " ")
    words = texts.select(F.explode(F.split(F.lower(plain), "[^a-z]+")).alias("w")).where(F.length("w") >= 2)
    return stored(words.groupBy("w").agg(F.count("*").alias("n")), "counts")


class Lexicon:
    """Unigram model: a known word costs its negative log-probability, another string a fixed
    price and a price for each letter. ``total`` is that of all counts, if ``counts`` holds
    only the words that can occur in the names to split."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        counts = {w: counts.get(w, 0) for w in {*counts, *BLOCK_WORDS}}
        total = total or sum(counts.values()) + len(counts)
        # Fixed words count as known ones of middling frequency.
        least = {w: max(1.0, total * 1e-5) for w in BLOCK_WORDS}
        self.cost = {w: -math.log(max(n + 1, least.get(w, 0)) / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 4.0
        self.long = sorted({len(w) for w in counts if len(w) > HEAD}, reverse=True)

    def split(self, name: str) -> list[str]:
        """Cheapest segmentation of one run of letters; of equal ones, that with the longer
        first words. Known words of up to ``HEAD`` letters are tried at every place, longer ones
        by their lengths. An unknown string of any length costs a price and one for each letter,
        so the best end of it is carried along from the right."""
        n = len(name)
        best, cut = [0.0] * (n + 1), [n] * (n + 1)
        far, end = 3.0 * n, n                      # smallest 3 b + best[b] so far, at the largest such b
        for a in range(n - 1, -1, -1):
            best[a], cut[a] = self.unknown - 3.0 * a + far, end
            for b in (*(a + x for x in self.long if a + x <= n), *range(min(n, a + HEAD), a, -1)):
                price = self.cost.get(name[a:b])
                if price is not None and (price + best[b], -b) < (best[a], -cut[a]):
                    best[a], cut[a] = price + best[b], b
            if 3.0 * a + best[a] < far:
                far, end = 3.0 * a + best[a], a
        out, a = [], 0
        while a < n:
            out.append(name[a:cut[a]])
            a = cut[a]
        return out


def _pieces(runs: DataFrame) -> DataFrame:
    """``(rid, w)``: the distinct parts of 2 to ``HEAD`` letters of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(run)
                for first in range(0, n, 2_000):        # a run of any length goes in short batches
                    parts = list({run[a:b] for a in range(first, min(n, first + 2_000)) for b in range(a + 2, min(n, a + HEAD) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(parts), pa.int64()), pa.array(parts, pa.string())], names=["rid", "w"])

    return runs.select("rid", "run").mapInArrow(cut, "rid long, w string")


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``(run, words)`` for distinct ``runs (run)`` of letters: each is cut with the counts of
    the words that occur in it, so no task holds the whole lexicon."""
    size = counts.agg(F.sum("n"), F.count("*"), F.count(F.when(F.col("w").isin(BLOCK_WORDS), 1))).first()
    total = (size[0] or 0) + size[1] + len(BLOCK_WORDS) - size[2]
    runs = stored(runs.withColumn("rid", F.monotonically_increasing_id()), "runs")
    parts, long = _pieces(runs), F.length("w") > HEAD
    # a longer word meets the runs that hold its first letters, and stays if they hold all of it
    heads = counts.where(long).select(F.col("w").alias("whole"), "n", F.substring("w", 1, HEAD).alias("w"))
    longer = parts.where(F.length("w") == HEAD).join(heads, "w").join(runs, "rid").where(F.contains("run", "whole"))
    found = parts.join(counts.where(~long), "w").unionByName(longer.select("rid", F.col("whole").alias("w"), "n")).groupBy("rid").agg(F.collect_set(F.struct("w", "n")).alias("known"))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [Lexicon({x["w"]: x["n"] for x in known or ()}, total).split(run)
                   for run, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], names=["run", "words"])

    return stored(runs.join(found, "rid", "left").select("run", "known").mapInArrow(segment, "run string, words array<string>"), "segments")


def url_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``urls (row, host, path)`` with ``words``, the words of host and path in their order:
    runs of letters, cut by the lexicon."""
    letters = F.regexp_extract_all(F.concat("host", F.lit(" "), F.lower("path")), F.lit("[a-z]+"), 0)
    runs = urls.select("row", F.posexplode(letters).alias("at", "run"))
    cut = split_runs(runs.select("run").distinct(), counts)
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]))
    words = runs.join(cut, "run").groupBy("row").agg(in_order.alias("words"))
    return stored(urls.join(words, "row", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))), "words")


def fit_bayes(words: DataFrame, col: str = "words") -> tuple[DataFrame, float]:
    """``(w, weight)`` of every word, log P(word | block) - log P(word | allow), smoothed by
    one half; and the classes' log-ratio. Counts are summed over all rows."""
    bad = F.exists(col, lambda w: w.isin(BLOCK_WORDS)).cast("int")
    rows = words.select(bad.alias("bad"), F.col(col).alias("ws"))
    sizes = rows.agg(F.sum("bad"), F.count("*")).first()
    blocked, total = sizes[0] or 0, sizes[1]
    counts = (rows.select("bad", F.explode("ws").alias("w")).groupBy("w").agg(F.sum("bad").alias("b"), F.count("*").alias("n")))
    counts = stored(counts, "weights")
    b_all, n_all, v = (x or 0 for x in counts.agg(F.sum("b"), F.sum("n"), F.count("*")).first())
    weight = F.log((F.col("b") + 0.5) / (b_all + 0.5 * (v + 1))) - F.log((F.col("n") - F.col("b") + 0.5) / (n_all - b_all + 0.5 * (v + 1)))
    return counts.select("w", weight.alias("weight")), math.log((blocked + 0.5) / (total - blocked + 0.5))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``(id, host, path, rule, verdict, words, log_odds)`` for every row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path, fits no rule of a host,
    and has no words: it is judged by the classes' ratio alone. Rows that repeat are judged
    alike; an empty table gives none. Other columns are not read."""
    host, path = host_of(F.col(f"`{url_col}`")), path_of(F.col(f"`{url_col}`"))
    rule, action = rule_of(rules, F.col("host"), F.col("path"))
    urls = stored(pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")), "urls")
    cut = url_words(urls, word_counts(pages, text_col))
    weights, prior = fit_bayes(cut)
    # Weights are added in the order of the words, so that runs agree to the last bit.
    in_order = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "weight"))), F.lit(0.0), lambda t, x: t + x["weight"])
    sums = cut.select("row", F.posexplode("words").alias("at", "w")).join(weights, "w").groupBy("row").agg(in_order.alias("sum"))
    judged = cut.join(sums, "row", "left").withColumn("log_odds", F.lit(prior) + F.coalesce("sum", F.lit(0.0)))
    verdict = F.coalesce(action, F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "words", "log_odds")
