"""Mixing sources to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document a posterior over the
domains: multinomial naive Bayes scores blocks of words, and the document's posterior
is the mean over its blocks, so a text of several domains is shared among them.
Projected gradient descent then finds a rate x >= 0 for every document, such that the
expected tokens of domain k, sum of x * tokens * posterior(k), come to the target's
share of the token budget, staying as near to the base rate 1 as a small ridge asks.

The state of the descent is one vector of residuals per step, as long as there are
domains. A document's rate is a function of its posterior and these vectors, so each
step is one aggregate over the table of posteriors, with nothing else kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import stored
from .words import hash_words, row_slices, text_buffer

BUCKET_BITS = 16
BLOCK_WORDS = 32


@dataclass
class Rate:
    """The rate of a posterior: steps from the base rate 1, each along its pull (a column, as long as
    there are domains) and projected onto x >= 0. A few numbers a step, applied to batches of rows."""

    pulls: np.ndarray
    step: float
    ridge: float

    def of(self, p: np.ndarray) -> np.ndarray:
        x, pull = np.ones(len(p)), p @ self.pulls
        for k in range(self.pulls.shape[1]):
            x = np.maximum(0.0, (1 - self.step * self.ridge) * x + self.step * self.ridge - self.step * pull[:, k])
        return x

    def column(self) -> Column:
        """The rate over ``_p``."""
        if not self.pulls.shape[1]:
            return F.lit(1.0)

        @F.arrow_udf("double")
        def run(p: pa.Array) -> pa.Array:
            return pa.array(self.of(p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), len(self.pulls))))

        return run("_p")


@dataclass
class DomainModel:
    """Log-probabilities of hashed words for each domain, and log-priors."""

    domains: list[str]
    prior: np.ndarray
    words: np.ndarray

    def posteriors(self, docs: DataFrame, text_col: str = "text", keep_text: bool = False, rate: Rate | None = None) -> DataFrame:
        """The columns of ``docs`` (the text only if asked for) with ``_tokens`` and ``_p``, the
        posteriors in the order of ``domains``, and with a ``rate`` its value ``_x``, worked out in
        the same task. A text without words has the prior."""
        others = [c for c in docs.columns if c != text_col or keep_text]
        schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema.add("_tokens", "long").add("_p", T.ArrayType(T.DoubleType()))
        if rate:
            schema = schema.add("_x", "double")
        # a text that is kept is sent to the task once
        once = keep_text and isinstance(docs.schema[text_col].dataType, T.StringType)
        at, own = (others.index(text_col), 0) if once else (0, 1)
        shared = docs.sparkSession.sparkContext.broadcast((self.prior, self.words))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prior, words = shared.value
            for batch in batches:
                buf, offs = text_buffer(batch.column(at))
                for a, b in row_slices(offs):
                    h, first = hash_words(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], lower=True)
                    p = _posteriors(h, first, prior, words)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(prior)), pa.array(p.reshape(-1)))
                    more = [pa.array(rate.of(p))] if rate else []
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[own:], pa.array(np.diff(first), pa.int64()), lists, *more], names=schema.names)

        text = [] if once else [F.col(f"`{text_col}`").cast("string").alias("_text")]
        return docs.select(*text, *[F.col(f"`{c}`") for c in others]).mapInArrow(score, schema)


def _posteriors(h: np.ndarray, first: np.ndarray, prior: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mean over a row's blocks of the blocks' posteriors, weighted by their words."""
    n = np.diff(first)
    out = np.tile(np.exp(prior), (len(n), 1))
    if len(h):
        rows = np.flatnonzero(n)
        k = -(-n[rows] // BLOCK_WORDS)
        starts = np.repeat(first[:-1][rows], k) + BLOCK_WORDS * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
        size = np.diff(np.append(starts, len(h)))
        logs = np.add.reduceat(words[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], starts, axis=0) + prior
        e = np.exp(logs - logs.max(1, keepdims=True))
        e *= (size / e.sum(1))[:, None]
        out[rows] = np.add.reduceat(e, np.cumsum(k) - k, axis=0) / n[rows][:, None]
    return out


def fit_domains(docs: DataFrame, labels: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text",
                max_rows: int = 5_000) -> DomainModel:
    """Naive Bayes on the documents that ``labels (id, domain)`` names; at most ``max_rows``
    labelled rows, chosen by the hash of the id. Word counts by domain are summed on the
    cluster into 2 ** 16 hashed words. Labels without id or domain are left out; if no
    labelled document has words, all belongs to one domain, ``none``."""
    rows = (labels.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).dropna().groupBy("id").agg(F.min("domain").alias("domain"))
            .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "id").select("domain", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            h, first = hash_words(buf, offs, lower=True)
            at = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            for i, d in enumerate(batch.column(0).to_pylist()):
                sums.setdefault(d, np.zeros(1 << BUCKET_BITS, np.int64))
                np.add.at(sums[d], at[first[i]:first[i + 1]], 1)
        for d, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some), pa.string()), pa.array(some), pa.array(c[some])], names=["domain", "word", "n"])

    got = sample.mapInArrow(counts, "domain string, word long, n long").groupBy("domain", "word").agg(F.sum("n").alias("n")).toPandas()
    domains = sorted(got["domain"].unique())
    if not domains:
        return DomainModel(["none"], np.zeros(1), np.zeros((1 << BUCKET_BITS, 1)))
    n = np.zeros((1 << BUCKET_BITS, len(domains)))
    for k, d in enumerate(domains):
        part = got[got["domain"] == d]
        n[part["word"].to_numpy(), k] = part["n"].to_numpy()
    total = n.sum(0)
    return DomainModel(domains, np.log(total / total.sum()), np.log((n + 0.1) / (total + 0.1 * len(n))))


def fit_rates(scored: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, ridge: float = 1e-5,
              step: float = 0.7, tolerance: float = 1e-4) -> tuple[Rate, dict]:
    """The rate, and a report: steps, expected shares, residual.

    Minimises gap' M^-1 gap / 2 + ridge * (token-weighted mean of (x - 1)^2) / 2, where gap
    is the expected domain tokens over the budget (the table's own tokens if None) less the
    targets, and M the token-weighted moments of the posteriors: in this scale the gradient
    at a document is its posterior times M^-1 gap, and any step under 2 converges. Targets
    are scaled to sum to 1; a domain without a target gets 0 (equal shares if none has one). The descent ends at a
    residual of ``tolerance`` or when it no longer moves; the report says what was left."""
    k = len(domains)
    want = np.array([targets.get(d, 0.0) for d in domains])
    want = want / want.sum() if want.sum() else np.full(k, 1 / k)
    p = [F.col("_p")[i] for i in range(k)]
    found = scored.agg(F.sum("_tokens"), *[F.sum(F.col("_tokens") * p[i] * p[j]) for i in range(k) for j in range(i, k)]).first()
    if not found[0]:
        return Rate(np.zeros((k, 0)), step, ridge), {"steps": 0, "shares": dict.fromkeys(domains, 0.0), "residual": 1.0}
    scale = float(budget or found[0])
    moments = np.zeros((k, k))
    moments[np.triu_indices(k)] = found[1:]
    moments = (moments + np.triu(moments, 1).T) / scale
    inverse = np.linalg.inv(moments + 1e-9 * np.trace(moments) * np.eye(k))
    rate, last = Rate(np.zeros((k, 0)), step, ridge), np.full(k, np.inf)
    while True:
        sums = scored.withColumn("_x", rate.column()).agg(*[F.sum(F.col("_tokens") * F.col("_x") * x) for x in p]).first()
        shares = np.array(sums, float) / scale
        gap = shares - want
        if np.abs(gap).max() < tolerance or np.abs(last - gap).max() < tolerance / 100:
            break
        last = gap
        rate = Rate(np.column_stack([rate.pulls, inverse @ gap]), step, ridge)
    return rate, {"steps": rate.pulls.shape[1], "shares": dict(zip(domains, shares.tolist(), strict=True)), "residual": float(np.abs(gap).max())}


def copies_of(rate: Column, id_col: Column) -> Column:
    """A whole number of copies whose mean is the rate: the fraction is rounded up for the
    ids whose hash lies below it."""
    unit = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (unit < rate - F.floor(rate)).cast("long")).cast("int")


@dataclass
class Mix:
    """A fitted mixture: rates for any documents of the same schema."""

    model: DomainModel
    rate: Rate
    report: dict
    id_col: str
    text_col: str

    def rates(self, docs: DataFrame) -> DataFrame:
        """``(id, tokens, p, rate, copies)`` for every row of ``docs``."""
        own = docs.select(F.col(f"`{self.id_col}`"), F.col(f"`{self.text_col}`"))
        out = self.model.posteriors(own, self.text_col, rate=self.rate)
        return out.select(self.id_col, F.col("_tokens").alias("tokens"), F.col("_p").alias("p"), F.col("_x").alias("rate"),
                          copies_of(F.col("_x"), F.col(f"`{self.id_col}`")).alias("copies"))

    def resample(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, all columns as they are, each as often as its copies say."""
        scored = self.model.posteriors(docs, self.text_col, keep_text=True, rate=self.rate)
        many = scored.withColumn("_copies", copies_of(F.col("_x"), F.col(f"`{self.id_col}`"))).where("_copies > 0")
        return many.withColumn("_copy", F.explode(F.expr("sequence(1, _copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str, id_col: str = "doc_id", text_col: str = "text",
        budget: float | None = None, max_rows: int = 5_000) -> Mix:
    """Fit the classifier on ``labels (id, domain)`` and the rates on all of ``docs``.

    Null and empty texts have no tokens, the prior as posterior, and a rate like any other;
    a null id is hashed as null; rows that repeat an id have equal copies if their texts are
    equal. An empty table keeps the base rate 1."""
    model = fit_domains(docs, labels, domain_col, id_col, text_col, max_rows)
    scored = stored(model.posteriors(docs.select(F.col(f"`{text_col}`")), text_col), "posteriors")
    rate, report = fit_rates(scored, model.domains, targets, budget)
    return Mix(model, rate, report, id_col, text_col)
