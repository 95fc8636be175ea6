"""Language-model scores from a lattice of subwords, and from word counts.

A text is its words, each spelled as the mark U+2581 and its characters, and an end. The
pieces are an existing subword vocabulary; every way to cut a word into pieces, or single
characters into byte pieces, counts with the product of the pieces' probabilities. A forward
recursion in log space sums all of them, so a score is the probability of the text itself
and not of one segmentation. Pieces hold the mark only in front, so the lattice of a text
falls apart into those of its words, and each distinct word is scored once.

The pieces' probabilities start from the vocabulary's own scores and are re-estimated by
expected counts over the training words; the vocabulary itself is never changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored
from .tokens import WORDS, Sums, row_words

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of re-estimation, and what is added to each piece's expected count.
ROUNDS, ADDED = 2, 0.1
#: Words that make up this share of all words or more are broadcast; there are at most 1 / HEAD
#: of them, and the end.
HEAD = 1 / 500_000
#: Words of up to so many characters are summed side by side, others one by one.
SHORT = 64
#: Longer words teach in stretches of so many characters; they are scored whole.
STRETCH = 1 << 14
HELD = 1_000_000
LN10 = log(10.0)


@dataclass(frozen=True)
class Pieces:
    """Subwords, 256 byte pieces and the end, with natural log probabilities in this order. A
    subword may hold the mark in front only."""

    words: tuple[str, ...]
    logs: np.ndarray

    @property
    def end(self) -> float:
        return float(self.logs[-1])


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """The pieces of a sentencepiece model. Pieces with the mark behind their first character
    cannot occur and are left out. Unigram scores are log probabilities; scores that are merge
    ranks, as in pair-merging models, become the frequencies 1 / (rank + 3)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = [i for i in ids if MARK not in model.id_to_piece(i)[1:]]
    scores = np.array([model.get_score(i) for i in ids])
    ranks = scores.min() < -1000
    mass = 1 / (3 - scores) if ranks else np.exp(scores)
    rest = np.full(257, mass.min())
    p = np.append(mass, rest)
    return Pieces(tuple(model.id_to_piece(i) for i in ids), np.log(p / p.sum()))


class Lattice:
    """All segmentations of a word under the pieces (built once in each task)."""

    def __init__(self, pieces: Pieces):
        self.logs, self.n = pieces.logs.tolist(), len(pieces.words)
        self.find, self.places = ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, w in enumerate(pieces.words):
            self.find.add_word(w, (len(w), i, self.logs[i]))
            self.places.add_word(w, i)
        self.find.make_automaton()
        self.places.make_automaton()
        self.table, self.sizes = np.array(self.logs), np.array([len(w) for w in pieces.words], np.int64)
        self.chars, self.reach = {}, max(map(len, pieces.words), default=1) + 1

    def byte_ids(self, c: str) -> list[int]:
        return [self.n + b for b in c.encode("utf-8", "surrogateescape")]

    def spelled(self, c: str) -> float:
        """Log probability of a character as its byte pieces."""
        got = self.chars.get(c)
        if got is None:
            got = self.chars[c] = sum(self.logs[i] for i in self.byte_ids(c))
        return got

    def score(self, word: str) -> float:
        """Log probability of a word: forward recursion over the ends of its pieces; only the
        places that a piece can still reach are held."""
        text, reach, marked = MARK + word, self.reach, MARK in word
        at = [0.0]                                             # at[-1] belongs to place ``done``
        done = base = 0
        for end, (size, _, p) in self.find.iter(text):
            start = end + 1 - size
            if marked and start and MARK in text[start:end + 1]:
                continue
            while done <= end:
                at.append(at[-1] + self.spelled(text[done]))
                done += 1
                if len(at) > 8 * reach:
                    base += len(at) - reach
                    del at[:-reach]
            a, b = at[start - base] + p, at[-1]
            at[-1] = a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))
        for c in text[done:]:
            at.append(at[-1] + self.spelled(c))
            del at[0]
        return at[-1]

    def expect(self, word: str, weight: float, into: np.ndarray) -> None:
        """Add the word's expected pieces, times ``weight``."""
        text = MARK + word
        marked, size = MARK in word, len(text)
        ahead = [0.0] * (size + 1)
        ends = [[] for _ in range(size + 1)]
        for end, (k, i, p) in self.find.iter(text):
            start = end + 1 - k
            if not (marked and start and MARK in text[start:end + 1]):
                ends[end + 1].append((start, i, p))
        for j in range(1, size + 1):
            total = ahead[j - 1] + self.spelled(text[j - 1])
            for start, _, p in ends[j]:
                a = ahead[start] + p
                total = a + log1p(exp(total - a)) if a > total else total + log1p(exp(a - total))
            ahead[j] = total
        back, whole = [None] * size + [0.0], ahead[size]
        for j in range(size, 0, -1):
            tail = back[j]
            if tail is None:
                continue
            p = self.spelled(text[j - 1])
            gain = exp(ahead[j - 1] + p + tail - whole) * weight
            if gain > 1e-12:
                for i in self.byte_ids(text[j - 1]):
                    into[i] += gain
            arcs = [(j - 1, None, p), *ends[j]]
            for start, i, p in arcs:
                through = p + tail
                old = back[start]
                back[start] = through if old is None else (through + log1p(exp(old - through)) if through > old else old + log1p(exp(through - old)))
                if i is not None:
                    into[i] += exp(ahead[start] + through - whole) * weight


    def _arcs(self, words: list[str]) -> tuple:
        """The lattices of many short words side by side: arcs (from, to, log probability, piece or
        the place of a character), steps of both ends within their word, and each word's end."""
        text = MARK + MARK.join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.flatnonzero(codes == ord(MARK))
        word = np.cumsum(codes == ord(MARK)) - 1
        kinds, char = np.unique(codes, return_inverse=True)
        found = np.fromiter(chain.from_iterable(self.places.iter(text)), np.int64).reshape(-1, 2)
        last, piece = np.append(found[:, 0], np.arange(len(codes))), np.append(found[:, 1], -1 - char)
        size = np.append(self.sizes[found[:, 1]], np.ones(len(codes), np.int64))
        spelled = np.array([self.spelled(chr(c)) for c in kinds])
        p = np.append(self.table[found[:, 1]], spelled[char])
        w = word[last]
        step = last + 1 - begins[w]
        to = last + 1 + w                                      # a word of n characters has n + 1 places
        return kinds, w, to - size, to, step - size, step, p, piece, np.append(begins[1:], len(codes)) + np.arange(len(words))

    @staticmethod
    def _flow(at: np.ndarray, source: np.ndarray, target: np.ndarray, step: np.ndarray, p: np.ndarray) -> None:
        """Sum the paths into ``at``, a step of all words at a time."""
        order = np.lexsort((target, step))
        source, target, step, p = source[order], target[order], step[order], p[order]
        cut = np.flatnonzero(np.diff(target, prepend=-1))      # a place belongs to one step
        sizes = np.diff(np.append(cut, len(target)))
        bounds = np.append(np.flatnonzero(np.diff(step[cut], prepend=step[0] - 1)), len(cut))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            i, j = cut[a], cut[b] if b < len(cut) else len(target)
            v, g = at[source[i:j]] + p[i:j], cut[a:b] - i
            top = np.maximum.reduceat(v, g)
            at[target[cut[a:b]]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, sizes[a:b])), g))

    def _short(self, words: list[str]) -> np.ndarray:
        return np.array([len(w) <= SHORT and MARK not in w for w in words], bool)

    def scores(self, words: list[str]) -> np.ndarray:
        """``score`` of each word."""
        out, short = np.zeros(len(words)), self._short(words)
        if short.any():
            _, _, a, b, _, step, p, _, ends = self._arcs([w for w, s in zip(words, short, strict=True) if s])
            ahead = np.zeros(ends[-1] + 1)
            self._flow(ahead, a, b, step, p)
            out[short] = ahead[ends]
        for i in np.flatnonzero(~short):
            out[i] = self.score(words[i])
        return out

    def expect_all(self, words: list[str], weights: np.ndarray, into: np.ndarray) -> None:
        """``expect`` of each word."""
        short = self._short(words)
        if short.any():
            kinds, w, a, b, behind, step, p, piece, ends = self._arcs([x for x, s in zip(words, short, strict=True) if s])
            ahead, back = np.zeros(ends[-1] + 1), np.zeros(ends[-1] + 1)
            self._flow(ahead, a, b, step, p)
            self._flow(back, b, a, -behind, p)
            gain = np.exp(ahead[a] + p + back[b] - ahead[ends][w]) * weights[short][w]
            whole = piece >= 0
            into[:self.n] += np.bincount(piece[whole], gain[whole], self.n)
            for c, n in zip(kinds, np.bincount(-1 - piece[~whole], gain[~whole], len(kinds)), strict=True):
                for i in self.byte_ids(chr(c)):
                    into[i] += n
        for i in np.flatnonzero(~short):
            for at in range(0, len(words[i]), STRETCH):
                self.expect(words[i][at:at + STRETCH], weights[i], into)


def refine(pieces: Pieces, words: DataFrame, ends: int) -> Pieces:
    """One round of expected counts over ``words (token, train)`` and ``ends`` ends: each task
    sums its words' pieces, and only these sums, one for each piece, are gathered."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(shared.value), np.zeros(len(shared.value.logs))
        for batch in batches:
            lattice.expect_all([w.decode("utf-8", "surrogateescape") for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float), into)
        some = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(into[some])], ["piece", "n"])

    got = words.where("train > 0").select("token", "train").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.full(len(pieces.logs), ADDED)
    for r in got:
        counts[r["piece"]] += r["n"]
    counts[-1] += ends
    return Pieces(pieces.words, np.log(counts / counts.sum()))


def count_words(texts: DataFrame) -> DataFrame:
    """``(token, n, train)`` of ``texts (text, train)``: occurrences in all rows and in those that
    teach; the end is the empty token. Summed in the task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["token"], ["n", "train"], HELD)
        for batch in batches:
            teaches = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            parts = [(np.arange(len(teaches)), pa.array([b""] * len(teaches), pa.binary()), np.ones(len(teaches), np.int64))]
            for part in (parts, row_words(batch.column(0), WORDS)):
                for rows, words, n in part:
                    for out in sums.add(pa.table({"token": words, "n": n.astype(np.int64), "train": n * teaches[rows]})):
                        yield from out.to_batches(max_chunksize=50_000)
        for out in sums.take():
            yield from out.to_batches(max_chunksize=50_000)

    return (texts.select("text", "train").mapInArrow(run, "token binary, n bigint, train bigint")
            .groupBy("token").agg(F.sum("n").alias("n"), F.sum("train").alias("train")))


def score_words(words: DataFrame, pieces: Pieces, total: int, distinct: int) -> DataFrame:
    """``words`` with ``known``, and the log10 probabilities ``base`` by add-one counts and ``score``
    by the lattice; the empty token is the end."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            words = [w.decode("utf-8", "surrogateescape") for w in batch.column(0).to_pylist()]
            scores = np.where([w == "" for w in words], shared.value.end, lattice.scores(words)) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores)], ["token", "n", "train", "score"])

    scored = words.select("token", "n", "train").mapInArrow(run, "token binary, n bigint, train bigint, score double")
    return scored.select("token", "n", (F.col("train") > 0).cast("int").alias("known"),
                         F.log10((F.col("train") + 1) / F.lit(float(total + distinct + 1))).alias("base"), "score")


def score_texts(docs: DataFrame, key: str, text: str, held_out, pieces: Pieces | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``held_out`` is a boolean column; rows where it is true do not teach (null counts as false).
    A null text is empty and has the end alone. Repeated rows, null keys and other columns are
    all right; without training rows every count is 0 and the vocabulary's own scores stand.

    Words are counted over all rows, and each distinct word is scored once. The words that make
    up a share of HEAD or more, a bounded number, are broadcast; a row's other words meet their
    scores in a join in which no word is frequent, and are added up by row."""
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), held.alias("held"))
    words = stored(count_words(texts.select("text", (~F.col("held")).alias("train"))), "words")
    sums = words.agg(F.sum("n"), F.sum("train"), F.sum((F.col("train") > 0).cast("bigint")), F.max(F.when(F.length("token") == 0, F.col("train")))).first()
    every, total, distinct, ends = (x or 0 for x in sums)
    pieces = pieces or load_pieces()
    for _ in range(rounds if total else 0):
        pieces = refine(pieces, words.where(F.length("token") > 0), ends)
    scored = stored(score_words(words, pieces, total, distinct), "scored")

    often = (F.col("n") >= max(every * HEAD, 1)) | (F.length("token") == 0)
    head = scored.where(often).select("token", "known", "base", "score").collect()
    shared = spark.sparkContext.broadcast({bytes(r["token"]): (r["known"], r["base"], r["score"]) for r in head})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        order = pa.array(list(table), pa.binary())
        known, base, score = (np.array([v[i] for v in table.values()], np.float64) for i in range(3))
        end = table.get(b"", (0, 0.0, 0.0))
        for batch in batches:
            rows = len(batch)
            own = np.tile(np.array([1.0, *end]), (rows, 1))    # words, known words, base, score
            left = []
            for row, words, n in row_words(batch.column(3), WORDS):
                at = pa.compute.index_in(words, value_set=order)
                here = np.asarray(at.is_valid())
                i, r, k = at.drop_null().to_numpy(), row[here], n[here]
                for c, weights in enumerate((k, k * known[i], k * base[i], k * score[i])):
                    own[:, c] += np.bincount(r, weights, rows)
                left.append((row[~here], words.filter(pa.array(~here)), n[~here]))
            ids = batch.column(0).to_numpy()
            row = np.concatenate([np.arange(rows), *[x[0] for x in left]]).astype(np.int64)
            token = pa.chunked_array([pa.nulls(rows, pa.binary()), *[x[1] for x in left]], pa.binary())
            n = np.concatenate([np.zeros(rows, np.int64), *[x[2] for x in left]])
            first = pa.array(np.append(np.arange(rows), np.full(len(row) - rows, -1)), mask=np.arange(len(row)) >= rows)
            of_row = pa.StructArray.from_arrays([batch.column(1), batch.column(2), pa.array(own[:, 0].astype(np.int64)), pa.array(own[:, 1].astype(np.int64)),
                                                 pa.array(own[:, 2]), pa.array(own[:, 3])], ["key", "held", "words", "known", "base", "score"])
            out = pa.table({"row": ids[row], "token": token, "n": n, "own": of_row.take(first)})
            yield from out.to_batches(max_chunksize=20_000)

    kind = docs.schema[key].dataType.simpleString()
    dealt = texts.select(F.monotonically_increasing_id().alias("row"), "key", "held", "text").mapInArrow(
        run, f"row bigint, token binary, n bigint, own struct<key:{kind},held:boolean,words:bigint,known:bigint,base:double,score:double>")
    # a row's own sums travel under a token that no word can be, different for every row
    alone = F.concat(F.unhex(F.lit("20")), F.col("row").cast("string").cast("binary"))
    tail = scored.where(~often).select("token", "known", "base", "score")
    met = dealt.withColumn("token", F.coalesce("token", alone)).join(tail, "token", "left")
    by = F.col("n")
    add = lambda c: F.coalesce(F.sum(by * F.col(c)), F.lit(0))
    rows = met.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("n").alias("n"), add("known").alias("k"), add("base").alias("b"), add("score").alias("s"))
    return rows.select(F.col("own.key").alias(key), F.col("own.held").alias("held_out"), (F.col("own.words") + F.col("n")).alias("n_tokens"),
                       (F.col("own.known") + F.col("k")).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
                       (F.col("own.base") + F.col("b")).alias("base_score"), (F.col("own.score") + F.col("s")).alias("score"))
