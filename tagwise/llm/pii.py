"""Personal data by boosted trees over candidate spans (DataFrame operations only).

High-recall generators propose overlapping candidates of four kinds: e-mail, IP address,
payment card and phone number, in plain and in disguised spellings. Format and context
features describe each one, boosted trees score it, and a threshold for each kind,
calibrated on held-out candidates, selects spans. Spans of the strict base patterns are
always kept; the trees add spans that lie clear of them.

Training needs no labels by hand: base spans, and their rewritings into the disguised
spellings, are positive; other candidates, and rewritings that break a format, are
negative. The trees are fitted on the candidates of all documents: equal rows of features are
counted in one aggregate, and each level of a tree is one aggregate that sums gradients by node,
feature and value. They are applied as CASE expressions. All work on texts is
done within the row: no text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

KINDS = ("email", "ip", "card", "phone")

# The strict patterns. The look-behinds and possessive quantifiers only keep a
# long run of one class from being tried from each of its characters; matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# The generators' patterns, wider than the base ones.
_AT, _DOT = r"(?:@| ?[\[(]at[\])] ?| at )", r"(?:\.| ?[\[(](?:dot|\.)[\])] ?| dot )"
CANDIDATES = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{{1,4}}:){{4,7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][ ._-])[0-9]++(?:[ ._-][0-9]++)*+",
    "phone": r"(?<![0-9A-Za-z])(?<![0-9][ ().-])(?:\+|\()?[0-9]++(?:[ ().-]{1,2}[0-9]++)*+",
}
#: Texts without these have no candidate of the kind.
NEEDED = {"email": r"@| at |[\[(]at[\])]", "ip": r"[0-9]|:[0-9A-Fa-f]{1,4}:", "card": "[0-9]", "phone": "[0-9]"}
# Words that announce a kind.
CUES = {"email": "mail|contact|write to|correo|courriel", "ip": r"\bip\b|host|server|address|adresse", "card": "card|visa|credit|amex|karte|carte|tarjeta",
        "phone": "phone|tel|call|mobile|fax|telefon|llam"}
CONTEXT = 24
BLOCK = 64


def _append(a: Column, more: Column) -> list[Column]:
    """The fields ``full`` and ``part`` of a walk's state with ``more`` added: blocks of elements, so
    that n additions copy about n * BLOCK of them and not n * n."""
    grown = F.concat(a["part"], more)
    over = F.size(a["part"]) >= BLOCK
    return [F.when(over, F.concat(a["full"], F.array(a["part"]))).otherwise(a["full"]).alias("full"), F.when(over, more).otherwise(grown).alias("part")]


def _added(a: Column) -> Column:
    return F.concat(F.flatten(a["full"]), a["part"])


def _running(lengths: Column) -> Column:
    """Sums of the elements before each element, in one walk. (A lambda that read an array from
    outside would have it made anew for every element.)"""
    start = F.struct(F.array().cast("array<array<int>>").alias("full"), F.array().cast("array<int>").alias("part"), F.lit(0).alias("sum"))
    return F.aggregate(lengths, start, lambda a, x: F.struct(*_append(a, F.array(a["sum"])), (a["sum"] + x).alias("sum")), _added)


def _matches(text: str, pattern: str, name: str, df: DataFrame, when: str) -> DataFrame:
    """Add ``name``: the pattern's matches in the text, as structs of start, end and value."""
    quoted = F.lit(pattern)
    found = F.when(F.col(text).rlike(when), F.regexp_extract_all(text, quoted, F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_m", found).withColumn("_g", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)))
    step = F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), F.col("_m"), lambda g, m: F.char_length(g) + F.char_length(m))
    df = df.withColumn("_b", F.when(F.size("_m") > 0, _running(step)))
    spans = F.transform(F.arrays_zip(F.col("_b").alias("b"), F.slice("_g", F.lit(1), F.size("_m")).alias("g"), F.col("_m").alias("m")),
                        lambda x: F.struct((x["b"] + F.char_length(x["g"])).alias("s"), (x["b"] + F.char_length(x["g"]) + F.char_length(x["m"])).alias("e"), x["m"].alias("v")))
    return df.withColumn(name, F.when(F.size("_m") > 0, spans).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))).drop("_m", "_g", "_b")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """12 to 19 digits whose doubled sum from the right is a multiple of ten."""
    n = F.length(digits)
    one = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(one(i))).otherwise(one(i)))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _small_parts(v: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    return F.forall(F.split(v, r"\."), lambda p: part(p) & F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")) <= 255, F.lit(False)))


def _on_value(check):
    return lambda x: check(x["v"])


def _context(x: Column, text: str) -> tuple[Column, Column]:
    """The characters before and after a span."""
    before = F.substring(F.col(text), F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
    return before, F.substring(F.col(text), x["e"] + 1, F.lit(CONTEXT))


def _candidate(k: int, text: str):
    def build(x):
        left, right = _context(x, text)
        return F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), left.alias("l"), right.alias("r"))
    return build


def _span(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``base_<kind>`` for each kind: the strict spans that pass their checks."""
    checks = {"email": lambda v: F.lit(True), "ip": _small_parts, "card": lambda v: luhn(_digits(v)),
              "phone": lambda v: F.length(_digits(v)).between(9, 15)}
    for kind in KINDS:
        df = _matches(text, BASE[kind], "_s", df, {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}[kind])
        df = df.withColumn(f"base_{kind}", F.filter("_s", _on_value(checks[kind]))).drop("_s")
    return df


def candidate_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``candidates``: structs of kind, start, end, value, left and right context."""
    plausible = {"email": lambda v: F.lit(True), "ip": lambda v: F.lit(True), "card": lambda v: F.length(_digits(v)).between(12, 19),
                 "phone": lambda v: F.length(_digits(v)).between(7, 15)}
    parts = []
    for kind in KINDS:
        df = _matches(text, CANDIDATES[kind], "_s", df, NEEDED[kind])
        df = df.withColumn(f"_c_{kind}", F.filter("_s", _on_value(plausible[kind]))).drop("_s")
        parts.append(F.transform(f"_c_{kind}", _candidate(KINDS.index(kind), text)))
    return df.withColumn("candidates", F.concat(*parts)).drop(*[f"_c_{k}" for k in KINDS])


def features(k: Column, v: Column, left: Column, right: Column) -> list[Column]:
    """Format and context features of a candidate, all whole numbers."""
    digits, low = _digits(v), F.lower(left)
    count = lambda p: F.length(v) - F.length(F.regexp_replace(v, p, ""))
    cue = [F.when(low.rlike(CUES[kind]), 1).otherwise(0) for kind in KINDS]
    yes = lambda c: F.when(c, 1).otherwise(0)
    groups = F.size(F.split(F.regexp_replace(v, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+"))
    return [k, F.length(digits), F.length(v), count(r"[ ().\-_/]"), yes(v.startswith("+")), yes(v.contains("(")), yes(v.contains("@")),
            yes(v.rlike(r"(?i)[\[(]at[\])]")), yes(v.rlike(r"(?i) at ")), count(r"\."), yes(v.rlike(r"(?i)[\[(](dot|\.)[\])]")), yes(v.rlike("(?i) dot ")),
            yes(F.coalesce(luhn(digits), F.lit(False))), groups, yes(v.rlike(r"^(19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}$|^[0-9]{1,2}[ .-][0-9]{1,2}[ .-](19|20)[0-9]{2}$")),
            yes(v.rlike(r"^[(+]?[0-9 ]{1,4}[) .-]+[0-9]{3}[ .-][0-9]{4}$")), yes(v.rlike("^(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[^0-9]+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")),
            yes(v.rlike(r"(?:[.]| |\]|\))[a-z]{2,6}$")), yes(v.contains(":")), *cue, yes(left.rlike("[A-Za-z0-9]$")), yes(right.rlike("^[A-Za-z0-9]"))]


N_FEATURES = 25


@dataclass
class Tree:
    """A split ``feature <= at`` with its two sides, or a leaf's value."""

    feature: int
    at: float
    low: Tree | float
    high: Tree | float


@dataclass
class Boosted:
    """Summed trees over a base value, and the threshold of each kind."""

    base: float
    trees: list[Tree | float]
    thresholds: list[float]

    def margin(self, x: list[Column]) -> Column:
        return sum((_walk(t, x) for t in self.trees), F.lit(self.base))


def _walk(t: Tree | float, x: list[Column]) -> Column:
    return F.lit(float(t)) if not isinstance(t, Tree) else F.when(x[t.feature] <= t.at, _walk(t.low, x)).otherwise(_walk(t.high, x))


def _value(t, x: np.ndarray) -> np.ndarray:
    if not isinstance(t, Tree):
        return np.full(len(x), float(t))
    return np.where(x[:, t.feature] <= t.at, _value(t.low, x), _value(t.high, x))


def _sums(values: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the sums of each."""
    each, at = np.unique(values, return_inverse=True)
    return each, np.stack([np.bincount(at, s, len(each)) for s in sums], 1)


def _node(x: np.ndarray, splits: dict[int, tuple[int, float]]) -> np.ndarray:
    """The open node of every row: 1 at the root, 2 i and 2 i + 1 below node i."""
    node = np.ones(len(x), np.int64)
    for i, (f, at) in sorted(splits.items()):
        node = np.where(node == i, 2 * i + (x[:, f] > at), node)
    return node


def _grow(level, depth: int, least: float = 5.0, ridge: float = 1.0) -> Tree | float:
    """One tree. ``level(splits, nodes)`` gives, by (node, feature), the distinct values with their sums of
    gradient, Hessian and rows; of equal gains the first feature, then the first value is taken."""
    splits, value, open_ = {}, {}, [1]
    leaf = lambda t: float(-0.3 * t[0] / (t[1] + ridge))
    for _ in range(depth):
        got, after = level(splits, open_) if open_ else {}, []
        for i in open_:
            best = (1e-3, None)
            for f in range(N_FEATURES):
                v, sums = got.get((i, f), (np.zeros(0), np.zeros((0, 3))))
                left = np.cumsum(sums, axis=0)
                whole = left[-1] if len(v) else np.zeros(3)
                value.setdefault(i, leaf(whole))
                cut = np.flatnonzero((left[:-1, 2] >= least) & (whole[2] - left[:-1, 2] >= least)) if len(v) else []
                if whole[2] < 2 * least or not len(cut):
                    continue
                a, b = left[cut], whole - left[cut]
                gain = a[:, 0] ** 2 / (a[:, 1] + ridge) + b[:, 0] ** 2 / (b[:, 1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                j = int(np.argmax(gain >= gain.max() - 1e-9 * abs(gain.max())))     # sums differ in their last digits
                if gain[j] > best[0] * (1 + 1e-9):
                    best = (float(gain[j]), (f, float((v[cut[j]] + v[cut[j] + 1]) / 2)), a[j], b[j])
            if best[1] is not None:
                splits[i] = best[1]
                value[2 * i], value[2 * i + 1] = leaf(best[2]), leaf(best[3])
                after += [2 * i, 2 * i + 1]
        open_ = after
    build = lambda i: Tree(*splits[i], build(2 * i), build(2 * i + 1)) if i in splits else value.get(i, -0.0)
    return build(1)


class _Rows:
    """Training rows in arrays, each counted ``n`` times, with their margins so far."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, n: np.ndarray):
        self.x, self.y, self.held, self.n = x, y, held, n

    def sides(self) -> dict[float, float]:
        """Rows outside ``held`` by y."""
        each, n = _sums(self.y[~self.held], self.n[~self.held])
        return dict(zip(each.tolist(), n[:, 0].tolist(), strict=True))

    def start(self, base: float) -> None:
        self.m = np.full(len(self.x), base)

    def add(self, tree: Tree | float) -> None:
        self.m = self.m + _value(tree, self.x)

    def level(self, splits: dict[int, tuple[int, float]], nodes: list[int]) -> dict:
        """By (node, feature): distinct values, sums of gradient, Hessian and rows outside ``held``."""
        x, y, n, out = self.x[~self.held], self.y[~self.held], self.n[~self.held], {}
        p, node = 1 / (1 + np.exp(-self.m[~self.held])), _node(x, splits)
        for i in nodes:
            own = node == i
            g, h = ((p - y) * n)[own], (p * (1 - p) * n)[own]
            out |= {(i, f): _sums(x[own, f], g, h, n[own]) for f in range(x.shape[1])} if own.any() else {}
        return out

    def kinds(self) -> dict:
        """By kind: the distinct margins of the held-out rows, sums of y and rows."""
        return {k: _sums(self.m[own], (self.y * self.n)[own], self.n[own]) for k in range(len(KINDS)) if (own := self.held & (self.x[:, 0] == k)).any()}


class _Table:
    """As ``_Rows``, of a table (f0, f1, ..., y, held, n): every sum is one aggregate, and the driver sees
    sums by distinct value only. A tree's margins are written once, before the next tree."""

    def __init__(self, rows: DataFrame):
        self.rows, self.x = rows, [F.col(f"f{i}") for i in range(N_FEATURES)]

    def sides(self) -> dict[float, float]:
        return {float(y): float(n) for y, n in self.rows.where("NOT held").groupBy("y").agg(F.sum("n")).collect()}

    def start(self, base: float) -> None:
        self.rows = self.rows.withColumn("m", F.lit(base))

    def add(self, tree: Tree | float) -> None:
        self.rows = stored(self.rows.withColumn("m", F.col("m") + _walk(tree, self.x)), "pii_margins")

    def level(self, splits: dict[int, tuple[int, float]], nodes: list[int]) -> dict:
        node = F.lit(1)
        for i, (f, at) in sorted(splits.items()):
            node = F.when(node == i, F.when(self.x[f] > at, 2 * i + 1).otherwise(2 * i)).otherwise(node)
        p = 1 / (1 + F.exp(-F.col("m")))
        own = self.rows.where("NOT held").select(*self.x, "y", "n", p.alias("p"), node.alias("node")).where(F.col("node").isin(nodes))
        each = own.select("node", ((F.col("p") - F.col("y")) * F.col("n")).alias("g"), (F.col("p") * (1 - F.col("p")) * F.col("n")).alias("h"), "n",
                          F.posexplode(F.array(*self.x)).alias("f", "v"))
        return self._by(each.groupBy("node", "f", "v").agg(F.sum("g"), F.sum("h"), F.sum("n")), 2)

    def kinds(self) -> dict:
        each = self.rows.where("held").groupBy("f0", "m").agg(F.sum(F.col("y") * F.col("n")), F.sum("n"))
        return {k: got for (k,), got in self._by(each, 1).items()}

    @staticmethod
    def _by(sums: DataFrame, keys: int) -> dict:
        """The rows of (keys, value, sums) by key, values ascending."""
        out: dict = {}
        for r in sums.collect():
            out.setdefault(tuple(map(int, r[:keys])), []).append([float(z) for z in r[keys:]])
        return {k: (t[:, 0], t[:, 1:]) for k, v in out.items() for t in [np.array(sorted(v))]}


def _boosted(rows: _Rows | _Table, turns: int, depth: int, precision: float) -> Boosted:
    count = rows.sides()
    base, trees = math.log((count.get(1.0, 0) + 1) / (count.get(0.0, 0) + 1)), []
    rows.start(base)
    for _ in range(turns):
        trees.append(_grow(rows.level, depth))
        rows.add(trees[-1])
    held, thresholds = rows.kinds(), []
    for k in range(len(KINDS)):
        m, sums = held.get(k, (np.zeros(0), np.zeros((0, 2))))
        m, sums = m[::-1], np.cumsum(sums[::-1], axis=0)
        ok = np.flatnonzero(sums[:, 0] / np.maximum(sums[:, 1], 1) >= precision)
        if not len(ok):
            thresholds.append(math.inf)
        else:  # halfway to the next margin below
            last = ok[-1]
            thresholds.append(max(0.0, float(m[last] + m[last + 1]) / 2 if last + 1 < len(m) else 0.0))
    return Boosted(base, trees, thresholds)


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray, turns: int = 24, depth: int = 3, precision: float = 0.99) -> Boosted:
    """Newton boosting for the log-loss on the rows outside ``held``; a kind's threshold is the
    lowest margin at which the held-out rows have the asked precision, moved halfway to
    the next one below, and not under even odds."""
    return _boosted(_Rows(np.asarray(x, float), np.asarray(y, float), held, np.ones(len(x))), turns, depth, precision)


def boost_rows(rows: DataFrame, turns: int = 24, depth: int = 3, precision: float = 0.99) -> Boosted:
    """``boost`` on ``rows`` (the features f0, f1, ..., y, held, n) by DataFrame aggregates."""
    return _boosted(_Table(rows), turns, depth, precision)


# Rewritings of a base span's value: (kind, pattern, replacement, positive).
# They spell out the disguises and near misses that the trees learn from.
REWRITINGS = [
    ("email", "@", " at ", 1), ("email", "@", "(at)", 1), ("email", "@", " [at] ", 1), ("email", r"\.(?=[A-Za-z]+$)", " dot ", 1),
    ("email", r"@(.*)\.([a-z]+)$", " at $1 dot $2", 1), ("email", r"@(.*)\.([a-z]+)$", " [at] $1 [dot] $2", 1),
    ("email", r"^.*@([A-Za-z0-9]+).*$", "look at $1.This", 0), ("email", r"^([A-Za-z0-9]+).*@([A-Za-z0-9]+).*$", "$1 at $2.Then-$2", 0),
    ("ip", r"\.", "[.]", 1), ("ip", r"\.", " dot ", 1), ("ip", r"\.", "(dot)", 1), ("ip", r"^([0-9]+)\.([0-9]+)", "9$1.8$2", 0),
    ("card", r"([0-9]{4})(?=[0-9])", "$1.", 1), ("card", r"([0-9]{4})(?=[0-9])", "$1_", 1),
    ("card", r"^([0-9]+)4$", "$17", 0), ("card", r"^([0-9]+)[0-35-9]$", "$14", 0), ("card", r"^([0-9]{4})([0-9]{2})([0-9]{2}).*$", "$1.$2.$3.5512", 0),
    ("phone", r"^\+[0-9]{1,3}[ .-]?", "", 1), ("phone", r"^\+", "00", 1), ("phone", r"^\+[0-9]{1,3}[ .-]?\(([0-9]+)\) ?", "$1-", 1),
    ("phone", r"^\+[0-9]{1,3}[ .-]?\(([0-9]+)\) ?([0-9]+)[ .-]", "$1.$2.", 1),
    ("phone", "[^0-9]", "", 0), ("phone", r"^.*([0-9]{2})([0-9])([0-9])$", "20$1-0$2-1$3", 0), ("phone", r"^.*([0-9]{2})([0-9])([0-9])$", "1$2.0$3.20$1", 0),
    ("phone", r"^.*([0-9]{3})[^0-9]*([0-9]{4})$", "$1 $2", 0),
]


def _examples(kind: str, text: str):
    """A base span as it stands and in all its rewritings that change it."""
    k = F.lit(KINDS.index(kind))

    def build(x):
        left, right = _context(x, text)
        one = lambda v, y: F.struct(k.alias("k"), v.alias("v"), left.alias("l"), right.alias("r"), F.lit(y).alias("y"))
        forms = [one(F.regexp_replace(x["v"], F.lit(p), F.lit(r)), y) for name, p, r, y in REWRITINGS if name == kind]
        return F.concat(F.array(one(x["v"], 1)), F.filter(F.array(*forms), lambda z: z["v"] != x["v"]))
    return build


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Boosted:
    """Fit the trees on the candidates of all documents; a third of them, by the hash of the id, sets the
    thresholds. With nothing to learn from, no span is added to the base ones."""
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    found = candidate_spans(base_spans(sample, "t"), "t")
    rows = [F.flatten(F.transform(f"base_{kind}", _examples(kind, "t"))) for kind in KINDS]
    clear = _clear(found, F.concat(*[F.col(f"base_{k}") for k in KINDS]))
    rows.append(F.transform(clear, lambda c: F.struct(c["k"].alias("k"), c["v"].alias("v"), c["l"].alias("l"), c["r"].alias("r"), F.lit(0).alias("y"))))
    each = found.select("id", F.explode(F.concat(*rows)).alias("c"))
    x = features(F.col("c.k"), F.col("c.v"), F.col("c.l"), F.col("c.r"))
    names = [f"f{i}" for i in range(N_FEATURES)]
    rows = each.select(*[c.cast("int").alias(n) for n, c in zip(names, x, strict=True)], F.col("c.y").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held"))
    table = stored(rows.groupBy(*names, "y", "held").agg(F.count(F.lit(1)).alias("n")), "pii_rows")
    if table.isEmpty():
        return Boosted(0.0, [], [math.inf] * len(KINDS))
    return boost_rows(table)


def find_pii(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, k, end, kind) in code points, end
    exclusive, by start, then kind as listed; ``spans`` has the base spans and the added
    ones. A null text counts as empty. Other columns stay as they are."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans")]
    # the caller's columns travel in one struct, so that none can clash with those made here
    df = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    df = candidate_spans(base_spans(df, "_t"), "_t")
    df = df.withColumn("base", F.array_sort(F.concat(*[F.transform(f"base_{kind}", _span(i)) for i, kind in enumerate(KINDS)])))
    df = df.withColumn("_clear", _clear(df, F.col("base")))
    scored = F.transform("_clear", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"),
                                                      model.margin(features(c["k"], c["v"], c["l"], c["r"])).alias("m")))
    floor = F.array(*[F.lit(float(min(t, 1e300))) for t in model.thresholds])
    df = df.withColumn("_chosen", F.array_sort(F.filter(scored, lambda c: c["m"] >= F.get(floor, c["k"]))))
    better = lambda a, b: (a["m"] > b["m"]) | ((a["m"] == b["m"]) & ((a["e"] - a["s"] > b["e"] - b["s"]) | ((a["e"] - a["s"] == b["e"] - b["s"]) & (F.struct(a["s"], a["k"]) < F.struct(b["s"], b["k"])))))
    chosen = "array<struct<s:int,k:int,e:int,m:double>>"
    alone = _by_cluster(F.col("_chosen"), chosen, chosen, lambda held: F.filter(held, lambda c: ~F.exists(held, lambda o: _meet(o, c) & better(o, c))))
    df = df.withColumn("spans", F.array_sort(F.concat("base", F.transform(alone, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))))
    return df.select("row.*", "base", "spans")


def _meet(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _by_cluster(items: Column, kind: str, out: str, pick) -> Column:
    """``pick`` of every cluster of overlapping items, one after the other, in one walk along
    ``items`` (sorted by start): only items of one cluster are compared with each other."""
    start = F.struct(F.array().cast(f"array<{out}>").alias("full"), F.array().cast(out).alias("part"), F.array().cast(kind).alias("held"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        apart = x["s"] >= a["end"]
        full, part = _append(a, pick(a["held"]))
        return F.struct(F.when(apart, full).otherwise(a["full"]).alias("full"), F.when(apart, part).otherwise(a["part"]).alias("part"),
                        F.when(apart, F.array(x)).otherwise(F.concat(a["held"], F.array(x))).alias("held"),
                        F.when(apart, x["e"]).otherwise(F.greatest(a["end"], x["e"])).alias("end"))
    return F.aggregate(items, start, step, lambda a: F.concat(_added(a), pick(a["held"])))


def _clear(df: DataFrame, base: Column) -> Column:
    """The ``candidates`` of ``df`` that meet no base span."""
    one = df.schema["candidates"].dataType.elementType.simpleString()
    item = lambda x, c: F.struct(x["s"].alias("s"), x["e"].alias("e"), c.cast(one).alias("c"))
    items = F.array_sort(F.concat(F.transform(base, lambda b: item(b, F.lit(None))), F.transform("candidates", lambda c: item(c, c))))
    free = lambda held: F.filter(held, lambda x: x["c"].isNotNull() & ~F.exists(held, lambda b: b["c"].isNull() & _meet(b, x)))
    return _by_cluster(items, f"array<struct<s:int,e:int,c:{one}>>", f"array<{one}>", lambda held: F.transform(free(held), lambda x: x["c"]))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"], x["e"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each selected stretch replaced by ``[KIND]``; overlapping spans are one stretch."""
    name = lambda k: F.upper(F.get(F.array(*[F.lit(x) for x in KINDS]), k))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(
        F.when(x["s"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("["), name(x["k"]), F.lit("]"))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], x["e"]).alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
