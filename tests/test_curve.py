"""The exact precision-recall curve against plain sorting."""

import random

from tagwise.operators import metrics as ME


def brute(rows):
    out = {}
    for label in {r[1] for r in rows}:
        mine = [(s, y) for _, x, y, s in rows if x == label and s is not None]
        pos = sum(y for _, y in mine)
        for t in {s for s, _ in mine}:
            tp, fp = (sum(y == k for s, y in mine if s >= t) for k in (1, 0))
            out[label, t] = (tp, fp, pos, sum(y for s, y in mine if s == t), tp / (tp + fp), tp / pos if pos else 0.0, 2 * tp / (tp + fp + pos))
    return out


def test_curve_and_area_match_sorting(spark):
    r = random.Random(4)
    rows = [(str(i), "hot" if r.random() < 0.7 else r.choice(["a", "b", None]), int(r.random() < 0.3), r.choice([0.1, 0.5, None, r.random()])) for i in range(900)]
    rows += [("x", "none", 0, 0.4), ("y", "none", 0, 0.6)]
    df = spark.createDataFrame(rows, "id string, label string, y int, score double").repartition(6)
    curve = ME.precision_recall_curve(df).cache()
    want = brute(rows)
    got = {(x.label, x.threshold): (x.tp, x.fp, x.pos, x.gain, x.precision, x.recall, x.f1) for x in curve.collect()}
    assert got == want
    for x in ME.curve_summary(curve).collect():
        mine = {t: v for (label, t), v in want.items() if label == x.label}
        assert x.steps == len(mine)
        if x.pos == 0:
            assert (x.average_precision, x.threshold, x.f1) == (None, None, None)
            continue
        f1, t = max((v[6], t) for t, v in mine.items())
        assert (x.threshold, x.f1) == (round(t, 6), round(f1, 6)) and abs(x.average_precision - sum(v[3] * v[4] for v in mine.values()) / x.pos) < 1e-6
    curve.unpersist()


def test_curve_of_no_rows(spark):
    empty = spark.createDataFrame([], "id string, label string, y int, score double")
    assert ME.curve_summary(ME.precision_recall_curve(empty)).count() == 0
