"""Trust-region Newton against a dense solver, on plain arrays."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tagwise.operators import linear as L
from tagwise.operators import models as MO
from tagwise.plans.registry import load_all
from tagwise.sources import io

LABELS = ["a", "b", "none", "all"]


def dense_newton(kind, x, y, c):
    """Newton with the whole Hessian and halved steps until the gradient vanishes."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def parts(w):
        m = y * (x @ w)
        if kind == "svm":
            gap = np.maximum(0, 1 - m)
            return w @ w / 2 + (c * gap**2).sum(), w + x.T @ (-2 * c * y * gap), np.eye(len(w)) + x.T @ (x * (2 * c * (m < 1))[:, None])
        s = 1 / (1 + np.exp(-m))
        return w @ w / 2 + (c * np.logaddexp(0, -m)).sum(), w + x.T @ (c * y * (s - 1)), np.eye(len(w)) + x.T @ (x * (c * s * (1 - s))[:, None])
    for _ in range(500):
        f, g, h = parts(w)
        if np.linalg.norm(g) < 1e-11:
            break
        step, t = np.linalg.solve(h, -g), 1.0
        while parts(w + t * step)[0] > f and t > 1e-9:
            t /= 2
        w = w + t * step
    return w


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(240, 12)) * (r.random((240, 12)) < 0.4)
    noisy = lambda w: x @ w + 0.7 * r.normal(size=240) > 0
    y = np.stack([noisy(r.normal(size=12)), noisy(r.normal(size=12)) & noisy(r.normal(size=12)), np.zeros(240, bool), np.ones(240, bool)], 1)
    vec = lambda i: Vectors.dense(x[i]) if i % 3 == 0 else Vectors.sparse(12, [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])])
    rows = [(str(i), [z for z, has in zip(LABELS, y[i], strict=True) if has], vec(i)) for i in range(240)]
    return x, y, spark.createDataFrame(rows, ["id", "techniques", "features"]).repartition(5).cache()


@pytest.mark.parametrize("kind", ["svm", "logistic"])
def test_coefficients_equal_a_dense_solution(sample, monkeypatch, kind):
    monkeypatch.setattr(L, "BLOCK_VALUES", 100)
    x, y, df = sample
    model = L.fit_linear(MO.training_rows(df, LABELS), 12, LABELS, kind, tolerance=1e-7)
    for i, name in enumerate(LABELS):
        n, pos = len(y), y[:, i].sum()
        if pos in (0, n):
            assert not model.coef[:, i].any() and model.steps[i] == 0
            continue
        c = np.where(y[:, i], n / (2 * pos), n / (2 * (n - pos)))
        assert model.coef[:, i] == pytest.approx(dense_newton(kind, x, np.where(y[:, i], 1.0, -1.0), c), abs=1e-4), name
        assert model.norm[i] <= 1e-7 * model.first_norm[i] and 0 < model.steps[i] < 60


def test_default_tolerance_is_the_references(sample):
    x, y, df = sample
    assert L.TOLERANCE == 1e-4 and L.MAX_STEPS["svm"] == 2000
    model = MO.fit_linear_models(df, LABELS, "svm")
    close = L.fit_linear(MO.training_rows(df, LABELS), 12, LABELS, "svm", tolerance=1e-7)
    assert model.coef == pytest.approx(close.coef, abs=1e-3)


@pytest.mark.parametrize("kind", ["svm", "logistic"])
def test_a_model_read_back_scores_the_same(spark, sample, tmp_path, kind):
    x, y, df = sample
    model, path = MO.fit_linear_models(df, LABELS, kind), str(tmp_path / "models")
    other = L.LinearModel(kind, LABELS, model.coef * 2, model.steps, model.norm, model.first_norm)
    assert io.save_model(spark, model, path) == 1 and io.save_model(spark, other, path) == 2
    first = io.load_model(spark, path, 1)
    assert (io.load_model(spark, path).coef == other.coef).all() and (first.coef == model.coef).all() and first.labels == LABELS
    with pytest.raises(ValueError):
        io.load_model(spark, path, 9)
    z = np.hstack([x, np.ones((len(x), 1))]) @ model.coef
    want = np.where(model.coef.any(0), 1 / (1 + np.exp(-z)), 0.0) if kind == "logistic" else z
    got = {(r.id, r.label): r for r in MO.score_long(MO.linear_scorer(first, spark), df, LABELS).collect()}
    assert len(got) == 240 * len(LABELS)
    for i in range(240):
        for k, name in enumerate(LABELS):
            assert got[str(i), name].score == pytest.approx(want[i, k], abs=1e-9) and got[str(i), name].y == y[i, k]


def test_any_scorer_fits(sample):
    _, _, df = sample
    rows = MO.score_long(lambda v: F.array(*[F.lit(float(i)) for i in range(4)]), df, LABELS).where("id = '3'").collect()
    assert {r.label: r.score for r in rows} == {"a": 0.0, "b": 1.0, "none": 2.0, "all": 3.0}


def test_svm_query_reports_its_end(spark, sf):
    rows = load_all()["ovr_linear_svc"].fn(spark, sf).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.steps == 0 or r.last_gradient < 1e-4 * r.first_gradient


def test_passes_are_those_of_the_slowest_label(sample):
    _, _, df = sample
    alone = [L.fit_linear(MO.training_rows(df, [x]), 12, [x], "logistic") for x in LABELS[:2]]
    model = L.fit_linear(MO.training_rows(df, LABELS[:2]), 12, LABELS[:2], "logistic")
    assert model.passes == max(m.passes for m in alone)
    assert model.steps.tolist() == [m.steps[0] for m in alone]
    assert model.coef == pytest.approx(np.hstack([m.coef for m in alone]), abs=1e-9)


def test_plain_and_sparse_blocks_give_the_same(sample, monkeypatch):
    _, _, df = sample
    fits = []
    for cells in (0, 40):
        monkeypatch.setattr(L, "PLAIN_CELLS", cells)
        fits.append(L.fit_linear(MO.training_rows(df, LABELS[:2]), 12, LABELS[:2], "svm"))
    assert fits[0].coef == pytest.approx(fits[1].coef, abs=1e-9)


@pytest.mark.parametrize("size", [1 << 16, (1 << 16) + 1])
def test_blocks_hold_the_places_of_all_features(spark, size):
    """Two bytes each where they are enough, the last place (the constant feature) included."""
    rows = spark.createDataFrame([(Vectors.sparse(size - 1, [(0, 2.0), (size - 2, 3.0)]), [1.0], [1.0])], ["features", "y", "c"])
    blocks = L.pack(rows, size - 1)
    assert len(blocks.first()["columns"]) == 3 * (2 if size <= 1 << 16 else 4)
    w = np.zeros((size, 1))
    w[[0, size - 2, size - 1], 0] = 1, 10, 100
    got = L._summed(blocks, 1, lambda b: b.back(b.times(w)), (size, 1), 1, size)
    assert got[[0, size - 2, size - 1], 0].tolist() == [264.0, 396.0, 132.0]


def test_model_rows_leave_the_parts_of_the_features(spark, sf):
    from tagwise.plans import q_models as Q

    assert Q._model_rows(spark, sf).columns == ["id", "split", "techniques", "features"]
