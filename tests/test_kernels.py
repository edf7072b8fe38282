"""The support-vector head: how near the least loss it comes, what it learns, and that folds stay apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeworks.operators import kernels

SCHEMA = "id long, x array<double>, y double, fold int, inner int"


def speakers(n=300, noise=20, seed=0):
    """Rows of speakers with a score, features that tell the speaker and features that tell nothing."""
    rng = np.random.default_rng(seed)
    who = np.repeat(np.arange(n // 3), 3)
    level = rng.normal(size=n // 3)[who]
    x = np.column_stack([level + 0.2 * rng.normal(size=n), rng.normal(size=(n // 3, 4))[who], rng.normal(size=(n, noise))])
    y = np.clip(np.round((3 + level) * 2) / 2, 1, 5)
    return x, y, who % 5, who // 5 % 3


def frame(spark, x, y, fold, inner):
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i]), int(inner[i])) for i in range(len(y))], SCHEMA)


def rbf(z):
    """The kernel of standardised, turned rows, all in plain numpy."""
    z = (z - z.mean(0)) / (z.std(0) + 1e-6)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    z = z @ vectors[:, ::-1]
    return np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (z.shape[1] * z.var()))


def least(k, y, cost, epsilon, rounds=6000, seed=0):
    """The dual optimum by exact steps on pairs of variables: a lower bound of the loss."""
    rng, a, ka = np.random.default_rng(seed), np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        i, j = rng.choice(len(y), 2, replace=False)
        curve = k[i, i] + k[j, j] - 2 * k[i, j]
        low, high = max(-cost - a[i], a[j] - cost), min(cost - a[i], a[j] + cost)
        spots = {low, high, *[d for d in (-a[i], a[j]) if low <= d <= high]}
        for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
            if curve > 1e-12:
                spots.add(float(np.clip((y[i] - y[j] - ka[i] + ka[j] - epsilon * (s - t)) / curve, low, high)))
        gain = lambda d: d * (y[i] - y[j] - ka[i] + ka[j]) - 0.5 * curve * d * d - epsilon * (abs(a[i] + d) + abs(a[j] - d))  # noqa: B023, E731
        d = max(spots, key=gain)
        a[i], a[j] = a[i] + d, a[j] - d
        ka += d * (k[i] - k[j])
    return y @ a - epsilon * np.abs(a).sum() - 0.5 * a @ k @ a


@pytest.mark.parametrize(("cost", "epsilon"), [(0.3, 0.2), (10.0, 0.05)])
def test_loss_is_near_the_least_where_landmarks_are_all_rows(spark, cost, epsilon):
    x, y, fold, inner = speakers(90, 2)
    _, models = kernels.support_vectors(frame(spark, x, y, fold % 2, 0 * inner), "id", "x", "y", "fold", "inner", 2, 1, landmarks=90, costs=(cost,), epsilons=(epsilon,), tolerance=0.002)
    assert len(models) == 2
    for f, m in enumerate(models):
        own = fold % 2 != f
        k = rbf(x[own])
        assert m.done and 0 <= m.gap <= 0.002
        loss = 0.5 * m.z[:-1] @ m.z[:-1] + cost * np.maximum(np.abs(y[own] - m.predicted(x[own])) - epsilon, 0).sum()
        bound = least(k, y[own], cost, epsilon)
        assert bound - 1e-6 <= loss <= bound + 0.006 * abs(loss)


def test_grid_predicts_every_row_and_learns(spark):
    x, y, fold, inner = speakers()
    out, models = kernels.support_vectors(frame(spark, x, y, fold, inner).repartition(3), "id", "x", "y", "fold", "inner", 5, landmarks=64, costs=(0.3, 3.0), epsilons=(0.05, 0.2))
    got = out.toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(300)) and np.isfinite(got["pred"]).all()
    assert np.corrcoef(got["y"], got["pred"])[0, 1] > 0.75
    assert len(models) == 5 and all(m.done and m.gap <= 0.01 for m in models)
    # a row's own score is nothing that its prediction knows of
    noise = np.random.default_rng(2).permutation(y)
    lost, _ = kernels.support_vectors(frame(spark, x, noise, fold, inner), "id", "x", "y", "fold", "inner", 5, landmarks=64, costs=(10.0,), epsilons=(0.05,))
    got = lost.toPandas()
    assert abs(np.corrcoef(got["y"], got["pred"])[0, 1]) < 0.3


def test_dual_variables_stay_in_their_box_and_balance():
    rng = np.random.default_rng(1)
    k, y = rng.normal(size=(50, 4)), rng.normal(size=50)
    soft, exact, up, up_y, down, down_y = kernels.loss_sums(y, np.zeros(50), k, 2.0, 0.1, 0.05)[: kernels.HEAD]
    assert 0 <= soft <= exact <= soft + 2.0 * 50 * 0.025 and 0 <= up <= 100 and -100 <= down <= 0
    got = kernels.loss_sums(y, y, k, 2.0, 0.1, 0.05)
    assert not got.any()


def test_empty_and_constant(spark):
    empty, models = kernels.support_vectors(spark.createDataFrame([], SCHEMA), "id", "x", "y", "fold", "inner", 3)
    assert empty.count() == 0 and models == []
    rows = spark.createDataFrame([(i, [1.0, 2.0], 4.0, i % 2, i % 3) for i in range(12)], SCHEMA)
    out, _ = kernels.support_vectors(rows, "id", "x", "y", "fold", "inner", 2, costs=(1.0,), epsilons=(0.05,))
    assert out.where(F.abs(F.col("pred") - 4) > 0.06).count() == 0 and out.count() == 12


def test_equal_rows_share_their_kernel_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y, f, at = rng.normal(size=400), rng.normal(size=7), np.sort(rng.integers(0, 7, 400))
    k = rng.normal(size=(7, 5))
    assert np.allclose(kernels.loss_sums(y, f[at], k[at], 2.0, 0.1, 0.05), kernels.loss_sums(y, f[at], k, 2.0, 0.1, 0.05, at))
    x, place = kernels.runs(np.array([[1.0, 2.0], [1.0, 2.0], [1.0, 3.0], [1.0, 2.0]]))
    assert x.tolist() == [[1, 2], [1, 3], [1, 2]] and place.tolist() == [0, 0, 1, 2]
    stood = []  # whole passes: no row is lost where a batch holds rows of many folds
    one = kernels.array_sums
    monkeypatch.setattr(kernels, "array_sums", lambda *how: stood.append(one(*how)) or stood[-1])
    df = spark.range(6000).select("id", F.array((F.col("id") % 11).cast("double"), (F.col("id") % 3).cast("double")).alias("x"), F.sin(F.col("id") % 11).alias("y"), (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("inner"))
    out, models = kernels.support_vectors(df, "id", "x", "y", "fold", "inner", 5, 2, landmarks=32, costs=(1.0,), epsilons=(0.05,))
    assert out.where("abs(pred - y) < 0.2").count() == 6000 and all(m.done for m in models)
    first = stood[0][2].reshape(34, 34)  # fold 0, all inner parts
    assert first[-2, -2] == 4800
    rows = np.array([np.sin(i % 11) for i in range(6000) if i % 5 != 0])
    assert np.allclose([first[-2, -1], first[-1, -1]], [rows.sum(), rows @ rows])


def test_sorted_truths_give_the_sums_of_single_rows_and_models_settle_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(9, 2)), 60, axis=0)
    x = x[np.lexsort(x.T[::-1])]
    y = 100 + 30 * rng.normal(size=540)
    at = kernels.runs(x)[1]
    y, fold, inner = y[np.lexsort((y, at))], rng.integers(0, 3, 540), rng.integers(0, 2, 540)
    kinds, kind = np.unique(np.column_stack([fold, inner]), axis=0, return_inverse=True)
    pack = kernels.Pack(kernels.runs(x)[0], at, y, kind.ravel(), kinds)
    own = pack.own(1, 0)
    assert (own == (fold != 1) & (inner != 0)).all() and (pack.own(1, 0, True) == (fold != 1) & (inner == 0)).all() and (pack.own(1, None) == (fold != 1)).all()
    f, k, how = 100 + 20 * rng.normal(size=(9, 3)), rng.normal(size=(9, 4)), (np.array([0.3, 2.0, 10.0]), np.array([0.05, 0.2, 4.0]), np.array([9.0, 0.5, 1e-6]))
    got = kernels.Sorted(pack).losses(own, f, k, *how)
    for j in range(3):
        assert np.allclose(got[j], kernels.loss_sums(y[own], f[at[own], j], k, *(h[j] for h in how), at[own]), rtol=1e-9, atol=1e-6)
    passes = []
    one = kernels.array_sums
    monkeypatch.setattr(kernels, "array_sums", lambda *a: passes.append(1) or one(*a))
    u = lambda n: F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(1000)) / 1000
    df = spark.range(0, 60_000, 1, 4).select("id", F.array(F.floor(u(1) * 50).cast("double"), F.floor(u(2) * 9).cast("double")).alias("x"), (u(3) * 100 + F.floor(u(1) * 50)).alias("y"), (F.col("id") % 2).cast("int").alias("fold"), F.lit(0).alias("inner"))
    out, models = kernels.support_vectors(df, "id", "x", "y", "fold", "inner", 2, 1, landmarks=48, costs=(0.3, 10.0), epsilons=(0.05,))
    assert all(m.done and m.gap <= 0.01 for m in models) and len(passes) < 20
    assert out.where("pred is null or isnan(pred)").count() == 0 and out.count() == 60_000
