"""Golden values, invariants and edge cases of the core operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeworks.functions import metrics, scalars, text, vectors
from gradeworks.operators import binning, blending, features, folds, heads, inference, linkage, metric, relations, resampling, sequences, stacking
from gradeworks.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_metric_identities(spark):
    df = spark.createDataFrame([(float(i), float(i), i + 1.0, 0.5 * i + 1, 7.0) for i in range(1, 6)], "y double, same double, shifted double, affine double, flat double")
    one = lambda p: metrics.report(df, [], "y", p).first()
    assert one("same").composite == pytest.approx(0.0) and one("same").pearson == pytest.approx(1.0)
    assert one("shifted").composite == pytest.approx(0.6)
    assert one("flat").pearson == 0.0
    a, b = stacking.line(df, "affine", "y").first()
    assert (a, b) == (pytest.approx(-2.0), pytest.approx(2.0))


def test_weights_equal_repeated_rows(spark):
    rng = np.random.default_rng(0)
    data = [(float(y), float(y + e), int(w)) for y, e, w in zip(rng.uniform(1, 5, 200), rng.normal(0, 0.5, 200), rng.integers(1, 4, 200), strict=True)]
    df = spark.createDataFrame(data, "y double, p double, w int")
    long = df.withColumn("k", F.explode(F.sequence(F.lit(1), "w")))
    a, b = metrics.report(df, [], "y", "p", "w").first(), metrics.report(long, [], "y", "p").first()
    assert a.rmse == pytest.approx(b.rmse, abs=1e-9) and a.pearson == pytest.approx(b.pearson, abs=1e-9)


def test_buckets_and_clip(spark):
    df = spark.createDataFrame([(30.0,), (45.0,), (50.0,), (60.07,), (float("nan"),), (None,)], "d double")
    got = [r[0] for r in df.select(scalars.bucket(F.col("d"), [44.5, 45.5, 59.5])).collect()]
    assert got == [0, 1, 2, 3, 3, None]
    assert [r[0] for r in df.select(scalars.clip(F.col("d"), 40, 55)).collect()][:4] == [40, 45, 50, 55]
    assert df.select(scalars.clip(F.col("d"), 40, 55)).collect()[5][0] is None


def test_importance_weights(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "pop int")
    got = sorted(r.weight for r in binning.importance_weights(one([3, 3, 3, 1]), one([1, 1, 3, 0]), "pop").collect())
    assert got == pytest.approx([4 / 9, 4 / 9, 4 / 9, 8 / 3])


def test_bins_of_constant_and_empty_columns(spark):
    flat = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert sorted((r.bin is None, r.bin) for r in binning.equal_bins(flat, "x", 8).collect()) == [(False, 0), (False, 0), (True, None)]
    spread = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    counts = lambda **how: sorted(r["count"] for r in binning.quantile_bins(spread, "x", 5, **how).groupBy("bin").count().collect())
    assert counts() == [200] * 5 and all(abs(n - 200) <= 2 for n in counts(accuracy=10_000))
    empty = flat.where("false")
    assert binning.quantile_bins(empty, "x", 5).count() == 0
    assert [r.n for r in binning.histogram(flat.select(F.lit(1).alias("b")), "b", 3).orderBy("b").collect()] == [0, 3, 0]


def test_calibration_is_exact(spark):
    rng = np.random.default_rng(1)
    offsets = [0.3, -0.2, 0.1, 0.0]
    data = [(int(g), float(y), float((y - offsets[g]) / 1.7)) for g, y in zip(rng.integers(0, 4, 300), rng.uniform(1, 5, 300), strict=True)]
    df = spark.createDataFrame(data, "pop int, y double, raw double")
    fitted = {r.pop: (r.a, r.b) for r in stacking.calibration(df, "pop", "raw", "y").collect()}
    for g, (a, b) in fitted.items():
        assert a == pytest.approx(offsets[g], abs=1e-8) and b == pytest.approx(1.7, abs=1e-8)
    other = spark.createDataFrame([(9, 1.0)], "pop int, raw double")
    assert stacking.calibrated(other, stacking.calibration(df, "pop", "raw", "y"), "pop", "raw").first().pred == pytest.approx(1.7 + np.mean([a for a, _ in fitted.values()]))


def test_ridge_against_direct_solution(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(200, 5)), rng.uniform(0.5, 2, 200)
    y = x @ [1.0, -2, 0, 0.5, 3] + rng.normal(size=200) + 4
    df = spark.createDataFrame([(0, [float(v) for v in a], float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "k int, x array<double>, y double, w double")
    gram = heads.grams(df, "x", "y", "k", "w")[0]
    for alpha, (coef, intercept) in zip((0.0, 10.0), heads.ridge(gram, (0.0, 10.0)), strict=True):
        mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
        xc = x - mx
        want = np.linalg.solve((xc * w[:, None]).T @ xc + alpha * np.eye(5), (xc * w[:, None]).T @ (y - my))
        assert np.allclose(coef, want, atol=1e-6) and intercept == pytest.approx(my - mx @ want, abs=1e-6)


def test_cross_validated_ridge_covers_rows_and_does_not_leak(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(v) for v in rng.normal(size=30)], float(rng.normal()), i % 5, i // 5 % 3) for i in range(200)]
    df = spark.createDataFrame(data, "id int, x array<double>, y double, fold int, inner int")
    oof, alphas = heads.cv_ridge(df, "id", "x", "y", "fold", "inner", 5, augmented=df)
    got = oof.collect()
    assert sorted(r.id for r in got) == list(range(200)) and len(alphas) == 5
    assert abs(np.corrcoef([r.y for r in got], [r.pred for r in got])[0, 1]) < 0.3


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 6))
    y = p @ [0.5, 0, 0.3, 0, -0.4, 0.2] + 1 + 0.1 * rng.normal(size=300)
    z = np.column_stack([np.ones(300), p, y])
    coef, b = stacking.nnls(z.T @ z)
    slope = p.T @ (y - p @ coef - b)
    assert (coef >= 0).all() and np.abs(slope[coef > 0]).max() < 1e-6 and slope[coef == 0].max() < 1e-6


def test_blend_stays_convex_and_beats_its_parts():
    rng = np.random.default_rng(5)
    y = rng.normal(3, 1, 400)
    p = np.column_stack([y + rng.normal(0, 0.6, 400), y + rng.normal(0, 0.7, 400), rng.normal(3, 1, 400)])
    z = np.column_stack([np.ones(400), p, y])
    w, a, b, score = blending.convex_blend(z.T @ z)
    single = [0.6 * np.sqrt(np.mean((y - q) ** 2)) + 0.4 * (1 - np.corrcoef(y, q)[0, 1]) for q in p.T]
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and 0.9 <= b <= 1.1 and abs(a) <= 1 and score < min(single)


def test_identification_finds_the_formula():
    var_p, sd, r, bias = 0.6, 1.0, 0.8, 0.1
    cov = r * sd * var_p**0.5
    base = sd * sd + var_p - 2 * cov + bias**2
    e = np.sqrt([base, base - bias + 0.25, base - 2 * bias + 1, base - 3 * bias + 2.25, base - 0.75 * var_p + cov])
    found = blending.identify(0.6 * e + 0.4 * (1 - r), var_p)
    assert found[0][0].startswith("0.6") and found[0][1] < 1e-4


def test_interval_join_edges(spark):
    points = spark.createDataFrame([(1, 0.0, 2.0), (1, 4.0, 6.0), (1, 9.0, 11.0), (2, 0.0, 2.0)], "k int, s double, e double")
    windows = spark.createDataFrame([(1, 1.0, 5.0), (1, 5.0, 10.0), (1, 3.0, 3.0)], "k int, lo double, hi double")
    got = relations.in_intervals(points, windows, "k", "s", "e", "lo", "hi", 2.0)
    assert sorted((r.s, r.lo) for r in got.collect()) == [(0.0, 1.0), (4.0, 5.0)]


def test_neighbours_and_pairs_over_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x[1] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    sims = x @ x.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if sims[i, j] > 3}
    assert {(r.a, r.b) for r in relations.similar_pairs(df, "id", "v", 3.0, block_rows=9).collect()} == want
    np.fill_diagonal(sims, -np.inf)
    got = {r.id: r.nn for r in relations.nearest(df, df, "id", "v", block_rows=9).collect()}
    assert got == {i: int(sims[i].argmax()) for i in range(60)}


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_metric_index_skips_blocks_and_loses_nothing(spark, monkeypatch, spread):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(12, 8)) * 3)[np.arange(600) % 12] + spread * rng.normal(size=(600, 8))
    x[5], x[7] = x[17], 0.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    sims, met = x @ x.T, []
    one = metric.multiplied
    monkeypatch.setattr(metric, "multiplied", lambda a, b, pairs, *how: (met.append(pairs.count()), one(a, b, pairs, *how))[1])
    cut = float(np.quantile(sims, 0.95))
    got = {(r.a, r.b): r.sim for r in relations.similar_pairs(df, "id", "v", cut, block_rows=20).collect()}
    want = {(i, j): sims[i, j] for i in range(600) for j in range(i + 1, 600) if sims[i, j] > cut}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    np.fill_diagonal(sims, -np.inf)
    got = {r.id: r.nn for r in relations.nearest(df, df, "id", "v", block_rows=20).collect()}
    assert all(abs(sims[i, got[i]] - sims[i].max()) < 1e-9 for i in range(600)) and len(got) == 600
    blocks = 600 // 20
    if spread < 1:  # tight groups far apart: few pairs of blocks can hold a result
        assert met[0] < 0.4 * blocks * (blocks + 1) / 2 and met[1] + met[2] < 0.5 * blocks**2


def test_rows_go_to_neighbourhoods_and_forests_connect_what_all_pairs_connect(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 6))
    df = spark.createDataFrame([((1 << 60) + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    rows = metric.plain(df, "id", "v")
    index = metric.indexed(rows, metric.chosen_pivots(rows), 10)
    sent = lambda: metric.multiplied(index, index, metric.block_pairs(index, index), lambda a, b, i, j: pd.DataFrame({"n": [len(a) * len(b)]}), "n long", lambda t: pd.DataFrame({"n": [t["n"].sum()]}))
    assert index.blocks.count() >= 40
    got = sent().toPandas()["n"]
    assert got.sum() == 400 * 400 and len(got) <= 100  # not one task's group for each of 1,600 pairs of blocks
    every = {(r.a, r.b) for r in relations.similar_pairs(df, "id", "v", 7.0, block_rows=10).collect()}
    some = {(r.a, r.b) for r in relations.spanning(df, "id", "v", 7.0, block_rows=10).collect()}
    assert len(some) < len(every)

    def groups(pairs):
        root = {}
        for a, b in pairs:
            a, b = root.get(a, {a}), root.get(b, {b})
            if a is not b:
                a |= b
            root |= dict.fromkeys(a, a)
        return {frozenset(g) for g in root.values()}

    assert groups(some) == groups(every)


def test_average_linkage_in_rounds_is_that_of_one_matrix(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 6))[np.arange(90) % 20] + 0.4 * rng.normal(size=(90, 6))
    x[3], x[11] = x[80], x[80]
    df = spark.createDataFrame([(7 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    cuts = [0.02, 0.1, 0.3, 0.7]
    got = linkage.clustered(df, "id", "v", cuts).toPandas().sort_values("id")
    merges = folds.average_linkage(x)
    for t in cuts:
        mine, want = got[got["threshold"] == t]["cluster"].to_numpy(), folds.cut(merges, len(x), t)
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    assert (got["cluster"] <= got["id"]).all()
    tree = linkage.merge_tree(df, "id", "v", 0.7).toPandas()
    assert tree["child"].is_unique and (tree["child"] > tree["parent"]).all() and (tree["height"] < 0.7).all()
    assert linkage.clustered(df.where("id < 0"), "id", "v", [0.5]).count() == 0 and linkage.clustered(df.where("id = 7"), "id", "v", [0.5]).count() == 1


def test_average_linkage_takes_few_rounds_for_near_and_equal_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(2, 12))
    x = np.concatenate([centers[np.arange(120) % 2] + 0.03 * rng.normal(size=(120, 12)), np.repeat(rng.normal(size=(1, 12)), 30, axis=0), rng.normal(size=(30, 12))])
    df = spark.createDataFrame([(5 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    one, labels = linkage.written, []
    monkeypatch.setattr(linkage, "written", lambda t, label: labels.append(label) or one(t, label))
    monkeypatch.setattr(linkage, "LEAST_ROWS", 70)  # several blocks
    monkeypatch.setattr(linkage, "CELLS", 70 * 12)
    got = linkage.clustered(df, "id", "v", [0.001, 0.3, 0.8]).toPandas().sort_values("id")
    merges = folds.average_linkage(x)
    for t in (0.001, 0.3, 0.8):
        mine, want = got[got["threshold"] == t]["cluster"].to_numpy(), folds.cut(merges, len(x), t)
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    assert labels.count("nearest") <= 8
    # groups that are cut give the same tree, in more rounds
    monkeypatch.setattr(linkage, "MOST_MEMBERS", 12)
    again = linkage.clustered(df.where("id < 150"), "id", "v", [0.3]).toPandas().sort_values("id")
    mine, want = again["cluster"].to_numpy(), folds.cut(folds.average_linkage(x[:30]), 30, 0.3)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_boosted_trees_are_fitted_on_distinct_rows_in_bounded_tasks(spark, monkeypatch):
    few = spark.range(600).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    kept = heads.tree_rows(few, ["a", "b"], "y", "fold", {})
    assert kept.count() == 30 and kept.agg(F.sum("__n"), F.round(F.sum(F.col("__n") * F.col("__y")), 6)).first() == (600.0, float(sum(i % 7 for i in range(600))))
    monkeypatch.setattr(heads, "TREE_ROWS", 100)
    assert heads.tree_rows(few, ["a", "b"], "y", "fold", {"subsamplingRate": 0.5}).rdd.getNumPartitions() == 6


def test_leakage_counts_the_pairs_that_lie_apart(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(3 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    clusters = spark.createDataFrame([(3 * i, t, i % k) for i in range(90) for t, k in ((0.1, 7), (0.2, 2))], "id long, threshold double, cluster long")
    a, b = np.nonzero(np.triu(x @ x.T > 2.0, 1))
    want = [(t, len(a), int((a % k != b % k).sum())) for t, k in ((0.1, 7), (0.2, 2))]
    for block in (None, 16):
        assert rows(relations.leakage(df, "id", "v", 2.0, clusters, block), "threshold") == want


def test_average_linkage_recovers_groups_and_folds_keep_them_whole(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 64))
    who = np.repeat(np.arange(12), 5)
    x = centers[who] + 0.1 * rng.normal(size=(60, 64))
    labels = folds.cut(folds.average_linkage(x), 60, 0.3)
    assert len(set(zip(who.tolist(), labels.tolist(), strict=True))) == 12 == len(set(labels.tolist()))
    df = spark.createDataFrame([(i, int(g), int(i % 3)) for i, g in enumerate(labels)], "id int, grp int, bin int")
    out = folds.folds(df, "id", "grp", "bin", 4, (0, 1))
    assert out.count() == 120 and folds.leaked_groups(out, "grp").count() == 0
    assert folds.folds(df.where("false"), "id", "grp", "bin").count() == 0


def test_average_linkage_against_the_naive_algorithm():
    rng = np.random.default_rng(11)
    for _ in range(5):
        x = rng.normal(size=(25, 4))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - unit @ unit.T
        groups = [[i] for i in range(25)]
        while len(groups) > 1:
            h, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
            if h >= 0.5:
                break
            groups[a] += groups.pop(b)
        labels = folds.cut(folds.average_linkage(x), 25, 0.5)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())}


def test_single_linkage(spark):
    df = spark.range(6).withColumnRenamed("id", "v")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long")
    assert rows(folds.single_linkage(df, pairs, "v"), "id") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4)]


def test_bands(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5.0, 1.0, 1.0, 1.0, 1.0, 9.0, 2.0, 2.0, 2.0, 2.0])] + [("b", i, 1.0) for i in range(4)], "k string, i int, s double")
    assert rows(sequences.best_bands(df, ["k"], "i", "s"), "k") == [("a", 1, 5, 6, 10), ("b", 0, 4, None, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Well, I I don't know.  Is that so? Yes!",), ("",), ("no stop",)], "t string")
    got = df.select(text.tokens(F.col("t")).alias("w"), text.sentences(F.col("t")).alias("s"), text.chunks(text.tokens(F.col("t")), 4).alias("c")).collect()
    assert got[0].w == ["well", "i", "i", "don't", "know", "is", "that", "so", "yes"] and got[0].s == ["Well, I I don't know.", "Is that so?", "Yes!"]
    assert got[1].s == [] and got[1].c == [""] and got[2].s == ["no stop"] and got[0].c == ["well i i don't", "know is that so", "yes"]
    pair = spark.createDataFrame([(["he", "go", "to", "school"], ["he", "goes", "school"]), ([], ["a", "b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(text.word_error_rate(F.col("a"), F.col("b"))).collect()] == [0.5, 2.0]
    assert [r[0] for r in pair.select(text.word_levenshtein(F.col("a"), F.col("b"))).collect()] == [2, 3]


def test_word_distance_and_window_shares_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lists = [[f"w{rng.integers(0, kinds)}" for _ in range(n)] for kinds, n in ((3, 0), (3, 10), (5, 24), (5, 25), (8, 26), (400, 300), (4, 120), (70000, 900))]

    def edits(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        table[:, 0], table[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = min(table[i, j + 1] + 1, table[i + 1, j] + 1, table[i, j] + (a[i] != b[j]))
        return int(table[-1, -1])

    def share(t, window=25):
        runs = [t[i : i + window] for i in range(len(t) - window + 1)] or [t]
        return float(np.mean([len(set(r)) / max(len(r), 1) for r in runs])) if t else 0.0

    pairs = [(a, b) for a in lists[:6] for b in lists[:7]] + [(lists[7], lists[7][::2])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.word_levenshtein(F.col("a"), F.col("b"))).collect()] == [edits(a, b) for a, b in pairs]
    one = spark.createDataFrame([(x,) for x in lists], "t array<string>")
    assert np.allclose([r[0] for r in one.select(text.mattr(F.col("t"))).collect()], [share(t) for t in lists])


def test_segment_means_round_edges_half_to_even(spark):
    df = spark.createDataFrame([(7, [float(i) for i in range(7)]), (3, [10.0, 20.0, 30.0]), (0, [])], "id int, v array<double>")
    got = {(r.id, r.segment): r["mean"] for r in sequences.segment_means(df, "id", "v", 4).collect()}
    want = {}
    for n, v in ((7, np.arange(7.0)), (3, np.array([10.0, 20.0, 30.0]))):
        edges = np.linspace(0, n, 5).round().astype(int)
        want |= {(n, j): float(v[a:b].mean() if b > a else v[min(a, n - 1)]) for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))}
    assert got == want and len(got) == 8


def test_truncated_svd_equals_numpy(spark):
    rng = np.random.default_rng(4)
    a = rng.random((40, 25)) * (rng.random((40, 25)) < 0.3) + np.outer(np.arange(40) % 3, np.arange(25) % 2) * 0.8
    rows = [(i, f"t{j}", float(a[i, j])) for i in range(40) for j in range(25) if a[i, j]]
    got = {r.id: r.vec for r in features.truncated_svd(spark.createDataFrame(rows, "id int, term string, weight double"), "id", 3, rounds=12).collect()}
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    want = a @ vt[:3].T
    mine = np.array([got[i] for i in range(40)])
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-3) and np.allclose(np.linalg.norm(mine, axis=0), s[:3], atol=1e-3)


def test_fourier_features_approach_the_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) * [3.0, 0.5] + [1.0, -2.0]
    df = spark.createDataFrame([(i, v.tolist(), float(np.sin(v[0]) + v[1]), i % 5, i % 3) for i, v in enumerate(x)], "id int, x array<double>, y double, fold int, inner int")
    phi = np.array([r.phi for r in heads.fourier_features(df, "x", 2, features=1024, gamma=0.2).orderBy("id").collect()])
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    kernel = np.exp(-0.2 * ((z[:, None] - z[None]) ** 2).sum(2))
    assert np.abs(phi @ phi.T - kernel).max() < 0.15
    out = heads.kernel_ridge(df, "id", "x", 2, "y", "fold", "inner", 5)
    assert out.count() == 60 and out.where("pred is null").count() == 0


def direct_stack(p, y, fold, pop, fit, judge, columns):
    """Composite of clipped out-of-fold predictions, each fold's stack fitted on the other rows themselves."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        tr, va = fold != f, fold == f
        z = np.column_stack([np.ones(tr.sum()), p[tr][:, columns], y[tr]])
        coef, c = stacking.nnls((z * fit[tr, None]).T @ z)
        raw = p[:, columns] @ coef + c
        design = np.column_stack([raw, np.eye(3)[pop]]) if pop is not None else np.column_stack([raw, np.ones(len(y))])
        beta = np.linalg.lstsq(design[tr] * np.sqrt(fit[tr, None]), y[tr] * np.sqrt(fit[tr]), rcond=None)[0]
        if pop is not None:
            there = np.bincount(pop[tr], minlength=3) > 0
            beta[1:][~there] = beta[1:][there].mean()
        out[va] = np.clip(design[va] @ beta, 1, 5)
    return out, composite(y, out, judge)


def composite(y, p, w):
    w = w / w.sum()
    my, mp = w @ y, w @ p
    r = (w @ ((y - my) * (p - mp))) / np.sqrt((w @ (y - my) ** 2) * (w @ (p - mp) ** 2))
    return 0.6 * np.sqrt(w @ (y - p) ** 2) + 0.4 * (1 - r)


@pytest.mark.parametrize("populations", [False, True])
def test_nested_stack_is_that_of_direct_computation(spark, populations):
    rng = np.random.default_rng(6)
    n = 240
    y = rng.uniform(1, 5, n)
    pop = rng.integers(0, 3, n)
    p = y[:, None] + rng.normal(size=(n, 4)) * [0.4, 0.6, 0.8, 3.0] + np.array([0.0, 1.0, -2.0])[pop][:, None] * populations
    folds_ = np.column_stack([np.arange(n) % 4, rng.integers(0, 3, n)])
    pop[(folds_[:, 0] == 1) & (pop == 2)] = 0
    fit, judge = rng.uniform(0.5, 2, n), rng.uniform(0.5, 2, n)
    rows = [([float(v) for v in p[i]], float(y[i]), int(folds_[i, 0]), int(folds_[i, 1]), int(pop[i]), float(fit[i]), float(judge[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "x array<double>, y double, f0 int, f1 int, pop int, fit double, judge double").repartition(3)
    how = {"population": "pop" if populations else None, "w_fit": "fit", "w_judge": "judge"}
    q = pop if populations else None
    score, each, _ = stacking.nested(df, "x", "y", ["f0", "f1"], **how)
    direct = [direct_stack(p, y, folds_[:, s], q, fit, judge, [0, 1, 2, 3]) for s in (0, 1)]
    assert np.allclose(each, [d[1] for d in direct], atol=1e-8) and abs(score - composite(y, np.mean([d[0] for d in direct], axis=0), judge)) < 1e-8
    # removal by removal, against all subsets scored directly
    way = stacking.pruned(df, "x", "y", ["f0"], most=2, tolerance=1e-4, **how)
    assert way[0][0] == (0, 1, 2, 3) and [len(c) for c, _ in way] == list(range(4, 4 - len(way), -1)) and len(way[-1][0]) <= 2
    for (before, _), (after, got) in zip(way, way[1:], strict=False):
        scores = [direct_stack(p, y, folds_[:, 0], q, fit, judge, [c for c in before if c != out])[1] for out in before]
        assert abs(min(scores) - got) < 1e-8 and after == tuple(c for c in before if c != before[int(np.argmin(scores))])
    if len(way[-1][0]) > 1:
        left = way[-1][0]
        assert min(direct_stack(p, y, folds_[:, 0], q, fit, judge, [c for c in left if c != out])[1] for out in left) > min(s for _, s in way) + 1e-4


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2.0])], "id int, v array<double>")
    center = vectors.mean_vector(df, "v")
    assert center.first().center == [1.0, 1.0]
    assert [r.v for r in vectors.centred_unit(df, "v", center).orderBy("id").collect()] == [[0.0, -1.0], [0.0, 1.0]]
    assert vectors.centred_unit(df.where("id = 0"), "v", vectors.mean_vector(df.where("id = 0"), "v")).first().v == [0.0, 0.0]


def test_bootstrap_draws_average_one(spark):
    d = spark.range(20000).select(resampling.draws(F.col("id"), F.lit(3)).alias("d")).agg(F.avg("d"), F.var_pop("d")).first()
    assert d[0] == pytest.approx(1, abs=0.05) and d[1] == pytest.approx(1, abs=0.1)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("x", "a1.wav", 2.0)], "k string, clip_name string, score double")
    assert files.id_and_label(df) == ("clip_name", "score")
    with pytest.raises(ValueError):
        files.metadata({"train": df.union(df)}, "clip_name").count()
    ids = spark.createDataFrame([(2, 0), (1, 1), (3, 2)], "id int, place int")
    preds = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id int, p double")
    assert [tuple(r) for r in files.submission(ids, preds, "id", "p", "place").collect()] == [(2, 0.2), (1, 0.1), (3, 0.3)]
    with pytest.raises(ValueError):
        files.submission(ids, preds.where("id < 3"), "id", "p", "place")
    with pytest.raises(KeyError):
        relations.reindexed(ids, preds.where("id < 3"), "id", "place")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.wav").write_bytes(b"x")
    (tmp_path / "deep" / "train.csv").write_text("a\n")
    for place in ("audios/train", "test"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "d.WAV").write_bytes(b"x")
    assert files.resolved(spark, str(tmp_path), "deep", "c").endswith("deep/c.wav")
    assert files.resolved(spark, str(tmp_path), "train", "d.WAV").endswith("audios/train/d.WAV")
    assert files.data_dir([str(tmp_path)]) == str(tmp_path / "deep")
    with pytest.raises(FileNotFoundError):
        files.resolved(spark, str(tmp_path), "train", "c")


def test_models_run_on_executors_in_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(10)], "id int, t string")

    def load():
        def model(values):
            assert len(values) <= 4
            return [[float(len(v)), 1.0] for v in values]

        return model

    got = {r.id: r.vec for r in inference.applied(df, "id", "t", load, batch=4).collect()}
    assert got == {i: None if i == 3 else [float(i), 1.0] for i in range(10)}
    assert inference.applied(df.where("false"), "id", "t", load).count() == 0


def test_turn_edits_are_those_of_whole_texts(spark, tmp_path):
    from gradeworks.plans import registry

    a = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)]
    b = a[:50] + ["other"] + a[51:60] + a[61:] + ["more"]
    spark.createDataFrame([(1, 0, " ".join(a)), (1, 1, " ".join(b))], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
    got = {n: registry.QUERIES[n](spark, str(tmp_path)).first() for n in ("t4_word_levenshtein", "t5_edit_rate", "t6_word_error_rate")}
    assert row[-1] == 3 == got["t4_word_levenshtein"].edits
    assert got["t5_edit_rate"].edit_rate == got["t6_word_error_rate"].wer == round(3 / 70, 6)


def test_weights_of_ridge_count_by_their_proportions_alone(spark):
    rng = np.random.default_rng(12)
    n, d = 200, 5
    x = rng.normal(size=(n, d)) * [1, 3, 0.2, 10, 1] + [0, 5, 0, -2, 1]
    y = x @ rng.normal(size=d) + rng.normal(size=n)
    w = rng.uniform(0.5, 2, n)
    frame = lambda w: spark.createDataFrame([(0, [float(v) for v in x[i]], float(y[i]), float(w[i])) for i in range(n)], "k int, x array<double>, y double, w double")
    sums = {name: heads.grams(frame(v), "x", "y", "k", "w")[0] for name, v in (("plain", np.ones(n)), ("w", w), ("twice", 2 * w))}
    for alpha in (0.1, 10.0, 1e4):
        # standardised by all rows alike, then weighted least squares with a penalty on weights of mean one
        z = (x - x.mean(0)) / (x.std(0) + 1e-6)
        v = w / w.mean()
        zc, yc = z - np.average(z, axis=0, weights=v), y - np.average(y, weights=v)
        beta = np.linalg.solve((zc * v[:, None]).T @ zc + alpha * np.eye(d), (zc * v[:, None]).T @ yc)
        want = np.average(y, weights=v) + zc @ beta
        for name in ("w", "twice"):
            coef, b = heads.fitted(sums[name], sums["plain"], (alpha,))[0]
            assert np.allclose(x @ coef + b, want, atol=1e-6)
    assert len(heads.ALPHAS) == 25 and heads.ALPHAS[0] == 0.1 and heads.ALPHAS[-1] == 100_000


def test_one_pass_resamples_are_those_of_multiplied_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ROWS", 7)
    monkeypatch.setattr(resampling, "TIMES", 5)
    rng = np.random.default_rng(4)
    rows = [(int(i) * 104_729_000_003, float(a), float(a + b), float(c), float(u)) for i, (a, b, c, u) in enumerate(zip(*rng.normal(size=(3, 60)), rng.uniform(0.1, 2, 60), strict=True))]
    df = spark.createDataFrame([*rows, (-5, 1.0, 2.0, 0.5, 1.0), (None, 1.0, 2.0, 3.0, 1.0), (7, None, 2.0, 3.0, 1.0)], "id long, y double, p double, q double, w double").repartition(3)
    for w in (None, "w"):
        got = {r.resample: (r.p, r.q) for r in resampling.resampled(df, "id", "y", ["p", "q"], 12, w).collect()}
        many = df.dropna().withColumn("id", F.pmod("id", F.lit(resampling.MODULUS))).crossJoin(spark.range(12).toDF("r")).withColumn("d", resampling.draws(F.col("id"), F.col("r")) * (F.col(w) if w else F.lit(1.0)))
        score = lambda p: metrics.composite(metrics.rmse(F.col("y"), F.col(p), F.col("d")), metrics.pearson(F.col("y"), F.col(p), F.col("d"))).alias(p)
        want = {r.r: (r.p, r.q) for r in many.groupBy("r").agg(score("p"), score("q")).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[r], want[r], atol=1e-9) for r in want)
    both = resampling.splits(df, "id", "y", ["p"], 3, 0.6).collect()
    assert {(r.resample, r.part) for r in both} == {(r, part) for r in range(3) for part in (0, 1)} and all(r.p > 0 for r in both)


def test_repeated_cross_validation_is_that_of_direct_computation(spark):
    rng = np.random.default_rng(14)
    n, d, k = 90, 3, 3
    x = rng.normal(size=(n, d)) * [1, 4, 0.3]
    y = x @ [1.0, -0.2, 2.0] + 0.3 * rng.normal(size=n)
    who = np.arange(n) // 3
    cols = np.column_stack([who % k, rng.integers(0, k, n // 3)[who]])
    inner, w = who // 3 % 3, rng.uniform(0.5, 2, n)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), int(cols[i, 0]), int(cols[i, 1]), int(inner[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, f0 int, f1 int, inner int, w double").repartition(3)
    src = np.repeat(np.arange(n - 10), 2)
    crops = x[src] + 0.05 * rng.normal(size=(len(src), d))
    short = spark.createDataFrame([(int(s), [float(v) for v in c]) for s, c in zip(src, crops, strict=True)], "source long, x array<double>")
    test = spark.createDataFrame([(i, [float(v) for v in x[i] + 1]) for i in range(4)], "id long, x array<double>")
    alphas = (0.1, 10.0, 1000.0)
    cv = heads.repeated_cv(df, "id", "x", "y", ["f0", "f1"], "inner", k, alphas=alphas, w="w", short=short, test=test)

    def ridge(tr, alpha):
        mean, sd = x[tr].mean(0), x[tr].std(0) + 1e-6
        z, v = (x[tr] - mean) / sd, w[tr] / w[tr].mean()
        mz, my = np.average(z, axis=0, weights=v), np.average(y[tr], weights=v)
        beta = np.linalg.solve(((z - mz) * v[:, None]).T @ (z - mz) + alpha * np.eye(d), ((z - mz) * v[:, None]).T @ (y[tr] - my))
        return lambda q: ((q - mean) / sd - mz) @ beta + my

    oof, brief, every = np.zeros((2, n)), np.zeros((2, len(src))), []
    for s in (0, 1):
        for f in range(k):
            tr = np.flatnonzero(cols[:, s] != f)
            errors = [sum(((ridge(tr[inner[tr] != p], a)(x[tr[inner[tr] == p]]) - y[tr[inner[tr] == p]]) ** 2).sum() for p in range(3)) for a in alphas]
            alpha = alphas[int(np.argmin(errors))]
            assert cv.alphas[s][f] == alpha
            model = ridge(tr, alpha)
            every.append(model)
            oof[s, cols[:, s] == f] = model(x[cols[:, s] == f])
            held = cols[src, s] == f
            brief[s, held] = model(crops[held])
    got = cv.rows.toPandas().sort_values("id")
    assert np.allclose(np.array(got["per_seed"].tolist()).T, oof, atol=1e-6) and np.allclose(got["oof"], oof.mean(0), atol=1e-6)
    assert np.allclose(got["insample"], np.mean([m(x) for m in every], axis=0), atol=1e-6)
    shorts = cv.short.toPandas().sort_values("id")
    want = brief.reshape(2, -1, 2).mean(2)
    assert np.allclose(np.array(shorts["per_seed"].tolist()[: n - 10]).T, want, atol=1e-6) and shorts["oof_short"][shorts["id"] >= n - 10].isna().all()
    assert np.allclose(cv.test.toPandas().sort_values("id")["pred"], np.mean([m(x[:4] + 1) for m in every], axis=0), atol=1e-6)
    row = heads.summary(cv, 2).first()
    one = np.ones(n)
    assert abs(row.composite - composite(y, oof.mean(0), one)) < 1e-6 and abs(row.sd_over_seeds - np.std([composite(y, o, one) for o in oof])) < 1e-6
    assert (row.n, row.n_short) == (n, n - 10) and abs(row.composite_short - composite(y[: n - 10], want.mean(0), one[: n - 10])) < 1e-6


def test_group_quantiles_of_a_hot_group_are_exact_and_spread(spark):
    rng = np.random.default_rng(3)
    values = {"hot": rng.normal(size=3000).round(3), "ties": np.repeat([1.0, 2.0], 50), "one": np.array([7.0]), None: rng.normal(size=40)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.75, 1.0]
    got = {r.k: (r.n, r.q) for r in binning.group_quantiles(df, "k", "x", shares).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k][0] == len(vs) and np.allclose(got[k][1], np.quantile(vs, shares), atol=1e-12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables are put together again
    try:
        counts = binning.ranged_counts(df, "k", "x").where("k = 'hot'")
        assert counts.select("part").distinct().count() > 1
        assert np.allclose(binning.group_quantiles(df, "k", "x", shares).where("k = 'hot'").first().q, np.quantile(values["hot"], shares), atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_sequences_of_one_key_for_the_whole_table(spark, coalesced):
    rng = np.random.default_rng(11)
    n, width = 400, 5
    start = rng.permutation(n).astype(float)
    rows = [("hot", float(s), float(s + rng.uniform(0, 2)), float(rng.normal())) for s in start] + [("few", float(i), i + 0.5, 1.0 * i) for i in range(3)] + [(None, 1.0, 2.0, 3.0), (None, 5.0, 6.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, s double, e double, x double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        ordered = {k: sorted(r for r in rows if r[0] == k) for k in ("hot", "few", None)}
        want = {(k, r[1]): None if i == 0 else max(r[1] - v[i - 1][2], 0.0) for k, v in ordered.items() for i, r in enumerate(v)}
        assert {(r.k, r.s): r.gap for r in sequences.gaps(df, "k", "s", "e").collect()} == want
        got = {(r.k, r.s): r.moving for r in sequences.moving_mean(df, ["k"], "s", "x", width).collect()}
        want = {(k, r[1]): np.mean([q[3] for q in v[i : i + width]]) for k, v in ordered.items() for i, r in enumerate(v) if i + width <= len(v)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        if coalesced == "false":
            assert sequences.ranged(df, ["k"], ["s"]).where("k = 'hot'").select("__part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
