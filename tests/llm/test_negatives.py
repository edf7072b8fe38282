"""Hard negatives against a full scan in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeworks.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives, count, every):
    """Sorted result rows from all scores."""
    kept = [(i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (ai, ac, av) in enumerate(kept):
        if ai is None or ai % every:
            continue
        order = lambda t: (-t[0], t[2] is None, t[2] or 0, t[1])
        score = lambda v: sum(x * y for x, y in zip(av, v, strict=False))
        near = sorted(((score(v), b, i) for b, (i, c, v) in enumerate(kept) if c == ac and b != a), key=order)[:positives]
        far = sorted(((score(v), b, i) for b, (i, c, v) in enumerate(kept) if c != ac), key=order)
        for s, _, pi in near:
            fits = [t for t in far if 30 * s <= 100 * t[0] <= 90 * s][:count]
            out += [(ai, pi, r, i, s, t) for r, (t, _, i) in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = [(i, rng.randrange(3), [x + rng.gauss(0, 0.7) for x in rng.choice(centre)]) for i in range(500)]
    hot = [0.5, 0.5, 0.25, 0.0, 0.125, 1.0]
    out += [(1000 + i, i % 3, hot) for i in range(250)]  # a third of all rows is one vector
    out += [(2000, 0, [0.0] * 6), (2010, 1, [-x for x in hot]), (2020, 9, hot), (2030, None, hot), (2040, 0, None), (2050, 0, [1.0, None] + hot[2:]), (2060, 0, [float("nan")] + hot[1:])]
    out += [(2070, 0, [float("inf")] + hot[1:]), (2080, 0, [1.0, 2.0]), (2090, 1, []), (None, 0, hot), (None, 1, hot), (3000, 1, out[3][2]), (3000, 1, out[3][2])]
    return out


@pytest.mark.parametrize(("block", "group", "pivots"), [(1024, 512, 64), (30, 7, 5)])
def test_negatives_against_a_full_scan(spark, rows, monkeypatch, block, group, pivots):
    for name, v in {"BLOCK_ROWS": block, "ANCHOR_GROUP": group, "PIVOTS": pivots, "SAMPLE": 200}.items():
        monkeypatch.setattr(negatives, name, v)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "q", "norm", "pivot", "block", "anchor", "windows", "score")})
    got = negatives.mined(df.repartition(3), "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, positives=3, negatives=4)
    assert sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str) == brute(rows, 3, 4, 10)


def test_scans_stop_where_no_better_row_can_be(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(1)
    # sixty tight clusters, far from one another
    centres = rng.normal(size=(60, 16)) * 3
    rows = [(i, int(i % 2), [float(x) for x in centres[i % 60] + rng.normal(size=16) * 0.05]) for i in range(3000)]
    seen = []
    one = negatives.scanned
    monkeypatch.setattr(negatives, "scanned", lambda table, pairs, *a: (seen.append(pairs.count()), one(table, pairs, *a))[1])
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mined(df, "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0, high=105)
    assert got.count() > 0 and sum(seen[:3]) < 0.5 * 30 * 150


def test_exact_beyond_doubles_and_empty(spark, rows):
    big = [(i, i % 2, [float(2**20 + 3 * i), float(i)]) for i in range(60)]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    got = negatives.mined(df, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, high=100)
    want = []
    for a in range(0, 60, 10):
        q = [(math.floor(256 * x[0]), math.floor(256 * x[1])) for _, _, x in big]
        s = [q[a][0] * x + q[a][1] * y for x, y in q]
        near = sorted((b for b in range(60) if b % 2 == a % 2 and b != a), key=lambda b: (-s[b], b))[:5]
        for p in near:
            want += [(a, p, s[p], s[b]) for b in sorted((b for b in range(60) if b % 2 != a % 2 and 30 * s[p] <= 100 * s[b] <= 100 * s[p]), key=lambda b: (-s[b], b))[:10]]
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "positive_score", "negative_score").collect()) == sorted(want)
    empty = spark.createDataFrame(rows, SCHEMA).where("false")
    assert negatives.mined(empty, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(OverflowError):
        negatives.mined(spark.createDataFrame([(1, 1, [8.4e6])], "vec_id long, label int, embedding array<double>"), "vec_id", "embedding", "label", F.lit(True))
