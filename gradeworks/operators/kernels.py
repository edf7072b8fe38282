"""Support-vector regression for any number of rows: kernel features at landmarks, and passes that sum slopes over all rows.

The kernel is ``exp(-gamma |a - b|^2)`` on standardised, projected features. Its
features are its values at a bounded number of landmark rows (Nystroem's method):
with no more training rows than landmarks that is the kernel itself. The weights
minimise ``|w|^2 / 2 + C * sum(max(0, |y - f(x)| - epsilon))``.

Every pass is one Spark job for all models at once (folds, inner folds, grid). A
task adds up, for each model, its rows' losses and slopes; the driver gets one short
array a model, whatever the rows. Slopes are the dual variables: they lie between
-C and C, and are balanced before use, so each pass gives a lower bound of the loss
too. A model is done when the gap between both is small.

Rows are kept packed by their features. Rows with equal features have one prediction, so
their loss is read off sums of their sorted truths, which all models of a training set
share; what a model costs grows with the different features and not with the rows. The
models' next steps are tasks of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.operators.heads import grams, scaled
from gradeworks.sources.scratch import written

#: The grid of the head, and the components that are kept of the features.
COSTS, EPSILONS, COMPONENTS = (0.3, 1.0, 3.0, 10.0), (0.05, 0.2), 128
#: Values of an array that one task adds up.
CHUNK = 4096
#: Rows, first by a hash, that landmarks are chosen from and that curvature is estimated on; and single numbers ahead of a pass's sums.
SAMPLE, HEAD = 16384, 6
#: Rows that a task of a pass has at most, about; rows that are packed together at most; and rows of equal features from which on sorted truths are worth it.
TASK_ROWS, PACKED_ROWS, ENOUGH = 200_000, 1 << 18, 8


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def filled(batches):
    return (b for b in batches if b.num_rows)


def array_sums(df: DataFrame, add, size: int) -> dict[int, np.ndarray]:
    """Sums by key of the arrays that ``add(batches)`` yields for a task as ``{key: array}``; arrays are added in pieces, one task's arrays a row."""

    def work(batches):
        for key, v in add(batches).items():
            for at in range(0, size, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([at], pa.int32()), pa.array([v[at : at + CHUNK].tolist()], pa.list_(pa.float64()))], names=["key", "at", "v"])

    def total(t: pa.Table) -> pa.Table:
        v = matrix(t["v"].combine_chunks()).sum(0)
        return pa.table({"key": t["key"].slice(0, 1), "at": t["at"].slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "key int, at int, v array<double>"
    got = df.mapInArrow(work, schema).groupBy("key", "at").applyInArrow(total, schema).toArrow()
    out: dict[int, np.ndarray] = {}
    for key, at, v in zip(got["key"].to_pylist(), got["at"].to_pylist(), got["v"].to_pylist(), strict=True):
        out.setdefault(key, np.zeros(size))[at : at + len(v)] = v
    return out


@dataclass
class Kernel:
    """Features of one training set: the kernel of projected rows at its landmarks."""

    turn: np.ndarray  # numbers to components, each standardised by the training rows
    shift: np.ndarray
    gamma: float
    points: np.ndarray  # landmarks in components
    root: np.ndarray  # values at landmarks to features whose products give the kernel
    rows: float = 0.0  # rows of the training set

    def values(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.turn - self.shift
        d = (z**2).sum(1)[:, None] - 2 * z @ self.points.T + (self.points**2).sum(1)[None, :]
        return np.exp(-self.gamma * np.maximum(d, 0))


def fitted_kernel(gram: np.ndarray, sample: np.ndarray, components: int) -> Kernel:
    """The kernel of a training set, from its sums and its landmarks: standardised, turned to its main components, scaled by their variance."""
    standard, mean, sd = scaled(gram)
    n, d = gram[0, 0], len(mean)
    values, vectors = np.linalg.eigh(standard[1 : d + 1, 1 : d + 1] / n)
    most = max(1, min(components, d, int(n // 2)))
    values, vectors = np.maximum(values[::-1][:most], 0), vectors[:, ::-1][:, :most]
    gamma = 1.0 / (most * values.mean()) if values.mean() > 0 else 1.0
    turn = vectors / sd[:, None]
    kernel = Kernel(turn, mean @ turn, gamma, sample @ turn - mean @ turn, np.eye(len(sample)))
    low, around = np.linalg.eigh(kernel.values(sample))
    kept = low > 1e-10 * low.max()
    kernel.root = around[:, kept] / np.sqrt(low[kept])
    return kernel


@dataclass
class Model:
    """A training set's support-vector model for one cost and epsilon, and where its descent stands."""

    of: int  # its training set
    cost: float
    epsilon: float
    z: np.ndarray = None  # weights of the features and intercept
    smooth: float = 0.0
    gap: float = float("inf")
    f: float = float("inf")
    slope: np.ndarray = None
    step: np.ndarray = None
    t: float = 0.0
    done: bool = False
    kernel: Kernel = None

    def predicted(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.values(x) @ (self.kernel.root @ self.z[:-1]) + self.z[-1]


def soft_loss(r: np.ndarray, epsilon: float, smooth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smooth loss of each residual, its slope, and whether it lies where the slope changes."""
    over = np.abs(r) - epsilon
    between = (over > 0) & (over < smooth)
    return np.where(over < smooth, np.maximum(over, 0) ** 2 / (2 * smooth), over - smooth / 2), np.sign(r) * np.clip(over / smooth, 0, 1), between


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that differ from the row before, and each row's place among them: sorted, equal rows have their kernel values made once."""
    new = np.append(True, (x[1:] != x[:-1]).any(1))
    return x[new], np.cumsum(new) - 1


def loss_sums(y: np.ndarray, f: np.ndarray, k: np.ndarray, cost: float, epsilon: float, smooth: float, at: np.ndarray | None = None) -> np.ndarray:
    """A batch's part of a pass: smooth and exact loss, and sums of the dual variables above and below zero. ``at`` is each row's place in ``k`` where rows share kernel values."""
    r = y - f
    soft, rate, _ = soft_loss(r, epsilon, smooth)
    up, down = cost * np.maximum(rate, 0), cost * np.minimum(rate, 0)
    head = [cost * soft.sum(), cost * np.maximum(np.abs(r) - epsilon, 0).sum(), up.sum(), up @ y, down.sum(), down @ y]
    if at is not None:
        up, down = (np.bincount(at, v, len(k)) for v in (up, down))
    return np.concatenate([head, up @ k, down @ k])


@dataclass
class Pack:
    """Rows that are sorted by features and truth: the different features, each row's place among them, truth, and kind (a fold and an inner fold)."""

    x: np.ndarray
    at: np.ndarray
    y: np.ndarray
    kind: np.ndarray
    kinds: np.ndarray

    def own(self, fold: int, inner: int | None, held: bool = False) -> np.ndarray:
        """Which rows train a set, or with ``held`` are held out by its inner fold."""
        f, i = self.kinds.T
        return ((f != fold) & ((i == inner) if held else (i != inner) if inner is not None else True))[self.kind]


def packed(batches):
    """Binary packs of ``x, y, fold, inner``, sorted by ``x`` and ``y``: a bounded number of rows in each."""
    held, many = [], 0

    def pack():
        x, y, f, i = (np.concatenate(c) for c in zip(*held, strict=True))
        different, at = runs(x)
        kinds, kind = np.unique(np.column_stack([f, i]), axis=0, return_inverse=True)
        parts = different, np.bincount(at), y, kind.ravel().astype(np.int32), kinds.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["x", "n", "y", "kind", "kinds"])

    for b in filled(batches):
        held.append((matrix(b.column(0)), *(b.column(c).to_numpy() for c in (1, 2, 3))))
        many += b.num_rows
        if many >= PACKED_ROWS:
            yield pack()
            held, many = [], 0
    if held:
        yield pack()


def unpacked(batches):
    for b in filled(batches):
        for i in range(b.num_rows):
            x, n, y, kind, kinds = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in enumerate((np.float64, np.int64, np.float64, np.int32, np.int64)))
            yield Pack(x.reshape(len(n), -1), np.repeat(np.arange(len(n)), n), y, kind, kinds.reshape(-1, 2))


class Sorted:
    """The truths of a pack, ready to be summed between any two bounds: each from its features' mean, in one order over all features."""

    def __init__(self, pack: Pack):
        self.mean = np.bincount(pack.at, pack.y, len(pack.x)) / np.bincount(pack.at, minlength=len(pack.x))
        self.y = pack.y - self.mean[pack.at]
        self.most = np.abs(self.y).max() + 1
        self.at, self.key = pack.at, self.y + 3 * self.most * pack.at

    def losses(self, own: np.ndarray, f: np.ndarray, k: np.ndarray, cost: np.ndarray, epsilon: np.ndarray, smooth: np.ndarray) -> np.ndarray:
        """What ``loss_sums`` gives for the rows ``own``, a row for each model, whose predictions are the columns of ``f``."""
        y, key, places = self.y[own], self.key[own], np.arange(len(f))[:, None]
        s1, s2 = (np.append(0.0, np.cumsum(v)) for v in (y, y * y))
        ends = np.cumsum(np.bincount(self.at[own], minlength=len(f)))[:, None]
        starts = np.append(0, ends[:-1, 0])[:, None]
        f = f - self.mean[:, None]
        # a bound that rounding puts on the wrong side of a truth changes nothing: losses and slopes are continuous there
        place = lambda v: np.clip(np.searchsorted(key, np.clip(v, -1.4 * self.most, 1.4 * self.most) + 3 * self.most * places), starts, ends)
        high, low = f + epsilon, f - epsilon
        p = [starts, place(low - smooth), place(low), place(high), place(high + smooth), ends]
        n, a, b = ([v[p[i + 1]] - v[p[i]] for i in (0, 1, 3, 4)] for v in (np.arange(len(s1)), s1, s2))
        up, down = n[3] + (a[2] - n[2] * high) / smooth, -(n[0] + (n[1] * low - a[1]) / smooth)
        up_y, down_y = a[3] + (b[2] - high * a[2]) / smooth + up * self.mean[:, None], -(a[0] + (low * a[1] - b[1]) / smooth) + down * self.mean[:, None]
        linear = a[3] - n[3] * (high + smooth / 2) + n[0] * (low - smooth / 2) - a[0]
        bent = (b[2] - 2 * high * a[2] + n[2] * high**2 + b[1] - 2 * low * a[1] + n[1] * low**2) / (2 * smooth)
        exact = a[3] + a[2] - (n[3] + n[2]) * high + (n[0] + n[1]) * low - a[0] - a[1]
        head = [v.sum(0) for v in (linear + bent, exact, up, up_y, down, down_y)]
        return cost[:, None] * np.column_stack([*head, up.T @ k, down.T @ k])


def local_minimum(z: np.ndarray, told: tuple[np.ndarray, np.ndarray, float], gram: np.ndarray, m: Model, tilt: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Newton's method on the sampled rows' loss, plus ``tilt @ z``, from much smoothing down to the model's."""
    phi, y, stands_for = told
    scale = m.cost * stands_for
    keep = np.ones(len(z))
    keep[-1] = 0
    smooths = [m.smooth * 3.0**i for i in range(3 if m.step is None else 1, -1, -1)]

    def value(z: np.ndarray, smooth: float):
        loss, rate, between = soft_loss(y - phi @ z, m.epsilon, smooth)
        return 0.5 * (keep * z) @ z + scale * loss.sum() + tilt @ z, keep * z - scale * (rate @ phi) + tilt, between

    for smooth in smooths:
        f, g, between = value(z, smooth)
        for _ in range(rounds):
            inside = phi[between]
            h = np.diag(keep) + scale / smooth * (inside.T @ inside) + 1e-4 * m.cost / smooth * gram
            step = -np.linalg.solve(h, g)
            fall, t = g @ step, 1.0
            if -fall <= 1e-9 * abs(f):
                break
            while t > 1e-4:
                f_new, g_new, b_new = value(z + t * step, smooth)
                if f_new <= f + 1e-4 * t * fall:
                    break
                t /= 2
            else:
                break
            z, f, g, between = z + t * step, f_new, g_new, b_new
    return z


def evened(m: Model, sums: np.ndarray, w: np.ndarray, slope: np.ndarray, gram: np.ndarray, xy: np.ndarray) -> float:
    """A lower bound of the loss from dual variables whose slope is evened out over all rows.

    With many rows a small share of the slope is large against the weights, and
    the dual variables as they are give a poor bound. Adding ``features @ u`` to them takes the slope away, up to
    ``pull * u``; features have a length of one at most, which tells how far all are to be
    scaled down to stay between -C and C.
    """
    up, up_y, down, down_y = sums[2:HEAD]
    keep, most = np.ones(len(slope)), float("-inf")
    keep[-1] = 0
    for pull in 10.0 ** np.arange(-2, 8):
        u = np.linalg.lstsq(gram + np.diag(pull * keep), slope, rcond=None)[0]
        share = m.cost / (m.cost + np.sqrt(u[:-1] @ u[:-1]) + abs(u[-1]))
        v = w - pull * u[:-1]
        gain = share * (up_y + down_y + u @ xy - m.epsilon * (up - down + np.sqrt(max(gram[-1, -1] * (u @ gram @ u), 0.0))))
        cost = share**2 * (v @ v)
        less = min(1.0, max(gain, 0.0) / cost) if cost > 0 else 1.0
        most = max(most, less * gain - 0.5 * less**2 * cost)
    return most


def advance(m: Model, sums: np.ndarray, root: np.ndarray, gram: np.ndarray, xy: np.ndarray, told: tuple[np.ndarray, np.ndarray, float], tolerance: float) -> None:
    """Take in a pass at ``z + t * step``: the gap, then the next step, or half of it where the loss has not come down.

    Losses and slopes are those of all rows. The next step leads to the least loss
    of the sampled training rows ``told`` (features, truth, rows that one stands
    for), tilted so that its slope here is that of all rows.
    """
    soft, exact, up, up_y, down, down_y = sums[:HEAD]
    d = (len(sums) - HEAD) // 2
    up_k, down_k = sums[HEAD : HEAD + d] @ root, sums[HEAD + d :] @ root
    at = m.z if m.step is None else m.z + m.t * m.step
    w = at[:-1]
    f = 0.5 * w @ w + soft
    slope = np.append(w - up_k - down_k, -(up + down))
    # the larger side is scaled down, so that the dual variables add up to nothing
    side = min(up, -down)
    a, b = (side / up if up > 0 else 0.0), (side / -down if down < 0 else 0.0)
    v = a * up_k + b * down_k
    dual = a * up_y + b * down_y - m.epsilon * (a * up - b * down) - 0.5 * v @ v
    dual = max(dual, evened(m, sums, w, slope, gram, xy))
    primal = 0.5 * w @ w + exact
    gap = (primal - dual) / primal if primal > 1e-12 else 0.0
    if gap <= tolerance:
        m.z, m.gap, m.done = at, gap, True
        return
    if m.step is not None and f > m.f + 1e-4 * m.t * (m.slope @ m.step) and m.t > 1e-5:
        m.t /= 2
        return
    m.z, m.f, m.slope, m.gap = at, f, slope, gap
    phi, y, stands_for = told
    own = np.append(w, 0.0) - m.cost * stands_for * (soft_loss(y - phi @ at, m.epsilon, m.smooth)[1] @ phi)
    tilt = slope - own
    m.step, m.t = local_minimum(at, told, gram, m, tilt) - at, 1.0
    # the part of the gap that is due to smoothing; what is left is due to the slope, which less smoothing makes no smaller
    blurred = exact - up_y - down_y + (up_k + down_k) @ w + (up + down) * at[-1] + m.epsilon * (up - down)
    if blurred > 0.3 * tolerance * primal and -(slope @ m.step) <= 0.1 * tolerance * abs(f):  # as low as this much smoothing lets it be
        m.smooth, m.f = 0.3 * m.smooth, float("inf")
        m.step = local_minimum(at, told, gram, m, tilt) - at


def advanced(part, told: tuple, tolerance: float):
    """A task's models, taken on by ``advance``: the features of a training set's sampled rows are made once for the models that follow one another."""
    x, y, folds, inners, sets, kernels, grams, xys = told
    last, sample = None, None
    for j, m, sums in part:
        kn = kernels[m.of]
        if m.of != last:
            f, i = sets[m.of]
            points = np.flatnonzero((folds != f) & (inners != i if i is not None else True))
            last, sample = m.of, (np.column_stack([kn.values(x[points]) @ kn.root, np.ones(len(points))]), y[points], kn.rows / len(points))
        p = len(kn.points)
        size = (len(sums) - HEAD) // 2
        advance(m, np.concatenate([sums[: HEAD + p], sums[HEAD + size : HEAD + size + p]]), kn.root, grams[m.of], xys[m.of], sample, tolerance)
        yield j, vars(m)


def support_vectors(
    df: DataFrame, ident: str, x: str, y: str, fold: str, inner: str, k: int, inner_k: int = 3, landmarks: int = 128, components: int = COMPONENTS,
    costs: tuple[float, ...] = COSTS, epsilons: tuple[float, ...] = EPSILONS, tolerance: float = 0.01, passes: int = 120,
) -> tuple[DataFrame, list[Model]]:
    """Out-of-fold predictions ``id, fold, y, pred`` of every row, and each fold's model.

    Each fold's cost and epsilon are those with the least mean error over its inner
    folds. Standardisation, components, landmarks and kernel width are those of a
    training set alone. ``passes`` bounds the jobs; a model's ``gap`` tells how far
    its loss may still be above the least, as a share of it.
    """
    rows = written(df.select(F.col(ident).alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), F.col(inner).cast("int").alias("inner")), "kernel-rows")
    # passes are many and heavy for the bytes they read: enough tasks for all cores, of a bounded number of rows
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    # equal rows stand together, and a row that is very frequent may be in several tasks
    rows = written(rows.repartitionByRange(tasks, "x", "id").sortWithinPartitions("x", "y"), "kernel-rows")
    by_cell = grams(rows.withColumn("cell", F.col("fold") * inner_k + F.col("inner")), "x", "y", "cell")
    if not by_cell:
        return df.sparkSession.createDataFrame([], f"{ident} {dict(df.dtypes)[ident]}, fold int, y double, pred double"), []
    sample = rows.orderBy(F.xxhash64("id", "x"), "id").limit(max(SAMPLE, 4 * landmarks)).select("x", "y", "fold", "inner").toArrow()
    sample_x, sample_y, folds_, inners = matrix(sample["x"].combine_chunks()), *(sample[c].to_numpy() for c in ("y", "fold", "inner"))
    sets, kernels = [], []
    for f, i in product(range(k), (*range(inner_k), None)):
        cells = [g for c, g in by_cell.items() if c // inner_k != f and c % inner_k != i]
        points = np.flatnonzero((folds_ != f) & (inners != i if i is not None else True))
        if cells and len(points):
            sets.append((f, i))
            kernels.append(fitted_kernel(sum(cells), sample_x[points[:landmarks]], components))
            kernels[-1].rows = sum(cells)[0, 0]
    size = max((len(kn.points) for kn in kernels), default=0)

    packs = written(rows.select("x", "y", "fold", "inner").mapInArrow(packed, "x binary, n binary, y binary, kind binary, kinds binary"), "kernel-packs")

    def first(batches):
        total = {s: np.zeros((size + 2) ** 2) for s in range(len(sets))}
        for pack in unpacked(batches):
            for s, kn in enumerate(kernels):
                own, n = pack.own(*sets[s]), len(pack.x)
                yy, at = pack.y[own], pack.at[own]
                v = np.zeros((n, size + 2))
                v[:, : len(kn.points)], v[:, -2] = kn.values(pack.x), 1
                products = v.T @ (np.bincount(at, minlength=n)[:, None] * v)
                products[-1] = products[:, -1] = np.bincount(at, yy, n) @ v
                products[-1, -1] = yy @ yy
                total[s] += products.ravel()
        return total

    start = array_sums(packs, first, (size + 2) ** 2)
    models, grams_, xys = [], {}, {}
    for s, kn in enumerate(kernels):
        g, p = start[s].reshape(size + 2, size + 2), len(kn.points)
        take = [*range(p), size]
        side = np.zeros((p + 1, kn.root.shape[1] + 1))
        side[:p, :-1], side[p, -1] = kn.root, 1
        gram, xy, n = side.T @ g[np.ix_(take, take)] @ side, side.T @ g[take, -1], g[-2, -2]
        grams_[s], xys[s] = gram, xy
        for c, e in product(costs, epsilons):
            ridge = np.eye(len(xy)) / c
            ridge[-1, -1] = 1e-9
            z = np.linalg.solve(gram + ridge + 1e-9 * np.eye(len(xy)), xy)
            error = np.sqrt(max((g[-1, -1] - 2 * z @ xy + z @ gram @ z) / n, 0))
            spread = np.sqrt(max(g[-1, -1] / n - (g[-2, -1] / n) ** 2, 0))
            models.append(Model(s, c, e, z, max(0.3 * error, 1e-3 * spread, 1e-9)))
    spark = df.sparkSession.sparkContext
    told = sample_x, sample_y, folds_, inners, sets, kernels, grams_, xys
    for _ in range(passes):
        live = [(j, m.of, kernels[m.of].root @ at[:-1], at[-1], m.cost, m.epsilon, m.smooth) for j, m in enumerate(models) if not m.done for at in [m.z if m.step is None else m.z + m.t * m.step]]
        if not live:
            break

        def one_pass(batches, live=live):
            total = {m[0]: np.zeros(HEAD + 2 * size) for m in live}
            by_set = {s: [m for m in live if m[1] == s] for s in sorted({m[1] for m in live})}
            for pack in unpacked(batches):
                truths = Sorted(pack)
                for s, those in by_set.items():
                    own, kk = pack.own(*sets[s]), kernels[s].values(pack.x)
                    numbers, _, beta, b0, *how = zip(*those, strict=True)
                    f, p = kk @ np.column_stack(beta) + np.array(b0), kk.shape[1]
                    if own.sum() >= ENOUGH * len(f):
                        sums = truths.losses(own, f, kk, *map(np.array, how))
                    else:
                        sums = [loss_sums(pack.y[own], f[pack.at[own], i], kk, *m[4:], pack.at[own]) for i, m in enumerate(those)]
                    for j, got in zip(numbers, sums, strict=True):
                        total[j][: HEAD + p] += got[: HEAD + p]
                        total[j][HEAD + size : HEAD + size + p] += got[HEAD + p :]
            return total

        got = array_sums(packs, one_pass, HEAD + 2 * size)
        asked = [(j, models[j], v) for j, v in got.items()]
        moved = spark.parallelize(range(len(asked)), min(len(asked), 4 * spark.defaultParallelism)).mapPartitions(lambda part, asked=asked: advanced([asked[i] for i in part], told, tolerance))
        for j, m in moved.collect():
            models[j] = Model(**m)
    for m in models:
        m.kernel = kernels[m.of]
    ready = [(j, m.of, kernels[m.of].root @ m.z[:-1], m.z[-1]) for j, m in enumerate(models)]

    def held_errors(batches):
        total = {j: np.zeros(2) for j, s, _, _ in ready if sets[s][1] is not None}
        for pack in unpacked(batches):
            for s, (f, i) in enumerate(sets):
                own = pack.own(f, i, True) if i is not None else np.zeros(0, dtype=bool)
                if own.any():
                    kk, yy, at = kernels[s].values(pack.x), pack.y[own], pack.at[own]
                    many = np.bincount(at, minlength=len(kk))
                    mean = np.bincount(at, yy, len(kk)) / np.maximum(many, 1)
                    around = ((yy - mean[at]) ** 2).sum()
                    for j, of_, beta, b0 in ready:
                        if of_ == s:
                            total[j] += [around + many @ (mean - (kk @ beta + b0)) ** 2, len(yy)]
        return total

    held = array_sums(packs, held_errors, 2) if inner_k > 1 else {}
    chosen = []
    for f in range(k):
        full = [j for j, m in enumerate(models) if sets[m.of] == (f, None)]
        error = lambda j: np.mean([np.sqrt(held[o][0] / held[o][1]) for o in held if held[o][1] and sets[models[o].of][0] == f and (models[o].cost, models[o].epsilon) == (models[j].cost, models[j].epsilon)] or [0.0])  # noqa: B023, E731
        if full:
            chosen.append((f, min(full, key=lambda j: (error(j), j))))
    use = {f: models[j] for f, j in chosen}

    def predict(batches):
        for b in filled(batches):
            (xx, at), ff = runs(matrix(b.column(3))), b.column(1).to_numpy()
            pred = np.full(len(ff), np.nan)
            for f, m in use.items():
                if len(own := np.flatnonzero(ff == f)):
                    pred[own] = m.predicted(xx)[at[own]]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(pred, from_pandas=True)], names=["id", "fold", "y", "pred"])

    out = rows.select("id", "fold", "y", "x").mapInArrow(predict, f"id {dict(rows.dtypes)['id']}, fold int, y double, pred double")
    return out.withColumnRenamed("id", ident), [models[j] for _, j in chosen]
