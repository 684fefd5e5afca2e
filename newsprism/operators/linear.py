"""Linear learners by gradient aggregation (M6, M8): logistic regression and the
squared-hinge support vector classifier.

A model minimises  0.5 |w|^2 + C * sum of loss(y (w x + b))  over the rows it may see;
loss is log(1 + exp(-t)) or max(0, 1 - t)^2, y is 1 or -1.  All models of a grid (every C on
every fold) are columns of one matrix and advance together: a step of L-BFGS
costs one pass over the rows for all of them, a model that has converged leaves the pass.

The rows are packed once into blocks (``blocks.py``).  Where features are few (``FEW``, or twice the rows), a pass maps blocks
to partial losses and gradients, which an exchange on column blocks adds up; the weights are broadcast and the gradients
come back to the driver, as in any method with one weight a feature.  Where there are fewer rows (a vocabulary outgrows its
texts and ``FEW``), weights that start at 0 stay sums of rows, w = X'a: the same descent runs on one number a row, the non-zeros are
dealt once by feature, and a pass gives X X'c, so no vector as long as the vocabulary moves; it is made for the models whose
weights are read, and a fold's accuracy is that of the margins the descent ends with.  A task of a pass adds up all its blocks,
so the partial sums that move are one set a core.  Models are taken in groups whose state stays below ``STATE_BYTES``, and a problem
for which a single model's would not is refused.  Else fold accuracies are counted in one more pass, so no model object is shipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_and_reload
from . import blocks as BL

HISTORY = 8
STATE_BYTES = 512 << 20
#: features up to which the descent stays on the weights, whatever the rows: its passes are short
FEW = 1 << 17
#: bytes of final weights that come to the driver at a time (one model's at least)
WEIGHT_BYTES = 64 << 20
#: non-zeros of a block of features at most (a commoner feature is a block of its own)
FEATURE_BLOCK = 1 << 22
#: a model has converged when its gradient is no longer than this, or when ``CALM`` steps
#: running have each lowered its value by less than ``tolerance`` of it
GRADIENT, CALM = 1e-4, 3

#: bits of a row's number in its task
PLACE = 40
#: largest second derivative of the losses
_CURVATURE = {"logistic": 0.25, "squared_hinge": 2.0}


def _sparse(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, indices, values) of a column of MLlib vectors."""
    kind = column.field("type").to_numpy(zero_copy_only=False)
    indices, values = column.field("indices"), column.field("values")
    count = np.diff(values.offsets.to_numpy())
    if kind.all():  # dense vectors
        index = np.concatenate([np.arange(n) for n in count]) if len(count) else np.zeros(0, np.int64)
    elif not kind.any():
        index = indices.flatten().to_numpy(zero_copy_only=False)
    else:
        index = np.concatenate([np.arange(n) if k else np.array(i) for k, n, i in zip(kind, count, indices.to_pylist())])
    return np.concatenate([[0], np.cumsum(count)]), index.astype(np.int32), values.flatten().to_numpy(zero_copy_only=False)


def pack(rows: DataFrame, id_col: str | None = None) -> DataFrame:
    """(y, fold, place, offsets, indices, entries): blocks of (features, label, fold), written.  A row's place is its
    task and its number there; with ``id_col`` its key is that column's hash."""
    seen = {}  # rows given by the task before

    def columns(batch):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        first = seen.get(TaskContext.get().taskAttemptId(), 0)
        seen[TaskContext.get().taskAttemptId()] = first + batch.num_rows
        place = (part << PLACE) + first + np.arange(batch.num_rows, dtype=np.int64)
        y = np.where(batch.column(1).to_numpy(zero_copy_only=False) > 0.5, 1.0, -1.0)
        keys = [batch.column(3).to_numpy(zero_copy_only=False)] if id_col else []
        return [y, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32), place, *keys], *_sparse(batch.column(0))

    key = [F.xxhash64(id_col)] if id_col else []
    return BL.pack(rows.select("features", F.col("label").cast("double"), F.col("fold").cast("int"), *key), columns,
                   ["y", "fold", "place", *(["key"] if id_col else [])])


def _summed(packed: DataFrame, one_block, size: int, width: int) -> np.ndarray:
    def add(out, raw):
        one_block(out, np.frombuffer(raw["y"]), np.frombuffer(raw["fold"], np.int32), *BL.entries(raw))

    return BL.summed(packed, add, size, width)


def _margins(off, index, value, weights: np.ndarray) -> np.ndarray:
    """w x + b of each row for each column of ``weights``; its last row is b."""
    return BL.products(off, index, value, weights) + weights[-1]


def _loss(kind: str, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss, and its derivative by z."""
    t = y[:, None] * z
    if kind == "logistic":
        return np.logaddexp(0, -t), -y[:, None] * 0.5 * (1 - np.tanh(0.5 * t))
    slack = np.maximum(0, 1 - t)
    return slack * slack, -2 * y[:, None] * slack


def _column_sums(off, index, value, rows: np.ndarray, out: np.ndarray) -> None:
    """out[column] += value * rows[row], for every entry; the last row of out takes the sum of rows."""
    BL.add_transposed(out, off, index, value, rows)
    out[-1] += rows.sum(axis=0)


def minimise(evaluate, start: np.ndarray, scale: np.ndarray, tolerance: float, max_passes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """L-BFGS on the columns of ``start`` in step: (minimum, gradient norms, passes).

    ``evaluate(points, columns)`` gives (values, gradients) of the given columns; ``scale`` is an
    upper bound of the second derivative of each coordinate.  Steps are halved until the value falls enough."""
    x, count = start.copy(), start.shape[1]
    every = np.arange(count)
    f, g = evaluate(x, every)
    passes, calm = 1, np.zeros(count, int)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = np.ones(count)
    d, slope = _direction(g, pairs, scale)
    while passes < max_passes:
        live = np.flatnonzero((np.linalg.norm(g, axis=0) > GRADIENT) & (calm < CALM))
        if not len(live):
            break
        trial = x[:, live] + step[live] * d[:, live]
        new_f, new_g = evaluate(trial, live)
        passes += 1
        good = new_f <= f[live] + 1e-4 * step[live] * slope[live] + 1e-12 * np.abs(f[live])
        step[live[~good]] *= 0.5
        s, y = np.zeros_like(x), np.zeros_like(x)
        took = live[good]
        s[:, took], y[:, took] = trial[:, good] - x[:, took], new_g[:, good] - g[:, took]
        calm[took] = np.where(f[took] - new_f[good] < tolerance * np.abs(new_f[good]), calm[took] + 1, 0)
        x[:, took], g[:, took], f[took] = trial[:, good], new_g[:, good], new_f[good]
        bent = (s * y).sum(axis=0)
        pairs = [*pairs, (s, y, np.where(bent > 1e-300, 1 / np.where(bent > 1e-300, bent, 1), 0.0))][-HISTORY:] if len(took) else pairs
        fresh, fresh_slope = _direction(g, pairs, scale)
        d[:, took], slope[took], step[took] = fresh[:, took], fresh_slope[took], 1.0
        # a step that has become nothing: start again from the gradient
        stuck = live[step[live] < 1e-10]
        d[:, stuck], step[stuck] = -g[:, stuck] / scale[:, stuck], 1.0
        slope[stuck] = (d[:, stuck] * g[:, stuck]).sum(axis=0)
    return x, np.linalg.norm(g, axis=0), passes


def _direction(g: np.ndarray, pairs, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Search directions by the two-loop recursion, and their slopes."""
    q, alphas = g.copy(), []
    for s, y, rho in reversed(pairs):
        a = rho * (s * q).sum(axis=0)
        q -= a * y
        alphas.append(a)
    gamma = np.ones(g.shape[1])
    for s, y, rho in pairs:  # the last step taken by each column
        curved = (y * y / scale).sum(axis=0)
        gamma = np.where(rho > 0, 1 / np.where(rho * curved > 0, rho * curved, 1), gamma)
    q *= gamma / scale
    for (s, y, rho), a in zip(pairs, reversed(alphas)):
        q += (a - rho * (y * q).sum(axis=0)) * s
    slope = -(q * g).sum(axis=0)
    bad = slope >= 0
    q[:, bad] = g[:, bad] / scale[:, bad]
    return -q, np.where(bad, -(q * g).sum(axis=0), slope)


class RowSpace:
    """The non-zeros of packed rows dealt by feature, and the labels and folds of the rows."""

    def __init__(self, packed: DataFrame, size: int):
        self.size = size
        self.spark = packed.sparkSession
        found = packed.select("y", "fold", "place").toArrow()

        def whole(name: str, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in found.column(name).to_pylist()])

        place = whole("place", np.int64)
        order = np.argsort(place)
        self.y, self.fold, place = whole("y", np.float64)[order], whole("fold", np.int32)[order], place[order]
        parts, starts = np.unique(place >> PLACE, return_index=True)
        self.rows = len(place)
        start = np.zeros(int(parts[-1]) + 1, np.int64)
        start[parts] = starts
        non_zeros = packed.agg(F.sum(F.octet_length("entries"))).first()[0] // 8
        count = max(self.spark.sparkContext.defaultParallelism, -(-non_zeros // FEATURE_BLOCK), 1)

        def split(batches):
            for raw in BL.rows_of(batches):
                off, index, value = BL.entries(raw)
                at = np.frombuffer(raw["place"], np.int64)
                row = np.repeat(start[at >> PLACE] + (at & ((1 << PLACE) - 1)), np.diff(off)).astype(np.int32)
                block = index % count  # neighbours in the alphabet are of like frequency at most by chance
                order = np.argsort(block, kind="stable")
                cut = np.flatnonzero(np.diff(block[order], prepend=-1))
                for a, b in zip(cut, np.append(cut[1:], len(order))):
                    own = order[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(block[own[0]])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (row[own], index[own] // count, value[own])]],
                        names=["block", "at", "feature", "value"])

        def gather(batches):
            block, parts = None, []

            def one():
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([b"".join(p)], pa.binary()) for p in zip(*parts)]],
                                                  names=["block", "at", "feature", "value"])

            for raw in BL.rows_of(batches):
                if raw["block"] != block and parts:
                    yield one()
                    parts = []
                block = raw["block"]
                parts.append((raw["at"], raw["feature"], raw["value"]))
            if parts:
                yield one()

        schema = "block int, at binary, feature binary, value binary"
        dealt = packed.mapInArrow(split, schema).repartitionByRange(count, "block").sortWithinPartitions("block").mapInArrow(gather, schema)
        self.blocks, self.count = write_and_reload(dealt, "feature_blocks"), count
        self.tasks = max(1, min(self.blocks.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism))

    def gram(self, c: np.ndarray) -> np.ndarray:
        """X X'c, column by column, in one pass."""
        shared, rows, width = self.spark.sparkContext.broadcast(np.ascontiguousarray(c.T)), self.rows, c.shape[1]

        def part(batches):
            out = None
            for raw in BL.rows_of(batches):
                out = np.zeros((width, rows)) if out is None else out
                at, feature, value = np.frombuffer(raw["at"], np.int32), np.frombuffer(raw["feature"], np.int32), np.frombuffer(raw["value"])
                for j in range(width):
                    sums = np.bincount(feature, value * shared.value[j].take(at))
                    out[j] += np.bincount(at, value * sums.take(feature), minlength=rows)
            for first in range(0, rows if out is not None else 0, BL.PIECE):
                piece = np.ascontiguousarray(out[:, first:first + BL.PIECE].T)
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([piece.tobytes()], pa.binary())], names=["at", "sums"])

        total = BL.added(self.blocks.coalesce(self.tasks).mapInArrow(part, "at bigint, sums binary"), self.tasks, rows, width)
        shared.destroy()
        return total

    def weights(self, a: np.ndarray) -> np.ndarray:
        """X'a."""
        shared, width, count = self.spark.sparkContext.broadcast(np.ascontiguousarray(a.T)), a.shape[1], self.count

        def part(batches):
            for raw in BL.rows_of(batches):
                at, feature, value = np.frombuffer(raw["at"], np.int32), np.frombuffer(raw["feature"], np.int32), np.frombuffer(raw["value"])
                known = np.unique(feature)
                sums = np.stack([np.bincount(feature, value * shared.value[j].take(at))[known] for j in range(width)], axis=1)
                for k in range(0, len(known), BL.PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (
                        known[k:k + BL.PIECE].astype(np.int64) * count + raw["block"], sums[k:k + BL.PIECE])], names=["feature", "sums"])

        out = np.zeros((self.size, width))
        found = self.blocks.mapInArrow(part, "feature binary, sums binary").toArrow()
        for feature, sums in zip(found.column(0), found.column(1)):
            out[np.frombuffer(feature.as_py(), np.int64)] = np.frombuffer(sums.as_py()).reshape(-1, width)
        shared.destroy()
        return out

    def minimise(self, kind: str, C: np.ndarray, left_out: np.ndarray, tolerance: float, max_passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """L-BFGS on models (w, b) with w = X'a: (a and b below it, gradient norms, shares of right predictions on the rows left out,
        0 without any).

        A vector is kept as (a, b) above its image (X X'a, b), so the inner product of two is that of one's upper and the
        other's lower half, and margins along a direction are known without a pass; a pass gives the image of a gradient."""
        n, free = self.rows, kind == "logistic"
        seen = (self.fold[:, None] != left_out[None, :]) * C

        def dot(u, v):
            return (u[:n + 1] * v[n + 1:]).sum(axis=0)

        def value(z, square, b, of):
            return (_loss(kind, self.y, z)[0] * seen[:, of]).sum(axis=0) + 0.5 * (square - (b * b if free else 0))

        def gradient(x, of):
            z = x[n + 1:-1] + x[n]
            by_z = _loss(kind, self.y, z)[1] * seen[:, of]
            bias = by_z.sum(axis=0) + (0 if free else x[n])
            return np.concatenate([by_z + x[:n], [bias], self.gram(by_z) + x[n + 1:-1], [bias]])

        every = np.arange(len(C))
        x = np.zeros((2 * n + 2, len(C)))
        f, g = value(np.zeros((n, len(C))), 0.0, x[n], every), gradient(x, every)
        passes, calm, pairs = 1, np.zeros(len(C), int), []
        while passes < max_passes:
            live = np.flatnonzero((np.sqrt(np.maximum(dot(g, g), 0)) > GRADIENT) & (calm < CALM))
            if not len(live):
                break
            d = _row_direction(g[:, live], [(s[:, live], y[:, live], rho[live]) for s, y, rho in pairs], dot)
            slope = dot(g[:, live], d)
            bad = slope >= 0
            d[:, bad], slope[bad] = -g[:, live[bad]], -dot(g, g)[live[bad]]
            step, new_f = self._line(x[:, live], d, f[live], slope, seen[:, live], kind, dot, lambda z, square, b: value(z, square, b, live))
            trial = x[:, live] + step * d
            new_g = gradient(trial, live)
            passes += 1
            s, y = np.zeros_like(x), np.zeros_like(x)
            s[:, live], y[:, live] = step * d, new_g - g[:, live]
            calm[live] = np.where(f[live] - new_f < tolerance * np.abs(new_f), calm[live] + 1, 0)
            x[:, live], g[:, live], f[live] = trial, new_g, new_f
            bent = dot(s, y)
            pairs = [*pairs, (s, y, np.where(bent > 1e-300, 1 / np.where(bent > 1e-300, bent, 1), 0.0))][-HISTORY:]
        shares = np.zeros(len(C))
        for j in every:
            own = self.fold == left_out[j]
            shares[j] = np.mean((x[n + 1:-1, j][own] + x[n, j] > 0) == (self.y[own] > 0)) if own.any() else 0.0
        return x[:n + 1], np.sqrt(np.maximum(dot(g, g), 0)), shares

    def _line(self, x, d, f, slope, seen, kind, dot, value) -> tuple[np.ndarray, np.ndarray]:
        """(steps, values) near the least value along ``d``: the derivative's root between bounds, by Newton steps and halving."""
        n, free = self.rows, kind == "logistic"
        z, dz = x[n + 1:-1] + x[n], d[n + 1:-1] + d[n]
        xx, xd, dd = dot(x, x), dot(x, d), dot(d, d)
        if free:
            xx, xd, dd = xx - x[n] ** 2, xd - x[n] * d[n], dd - d[n] ** 2
        low, high, step = np.zeros(len(f)), np.full(len(f), np.inf), np.ones(len(f))
        for _ in range(12):
            at = z + step * dz
            by_z = _loss(kind, self.y, at)[1]
            first = (by_z * seen * dz).sum(axis=0) + xd + step * dd
            if (np.abs(first) <= 0.1 * np.abs(slope)).all():
                break
            t = self.y[:, None] * at
            bend = 0.25 / np.cosh(0.5 * np.clip(t, -700, 700)) ** 2 if free else 2.0 * (t < 1)
            second = (bend * seen * dz * dz).sum(axis=0) + dd
            high, low = np.where(first > 0, step, high), np.where(first > 0, low, step)
            newton = step - first / np.where(second > 0, second, 1)
            inside = (newton > low) & (newton < high)
            step = np.where(np.abs(first) <= 0.1 * np.abs(slope), step, np.where(inside, newton, np.where(np.isfinite(high), 0.5 * (low + high), 2 * step)))

        def at(t):
            b = x[n] + t * d[n]
            return value(z + t * dz, xx + 2 * t * xd + t * t * dd + (b * b if free else 0), b)

        new_f = at(step)
        for _ in range(30):
            worse = new_f > f + 1e-12 * np.abs(f)
            if not worse.any():
                break
            step = np.where(worse, 0.5 * step, step)
            new_f = at(step)
        return step, new_f


def _row_direction(g: np.ndarray, pairs, dot) -> np.ndarray:
    """Search directions by the two-loop recursion with the inner product ``dot``."""
    q, alphas, gamma = g.copy(), [], np.ones(g.shape[1])
    for s, y, rho in reversed(pairs):
        a = rho * dot(s, q)
        q -= a * y
        alphas.append(a)
    for s, y, rho in pairs:
        size = dot(y, y)
        gamma = np.where((rho > 0) & (size > 0), 1 / np.where((rho > 0) & (size > 0), rho * size, 1), gamma)
    q *= gamma
    for (s, y, rho), a in zip(pairs, reversed(alphas)):
        q += (a - rho * dot(y, q)) * s
    return -q


@dataclass
class LinearModel:
    """A fitted model; ``coefficients`` is indexed like the feature vectors."""
    loss: str
    C: float
    weights: np.ndarray
    intercept: float
    gradient_norm: float

    @property
    def coefficients(self):
        return Vectors.dense(self.weights)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with margin, prediction and (logistic) prob_1 from their ``features``."""
        kept = [c for c in rows.columns if c != "features"]
        schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("margin", T.DoubleType())])
        value = rows.sparkSession.sparkContext.broadcast(np.append(self.weights, self.intercept)[:, None])

        def run(batches):
            for batch in batches:
                z = _margins(*_sparse(batch.column(len(kept))), value.value)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z)], names=[*kept, "margin"])

        out = rows.select(*kept, "features").mapInArrow(run, schema)
        if self.loss == "logistic":
            out = out.withColumn("prob_1", 1 / (1 + F.exp(-F.col("margin"))))
        return out.withColumn("prediction", (F.col("margin") > 0).cast("double"))


@dataclass
class RowModel(LinearModel):
    """A model fitted in row space, whose weights X'a are made when they are first read."""
    space: RowSpace = field(repr=False)
    a: np.ndarray = field(repr=False)
    left_out: int
    held_share: float

    def __getattribute__(self, name):
        if name == "weights" and object.__getattribute__(self, "__dict__")["weights"] is None:
            make_weights([self])
        return object.__getattribute__(self, name)


def make_weights(models: list) -> None:
    """The weights of the models of one row space that have none yet, in passes for as many as ``WEIGHT_BYTES`` hold."""
    bare = [m for m in models if isinstance(m, RowModel) and vars(m)["weights"] is None]
    some = max(1, WEIGHT_BYTES // (8 * bare[0].space.size)) if bare else 1
    for k in range(0, len(bare), some):
        w = bare[k].space.weights(np.stack([m.a for m in bare[k:k + some]], axis=1))
        for j, m in enumerate(bare[k:k + some]):
            m.weights = w[:, j].copy()


def in_row_space(packed: DataFrame, size: int) -> bool:
    """Whether models of these rows are fitted on one number a row."""
    rows = _rows(packed)
    return 0 < 2 * rows < size and size > FEW


def _rows(packed: DataFrame) -> int:
    return packed.agg(F.coalesce(F.sum(F.octet_length("y")), F.lit(0))).first()[0] // 8


@dataclass
class LinearLearner:
    """Logistic regression (free intercept) or squared-hinge SVC (its intercept is a weight like the others); a
    model that has not converged after ``max_passes`` passes is taken as it is (its gradient norm tells)."""
    loss: str = "logistic"
    tolerance: float = 1e-4
    max_passes: int = 150

    def fit(self, packed: DataFrame, size: int, models: list[tuple[float, int]], space=None) -> list[LinearModel]:
        """One model per (C, fold that is left out, -1: none), in groups that fit ``STATE_BYTES``; ``space()`` is
        the ``RowSpace`` of ``packed``, made here if not given."""
        rows, by_row = _rows(packed), in_row_space(packed, size)
        one = (2 * rows + 2 if by_row else size + 1) * 8 * (2 * HISTORY + 8)
        if one > STATE_BYTES:
            raise ValueError(f"{rows} rows and {size} features need {one} bytes of state for one model; STATE_BYTES is {STATE_BYTES}")
        group, out = max(1, STATE_BYTES // one), []
        space = (space or (lambda: RowSpace(packed, size)))() if by_row else None
        for a in range(0, len(models), group):
            out += self._fit_rows(space, models[a:a + group]) if by_row else self._fit_group(packed, size, models[a:a + group])
        return out

    def _fit_rows(self, space: RowSpace, models: list[tuple[float, int]]) -> list[LinearModel]:
        C, left_out = np.array([c for c, _ in models], float), np.array([k for _, k in models], np.int32)
        x, norm, share = space.minimise(self.loss, C, left_out, self.tolerance, self.max_passes)
        return [RowModel(self.loss, float(C[j]), None, float(x[-1, j]), float(norm[j]), space, x[:-1, j].copy(), int(left_out[j]), float(share[j]))
                for j in range(len(models))]

    def _fit_group(self, packed: DataFrame, size: int, models: list[tuple[float, int]]) -> list[LinearModel]:
        sc, kind = packed.sparkSession.sparkContext, self.loss
        C, left_out = np.array([c for c, _ in models]), np.array([k for _, k in models], np.int32)
        penalty = np.ones((size + 1, 1))
        if kind == "logistic":
            penalty[-1] = 0

        def squares(out, y, fold, off, index, value):
            _column_sums(off, index, value * value, np.ones((len(y), 1)), out)

        scale = penalty + _CURVATURE[kind] * C * _summed(packed, squares, size + 1, 1)
        scale[scale == 0] = 1.0

        def evaluate(points, columns):
            weights, skip, factor = sc.broadcast(points), left_out[columns], C[columns]

            def one_block(out, y, fold, off, index, value):
                loss, by_z = _loss(kind, y, _margins(off, index, value, weights.value))
                seen = fold[:, None] != skip[None, :]
                _column_sums(off, index, value, by_z * seen * factor, out[:-1])
                out[-1] += (loss * seen).sum(axis=0) * factor

            total = _summed(packed, one_block, size + 2, len(columns))
            weights.destroy()
            return (total[-1] + 0.5 * (penalty * points * points).sum(axis=0), total[:-1] + penalty * points)

        x, norm, _ = minimise(evaluate, np.zeros((size + 1, len(models))), scale, self.tolerance, self.max_passes)
        return [LinearModel(kind, float(C[j]), x[:-1, j].copy(), float(x[-1, j]), float(norm[j])) for j in range(len(models))]


def fold_accuracy(packed: DataFrame, models: list[LinearModel], folds: list[int]) -> list[float]:
    """Share of right predictions of each model on its own fold, in one pass (0 where the fold is empty)."""
    if not models:
        return []
    if all(isinstance(m, RowModel) and m.left_out == k for m, k in zip(models, folds)):
        return [m.held_share for m in models]
    sc = packed.sparkSession.sparkContext
    weights = sc.broadcast(np.stack([np.append(m.weights, m.intercept) for m in models], axis=1))
    own = np.array(folds, np.int32)

    def one_block(out, y, fold, off, index, value):
        right = (_margins(off, index, value, weights.value) > 0) == (y[:, None] > 0)
        seen = fold[:, None] == own[None, :]
        out[0] += (right & seen).sum(axis=0)
        out[1] += seen.sum(axis=0)

    total = _summed(packed, one_block, 2, len(models))
    weights.destroy()
    return [float(a / n) if n else 0.0 for a, n in total.T]
