"""Many logistic models without penalty over one encoded table (ML-2, ML-16, ML-18, ML-19, FLT-10).

Models differ in the rows they train on (folds or the rest of them) and in their columns (nested terms). All advance
together: one pass adds up, for every model, loss, gradient and curvature over its rows; the step is taken on those
few numbers. A table with ten folds is read about ten times whatever the number of models.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from secondlook.functions.predicates import complete_cases
from secondlook.models.merging import Moments, matrix, summed, tasks_of
from secondlook.session import stage

MAX_PASSES = 40
SETTLED = 1e-8  # largest step, in units of a feature's deviation, after which a model has settled
NEARLY = 1e-4  # the same once the loss is flat
FLAT = 1e-11  # relative change of the loss that ends a fit whose coefficients run off, as classes are parted
MAX_LEVELS = 1_000
SUMS_PER_PASS = 4_000_000  # numbers that one task sends; more models take another run
MISSING = ("error", "skip", "pass")


@dataclass
class Design:
    """The columns of a model matrix: numbers as they are, any other type as indicators of its levels but the first.

    With ``passed``, a missing number is 0 beside an indicator of its own, and a missing level is a level of its own,
    at fitting and at scoring alike; such a column is there only if the rows designed for had missing values.
    """

    terms: list[str]
    levels: dict[str, list]  # of each term that is no number, first one first
    missing: list[str]  # terms with an indicator of missing values

    @property
    def columns(self) -> list[tuple[str, object]]:
        """Term and level; for a number the level is None, for an indicator of missing values it is ``...``."""
        out: list[tuple[str, object]] = []
        for t in self.terms:
            out += [(t, v) for v in self.levels[t][1:]] if t in self.levels else [(t, None)]
            out += [(t, ...)] if t in self.missing else []
        return out

    def names(self) -> list[str]:
        return [t if v is None else f"{t}_{'missing' if v is ... else v}" for t, v in self.columns]

    def row(self) -> Column:
        def one(term: str, level: object) -> Column:
            if level is ...:
                return F.col(term).isNull().cast("double")
            if level is None:
                return F.coalesce(F.col(term).cast("double"), F.lit(0.0)) if term in self.missing else F.col(term).cast("double")
            return F.coalesce(F.col(term) == F.lit(level), F.lit(False)).cast("double")
        return F.array(*[one(*c) for c in self.columns]) if self.columns else F.array().cast("array<double>")

    def known(self) -> Column:
        """Whether all levels of a row are among those designed for, and no value is missing that was not to be."""
        out = F.lit(True)
        for t in self.terms:
            fine = F.col(t).isin(*self.levels[t]) if t in self.levels else F.col(t).isNotNull()
            out = out & F.coalesce(fine, F.lit(t in self.missing))
        return out

    def blocks(self) -> list[np.ndarray]:
        """For each term with levels, the places of its indicators: a row with none of them has the first level."""
        where = self.columns
        return [np.array([k for k, c in enumerate(where) if c[0] == t]) for t in self.levels]


def design(df: DataFrame, terms: Sequence[str], passed: bool = False) -> Design:
    """The design of ``terms`` for the rows of ``df``; at most ``MAX_LEVELS`` levels in all."""
    terms = list(terms)
    nominal = [t for t in terms if not isinstance(df.schema[t].dataType, NumericType)]
    levels: dict[str, list] = {t: [] for t in nominal}
    missing: list[str] = []
    if nominal:
        kinds = F.array(*[F.struct(F.lit(k).alias("term"), F.col(t).cast("string").alias("level")) for k, t in enumerate(nominal)])
        found = df.select(F.inline(kinds)).where("level IS NOT NULL").distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels in {', '.join(nominal)}")
        for t in nominal:
            own = sorted((r["level"] for r in found if r["term"] == nominal.index(t)), key=lambda v: v.encode())
            levels[t] = [v == "true" for v in own] if df.schema[t].dataType.typeName() == "boolean" else own
    if passed and terms:
        holes = df.agg(*[F.bool_or(F.col(t).isNull()).alias(f"m{k}") for k, t in enumerate(terms)]).first()
        missing = [t for t, hole in zip(terms, holes) if hole]
    return Design(terms, levels, missing)


@dataclass
class Fits:
    """Models by row, the intercept and columns by place, in units of centred and scaled columns."""

    point: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    loss: np.ndarray  # minus the log likelihood
    null_loss: np.ndarray
    rows: np.ndarray  # that each model trained on
    rank: np.ndarray  # coefficients that the rows determine, the intercept included
    covariance: list[np.ndarray]  # of the coefficients, scaled; columns without variation have none (NaN)
    means: np.ndarray  # model x column, over the training rows
    settled: np.ndarray

    def raw(self) -> np.ndarray:
        """Intercept and coefficients in the columns' own units."""
        slopes = self.point[:, 1:] / self.spread
        return np.hstack([self.point[:, :1] - (slopes @ self.centre)[:, None], slopes])

    def errors(self) -> np.ndarray:
        """Standard errors of ``raw``."""
        to_raw = np.vstack([np.r_[1.0, -self.centre / self.spread], np.hstack([np.zeros((len(self.spread), 1)), np.diag(1 / self.spread)])])
        out = []
        for c in self.covariance:
            known = ~np.isnan(np.diag(c))
            half = to_raw[:, known]
            own = np.sqrt(np.einsum("ij,jk,ik->i", half, c[np.ix_(known, known)], half))
            out.append(np.where(known, own, np.nan))
        return np.array(out)


def encoded(df: DataFrame, made: Design, outcome: str, part: Column) -> DataFrame:
    """The table that all passes read: part (from 0), label and x; written once."""
    x = F.transform(made.row(), lambda v: F.coalesce(v, F.lit(0.0)))  # of models that use only other columns
    return stage(df.select(part.cast("int").alias("part"), F.col(outcome).cast("double").alias("label"), x.alias("x")), "encoded")


def fit(ready: DataFrame, trains: np.ndarray, uses: np.ndarray) -> Fits:
    """Models over ``ready`` (part, label, x): ``trains[model, part]`` says which rows, ``uses[model, column]`` which columns.

    A column without variation over a model's rows has coefficient 0. Columns that depend on others share one fit: the
    shortest solution. A model without rows keeps coefficients 0. Classes that a model parts
    completely let coefficients grow until the loss is flat; ``settled`` is false then.
    """
    tasks = tasks_of(ready)
    models, parts = trains.shape
    width = uses.shape[1]
    spans = Moments(parts, width, full=False)
    n, mean, squares = spans.over(ready.select("part", "x"), tasks)
    whole = Moments(1, width, full=False)

    def over(chosen: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        state = np.zeros(1 + 2 * width)
        for p in np.flatnonzero(chosen):
            state = whole.merge(state, np.concatenate([[n[p]], mean[p], squares[p]]))
        return state[0], state[1:1 + width], state[1 + width:]

    total, centre, around = over(np.ones(parts, bool))
    spread = np.sqrt(around / max(total - 1, 1))
    spread = np.where(spread > 0, spread, 1.0)
    own = [over(t) for t in trains]
    rows = np.array([x[0] for x in own])
    varies = np.array([x[2] > 1e-12 * (np.abs(x[1]) + spread) ** 2 * max(x[0], 1) for x in own]).reshape(models, width)
    active = np.hstack([np.ones((models, 1), bool), uses.astype(bool) & varies])
    means = np.array([x[1] for x in own]).reshape(models, width)
    per_run = max(1, SUMS_PER_PASS // ((width + 1) * (width + 4)))
    runs = [_solve(ready, tasks, trains[k:k + per_run], active[k:k + per_run], centre, spread) for k in range(0, models, per_run)]
    point, loss, null_loss, rank, settled = (np.concatenate([r[i] for r in runs]) for i in range(5))
    return Fits(point, centre, spread, loss, null_loss, rows, rank, [c for r in runs for c in r[5]], means, settled)


def _solve(ready: DataFrame, tasks: int, trains: np.ndarray, active: np.ndarray, centre: np.ndarray, spread: np.ndarray):
    models, width = active.shape
    point = np.zeros((models, width))
    kept, kept_loss, target = point.copy(), np.full(models, np.inf), point.copy()
    null_loss, done, settled = np.zeros(models), np.zeros(models, bool), np.zeros(models, bool)
    curves = np.zeros((models, width, width))
    for turn in range(MAX_PASSES):
        loss, slope, curve = _sums(ready, tasks, trains, point, centre, spread)
        if turn == 0:
            # at 0 every probability is a half; the model of the intercept alone needs the share of ones
            n = 4 * curve[:, 0, 0]
            share = np.divide(n / 2 - slope[:, 0], n, out=np.zeros_like(n), where=n > 0)
            for p in (share, 1 - share):
                null_loss -= np.where(p > 0, n * p * np.log(np.where(p > 0, p, 1)), 0)
        for m in np.flatnonzero(~done):
            if loss[m] > kept_loss[m] * (1 + 1e-12) + 1e-12:
                point[m] = (kept[m] + point[m]) / 2  # the step was too long
                settled[m] = done[m] = np.abs(point[m] - kept[m]).max() < SETTLED
                continue
            flat = kept_loss[m] - loss[m] <= FLAT * (abs(loss[m]) + 0.1)
            a = np.flatnonzero(active[m])
            step = np.linalg.lstsq(curve[m][np.ix_(a, a)], -slope[m][a], rcond=1e-10)[0]
            kept[m], kept_loss[m], curves[m] = point[m], loss[m], curve[m]
            target[m] = point[m]
            target[m, a] += step
            point[m] = target[m]
            size = np.abs(step).max(initial=0)
            settled[m] = size < SETTLED or (flat and size < NEARLY)  # steps shrink to their square
            done[m] = settled[m] or flat
            if done[m] and not settled[m]:
                point[m] = kept[m]
        if done.all():
            break
    if not settled.all():
        warnings.warn(f"{(~settled).sum()} of {models} models have no finite solution or did not settle", RuntimeWarning, stacklevel=3)
    rank, covariance = np.zeros(models, int), []
    for m in range(models):
        a = np.flatnonzero(active[m])
        own = curves[m][np.ix_(a, a)]
        rank[m] = np.linalg.matrix_rank(own, tol=1e-9 * max(np.abs(own).max(), 1e-300), hermitian=True) if own.any() else 0
        full = np.full((width, width), np.nan)
        full[np.ix_(a, a)] = np.linalg.pinv(own, rcond=1e-10, hermitian=True)
        covariance.append(full)
    return point, kept_loss, null_loss, rank, settled, covariance


def _standard(column: pa.Array, rows: int, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    x = matrix(column) if len(centre) else np.zeros((rows, 0))
    return np.hstack([np.ones((rows, 1)), (x - centre) / spread])


def _sums(ready: DataFrame, tasks: int, trains: np.ndarray, point: np.ndarray, centre: np.ndarray, spread: np.ndarray):
    """Loss, gradient and curvature of every model over its rows, in one pass."""
    models, width = point.shape
    upper = np.triu_indices(width)
    chunk = max(64, 2_000_000 // len(upper[0]))

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((models, 1 + width + len(upper[0])))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                some = batch.slice(at, chunk)
                part, label = some.column(0).to_numpy(), some.column(1).to_numpy()
                x = _standard(some.column(2), some.num_rows, centre, spread)
                for p in np.unique(part):
                    who = np.flatnonzero(trains[:, p])
                    if not who.size:
                        continue
                    own, y = x[part == p], label[part == p]
                    eta = own @ point[who].T
                    chance = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                    total[who, 0] += (np.logaddexp(0, eta) - y[:, None] * eta).sum(axis=0)
                    total[who, 1:1 + width] += (chance - y[:, None]).T @ own
                    total[who, 1 + width:] += (chance * (1 - chance)).T @ (own[:, upper[0]] * own[:, upper[1]])
        return total.ravel()

    flat = summed(ready.select("part", "label", "x"), add, tasks)
    total = np.zeros((models, 1 + width + len(upper[0]))) if flat is None else flat.reshape(models, -1)
    curve = np.zeros((models, width, width))
    curve[:, upper[0], upper[1]] = curve[:, upper[1], upper[0]] = total[:, 1 + width:]
    return total[:, 0], total[:, 1:1 + width], curve


def score(ready: DataFrame, fits: Fits, scores: np.ndarray, blocks: list, carried: Sequence[str] = ()) -> DataFrame:
    """(model, label, probability, carried columns) for every row of the parts with ``scores[model, part]``, in one pass.

    ``blocks`` are the design's, or a list of them per model. Rows with a level that no training row of the model has are left out.
    """
    point, centre, spread, rows = fits.point, fits.centre, fits.spread, fits.rows
    seen = fits.means * rows[:, None] > 0.5  # indicators with a training row
    own_blocks = [list(b) for b in blocks] if blocks and isinstance(blocks[0], list) else [list(blocks)] * len(point)
    first_seen = [[rows[m] * (1 - fits.means[m, b].sum()) > 0.5 for b in own] for m, own in enumerate(own_blocks)]
    names = ["part", "label", "x", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                some = batch.slice(at, 4_096)
                part = some.column(0).to_numpy()
                x = _standard(some.column(2), some.num_rows, centre, spread)
                raw = matrix(some.column(2)) if len(centre) else np.zeros((some.num_rows, 0))
                for m in range(len(point)):
                    take = scores[m, part] & (rows[m] > 0)
                    for block, first in zip(own_blocks[m], first_seen[m]):
                        own = raw[:, block] > 0
                        take &= np.where(own.any(axis=1), own @ seen[m, block], first)
                    if take.any():
                        where = pa.array(np.flatnonzero(take))
                        eta = (x[take] * point[m]).sum(axis=1)  # row by row: equal rows get equal scores
                        chance = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                        yield pa.RecordBatch.from_pydict({
                            "model": pa.array(np.full(len(where), m, np.int32)), "label": some.column(1).take(where),
                            "probability": pa.array(chance), **{c: some.column(3 + k).take(where) for k, c in enumerate(carried)}})

    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
    schema = "model int, label double, probability double" + "".join(f", `{c}` {kinds[c]}" for c in carried)
    return ready.select(*names).mapInArrow(run, schema)
