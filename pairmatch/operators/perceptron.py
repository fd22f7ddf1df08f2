"""Multi-layer perceptrons with several activations, solvers and step rules, for grid searches.

Each setting and fold is fitted by a task of its own. Its rows lie in a temporary file of the task and are
worked on some at a time, so their number has no bound. For one network fitted by all tasks there is
Spark's ``MultilayerPerceptronClassifier``.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.boosting import matrix
from pairmatch.operators.sampling import SEED, stratified_folds
from pairmatch.session import written

Weights = list[tuple[np.ndarray, np.ndarray]]

#: Rows whose layers a task holds at a time: about 5 KB a row with the usual layers, and as much for slopes.
PIECE_ROWS = 8192

#: Value and derivative (from the value) of each activation.
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "logistic": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
}


@dataclass(frozen=True)
class Settings:
    """A network and how it is fitted.

    ``sgd`` and ``adam`` go ``rounds`` times through the rows in drawn batches, ``lbfgs`` makes
    ``rounds`` steps over all rows. ``schedule`` is for ``sgd``: ``invscaling`` divides the step by
    the root of the number of batches so far, ``adaptive`` by 5 whenever the loss has not become
    smaller by ``tol`` twice in a row. ``decay`` is the weight decay.
    """

    solver: str = "adam"
    activation: str = "relu"
    schedule: str = "invscaling"
    hidden: tuple[int, ...] = (100, 250, 200, 50, 10)
    rounds: int = 20
    step: float = 0.0025
    decay: float = 1e-4
    tol: float = 1e-4
    batch: int = 200
    momentum: float = 0.9
    seed: int = SEED


def start(n_inputs: int, s: Settings) -> Weights:
    """Uniform weights, in a range that keeps the size of the values from layer to layer."""
    rng = np.random.default_rng(s.seed)
    sizes = [n_inputs, *s.hidden, 1]
    top = 2.0 if s.activation == "logistic" else 6.0
    out = []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(top / (a + b))
        out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return out


def margins(x: np.ndarray, weights: Weights, s: Settings) -> list[np.ndarray]:
    """The values of all layers; the last one is the margin of class 1."""
    act, layers = ACTIVATIONS[s.activation][0], [x]
    for k, (w, b) in enumerate(weights):
        z = layers[-1] @ w + b
        layers.append(z if k == len(weights) - 1 else act(z))
    return layers


def log_losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic loss of each row."""
    return np.logaddexp(0, np.where(y == 1, -margin, margin))


def loss_and_gradient(
    x: np.ndarray, y: np.ndarray, weights: Weights, s: Settings
) -> tuple[float, Weights]:
    """Mean loss with weight decay, and its gradient by back propagation, some rows at a time."""
    n, total, sums = len(x), 0.0, None
    for k in range(0, n, PIECE_ROWS):
        loss, parts = loss_and_slopes(x[k : k + PIECE_ROWS], y[k : k + PIECE_ROWS], weights, s, n)
        total += loss
        sums = parts if sums is None else [(a + c, b + d) for (a, b), (c, d) in zip(sums, parts)]
    loss = total / n + s.decay / 2 / n * sum((w**2).sum() for w, _ in weights)
    return float(loss), [(a + s.decay / n * w, b) for (a, b), (w, _) in zip(sums, weights)]


def loss_and_slopes(
    x: np.ndarray, y: np.ndarray, weights: Weights, s: Settings, n: int
) -> tuple[float, Weights]:
    """Sum of the losses of some of ``n`` rows, and their part of the gradient of the mean loss."""
    layers = margins(x, weights, s)
    margin = layers[-1][:, 0]
    slope = ((ACTIVATIONS["logistic"][0](margin) - y) / n)[:, None]
    out: Weights = []
    for k in range(len(weights) - 1, -1, -1):
        w, _ = weights[k]
        out.append((layers[k].T @ slope, slope.sum(axis=0)))
        if k:
            slope = (slope @ w.T) * ACTIVATIONS[s.activation][1](layers[k])
    return log_losses(margin, y).sum(), out[::-1]


def flat(weights: Weights) -> np.ndarray:
    """All numbers in a row."""
    return np.concatenate([part.ravel() for layer in weights for part in layer])


def shaped(numbers: np.ndarray, like: Weights) -> Weights:
    """Numbers in the shapes of the layers."""
    out, at = [], 0
    for w, b in like:
        parts = [numbers[at : at + w.size].reshape(w.shape)]
        at += w.size
        out.append((parts[0], numbers[at : at + b.size]))
        at += b.size
    return out


def by_batches(x: np.ndarray, y: np.ndarray, s: Settings) -> Weights:
    """``sgd`` with look-ahead momentum, or ``adam``."""
    rng = np.random.default_rng([s.seed, 1])
    like = start(x.shape[1], s)
    w = flat(like)
    speed, square, count = np.zeros_like(w), np.zeros_like(w), 0
    step, best, waited, size = s.step, np.inf, 0, min(s.batch, len(x))
    for _ in range(s.rounds):
        order, total = rng.permutation(len(x)), 0.0
        for k in range(0, len(x), size):
            rows = order[k : k + size]
            loss, gradient = loss_and_gradient(x[rows], y[rows], shaped(w, like), s)
            total, g, count = total + loss * len(rows), flat(gradient), count + 1
            if s.solver == "adam":
                speed = 0.9 * speed + 0.1 * g
                square = 0.999 * square + 0.001 * g * g
                rate = s.step * np.sqrt(1 - 0.999**count) / (1 - 0.9**count)
                w = w - rate * speed / (np.sqrt(square) + 1e-8)
            else:
                speed = s.momentum * speed - step * g
                w = w + s.momentum * speed - step * g
                if s.schedule == "invscaling":
                    step = s.step / np.sqrt(count + 1)
        mean = total / len(x)
        waited = 0 if mean < best - s.tol else waited + 1
        best = min(best, mean)
        if waited >= 2:
            if s.solver != "sgd" or s.schedule != "adaptive" or step <= 1e-6:
                break
            step, waited = step / 5, 0
    return shaped(w, like)


def by_all_rows(x: np.ndarray, y: np.ndarray, s: Settings, kept: int = 10) -> Weights:
    """Steps along limited-memory estimates of the inverse curvature (``lbfgs``)."""
    like = start(x.shape[1], s)
    w, past = flat(like), deque(maxlen=kept)

    def at(numbers: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = loss_and_gradient(x, y, shaped(numbers, like), s)
        return loss, flat(gradient)

    loss, g = at(w)
    for _ in range(s.rounds):
        way, sides = g.copy(), []
        for dw, dg in reversed(past):
            a = dw @ way / (dg @ dw)
            way -= a * dg
            sides.append(a)
        if past:
            way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (dw, dg), a in zip(past, reversed(sides)):
            way += (a - dg @ way / (dg @ dw)) * dw
        length = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        for _ in range(30):  # halve the step until the loss falls enough
            new_loss, new_g = at(w - length * way)
            if new_loss <= loss - 1e-4 * length * (g @ way):
                break
            length /= 2
        else:
            break
        dw, dg = -length * way, new_g - g
        if dw @ dg > 1e-12:
            past.append((dw, dg))
        done = loss - new_loss <= s.tol * 1e-3 * max(1, abs(loss))
        w, loss, g = w + dw, new_loss, new_g
        if done:
            break
    return shaped(w, like)


def fit_here(x: np.ndarray, y: np.ndarray, s: Settings) -> Weights:
    """Fit on rows in memory."""
    return by_all_rows(x, y, s) if s.solver == "lbfgs" else by_batches(x, y, s)


def grid(base: Settings, **values: list) -> list[Settings]:
    """All combinations of the listed values, the last name changing first."""
    return [replace(base, **dict(zip(values, point))) for point in product(*values.values())]


def mean_loss(x: np.ndarray, y: np.ndarray, weights: Weights, s: Settings) -> float:
    """Mean logistic loss, some rows at a time."""
    total = 0.0
    for k in range(0, len(x), PIECE_ROWS):
        margin = margins(x[k : k + PIECE_ROWS], weights, s)[-1][:, 0]
        total += log_losses(margin, y[k : k + PIECE_ROWS]).sum()
    return float(total / len(x)) if len(x) else float("nan")


def on_disk(shape: tuple[int, int], file) -> np.ndarray:
    """Numbers that lie in a file; the system keeps in memory what it has room for."""
    file.truncate(max(8, 8 * shape[0] * shape[1]))
    return np.asarray(np.memmap(file, np.float64, "r+", shape=shape)) if shape[0] * shape[1] else np.zeros(shape)


def standardised(x: np.ndarray, train: np.ndarray, held: np.ndarray, out: np.ndarray) -> None:
    """Write rows ``train``, then rows ``held`` to ``out``, standardised by ``train``; a constant counts as 0."""
    pieces = [train[k : k + PIECE_ROWS] for k in range(0, len(train), PIECE_ROWS)]
    width = np.zeros(x.shape[1])
    mean = sum((x[p].sum(axis=0) for p in pieces), width) / len(train)
    spread = np.sqrt(sum((((x[p] - mean) ** 2).sum(axis=0) for p in pieces), width) / len(train))
    order, scale = np.concatenate([train, held]), np.where(spread > 0, spread, np.inf)
    for k in range(0, len(order), PIECE_ROWS):
        out[k : k + PIECE_ROWS] = (x[order[k : k + PIECE_ROWS]] - mean) / scale


def grid_scores(
    df: DataFrame, inputs: list[str], settings: list[Settings], folds: int,
    label: str = "is_duplicate", key: str = "id", most_rows: int | None = None,
) -> DataFrame:
    """``(setting, log_loss)``: mean held-out loss of each setting over class-balanced folds.

    Columns are standardised by the rows of the fit; a constant column counts as 0. A task has all
    labelled rows, in a temporary file, and works on ``PIECE_ROWS`` of them at a time; it holds a label, a
    fold and a key per row. With ``most_rows``, more labelled rows are refused. Rows without a label are
    left out.
    """
    labelled = df.where(F.col(label).isNotNull())
    if most_rows is not None and labelled.count() > most_rows:
        raise ValueError(f"more than {most_rows} labelled rows for one task")
    columns = F.array(*[F.col(c).cast("double") for c in inputs]).alias("x")
    rows = labelled.select(key, F.col(label).cast("int").alias("y"), columns)
    held = written(stratified_folds(rows, folds, "y", key), "folds")
    fits = held.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(len(settings) * folds - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = 0, []
        with tempfile.TemporaryFile() as read, tempfile.TemporaryFile() as dealt:
            for batch in batches:
                number = batch.column("fit")[0].as_py()
                parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "y", "fold")])
                read.write(matrix(batch.column("x")).tobytes())
            read.flush()
            ids, y, fold = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(ids, kind="stable")
            out = fold[order] == number % folds
            train, rest = order[~out], order[out]
            shape = (len(ids), len(inputs))
            x = on_disk(shape, dealt)
            standardised(on_disk(shape, read), train, rest, x)
            s, n = settings[number // folds], len(train)
            loss = mean_loss(x[n:], y[rest], fit_here(x[:n], y[train], s), s)
        yield pa.RecordBatch.from_pydict({"k": [number // folds], "loss": [loss]})

    losses = fits.repartitionById(len(settings) * folds, F.col("fit")).groupBy("fit").applyInArrow(
        run, "k long, loss double"
    )
    texts = [f"solver={s.solver}, activation={s.activation}, schedule={s.schedule}" for s in settings]
    name = F.element_at(F.array(*map(F.lit, texts)), F.col("k").cast("int") + 1)
    return losses.groupBy("k").agg(F.avg("loss").alias("log_loss")).select(
        name.alias("setting"), "log_loss"
    )
