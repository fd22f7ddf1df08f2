import numpy as np
import pytest

from pairmatch.operators import perceptron as P

RNG = np.random.default_rng(3)
X = RNG.normal(size=(120, 4))
Y = (X[:, 0] * X[:, 1] > 0).astype(int)
SMALL = P.Settings(hidden=(7, 3), batch=40)


@pytest.mark.parametrize("activation", ["relu", "logistic", "tanh"])
def test_gradient_is_that_of_the_loss(activation):
    s = P.replace(SMALL, activation=activation, decay=0.3)
    weights = P.start(4, s)
    _, gradient = P.loss_and_gradient(X, Y, weights, s)
    g, w = P.flat(gradient), P.flat(weights)
    for k in range(0, len(w), 5):
        ends = []
        for e in (1e-6, -1e-6):
            moved = w.copy()
            moved[k] += e
            ends.append(P.loss_and_gradient(X, Y, P.shaped(moved, weights), s)[0])
        assert g[k] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("solver", ["sgd", "lbfgs", "adam"])
@pytest.mark.parametrize("schedule", ["invscaling", "adaptive"])
def test_every_solver_lessens_the_loss(solver, schedule):
    s = P.replace(SMALL, solver=solver, schedule=schedule, activation="tanh", rounds=150, step=0.05)
    first = P.loss_and_gradient(X, Y, P.start(4, s), s)[0]
    last = P.loss_and_gradient(X, Y, P.fit_here(X, Y, s), s)[0]
    assert last < (0.35 if solver != "sgd" or schedule == "adaptive" else first)


def test_first_steps_follow_their_formulas():
    s = P.replace(SMALL, batch=500, rounds=1, step=0.1)
    w = P.start(4, s)
    g = P.flat(P.loss_and_gradient(X, Y, w, s)[1])
    # the first look-ahead step goes 1 + momentum times as far
    sgd = P.flat(P.fit_here(X, Y, P.replace(s, solver="sgd")))
    np.testing.assert_allclose(sgd, P.flat(w) - 0.1 * 1.9 * g, atol=1e-12)
    adam = P.flat(P.fit_here(X, Y, P.replace(s, solver="adam")))
    big = np.abs(g) > 1e-4
    np.testing.assert_allclose((adam - P.flat(w))[big], -0.1 * np.sign(g[big]), rtol=1e-2)


def test_grid_of_settings_by_folds(spark):
    rows = [(int(k), *map(float, X[k]), 1.0, int(Y[k])) for k in range(len(X))]
    rows.append((999, 0.0, 0.0, 0.0, 0.0, 1.0, None))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, is_duplicate int")
    base = P.replace(SMALL, rounds=60, step=0.02)
    settings = P.grid(base, solver=["sgd", "lbfgs", "adam"], activation=["relu", "logistic", "tanh"],
                      schedule=["invscaling", "adaptive"])
    got = {r["setting"]: r["log_loss"] for r in P.grid_scores(df, list("abcde"), settings, 3).collect()}
    assert len(got) == 18 and all(0 < v < 30 for v in got.values())
    # one setting by hand, over the same folds
    from pairmatch.operators.sampling import stratified_folds

    fold = {r["id"]: r["fold"] for r in stratified_folds(df.where("is_duplicate is not null"), 3).collect()}
    fold = np.array([fold[k] for k in range(len(X))])
    s, losses = settings[-1], []
    for k in range(3):
        out, full = fold == k, np.column_stack([X, np.zeros(len(X))])
        x = (full - full[~out].mean(0)) / np.where(full[~out].std(0) > 0, full[~out].std(0), np.inf)
        margin = P.margins(x[out], P.fit_here(x[~out], Y[~out], s), s)[-1][:, 0]
        losses.append(P.log_losses(margin, Y[out]).mean())
    assert got["solver=adam, activation=tanh, schedule=adaptive"] == pytest.approx(np.mean(losses))
    with pytest.raises(ValueError):
        P.grid_scores(df, ["a"], settings, 3, most_rows=5)


def test_grid_takes_any_number_of_rows_some_at_a_time(spark, monkeypatch):
    """No number of rows is refused by itself; losses and gradients of pieces add up to those of all rows."""
    import inspect

    assert inspect.signature(P.grid_scores).parameters["most_rows"].default is None
    weights = P.start(4, SMALL)
    whole, gradient = P.loss_and_gradient(X, Y, weights, SMALL)
    df = spark.createDataFrame(
        [(int(k), *map(float, X[k]), int(Y[k])) for k in range(len(X))],
        "id long, a double, b double, c double, d double, is_duplicate int",
    )
    settings = P.grid(P.replace(SMALL, rounds=5), solver=["lbfgs", "adam"])
    want = {r["setting"]: r["log_loss"] for r in P.grid_scores(df, list("abcd"), settings, 3).collect()}
    held = []
    with monkeypatch.context() as m:
        m.setattr(P, "PIECE_ROWS", 50)
        plain = P.margins
        m.setattr(P, "margins", lambda x, *a: held.append(len(x)) or plain(x, *a))
        loss, parts = P.loss_and_gradient(X, Y, weights, SMALL)
        P.fit_here(X, Y, settings[0])
        out = np.empty_like(X)
        P.standardised(X, np.arange(100), np.arange(100, 120), out)
    assert loss == pytest.approx(whole) and max(held) == 50
    np.testing.assert_allclose(P.flat(parts), P.flat(gradient), atol=1e-12)
    np.testing.assert_allclose(out, (X - X[:100].mean(0)) / X[:100].std(0), atol=1e-12)
    assert len(want) == 2 and all(0 < v < 30 for v in want.values())
