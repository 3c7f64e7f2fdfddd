"""Forests that are grown by tasks."""

import numpy as np
import pytest

from understory.operators import learn as E, trees as T


def blocks(x, y, w=None):
    return lambda: ((x[a:a + 700], y[a:a + 700], (np.ones(len(y)) if w is None else w)[a:a + 700]) for a in range(0, len(y), 700))


@pytest.mark.parametrize("limit", [10 ** 9, 500])
def test_a_tree_is_grown_to_its_ends(limit):
    """Leaves hold the mean of their drawn rows, at least ``least`` of them, whether nodes fit a task's memory or not."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 32, (4000, 3)).astype(np.uint8)
    y = np.where(x[:, 0] > 11, 5.0, 1.0) + x[:, 1] * 0.1 + rng.normal(size=4000)
    tree = T.grow(blocks(x, y), 4000, 3, 5, 1.0, [42, 7], limit)
    c = np.concatenate([np.random.default_rng([42, 7, i]).poisson(1.0, len(b[1])) for i, b in enumerate(blocks(x, y)())])
    leaf = T.place(x, tree.arrays)
    n, total = np.bincount(leaf, c), np.bincount(leaf, c * y)
    held = np.flatnonzero(n)
    assert n[held].min() >= 5 and tree.arrays[3][held] == pytest.approx(total[held] / n[held])
    assert len(held) > 300 and (tree.arrays[0][held] == -1).all()
    assert tree.importance.argmax() == 0


def test_limits_give_one_first_split():
    """The first split of all features is the best of all cuts, by brute force."""
    rng = np.random.default_rng(4)
    x, w = rng.integers(0, 32, (900, 2)).astype(np.uint8), rng.uniform(0.5, 2, 900)
    y = np.sin(x[:, 1] / 5) + rng.normal(size=900) * 0.1
    c = np.concatenate([np.random.default_rng([1, 1, i]).poisson(1.0, len(b[1])) for i, b in enumerate(blocks(x, y)())])
    v = w * c
    best = max((sum(np.sum(v[s] * y[s]) ** 2 / v[s].sum() for s in (x[:, f] <= k, x[:, f] > k)), f, k)
               for f in range(2) for k in range(31) if min(c[x[:, f] <= k].sum(), c[x[:, f] > k].sum()) >= 5)
    for limit in (10 ** 9, 400):
        tree = T.grow(blocks(x, y, w), 900, 2, 5, 1.0, [1, 1], limit)
        assert (tree.arrays[0][0], tree.arrays[1][0]) == best[1:]


def test_forests_have_no_limit_of_depth(spark):
    """A stair of 32 steps in the only feature; trees of six levels blur it, and registered forests had 40 of them."""
    df = spark.range(0, 6400, 1, 3).selectExpr("CAST(id % 32 AS DOUBLE) AS a", "CAST(power(1.3D, id % 32) AS DOUBLE) AS y", "'x' AS name",
                                               "CAST(id % 32 % 2 AS INT) AS good")
    model = E.fit_forest(df, ["a"], "y", trees=4)
    got = {r.a: r.prediction for r in model.transform(df.where("id < 32")).select("a", "prediction").collect()}
    assert got == pytest.approx({float(i): 1.3 ** i for i in range(32)}) and model.stages[-1].trees == 4
    assert model.stages[-1].featureImportances.toArray().tolist() == [1.0]
    missing = E.predict(model, df.where("a < 3").limit(30).selectExpr("IF(a = 1, NULL, a) AS a", "name").distinct(), ["a"], ["name"]).collect()
    assert sorted(r.pred is None for r in missing) == [False, False, True]
    with pytest.raises(Exception, match="target"):
        E.fit_forest(df.selectExpr("a", "IF(a = 3, NULL, y) AS y"), ["a"], "y", trees=1)
    scored = E.quality_scores(E.fit_quality(df, ["a"], "good", trees=4), df, ["a"], "good")
    assert scored.where("abs(score - good) < 1e-9").count() == 6400


def test_registered_forests_are_whole(spark, monkeypatch):
    """They had 40 trees of six levels."""
    from types import SimpleNamespace

    from understory.plans import models

    seen = []

    def stop(*args, **options):
        seen.append((args[3:], options))
        raise InterruptedError

    for name in ("fit_forest", "fit_quality"):
        monkeypatch.setattr(E, name, stop)
    for name in ("holdout", "quality_split"):
        monkeypatch.setattr(E, name, lambda *a: (None, None))
    for name in ("training", "written", "fill_group_median"):
        monkeypatch.setattr(models, name, lambda *a: None)
    rows = SimpleNamespace(where=lambda c: rows, select=lambda *c: rows)
    for made in (models.rf_regression, models.rf_quality_classifier):
        with pytest.raises(InterruptedError):
            made(SimpleNamespace(footprints=rows))
    assert seen == [((), {}), ((), {})]
