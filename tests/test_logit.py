"""The logit: estimates against a plain Newton fit, columns that add nothing, outcomes that are told apart."""

import numpy as np
import pytest

from retroscope.operators import stats


def table(spark, y, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(int(a), *map(float, b)) for a, b in zip(y, x)]
    return spark.createDataFrame([*rows, (1, *[None] * len(names))], "y int, " + ", ".join(f"{n} double" for n in names)).repartition(4), names


def plain_fit(y, x):
    z = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        info = (z * (p * (1 - p))[:, None]).T @ z
        b = b + np.linalg.solve(info, z.T @ (y - p))
    eta = z @ b
    return b, np.sqrt(np.diag(np.linalg.inv(info))), float((y * eta - np.logaddexp(0, eta)).sum())


def data(seed, n, p):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 50, 0.01][:p] + [0, 1000, -3][:p]
    eta = 0.4 * (x[:, 0]) - 0.01 * (x[:, 1] - 1000)
    return (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int), x


def test_estimates_equal_a_plain_fit(spark):
    y, x = data(1, 600, 3)
    df, names = table(spark, y, x)
    fit = stats.fit_logit(df, "y", names)
    b, se, llf = plain_fit(y, x)
    terms = {t["term"]: t for t in fit["terms"]}
    assert fit["converged"] and fit["n"] == 600 and fit["params"] == 4 and fit["llf"] == pytest.approx(llf)
    assert [terms[n]["coef"] for n in [*names, "const"]] == pytest.approx(list(b), rel=1e-5)
    assert [terms[n]["se"] for n in [*names, "const"]] == pytest.approx(list(se), rel=1e-4)
    assert all(t["status"] == "estimated" and abs(t["score"]) < 1e-4 for t in fit["terms"])
    at = {r["term"]: r for r in stats.logit_score(df, "y", {"const": b[-1], **dict(zip(names, b))}).collect()}
    assert at["x0"]["llf"] == pytest.approx(llf) and at["x0"]["n"] == 600 and abs(at["x0"]["score"]) < 1e-6
    share = y.mean()
    assert fit["pseudo_r2"] == pytest.approx(1 - llf / (600 * (share * np.log(share) + (1 - share) * np.log(1 - share))))


def test_columns_that_add_nothing_are_named(spark):
    y, x = data(2, 300, 2)
    wide = np.hstack([x, x[:, :1] * 2 - x[:, 1:2], np.full((300, 1), 7.0), x[:, :1] ** 2])
    df, names = table(spark, y, wide)
    fit = stats.fit_logit(df, "y", names)
    assert [t["status"] for t in fit["terms"]] == ["estimated", "estimated", "collinear", "constant", "estimated", "estimated"]
    b, _, llf = plain_fit(y, wide[:, [0, 1, 4]])
    assert fit["llf"] == pytest.approx(llf) and fit["params"] == 4
    assert [t["coef"] for t in fit["terms"] if t["status"] == "estimated"][:3] == pytest.approx(list(b[:3]), rel=1e-4)


def test_a_group_with_one_outcome_is_separated(spark):
    y, x = data(3, 500, 1 + 1)
    group = np.arange(500) % 5
    y = np.where(group == 4, 1, y)
    wide = np.hstack([x, (group[:, None] == [1, 2, 4]).astype(float)])
    df, names = table(spark, y, wide)
    fit = stats.fit_logit(df, "y", names)
    assert [t["status"] for t in fit["terms"]] == ["estimated"] * 4 + ["separated", "estimated"]
    # the others are fitted on the rows that nothing tells apart
    rest = group != 4
    b, se, llf = plain_fit(y[rest], wide[rest][:, :4])
    assert fit["llf"] == pytest.approx(llf) and fit["params"] == 6 and fit["converged"]
    assert [t["coef"] for t in fit["terms"][:4]] == pytest.approx(list(b[:4]), rel=1e-4)
    assert [t["se"] for t in fit["terms"][:4]] == pytest.approx(list(se[:4]), rel=1e-3)
    assert fit["terms"][4]["coef"] is None and fit["terms"][4]["p_value"] is None


def test_a_number_that_tells_all_outcomes(spark):
    x = np.arange(40.0)[:, None]
    df, names = table(spark, (x[:, 0] > 20.5).astype(int), x)
    fit = stats.fit_logit(df, "y", names)
    assert [t["status"] for t in fit["terms"]] == ["separated", "separated"] and fit["llf"] == 0 and fit["pseudo_r2"] == 1
    # nearly: two rows at the border differ, so the border is all that remains
    x = np.concatenate([x, [[20.0], [21.0], [20.0], [21.0]]])
    y = np.concatenate([(x[:40, 0] > 20.5).astype(int), [1, 0, 0, 1]])
    df, names = table(spark, y, x)
    fit = stats.fit_logit(df, "y", names)
    b, _, llf = plain_fit(y, x)
    assert fit["llf"] == pytest.approx(llf) and fit["terms"][0]["status"] == "estimated"


def test_one_outcome_and_no_columns(spark):
    df, names = table(spark, np.ones(20, int), np.arange(20.0)[:, None])
    fit = stats.fit_logit(df, "y", names)
    assert {t["status"] for t in fit["terms"]} == {"separated"} and fit["llf"] == 0
    y, x = data(4, 100, 2)
    df, _ = table(spark, y, x)
    fit = stats.fit_logit(df.na.drop(), "y", [])
    assert fit["terms"][0]["coef"] == pytest.approx(np.log(y.mean() / (1 - y.mean()))) and fit["pseudo_r2"] == pytest.approx(0)


def test_ratio_test_of_models():
    small, large = {"llf": -50.0, "params": 3}, {"llf": -47.0, "params": 5}
    assert stats.likelihood_ratio(small, large)["p_value"] == pytest.approx(np.exp(-3.0))
    assert stats.likelihood_ratio(large, small)["p_value"] is None
