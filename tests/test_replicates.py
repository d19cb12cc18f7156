"""Differences of configurations over the same queries, and monotone fits of curves."""

import itertools

import numpy as np
import pytest

from ragscale.operators import bootstrap, replicates
from ragscale.operators.replicates import PATTERNS, isotonic, shapes

KEYS = ["model", "quantization"]


def study(spark, n=200, seed=4, noise=0.02):
    """Two points of one curve over the same queries, whose scores go along with each other."""
    rng = np.random.default_rng(seed)
    hard = rng.random(n)
    rows = [("m", "FP16", f"q{i}", float(x)) for i, x in enumerate(hard)]
    rows += [("m", "Q4", f"q{i}", float(x - 0.03 + noise * rng.normal())) for i, x in enumerate(hard)]
    rows += [("k", "Q4", f"q{i}", float(rng.random())) for i in range(n)] + [(None, "Q4", "q1", None)]
    return spark.createDataFrame(rows, "model string, quantization string, query_id string, cu double")


def test_paired_interval_is_narrower_than_the_overlap_rule(spark):
    df = study(spark)
    vectors = replicates.replicate_vectors(df, KEYS, ["cu"], "query_id")
    (r,) = replicates.baseline_differences(vectors, KEYS, "FP16").collect()
    plain = {x.quantization: x for x in bootstrap.poisson_ci(df, KEYS, ["cu"], "query_id").where("model = 'm'").collect()}
    assert r.delta == pytest.approx(plain["Q4"]["mean"] - plain["FP16"]["mean"])
    apart = (plain["Q4"]["ci_hi"] - plain["Q4"]["ci_lo"]) + (plain["FP16"]["ci_hi"] - plain["FP16"]["ci_lo"])
    assert r.ci_hi - r.ci_lo < apart / 10 and r.ci_lo < r.delta < r.ci_hi
    assert r.differs and plain["Q4"]["ci_hi"] > plain["FP16"]["ci_lo"]  # intervals overlap, the difference is sure all the same


@pytest.mark.parametrize("block_rows", [1 << 20, 40])
def test_replicates_give_the_bootstrap_interval(spark, monkeypatch, block_rows):
    from ragscale.operators import skew
    monkeypatch.setattr(skew, "MIN_BLOCK_ROWS", 10)
    df = study(spark)
    vectors = replicates.replicate_vectors(df, KEYS, ["cu"], "query_id", n_resamples=300, block_rows=block_rows)
    assert {len(r.replicates) for r in vectors.collect()} == {300}
    got = {(r.model, r.quantization): (r["mean"], r.ci_lo, r.ci_hi) for r in replicates.with_interval(vectors, vectors["replicates"]).collect()}
    want = {(r.model, r.quantization): (r["mean"], r.ci_lo, r.ci_hi) for r in bootstrap.poisson_ci(df, KEYS, ["cu"], "query_id", n_resamples=300).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_pairs_of_models(spark):
    vectors = replicates.replicate_vectors(study(spark), KEYS, ["cu"], "query_id")
    rows = replicates.pair_differences(vectors, [("m", "k"), ("k", "nobody")], KEYS).collect()
    assert [(r.model, r.other, r.quantization) for r in rows] == [("m", "k", "Q4")]
    assert replicates.baseline_differences(vectors.limit(0), KEYS, "FP16").count() == 0


def brute_isotonic(y):
    """Best non-decreasing fit by trying every way to cut the points into blocks."""
    best = None
    for k in range(len(y)):
        for cuts in itertools.combinations(range(1, len(y)), k):
            blocks = np.split(np.asarray(y, float), cuts)
            means = [b.mean() for b in blocks]
            if all(a <= b + 1e-12 for a, b in zip(means, means[1:])):
                fit = np.concatenate([np.full(len(b), m) for b, m in zip(blocks, means)])
                loss = ((fit - y) ** 2).sum()
                if best is None or loss < best[0] - 1e-12:
                    best = (loss, fit)
    return best[1]


def test_fits_are_isotonic_regressions():
    rng = np.random.default_rng(6)
    values = np.round(rng.random((300, 6)), 1)  # with ties
    there = rng.random((300, 6)) < 0.8
    fit = isotonic(values, there)
    for y, t, f in zip(values, there, fit):
        assert np.isnan(f[~t]).all()
        if t.any():
            assert f[t] == pytest.approx(brute_isotonic(y[t]))


def test_shapes_ties_and_missing_points():
    nan = np.nan
    m = np.array([[0, .1, .2, .9], [.9, .5, .5, 0], [.5, .5, .5, .5], [.5, .52, .5, .51], [0, .5, .5, 0], [nan, nan, .4, nan], [nan, .1, nan, .8], [nan] * 4])
    assert [PATTERNS[i] for i in shapes(m, 0.05)] == ["rising", "falling", "flat", "flat", "indeterminate", "indeterminate", "rising", "indeterminate"]


def test_probabilities_of_a_curve(spark):
    rng = np.random.default_rng(8)
    level = {"FP16": 0.3, "Q8": 0.4, "Q4": 0.7, "other": 0.0}
    rows = [("m", q, f"q{i}", float(v + 0.05 * rng.normal())) for q, v in level.items() for i in range(60)] + [("one", "Q4", "q1", 0.5)]
    df = spark.createDataFrame(rows, "model string, quantization string, query_id string, cu double")
    vectors = replicates.replicate_vectors(df, KEYS, ["cu"], "query_id", n_resamples=200)
    got = {r.model: r for r in replicates.curve_probabilities(vectors, ["model"], ["Q4", "Q8", "FP16"]).collect()}
    assert got["m"].n_points == 3 and got["m"].p_rising == 1.0 and got["m"].p_indeterminate == 0.0
    assert got["one"].n_points == 1 and got["one"].p_indeterminate == 1.0
