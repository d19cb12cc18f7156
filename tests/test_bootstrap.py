"""Properties of the bootstrap estimators and the preference gap."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragscale.operators import aggregate, bootstrap


def frame(spark, groups):
    rows = [(g, i, float(v)) for g, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, id bigint, v double")


def by_group(df):
    return {r["g"]: r for r in df.collect()}


def skewed(n, power, seed):
    """Scores in [0, 1] piled up near 0."""
    return np.random.default_rng(seed).random(n) ** power


GROUPS = {
    "skewed": skewed(700, 4, 1),
    "ties": np.repeat([0.0, 0.25, 0.5], [50, 130, 70]),
    "yes_no": (np.arange(300) % 3 == 0).astype(float),
    "narrow": 0.6 + skewed(260, 2, 2) / 500,
    "constant": np.full(33, 0.125),
    "one": np.array([0.75]),
}
METHODS = [bootstrap.poisson_ci, bootstrap.multinomial_ci]


@pytest.mark.parametrize("method", METHODS)
def test_interval_properties(spark, method):
    found = by_group(method(frame(spark, GROUPS), ["g"], ["v"], "id"))
    for g, values in GROUPS.items():
        r = found[g]
        assert r["n"] == len(values) and r["mean"] == pytest.approx(values.mean())
        assert r["ci_lo"] - 1e-9 <= r["mean"] <= r["ci_hi"] + 1e-9
        if len(set(values)) == 1:
            assert r["ci_lo"] == pytest.approx(r["ci_hi"]) and r["std"] == 0.0
        else:  # normal theory: the interval spans 3.92 standard errors
            assert r["ci_hi"] - r["ci_lo"] == pytest.approx(3.92 * values.std(ddof=1) / len(values) ** 0.5, rel=0.15)


def brute_hash(lane, b, k1, k2, seed=42):
    """A hash below the prime in Python's own integers."""
    prime = (1 << 31) - 1
    d = hashlib.md5(f"{seed}-{lane}-{b}".encode()).hexdigest()
    ca, cb, cc = int(d[:10], 16) % (prime - 1) + 1, int(d[10:20], 16) % (prime - 1) + 1, int(d[20:30], 16) % prime
    x = (k1 * ca + k2 * cb + cc) % prime
    return ((x * x + 12345) ** 2 + x) % prime


def brute_draws(n, b, leaf=bootstrap.LEAF):
    """Positions of all draws of one replicate, node by node."""
    prime, levels = (1 << 31) - 1, 0
    while leaf << levels < n:
        levels += 1
    out = []

    def visit(level, node, k):
        if level < levels:
            bits = "".join(format(brute_hash(bootstrap.SPLITS, b, w, node), "031b")[::-1] for w in range(-(-k // 31)))[:k]
            visit(level + 1, 2 * node, bits.count("1"))
            visit(level + 1, 2 * node + 1, k - bits.count("1"))
            return
        for i in range(k):
            u = Fraction(brute_hash(bootstrap.HIGH, b, i, node) * prime + brute_hash(bootstrap.LOW, b, i, node), prime * prime)
            out.append(math.floor((node - (1 << levels) + u) * n / (1 << levels)))

    visit(0, 1, n)
    return out


def brute_multinomial(values, n_resamples=1000):
    means = [np.mean(np.asarray(values)[brute_draws(len(values), b)]) for b in range(n_resamples)]
    return np.percentile(means, [2.5, 97.5])


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 100, 1000])
def test_tree_and_draws_against_plain_integers(n):
    leaf, levels = 16, bootstrap.tree_levels(n, 16)
    split, high, low = (bootstrap.coefficients(lane, 3, 42) for lane in (bootstrap.SPLITS, bootstrap.HIGH, bootstrap.LOW))
    for b in range(3):
        counts = bootstrap.split_counts(n, split[:, b], leaf)
        assert len(counts) == 1 << levels and counts.sum() == n
        got = bootstrap.leaf_draws(0, counts, n, levels, high[:, b], low[:, b])
        assert got.tolist() == brute_draws(n, b, leaf) and 0 <= got.min() <= got.max() < n


@pytest.mark.parametrize("n", [1_500_000_000, 3_000_000_000, 50_000_000_000])
def test_draws_of_huge_groups_fall_evenly_on_all_positions(n):
    """Leaves of a simulated tree: every stretch of positions gets its share, the last positions too."""
    levels = bootstrap.tree_levels(n)
    high, low = (bootstrap.coefficients(lane, 1, 42)[:, 0] for lane in (bootstrap.HIGH, bootstrap.LOW))
    per, first = 2000, [0, (1 << levels) // 3, (1 << levels) - 60]
    for leaf in first:
        drawn = bootstrap.leaf_draws(leaf, np.full(60, per), n, levels, high, low)
        inside = (drawn / n * (1 << levels) - leaf) * 4  # quarters of a leaf
        times = np.bincount(np.floor(inside + 1e-6).astype(int).clip(0, 239), minlength=240)
        chi = ((times - per / 4) ** 2 / (per / 4)).sum()
        assert abs(chi - 180) < 6 * (2 * 180) ** 0.5  # 240 cells, 60 sums fixed
    assert drawn.max() >= n - n / (1 << levels) / 100
    top = np.uint32(bootstrap.PRIME - 1)
    assert bootstrap.scaled(np.array([top]), np.array([top]), n)[0] == n - 1
    exact = [(h * bootstrap.PRIME + w) * n // bootstrap.PRIME**2 for h, w in ((5, 7), (2**30, 2**31 - 2), (2**31 - 2, 0))]
    assert bootstrap.scaled(np.array([5, 2**30, 2**31 - 2]), np.array([7, 2**31 - 2, 0]), n).tolist() == exact


def test_split_is_a_fair_binomial():
    by = bootstrap.coefficients(bootstrap.SPLITS, 300, 7)
    left = np.array([bootstrap.split_counts(100_000, by[:, b], 50_000)[0] for b in range(300)])
    z = (left - 50_000) / 25_000**0.5
    assert abs(z.mean()) < 0.25 and 0.85 < z.std() < 1.15


def test_leaves_of_a_block_are_those_that_reach_it():
    for n, levels in ((1000, 6), (77, 3), (4097, 1)):
        for lo, hi in ((0, 1), (3, 30), (n - 5, n), (0, n)):
            want = [j for j in range(1 << levels) if any(lo <= (j * n + t) >> levels < hi for t in range(n))]
            assert bootstrap.leaf_range(lo, hi, n, levels) == (want[0], want[-1])


def test_weights_of_different_keys_are_independent():
    prime = bootstrap.PRIME
    by = bootstrap.coefficients(bootstrap.WEIGHTS, 1000, 42)
    keys = np.array([(5, 9), (5, 10), (6, 9), (9, 5), (0, 0), (prime - 1, prime - 1)], dtype=np.uint64)
    w = bootstrap.poisson_weights(keys[:, 0], keys[:, 1], by).astype(float)
    assert abs(w.mean() - 1) < 0.06 and abs(w.var() - 1) < 0.15
    close = np.abs(np.corrcoef(w) - np.eye(len(w)))
    assert close.max() < 0.15
    for shift in (1, 2, 7):  # no row repeats another one some replicates later
        assert max(abs(np.corrcoef(w[i, shift:], w[j, :-shift])[0, 1]) for i in range(6) for j in range(6)) < 0.15


def test_row_keys_that_differ_by_the_prime_are_different_rows(spark):
    from ragscale.functions.hashing import stable_pair
    prime = bootstrap.PRIME
    rows = spark.createDataFrame([(5,), (5 + prime,), (5 + 2 * prime,)], "id bigint").select(*[c.alias(n) for n, c in zip("ab", stable_pair("id"))]).collect()
    assert len({(r.a % prime, r.b % prime) for r in rows}) == 3 and all(0 <= r.a < 1 << 60 and 0 <= r.b < 1 << 60 for r in rows)


@pytest.mark.parametrize("partitions", [1, 7, 60])
@pytest.mark.parametrize("block_rows", [23, 1 << 18])
def test_multinomial_does_not_depend_on_blocks_or_partitions(spark, partitions, block_rows):
    groups = {k: GROUPS[k] for k in ("ties", "narrow", "one")} | {None: GROUPS["constant"]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = by_group(bootstrap.multinomial_ci(frame(spark, groups).repartition(5), ["g"], ["v"], "id", n_resamples=60, block_rows=block_rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g, values in groups.items():
        assert (found[g]["ci_lo"], found[g]["ci_hi"]) == pytest.approx(tuple(brute_multinomial(values, 60)), abs=1e-9)


@pytest.mark.parametrize("partitions", [1, 8, 200])
@pytest.mark.parametrize("block_rows", [700, 5000, 1 << 18])
def test_trees_give_one_answer_for_all_blocks_and_partitions(spark, partitions, block_rows):
    groups = {"deep": skewed(3 * bootstrap.LEAF + 11, 3, 4), "two": skewed(bootstrap.LEAF + 1, 2, 5), "leaf": skewed(bootstrap.LEAF, 2, 6), None: GROUPS["constant"]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = by_group(bootstrap.multinomial_ci(frame(spark, groups).repartition(5), ["g"], ["v"], "id", n_resamples=7, block_rows=block_rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g, values in groups.items():
        assert (found[g]["ci_lo"], found[g]["ci_hi"]) == pytest.approx(tuple(brute_multinomial(values, 7)), abs=1e-10)


@pytest.mark.parametrize("method", METHODS)
def test_a_repeated_row_key_is_an_error(spark, method):
    df = frame(spark, {"a": [0.1, 0.2, 0.3]}).withColumn("id", F.lit(1).cast("bigint"))
    with pytest.raises(Exception, match="row key repeats"):
        method(df, ["g"], ["v"], "id").collect()


def test_more_hot_keys_than_partitions(spark, monkeypatch):
    from ragscale.operators import skew
    monkeypatch.setattr(skew, "MIN_BLOCK_ROWS", 10)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    groups = {f"g{i}": skewed(60, 2, i) for i in range(30)} | {None: skewed(80, 3, 99), "small": [0.5]}
    df = frame(spark, groups)
    hot = skew.hot_keys(df, ["g"], 25)
    assert hot.count() == 31 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = by_group(bootstrap.poisson_ci(df, ["g"], ["v"], "id", block_rows=10**6))
    split = by_group(bootstrap.poisson_ci(df, ["g"], ["v"], ["id"], block_rows=25))
    assert plain.keys() == split.keys() == groups.keys()
    for g in plain:
        assert [split[g][c] for c in ("n", "mean", "ci_lo", "ci_hi")] == pytest.approx([plain[g][c] for c in ("n", "mean", "ci_lo", "ci_hi")])


def test_composite_keys_give_real_intervals(spark):
    """Records identified by several columns, as the README shows; one column alone would repeat."""
    rows = [("m", "Q4", None, "d", "s", "pass2_loose", f"q{i // 2}", "run", f"2024-01-0{1 + i % 2}", i / 40) for i in range(40)]
    schema = "model string, quantization string, source string, dataset string, subset string, pass string, query_id string, run_id string, timestamp string, cu double"
    df = spark.createDataFrame(rows, schema)
    got = aggregate.aggregate_results(df, ["query_id", "timestamp", "run_id"], ["timestamp", "run_id"], "pass2_loose", "pass3_strict", metrics=["cu"])
    cu = {r["metric"]: r for r in got.collect()}["cu"]
    assert cu["ci_hi"] - cu["ci_lo"] > 0.1 and cu["n_queries"] == 40
    with pytest.raises(Exception, match="row key repeats"):
        aggregate.aggregate_results(df, "run_id", "timestamp", "pass2_loose", "pass3_strict", metrics=["cu"]).collect()


def test_wider_confidence_is_wider(spark):
    df = frame(spark, {"x": np.random.default_rng(25).normal(0, 1, 320)})
    wide = bootstrap.poisson_ci(df, ["g"], ["v"], "id", confidence=0.99).first()
    narrow = bootstrap.poisson_ci(df, ["g"], ["v"], "id", confidence=0.90).first()
    assert wide["ci_hi"] - wide["ci_lo"] > narrow["ci_hi"] - narrow["ci_lo"]


def test_poisson_ignores_order_and_partitions(spark):
    df = frame(spark, {"big": GROUPS["skewed"], "small": GROUPS["ties"]})
    plain = by_group(bootstrap.poisson_ci(df, ["g"], ["v"], "id"))
    mixed = by_group(bootstrap.poisson_ci(df.repartition(5).orderBy(F.rand(1)), ["g"], ["v"], "id"))
    for g in plain:
        for c in ("mean", "ci_lo", "ci_hi", "std"):
            assert mixed[g][c] == pytest.approx(plain[g][c], abs=1e-12)


def test_empty_input(spark):
    nothing = frame(spark, {"x": [1.0]}).where("false")
    assert bootstrap.poisson_ci(nothing, ["g"], ["v"], "id").count() == 0
    assert bootstrap.multinomial_ci(nothing, ["g"], ["v"], "id").count() == 0


def pairs(spark, loose, strict):
    rows = [(i, "m", "q", "d", "s", p, f"q{k}", v) for i, (p, k, v) in enumerate(
        [("pass2", k, v) for k, v in enumerate(loose)] + [("pass3", k, v) for k, v in enumerate(strict)])]
    return spark.createDataFrame(
        rows, "id bigint, model string, quantization string, dataset string, subset string, pass string, query_id string, cu double")


def test_gap_is_the_mean_difference_of_shared_queries(spark):
    rng = np.random.default_rng(12)
    loose, strict = rng.random(37) ** 2, rng.random(29)
    r = aggregate.preference_gap(pairs(spark, loose.tolist(), strict.tolist()), "id").first()
    diff = strict - loose[:29]
    assert r["n"] == 29 and r["mean"] == pytest.approx(diff.mean()) and r["std"] == pytest.approx(diff.std(ddof=1))
    assert r["ci_lo"] < r["mean"] < r["ci_hi"]


def test_gap_last_record_wins_and_nulls_drop(spark):
    df = pairs(spark, [0.1, 0.5], [0.6, None])
    later = df.where("pass = 'pass2' and query_id = 'q0'").withColumn("id", F.lit(99)).withColumn("cu", F.lit(0.4))
    rows = aggregate.paired_passes(df.unionByName(later), "id").collect()
    assert [(r["query_id"], r["loose"], r["strict"]) for r in rows] == [("q0", 0.4, 0.6)]


def test_gap_is_zero_without_a_pair(spark):
    df = pairs(spark, [0.1], []).withColumn("pass", F.lit("pass3"))
    gaps = aggregate.preference_gap(df, "id")
    out = aggregate.attach_gap(df.select("model", "quantization", "dataset", "subset", "pass").distinct(), gaps).first()
    assert [out[f"gap_{c}"] for c in ("mean", "ci_lo", "ci_hi", "std")] == [0.0] * 4


def test_aggregated_records_meet_the_contract(spark):
    from ragscale.operators.quality import aggregated_violations
    from ragscale.schemas import AGGREGATED_RECORD, METRICS
    rng = np.random.default_rng(5)
    rows = [(i, "m", "Q4", None, "d", "s", f"pass{1 + i % 3}", f"q{i // 3}", *map(float, rng.uniform(0, 0.4, len(METRICS))))
            for i in range(90)]
    schema = ("id bigint, model string, quantization string, source string, dataset string, subset string, pass string, "
              "query_id string, " + ", ".join(f"{m} double" for m in METRICS))
    flat = aggregate.aggregate_results(spark.createDataFrame(rows, schema), "id", "id").cache()
    assert flat.count() == 3 * 12
    assert aggregated_violations(flat).where("size(violations) > 0").count() == 0
    nested = aggregate.nest_aggregated(flat)
    assert [f.name for f in nested.schema] == [f.name for f in AGGREGATED_RECORD]
    records = {r["pass"]: r for r in nested.collect()}
    assert set(records["pass3"]["metrics"]) == {*METRICS, "preference_gap"}
    assert records["pass3"]["capability_degraded"] and not records["pass2"]["capability_degraded"]
    assert records["pass1"]["metrics"]["preference_gap"]["std"] == 0.0 and records["pass1"]["source"] == "local"


def test_records_are_read_three_times(spark, tmp_path):
    """Counted by the rows that leave the file scans; written intermediates are other files."""
    rng = np.random.default_rng(8)
    rows = [("m", f"Q{i % 4}", "d", "s", f"pass{2 + i % 2}", None, i // 2, i, float(rng.random())) for i in range(4000)]
    schema = "model string, quantization string, dataset string, subset string, pass string, source string, query_id int, id int, cu double"
    path = str(tmp_path / "records")
    spark.createDataFrame(rows, schema).write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(path).mapInArrow(counted, schema)
    assert aggregate.aggregate_results(df, "id", "id", metrics=["cu"]).count() > 0
    assert read.value == 3 * 4000
