"""Replicates whose draws are split by hashed binomials: their law, and the whole sizes of the sweeps that use them."""

from math import comb

import duckdb
import numpy as np
import pytest

from ripplenet import storage
from ripplenet.operators.bootstrap import bootstrap_hashed, bootstrap_split, hashed_binomials, split_sums
from ripplenet.plans import sweep
from workload import inputs, sampling

REPS = np.arange(1, 20_001)


@pytest.mark.parametrize("n, p", [(1, 0.3), (60, 0.1), (60, 0.45), (60, 0.9), (200, 0.5)])
def test_binomials_follow_their_law(n, p):
    """By inversion and by rejection, to either side of 1/2."""
    found = hashed_binomials(np.full(len(REPS), n), p, "law", REPS)
    expected = np.array([comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]) * len(REPS)
    seen, some = np.bincount(found, minlength=n + 1), expected > 5
    squares = ((seen - expected)[some] ** 2 / expected[some]).sum()
    assert len(seen) == n + 1 and squares < some.sum() + 5 * np.sqrt(2 * some.sum())


@pytest.mark.parametrize("n", [100_000, 10**9])
def test_large_binomials_have_their_mean_and_spread(n):
    for p in (0.5, 0.01, 0.999):
        found = hashed_binomials(np.full(len(REPS), n), p, "large", REPS)
        spread = np.sqrt(n * p * (1 - p))
        assert abs(found.mean() - n * p) < 5 * spread / np.sqrt(len(REPS)) and 0.97 < found.std() / spread < 1.03


def test_sums_follow_the_weights():
    ks, weights = np.array([0, 2, 5, 9, 40]), np.array([700, 20, 5, 1000, 1])
    p = weights / weights.sum()
    found = split_sums(500, ks, weights, "sums", REPS)
    mean, spread = 500 * (p @ ks), np.sqrt(500 * (p @ ks**2 - (p @ ks) ** 2))
    assert abs(found.mean() - mean) < 5 * spread / np.sqrt(len(REPS)) and 0.97 < found.std() / spread < 1.03
    assert (split_sums(7, ks[3:4], weights[3:4], "one", REPS) == 63).all()


def test_split_and_hashed_replicates_agree(spark):
    groups = spark.createDataFrame([(0, 1, k, n, n) for k, n in ((1, 9), (3, 40), (8, 2), (2000, 1))], "run_id bigint, wave int, k bigint, n bigint, reached bigint")
    seeds = spark.createDataFrame([(0, 1, 10), (0, 2, 11)], "run_id bigint, ord bigint, v bigint")
    values = spark.createDataFrame([(10, 1), (11, 3)], "v bigint, k bigint")
    means = []
    for boot in (bootstrap_hashed, bootstrap_split):
        stats = np.array([r.stat for r in boot(groups, seeds, values, 3000).collect()])
        means.append((stats.mean(), stats.std() / np.sqrt(len(stats))))
        assert len(stats) == 3000
    assert abs(means[0][0] - means[1][0]) < 6 * (means[0][1] + means[1][1])


@pytest.fixture()
def asked(monkeypatch):
    """What the registered sweeps ask for; none is run."""
    calls = []

    def note(edges, runs, waves, reps=sweep.BOOT_COUNT, **more):
        rows = runs.select("iteration", "seed_count").collect()
        calls.append(({r.iteration for r in rows}, {r.seed_count for r in rows}, list(waves), reps))
        raise StopIteration

    monkeypatch.setattr(sweep, "sweep", note)
    return calls


@pytest.fixture()
def tables(spark, tmp_path):
    """Orders and events of few parts and users."""
    lines = "id DIV 6 AS l_orderkey", "CAST(id % 6 AS int) AS l_linenumber", "pmod(xxhash64(id), 40) AS l_partkey"
    spark.range(400).selectExpr(*lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id AS event_id", "pmod(xxhash64(id, 1), 25) AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_wave_sweep_has_its_published_size(spark, tables, asked):
    """It had 2 of 50 iterations and 3 of 1000 replicates."""
    with pytest.raises(StopIteration), storage.scratch(spark):
        sampling.sweep_waves(spark, tables)
    assert asked == [(set(range(1, 51)), {20}, list(range(9)), 1000)]


def test_report_sweep_has_its_published_size(spark, tables, asked):
    """It had 5 of 1000 replicates, wave 1, and one of the four seed counts shown against embeddedness."""
    with pytest.raises(StopIteration), storage.scratch(spark):
        sampling._new_small_sweep(spark, tables)
    assert asked == [(set(range(1, 51)), {1, 5, 10, 20, 40, 50, 80, 100}, [2], 1000)]


def test_sql_repeats_split_draws(spark, tables):
    """The tree of binomials in SQL, over inversion and rejection, draws the same replicates."""
    runs = sweep.real_network_runs(spark, iterations=2, seed_count=5)
    with storage.scratch(spark):
        rows = sampling._sweep_rows(sweep.sweep(inputs.part_graph(spark, tables), runs, [0, 1, 2], reps=60, draws="split"))
        got = sorted(tuple(r) for r in rows.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tables}/lineitem.parquet/*.parquet'")
    sql = f"WITH {inputs.PART_GRAPH}, {sampling._sweep([1, 2], [5], [0, 1, 2], 60, 'deg', 'deg', boot=inputs.split_boot_sql)} {sampling.SWEEP_OUT}"
    want = sorted(con.execute(f"SELECT {', '.join(rows.columns)} FROM ({sql})").fetchall())
    assert len(got) == 6 and [tuple(r) for r in want] == [pytest.approx(r, abs=1e-6) for r in got]
