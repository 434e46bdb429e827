"""Work that is done once, and in bounded tasks."""

import pytest

from ripplenet.operators import ordering, profiles, traversal


def test_keys_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    keys = spark.range(30).repartition(2).mapInArrow(count, "id bigint").selectExpr("concat('w', id) AS word")
    ids = {r.word: r.id for r in ordering.assign_ids(keys, "word", base=100).collect()}
    assert ids == {w: 100 + i for i, w in enumerate(sorted(f"w{i}" for i in range(30)))} and made.value == 30


def test_words_are_counted_in_bounded_parts(spark):
    rows = [(i % 50, "alpha beta " * 5 + f"word{i % 7}") for i in range(400)] + [(None, "alpha gamma"), (None, None)]
    texts = spark.createDataFrame(rows, "v int, text string").coalesce(1)
    dealt = profiles.profile_words(texts, task_bytes=1000)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, profiles.profile_words(texts).collect()))


def test_successors_move_their_rows_once(spark):
    """The rows are sorted where they are paired: nothing is shuffled by group afterwards, only the two ends of each slice."""
    df = spark.range(1000).selectExpr("id div 7 AS g", "id AS i", "id * 3 AS x")
    pairs = ordering.successors(df, ["g"], ["i"], "x", 5)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(_slice#") == 1
    got = sorted(tuple(r) for r in pairs.collect())
    assert got == [(3 * i, 3 * i + 3) for i in range(999) if i // 7 == (i + 1) // 7]


@pytest.mark.parametrize("rows_per_salt", [10, 1_000_000])
def test_edges_of_one_round_are_not_laid_out(spark, monkeypatch, rows_per_salt):
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)]
    edges, seeds = spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.createDataFrame([(0, 0), (1, 7)], "run_id long, v long")
    laid = traversal.build_adjacency(edges, rows_per_salt=rows_per_salt)
    want = sorted(map(str, traversal.wave_increments(laid, seeds, 1).collect()))
    monkeypatch.delattr(traversal, "materialize_bucketed")
    once = traversal.build_adjacency(edges, rows_per_salt=rows_per_salt, rounds=1)
    assert (once.salts is None) == (rows_per_salt > 1000)
    assert sorted(map(str, traversal.wave_increments(once, seeds, 1).collect())) == want
    assert {(r.v, r.k) for r in once.degrees.collect()} >= {(0, 59), (1, 2), (2, 3)}
