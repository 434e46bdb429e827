from types import SimpleNamespace

import pytest
from graph_helpers import pairs
from pyspark.sql import functions as F

from ripplenet import storage
from ripplenet.operators.cleaning import clean_edges
from ripplenet.plans import report, sweep
from ripplenet.sources import files


def write(folder, name, *lines):
    path = folder / name
    path.write_text("".join(f"{line}\n" for line in lines))
    return str(path)


def test_edge_lists(spark, tmp_path):
    path = write(tmp_path, "edges.txt", "# comment", "1 2", "", "2\t 3", "  3   1 9")
    assert pairs(files.read_edge_list(spark, path)) == [(1, 2), (2, 3), (3, 1)]
    broken = write(tmp_path, "broken.txt", "1 2", "7", "x y")
    assert pairs(files.read_edge_list(spark, broken, "DROP")) == [(1, 2)]
    with pytest.raises(Exception, match="not an edge"):
        files.read_edge_list(spark, broken).collect()


def test_named_networks(spark, tmp_path):
    path = write(tmp_path, "n.txt", "1 2", "2 1", "2 3", "3 3")
    catalog = {"a": files.Network(path), "b": files.Network(path, "mutual"), "c": files.Network(path, "raw")}
    assert pairs(files.load_network(spark, "a", catalog)) == [(1, 2), (2, 3)]
    assert pairs(files.load_network(spark, "b", catalog)) == [(1, 2)]
    assert len(pairs(files.load_network(spark, "c", catalog))) == 4
    with pytest.raises(ValueError, match="unknown network"):
        files.load_network(spark, "d", catalog)
    assert files.clean_mode("enron") == "mutual" and files.clean_mode("dblp") == "simple"
    with pytest.raises(ValueError):
        files.clean_mode("wiki")


def test_text_layouts(spark, tmp_path):
    user = write(tmp_path, "u.tsv", 'a\tb\tNew "York\t1\t2\tnull\t\ten\t0\t \tnull\tff\t7')
    row = files.read_user_info(spark, user).first()
    assert (row.screen_name, row.location, row.created, row.statuses) == ("b", 'New "York', None, 7)
    line = "u\t \tWed Nov 23 21:04:11 UTC 2016\t-1\t0\tnull\tx\t1\t2\ten\tnull\t3\thello\tfalse\ttrue"
    row = files.read_timeline(spark, write(tmp_path, "t.tsv", line)).first()
    assert (row.user, row.text, row.truncated) == ("u", "hello", True)
    assert files.read_predictions(spark, write(tmp_path, "p.tsv", "u\t1.0")).first().label == "1.0"
    assert files.read_labels(spark, write(tmp_path, "l.tsv", "u\t1")).first().label == 1
    assert files.read_list(spark, write(tmp_path, "s.txt", "the", "and", "the")).count() == 2
    votes = files.read_votes(spark, write(tmp_path, "v.tsv", "u\t0", "w"))
    assert sorted(tuple(r) for r in votes.collect()) == [("u", 0), ("w", 2)]
    ratings = files.read_ratings(spark, write(tmp_path, "r.tsv", "1\t2\t3", "1\t2"))
    assert [tuple(r) for r in ratings.collect()] == [(2, 3)]
    assert files.read_external_profiles(spark, write(tmp_path, "e.tsv", "u\ttext", "bad")).count() == 1
    assert files.read_external_corpus(spark, write(tmp_path, "c.tsv", "u\t1\ttext\t2", "bad")).first().text == "text"
    assert files.read_location_lookup(spark, write(tmp_path, "lo.tsv", "NYC\tNew York, USA")).first().location == "nyc"
    assert files.read_state_lookup(spark, write(tmp_path, "st.tsv", "Idaho\tID")).first().abbreviation == "id"
    assert files.read_libsvm(spark, write(tmp_path, "v.libsvm", "1 1:2 5:1")).first().label == 1.0


def test_sinks(spark, tmp_path):
    vocab = spark.createDataFrame([("word", 100)], "word string, id bigint")
    files.write_vocabulary(vocab, str(tmp_path / "vocab"))
    assert tuple(files.read_vocabulary(spark, str(tmp_path / "vocab")).first()) == ("word", 100)
    files.write_libsvm(spark.createDataFrame([(1, "100:2")], "label int, features string"), str(tmp_path / "vec"))
    assert spark.read.text(str(tmp_path / "vec")).first().value == "1 100:2"
    dist = spark.createDataFrame([(2, 5, 0.5)], "k int, n int, fraction double")
    files.write_tsv(dist, str(tmp_path / "dist"))
    assert spark.read.text(str(tmp_path / "dist")).first().value == "2\t5\t0.5"


@pytest.mark.parametrize("draws", ["multinomial", "hashed"])
def test_sweep_rows_are_consistent(spark, tmp_path, draws):
    ends = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(200)).alias(n) for i, n in enumerate(("src", "dst"))]
    edges = storage.materialize(clean_edges(spark.range(800).select(*ends)))
    runs = sweep.parameter_grid(spark, iteration=[1, 2], seed_count=[1, 5])
    rows = sweep.sweep(edges, runs, [0, 2], reps=40, draws=draws, max_seeds=10).withColumn("method", F.lit("pooled")).withColumn("seed", F.col("seed_count"))
    rows = storage.materialize(rows)
    assert rows.count() == 8
    for r in rows.collect():
        assert r.lmin <= r.l1 <= r.mean <= r.l2 <= r.lmax and 0 < r.lmsiDistinct <= r.lmsiAll and r.lmsiDistinct <= 1
        assert r.edges == edges.count()
        if r.wave == 0:
            assert r.lmsiAll == r.lmsiDistinct
    files.write_results(rows, str(tmp_path / "results"), "real")
    read = files.read_results(spark, str(tmp_path / "results"))
    assert read.columns == files.RESULT_COLUMNS["real"] and read.count() == 8
    table = report.interval_table(rows, ["seed_count"])
    assert table.count() == 2
    assert report.interval_gini(rows, ["wave"]).where("gini_interval BETWEEN 0 AND 1").count() == 2


def test_per_seed_sweep_includes_more(spark, tiny_edges):
    runs = sweep.parameter_grid(spark, iteration=[1], seed_count=[3])
    pooled, single = (
        sweep.sweep(clean_edges(tiny_edges), runs, [2], reps=5, method=m, max_seeds=3).first() for m in ("pooled", "per_seed")
    )
    assert single.lmsiAll > pooled.lmsiAll and single.lmsiDistinct == pooled.lmsiDistinct


def session_stub(folder, master):
    """Just enough of a session to ask where its tables go."""
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_scratch_follows_the_session():
    assert storage.scratch_root(session_stub("hdfs://shared/dir/", "yarn")) == "hdfs://shared/dir"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_root(session_stub(None, "yarn"))
    local = session_stub(None, "local[2]")
    assert storage.scratch_root(local) == storage.scratch_root(local)


def test_scratch_needs_a_shared_folder_on_any_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_root(session_stub(None, "local-cluster[3,2,1024]"))


def test_lines_that_end_in_empty_fields(spark, tmp_path):
    votes = files.read_votes(spark, write(tmp_path, "v.tsv", "u\t", "w\t1"))
    assert sorted(tuple(r) for r in votes.collect()) == [("u", 2), ("w", 1)]
    assert files.read_ratings(spark, write(tmp_path, "r.tsv", "1\t2\t", "1\t2\t3\t")).count() == 1


def test_malformed_rows_stop_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_labels(spark, write(tmp_path, "l.tsv", "u\tx")).collect()


def test_texts_with_breaks_stay_one_row(spark, tmp_path):
    rows = spark.createDataFrame([("a", " one\ntwo\tthree\x00 "), ("b", "plain")], "v string, text string")
    files.write_tsv(rows, str(tmp_path / "t"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == ["a\t one two three  ", "b\tplain"]
