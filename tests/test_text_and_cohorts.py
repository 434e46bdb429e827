import random

import pytest
from pyspark.ml.feature import VectorIndexer
from pyspark.sql import functions as F

from ripplenet.functions import dates, places, text
from ripplenet.operators import classify, profiles, regions, values
from ripplenet.plans.classification import classify_snowball


def test_clean_text(spark):
    rows = [("Don't STOP believing, wait-what?", "dont"), (None, None), ("a bb ccc", None), ("Them2 them", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    out = [r.c for r in df.select("i", text.clean_text(F.col("t"), ["stop"]).alias("c")).orderBy("i").collect()]
    assert out == ["believing wait what", " ", "", "them2 them"]


@pytest.mark.parametrize("longer_than", [0, 1, 3])
def test_words_come_from_one_pass_and_equal_those_of_the_cleaned_text(spark, longer_than):
    """Tokens as the published rule finds them, without the cleaned text and the short tokens in between."""
    rng = random.Random(2)
    parts = ["abcd", "ABC", "a1", "Zürich", "naïve", "\u0130stanbul", "\u212Aelvin", "\U0001F600", "x" * 30, "\n", "\t", "--", "\ud55c\uae00", "_", "\x00", "4you"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "."]) for _ in range(rng.randrange(40)))) for i in range(80)]
    df = spark.createDataFrame([*texts, (80, None), (81, "")], "v int, t string")
    cleaned = F.split(F.regexp_replace(F.lower(F.coalesce("t", F.lit(" "))), text.NON_ALNUM, " "), " ")
    both = df.select(text.word_tokens(F.col("t"), longer_than).alias("got"), F.filter(cleaned, lambda w: F.length(w) > longer_than).alias("rule"))
    assert all(r.got == r.rule for r in both.collect())
    plan = df.select(text.word_tokens(F.col("t"), longer_than))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "split(" not in plan


def test_profile_tokens_and_scrub(spark):
    df = spark.createDataFrame([("I'm A b2 tab\there\nnow \\n end\r",)], "t string")
    row = df.select(text.profile_tokens(F.col("t")).alias("p"), text.scrub_text(F.col("t")).alias("s")).first()
    assert row.p == ["b2", "tab", "here", "now", "end"]
    assert row.s == "I'm A b2 tab here now   end "


def test_status_time(spark):
    df = spark.createDataFrame([("Wed Nov 23 21:04:11 UTC 2016",), ("Wed Nov 23 22:04:11 UTC 2008",), ("",)], "t string")
    at = dates.parse_status_time(F.col("t"))
    rows = df.select(dates.is_off_hours(at).alias("off"), dates.years_since_1900(at).alias("y")).collect()
    assert [tuple(r) for r in rows] == [(False, 116), (True, 108), (None, None)]


def test_places(spark):
    rows = [
        ("x", '{"status":"OK","results":[{"formatted_address":"Boise, ID 83702, USA"}]}'),
        ("x", '{"status":"ZERO_RESULTS","results":[]}'),
        ("", "{}"),
    ]
    df = spark.createDataFrame(rows, "q string, p string")
    found = [r.a for r in df.select(places.geocode_address(F.col("q"), F.col("p")).alias("a")).collect()]
    assert found == ["Boise, ID 83702, USA", "invalid", "invalid"]
    addresses = spark.createDataFrame([("boise, id 83702, usa",), ("texas, usa",), ("paris, france",)], "address string")
    states = spark.createDataFrame([("Idaho", "ID")], "name string, abbreviation string")
    table = {r.address: r.region for r in regions.normalise_states(addresses, states).collect()}
    assert table == {"boise, id 83702, usa": "idaho", "texas, usa": "texas"}


def test_cohort_table(spark):
    ill = spark.createDataFrame([("idaho", 3), ("ohio", 1)], "region string, n bigint")
    well = spark.createDataFrame([("ohio", 4), ("dc", 2)], "region string, n bigint")
    table = regions.cohort_table(ill, well)
    assert sorted(tuple(r) for r in table.collect()) == [
        ("dc", 0, 2), ("idaho", 3, 0), ("ohio", 1, 4), ("south dakota", 0, 0)
    ]
    shares = {r.region: r.res for r in regions.cohort_percentage(table).collect()}
    assert shares == {"idaho": 100.0, "ohio": 20.0, "south dakota": None}


def test_values(spark):
    members = spark.createDataFrame([("a",), ("b",)], "v string")
    texts = spark.createDataFrame([("a", "Side effects, side-effects!"), ("a", "drugs"), ("c", "drugs")], "v string, text string")
    found = values.keyword_values(texts, members, ["side-effects", "drugs"])
    assert {r.v: r.k for r in found.collect()} == {"a": 6, "b": 1}
    assert all(len(words) == n for words, n in zip(values.KEYWORDS.values(), (28, 27, 25, 31)))
    ratings = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "user bigint, topic bigint")
    assert [tuple(r) for r in values.topic_values(ratings, 5).collect()] == [(1, 3)]


@pytest.mark.parametrize("segment_chars", [1000, 12])
def test_profiles_keep_every_text_in_order(spark, segment_chars):
    rows = [("a", i, f"text{i}") for i in range(9)] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "v string, at int, text string")
    found = profiles.profiles(df, "at", segment_chars=segment_chars).orderBy("v", "segment").collect()
    assert " ".join(r.profile for r in found if r.v == "a") == " ".join(f"text{i}" for i in range(9))
    assert len([r for r in found if r.v == "a"]) == (1 if segment_chars == 1000 else 5)
    assert [r.profile for r in found if r.v == "b"] == [" "]


def test_long_profiles_with_repeated_and_missing_places(spark):
    rows = [("a", i % 5, f"{i:03d}") for i in range(40)] + [("a", None, "none"), ("a", 3, "003"), ("b", 1, "x")]
    df = spark.createDataFrame(rows, "v string, at int, text string")
    found = profiles.profiles(df, "at", segment_chars=30).orderBy("v", "segment").collect()
    parts = [r.profile for r in found if r.v == "a"]
    assert len(parts) > 4 and max(map(len, parts)) <= 40
    order = sorted([r for r in rows if r[0] == "a"], key=lambda r: (r[1] is not None, r[1] or 0))
    said = " ".join(parts).split(" ")
    assert sorted(said) == sorted(r[2] for r in order) and said[0] == "none"
    place = {"none": -1} | {r[2]: r[1] for r in order if r[1] is not None}
    assert [place[t] for t in said] == sorted(place[t] for t in said)
    assert [(r.segment, r.profile) for r in found if r.v == "b"] == [(0, "x")]


@pytest.fixture(scope="module")
def words(spark):
    texts = [("u1", "alpha alpha beta gamma"), ("u2", "alpha alpha beta beta beta delta"), ("u3", "gamma gamma gamma"), ("u4", "tiny")]
    return profiles.profile_words(spark.createDataFrame(texts, "v string, text string"))


def test_vocabulary_and_vectors(spark, words):
    vocab = profiles.vocabulary(words)
    assert sorted((r.word, r.id) for r in vocab.collect()) == [("alpha", 100), ("beta", 101), ("gamma", 102)]
    trained = profiles.vector_text(profiles.training_vectors(words, vocab))
    assert {r.v: r.features for r in trained.collect()} == {"u1": "100:2 101:1 102:1", "u2": "100:2 101:3"}
    assert profiles.scoring_vectors(words, vocab, 2).select("v").collect()[0].v == "u1"
    kept = profiles.scoring_vectors(words, vocab, 1)
    assert tuple(profiles.ignored_users(words, kept).first()) == (2, 2)


def test_training_set(spark):
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("s", 0)], "v string, label int")
    seeds = spark.createDataFrame([("s",)], "v string")
    external = spark.createDataFrame([(f"x{i}",) for i in range(30)], "v string")
    found = profiles.training_set(labels, seeds, external).collect()
    assert {r.v: r.label for r in found if not r.v.startswith("x")} == {"a": 1, "s": 1, "b": 0, "c": 0}
    assert sum(r.v.startswith("x") for r in found) == int(100 / 36 * 4)


def test_forest_separates_words(spark):
    rows = [(i, float(i % 2), [i % 2], [5]) for i in range(20)] + [(100 + i, None, [i % 2], [5]) for i in range(6)]
    df = classify.as_features(spark.createDataFrame(rows, "v int, label double, ids array<int>, counts array<int>"), 2)
    training, scoring = classify.train_and_score(df)
    scored = classify.fit_labels(training).transform(scoring)
    assert {r.v: r.predictedLabel for r in scored.collect()} == {100 + i: str(float(i % 2)) for i in range(6)}
    fixed = spark.createDataFrame([(1,)], "v int")
    table = classify.prediction_table(scored, fixed, fixed)
    assert table.count() == 8 and table.where("v = 1 AND label = '1.0'").count() == 2


def test_feature_index_agrees_with_the_fitted_indexer(spark):
    """Categories of up to four values, zeros of absent words among them; the fifth value makes a feature continuous."""
    rng = random.Random(6)
    rows = []
    for v in range(60):
        some = {100: rng.choice([1, 2]), 101: rng.choice([1, 2, 3, 4]), 102: rng.randrange(1, 6), 103: 1}
        if v % 3:
            some.update({104: rng.choice([1, 2, 3]), 105: rng.randrange(1, 5)})
        rows.append((v, sorted(some), [some[i] for i in sorted(some)]))
    vectors = spark.createDataFrame(rows, "v bigint, ids array<bigint>, counts array<bigint>")
    got = {r.id: (r["values"], r.categorical) for r in classify.feature_index(vectors).collect()}
    fitted = VectorIndexer(inputCol="features", outputCol="x", maxCategories=4).fit(classify.as_features(vectors, 106))
    maps = {int(k): sorted(m) for k, m in fitted.categoryMaps.items() if k >= 100}
    assert {i: v for i, (v, categorical) in got.items() if categorical} == maps and set(got) == set(range(100, 106))
    assert all(len(v) == 5 for v, categorical in got.values() if not categorical)


def test_snowball_classification_of_a_small_world(spark):
    """Seeds 1 and 2, wave one 10 to 13 with 10 and 11 known before, wave two 20 to 23, of which 23 has no texts."""
    links = [(1, 10), (1, 11), (2, 12), (2, 13), (1, 2), (10, 20), (10, 21), (11, 22), (11, 12), (11, 23), (12, 30), (10, 1)]
    sad, glad = "lonely empty tired crying lonely tired ", "sunny happy garden music happy garden "
    told = {1: sad, 2: sad, 50: sad, 51: sad, 60: glad, 61: glad, 20: sad, 21: glad, 22: glad, 12: sad, **{90 + k: glad for k in range(6)}}
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    table = classify_snowball(
        frame([(v, t * 2) for v, t in told.items()], "v bigint, text string"), frame(links, "src bigint, dst bigint"),
        frame([(1,), (2,)], "v bigint"), frame([(50, 1), (51, 1), (60, 0), (61, 0)], "v bigint, label int"),
        frame([(10,), (11,), (30,)], "v bigint"), frame([(90 + k,) for k in range(6)], "v bigint"),
    )
    got = {r.v: (r.label, r.part) for r in table.collect()}
    assert got == {
        1: ("1.0", "seed"), 2: ("1.0", "seed"), 10: ("1.0", "kept"), 11: ("1.0", "kept"),
        20: ("1.0", "scored"), 21: ("0.0", "scored"), 22: ("0.0", "scored"),
    }
