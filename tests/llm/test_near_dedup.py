"""ProbMinHash near-duplicates against exact pairs and components in plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from ripplenet.llm import near_dedup

FAR = 2**63 - 1


def plain_groups(rows, similarity=0.8):
    """Smallest id of each component of the exact links."""
    sets = defaultdict(set)
    for i, text in rows:
        words = near_dedup._WORDS((text or "").lower())
        key = FAR if i is None else i
        sets[key] |= {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        shared.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in sets}


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_groups(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = FAR if r["doc_id"] is None else r["doc_id"]
        assert (FAR if r["class_id"] is None else r["class_id"]) == want[key]
        assert r["kept"] == (want[key] == key)


def test_groups_of_documents(documents):
    check(documents)


def test_odd_and_empty_tables(odd_documents, no_documents):
    check(odd_documents.withColumn("_class", F.lit("x")))
    assert near_dedup.near_duplicates(no_documents).collect() == []


@pytest.mark.parametrize("all_pairs", [32, 2])
def test_groups_of_edited_copies(spark, monkeypatch, all_pairs):
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(near_dedup, "PART", 4)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    rows, passage = [], [word() for _ in range(60)]
    for group in range(6):
        base = [word() for _ in range(200)]
        for copy in range(1 + 12 * group):
            words = list(base)
            if copy:
                words[draw.randrange(200)] = word()
            rows.append((group * 1000 + copy, " ".join(words)))
    rows += [(9000 + k, " ".join(passage + [word() for _ in range(60)])) for k in range(60)]
    rows += [(9500 + k, "Only, four words here") for k in range(5)] + [(9600, "only four words")]
    draw.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_registers_agree_as_often_as_the_probability_jaccard_similarity():
    x, y = {1: 3.0, 2: 1.0, 3: 2.0, 4: 1.0}, {1: 1.0, 2: 1.0, 3: 4.0, 5: 2.0}
    share = lambda i: 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y})
    want = sum(share(i) for i in x if i in y)
    text = np.array([0] * 4 + [1] * 4)
    mixed = near_dedup._mix(np.array([*x, *y], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = near_dedup.signatures(2, text, mixed, np.array([*x.values(), *y.values()]), 40_000)
    assert abs((out[0] == out[1]).mean() - want) < 0.012


def test_bands_find_pairs_at_the_threshold():
    draw = np.random.default_rng(1)
    found = 0
    for _ in range(200):
        pool = draw.integers(0, 2**63, 110).astype(np.uint64)
        a, b = pool[:100], np.concatenate([pool[:89], pool[100:]])  # similarity 89 / 111
        value = np.concatenate([np.sort(a), np.sort(b)])
        text = np.repeat([0, 1], [100, len(b)])
        keys = near_dedup.band_keys(
            near_dedup.signatures(2, text, value, np.ones(len(value)), near_dedup.BANDS * near_dedup.ROWS),
            near_dedup.BANDS, near_dedup.ROWS,
        )
        found += (keys[0] == keys[1]).any()
    assert found == 200


def test_copies_that_differ_in_repeat_counts_share_a_band():
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    for _ in range(40):
        body, line = [word() for _ in range(300)], [word() for _ in range(10)]
        texts = [body + line * n for n in (2, 22, 62)]
        keys = near_dedup.text_keys(3, *near_dedup.shingles(texts), near_dedup.BANDS, near_dedup.ROWS)
        assert len(np.intersect1d(keys[0], keys[1])) and len(np.intersect1d(keys[0], keys[2]))


def test_groups_of_copies_that_differ_in_repeat_counts(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    rows = []
    for group in range(20):
        body, line = [word() for _ in range(300)], [word() for _ in range(10)]
        rows += [(10 * group + k, " ".join(body + line * n)) for k, n in enumerate((2, 62, 150))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


@pytest.mark.parametrize("block", [64, 2])
def test_components_that_share_a_large_bucket_meet(spark, block):
    draw = random.Random(8)
    base = [draw.randrange(2**40) for _ in range(100)]
    texts = {r: set(base[: 100 - 4 * r]) | {draw.randrange(2**40) for _ in range(2 * r)} for r in range(1, 9)}
    sets = spark.createDataFrame([(r, sorted(s)) for r, s in texts.items()], "_id bigint, shingles array<bigint>")
    members = spark.createDataFrame(
        [(k, r, 1 if r < 4 else r, 1) for k, some in ((7, range(1, 6)), (8, range(4, 9))) for r in some],
        "_key bigint, rep bigint, label bigint, _main bigint",
    )
    want = {
        (a, b) for a in texts for b in texts
        if a < b and b > 3 and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])
    }
    got = near_dedup.remaining_links(members, sets, 0.8, block)
    assert want and {tuple(r) for r in got.collect()} == want


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, a), (3, b), (2, b), (5, a), (9, "else where")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in out) == [(2, 2), (3, 2), (3, 2), (5, 2), (9, 9)]


def test_rows_with_a_null_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (9, b), (None, a), (None, b + " end"), (None, c), (None, c + " end"), (None, "else where")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    ids = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in out if r["doc_id"] is not None)
    assert ids == [(5, 5, True), (9, 9, True)]
    nulls = sorted((r["class_id"] or 0, r["kept"]) for r in out if r["doc_id"] is None)
    assert nulls == [(0, False), (0, True), (0, True), (5, False), (9, False)]


def test_new_links_join_components_without_walking_the_old_ones(spark, monkeypatch):
    old = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 203), (203, 204)]
    new = [(40, 100), (101, 300), (5, 17), (200, 204), (400, 401)]
    frame = lambda links: spark.createDataFrame(links, "a bigint, b bigint")
    known = near_dedup.components(frame(old))
    want = {tuple(r) for r in near_dedup.components(frame(old + new)).collect()}
    written, write = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, label: written.append((label, out := write(df, label))) or out)
    got = near_dedup.components(frame(new), known)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # Both ways of the three links between components; no old link is walked again.
    assert [out.count() for label, out in written if label == "links"] == [6]
    written.clear()
    assert near_dedup.components(frame([(5, 17), (200, 204)]), got) is got
    assert [label for label, _ in written] == ["component-links"]
